"""Fuzzy line deduplication.

Lines are normalised to their words (runs of letters and digits, lower case; in scripts without blanks each character). Equal lines are one node. Two nodes of n <= m
words with edit similarity p or more are at most (1-p)m edits apart. An edit breaks at most two of a line's bigrams, and two
only where it hits a word between two neighbours, so of some of a line's bigrams it is known how many can be broken; the rest
is in both. Of each line the bigrams that are first in one order of all are taken, one more than can be broken: the first common
one is among them in both lines, and the lines meet under it (below p = 0.75 the same is done with words). The order is by frequency in all documents; which order it is
decides on the work only. What meets and can be similar by the numbers of words and the parities of words by hash range is a
candidate, so that no pair is lost. Candidates are verified by the edit similarity of their word sequences, and of each
connected group the occurrence with the smallest (doc_id, line number) stays.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Overlaps, _INVERSE, _BASE, chunks, connect, covered, dealt_parts, forest, free_names, joining, lower_bytes, mix64, quoted, slices, stage, word_hashes

#: Lines under one gram that are held against each other together with those of other grams; more are one by one.
_FEW = 64
#: Places of the table of gram frequencies (bits).
_TABLE_BITS = 18
#: Of the pairs under one gram a star stands for those that are more than so many to a line; fewer are candidates themselves.
_EACH = 4
#: Lines under one gram up to which all their pairs are looked at at once.
_SQUARE = 512
#: 64-bit words of the parities that lines are held against where they meet, and members of stars before their words are.
_NARROW, _WIDE = 4, 4
_WIDE_NAMES = [f"p{k}" for k in range(_WIDE)]
#: The grams are dealt in so many rounds, one after the other, so that the shuffle of one is gone before the next.
ROUNDS = 2

#: Code points of scripts that are written without blanks between words.
_BLANKLESS = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF),
              (0x4E00, 0x9FFF), (0xA000, 0xA4CF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))

_SIGNS = np.ones(256, bool)  # ASCII signs and blanks part words; bytes from 128 on belong to letters
_SIGNS[128:] = False
for _c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _SIGNS[_c] = False


def _alone(data: np.ndarray) -> np.ndarray:
    """Edges of the characters of scripts without blanks, each a word: Thai, Lao, Myanmar, Khmer, kana, Bopomofo, Han, Yi."""
    if not len(data) or data.max() < 0xE0:
        return np.zeros(0, np.int64)
    lead = np.flatnonzero((data >= 0xE0) & (data < 0xF5))
    four = data[lead] >= 0xF0
    size = np.where(four, 4, 3)
    padded = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.int64)
    cp = np.where(four, (padded[lead] & 7) << 18 | (padded[lead + 1] & 63) << 12 | (padded[lead + 2] & 63) << 6 | padded[lead + 3] & 63,
                  (padded[lead] & 15) << 12 | (padded[lead + 1] & 63) << 6 | padded[lead + 2] & 63)
    some = np.zeros(len(lead), bool)
    for lo, hi in _BLANKLESS:
        some |= (cp >= lo) & (cp <= hi)
    return np.concatenate((lead[some], lead[some] + size[some]))


def line_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of lower-cased texts, first word of each line, first line of each text (lines are parted by \\n), word sizes."""
    breaks = np.flatnonzero(data == 10) + 1
    starts = np.sort(np.concatenate((offsets[:-1], breaks)), kind="stable")
    first_line = np.searchsorted(breaks, offsets[:-1], "right") + np.arange(len(offsets) - 1)
    # A break in front of a text's first byte can't be its own: texts begin a line of their own.
    ends = np.append(starts, len(data))
    edges = np.unique(np.concatenate((ends, _alone(data))))
    words, first_word, size = word_hashes(data, edges, _SIGNS, sizes=True)
    first_word = first_word[np.searchsorted(edges, ends)]
    return words, first_word, np.append(first_line, len(starts)), size


def line_names(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Order-sensitive 64-bit names of the word sequences of lines; 0 for lines without words."""
    n = len(words)
    steps, back = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, _INVERSE, np.uint64)
    steps[0] = back[0] = 1
    up, down = np.cumprod(steps), np.cumprod(back)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(words) * up[:n])))
    count = np.diff(first)
    names = mix64((total[first[1:]] - total[first[:-1]]) * down[first[:-1]] + count.astype(np.uint64))
    return np.where(count > 0, names, np.uint64(0)).view(np.int64)


def parities(words: np.ndarray, first: np.ndarray, wide: int = 1) -> np.ndarray:
    """For each line `wide` words of 64 bits: whether the number of its words in each range of the mixed hash is odd."""
    bits = np.zeros((len(words) + 1, wide), np.uint64)
    h = mix64(words)
    bits[np.arange(len(words)), (h & np.uint64(0xFF)).astype(np.int64) % wide] = np.uint64(1) << (h >> np.uint64(58))
    bits = np.bitwise_xor.reduceat(bits, first[:-1], axis=0) if len(first) > 1 else bits[:0]
    bits[np.diff(first) == 0] = 0
    return bits.view(np.int64)


def may_link(n, x, m, y, percent: int):
    """Whether lines of n and m words with parities x and y can be similar: an edit changes two words' parities, a deletion one."""
    short, long = np.minimum(n, m), np.maximum(n, m)
    far = np.int16(0)
    for w in range(x.shape[-1]):
        far = far + np.bitwise_count(np.asarray(x[..., w] ^ y[..., w]).view(np.uint64)).astype(np.int16)
    return (100 * short >= percent * long) & (far <= 2 * ((100 - percent) * long // 100) - (long - short))


def _grams(words: np.ndarray, first: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Line and hash of the grams of lines: bigrams from 75 % on, words below."""
    line = np.repeat(np.arange(len(first) - 1), np.diff(first))
    if percent < 75:
        return line, mix64(words)
    inside = np.flatnonzero(line[:-1] == line[1:])
    return line[inside], mix64(mix64(words[inside]) + words[inside + 1])


#: Place of a gram that a line has more than once, or that lies too far back to tell.
_ANYWHERE = 0xFFFF


def leading_grams(words: np.ndarray, first: np.ndarray, percent: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line, hash (its upper 42 bits) and place of the distinct grams under which lines meet; order: rank below 64 by the hash's upper bits.

    A line takes grams until not all of them can be broken. Of k bigrams of a line of n words, among them at most P pairs of neighbours
    without a common one, u words hit and v insertions break u + min(u, P) + v. A line of m >= n words allows u + v <= (1-p)m with
    v >= m - n; over all m, and for shorter lines too, that is at most ((1-p)n + (2p-1)P) / p, and 2(1-p)n.
    """
    most = np.diff(first) * (100 - percent) // (50 if percent >= 75 else 100)
    lines, grams, places = [first[:0]], [words[:0]], [first[:0]]
    for lo in range(0, len(most), 1 << 16):  # one sort of 64-bit words: line, rank, gram
        part = first[lo: lo + (1 << 16) + 1]
        line, gram = _grams(words[part[0]: part[-1]], part - part[0], percent)
        key = line.astype(np.uint64) << np.uint64(48) | order[(gram >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(42) | gram >> np.uint64(22)
        begin = np.searchsorted(line, np.arange(len(part)))
        each, begin = np.diff(begin), begin[:-1]
        at = np.argsort(key)
        key, index = key[at], np.arange(len(key))
        again = np.zeros(len(key) + 1, bool)
        again[1:-1] = key[1:] == key[:-1]
        keep = (index <= np.repeat(begin + most[lo: lo + len(each)], each)) & ~again[:-1]
        if percent >= 75:  # percent * k <= (100 - percent) * n + (2 * percent - 100) * P, both k and P less what they were where the line began
            pairs = _neighbours(at, line)
            enough = percent * begin + (100 - percent) * np.diff(part) - (2 * percent - 100) * pairs[begin]
            keep &= percent * index - (2 * percent - 100) * pairs[:-1] <= np.repeat(enough, each)
        keep = np.flatnonzero(keep)
        line = line[keep]
        lines.append(line + lo)
        grams.append(key[keep] & np.uint64((1 << 42) - 1))
        places.append(np.where(again[keep + 1] | again[keep], _ANYWHERE, np.minimum(at[keep] - begin[line], _ANYWHERE)))
    return np.concatenate(lines), np.concatenate(grams), np.concatenate(places)


def _neighbours(at: np.ndarray, line: np.ndarray) -> np.ndarray:
    """For each k, how many disjoint pairs of neighbours of one line are among the places at[:k], or more; line: of each place.

    In a run of n places these are n // 2 = (n - 1) - (n - 2) + (n - 3) - ...: twos less threes and so on, and up to fours it is no less.
    """
    n = len(at)
    if not n:
        return np.zeros(1, np.int64)
    since = np.empty(n, np.int64)
    since[at] = np.arange(n)
    twos = np.maximum(since[:-1], since[1:])
    twos[line[:-1] != line[1:]] = n
    threes = np.maximum(twos[:-1], twos[1:])
    fours = np.maximum(threes[:-1], threes[1:])
    count = np.bincount(twos, minlength=n + 1) - np.bincount(threes, minlength=n + 1) + np.bincount(fours, minlength=n + 1)
    return np.concatenate(([0], np.cumsum(count[:n])))


def may_align(n, i, m, j, percent: int):
    """Whether lines of n and m words that share a gram at the places i and j can be similar with these aligned."""
    apart = np.abs(i - j) + np.abs((n - i) - (m - j))
    return (apart <= (100 - percent) * np.maximum(n, m) // 100) | (np.maximum(i, j) == _ANYWHERE)


def _pairs(parts: list[np.ndarray]) -> np.ndarray:
    """Distinct pairs."""
    both = np.concatenate(parts)
    both = both[np.lexsort((both[:, 1], both[:, 0]))]
    fresh = np.ones(len(both), bool)
    fresh[1:] = (both[1:] != both[:-1]).any(1)
    return both[fresh]


def word_edit_distance(a: list, b: list) -> int:
    """Levenshtein distance of two sequences, by Myers' bit vectors in one integer."""
    if not a or not b:
        return len(a) + len(b)
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full, last, score = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    plus, minus = full, 0
    for y in b:
        eq = where.get(y, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & full
        mh = plus & xh
        score += bool(ph & last) - bool(mh & last)
        ph = (ph << 1 | 1) & full
        mh = mh << 1 & full
        plus, minus = mh | ~(xv | ph) & full, ph & xv
    return score


def _common(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """How many 32-bit words each x has in common with its y, as often as both have them."""
    size = np.array([len(z) // 4 for z in (*x, *y)], np.int64)
    pair = np.repeat(np.concatenate((np.arange(len(x)), np.arange(len(y)))), size).astype(np.uint64)
    word = np.frombuffer(b"".join((*x, *y)), np.uint32).astype(np.uint64)
    key = pair << np.uint64(33) | word << np.uint64(1)
    key[size[: len(x)].sum():] |= np.uint64(1)
    key.sort()
    start = np.flatnonzero(np.append(True, key[1:] >> np.uint64(1) != key[:-1] >> np.uint64(1))[: len(key)])
    if not len(start):
        return np.zeros(len(x), np.int64)
    right = np.add.reduceat((key & np.uint64(1)).astype(np.int64), start)
    both = np.minimum(right, np.diff(np.append(start, len(key))) - right)
    return np.bincount((key[start] >> np.uint64(33)).astype(np.int64), both, minlength=len(x)).astype(np.int64)


def similar(x: list[bytes], y: list[bytes], percent: int) -> np.ndarray:
    """Whether sequences of 32-bit words are similar by edit distance; each x is held against its y.

    Most are, by one shift at most: matches of a common beginning and end as they lie bound the distance from above. Of the others those with
    too few common words are not, and the rest are measured.
    """
    x, y = zip(*((a, b) if len(a) <= len(b) else (b, a) for a, b in zip(x, y))) if x else ((), ())
    n, m = (np.array([len(a) // 4 for a in z], np.int64) for z in (x, y))
    a, b = (np.frombuffer(b"".join(z), np.uint32) for z in (x, y))
    begin = np.cumsum(n) - n
    at = np.arange(len(a)) + np.repeat(np.cumsum(m) - m - begin, n)
    front, back = a == b[at], a == b[at + np.repeat(m - n, n)]
    gain = np.concatenate(([0], np.cumsum(front.astype(np.int64) - back)))
    total = np.concatenate(([0], np.cumsum(back)))
    most = np.maximum(0, np.maximum.reduceat(gain[1:], begin) - gain[begin]) if len(a) else n
    keep = 100 * (most + total[begin + n] - total[begin]) >= percent * m
    rest = np.flatnonzero(~keep & (100 * n >= percent * m))
    rest = rest[100 * _common([x[k] for k in rest], [y[k] for k in rest]) >= percent * m[rest]]
    for k in rest:
        keep[k] = 100 * (m[k] - word_edit_distance(np.frombuffer(x[k], np.uint32).tolist(), np.frombuffer(y[k], np.uint32).tolist())) >= percent * m[k]
    return keep


def _lines(docs: DataFrame, percent: int, least_words: int) -> DataFrame:
    """doc_id, text_hash, line_no, line (name), n_words of every line with words; of each task one row of
    n_words -1 and, in parity, how often it met grams of distinct lines of least_words or more words, by the upper bits of their hashes."""
    names_out = ["doc_id", "text_hash", "line_no", "line", "n_words", "parity"]

    def cut(batches):
        import pyarrow as pa

        total = np.zeros(1 << _TABLE_BITS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part, met = batch.slice(at, 1000), []
                ids, hashes = part.column(0).to_numpy(), part.column(2).to_numpy()
                data, offsets = lower_bytes(part.column(1).to_pylist())
                for i, j in chunks(offsets):
                    words, first, lines, _ = line_words(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i])
                    owner = np.repeat(np.arange(i, j), np.diff(lines))
                    names, count = line_names(words, first), np.diff(first)
                    keep = count > 0
                    at = np.unique(names, return_index=True)[1]
                    at = at[count[at] >= least_words]
                    start = np.concatenate(([0], np.cumsum(count[at])))
                    _, gram = _grams(words[np.repeat(first[at] - start[:-1], count[at]) + np.arange(start[-1])], start, percent)
                    met.append((gram >> np.uint64(64 - _TABLE_BITS)).astype(np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x[keep]) for x in (ids[owner], hashes[owner], (np.arange(len(owner)) - lines[:-1][owner - i]).astype(np.int32),
                                                     names, count.astype(np.int32))] + [pa.nulls(int(keep.sum()), pa.binary())], names_out)
                total += np.bincount(np.concatenate(met), minlength=len(total))
        some = np.flatnonzero(total)
        none = pa.nulls(1, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none.cast(pa.int32()), none, pa.array([-1], pa.int32()), pa.array([np.stack((some, total[some])).tobytes()], pa.binary())], names_out)

    return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        cut, "doc_id long, text_hash long, line_no int, line long, n_words int, parity binary")


def _chunks_of_words(batch, least_words: int):
    """Words and first words of the distinct lines of least_words words or more in a batch of (text,), by chunk."""
    data, offsets = lower_bytes(batch.column(0).to_pylist())
    for i, j in chunks(offsets):
        words, first, _, _ = line_words(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i])
        count = np.diff(first)
        names, at = np.unique(line_names(words, first), return_index=True)
        keep = count[at] >= least_words
        names, at = names[keep], at[keep]
        count = count[at]
        start = np.concatenate(([0], np.cumsum(count)))
        yield names, words[np.repeat(first[at] - start[:-1], count) + np.arange(start[-1])], start


def _order(counts: DataFrame) -> np.ndarray:
    """Ranks below 64 by how often grams are in all documents, by the upper bits of their hashes; counts: the rows of n_words -1 of `_lines`."""
    each = 1 << max(0, _TABLE_BITS - 6)

    def unpack(batches):
        import pyarrow as pa

        total = np.zeros(1 << _TABLE_BITS, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                place, n = np.frombuffer(data, np.int64).reshape(2, -1)
                total[place] += n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total) // each, dtype=np.int32)), pa.array([x.tobytes() for x in total.reshape(-1, each)], pa.binary())], ["part", "data"])

    def add(key, table):
        import pyarrow as pa

        total = np.zeros(each, np.int64)
        for data in table.column("data").to_pylist():
            total += np.frombuffer(data, np.int64)
        some = np.flatnonzero(total > 1)
        return pa.table({"place": pa.array(some + key[0].as_py() * each), "n": pa.array(total[some])})

    rows = counts.select("parity").mapInArrow(unpack, "part int, data binary").groupBy("part").applyInArrow(add, "place long, n long").toArrow()
    order = np.zeros(1 << _TABLE_BITS, np.uint8)
    n = rows.column("n").to_numpy()
    if len(n):  # three ranks to a doubling, from what a common place has
        order[rows.column("place").to_numpy()] = np.clip(8 + 3 * np.log2(n / np.median(n)), 1, 63).astype(np.uint8)
    return order


def _near(docs: DataFrame, order: np.ndarray, percent: int, least_words: int) -> list[DataFrame]:
    """Tables (kind, a, b) of candidate pairs of lines, a < b.

    Large groups are covered by stars around their lines: kind 0 is a pair, 1 a pair that is part of a star around a, 2 a mere
    member b of the star around a. Members of a star stand for all pairs among them.
    """
    spark = docs.sparkSession
    parts = dealt_parts(docs, 2 << 20)
    docs = docs.where("doc_id IS NOT NULL")
    held = spark.sparkContext.broadcast(order)

    def deal(only):
        def run(batches):
            import pyarrow as pa

            for batch in slices(batches, 1000):
                part, blob, tos, rows, about, met = [], [], [], [], [], 0
                for names, words, first in _chunks_of_words(batch, least_words):
                    line, gram, place = leading_grams(words, first, percent, held.value)
                    some = (gram % np.uint64(ROUNDS)).astype(np.int64) == only
                    line, gram, place = line[some], gram[some] // np.uint64(ROUNDS), place[some]
                    size = np.minimum(np.diff(first), 0xFFFF)[line]
                    tos.append((gram % np.uint64(parts)).astype(np.int32))
                    rows.append((line + met, (gram // np.uint64(parts)).astype(np.uint32), (size << 16 | place).astype(np.uint32)))
                    about.append(np.column_stack((names, parities(words, first, _NARROW))))
                    met += len(names)
                if rows:
                    to, rows, about = np.concatenate(tos), [np.concatenate(c) for c in zip(*rows)], np.concatenate(about)
                    at = np.argsort(to.astype(np.uint16) if parts < 1 << 16 else to, kind="stable")
                    rows, cut = [about.take(rows[0][at], 0), *(c[at] for c in rows[1:])], np.searchsorted(to[at], np.arange(parts + 1))
                    for p in np.flatnonzero(np.diff(cut)):
                        part.append(int(p))
                        blob.append(b"".join(c[cut[p]: cut[p + 1]].tobytes() for c in rows))
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(blob, pa.binary())], ["part", "data"])

        return run

    def meet(table):
        import pyarrow as pa

        columns = [], [], []
        for data in (x.as_buffer() for batch in table.to_batches() for x in batch.column("data")):
            n = data.size // (16 + 8 * _NARROW)
            columns[0].append(np.frombuffer(data, np.int64, n * (1 + _NARROW)).reshape(n, -1))
            for k in (1, 2):
                columns[k].append(np.frombuffer(data, np.uint32, n, data.size - 4 * n * (3 - k)))
        about, key, size = (np.concatenate(c) for c in columns)
        del columns
        # Most grams are in one line only; these go by one sort of 64-bit words: gram, place.
        both = np.sort(key.astype(np.uint64) << np.uint64(32) | np.arange(len(key), dtype=np.uint64))
        same = np.zeros(len(both) + 1, bool)
        same[1:-1] = both[1:] >> np.uint64(32) == both[:-1] >> np.uint64(32)
        some = same[1:] | same[:-1]
        at, group = (both[some] & np.uint64(2**32 - 1)).astype(np.int64), np.cumsum(~same[:-1][some]).astype(np.uint64)
        # Within a gram by name, which is a hash: by its upper bits.
        bits = np.uint64(len(group).bit_length())
        at = at[np.argsort(group << np.uint64(64) - bits | (about[at, 0].view(np.uint64) ^ np.uint64(1 << 63)) >> bits)]
        key, about, size = key[at], about.take(at, 0), size[at].astype(np.int64)
        name, parity = about[:, 0].copy(), about[:, 1:]
        del both, same, some, group, at
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
        key, name, parity, place, size = key[fresh], name[fresh], parity[fresh], size[fresh] & 0xFFFF, size[fresh] >> 16
        place = np.where(size == 0xFFFF, _ANYWHERE, place)

        def aligned(i, j):
            return may_align(size[i], place[i], size[j], place[j], percent)

        def alike(i, j):
            return may_link(size[i], parity[i], size[j], parity[j], percent) | (size[i] == 0xFFFF) & (size[j] == 0xFFFF)

        start = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        length = np.diff(np.append(start, len(key)))
        within = np.repeat(length, length)
        none = np.zeros((0, 2), np.int64)
        pairs, stars, only, seen = [none], [none], [none], set()
        near, behind = [none], np.repeat(start + length, length)
        left = np.flatnonzero(within <= _FEW)
        for d in range(1, _FEW):
            left = left[left + d < behind[left]]
            if not len(left):
                break
            same = left[aligned(left, left + d)]
            same = same[alike(same, same + d)]
            near.append(np.stack((same, same + d), 1))
        chosen, (lead, member) = forest(np.concatenate(near), np.repeat(np.arange(len(start)), length), _EACH)
        pairs.append(name[chosen])
        only.append(np.stack((name[lead], name[member]), 1))
        for g in np.flatnonzero(length > _FEW):
            some = slice(start[g], start[g] + length[g])
            names, here = name[some], np.arange(some.start, some.stop)
            if (what := names.tobytes()) in seen:  # the same lines under another gram
                continue
            seen.add(what)
            if len(names) <= _SQUARE:
                i, j = np.nonzero(np.triu(aligned(here[:, None], here), 1))
                met = alike(here[i], here[j])
                i, j = i[met], j[met]
                if len(i) <= _EACH * len(np.unique(np.concatenate((i, j)))):
                    pairs.append(np.stack((names[i], names[j]), 1))
                    continue
            tree, members = covered(len(names), lambda i, j: aligned(here[i], here[j]) & alike(here[i], here[j]))
            if len(members):
                lead = members[0]
                direct = tree[tree[:, 0] == lead]
                stars.append(names[direct])
                pairs.append(names[tree[tree[:, 0] != lead]])
                rest = np.setdiff1d(members[1:], direct[:, 1])
                only.append(np.stack((np.full(len(rest), names[lead]), names[rest]), 1))
        found = [_pairs(x) for x in (pairs, stars, only)]
        both = np.concatenate(found)
        kind = np.repeat(np.arange(3, dtype=np.int32), [len(x) for x in found])
        return pa.table({"kind": pa.array(kind), "a": pa.array(both[:, 0]), "b": pa.array(both[:, 1])})

    return [stage(docs.select("text").mapInArrow(deal(k), "part int, data binary").groupBy("part").applyInArrow(meet, "kind int, a long, b long"), "near")
            for k in range(ROUNDS)]


def _verifier(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, percent: int):
    """verified(pairs) over the word sequences of the wanted lines, read again from their first occurrences, and these: line, words, p0 ... (wide parities)."""
    places = nodes.join(wanted, "line", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "line")).alias("at"))

    def fetch(batches):
        import pyarrow as pa

        for batch in slices(batches, 500):
            wanted, text = [], []
            for whole, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines = (whole or "").split("\n")
                at = [a for a in at if a["line_no"] < len(lines)]
                wanted += [a["line"] for a in at]
                text += [lines[a["line_no"]] for a in at]
            wanted = np.array(wanted, np.int64)
            data, offsets = lower_bytes(text)
            for i, j in chunks(offsets):
                words, first, _, _ = line_words(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i])
                same = np.flatnonzero(line_names(words, first) == wanted[i:j])  # doc_id may repeat with other texts
                codes = (words >> np.uint64(32)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array(wanted[i:j][same]), pa.array([codes[first[k]: first[k + 1]].tobytes() for k in same], pa.binary()),
                                                  *[pa.array(p) for p in parities(words, first, _WIDE)[same].T]], ["line", "words", *_WIDE_NAMES])

    texts = stage(docs.select("doc_id", "text").join(places, "doc_id").select("text", "at").mapInArrow(fetch, f"line long, words binary, {', '.join(f'{p} long' for p in _WIDE_NAMES)}")
                  .dropDuplicates(["line"]), "words")

    def verify(batches):
        import pyarrow as pa

        for batch in slices(batches, 2000):
            mask = pa.array(similar(batch.column(2).to_pylist(), batch.column(3).to_pylist(), percent), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    def verified(pairs):
        return (pairs.join(texts.select(F.col("line").alias("a"), F.col("words").alias("wa")), "a")
                .join(texts.select(F.col("line").alias("b"), F.col("words").alias("wb")), "b")
                .select("a", "b", "wa", "wb").mapInArrow(verify, "a long, b long"))

    return verified, texts


def _may_cross(percent: int):
    """For `connect`: which lines may link with one of another component, by their wide parities."""
    def may(about, component):
        n = np.array([x["n_words"] for x in about], np.int64)
        parity = np.array([[x[p] for p in _WIDE_NAMES] for x in about], np.int64).reshape(-1, _WIDE)
        _, own, count = np.unique(component, return_inverse=True, return_counts=True)
        keep, step = np.zeros(len(n), bool), max(1, (1 << 16) // max(1, len(n)))
        asked = np.flatnonzero(own != count.argmax()) if len(count) > 1 else own[:0]
        for at in range(0, len(asked), step):
            i = asked[at: at + step, None]
            hit = may_link(n[i], parity[i], n, parity, percent) & (own[i] != own)
            keep |= hit.any(0)
            keep[i[:, 0]] |= hit.any(1)
        return keep

    return may


def _find(percent: int):
    """For `connect`: linked lines of different components, of the word sequences of lines that met."""
    def find(data, component):
        sequences = [np.frombuffer(x, np.uint32).astype(np.uint64) for x in data]
        bags = []  # the k-th occurrence of a word is an element of its own
        for s in sequences:
            x = np.sort(s)
            begin = np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)])
            bags.append(mix64(x + (np.arange(len(x)) - np.repeat(begin, np.diff(np.append(begin, len(x))))).astype(np.uint64) * np.uint64(_BASE)))
        overlaps = Overlaps(bags)
        some = np.flatnonzero(100 * overlaps.shared >= percent * overlaps.size)
        overlaps, held = overlaps.only(some), {}

        def words(k):
            if k not in held:
                held[k] = sequences[some[k]].tolist()
            return held[k]

        def near(i, others):
            long = np.maximum(overlaps.size[others], overlaps.size[i])
            others = others[100 * overlaps.of(i)[others] >= percent * long]
            return np.array([j for j in others if 100 * (max(len(words(i)), len(words(j))) - word_edit_distance(words(i), words(j))) >= percent * max(len(words(i)), len(words(j)))], np.int64)

        return some[joining(component[some], near)]

    return find


def dropped_lines(docs: DataFrame, percent: int = 75, least_words: int = 3, least_exact: int | None = None) -> DataFrame:
    """doc_id, text_hash, dropped (array of line numbers): occurrences that are not the first of their group.

    Lines of fewer than least_words words are no candidates for near copies; at 75 percent and 3 words that leaves no link
    out, as lines of one or two words are that like to equal ones only. Those of least_exact words (by default least_words)
    or more are compared for equality.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = stage(_lines(docs, percent, least_words).where((F.col("n_words") >= (least_words if least_exact is None else least_exact)) | (F.col("n_words") < 0)), "lines")
    lines, order = cut.where("n_words >= 0"), _order(cut.where("n_words < 0"))
    nodes = stage(lines.groupBy("line").agg(F.min(F.struct("doc_id", "line_no")).alias("at"), F.count("*").alias("n"))
                  .select("line", "at.doc_id", "at.line_no", "n"), "nodes")
    near = functools.reduce(DataFrame.unionByName, _near(docs, order, percent, least_words))
    pairs = stage(near.select("kind", F.col("a").alias("x"), F.col("b").alias("y")).distinct(), "pairs")
    held = None

    def verifier():
        nonlocal held
        if held is None:
            held = _verifier(docs, nodes, pairs.select(F.explode(F.array("x", "y")).alias("line")).distinct(), percent)
        return held

    n_words = (F.length("words") / 4).cast("long")
    candidates = pairs.where("kind < 2").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    found = connect(candidates, pairs.where("kind > 0").select(F.col("x").alias("a"), F.col("y").alias("b")), lambda some: verifier()[0](some),
                    lambda: verifier()[1].select(F.col("line").alias("node"), n_words.alias("weight"), F.col("words").alias("data")), _find(percent),
                    lambda: verifier()[1].select(F.col("line").alias("node"), F.struct(n_words.alias("n_words"), *_WIDE_NAMES).alias("about")), _may_cross(percent))
    if found is None:
        group = nodes.where("n > 1").withColumn("component", F.col("line"))
    else:
        group = nodes.join(found.select(F.col("node").alias("line"), "component"), "line", "left").where("n > 1 OR component IS NOT NULL").withColumn("component", F.coalesce("component", "line"))
    group = group.select("line", "doc_id", "line_no", "n", "component")
    first = group.groupBy("component").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.sum("n").alias("copies")).where("copies > 1")
    affected = group.join(first, "component").select("line", "first")
    return (lines.select("line", "doc_id", "text_hash", "line_no").join(affected, "line").where(F.struct("doc_id", "line_no") != F.col("first"))
            .groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias("dropped")))


def dedup_lines(docs: DataFrame, percent: int = 75, least_words: int = 3, least_exact: int | None = None) -> DataFrame:
    """docs with n_lines, n_dropped and text without the lines that are near copies of an earlier one.

    Order is that of (doc_id, line number); lines are parted by \\n, and null text has none. Rows with null doc_id stay as they
    are and do not count as occurrences; rows of equal doc_id count as one document. Other columns stay, clashing ones
    (n_lines, n_dropped) are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped")
    names = docs.columns
    own, hashed, gone = free_names(names, "line_doc", "line_hash", "line_gone")
    dropped = stage(dropped_lines(docs, percent, least_words, least_exact), "dropped").toDF(own, hashed, gone)
    joined = docs.join(dropped, (F.col("doc_id") == F.col(own)) & (F.xxhash64("text") == F.col(hashed)), "left")
    lines = F.split("text", "\n")
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col(gone), i)), "\n")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(left).alias("text")
    return joined.select(*[text if c == "text" else F.col(quoted(c)) for c in names], F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).alias("n_lines"),
                         F.coalesce(F.size(gone), F.lit(0)).alias("n_dropped"))
