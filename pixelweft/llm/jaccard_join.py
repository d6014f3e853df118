"""N-gram Jaccard join by partitioning the universe of shingles.

Two sets of sizes a <= b with Jaccard similarity p % or more differ in at most H = (100-p)(a+b) / (100+p) elements. The
hashed universe is cut in m segments; a set's part of segment i may be asked to match exactly (worth 1) or up to one
deletion (worth 2), and if the worths of the chosen segments sum to H + 1, the pigeonhole principle has two such sets
agree on one of them. Sets are dealt to size bands so narrow that a partner is at most one band lower:

- in its own band a set indexes every non-empty segment and, for a few segments, all one-deletion neighbours;
- in the band below it only probes, with the cheapest segments that are enough: full segments are rarer and hence
  cheaper than those of one element, a deletion neighbourhood costs a signature per element, and empty segments,
  which far too many sets share, are left out;
- a set with too few non-empty segments for that gives all it has, empty segments included, which completes it against
  partners in the same position; every other partner's own choice suffices.

Sets that share a signature are candidates. Every shuffled set carries a small sketch, the number of its elements in each
of 64 ranges of the hash (a finer one for large sets); the sum of the smaller counts bounds the intersection from above, so
unrelated sets that only share a passage are ruled out where they meet. What remains is verified exactly on the sets, one
pair per set first and the rest only between sets that are not connected yet. Under a signature with many sets, a star
around the first stands for all pairs; where it turns out not to hold together, all its members are compared exactly in
one task (or block by block, see `common.connect`), from which at most one link a member comes out. No link is lost.

Nodes are sets, named by a 64-bit hash: documents with equal sets are one node.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Overlaps, chunks, connect, covered, dealt_parts, free_names, joining, mix64, quoted, shingle_sets, slices, stage, text_bytes

_U = np.uint64
#: Kinds of rows: part of a star, other candidate pair, document, mere member of a star (0: signatures).
_STAR, _OPEN, _DOC, _MEMBER = 1, 2, 3, 4
#: Sets under one signature of which all pairs are candidates; with more, stars.
_FEW = 12
#: Sets of more elements carry a finer sketch as well.
LARGE = 512


def set_name(s: np.ndarray) -> int:
    return int(mix64(mix64(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64, keepdims=True) + _U(len(s))).view(np.int64)[0])


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have Jaccard similarity of percent % or more."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum()) if len(b) else 0
    return 100 * both >= percent * (len(a) + len(b) - both)


class Bands:
    """Size bands and, per band, the segments m, the most differing elements and how many segments have deletions."""

    def __init__(self, percent: int, longest: int = 1 << 40):
        self.percent = percent
        low, lows = 1, []
        while low <= longest:
            lows.append(low)
            low = max(low + 1, -(-100 * low // percent))
        self.low = np.array(lows, np.int64)
        self.cache: dict[int, tuple[int, int, np.ndarray]] = {}

    def differ(self, a: int, b: int) -> int:
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def largest_partner(self, a: int) -> int:
        return 100 * a // self.percent

    def high(self, k: int) -> int:
        return int(self.low[k + 1]) - 1

    def scheme(self, k: int) -> tuple[int, int, np.ndarray]:
        """m, the number of segments with deletions (the last ones), and a tag per segment."""
        if k not in self.cache:
            need = self.differ(self.high(k), self.largest_partner(self.high(k))) + 1
            if need <= 6:  # short sets: few large segments, all with deletions
                m = enabled = -(-need // 2)
            else:
                m = int(need * 1.12) + 3
                enabled = m // 16 + 2
            self.cache[k] = m, enabled, mix64((np.arange(m).astype(np.uint64) << _U(20)) + _U(k + 1))
        return self.cache[k]

    def signatures(self, s: np.ndarray) -> np.ndarray:
        """All signatures of a sorted set of hashes."""
        n = len(s)
        if not n or not self.differ(n, self.largest_partner(n)):
            lone = True  # a set this short has no larger partner but itself
        else:
            lone = False
        own = int(np.searchsorted(self.low, n, "right")) - 1
        g = mix64(s + _U(0x2545F4914F6CDD1D))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(g)))
        found = []
        for k in (own, own - 1):
            if k < 0 or k == own and lone or k < own and -(-self.percent * n // 100) > self.high(k):
                continue
            need = (self.differ(n, self.largest_partner(n)) if k == own else self.differ(min(n, self.high(k)), n)) + 1
            if need == 1 and k < own:
                continue
            m, enabled, tag = self.scheme(k)
            segment = ((s >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)
            count = np.bincount(segment, minlength=m)
            end = np.cumsum(count)
            part = total[end] - total[end - count] + tag
            full = np.flatnonzero(count)
            deletable = int((count[m - enabled:] > 1).sum())
            if k < own and len(full) >= need:
                found.append(part[full[np.argpartition(-count[full], need - 1)[:need]]])
                continue
            tail = slice(int(end[m - enabled - 1]) if m > enabled else 0, n)
            if len(full) + deletable < need:
                found.append(part)  # with the empty segments, and the deletions that leave one empty
            else:
                found.append(part[full])
                keep = count[segment[tail]] > 1
                found.append(part[segment[tail]][keep] - g[tail][keep])
                continue
            found.append(part[segment[tail]] - g[tail])
        return mix64(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def sketch(s: np.ndarray) -> np.ndarray:
    """Five words: size and unit, and the counts by range of hash in these units, rounded up, four bits each."""
    count = np.bincount((s >> _U(58)).astype(np.int64), minlength=64)
    unit = max(1, -(-int(count.max(initial=0)) // 15))
    nibble = (-(-count // unit)).astype(np.uint8)
    return np.concatenate((np.array([len(s) | unit << 40], np.int64), (nibble[::2] | nibble[1::2] << 4).view(np.int64)))


def fine_sketch(s: np.ndarray) -> bytes:
    """Counts in a power of two of hash ranges, four to eight elements to each: the same bound for large sets."""
    k = min(20, max(6, (len(s) // 8).bit_length()))
    count = np.bincount((s >> _U(64 - k)).astype(np.int64), minlength=1 << k)
    unit = max(1, -(-int(count.max(initial=0)) // 15))
    nibble = (-(-count // unit)).astype(np.uint8)
    return np.array([k, unit], "<u4").tobytes() + (nibble[::2] | nibble[1::2] << 4).tobytes()


def _fine_counts(data: bytes) -> tuple[int, np.ndarray]:
    k, unit = np.frombuffer(data, "<u4", 2).tolist()
    packed = np.frombuffer(data, np.uint8, offset=8)
    count = np.empty(1 << k, np.int32)
    count[::2], count[1::2] = packed & 15, packed >> 4
    return k, count * unit


class FineSketches:
    """Fine sketches of the large ones among sets, compared many pairs at a time."""

    def __init__(self, size: np.ndarray, sketches: list[bytes], percent: int):
        self.size, self.percent = size, percent
        self.count = {i: _fine_counts(x) for i, x in enumerate(sketches) if x}
        self.k = np.array([self.count[i][0] if x else 0 for i, x in enumerate(sketches)], np.int64)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def table(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Row of each set, and counts in 2^k ranges; partners are so alike in size that their own k is that or one more."""
        if k not in self.tables:
            some = np.flatnonzero((self.k == k) | (self.k == k + 1))
            row = np.zeros(len(self.k), np.int64)
            row[some] = np.arange(len(some))
            self.tables[k] = row, np.stack([self.count[i][1].reshape(1 << k, -1).sum(1, dtype=np.int32) for i in some])
        return self.tables[k]

    def may_link(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        keep = np.ones(len(j), bool)
        least, apart = np.minimum(self.k[i], self.k[j]), np.abs(self.k[i] - self.k[j])
        for k in np.unique(least[(least > 0) & (apart < 2)]).tolist():
            row, count = self.table(k)
            some = np.flatnonzero((least == k) & (apart < 2))
            step = max(1, (1 << 21) >> k)
            for at in range(0, len(some), step):
                p = some[at: at + step]
                a, b = self.size[i[p]], self.size[j[p]]
                both = np.minimum(np.minimum(count[row[i[p]]], count[row[j[p]]]).sum(1), np.minimum(a, b))
                keep[p] = 100 * both >= self.percent * (a + b - both)
        return keep


def _unpacked(sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and upper bounds of the counts, of rows of sketches."""
    packed, unit = np.ascontiguousarray(sketches[:, 1:]).view(np.uint8), sketches[:, :1] >> 40
    count = np.empty((len(sketches), 64), np.uint16 if unit.max(initial=0) < 4096 else np.int32)
    count[:, ::2], count[:, 1::2] = packed & 15, packed >> 4
    return sketches[:, 0] & (1 << 40) - 1, count * unit.astype(count.dtype)


def _may_link(size, count, i, j, percent: int) -> np.ndarray:
    """Whether sets i and j can be similar as far as their sizes and sketches tell."""
    i = np.broadcast_to(i, j.shape)
    low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
    keep = 100 * low >= percent * high
    alike = np.flatnonzero(keep)
    for at in range(0, len(alike), 1 << 13):
        some = alike[at: at + (1 << 13)]
        both = np.minimum(np.minimum(count[i[some]], count[j[some]]).sum(1, dtype=np.int64), low[some])
        keep[some] = 100 * both >= percent * (low[some] + high[some] - both)
    return keep


def _first_of_runs(x: np.ndarray) -> np.ndarray:
    return np.concatenate(([True], x[1:] != x[:-1])) if len(x) else np.zeros(0, bool)


def _deal(percent: int, width: int, parts: int):
    """Batches of (doc_id, text) -> blobs by part: documents, and signatures with the names and sketches of their sets."""
    def deal(batches):
        import pyarrow as pa

        bands = Bands(percent)
        for batch in slices(batches, 1500):
            ids = batch.column(0)
            data, offsets = text_bytes(batch.column(1))
            sets: list[np.ndarray] = []
            for i, j in chunks(offsets):
                sets += shingle_sets(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i], width)
            names = np.array([set_name(s) for s in sets], np.int64)
            size = np.array([len(s) for s in sets], np.int64)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            part, kind, blob = [], [], []
            rows = np.stack([ids.fill_null(0).to_numpy().astype(np.int64), known.astype(np.int64), size, names], 1)
            for some in np.array_split(np.arange(len(rows)), max(1, len(rows) // 1024)):
                if len(some):
                    part.append(int(mix64(rows[some[:1], 3].astype(np.uint64))[0] % _U(parts)))
                    kind.append(_DOC)
                    blob.append(rows[some].tobytes())

            name, at = np.unique(names[known & (size > 0)], return_index=True)  # equal sets go once
            at = np.flatnonzero(known & (size > 0))[at]
            keys = [bands.signatures(sets[i]) for i in at]
            about = np.array([sketch(sets[i]) for i in at], np.int64).reshape(-1, 5)
            more = [fine_sketch(sets[i]) if size[i] > LARGE else b"" for i in at]
            owner = np.repeat(np.arange(len(at), dtype=np.int32), [len(k) for k in keys])
            key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            to = ((key >> _U(20)) % _U(parts)).astype(np.int32)
            order = np.argsort(to, kind="stable")  # within a part by owner
            key, owner, to = key[order], owner[order], to[order]
            cut = np.flatnonzero(_first_of_runs(to))
            for lo, hi in zip(cut, np.append(cut[1:], len(to))):
                first = np.flatnonzero(_first_of_runs(owner[lo:hi]))
                who = owner[lo:hi][first]
                part.append(int(to[lo]))
                kind.append(0)
                # 40 bits of a signature are enough among those of a part: a chance agreement is only one candidate more.
                extra = [more[i] for i in who]
                blob.append(np.concatenate(([len(who)], name[who], about[who].reshape(-1))).astype(np.int64).tobytes()
                            + np.concatenate((np.diff(np.append(first, hi - lo)), [len(e) for e in extra])).astype(np.uint32).tobytes()
                            + b"".join(extra) + (key[lo:hi] >> _U(32)).astype(np.uint32).tobytes() + (key[lo:hi] >> _U(24)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], ["part", "kind", "data"])

    return deal


def _shared(keys, inverse: np.ndarray, counts, nodes: int, bits: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of more than one of `nodes` sets with these sets, in order and each once; keys: upper 32 and lower 8 bits by blob.

    Signatures and sets of a part are sorted as one word of 64 bits, in place; sets too many for that in some ranges of the signatures.
    """
    total = sum(len(high) for high, _ in keys)
    ranges = 1 << max(0, (nodes - 1).bit_length() - bits)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for k in range(ranges):
        both, at, owner = np.empty(total, np.uint64), 0, 0
        for (high, low), count in zip(keys, counts):
            node = np.repeat(inverse[owner: owner + len(count)], count)
            owner += len(count)
            some = slice(None) if ranges == 1 else np.flatnonzero(high % np.uint32(ranges) == k)
            key = (high[some] // np.uint32(ranges)).astype(_U) << _U(8) | low[some]
            both[at: at + len(key)] = key << _U(64 - (40 - ranges.bit_length() + 1)) | node[some].astype(_U)
            at += len(key)
        both = both[:at]
        both.sort()
        shift = _U(64 - (40 - ranges.bit_length() + 1))
        # Most signatures are of one set only.
        same = np.flatnonzero((both[1:] ^ both[:-1]) >> shift == 0)
        both = both[np.union1d(same, same + 1)]
        both = both[_first_of_runs(both)]
        key = ((both >> shift).astype(np.int64) >> 8) * ranges + k
        found.append((key << 8 | (both >> shift).astype(np.int64) & 255, (both & (_U(1) << shift) - _U(1)).astype(np.int64)))
    return tuple(np.concatenate(c) for c in zip(*found))


def _meet(percent: int):
    """All blobs of a part -> rows (kind, a, b, c, d): documents as they came, and candidate pairs a < b of sets."""
    def meet(table):
        import pyarrow as pa

        out, keys, nodes, abouts, extras, counts = [], [], [], [], [], []
        for kind, data in ((k, x.as_buffer()) for batch in table.to_batches() for k, x in zip(batch.column("kind").to_pylist(), batch.column("data"))):
            x = np.frombuffer(data, np.int64, len(data) // 8)
            if kind == _DOC:
                out.append((np.full(len(x) // 4, _DOC), *x.reshape(-1, 4).T))
            else:
                n = int(x[0])
                nodes.append(x[1: n + 1])
                abouts.append(x[n + 1: 6 * n + 1].reshape(n, 5))
                short = np.frombuffer(data, np.uint32, 2 * n, 8 * (6 * n + 1)).astype(np.int64)
                counts.append(short[:n])
                end = 8 * (7 * n + 1) + np.cumsum(short[n:])
                begin = end - short[n:]
                large = np.flatnonzero(short[n:])
                extras.append(({k: data.slice(a, b - a) for k, a, b in zip(large.tolist(), begin[large].tolist(), end[large].tolist())}, n))
                total, at = int(counts[-1].sum()), int(end[-1])
                keys.append((np.frombuffer(data, np.uint32, total, at), np.frombuffer(data, np.uint8, total, at + 4 * total)))
        if keys:
            name, first, inverse = np.unique(np.concatenate(nodes), return_index=True, return_inverse=True)
            key, node = _shared(keys, inverse, counts, len(name))
            del keys, nodes, counts, inverse
            used, node = np.unique(node, return_inverse=True)
            name, first = name[used], first[used]
            size, count = _unpacked(np.concatenate(abouts)[first] if len(first) else abouts[0][:0])
            begin = np.cumsum([0] + [n for _, n in extras])
            of = np.searchsorted(begin, first, "right") - 1
            fine = FineSketches(size, [extras[b][0].get(k, b"") for b, k in zip(of.tolist(), (first - begin[of]).tolist())], percent)

            def may_link(i, j):
                keep = _may_link(size, count, i, j, percent)
                some = np.flatnonzero(keep)
                keep[some] = fine.may_link(np.broadcast_to(i, j.shape)[some], j[some])
                return keep

            start = np.flatnonzero(_first_of_runs(key))
            length = np.diff(np.append(start, len(key)))
            group = np.repeat(np.arange(len(start)), length)
            few = length[group] <= _FEW
            met = [np.zeros(0, np.int64)]
            for d in range(1, _FEW):  # all pairs of small groups, d places apart
                same = np.flatnonzero((group[:-d] == group[d:]) & few[:-d]) if d < len(group) else group[:0]
                if not len(same):
                    break
                pair = np.unique(node[same] * len(name) + node[same + d])
                for at in range(0, len(pair), 1 << 18):
                    some = pair[at: at + (1 << 18)]
                    met.append(some[may_link(some // len(name), some % len(name))])
            pair = np.unique(np.concatenate(met))
            stars, only, others = [], [], [np.stack((pair // len(name), pair % len(name)), 1)]
            seen = set()
            for g in np.flatnonzero(length > _FEW):
                some = node[start[g]: start[g] + length[g]]
                if (what := some.tobytes()) in seen:  # the same sets under another signature
                    continue
                seen.add(what)
                forest, members = covered(len(some), lambda i, j: may_link(np.repeat(some[i[:, 0]], len(j)), np.tile(some[j], len(i))).reshape(len(i), len(j)))
                if len(members):
                    direct = forest[forest[:, 0] == members[0]]
                    stars.append(some[direct])
                    others.append(some[forest[forest[:, 0] != members[0]]])
                    rest = np.setdiff1d(members[1:], direct[:, 1])
                    only.append(np.stack((np.full(len(rest), some[members[0]]), some[rest]), 1))
            for kind, found in ((_STAR, stars), (_OPEN, others), (_MEMBER, only)):
                found = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
                zero = np.zeros(len(found), np.int64)
                out.append((np.full(len(found), kind), name[found[:, 0]], name[found[:, 1]], zero, zero))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 5
        return pa.table({n: pa.array(c.astype(np.int64)) for n, c in zip(("kind", "a", "b", "c", "d"), columns)})

    return meet


def packed(s: np.ndarray) -> bytes:
    """The upper 48 bits of sorted hashes."""
    return s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8")[:, 0]


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of sets that are similar; sets(node, weight, data)."""
    def verify(batches):
        import pyarrow as pa

        for batch in slices(batches, 256):
            keep = pa.array([similar(unpacked(x), unpacked(y), percent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return (pairs.select("a", "b")
            .join(sets.select(F.col("node").alias("b"), F.col("data").alias("db")), "b")
            .join(sets.select(F.col("node").alias("a"), F.col("data").alias("da")), "a")
            .select("a", "b", "da", "db").mapInArrow(verify, "a long, b long"))


def _find(percent: int):
    """For `connect`: similar sets of different components, of those that met."""
    def find(data, component):
        overlaps = Overlaps([unpacked(x) for x in data])
        some = np.flatnonzero(100 * overlaps.shared >= percent * overlaps.size)
        overlaps = overlaps.only(some)

        def near(i, others):
            both = overlaps.of(i)[others]
            return others[100 * both >= percent * (overlaps.size[i] + overlaps.size[others] - both)]

        return some[joining(component[some], near)]

    return find


def _sets(docs: DataFrame, named: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, weight, data): the wanted sets, made again from the text of the smallest document of each."""
    def make(batches):
        import pyarrow as pa

        for batch in slices(batches):
            data, offsets = text_bytes(batch.column(1))
            sets = []
            for i, j in chunks(offsets):
                sets += shingle_sets(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i], width)
            names = batch.column(0).to_pylist()
            keep = [i for i, (s, x) in enumerate(zip(sets, names)) if set_name(s) == x]  # doc_id may repeat with other texts
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in keep], pa.int64()), pa.array([len(sets[i]) for i in keep], pa.int64()),
                                              pa.array([packed(sets[i]) for i in keep], pa.binary())], ["node", "weight", "data"])

    chosen = named.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    made = docs.select("doc_id", "text").join(chosen, "doc_id").select("node", "text").mapInArrow(make, "node long, weight long, data binary")
    return made.dropDuplicates(["node"])


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = 5, part_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, n_shingles, component_id per row of docs(doc_id, text).

    part_bytes: bytes of input to a part of the search; smaller parts take less memory a task and more shuffle.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, shingles `width` words; fewer words are one shingle, none (null,
    empty or blank text) an empty set that links with nothing. component_id is the smallest doc_id reachable by links.
    A row with null doc_id links with nothing and has a null component_id. Repeated rows give repeated results.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = docs.mapInArrow(_deal(percent, width, dealt_parts(docs, part_bytes)), "part int, kind int, data binary")
    met = stage(dealt.groupBy("part").applyInArrow(_meet(percent), "kind long, a long, b long, c long, d long"), "jaccard")
    rows = met.where(F.col("kind") == _DOC).select(
        F.when(F.col("b") == 1, F.col("a")).alias("doc_id"), F.col("c").alias("n_shingles"), F.col("d").alias("node"))
    named = rows.where("doc_id IS NOT NULL AND n_shingles > 0").select("doc_id", "node")
    star = met.where(F.col("kind").isin(_STAR, _MEMBER)).select("a", "b").distinct()
    open_ = met.where(F.col("kind").isin(_STAR, _OPEN)).select("a", "b").distinct()
    held = None

    def sets():
        nonlocal held
        if held is None:
            nodes = met.where(F.col("kind") != _DOC).select(F.explode(F.array("a", "b")).alias("node")).distinct()
            held = stage(_sets(docs, named, nodes, width), "sets")
        return held

    found = connect(open_, star, lambda pairs: _verified(pairs, sets(), percent), sets, _find(percent))
    by_set = named.groupBy("node").agg(F.min("doc_id").alias("least"))
    if found is not None:
        by_set = by_set.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = by_set.groupBy("component").agg(F.min("least").alias("component_id"))
        by_set = by_set.join(least, "component")
    else:
        by_set = by_set.withColumn("component_id", F.col("least"))
    joined = rows.join(by_set.select("node", "component_id"), "node", "left")
    lone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    return joined.select("doc_id", "n_shingles", F.when(lone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, percent: int = 75, width: int = 5, part_bytes: int = 16 << 20) -> DataFrame:
    """The rows of docs without near duplicates: of each component the document with the smallest doc_id stays.

    Columns are kept, whatever their names. Rows with null doc_id stay; of rows that share the doc_id that stays, one stays.
    """
    own, n = free_names(docs.columns, "kept_id", "kept_rows")
    result = near_duplicates(docs, percent, width, part_bytes)
    kept = stage(result.where("doc_id = component_id").groupBy(F.col("doc_id").alias(own)).agg(F.count("*").alias(n)), "kept")
    joined = docs.join(kept, docs["doc_id"] == kept[own], "left")
    once = joined.where(docs["doc_id"].isNull() | (kept[n] == 1)).select(*[docs[quoted(c)] for c in docs.columns])
    if kept.where(kept[n] > 1).isEmpty():
        return once
    return once.unionByName(joined.where(kept[n] > 1).select(*[docs[quoted(c)] for c in docs.columns]).dropDuplicates(["doc_id"]))
