"""A hashed maximum-entropy language model: n-gram and skip features with a class-factored softmax.

P(word | context) = P(class | context) P(place | class, context) P(word | place). Every word has one of classes x places: the
commonest words a place each, in the first half of the classes, all others the one that their last three bytes hash to. The
first two factors are softmaxes over the unigram shares times the exponential of weights of the features active: the word
before, the two words before, and the word two before (a skip); in these contexts a word that is not among the common ones
stands by its ending. A feature (for the second factor a feature with the class) hashes to a row of the weights'
table. The last factor is the word's smoothed share of its place by counts over the whole corpus, with a share for a word not
seen, so that all sums to one. With no weights the model is the unigram base.

Counts are exact over all training documents, in a table that grows with the vocabulary and is only joined. The words that
have 2^-18 of all tokens or more, so at most 2^18, travel to the tasks; the others of a document meet their counts in the join.

Training: each of `rounds` folds of the documents is read by tasks that make gradient steps on a copy of the weights, and give
one row of sums for each row of weights that they touched; these are averaged by how often each task touched the row. The
sums are whole numbers, so their order does not show. The table has 2^bits rows, bits following the root of the number of
training tokens up to `most_bits` (128 MB), which is what bounds memory; a larger corpus shares rows, and drops nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, dealt_parts, mix64, slices, stage, text_bytes, unstage, word_hashes
from .language_id import held_out

#: Classes, and places in each of them.
WIDTH = 32
#: Words of their own place, in half of the classes.
OWN = WIDTH * WIDTH // 2
#: Words of at least one in so many tokens are sent to every task; of those, contexts are told apart at one in CONTEXT.
LISTED, CONTEXT = 1 << 18, 1 << 14
#: Tokens whose gradients make one step, at most.
STEP = 16384
#: The hashes of the end of a text and of what is before its beginning.
END, BEFORE = np.uint64(0xE7D0F1A5C3B29687), np.uint64(0x5B1C9D3E7F8A6042)
_MUL = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
#: Units of the weights' sums.
UNIT = float(1 << 16)
FEATURES = 3
#: Weights stay within this, so that exponentials of a sum of FEATURES of them and a share's logarithm are single-precision numbers.
LIMIT = np.float32(15)


class Lookup:
    """Values of 64-bit keys, -1 for all others: tables by some bits of the key, each holding what found no room before."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.tables, shift = [], 0
        while len(keys):
            bits = max(4, int(len(keys)).bit_length() + 2)
            place = (keys >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
            _, first = np.unique(place, return_index=True)
            own, value = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int64)
            own[place[first]], value[place[first]] = keys[first], values[first]
            self.tables.append((np.uint64(shift), np.uint64((1 << bits) - 1), own, value))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values, shift = keys[rest], values[rest], (shift + 17) % 44

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        for shift, mask, own, value in self.tables:
            place = (keys >> shift) & mask
            hit = own[place] == keys
            out[hit] = value[place[hit]]
        return out


def place_of(tails: np.ndarray) -> np.ndarray:
    """The place of a word that has none of its own, by its last three bytes."""
    m = mix64((tails.astype(np.uint64) + np.uint64(1)) * _MUL[0])
    return OWN + (m >> np.uint64(32)).astype(np.int64) % OWN


def tokens(column):
    """Of an Arrow column of texts, some texts at a time: the first text's number, the tokens' hashes, tails and places in their texts' count.

    Yields (at, hashes, tails, start): text at + k has the tokens start[k] to start[k + 1], the last one being END.
    """
    data, offsets = text_bytes(column)
    for i, j in chunks(offsets):
        words, first, tails = word_hashes(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i], tails=True)
        many = np.diff(first)
        start = np.concatenate(([0], np.cumsum(many + 1)))
        of = np.arange(len(words)) + np.repeat(np.arange(j - i), many)
        h, t = np.full(start[-1], END), np.zeros(start[-1], np.int64)
        h[of], t[of] = words, tails
        yield i, h, t, start


@dataclass
class Vocabulary:
    """What tasks know of words: total, distinct (training tokens), the listed words' counts, and sums by place."""

    total: int
    distinct: int
    keys: np.ndarray  # listed words, commonest first
    counts: np.ndarray
    mass: np.ndarray  # (classes * places,): N + 0.1 (V + 1) of each place

    @property
    def base(self) -> np.ndarray:
        """Logarithms of the places' shares, (classes, places)."""
        return np.log(self.mass / self.mass.sum()).reshape(WIDTH, WIDTH)

    def lookup(self, all_listed: bool) -> Lookup:
        """Number in the list; without all_listed only of words that contexts tell apart or that have their own place."""
        n = len(self.keys) if all_listed else max(int((self.counts * CONTEXT >= self.total).sum()), min(OWN, len(self.keys)))
        return Lookup(self.keys[:n], np.arange(n))


def count_words(train: DataFrame) -> DataFrame:
    """(h, tail, n) of each distinct token of the texts, END among them; staged."""
    def count(batches):
        import pyarrow as pa

        def counted(parts):
            h, t = (np.concatenate(x) for x in zip(*parts))
            own, first, n = np.unique(h, return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(t[first].astype(np.int32)), pa.array(n)], names=["h", "tail", "n"])

        parts, many = [], 0
        for batch in slices(batches):
            for _, h, t, _ in tokens(batch.column(0)):
                parts.append((h, t))
                many += len(h)
                if many > 1 << 20:
                    yield counted(parts)
                    parts, many = [], 0
        if parts:
            yield counted(parts)

    found = train.select("text").mapInArrow(count, "h long, tail int, n long")
    return stage(found.groupBy("h").agg(F.min("tail").alias("tail"), F.sum("n").alias("n")), "words")


def vocabulary(words: DataFrame) -> Vocabulary:
    """The sums over words(h, tail, n), and the words that have at least one in LISTED tokens."""
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    listed = words.where(F.col("n") * LISTED >= total).select("h", "n").toArrow()
    keys, counts = listed.column(0).to_numpy().view(np.uint64), listed.column(1).to_numpy()
    order = np.lexsort((keys, -counts))
    keys, counts = keys[order], counts[order]
    own = Lookup(keys[:OWN], np.arange(len(keys[:OWN])))

    def masses(batches):
        import pyarrow as pa

        n, v = np.zeros(WIDTH * WIDTH, np.int64), np.zeros(WIDTH * WIDTH, np.int64)
        for batch in batches:
            at = own(batch.column(0).to_numpy().view(np.uint64))
            at = np.where(at >= 0, at, place_of(batch.column(1).to_numpy()))
            np.add.at(n, at, batch.column(2).to_numpy())
            v += np.bincount(at, minlength=len(v))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n), pa.array(v)], names=["place", "n", "v"])

    mass = np.full(WIDTH * WIDTH, 0.1)
    for r in words.mapInArrow(masses, "place int, n long, v long").groupBy("place").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        mass[r.place] = r.n + 0.1 * (r.v + 1)
    return Vocabulary(total, distinct, keys, counts, mass)


def _features(h: np.ndarray, tails: np.ndarray, listed: np.ndarray, start: np.ndarray, n_context: int) -> tuple[np.ndarray, np.ndarray]:
    """(FEATURES, tokens) hashes of the contexts, and each token's place."""
    place = np.where((listed >= 0) & (listed < OWN), listed, place_of(tails))
    ending = mix64(tails.astype(np.uint64) + _MUL[1])
    word = np.where((listed >= 0) & (listed < n_context), h, ending)
    before = []
    for k in (1, 2):
        b = np.full(len(word), BEFORE)
        b[k:] = word[:-k] if len(word) > k else word[:0]
        for d in range(k):
            at = start[:-1] + d
            b[at[at < start[1:]]] = BEFORE
        before.append(b)
    one, two = before
    keys = np.stack((one * _MUL[0], one * _MUL[1] + two * _MUL[2], two * _MUL[3] + np.uint64(2)))
    return mix64(keys), place


def _rows(keys: np.ndarray, cls: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of weights of the contexts, and of the contexts with the class."""
    drop = np.uint64(64 - bits)
    return (keys >> drop).astype(np.int32), (((keys ^ (cls.astype(np.uint64) + np.uint64(1)) * _MUL[3]) * _MUL[1]) >> drop).astype(np.int32)


def _scores(weights: np.ndarray, rows: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Logarithms of shares up to a summand; weights within LIMIT keep their exponentials within single precision."""
    z = weights.take(rows[0], axis=0)
    for r in rows[1:]:
        z += weights.take(r, axis=0)
    z += offset
    return z


_ONES = np.ones(WIDTH, np.float32)


def log_shares(weights: np.ndarray, base: tuple[np.ndarray, np.ndarray], keys: np.ndarray, place: np.ndarray, bits: int) -> np.ndarray:
    """The natural logarithm of P(place | context) of each token."""
    cls, own = place // WIDTH, place % WIDTH
    at, out = np.arange(len(place)), np.zeros(len(place))
    for rows, offset, target in zip(_rows(keys, cls, bits), (base[0], base[1][cls]), (cls, own)):
        z = _scores(weights, rows, offset)
        own_score = z[at, target].astype(np.float64)
        out += own_score - np.log((np.exp(z, out=z) @ _ONES).astype(np.float64))
    return out


def bases(vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of the classes' shares, and of the places' in their class."""
    whole = vocabulary.base
    of_class = np.log(np.exp(whole).sum(axis=1))
    return of_class.astype(np.float32), (whole - of_class[:, None]).astype(np.float32)


def sum_runs(grad: np.ndarray, source: np.ndarray, first: np.ndarray, short: int = 8) -> np.ndarray:
    """Sums of grad[source] over the runs that begin at `first`: short runs of one size together, each longer one by itself."""
    size = np.diff(np.concatenate((first, [len(source)])))
    out = np.empty((len(first), grad.shape[1]), grad.dtype)
    for k in range(1, short + 1):
        runs = np.flatnonzero(size == k)
        at = first[runs]
        total = grad.take(source[at], axis=0)
        for j in range(1, k):
            total += grad.take(source[at + j], axis=0)
        out[runs] = total
    long = np.flatnonzero(size > short)
    ones = np.ones(int(size.max(initial=0)), grad.dtype)
    for run, at, n in zip(long.tolist(), first[long].tolist(), size[long].tolist()):
        out[run] = ones[:n] @ grad.take(source[at: at + n], axis=0)
    return out


class Trainer:
    """Gradient steps on a copy of the weights; each row's step shrinks with the squares of its gradients so far."""

    def __init__(self, weights: np.ndarray, squares: np.ndarray, base, bits: int, rate: float):
        self.weights, self.squares, self.base, self.bits, self.rate = weights.copy(), squares.copy(), base, bits, rate
        self.hits = np.zeros(len(weights), np.int64)

    def step(self, keys: np.ndarray, place: np.ndarray) -> None:
        m = len(place)
        cls, own = place // WIDTH, place % WIDTH
        rows = _rows(keys, cls, self.bits)
        grad = np.empty((2 * m, WIDTH), np.float32)
        for k, (r, offset, target) in enumerate(zip(rows, (self.base[0], self.base[1][cls]), (cls, own))):
            g = grad[k * m: (k + 1) * m]
            np.exp(_scores(self.weights, r, offset), out=g)
            g *= (1 / (g @ _ONES))[:, None]
            g[np.arange(m), target] -= 1
        # All rows touched, in order, with the gradients' places.
        packed = np.concatenate([r.reshape(-1) for r in rows]).astype(np.int64) << 32
        packed |= np.concatenate([np.tile(np.arange(m), FEATURES), np.tile(np.arange(m, 2 * m), FEATURES)])
        packed.sort()
        row = packed >> 32
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        total = sum_runs(grad, packed & 0xFFFFFFFF, first)
        touched = row[first]
        squares = self.squares[touched] + np.einsum("ij,ij->i", total, total)
        self.squares[touched] = squares
        total *= (-self.rate / np.sqrt(squares + 1e-6)).astype(np.float32)[:, None]
        total += self.weights.take(touched, axis=0)
        self.weights[touched] = np.clip(total, -LIMIT, LIMIT, out=total)
        self.hits[touched] += np.diff(np.concatenate((first, [len(row)])))


def train(docs: DataFrame, words: Vocabulary, bits: int, rounds: int, rate: float) -> np.ndarray:
    """Weights (2^bits, WIDTH) after one pass over the texts of docs(text, fold), a round for each fold."""
    spark = docs.sparkSession
    weights, squares = np.zeros((1 << bits, WIDTH), np.float32), np.ones(1 << bits, np.float32)
    base, n_context = bases(words), int((words.counts * CONTEXT >= words.total).sum())
    shards = dealt_parts(docs, 256 << 20)
    for k in range(rounds):
        now = spark.sparkContext.broadcast((weights, squares, words.lookup(False), base))

        def learn(batches):
            import pyarrow as pa

            weights, squares, lookup, base = now.value
            model = Trainer(weights, squares, base, bits, rate)
            for batch in slices(batches):
                for _, h, tails, start in tokens(batch.column(0)):
                    keys, place = _features(h, tails, lookup(h), start, n_context)
                    for a in range(0, len(place), STEP):
                        model.step(keys[:, a: a + STEP], place[a: a + STEP])
            at = np.flatnonzero(model.hits)
            for a in range(0, len(at), 1 << 14):
                some = at[a: a + (1 << 14)]
                sums = np.rint((model.weights[some] - weights[some]).astype(np.float64) * (model.hits[some, None] * UNIT)).astype(np.int64)
                more = np.rint((model.squares[some] - squares[some]).astype(np.float64) * 16).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(model.hits[some]), pa.array(more), *(pa.array(sums[:, d]) for d in range(WIDTH))], names=names)

        names = ["row", "hits", "squares", *(f"w{d}" for d in range(WIDTH))]
        given = docs.where(F.col("fold") == k).select("text").coalesce(shards).mapInArrow(learn, ", ".join([f"row int, hits long, squares long, {', '.join(f'w{d} long' for d in range(WIDTH))}"]))
        merged = stage(given.groupBy("row").agg(*(F.sum(c).alias(c) for c in names[1:])), "weights")
        table = merged.toArrow()
        if table.num_rows:
            row, hits = table.column("row").to_numpy(), table.column("hits").to_numpy()
            weights = weights.copy()
            for d in range(WIDTH):
                weights[row, d] += (table.column(f"w{d}").to_numpy() / (hits * UNIT)).astype(np.float32)
            squares = squares.copy()
            squares[row] += (table.column("squares").to_numpy() / 16).astype(np.float32)
        unstage(merged)
        now.unpersist()
    return weights


def score(docs: DataFrame, rounds: int = 2, rate: float = 0.7, most_bits: int = 20, folds: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of each row of docs.

    Learned from are the texts of ids whose crc32 (as text) is not divisible by `folds`. Null text counts as empty: one token,
    the end. A row of null id is scored, is not held out and teaches nothing; repeated rows count as often as they are there.
    Nothing to learn from: every token has the share of one that is not seen. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", held_out(F.col("doc_id"), folds).alias("held_out"))
    learned = docs.where(~F.col("held_out") & F.col("doc_id").isNotNull()).select("text", F.pmod(F.xxhash64("doc_id"), F.lit(rounds)).alias("fold"))
    counted = count_words(learned)
    words = vocabulary(counted)
    bits = min(most_bits, 3 + int(np.ceil(np.log2(max(2, words.total)) / 2)))
    weights = train(learned, words, bits, rounds, rate)
    n_context = int((words.counts * CONTEXT >= words.total).sum())
    sent = spark.sparkContext.broadcast((weights, bases(words), words.lookup(True), np.log10(words.counts + 0.1), np.log10(words.mass)))

    def judge(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        weights, base, lookup, share, mass = sent.value
        key = TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            parts = []
            for i, h, tails, start in tokens(batch.column(1)):
                listed = lookup(h)
                keys, place = _features(h, tails, listed, start, n_context)
                known = listed >= 0
                model = np.concatenate([log_shares(weights, base, keys[:, a: a + STEP], place[a: a + STEP], bits) for a in range(0, len(h), STEP)]) / np.log(10)
                part = np.where(known, share[listed], 0.0) if len(share) else np.zeros(len(h))
                sums = [np.add.reduceat(x, start[:-1]) for x in (part, model - mass[place], known.astype(np.int64))]
                of, rare = np.repeat(np.arange(len(start) - 1), np.diff(start))[~known], h[~known]
                order = np.lexsort((rare, of))
                of, rare = of[order], rare[order]
                new = np.flatnonzero(np.concatenate(([True], (rare[1:] != rare[:-1]) | (of[1:] != of[:-1])))) if len(of) else of
                many = np.diff(np.concatenate((new, [len(of)])))
                ends = np.concatenate(([0], np.cumsum(np.bincount(of[new], minlength=len(start) - 1)))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (rare[new].view(np.int64), many.astype(np.int32))]
                at = np.arange(len(start) - 1)
                parts.append(pa.RecordBatch.from_arrays([
                    pa.array(key + at), batch.column(0).slice(i, len(at)), batch.column(2).slice(i, len(at)), pa.array(np.diff(start)), pa.array(sums[2]), pa.array(sums[0]), pa.array(sums[1]), *lists,
                ], names=["key", "doc_id", "held_out", "n_tokens", "n_listed", "listed", "model", "rare", "many"]))
                key += len(at)
            yield from parts

    kind = dict(docs.dtypes)["doc_id"]
    found = stage(docs.select("doc_id", "text", "held_out").mapInArrow(
        judge, f"key long, doc_id {kind}, held_out boolean, n_tokens long, n_listed long, listed double, model double, rare array<long>, many array<int>"), "scored")
    rest = found.select("key", F.explode(F.arrays_zip("rare", "many")).alias("w")).select("key", F.col("w.rare").alias("h"), F.col("w.many").alias("many"))
    rare = counted.where(F.col("n") * LISTED < words.total).select("h", "n")
    rest = rest.join(rare, "h", "left").groupBy("key").agg(
        F.sum(F.col("many") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1))).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("many")).otherwise(0)).alias("known"))
    whole = float(np.log10(words.total + 0.1 * (words.distinct + 1)))
    some = F.col("listed") + F.coalesce("more", F.lit(0.0))
    return found.drop("rare", "many").join(rest, "key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_listed") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"),
        (some - F.col("n_tokens") * F.lit(whole)).alias("base_score"), (some + F.col("model")).alias("score"))
