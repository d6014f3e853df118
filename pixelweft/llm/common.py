"""Helpers that the operators of this subpackage share: staged tables, connected components, words and shingles."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder used where spark.checkpoint.dir is unset, by application.
_OWN_ROOT: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, a temporary one, in a local session only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_ROOT:
        _OWN_ROOT[app] = "file://" + tempfile.mkdtemp(prefix="pixelweft-")
    return _OWN_ROOT[app]


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/pixelweft/{label}-{uuid.uuid4().hex}"
    # The table replaces its lineage, so the shuffle files that led to it may go as soon as it is written.
    key, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", None
    try:
        before = spark.conf.get(key)
        spark.conf.set(key, "true")
        df.write.parquet(path)
    finally:
        if before is not None:
            spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing will read again."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt_parts(df: DataFrame, each: int = 16 << 20) -> int:
    """Parts to deal what is made of df into: `each` bytes of its input to a part, and two parts a core at least."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(2 * df.sparkSession.sparkContext.defaultParallelism, size // each if size < 1 << 60 else 0)


#: Edges up to which one task finds the components (16 bytes each); beyond it they are found by joins.
SMALL_EDGES = 1_000_000


def _union_find(batches):
    import pyarrow as pa

    parent: dict[int, int] = {}

    def top(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            p, q = top(u), top(v)
            if p != q:
                parent[max(p, q)] = min(p, q)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], ["node", "component"])


def slices(batches, rows: int = 1000):
    """Arrow batches of at most `rows` rows, so that what Python makes of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b): one row (node, component) per node of an edge, component the smallest node.

    Few edges, by a count, go to one task. Otherwise large-star and small-star steps over DataFrames alternate until the edges
    are stars around the smallest nodes; only minima are grouped, so a hub is combined before the shuffle. Self-links are left
    out.
    """
    now = stage(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if now.count() <= SMALL_EDGES:
        return now.coalesce(1).mapInArrow(_union_find, "node long, component long")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))
        )).alias("e")).select("e.u", "e.v").where("u > v").distinct()
        after = stage(small, "edges")
        unstage(now)
        now = after
        # Done when every node has one root and no root has another.
        children = now.groupBy("u").agg(F.count("*").alias("n"))
        if children.where("n > 1").isEmpty() and now.join(children.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
    return now.select(F.explode(F.array(
        F.struct(F.col("u").alias("node"), F.col("v").alias("component")), F.struct(F.col("v").alias("node"), F.col("v").alias("component"))
    )).alias("e")).select("e.*").distinct()


#: Weight of the members of a star that one task compares with each other; larger stars are cut in blocks, block by block.
BLOCK_WEIGHT = 1 << 21


def connect(open_: DataFrame, star: DataFrame, verified, data, find, about=None, may=None) -> DataFrame | None:
    """Components over the verified ones of candidate pairs, with few verifications; None where there are no candidates.

    open_(a, b), a < b, are candidates; verified(pairs) returns those that are links. Rows of star(a, b) stand for all pairs
    among one a and its b. One pair per b is verified first, then the others whose ends are not connected yet. Of the stars
    that do not hold together by then all members are compared with each other, where they lie: data() has (node, weight,
    data), about() has (node, about), and find(data, components) gives the places of linked members of different components, one link for each two
    components that it joins, so that no more links leave a task than it has members.
    """
    open_ = stage(open_, "open")
    if open_.isEmpty() and star.isEmpty():
        return None
    links = stage(verified(open_.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")), "links")
    found = stage(components(links), "found")

    def joined(new):
        nonlocal links, found
        if not new.isEmpty():
            links = links.unionByName(new)
            found = stage(components(links), "found")

    apart = stage(
        open_.join(found.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
        .join(found.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        .where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"), "rest")
    if not apart.isEmpty():
        joined(stage(verified(apart), "links"))
    group = (star.select("a", "b").unionByName(star.select("a", F.col("a").alias("b"))).distinct()
             .join(found.select(F.col("node").alias("b"), "component"), "b", "left").select("a", F.col("b").alias("node"), F.coalesce("component", "b").alias("component")))
    group = stage(group, "stars")
    broken = group.groupBy("a").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("a")
    if not broken.isEmpty():
        group = group.join(broken, "a", "left_semi")
        if may is not None:
            group = stage(_may_cross(group.join(about(), "node"), may), "crossing")
        joined(stage(_crossing(group, data(), find).distinct(), "cross"))
    return found


def _blocks(rows: DataFrame, weight) -> DataFrame:
    """rows(a, node, ...) with i and j: the blocks of a star that meet in a task, each row in as many as its star has blocks."""
    blocks = (rows.groupBy("a").agg(F.sum(weight).alias("weight")).where(F.col("weight") > BLOCK_WEIGHT)
              .select("a", F.ceil(F.col("weight") / BLOCK_WEIGHT).cast("int").alias("blocks")))
    return (rows.join(blocks, "a", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("blocks", "own", "other"))


def _may_cross(rows: DataFrame, may) -> DataFrame:
    """(a, node, component) of the members that may link with one of another component in their star."""
    def judge(table):
        import pyarrow as pa

        keep = may(table.column("about").to_pylist(), table.column("component").to_numpy())
        return table.select(["a", "node", "component"]).filter(pa.array(keep))

    return _blocks(rows, F.lit(256)).groupBy("a", "i", "j").applyInArrow(judge, "a long, node long, component long").distinct()


def _crossing(group: DataFrame, data: DataFrame, find) -> DataFrame:
    """Links (a, b) between members of one star and of different components; group(a, node, component)."""
    def cross(table):
        import pyarrow as pa

        node, own = table.column("node").to_numpy(), table.column("component").to_numpy()
        at = find(table.column("data").to_pylist(), own)
        ends = node[at]
        return pa.table({"a": pa.array(ends.min(1)), "b": pa.array(ends.max(1))})

    dealt = _blocks(group.join(data, "node"), "weight").select("a", "i", "j", "node", "component", "data")
    return dealt.groupBy("a", "i", "j").applyInArrow(cross, "a long, b long")


def quoted(name: str) -> str:
    """A column's name as an identifier, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def free_names(columns, *names: str) -> list[str]:
    """The names, each with as many _ in front as it takes to clash with none of the columns, whatever their case."""
    taken = {c.lower() for c in columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


def covered(n: int, near) -> tuple[np.ndarray, np.ndarray]:
    """Of n things that met: pairs (i, j) that may link, so that each that may link with some other is in one, and the places of these.

    near(i, j) tells which may link, i being a column of places and j a row. The first few cover what is alike; the rest are
    held against all, many at a time.
    """
    lone, every, pairs = np.ones(n, bool), np.arange(n), []
    for i in range(min(4, n)):
        if lone[i]:
            hit = near(np.array([[i]]), every)[0]
            hit[i] = False
            fresh = np.flatnonzero(hit & lone)
            if len(fresh):
                lone[fresh] = lone[i] = False
                pairs.append(np.sort(np.stack((np.full(len(fresh), i), fresh), 1), axis=1))
    rest = np.flatnonzero(lone)
    step = max(1, (1 << 17) // max(1, n))
    for at in range(0, len(rest), step):
        some = rest[at: at + step]
        hit = near(some[:, None], every)
        hit[np.arange(len(some)), some] = False
        has = hit.any(1)
        some, first = some[has], hit[has].argmax(1)
        lone[some] = lone[first] = False
        pairs.append(np.sort(np.stack((some, first), 1), axis=1))
    return (np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)), np.flatnonzero(~lone)


def forest(pairs: np.ndarray, group: np.ndarray, each: int = 0) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Of pairs (i, j), i < j, of places in groups: each j with its smallest i, and stars over the groups with more pairs than that.

    Of groups with up to `each` more pairs to a j all pairs are returned, and no star. group gives a place's group, ascending. A star is (lead, member), the lead being the first place of its group that is in a pair.
    """
    pairs = pairs[np.lexsort((pairs[:, 0], pairs[:, 1]))]
    fresh = np.ones(len(pairs), bool)
    fresh[1:] = pairs[1:, 1] != pairs[:-1, 1]
    of = group[pairs[:, 1]]
    more = np.bincount(of, minlength=1) > (1 + each) * np.bincount(of[fresh], minlength=1)
    member = np.unique(pairs[more[of]])
    if each:
        fresh |= ~more[of]
    first = np.ones(len(member), bool)
    first[1:] = group[member[1:]] != group[member[:-1]]
    lead = member[first][np.cumsum(first) - 1]
    return pairs[fresh], (lead[~first], member[~first])


class Overlaps:
    """Numbers of common elements of sets without repeats, none empty: one against all, exactly."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        _, ids, count = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
        self.ids, self.mark = ids.astype(np.int32), np.zeros(len(count) + 1, np.int32)
        self.start = np.cumsum(self.size) - self.size
        #: How many elements of each set another one has too.
        self.shared = self._sums((count > 1).astype(np.int32))

    def _sums(self, by_element: np.ndarray) -> np.ndarray:
        return np.add.reduceat(by_element.take(self.ids), self.start) if len(self.start) else self.size

    def of(self, i: int) -> np.ndarray:
        own = self.ids[self.start[i]: self.start[i] + self.size[i]]
        self.mark[own] = 1
        out = self._sums(self.mark)
        self.mark[own] = 0
        return out

    def only(self, keep: np.ndarray) -> "Overlaps":
        """The same for the sets at the places `keep`."""
        some = object.__new__(Overlaps)
        some.size, some.shared, some.mark = self.size[keep], self.shared[keep], self.mark
        some.start = np.cumsum(some.size) - some.size
        some.ids = self.ids[np.repeat(self.start[keep] - some.start, some.size) + np.arange(some.size.sum())]
        return some


def joining(component: np.ndarray, near) -> np.ndarray:
    """Pairs of places that join components: near(i, places) gives those of the places, all of other components, that i links with.

    Of two different components one is not the commonest, so only the members of the others are asked.
    """
    _, own, count = np.unique(component, return_inverse=True, return_counts=True)
    out = []
    for i in np.flatnonzero(own != count.argmax()) if len(count) > 1 else ():
        others = np.flatnonzero(own != own[i])
        hit = near(i, others) if len(others) else others
        if len(hit):
            _, first = np.unique(own[hit], return_index=True)  # one link for each other component
            out += [(i, hit[k]) for k in first]
            own[np.isin(own, own[hit])] = own[i]
    return np.array(out, np.int64).reshape(-1, 2)


# ---------------------------------------------------------------- words and hashes over a batch of UTF-8 texts

_RNG = np.random.Generator(np.random.PCG64(20240611))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
#: By number of bytes: the mask of a little-endian word's first bytes.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer on 64-bit words (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; null counts as empty."""
    import pyarrow as pa

    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0]


def lower_bytes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of some texts, lower-cased beyond A-Z; `word_hashes` sees to A-Z in those of ASCII alone. None counts as empty."""
    parts = [(t if t.isascii() else t.lower()).encode() if t else b"" for t in texts]
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    return np.frombuffer(b"".join(parts), np.uint8), offsets


def chunks(offsets: np.ndarray, most: int = 1 << 18):
    """Row ranges [i, j) of at most `most` bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_hashes(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE, sizes: bool = False, tails: bool = False) -> tuple[np.ndarray, ...]:
    """64-bit hashes of the words (A-Z lower-cased) of some texts, and the first word's index of each text.

    space: which bytes part words, by default those of [ \\t-\\r]. sizes: also return the words' lengths in bytes. tails: also return
    the words' last three bytes as numbers. A word is read eight bytes at a time, from every byte's place as a 64-bit word.
    """
    n = len(data)
    if not n:
        return (np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), *([np.zeros(0, np.int64)] * (sizes + tails)))
    whole = data.tobytes()
    word = np.frombuffer(whole.translate((~space).tobytes()), bool)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(word & (edge[:-1] | np.concatenate(([True], ~word[:-1]))))
    size = np.flatnonzero(word & (edge[1:] | np.concatenate((~word[1:], [True])))) + 1 - starts
    at_byte = np.ndarray((n,), "<u8", whole.translate(_LOWER.tobytes()) + bytes(8), strides=(1,))
    hashes = mix64((at_byte[starts] & _FIRST[np.minimum(size, 8)]) + size.astype(np.uint64) * np.uint64(_BASE))
    more, done = np.flatnonzero(size > 8), 8
    while len(more):
        hashes[more] = mix64(hashes[more] ^ at_byte[starts[more] + done] & _FIRST[np.minimum(size[more] - done, 8)])
        done += 8
        more = more[size[more] > done]
    out = (hashes, np.searchsorted(starts, offsets), *([size] if sizes else []))
    if tails:
        out += ((at_byte[starts + np.maximum(size - 3, 0)] & _FIRST[np.minimum(size, 3)]).astype(np.int64),)
    return out


_TURN = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct word shingles; fewer words make one shingle, no words none."""
    words, first = word_hashes(data, offsets)
    m = len(words) - width + 1
    rolled = np.zeros(max(m, 0), np.uint64)
    for k in range(width if m > 0 else 0):
        rolled += words[k: k + m] * _TURN[k]
    rolled = mix64(rolled)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            s = np.sort(rolled[a: b - width + 1])
            sets.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            part = words[a:b]
            sets.append(mix64((part * _TURN[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            sets.append(rolled[:0])
    return sets
