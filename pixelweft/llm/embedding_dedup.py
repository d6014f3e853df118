"""Near-duplicate embeddings by lattice hashing.

Each of several tables projects unit vectors at random to a few blocks of eight dimensions, scales and shifts them, and
decodes every block to the nearest point of the E8 lattice; the points together name a cell. A vector is indexed in its
own cell and probes, besides it, the neighbouring cells (one block moved by one of E8's 240 shortest vectors) that are
nearest to it. Vectors that meet are compared first by a sketch of random hyperplanes, whose threshold is some six
standard deviations from what a link shows, and what passes is verified by cosine in double precision.

With the defaults a pair of cosine 0.9 in 64 dimensions is met with a probability above 0.99 (0.9999 at 0.95); the tests
measure recall against brute force. A cell takes in about one unrelated vector in a thousand; far larger tables should
have more blocks, and more tables to make up for it.

Equal vectors are one node with a weight, so a vector with thousands of copies is hashed once. Cells with more than
CELL_ROWS vectors are dealt to several tasks, each with a share of the index and all probes.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, mix64, partitions, stage

CELL_ROWS = 2048
SKETCH_BITS = 128


def e8_shortest() -> np.ndarray:
    """The 240 shortest vectors of E8: all (+-1, +-1, 0^6) and the half-integer ones with an even number of minus signs."""
    found = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            found.append(v)
    found += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(found)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: where rounding gives an odd one, the coordinate rounded worst goes the other way."""
    near = np.rint(x)
    rest = x - near
    row = np.arange(len(x))
    worst = np.abs(rest).argmax(1)
    near[row, worst] += np.where(near.sum(1) % 2 != 0, np.where(rest[row, worst] >= 0, 1.0, -1.0), 0.0)
    return near


def e8_nearest(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8 = D8 and D8 shifted by a half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


class Hasher:
    def __init__(self, dims: int, tables: int, blocks: int, probes: int, scale: float, seed: int):
        rng = np.random.default_rng((seed, dims))
        pad = max(dims, 8 * blocks)  # short vectors are padded with zeros
        self.dims, self.pad, self.blocks, self.probes, self.scale = dims, pad, blocks, probes, scale * (pad / 64) ** 0.5
        self.turn = [np.linalg.qr(rng.normal(size=(pad, 8 * blocks)))[0] for _ in range(tables)]
        self.shift = rng.random((tables, 8 * blocks)) * 2
        self.planes = rng.normal(size=(pad, SKETCH_BITS))
        self.steps = e8_shortest()
        self.odd = rng.integers(1, 2**62, 8 * blocks).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def _name(self, table: int, points: np.ndarray) -> np.ndarray:
        twice = np.rint(2 * points).astype(np.int64).astype(np.uint64)
        return mix64((twice * self.odd).sum(1, dtype=np.uint64) + mix64(np.array([table * 1_000_003 + self.dims], np.uint64)))

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Own cells (n, tables) and neighbouring cells (n, tables, probes)."""
        unit = np.pad(unit, ((0, 0), (0, self.pad - self.dims)))
        own, near = [], []
        row = np.arange(len(unit))
        for t, (turn, shift) in enumerate(zip(self.turn, self.shift)):
            at = unit @ turn * self.scale + shift
            point = np.concatenate([e8_nearest(at[:, 8 * b: 8 * b + 8]) for b in range(self.blocks)], 1)
            own.append(self._name(t, point))
            gain = np.concatenate([(at - point)[:, 8 * b: 8 * b + 8] @ self.steps.T for b in range(self.blocks)], 1)
            best = np.argpartition(-gain, self.probes, 1)[:, : self.probes]
            names = []
            for k in range(self.probes):
                block, step = best[:, k] // len(self.steps), best[:, k] % len(self.steps)
                moved = point.reshape(len(unit), self.blocks, 8).copy()
                moved[row, block] += self.steps[step]
                names.append(self._name(t, moved.reshape(len(unit), -1)))
            near.append(np.stack(names, 1))
        return np.stack(own, 1), np.stack(near, 1)

    def sketch(self, unit: np.ndarray) -> np.ndarray:
        bits = np.pad(unit, ((0, 0), (0, self.pad - self.dims))) @ self.planes > 0
        return np.packbits(bits, axis=1).view(np.int64)


def _vectors(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) by number of dimensions, of an Arrow list column without nulls."""
    values, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(column.value_lengths().to_numpy())
    size = np.diff(ends, prepend=0)
    return [(rows := np.flatnonzero(size == d), values[(ends[rows] - d)[:, None] + np.arange(d)]) for d in np.unique(size)]


def usable(vector: Column) -> Column:
    """Whether a vector can link: not null, no component null or not finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def links(nodes: DataFrame, threshold: float = 0.9, tables: int = 8, blocks: int = 2, probes: int = 6, scale: float = 3.0, seed: int = 7) -> DataFrame:
    """Pairs a < b of nodes(node, embedding) with cosine >= threshold, each once."""
    spark = nodes.sparkSession
    nodes = stage(nodes.select("node", F.col("embedding").cast("array<double>").alias("embedding")), "vectors")
    differ = np.arccos(min(1.0, threshold)) / np.pi
    most = SKETCH_BITS * differ + 6.5 * (SKETCH_BITS * differ * (1 - differ)) ** 0.5

    def hashed(batches):
        import pyarrow as pa

        hashers: dict[int, Hasher] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for rows, m in _vectors(batch.column(1)):
                d = m.shape[1]
                if d not in hashers:
                    hashers[d] = Hasher(d, tables, blocks, probes, scale, seed)
                unit = m / np.abs(m).max(1)[:, None]  # before the norm, against overflow
                unit /= np.linalg.norm(unit, axis=1)[:, None]
                own, near = hashers[d].cells(unit)
                sketch = hashers[d].sketch(unit)
                n = tables * (1 + probes)
                key = np.concatenate((own[:, :, None], near), 2).reshape(-1).view(np.int64)
                index = np.tile(np.arange(n) % (1 + probes) == 0, len(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(np.repeat(ids[rows], n)), pa.array(index)] + [pa.array(np.repeat(sketch[:, k], n)) for k in (0, 1)],
                    ["cell", "node", "index", "s0", "s1"])

    entries = nodes.mapInArrow(hashed, "cell long, node long, index boolean, s0 long, s1 long")
    large = entries.where("index").groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > CELL_ROWS) \
        .select("cell", F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("shares"))
    large = stage(large, "cells")
    dealt = entries.join(large, "cell", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
    # In a cell of several shares an indexed row also probes the other shares, as a row of its own.
    dealt = dealt.unionByName(dealt.where("index AND shares > 1").withColumn("index", F.lit(False)))
    share = F.when(F.col("index"), F.array(F.pmod(F.xxhash64("node"), F.col("shares")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("shares") - 1))
    dealt = dealt.withColumn("share", share)
    dealt = dealt.withColumn("share", F.explode("share"))
    parts = 4 * partitions(spark)
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("cell", "share"), F.lit(parts)).cast("int"))

    def meet(table):
        import pyarrow as pa

        cell, share, node, index = (table.column(n).to_numpy() for n in ("cell", "share", "node", "index"))
        sketch = np.stack([table.column(n).to_numpy().view(np.uint64) for n in ("s0", "s1")], 1)
        order = np.lexsort((~index, share, cell))  # in each cell the index first
        cell, share, node, index, sketch = cell[order], share[order], node[order], index[order], sketch[order]
        first = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]) | (share[1:] != share[:-1])))) if len(cell) else np.zeros(0, int)
        found = []
        for lo, hi in zip(first, np.append(first[1:], len(cell))):
            n = int(index[lo:hi].sum())
            if not n or hi - lo < 2:
                continue
            for at in range(lo, hi, 1024):  # blocks of rows against the cell's index
                rows = slice(at, min(at + 1024, hi))
                far = np.bitwise_count(sketch[rows, None, :] ^ sketch[None, lo: lo + n, :]).sum(2)
                i, j = np.nonzero(far <= most)
                a, b = node[rows][i], node[lo: lo + n][j]
                found.append(np.stack((np.minimum(a, b), np.maximum(a, b)), 1)[a != b])
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pa.table({"a": pa.array(pairs[:, 0].astype(np.int64)), "b": pa.array(pairs[:, 1].astype(np.int64))})

    met = dealt.select("part", "cell", "share", "node", "index", "s0", "s1").groupBy("part").applyInArrow(meet, "a long, b long").distinct()

    def verify(batches):
        import pyarrow as pa

        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            right = {d.shape[1]: (r, d) for r, d in _vectors(batch.column(3))}
            for rows, x in _vectors(batch.column(2)):
                other, y = right.get(x.shape[1], (np.zeros(0, int), x[:0]))
                both, i, j = np.intersect1d(rows, other, return_indices=True)
                x, y = x[i] / np.abs(x[i]).max(1, initial=0)[:, None], y[j] / np.abs(y[j]).max(1, initial=0)[:, None]
                cosine = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
                keep[both] = cosine >= threshold
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return (
        met.join(nodes.select(F.col("node").alias("a"), F.col("embedding").alias("ea")), "a")
        .join(nodes.select(F.col("node").alias("b"), F.col("embedding").alias("eb")), "b")
        .select("a", "b", "ea", "eb").mapInArrow(verify, "a long, b long")
    )


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, **how) -> DataFrame:
    """vec_id, n_links, component_id, kept per row of vectors(vec_id, embedding).

    n_links counts the other rows linked directly, copies included; component_id is the smallest vec_id reachable.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
    different lengths. A null vec_id links with nothing, has a null component_id and is not kept. Repeated rows count
    as vectors of their own.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = rows.withColumn("ok", usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    # A node is a vector, named by a hash of it: rows of one vec_id may hold different vectors.
    nodes = stage(rows.where("ok").groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
                  .withColumn("node", F.xxhash64("embedding")), "nodes")
    pairs = stage(links(nodes, threshold, **how), "links")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(nodes.select(F.col("node").alias("b"), "weight"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("linked"))
    found = nodes.select("node", "least").join(components(pairs), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = found.groupBy("component").agg(F.min("least").alias("component_id"))
    found = found.join(least, "component").select("node", "component_id")
    per_node = nodes.join(degree, "node", "left").join(found, "node").select(
        F.col("embedding").alias("__e"), (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component_id")
    joined = rows.join(per_node, F.col("ok") & (F.col("embedding") == F.col("__e")), "left")
    component = F.when(F.col("ok"), F.col("component_id")).otherwise(F.col("vec_id"))
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
