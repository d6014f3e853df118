"""Centroid clustering of vectors by exact integer arithmetic and partial-distance search.

Vectors are turned to integers once and staged. In each round tasks assign the vectors they read and give one row of sums per
centroid, so that a round shuffles as many rows as centroids times tasks, whatever cluster is large; k centroids travel to the
tasks and k rows of sums to the driver.

The search looks at the dimensions of the largest variance first: squared differences over the first block of dimensions are
summed for every centroid, the nearest by these is finished for a first bound, and a centroid is abandoned once its partial
sum is strictly above the bound of its vector. Survivors finish all dimensions, so ties are decided on whole distances.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, slices, stage

#: Components in units of 1/256 count as no more than this, so that squared distances of 64 dimensions are exact in 64 bits.
LARGEST = 1 << 27
#: Dimensions after which partial sums are compared with the bounds, as shares of all.
STEPS = (1 / 8, 1 / 4, 1 / 2, 1)


def _integers(column, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """The integer vectors of an Arrow list column, and the places of the rows that have one."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.cast(pa.list_(pa.float64()))
    at = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dims), False).to_numpy(zero_copy_only=False))
    flat = pc.list_flatten(column.take(pa.array(at)))
    x = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(len(at), dims)
    good = np.isfinite(x).all(axis=1)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * x[good]), -LARGEST, LARGEST).astype(np.int64), at[good]


def integer_vectors(vectors: DataFrame, embedding: str = "embedding", dims: int = 64, scale: int = 256) -> DataFrame:
    """The rows of vectors with exactly `dims` components, none null or not finite, with the vector floor(scale * x) in `units`.

    Components beyond ±2^27 units count as that. A column named units is replaced, all others but the embedding stay.
    """
    import pyarrow as pa
    from pyspark.sql.types import ArrayType, LongType, StructField, StructType

    kept = vectors.drop(*{"units"} - {embedding})
    schema = StructType([f for f in kept.schema.fields if f.name != embedding] + [StructField("units", ArrayType(LongType()))])

    def convert(batches):
        for batch in batches:
            place = batch.schema.get_field_index(embedding)
            for part in slices([batch], 4096):
                units, at = _integers(part.column(place), dims, scale)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, units.size + 1, dims), pa.int32()), pa.array(units.reshape(-1)))
                rest = [c.take(pa.array(at)) for k, c in enumerate(part.columns) if k != place]
                yield pa.RecordBatch.from_arrays([*rest, lists], names=schema.names)

    return kept.mapInArrow(convert, schema)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x its nearest row of centroids (ties: the smaller) and their squared distance; order: dimensions, first to last."""
    n, k = len(x), len(centroids)
    x, centroids = x[:, order], centroids[:, order]
    ends = sorted({max(1, int(len(order) * s)) for s in STEPS})
    first = np.zeros((n, k), np.int64)
    for d in range(ends[0]):
        gap = x[:, d, None] - centroids[None, :, d]
        first += gap * gap
    rows = np.arange(n)
    guess = first.argmin(axis=1)
    rest = x[:, ends[0]:] - centroids[guess, ends[0]:]
    bound = first[rows, guess] + (rest * rest).sum(axis=1)
    alive = first <= bound[:, None]
    row, of = np.nonzero(alive)
    partial = first[row, of]
    for a, b in zip(ends, ends[1:]):
        gap = x[row, a:b] - centroids[of, a:b]
        partial = partial + (gap * gap).sum(axis=1)
        keep = partial <= bound[row]
        row, of, partial = row[keep], of[keep], partial[keep]
    best = np.lexsort((of, partial, row))
    best = best[np.concatenate(([True], row[best][1:] != row[best][:-1]))] if n else best
    return of[best], partial[best]


def _units(column, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _totals(units: DataFrame, dims: int) -> np.ndarray:
    """The dimensions by falling variance, which only decides how soon centroids are abandoned: doubles will do."""
    def sums(batches):
        import pyarrow as pa

        n, s, q = 0, np.zeros(dims), np.zeros(dims)
        for part in slices(batches, 4096):
            x = _units(part.column(0), dims).astype(np.float64)
            n, s, q = n + len(x), s + x.sum(axis=0), q + (x * x).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(np.full(dims, n)), pa.array(s), pa.array(q)], names=["d", "n", "s", "q"])

    parts = units.mapInArrow(sums, "d int, n long, s double, q double")
    variance = {r.d: r.q / r.n - (r.s / r.n) ** 2 for r in parts.groupBy("d").agg(*(F.sum(c).alias(c) for c in "nsq")).collect()}
    return np.array(sorted(range(dims), key=lambda d: -variance.get(d, 0.0)), np.int64)


def _round(units: DataFrame, centroids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The centroids after one round: componentwise floor of the means of their vectors, those without any unchanged."""
    k, dims = centroids.shape

    def gather(batches):
        import pyarrow as pa

        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for part in slices(batches, 4096):
            x = _units(part.column(0), dims)
            own, _ = nearest(x, centroids, order)
            by = np.argsort(own, kind="stable")
            found, start = np.unique(own[by], return_index=True)
            if len(found):
                total[found] += np.add.reduceat(x[by], start, axis=0)
                count += np.bincount(own, minlength=k)
        at = np.flatnonzero(count)
        c, d = np.repeat(at, dims).astype(np.int32), np.tile(np.arange(dims, dtype=np.int32), len(at))
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(d), pa.array(np.repeat(count[at], dims)), pa.array(total[at].reshape(-1))], names=["c", "d", "n", "s"])

    out = centroids.copy()
    for r in units.mapInArrow(gather, "c int, d int, n long, s long").groupBy("c", "d").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
        out[r.c, r.d] = r.s // r.n
    return out


def fit(units: DataFrame, k: int = 40, rounds: int = 5, seed: str = "2", vec_id: str = "vec_id", dims: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Centroids after `rounds` rounds over (vec_id, units), and the order of dimensions by falling variance.

    The first ones are the k vectors of the smallest sha256 of the seed, a colon and the id (null: nothing), rows of one id in
    the order of their vectors; with fewer than k vectors there are as many centroids as vectors.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(vec_id).cast("string"), F.lit(""))), 256)
    first = units.select("units", digest.alias("h")).orderBy("h", "units").limit(k).collect()
    centroids = np.array([r.units for r in first], np.int64).reshape(len(first), dims)
    order = np.arange(dims)
    if len(first):
        vectors = units.select("units")
        order = _totals(vectors, dims)
        for _ in range(rounds):
            centroids = _round(vectors, centroids, order)
    return centroids, order


def assign(units: DataFrame, centroids: np.ndarray, order: np.ndarray) -> DataFrame:
    """units without its vectors, with cluster and distance (squared); columns of these names are replaced."""
    import pyarrow as pa
    from pyspark.sql.types import IntegerType, LongType, StructField, StructType

    units = units.drop("cluster", "distance")
    dims = centroids.shape[1]
    schema = StructType([f for f in units.schema.fields if f.name != "units"] + [StructField("cluster", IntegerType()), StructField("distance", LongType())])

    def find(batches):
        for batch in batches:
            place = batch.schema.get_field_index("units")
            for part in slices([batch], 4096):
                own, far = nearest(_units(part.column(place), dims), centroids, order)
                yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(part.columns) if i != place), pa.array(own.astype(np.int32)), pa.array(far)], names=schema.names)

    return units.mapInArrow(find, schema)


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: str = "2", dims: int = 64, scale: int = 256) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector of `dims` finite components.

    Other rows (null, shorter or longer vectors, null or non-finite components) are left out; repeated rows each have theirs.
    Without any vector the result is empty. At most k rows of sums and digests are joined to the vectors, by broadcast.
    """
    units = stage(integer_vectors(vectors.select("vec_id", "embedding"), dims=dims, scale=scale), "units")
    centroids, order = fit(units, k, rounds, seed, dims=dims)
    found = stage(assign(units, centroids, order), "clusters")
    own, = free_names(found.columns, "of")
    sums = found.groupBy(F.col("cluster").alias(own)).agg(F.sum("distance").alias("cluster_inertia")).collect()
    whole = sum(r.cluster_inertia for r in sums)
    digest = {c: hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for c, row in enumerate(centroids.tolist())}
    about = found.sparkSession.createDataFrame([(r[own], r.cluster_inertia, whole, digest[r[own]]) for r in sums], f"{own} int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), F.col("cluster") == F.col(own)).drop(own).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
