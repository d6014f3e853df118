"""Rasters made of the tables at hand.

Embeddings are read as pixels: values are shifted by a half, scaled to 8 bits, clamped and truncated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.sqlop import DUCKDB, SPARK, Dialect


def _exploded(d: Dialect, embeddings: str, of: int = 1) -> str:
    """(vec_id, p, e): components from 0, zeros after them up to a multiple of `of`."""
    if d is DUCKDB:
        e = "embedding" if of == 1 else f"list_resize(embedding, {of} * CAST(ceil(len(embedding) / {of}e0) AS BIGINT), 0)"
        return f"(SELECT vec_id, p, CAST(e AS DOUBLE) AS e FROM (SELECT vec_id, CAST(unnest(range(len({e}))) AS INTEGER) AS p, unnest({e}) AS e FROM {embeddings}))"
    e = "embedding" if of == 1 else f"concat(embedding, array_repeat(CAST(0 AS FLOAT), pmod(-cardinality(embedding), {of})))"
    return f"(SELECT vec_id, p, CAST(f AS DOUBLE) AS e FROM {embeddings} LATERAL VIEW posexplode({e}) t AS p, f)"


def grey_sql(d: Dialect, embeddings: str) -> str:
    """One image, 64 wide, a row per vector."""
    return f"SELECT 0 AS image_id, p AS x, CAST(vec_id AS INT) AS y, 0 AS band, {d.u8_trunc('(e + 5e-1) * 255')} AS v FROM {_exploded(d, embeddings)}"


def rgb_sql(d: Dialect, embeddings: str) -> str:
    """Five aligned images of three bands, a third of a vector wide."""
    return (f"SELECT CAST(vec_id % 5 AS INT) AS image_id, CAST(floor(p / 3e0) AS INT) AS x, CAST(floor(vec_id / 5e0) AS INT) AS y, p % 3 AS band, "
            f"{d.u8_trunc('(e + 5e-1) * 255')} AS v FROM {_exploded(d, embeddings, 3)}")


def stack_sql(d: Dialect, embeddings: str) -> str:
    """Five aligned images, 64 wide, one band."""
    return (f"SELECT CAST(vec_id % 5 AS INT) AS image_id, p AS x, CAST(floor(vec_id / 5e0) AS INT) AS y, 0 AS band, "
            f"{d.u8_trunc('(e + 5e-1) * 255')} AS v FROM {_exploded(d, embeddings)}")


def float_sql(d: Dialect, embeddings: str) -> str:
    """The grey image with the values as they are."""
    return f"SELECT 0 AS image_id, p AS x, CAST(vec_id AS INT) AS y, 0 AS band, e AS v FROM {_exploded(d, embeddings)}"


def bag_sql(d: Dialect, lineitem: str) -> str:
    """Line items as a bag of pixels of three bands without places; for statistics."""
    values = (("0", "l_quantity * 5"), ("1", "l_discount * 2550"), ("2", "l_tax * 3187"))
    return " UNION ALL ".join(f"SELECT 0 AS image_id, 0 AS x, 0 AS y, {b} AS band, {d.u8_trunc(e)} AS v FROM {lineitem}" for b, e in values)


def polylines_sql(d: Dialect, embeddings: str) -> str:
    """A polyline per vector, its components in pairs being points; those of even vectors are closed."""
    at = ", ".join(f"max(CASE WHEN p % 2 = {k} THEN 32 + 60 * e END) AS {c}" for k, c in enumerate("xy"))
    return (f"SELECT vec_id AS path_id, 0 AS part, CAST(floor(p / 2e0) AS INT) AS seq, {at}, CAST(1 - vec_id % 2 AS INT) AS closed FROM {_exploded(d, embeddings, 2)} "
            f"GROUP BY vec_id, CAST(floor(p / 2e0) AS INT)")


def stars_sql(d: Dialect, embeddings: str) -> str:
    """A polygon per vector, its components being radii at equal angles around (32, 32)."""
    angle = f"p * {d.num(6.283185307179586)} / 64"
    return (f"SELECT vec_id AS path_id, p AS seq, round(32 + greatest(2, 22 + 24 * e) * cos({angle}), 6) AS x, round(32 + greatest(2, 22 + 24 * e) * sin({angle}), 6) AS y "
            f"FROM {_exploded(d, embeddings)} WHERE p < 64")


WRITERS = {"stars": (stars_sql, "embeddings"), "polylines": (polylines_sql, "embeddings"), "grey": (grey_sql, "embeddings"), "rgb": (rgb_sql, "embeddings"), "stack": (stack_sql, "embeddings"), "float": (float_sql, "embeddings"), "bag": (bag_sql, "lineitem")}


def raster(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    write, table = WRITERS[kind]
    return spark.sql(write(SPARK, "{t}"), t=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def raster_sql(kind: str) -> str:
    write, table = WRITERS[kind]
    return f"({write(DUCKDB, table)})"
