"""Colours from one ICC profile's space to another's.

What differs are the distinct colours of a raster; these are transformed and joined back to the pixels. Curves are tables that a
colour meets at the place it lies in, grids of colours tables that each of its 2^n corners meets, weighted. Such tables come from
the profiles and are as large as these: at most 65,535 entries a curve.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.icc import Lut, Profile, parse

#: Steps that linear light is taken to before the inverse of a tone curve. Fixed value.
STEPS = 4096
#: XYZ of 1 in a connection space's code, the white that Lab refers to there, and its cube root's end. Fixed values.
XYZ_ONE, WHITE, NEAR, SLOPE = 65535 / 32768, (0.96422, 1.0, 0.82521), 216 / 24389, 24389 / 27


def _table(df: DataFrame, rows, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, schema)


def _at_codes(df: DataFrame, names: list[str], tables: list[np.ndarray]) -> DataFrame:
    """Columns of whole codes replaced by their entries of a table each."""
    rows = [(k, i, float(v)) for k, t in enumerate(tables) for i, v in enumerate(t)]
    table = F.broadcast(_table(df, rows, "channel int, code int, entry double"))
    for k, name in enumerate(names):
        own = table.where(F.col("channel") == k).select(F.col("code").alias(f"{name}_code"), F.col("entry").alias(f"{name}_entry"))
        df = df.join(own, F.col(name).cast("int") == F.col(f"{name}_code")).withColumn(name, F.col(f"{name}_entry")).drop(f"{name}_code", f"{name}_entry")
    return df


def _curves(df: DataFrame, names: list[str], tables: np.ndarray) -> DataFrame:
    """Columns in 0 .. 1 through curves of equally spaced entries, between two of them by a straight line."""
    n = tables.shape[1]
    rows = [(k, i, float(t[i]), float(t[i + 1])) for k, t in enumerate(tables) for i in range(n - 1)]
    table = F.broadcast(_table(df, rows, "channel int, step int, low double, high double"))
    for k, name in enumerate(names):
        at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(name))) * (n - 1)
        own = table.where(F.col("channel") == k).select(F.col("step").alias(f"{name}_step"), F.col("low").alias(f"{name}_low"), F.col("high").alias(f"{name}_high"))
        df = df.withColumn(f"{name}_at", at).join(own, F.least(F.floor(f"{name}_at"), F.lit(n - 2)).cast("int") == F.col(f"{name}_step"))
        df = df.withColumn(name, F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * (F.col(f"{name}_at") - F.col(f"{name}_step")))
        df = df.drop(*(f"{name}_{c}" for c in ("at", "step", "low", "high")))
    return df


def _gridded(df: DataFrame, key: list[str], names: list[str], lut: Lut, out: list[str]) -> DataFrame:
    """key and the columns `out`: the colours of a grid around (names), weighted by nearness along each channel."""
    n, g = len(names), lut.grid
    at = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))) * (g - 1) for c in names]
    low = [F.least(F.floor(a), F.lit(g - 2)) for a in at]
    corners = []
    for corner in range(1 << n):
        high = [corner >> k & 1 for k in range(n)]
        place = functools.reduce(lambda s, k: s * g + low[k] + high[k], range(n), F.lit(0))
        weight = functools.reduce(lambda s, k: s * ((at[k] - low[k]) if high[k] else (1 - (at[k] - low[k]))), range(n), F.lit(1.0))
        corners.append(F.struct(place.cast("long").alias("place"), weight.alias("weight")))
    grid = _table(df, [(i, *map(float, row)) for i, row in enumerate(lut.colours)], "place long, " + ", ".join(f"g{k} double" for k in range(len(out))))
    met = df.select(*key, F.explode(F.array(*corners)).alias("c")).select(*key, "c.place", "c.weight").where("weight > 0").join(grid, "place")
    return met.groupBy(*key).agg(*(F.sum(F.col("weight") * F.col(f"g{k}")).alias(c) for k, c in enumerate(out)))


def _through(df: DataFrame, key: list[str], names: list[str], lut: Lut, out: list[str]) -> DataFrame:
    df = _curves(df.select(*key, *names), names, lut.inputs)
    if len(names) == 3:
        mixed = [functools.reduce(lambda s, j: s + float(lut.matrix[i, j]) * F.col(names[j]), range(1, 3), float(lut.matrix[i, 0]) * F.col(names[0])) for i in range(3)]
        df = df.withColumns(dict(zip(names, mixed)))
    return _curves(_gridded(df, key, names, lut, out), out, lut.outputs)


def _connected(x: list[Column], source: str, target: str) -> list[Column]:
    """Codes of one connection space (XYZ or Lab) as those of another."""
    if source == target:
        return x
    bounded = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    if source == "Lab ":
        fy = (x[0] * 100 + 16) / 116
        f = [(x[1] * 256 - 128) / 500 + fy, fy, fy - (x[2] * 256 - 128) / 200]
        return [bounded(w * F.when(t * t * t > NEAR, t * t * t).otherwise((116 * t - 16) / SLOPE) / XYZ_ONE) for t, w in zip(f, WHITE)]
    t = [c * XYZ_ONE / w for c, w in zip(x, WHITE)]
    f = [F.when(c > NEAR, F.cbrt(c)).otherwise((SLOPE * c + 16) / 116) for c in t]
    return [bounded((116 * f[1] - 16) / 100), bounded((500 * (f[0] - f[1]) + 128) / 256), bounded((200 * (f[1] - f[2]) + 128) / 256)]


def _inverse(curve) -> np.ndarray:
    """The code nearest to each of STEPS values of light, the higher one at a tie."""
    light, y = curve(np.arange(256) / 255), np.arange(STEPS) / (STEPS - 1)
    above = np.minimum(np.searchsorted(light, y, "left"), 255)
    below = np.maximum(above - 1, 0)
    return np.where((above > 0) & (np.abs(light[below] - y) < np.abs(light[above] - y)), below, above)


INTENTS = {"perceptual": "0", "relative": "1", "saturation": "2", "absolute": "1"}


def _tables(source: Profile, target: Profile, intent: str) -> tuple[Lut, Lut] | None:
    k = INTENTS[intent]
    one, two = source.lut(f"A2B{k}") or source.lut("A2B0"), target.lut(f"B2A{k}") or target.lut("B2A0")
    return (one, two) if one and two and len(one.outputs) == 3 and len(two.inputs) == 3 else None


def icc_transform(r: DataFrame, source: bytes, target: bytes, intent: str = "perceptual") -> DataFrame:
    """Rasters of 8 bits in the source profile's colours to the target's; bands beyond the colours are kept after them.

    Profiles of primaries and tone curves go through linear light, others through their lookup tables. A grey band with a profile
    of three colours counts as all three.
    """
    a, b = parse(source), parse(target)
    pels = r.groupBy("image_id", "x", "y").agg(F.map_from_entries(F.collect_list(F.struct(F.col("band"), F.col("v")))).alias("bands"))
    names = lambda n, s: [f"{s}{k}" for k in range(n)]
    curves = [[p.curve(f"{c}TRC") for c in "rgb"] for p in (a, b)]
    matrices = [p.matrix() for p in (a, b)]
    plain = None not in curves[0] + curves[1] and all(m is not None for m in matrices) and abs(np.linalg.det(matrices[1])) > 1e-12
    luts = None if plain else _tables(a, b, intent)
    if not plain and luts is None:
        raise ValueError("the profiles have neither primaries and curves nor lookup tables that meet")
    given = 3 if plain else len(luts[0].inputs)
    made = 3 if plain else len(luts[1].outputs)
    grey = plain and r.agg(F.max("band")).first()[0] in (0, 1)
    key, out = names(given, "v"), names(made, "o")
    pels = pels.select("image_id", "x", "y", "bands", *(F.col("bands")[0 if grey else k].alias(c) for k, c in enumerate(key)))
    colours = pels.select(*key).distinct()
    work = colours.select(*key, *(F.col(c).alias(f"w{c}") for c in key))
    inner = [f"w{c}" for c in key]
    if plain:
        whole = np.linalg.inv(matrices[1]) @ matrices[0]
        light = _at_codes(work, inner, [c(np.arange(256) / 255) for c in curves[0]])
        for i, c in enumerate(out):
            mixed = functools.reduce(lambda s, j: s + float(whole[i, j]) * F.col(inner[j]), range(1, 3), float(whole[i, 0]) * F.col(inner[0]))
            light = light.withColumn(c, F.floor(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mixed)) * (STEPS - 1), 9) + 0.5).cast("int"))
        found = _at_codes(light.select(*key, *out), out, [_inverse(c) for c in curves[1]])
    else:
        scaled = work.withColumns({c: F.col(c) / 255 for c in inner})
        middle = _through(scaled, key, inner, luts[0], ["p0", "p1", "p2"])
        middle = middle.select(*key, *(c.alias(f"q{k}") for k, c in enumerate(_connected([F.col(f"p{k}") for k in range(3)], a.connection, b.connection))))
        found = _through(middle, key, ["q0", "q1", "q2"], luts[1], out)
        found = found.select(*key, *(F.floor(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))) * 255, 9) + 0.5).alias(c) for c in out))
    taken = 1 if grey else given
    extra = F.transform(F.array_sort(F.filter(F.map_keys("bands"), lambda k: k >= taken)), lambda k: F.struct((k - taken + made).alias("band"), F.element_at("bands", k).alias("v")))
    painted = pels.join(found, key)
    rows = F.concat(F.array(*(F.struct(F.lit(k).alias("band"), F.col(c).cast("double").alias("v")) for k, c in enumerate(out))), extra)
    return painted.select("image_id", "x", "y", F.explode(rows).alias("p")).select("image_id", "x", "y", F.col("p.band").cast("int").alias("band"), F.col("p.v").alias("v"))
