"""Connected regions, floods and distances, tile by tile: no task holds more than a tile, or some rows, of an image.

Regions: every tile labels its own pixels; labels that touch across tile borders are edges of a graph, whose components are
found by joins; then labels are replaced by their component's. A label is the place of its first pixel, y * 2^32 + x, so that the
smallest label of a region is that of its first pixel in the image, whatever the tiles.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staged import checkpointed

TILE = 256
PLACE = ("image_id", "x", "y")


def label(on: np.ndarray, diagonal: bool = False) -> np.ndarray:
    """Connected parts of a boolean array, numbered from 1 in the order of their first pixels; runs are joined row by row."""
    parent, reach = [0], int(diagonal)

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = np.zeros(on.shape, int)
    for y, row in enumerate(on):
        edge = np.flatnonzero(np.diff(np.concatenate(([False], row, [False])).astype(np.int8)))
        for lo, hi in zip(edge[::2], edge[1::2]):
            above = [top(i) for i in np.unique(out[y - 1, max(0, lo - reach): hi + reach]) if i] if y else []
            if above:
                name = min(above)
                for i in above:
                    parent[i] = name
            else:
                name = len(parent)
                parent.append(name)
            out[y, lo:hi] = name
    roots = np.array([top(i) for i in range(len(parent))])
    _, dense = np.unique(roots, return_inverse=True)
    return dense[out]


def _in_tiles(mask: DataFrame, diagonal: bool, tile: int) -> DataFrame:
    """mask(image_id, x, y) with part, the label within its tile; rows may say by a column `same` that a place is not in it, and one is in it if some row says so and none does not."""
    def run(table):
        import pyarrow as pa

        x, y = (table.column(c).to_numpy().astype(np.int64) for c in ("x", "y"))
        x0, y0 = x.min(), y.min()
        on = np.zeros((y.max() - y0 + 1, x.max() - x0 + 1), bool)
        if "same" in table.column_names:
            same = table.column("same")
            yes, no = same.fill_null(False).to_numpy(), ~same.fill_null(True).to_numpy()
            on[y[yes] - y0, x[yes] - x0] = True
            on[y[no] - y0, x[no] - x0] = False
            y, x = np.nonzero(on)
            y, x = y + y0, x + x0
        else:
            on[y - y0, x - x0] = True
        parts = label(on, diagonal)
        _, first = np.unique(parts, return_index=True)
        if not on.all():
            first = first[1:]
        width = on.shape[1]
        key = ((first // width + y0) << 32) + first % width + x0
        image = np.full(len(x), table.column("image_id")[0].as_py(), np.int32)
        return pa.table({"image_id": pa.array(image), "x": pa.array(x.astype(np.int32)), "y": pa.array(y.astype(np.int32)), "part": pa.array(key[parts[y - y0, x - x0] - 1])})

    dealt = mask.withColumns({"tx": F.floor(F.col("x") / tile), "ty": F.floor(F.col("y") / tile)})
    return dealt.groupBy("image_id", "ty", "tx").applyInArrow(run, "image_id int, x int, y int, part long")


def _least(edges: DataFrame) -> DataFrame:
    """(image_id, part, root) of the parts of edges(image_id, a, b): the smallest part that each is connected with.

    In each round a part takes the smallest root among its own and its neighbours', and then that root's root, so that
    distances halve; what is grouped are minima only. Ends when no root changes.
    """
    both = checkpointed(edges.select("image_id", "a", "b").union(edges.select("image_id", "b", "a")).distinct().toDF("image_id", "a", "b"))
    now = checkpointed(both.groupBy("image_id", F.col("a").alias("part")).agg(F.min("b").alias("m")).select("image_id", "part", F.least("part", "m").alias("root")))
    while True:
        near = (both.join(now.select("image_id", F.col("part").alias("b"), "root"), ["image_id", "b"])
                .groupBy("image_id", F.col("a").alias("part")).agg(F.min("root").alias("near")))
        lower = now.join(near, ["image_id", "part"]).select("image_id", "part", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = now.select("image_id", F.col("part").alias("root"), F.col("root").alias("far"))
        after = checkpointed(lower.join(jump, ["image_id", "root"], "left").select("image_id", "part", "old", F.least("root", "far").alias("root")))
        now = after.select("image_id", "part", "root")
        if after.where("root != old").isEmpty():
            return now


def regions(mask: DataFrame, diagonal: bool = False, tile: int = TILE) -> DataFrame:
    """mask(image_id, x, y) with root, the label of each pixel's region; 4-connected, or 8-connected with `diagonal`."""
    parts = checkpointed(_in_tiles(mask, diagonal, tile))
    steps = [(1, 0), (0, 1)] + [(1, 1), (-1, 1)] * diagonal
    border = parts.where(" OR ".join(f"pmod({c}, {tile}) IN (0, {tile - 1})" for c in "xy"))
    moved = border.withColumn("s", F.explode(F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in steps)))).select(
        "image_id", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"), F.col("part").alias("a"))
    edges = moved.join(border.withColumnRenamed("part", "b"), list(PLACE)).where("a != b").select("image_id", "a", "b").distinct()
    edges = checkpointed(edges)
    if edges.isEmpty():
        return parts.withColumnRenamed("part", "root")
    return parts.join(_least(edges), ["image_id", "part"], "left").select(*PLACE, F.coalesce("root", "part").alias("root"))


def numbered(found: DataFrame) -> DataFrame:
    """(image_id, root, number) of the roots of regions: from 1 in the order of first pixels; ranked row by row of the image."""
    roots = found.select("image_id", "root", F.shiftright("root", 32).alias("row")).distinct()
    rows = roots.groupBy("image_id", "row").agg(F.count("*").alias("n"))
    before = rows.select("image_id", "row", (F.sum("n").over(Window.partitionBy("image_id").orderBy("row")) - F.col("n")).alias("before"))
    within = roots.withColumn("k", F.row_number().over(Window.partitionBy("image_id", "row").orderBy("root")))
    return within.join(before, ["image_id", "row"]).select("image_id", "root", (F.col("before") + F.col("k")).alias("number"))


def label_regions(r: DataFrame, tile: int = TILE) -> DataFrame:
    """Number of each pixel's 4-connected region of pixels that are not 0 (in any band); 0 elsewhere."""
    places = r.groupBy(*PLACE).agg(F.max(F.col("v") != 0).alias("lit"))
    found = regions(places.where("lit").select(*PLACE), tile=tile)
    named = found.join(numbered(found), ["image_id", "root"]).select(*PLACE, "number")
    return places.join(named, list(PLACE), "left").select(*PLACE, F.lit(0).alias("band"), F.coalesce("number", F.lit(0)).cast("double").alias("v"))


def draw_flood(r: DataFrame, x: int, y: int, ink, tile: int = TILE) -> DataFrame:
    """Ink the 4-connected pixels equal to the one at (x, y), in each image that has such a place; none where it has the ink already."""
    colour = F.element_at(F.array(*(F.lit(float(v)) for v in ink)), F.col("band") + 1)
    seed = r.where((F.col("x") == x) & (F.col("y") == y)).select("image_id", "band", F.col("v").alias("seed"))
    start = seed.groupBy("image_id").agg(F.min(F.col("seed") == colour).alias("inked")).where("NOT inked").select("image_id")
    # Bands of a place meet in its tile's task, where it is labelled; grouped before, all places of a file's part would be in one task's memory.
    same = r.join(seed, ["image_id", "band"]).join(start, "image_id").select(*PLACE, (F.col("v") == F.col("seed")).alias("same"))
    found = regions(same, tile=tile)
    root = found.where((F.col("x") == x) & (F.col("y") == y)).select("image_id", "root")
    flooded = found.join(root, ["image_id", "root"]).select(*PLACE, F.lit(True).alias("flooded"))
    return r.join(flooded, list(PLACE), "left").select(*PLACE, "band", F.when(F.col("flooded"), colour).otherwise(F.col("v")).alias("v"))


#: Distances are clamped to this, so nothing farther is looked for.
FAR = 255


def _vertical(r: DataFrame, tile: int) -> DataFrame:
    """(image_id, x, y, gap): rows to the nearest lit pixel of the column, FAR + 1 where there is none within FAR.

    Within strips of rows by windows; the last lit row of the strip above and the first of the one below, which are `tile` >= FAR rows
    high, stand for all that lies beyond.
    """
    places = r.groupBy(*PLACE).agg(F.max(F.when(F.col("v") != 0, F.col("y"))).alias("lit")).withColumn("strip", F.floor(F.col("y") / tile))
    own = Window.partitionBy("image_id", "x", "strip").orderBy("y")
    inside = places.withColumns({
        "up": F.max("lit").over(own), "down": F.min("lit").over(own.rowsBetween(0, Window.unboundedFollowing)),
    })
    ends = places.groupBy("image_id", "x", "strip").agg(F.min("lit").alias("first"), F.max("lit").alias("last")).where("first IS NOT NULL")
    above = ends.select("image_id", "x", (F.col("strip") + 1).alias("strip"), F.col("last").alias("above"))
    below = ends.select("image_id", "x", (F.col("strip") - 1).alias("strip"), F.col("first").alias("below"))
    beside = above.join(below, ["image_id", "x", "strip"], "full")
    gap = F.least(F.col("y") - F.coalesce("up", "above"), F.coalesce("down", "below") - F.col("y"), F.lit(FAR + 1))
    return inside.join(beside, ["image_id", "x", "strip"], "left").select(*PLACE, gap.cast("int").alias("gap"))


def envelope(gap: np.ndarray) -> np.ndarray:
    """Least (x - x')^2 + gap(x')^2 along each row: the lower envelope of the row's parabolas, as far as FAR goes."""
    best = gap.astype(np.int64) ** 2
    own, k = best.copy(), 1
    while k < gap.shape[1] and k <= FAR and k * k < best.max():
        best[:, k:] = np.minimum(best[:, k:], own[:, :-k] + k * k)
        best[:, :-k] = np.minimum(best[:, :-k], own[:, k:] + k * k)
        k += 1
    return best


def nearest(r: DataFrame, tile: int = TILE, rows: int = 32) -> DataFrame:
    """Distance of each pixel to the nearest one that is not 0 (in any band), clamped to 255 and truncated.

    Two passes: gaps along columns in strips of `tile` rows, then the lower envelope along the rows, some `rows` of an image a task.
    """
    if tile < FAR:
        raise ValueError(f"strips have {FAR} rows at least")

    def run(table):
        import pyarrow as pa

        x, y = (table.column(c).to_numpy().astype(np.int64) for c in ("x", "y"))
        y0 = y.min()
        gap = np.full((y.max() - y0 + 1, x.max() + 1), FAR + 1, np.int64)
        gap[y - y0, x] = table.column("gap").to_numpy()
        far = np.floor(np.minimum(np.sqrt(envelope(gap).astype(np.float64)), FAR))
        return pa.table({"image_id": table.column("image_id"), "x": table.column("x"), "y": table.column("y"), "band": pa.array(np.zeros(len(x), np.int32)), "v": pa.array(far[y - y0, x])})

    dealt = _vertical(r, tile).withColumn("some", F.floor(F.col("y") / rows))
    return dealt.groupBy("image_id", "some").applyInArrow(run, "image_id int, x int, y int, band int, v double")
