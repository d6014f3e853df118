"""Image pyramids: levels by repeated halving, cut in tiles that overlap their neighbours, and encoded as the files of a viewer.

Each image has as many levels as halvings bring its longer side to 1; a level is made of the one above it and staged. A pixel goes to
each tile that holds it, which is its own and, at a border, its neighbours'; a task encodes one tile at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.sqlop import KEY, operator, size_of
from ..plans.staged import checkpointed
from . import geometry


@operator(1)
def halved(d, r):
    """Images of more than one pixel at half their size, odd sides rounded up, by linear resampling; those of one pixel are left out."""
    larger = f"(SELECT r.{KEY.replace(', ', ', r.')}, r.v FROM {r} r JOIN {size_of(r)} z ON z.image_id = r.image_id WHERE greatest(z.w, z.h) > 1)"
    half = lambda n: f"(floor(({n} + 1) / 2e0) / ({n} * 1e0))"
    return geometry._resized(d, larger, half("w"), half("h"), "linear")


def levels(r: DataFrame) -> DataFrame:
    """Pixels (level, image_id, x, y, band, v) of all levels; level 0 is of one pixel, the last one the image itself."""
    made, now = [], checkpointed(r.select("image_id", "x", "y", "band", "v"))
    while not now.isEmpty():
        made.append(now)
        now = checkpointed(halved(now))
    if not made:
        return r.select(F.lit(0).alias("level"), "image_id", "x", "y", "band", "v").limit(0)
    # Images are of different depths: a step counts from the image, a level from its smallest copy.
    steps = [m.select(F.lit(k).alias("step"), "image_id", "x", "y", "band", "v") for k, m in enumerate(made)]
    every = steps[0]
    for s in steps[1:]:
        every = every.unionByName(s)
    depth = every.groupBy("image_id").agg(F.max("step").alias("depth"))
    return every.join(depth, "image_id").select((F.col("depth") - F.col("step")).alias("level"), "image_id", "x", "y", "band", "v")


@operator(1)
def tiled(d, pixels, tile: int = 256, overlap: int = 1):
    """(image_id, level, col, row, x, y, band, v): every pixel in the tiles that hold it, x and y from the tile's corner.

    A tile reaches `overlap` pixels into its neighbours on all sides where there are any.
    """
    sizes = f"(SELECT image_id, level, max(x) + 1 AS w, max(y) + 1 AS h FROM {pixels} GROUP BY image_id, level)"
    first = lambda c: f"greatest(0, CAST(floor(({c} - {overlap}) / {tile}e0) AS INT))"
    last = lambda c, n: f"least(CAST(floor(({n} - 1) / {tile}e0) AS INT), CAST(floor(({c} + {overlap}) / {tile}e0) AS INT))"
    placed = (f"(SELECT p.image_id, p.level, p.x, p.y, p.band, p.v, {first('p.x')} AS c0, {last('p.x', 's.w')} - {first('p.x')} + 1 AS nc, {first('p.y')} AS r0, {last('p.y', 's.h')} - {first('p.y')} + 1 AS nr "
              f"FROM {pixels} p JOIN {sizes} s ON s.image_id = p.image_id AND s.level = p.level)")
    rows = d.expand(d.expand(placed, "nc", "i"), "nr", "j")
    corner = lambda c: f"({c} * {tile} - CASE WHEN {c} > 0 THEN {overlap} ELSE 0 END)"
    return (f"SELECT image_id, level, c0 + i AS col, r0 + j AS row, x - {corner('(c0 + i)')} AS x, y - {corner('(r0 + j)')} AS y, band, v FROM {rows} e "
            f"WHERE x >= {corner('(c0 + i)')} AND y >= {corner('(r0 + j)')} AND x < (c0 + i + 1) * {tile} + {overlap} AND y < (r0 + j + 1) * {tile} + {overlap}")


#: By layout: the name of a tile below the image's own, of the columns of its row.
NAMES = {
    "dz": "concat('_files/', level, '/', col, '_', row, ext)", "google": "concat('/', level, '/', col, '/', row, ext)",
    "zoomify": "concat('/TileGroup', number div 256, '/', level, '-', col, '-', row, ext)",
    "iiif": "concat('/', x0, ',', y0, ',', least(tile * factor, full_w - x0), ',', least(tile * factor, full_h - y0), '/', wide, ',/0/default', ext)",
}


def descriptors(sizes: DataFrame, tile: int, overlap: int, format: str, layout: str) -> DataFrame:
    """(image_id, name, content) of the text file that describes each image of sizes(image_id, full_w, full_h, tiles, levels); none for google."""
    if layout == "dz":
        text = F.format_string(f'<?xml version="1.0" encoding="UTF-8"?>\n<Image TileSize="{tile}" Overlap="{overlap}" Format="{format}" xmlns="http://schemas.microsoft.com/deepzoom/2008">\n'
                               '  <Size Width="%d" Height="%d"/>\n</Image>\n', "full_w", "full_h")
        name = ".dzi"
    elif layout == "zoomify":
        text = F.format_string(f'<IMAGE_PROPERTIES WIDTH="%d" HEIGHT="%d" NUMTILES="%d" NUMIMAGES="1" VERSION="1.8" TILESIZE="{tile}"/>\n', "full_w", "full_h", "tiles")
        name = "/ImageProperties.xml"
    elif layout == "iiif":
        factors = F.array_join(F.transform(F.sequence(F.col("levels") - 1, F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftleft", F.lit(1), k.cast("int")).cast("string")), ",")
        text = F.concat(F.format_string('{\n  "@context": "http://iiif.io/api/image/2/context.json",\n  "@id": "",\n  "protocol": "http://iiif.io/api/image",\n  "width": %d,\n  "height": %d,\n'
                                        f'  "tiles": [\n    {{ "width": {tile}, "scaleFactors": [', "full_w", "full_h"), factors, F.lit('] }\n  ],\n  "profile": ["http://iiif.io/api/image/2/level0.json"]\n}\n'))
        name = "/info.json"
    else:
        return sizes.select("image_id", F.lit("").alias("name"), F.lit("").cast("binary").alias("content")).limit(0)
    return sizes.select("image_id", F.concat("base", F.lit(name)).alias("name"), F.encode(text, "UTF-8").alias("content"))


def deep_zoom(r: DataFrame, tile: int = 256, overlap: int = 1, format: str = "png", layout: str = "dz", base: str = "image") -> DataFrame:
    """(image_id, name, content): the files of the images' pyramids, tiles and descriptors, below `base` and the image's number.

    Layouts other than dz have no overlap. The rows are a table like any other: written with overwrite and Spark's commit, so a
    rerun leaves no tile of an earlier one.
    """
    from ..sources.codecs import ENCODERS
    from .arrays import to_array

    if tile <= 0 or overlap < 0 or layout not in NAMES or format not in ("png", "jpeg"):
        raise ValueError("tiles are larger than 0, overlaps no less than 0, layouts dz, google, zoomify or iiif, formats png or jpeg")
    overlap = overlap if layout == "dz" else 0
    pixels = checkpointed(levels(r))
    encoder, ext = ENCODERS[format], {"png": "png", "jpeg": "jpg"}[format]

    def write(table):
        import pyarrow as pa

        _, a = to_array(table)
        return pa.table({**{c: table.column(c).slice(0, 1) for c in ("image_id", "level", "col", "row")}, "wide": pa.array([a.shape[1]], pa.int32()), "content": pa.array([encoder(a)], pa.binary())})

    cells = tiled(pixels, tile=tile, overlap=overlap).selectExpr("CAST(image_id AS INT) AS image_id", "CAST(level AS INT) AS level", "CAST(col AS INT) AS col", "CAST(row AS INT) AS row", "CAST(x AS INT) AS x", "CAST(y AS INT) AS y", "CAST(band AS INT) AS band", "v")
    files = checkpointed(cells.groupBy("image_id", "level", "col", "row").applyInArrow(write, "image_id int, level int, col int, row int, wide int, content binary"))
    sizes = (pixels.groupBy("image_id", "level").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h")).withColumns({"nc": F.ceil(F.col("w") / tile), "nr": F.ceil(F.col("h") / tile)}))
    whole = sizes.groupBy("image_id").agg(F.max_by("w", "level").alias("full_w"), F.max_by("h", "level").alias("full_h"), F.sum(F.col("nc") * F.col("nr")).alias("tiles"), (F.max("level") + 1).alias("levels"))
    whole = whole.withColumn("base", F.concat(F.lit(base), "image_id"))
    # Tiles are numbered level by level, row by row: those of the levels before come first.
    own, before = sizes.alias("o"), sizes.alias("b")
    starts = (own.join(before, (F.col("o.image_id") == F.col("b.image_id")) & (F.col("b.level") < F.col("o.level")), "left")
              .groupBy("o.image_id", "o.level", F.col("o.nc").alias("nc")).agg(F.coalesce(F.sum(F.expr("b.nc * b.nr")), F.lit(0)).alias("start")))
    named = (files.join(starts, ["image_id", "level"]).join(whole, "image_id")
             .withColumns({"number": F.col("start") + F.col("row") * F.col("nc") + F.col("col"), "factor": F.expr("shiftleft(1, CAST(levels - 1 - level AS INT))"), "tile": F.lit(tile), "ext": F.lit("." + ext)})
             .withColumns({"x0": F.expr("col * tile * factor"), "y0": F.expr("row * tile * factor")}))
    return named.select("image_id", F.concat("base", F.expr(NAMES[layout])).alias("name"), "content").unionByName(descriptors(whole, tile, overlap, ext, layout))
