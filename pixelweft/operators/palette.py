"""Quantising to few colours: an octree kept as a table of bit prefixes, shares of equal population, and given palettes.

All work is on the distinct colours of an image (2^24 at most), which are counted before anything else, and joined back to the pixels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.sqlop import operator, pel, unpel

#: Rows times this plus column: places in the order of scanning.
ROW = 1 << 32


def _coloured(r: str, bands: int) -> str:
    """Subquery of pels with whole numbers r, g, b; with a fourth band only those that are not wholly transparent."""
    alpha = ", v3" if bands == 4 else ""
    return f"(SELECT image_id, x, y, CAST(v0 AS INT) AS r, CAST(v1 AS INT) AS g, CAST(v2 AS INT) AS b{alpha} FROM {pel(r, bands)} p {'WHERE v3 > 0' if bands == 4 else ''})"


def _repainted(r: str, bands: int, mapped: str, keep: bool = False) -> str:
    """The raster with the colours of mapped(image_id, r, g, b, nr, ng, nb); alpha stays. What has none is 0, or stays with `keep`."""
    values = [f"coalesce(m.n{c}, {f'p.v{k}' if keep else '0e0'})" for k, c in enumerate("rgb")] + (["p.v3"] if bands == 4 else [])
    pels = (f"(SELECT p.image_id, p.x, p.y, {', '.join(f'{v} AS q{k}' for k, v in enumerate(values))} FROM {pel(r, bands)} p "
            f"LEFT JOIN {mapped} m ON m.image_id = p.image_id AND m.r = CAST(p.v0 AS INT) AND m.g = CAST(p.v1 AS INT) AND m.b = CAST(p.v2 AS INT)"
            f"{' AND p.v3 > 0' if bands == 4 and not keep else ''})")
    return unpel(pels, [f"q{k}" for k in range(len(values))])


@operator(1)
def quantize(d, r, colors: int = 16, bands: int = 3):
    """Each image of 8 bits in at most `colors` colours by an octree over the colours; a fourth band is alpha, kept as it is.

    A node is a prefix of the bits of the three bands; it is an entry of the tree's table with its pixels, their sums and its first
    pixel. Folding all nodes of a depth leaves as many colours as that depth has nodes, so the depth where folding ends is the
    greatest with no more than `colors`. Of its nodes those are folded whose last child came last, one by one until few enough
    colours are left. A colour becomes the truncated mean of its folded ancestor, or of its ancestor one bit deeper. Wholly
    transparent pixels do not count and become 0.
    """
    def prefix(bits):
        return ", ".join(f"{d.shift_right(f'c.{c}', bits)} AS {c}" for c in "rgb")

    def up(alias, bits):
        return " AND ".join(f"{alias}.{c} = {d.shift_right(f'c.{c}', bits)}" for c in "rgb")

    low, high = "(8 - k.depth)", "greatest(7 - k.depth, 0)"
    return f"""WITH px AS (SELECT * FROM {_coloured(r, bands)} p),
colours AS (
  SELECT image_id, r, g, b, count(*) AS n, min(CAST(y AS BIGINT) * {ROW} + x) AS first FROM px GROUP BY image_id, r, g, b
), tree AS (
  SELECT image_id, depth, r, g, b, sum(n) AS n, sum(sr) AS sr, sum(sg) AS sg, sum(sb) AS sb, min(first) AS first
  FROM (SELECT c.image_id, k.depth, {prefix(low)}, c.n, c.n * c.r AS sr, c.n * c.g AS sg, c.n * c.b AS sb, c.first FROM colours c CROSS JOIN {d.series(0, 9, 'depth')} k) e
  GROUP BY image_id, depth, r, g, b
), sizes AS (SELECT image_id, depth, count(*) AS many FROM tree GROUP BY image_id, depth),
cut AS (
  SELECT k.image_id, k.depth, s.many FROM (SELECT image_id, max(depth) AS depth FROM sizes WHERE many <= {colors} GROUP BY image_id) k
  LEFT JOIN sizes s ON s.image_id = k.image_id AND s.depth = k.depth + 1
), parents AS (
  SELECT c.image_id, k.many, {prefix(1)}, max(c.first) AS latest, count(*) - 1 AS fewer
  FROM tree c JOIN cut k ON k.image_id = c.image_id AND c.depth = k.depth + 1 GROUP BY c.image_id, k.many, {', '.join(d.shift_right(f'c.{c}', 1) for c in 'rgb')}
), folded AS (
  SELECT image_id, r, g, b FROM (
    SELECT image_id, r, g, b, many - coalesce(sum(fewer) OVER (PARTITION BY image_id ORDER BY latest DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS still FROM parents) t
  WHERE still > {colors}
), placed AS (
  SELECT c.image_id, c.r, c.g, c.b, CASE WHEN f.image_id IS NULL THEN least(k.depth + 1, 8) ELSE k.depth END AS depth
  FROM colours c JOIN cut k ON k.image_id = c.image_id LEFT JOIN folded f ON f.image_id = c.image_id AND {up('f', low)}
), mapped AS (
  SELECT c.image_id, c.r, c.g, c.b, floor(t.sr / (t.n * 1e0)) AS nr, floor(t.sg / (t.n * 1e0)) AS ng, floor(t.sb / (t.n * 1e0)) AS nb
  FROM placed c JOIN tree t ON t.image_id = c.image_id AND t.depth = c.depth AND {up('t', '(8 - c.depth)')}
)
{_repainted(r, bands, 'mapped')}"""


def web_safe() -> list[tuple[int, int, int]]:
    """The cube of six levels a band."""
    return [(51 * i, 51 * j, 51 * k) for i in range(6) for j in range(6) for k in range(6)]


@operator(1)
def quantize_palette(d, r, palette=None, bands: int = 3):
    """Each colour becomes the nearest of a palette of at most 256 (squared distance; ties: the earlier); a fourth band is kept."""
    palette = web_safe() if palette is None else list(palette)
    if not 0 < len(palette) <= 256:
        raise ValueError("a palette has 1 to 256 colours")
    rows = ", ".join(f"({i}, {', '.join(str(int(v)) for v in c)})" for i, c in enumerate(palette))
    far = " + ".join(f"(c.{c} - q.p{c}) * (c.{c} - q.p{c})" for c in "rgb")
    entries = f"(VALUES {rows}) AS q(i, pr, pg, pb)"
    colours = f"(SELECT DISTINCT image_id, CAST(v0 AS INT) AS r, CAST(v1 AS INT) AS g, CAST(v2 AS INT) AS b FROM {pel(r, bands)} p)"
    best = f"(SELECT c.image_id, c.r, c.g, c.b, min(({far}) * 256 + q.i) % 256 AS i FROM {colours} c CROSS JOIN {entries} GROUP BY c.image_id, c.r, c.g, c.b)"
    mapped = f"(SELECT c.image_id, c.r, c.g, c.b, {', '.join(f'CAST(q.p{c} AS DOUBLE) AS n{c}' for c in 'rgb')} FROM {best} c JOIN {entries} ON q.i = c.i)"
    return _repainted(r, bands, mapped, keep=True)


def quantize_grey(r: DataFrame, colors: int = 16) -> DataFrame:
    """One-band images of 8 bits in at most `colors` greys: the histogram is cut where a share of equal population is full.

    A grey is the truncated mean of its part; a pixel takes the nearest grey, the darker one at a tie. The histogram of an image,
    256 entries at most, is folded in order in one expression.
    """
    bins = r.groupBy("image_id", F.col("v").cast("int").alias("bin")).agg(F.count("*").alias("n"))
    whole = bins.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias("total"))
    state = "named_struct('full', array_repeat(0L, 0), 'sum', 0L, 'n', 0L)"
    # What a part still lacks is decided before the entry that fills it is added.
    fills = f"acc.n + e.n >= greatest(total div {colors}, 1L) AND size(acc.full) < {colors - 1}"
    step = (f"named_struct('full', CASE WHEN {fills} THEN array_append(acc.full, (acc.sum + e.bin * e.n) div (acc.n + e.n)) ELSE acc.full END, "
            f"'sum', CASE WHEN {fills} THEN 0L ELSE acc.sum + e.bin * e.n END, 'n', CASE WHEN {fills} THEN 0L ELSE acc.n + e.n END)")
    last = f"CASE WHEN acc.n > 0 AND size(acc.full) < {colors} THEN array_append(acc.full, acc.sum div acc.n) ELSE acc.full END"
    greys = whole.select("image_id", F.expr(f"aggregate(bins, {state}, (acc, e) -> {step}, acc -> {last})").alias("greys"))
    nearest = F.expr("array_min(transform(greys, g -> struct(abs(g - bin) AS far, g AS grey))).grey")
    mapped = bins.join(greys, "image_id").select("image_id", "bin", nearest.cast("double").alias("grey"))
    return (r.withColumn("bin", F.col("v").cast("int")).join(mapped, ["image_id", "bin"])
            .select("image_id", "x", "y", "band", F.col("grey").alias("v")))
