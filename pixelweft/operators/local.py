"""Equalisation within tiles and edges with hysteresis, as plans of windows, counts and joins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.sqlop import KEY, operator, sized
from ..plans.staged import checkpointed
from . import regions
from .stencil import _column, _row, along, nine, passed


@operator(1)
def hist_local(d, r, tiles: int = 8, clip: float = 3.0):
    """Contrast-limited equalisation: a clipped look-up table per tile and band, between tiles the four nearest blended.

    What is clipped goes to all bins alike, the rest of that division to the first ones. A tile's table is an array of 256
    entries, one for each of tiles x tiles places of an image and band. Where an image is narrower than the tiles are many, a
    tile without pixels leaves values as they are.
    """
    px = f"""(SELECT image_id, x, y, band, v, {', '.join(f'{d.div(f"({c} + 1) * {tiles} - 1", f"{s} * 1e0")} AS t{c}' for c, s in (('x', 'w'), ('y', 'h')))} FROM {sized(r)} s)"""
    top = f"greatest(1e0, floor({d.num(clip)} * pixels / 256e0))"
    corners = {n: f"LEFT JOIN luts {n} ON {n}.image_id = p.image_id AND {n}.band = p.band AND {n}.ty = p.{cy} AND {n}.tx = p.{cx}"
               for n, cy, cx in (("a", "y0", "x0"), ("b", "y0", "x1"), ("c", "y1", "x0"), ("e", "y1", "x1"))}
    pixels, at = d.looked_up("near", corners, {n: f"coalesce({d.item(f'{n}.lut', 'p.v')}, p.v)" for n in corners})
    blend = f"round(({at['a']} * (1 - p.fx) + {at['b']} * p.fx) * (1 - p.fy) + ({at['c']} * (1 - p.fx) + {at['e']} * p.fx) * p.fy, 9)"
    places = ", ".join(f"{c} * {tiles} / ({s} * 1e0) - 5e-1 AS f{c}" for c, s in (("x", "w"), ("y", "h")))
    kept = ", ".join(f"greatest(0, least({tiles - 1}, floor(f{c}) + {k})) AS {c}{k}" for c in "xy" for k in (0, 1))
    return f"""WITH px AS {px},
counts AS (SELECT image_id, band, ty, tx, CAST(v AS INT) AS bin, count(*) AS n FROM px GROUP BY image_id, band, ty, tx, CAST(v AS INT)),
sums AS (SELECT image_id, band, ty, tx, sum(n) AS pixels FROM counts GROUP BY image_id, band, ty, tx),
spare AS (
  SELECT s.image_id, s.band, s.ty, s.tx, s.pixels, {top} AS most, sum(greatest(c.n - {top}, 0)) AS excess
  FROM sums s JOIN counts c ON c.image_id = s.image_id AND c.band = s.band AND c.ty = s.ty AND c.tx = s.tx GROUP BY s.image_id, s.band, s.ty, s.tx, s.pixels
), bins AS (
  SELECT s.image_id, s.band, s.ty, s.tx, s.pixels, k.bin, least(coalesce(c.n, 0), s.most) + floor(s.excess / 256e0) + CASE WHEN k.bin < s.excess - 256 * floor(s.excess / 256e0) THEN 1 ELSE 0 END AS n
  FROM spare s CROSS JOIN {d.series(0, 256, 'bin')} k LEFT JOIN counts c ON c.image_id = s.image_id AND c.band = s.band AND c.ty = s.ty AND c.tx = s.tx AND c.bin = k.bin
), summed AS (
  SELECT image_id, band, ty, tx, greatest(0e0, least(255e0, floor(sum(n) OVER (PARTITION BY image_id, band, ty, tx ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 255 / pixels))) AS val FROM bins
), luts AS (SELECT image_id, band, ty, tx, {d.sorted_list('val')} AS lut FROM summed GROUP BY image_id, band, ty, tx),
places AS (SELECT {KEY}, v, {places} FROM {sized(r)} s),
near AS (SELECT {KEY}, v, fx - floor(fx) AS fx, fy - floor(fy) AS fy, {kept} FROM places)
SELECT p.image_id, p.x, p.y, p.band, floor(greatest(0e0, least(255e0, {blend}))) AS v FROM {pixels}"""


def _smooth(d, r: str, sigma: float, vertical: bool) -> str:
    """A Gaussian of radius ceil(3 sigma) along one axis in real values, edges repeated."""
    radius = max(1, math.ceil(sigma * 3))
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    over = along(d, vertical)
    first, last = d.end("v", over), d.end("v", over, last=True)
    terms = []
    for k, w in zip(range(-radius, radius + 1), kernel):
        at = "v" if k == 0 else f"coalesce({'lag' if k < 0 else 'lead'}(v, {abs(k)}) OVER {over()}, {first if k < 0 else last})"
        terms.append(f"{at} * {d.num(w / sum(kernel))}")
    return passed(d, r, radius, f"{' + '.join(terms)} AS v", vertical)


#: By sector of the gradient's angle: the two neighbours that it is compared with. Fixed values.
ACROSS = (("w", "e"), ("ne", "sw"), ("n", "s"), ("nw", "se"))


@operator(1)
def thinned(d, r, sigma: float = 1.4):
    """Gradient magnitudes of a smoothed one-band image where they are no less than those of both neighbours across; 0 elsewhere and at the edges."""
    blurred = f"{_smooth(d, _smooth(d, r, sigma, False) + ' h', sigma, True)} b"
    gx = "(p02 - p00) + 2 * (p12 - p10) + (p22 - p20)"
    gy = "(p20 - p00) + 2 * (p21 - p01) + (p22 - p02)"
    slopes = f"(SELECT {KEY}, round({gx}, 9) AS gx, round({gy}, 9) AS gy FROM {nine(d, blurred)} n)"
    # Angles from 0 to 180 degrees, parted at 22.5, 67.5, 112.5 and 157.5; a gradient of 0 is in the first sector.
    angle = "round(CASE WHEN gy < 0 THEN degrees(atan2(gy, gx)) + 180 ELSE degrees(atan2(gy, gx)) END, 9)"
    sizes = f"(SELECT {KEY}, round(sqrt(gx * gx + gy * gy), 9) AS v, {angle} AS angle FROM {slopes} g)"
    sector = "CASE WHEN angle < 225e-1 THEN 0 WHEN angle < 675e-1 THEN 1 WHEN angle < 1125e-1 THEN 2 WHEN angle < 1575e-1 THEN 3 ELSE 0 END"
    across = f"(SELECT {KEY}, v, {sector} AS sector, lag(v) OVER {_row()} AS w, lead(v) OVER {_row()} AS e FROM {sizes} z)"
    beside = ", ".join(f"{f}({c}) OVER {_column()} AS {name}" for f, c, name in (
        ("lag", "w", "nw"), ("lag", "v", "n"), ("lag", "e", "ne"), ("lead", "w", "sw"), ("lead", "v", "s"), ("lead", "e", "se")))
    tops = " ".join(f"WHEN {k} THEN v >= {a} AND v >= {b}" for k, (a, b) in enumerate(ACROSS))
    return (f"SELECT {KEY}, CASE WHEN nw IS NOT NULL AND se IS NOT NULL AND CASE sector {tops} END THEN v ELSE 0e0 END AS v "
            f"FROM (SELECT {KEY}, v, sector, w, e, {beside} FROM {across} a) c")


def canny(r: DataFrame, sigma: float = 1.4, low: int = 20, high: int = 60, tile: int = regions.TILE) -> DataFrame:
    """255 at the edges of one-band images: thinned gradients of `high` or more, and those of `low` or more that are 8-connected with them; else 0."""
    thin = checkpointed(thinned(r, sigma=sigma))
    weak = thin.where(F.col("v") >= low).select(*regions.PLACE, "v")
    found = regions.regions(weak.select(*regions.PLACE), diagonal=True, tile=tile).join(weak, list(regions.PLACE))
    strong = found.where(F.col("v") >= high).select("image_id", "root").distinct()
    edges = found.join(strong, ["image_id", "root"]).select(*regions.PLACE, F.lit(255.0).alias("edge"))
    return thin.join(edges, list(regions.PLACE), "left").select(*regions.PLACE, "band", F.coalesce("edge", F.lit(0.0)).alias("v"))
