"""SQL for the queries of whole-image operators, written apart from these: sums over frequencies, nearest places and reachability."""

from __future__ import annotations

from ..operators.clipping import KEEP, boundary
from ..operators.colour import to_cmyk
from ..operators.local import thinned
from ..operators.pyramid import halved
from ..sources import icc
from ..sources.rasters import raster_sql
from .sqlop import DUCKDB

#: Places that results of transforms are rounded to; sums in another order differ from the tenth on, and at two there are ties (sums of whole numbers over 80).
PLACES = 4

_SIZED = f"""px AS MATERIALIZED (SELECT * FROM {raster_sql('stack')}),
size AS MATERIALIZED (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM px GROUP BY image_id)"""
_MASK = f"""px AS MATERIALIZED (SELECT image_id, x, y, band, CASE WHEN v >= 150 THEN 255 ELSE 0 END AS v FROM {raster_sql('stack')})"""


def _turn(k: str, n: str, size: str) -> str:
    return f"2 * pi() * (({k} * {n}) % {size}) / {size}"


_TRANSFORM = f"""{_SIZED},
along AS MATERIALIZED (
  SELECT p.image_id, u.u, p.y, p.band, sum(p.v * cos({_turn('u.u', 'p.x', 's.w')})) AS re, -sum(p.v * sin({_turn('u.u', 'p.x', 's.w')})) AS im
  FROM px p JOIN size s ON s.image_id = p.image_id JOIN (SELECT image_id, unnest(range(w)) AS u FROM size) u ON u.image_id = p.image_id GROUP BY ALL
), f AS MATERIALIZED (
  SELECT a.image_id, a.u AS x, v.v AS y, a.band,
    sum(a.re * cos({_turn('v.v', 'a.y', 's.h')}) + a.im * sin({_turn('v.v', 'a.y', 's.h')})) / sqrt(max(s.w * s.h)) AS re,
    sum(a.im * cos({_turn('v.v', 'a.y', 's.h')}) - a.re * sin({_turn('v.v', 'a.y', 's.h')})) / sqrt(max(s.w * s.h)) AS im
  FROM along a JOIN size s ON s.image_id = a.image_id JOIN (SELECT image_id, unnest(range(h)) AS v FROM size) v ON v.image_id = a.image_id GROUP BY ALL
)"""

_PLACE = "CAST(image_id AS BIGINT) AS image_id, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(band AS BIGINT) AS band"

SQL = {
    "fw_fft": f"WITH {_TRANSFORM} SELECT {_PLACE}, round(re, {PLACES}) + 0e0 AS re, round(im, {PLACES}) + 0e0 AS im FROM f",
    # The inverse of the transform is what was transformed.
    "inv_fft": f"WITH {_SIZED} SELECT {_PLACE}, CAST(v AS DOUBLE) AS v FROM px",
    "spectrum": f"""WITH {_TRANSFORM}, m AS (SELECT *, ln(1 + sqrt(re * re + im * im)) AS m FROM f)
SELECT CAST(m.image_id AS BIGINT) AS image_id, CAST((m.x + s.w // 2) % s.w AS BIGINT) AS x, CAST((m.y + s.h // 2) % s.h AS BIGINT) AS y, CAST(m.band AS BIGINT) AS band,
  floor(round(m / max(m) OVER (PARTITION BY m.image_id, m.band) * 255, 9)) AS v FROM m JOIN size s ON s.image_id = m.image_id""",
    "nearest": f"""WITH {_MASK}, lit AS MATERIALIZED (SELECT image_id, x, y FROM px WHERE v <> 0)
SELECT CAST(p.image_id AS BIGINT) AS image_id, CAST(p.x AS BIGINT) AS x, CAST(p.y AS BIGINT) AS y, CAST(p.band AS BIGINT) AS band,
  floor(least(255e0, sqrt(min((p.x - o.x) * (p.x - o.x) + (p.y - o.y) * (p.y - o.y))))) AS v FROM px p JOIN lit o ON o.image_id = p.image_id GROUP BY ALL""",
    "label_regions": f"""WITH RECURSIVE {_MASK}, lit AS MATERIALIZED (SELECT image_id, x, y FROM px WHERE v <> 0),
reach AS (
  SELECT image_id, x, y, x AS sx, y AS sy FROM lit
  UNION SELECT o.image_id, o.x, o.y, r.sx, r.sy FROM reach r JOIN (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) AS s(dx, dy) ON true JOIN lit o ON o.image_id = r.image_id AND o.x = r.x + s.dx AND o.y = r.y + s.dy
), first AS (SELECT image_id, x, y, min(sy * 100000 + sx) AS f FROM reach GROUP BY ALL),
named AS (SELECT image_id, x, y, dense_rank() OVER (PARTITION BY image_id ORDER BY f) AS k FROM first)
SELECT CAST(p.image_id AS BIGINT) AS image_id, CAST(p.x AS BIGINT) AS x, CAST(p.y AS BIGINT) AS y, CAST(p.band AS BIGINT) AS band, CAST(coalesce(n.k, 0) AS DOUBLE) AS v
FROM px p LEFT JOIN named n ON n.image_id = p.image_id AND n.x = p.x AND n.y = p.y""",
    "draw_flood": f"""WITH RECURSIVE {_MASK}, same AS MATERIALIZED (
  SELECT p.image_id, p.x, p.y FROM px p JOIN px q ON q.image_id = p.image_id AND q.x = 5 AND q.y = 5 WHERE p.v = q.v
), reach AS (
  SELECT image_id, x, y FROM same WHERE x = 5 AND y = 5
  UNION SELECT o.image_id, o.x, o.y FROM reach r JOIN (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) AS s(dx, dy) ON true JOIN same o ON o.image_id = r.image_id AND o.x = r.x + s.dx AND o.y = r.y + s.dy
)
SELECT CAST(p.image_id AS BIGINT) AS image_id, CAST(p.x AS BIGINT) AS x, CAST(p.y AS BIGINT) AS y, CAST(p.band AS BIGINT) AS band, CASE WHEN r.x IS NOT NULL THEN 99e0 ELSE CAST(p.v AS DOUBLE) END AS v
FROM px p LEFT JOIN reach r ON r.image_id = p.image_id AND r.x = p.x AND r.y = p.y""",
    # The thinned gradients are the operator's own plan; what is reached from the strong ones is found step by step.
    "canny": f"""WITH RECURSIVE thin AS MATERIALIZED ({thinned.sql(raster_sql('grey'))}), weak AS MATERIALIZED (SELECT image_id, x, y, v FROM thin WHERE v >= 20),
reach AS (
  SELECT image_id, x, y FROM weak WHERE v >= 60
  UNION SELECT o.image_id, o.x, o.y FROM reach r JOIN (SELECT unnest([-1, 0, 1]) AS dx) a ON true JOIN (SELECT unnest([-1, 0, 1]) AS dy) b ON true JOIN weak o ON o.image_id = r.image_id AND o.x = r.x + dx AND o.y = r.y + dy
)
SELECT CAST(t.image_id AS BIGINT) AS image_id, CAST(t.x AS BIGINT) AS x, CAST(t.y AS BIGINT) AS y, CAST(t.band AS BIGINT) AS band, CASE WHEN r.x IS NOT NULL THEN 255e0 ELSE 0e0 END AS v
FROM thin t LEFT JOIN reach r ON r.image_id = t.image_id AND r.x = t.x AND r.y = t.y""",
    # The histogram is walked bin by bin: what the open part has, and the parts that are full.
    "quantize_grey": f"""WITH RECURSIVE px AS MATERIALIZED (SELECT * FROM {raster_sql('grey')}),
bins AS MATERIALIZED (SELECT image_id, CAST(v AS BIGINT) AS bin, count(*) AS n, row_number() OVER (PARTITION BY image_id ORDER BY v) AS k, count(*) OVER (PARTITION BY image_id) AS last FROM px GROUP BY image_id, v),
target AS (SELECT image_id, greatest(1, CAST(sum(n) AS BIGINT) // 12) AS t FROM bins GROUP BY image_id),
walk AS (
  SELECT image_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS m, CAST(0 AS BIGINT) AS made, CAST(NULL AS BIGINT) AS grey FROM target
  UNION ALL
  SELECT w.image_id, b.k, CASE WHEN full_ THEN 0 ELSE w.s + b.bin * b.n END, CASE WHEN full_ THEN 0 ELSE w.m + b.n END, w.made + CASE WHEN full_ THEN 1 ELSE 0 END,
    CASE WHEN full_ OR b.k = b.last THEN (w.s + b.bin * b.n) // (w.m + b.n) END
  FROM (SELECT w.*, w.m + b.n >= t.t AND w.made < 11 AS full_ FROM walk w JOIN bins b ON b.image_id = w.image_id AND b.k = w.k + 1 JOIN target t ON t.image_id = w.image_id) w
  JOIN bins b ON b.image_id = w.image_id AND b.k = w.k + 1
), greys AS (SELECT image_id, grey FROM walk WHERE grey IS NOT NULL),
best AS (
  SELECT b.image_id, b.bin, g.grey FROM bins b JOIN greys g ON g.image_id = b.image_id
  QUALIFY row_number() OVER (PARTITION BY b.image_id, b.bin ORDER BY abs(g.grey - b.bin), g.grey) = 1
)
SELECT CAST(p.image_id AS BIGINT) AS image_id, CAST(p.x AS BIGINT) AS x, CAST(p.y AS BIGINT) AS y, CAST(p.band AS BIGINT) AS band, CAST(b.grey AS DOUBLE) AS v
FROM px p JOIN best b ON b.image_id = p.image_id AND b.bin = p.v""",
    # Triangles of a simple polygon are two fewer than its vertices, and cover it.
    "path_triangles": f"""WITH p AS (SELECT path_id, seq, x, y, lead(x) OVER w AS x1, lead(y) OVER w AS y1, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy FROM {raster_sql('stars')} WINDOW w AS (PARTITION BY path_id ORDER BY seq))
SELECT path_id, count(*) - 2 AS triangles, round(abs(sum(x * coalesce(y1, fy) - coalesce(x1, fx) * y)) / 2, 6) AS area FROM p GROUP BY path_id""",
    # A place is in a polygon by the parity of the edges to its right.
    "points_in_triangles": f"""WITH p AS (SELECT path_id, x, y, lead(x) OVER w AS x1, lead(y) OVER w AS y1, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy FROM {raster_sql('stars')} WINDOW w AS (PARTITION BY path_id ORDER BY seq)),
e AS (SELECT path_id, x AS x0, y AS y0, coalesce(x1, fx) AS x1, coalesce(y1, fy) AS y1 FROM p),
g AS (SELECT a.range * 8 + CAST(0.37123 AS DOUBLE) AS x, b.range * 8 + CAST(0.61877 AS DOUBLE) AS y FROM range(9) a, range(9) b),
inside AS (
  SELECT g.x, g.y, e.path_id FROM g JOIN e ON (e.y0 <= g.y) <> (e.y1 <= g.y) AND e.x0 + (g.y - e.y0) / (e.y1 - e.y0) * (e.x1 - e.x0) > g.x GROUP BY ALL HAVING count(*) % 2 = 1
) SELECT x, y, count(*) AS n FROM inside GROUP BY x, y""",
}


def _walk(op: str) -> str:
    """Rings of a boolean, walked from every piece until it comes round; the pieces are the operator's own plan."""
    stars = raster_sql("stars")
    moved = f"(SELECT path_id - 1 AS path_id, seq, x + 95e-1 AS x, y - 425e-2 AS y FROM {stars} WHERE path_id > 0)"
    parts = ((stars, moved, op),) if op != "xor" else ((stars, moved, "subtract"), (moved, stars, "subtract"))
    pieces = " UNION ALL ".join(f"SELECT {k} AS part, path_id, u, v, x0, y0 FROM ({boundary.sql(a, b, op=o)})" for k, (a, b, o) in enumerate(parts))
    return f"""WITH RECURSIVE e AS MATERIALIZED ({pieces}),
reach AS (SELECT part, path_id, u, u AS t FROM e UNION SELECT r.part, r.path_id, r.u, e.v FROM reach r JOIN e ON e.part = r.part AND e.path_id = r.path_id AND e.u = r.t),
heads AS MATERIALIZED (SELECT part, path_id, u, min(t) AS head FROM reach GROUP BY ALL),
walk AS (
  SELECT h.part, h.path_id, h.head, h.u, 0 AS seq FROM heads h WHERE h.u = h.head
  UNION ALL SELECT w.part, w.path_id, w.head, e.v, w.seq + 1 FROM walk w JOIN e ON e.part = w.part AND e.path_id = w.path_id AND e.u = w.u WHERE e.v <> w.head
)
SELECT CAST(w.path_id AS BIGINT) AS path_id, CAST(w.part AS BIGINT) AS part, CAST(w.head AS BIGINT) AS ring, CAST(w.seq AS BIGINT) AS seq, round(e.x0, 6) + 0e0 AS x, round(e.y0, 6) + 0e0 AS y
FROM walk w JOIN e ON e.part = w.part AND e.path_id = w.path_id AND e.u = w.u"""


SQL |= {f"path_{op}": _walk(op) for op in (*KEEP, "xor")}


def _tiles(tile: int = 40, overlap: int = 1, most: int = 20) -> str:
    """Tiles as rectangles that pixels are counted in; levels are the operator's own halvings, as many as `most`."""
    steps = [f"s0 AS MATERIALIZED (SELECT image_id, x, y, band, v FROM {raster_sql('rgb')})"] + [f"s{k} AS MATERIALIZED ({halved.sql(f's{k - 1}')})" for k in range(1, most)]
    every = " UNION ALL ".join(f"SELECT {k} AS step, image_id, x, y, band, v FROM s{k}" for k in range(most))
    return f"""WITH {', '.join(steps)}, p AS MATERIALIZED (SELECT *, max(step) OVER (PARTITION BY image_id) - step AS level FROM ({every})),
z AS (SELECT image_id, level, max(x) + 1 AS w, max(y) + 1 AS h FROM p GROUP BY ALL),
c AS (SELECT image_id, level, w, h, unnest(range((w + {tile - 1}) // {tile})) AS col FROM z),
t AS (SELECT *, unnest(range((h + {tile - 1}) // {tile})) AS "row" FROM c)
SELECT CAST(t.image_id AS BIGINT) AS image_id, CAST(t.level AS BIGINT) AS level, CAST(col AS BIGINT) AS col, CAST("row" AS BIGINT) AS "row", CAST(p.band AS BIGINT) AS band, count(*) AS pixels, CAST(sum(p.v) AS DOUBLE) AS total
FROM t JOIN p ON p.image_id = t.image_id AND p.level = t.level AND p.x BETWEEN col * {tile} - {overlap} AND col * {tile} + {tile + overlap - 1} AND p.y BETWEEN "row" * {tile} - {overlap} AND "row" * {tile} + {tile + overlap - 1}
GROUP BY ALL"""


SQL["deep_zoom_tiles"] = _tiles()


def _primaries() -> str:
    """The profiles' formulas written out; the code of a light is the nearest of all 256, the higher one at a tie."""
    import numpy as np

    one, two = icc.parse(icc.srgb()), icc.parse(icc.wide_gamut())
    num, m = DUCKDB.num, (np.linalg.inv(two.matrix()) @ one.matrix()).tolist()
    g, a, b, c, e = (round(v * 65536) / 65536 for v in (2.4, 1 / 1.055, 0.055 / 1.055, 1 / 12.92, 0.04045))
    light = lambda v: f"(CASE WHEN {v} / 255e0 < {num(e)} THEN {num(c)} * ({v} / 255e0) ELSE power({num(a)} * ({v} / 255e0) + {num(b)}, {num(g)}) END)"
    mixed = ", ".join(f"floor(round(greatest(0e0, least(1e0, {' + '.join(f'{num(m[i][j])} * l{j}' for j in range(3))})) * 4095, 9) + 0.5) / 4095e0 AS m{i}" for i in range(3))
    return f"""WITH p AS MATERIALIZED (SELECT image_id, x, y, max(v) FILTER (band = 0) AS v0, max(v) FILTER (band = 1) AS v1, max(v) FILTER (band = 2) AS v2 FROM {raster_sql('rgb')} GROUP BY ALL),
l AS (SELECT *, {', '.join(f'{light(f"v{j}")} AS l{j}' for j in range(3))} FROM p), m AS MATERIALIZED (SELECT *, {mixed} FROM l),
codes AS (SELECT range AS code, power(range / 255e0, 563 / 256e0) AS light FROM range(256)), steps AS (SELECT DISTINCT s FROM (SELECT m0 AS s FROM m UNION ALL SELECT m1 FROM m UNION ALL SELECT m2 FROM m)),
best AS MATERIALIZED (SELECT s, code FROM steps, codes QUALIFY row_number() OVER (PARTITION BY s ORDER BY abs(light - s), code DESC) = 1)
{' UNION ALL '.join(f'SELECT CAST(m.image_id AS BIGINT) AS image_id, CAST(m.x AS BIGINT) AS x, CAST(m.y AS BIGINT) AS y, CAST({k} AS BIGINT) AS band, CAST(b.code AS DOUBLE) AS v FROM m JOIN best b ON b.s = m.m{k}' for k in range(3))}"""


def _tables() -> str:
    """Grids by their rules, as the corners around each colour ask for them."""
    def around(table, names, grid, values, out):
        n = len(names)
        low = {c: f"least(floor({c} * {grid - 1}), {grid - 2})" for c in names}
        at = ", ".join(f"({low[c]} + b{k}) / {grid - 1}e0 AS g{k}" for k, c in enumerate(names))
        weight = " * ".join(f"(CASE b{k} WHEN 1 THEN {c} * {grid - 1} - {low[c]} ELSE 1 - ({c} * {grid - 1} - {low[c]}) END)" for k, c in enumerate(names))
        bits = ", ".join(f"(SELECT unnest([0, 1]) AS b{k})" for k in range(n))
        entry = ", ".join(f"sum(w * round(greatest(0e0, least(1e0, {v})) * 65535) / 65535) AS {o}" for v, o in zip(values, out))
        return f"(SELECT c0, c1, c2, c3, {entry} FROM (SELECT t.*, {at}, {weight} AS w FROM {table} t, {bits}) GROUP BY c0, c1, c2, c3)"

    lab = around("d", ("c0", "c1", "c2", "c3"), 5, ("(1 - g3) * (1 - 0.3e0 * g0 - 0.6e0 * g1 - 0.1e0 * g2)", "0.5e0 + 0.2e0 * (g1 - g0) * (1 - g3)", "0.5e0 + 0.25e0 * (g2 - 0.5e0 * g0 - 0.5e0 * g1) * (1 - g3)"), ("p0", "p1", "p2"))
    rgb = around("lab", ("p0", "p1", "p2"), 9, ("g0 + (g1 - 0.5e0)", "g0 - 0.5e0 * (g1 - 0.5e0) + 0.2e0 * (g2 - 0.5e0)", "g0 - (g2 - 0.5e0)"), ("o0", "o1", "o2"))
    return f"""WITH p AS MATERIALIZED (SELECT image_id, x, y, {', '.join(f'max(v) FILTER (band = {k}) / 255e0 AS c{k}' for k in range(4))} FROM ({to_cmyk.sql(raster_sql('rgb'))}) GROUP BY ALL),
d AS (SELECT DISTINCT c0, c1, c2, c3 FROM p), lab AS MATERIALIZED {lab}, rgb AS MATERIALIZED {rgb}
{' UNION ALL '.join(f'SELECT CAST(p.image_id AS BIGINT) AS image_id, CAST(p.x AS BIGINT) AS x, CAST(p.y AS BIGINT) AS y, CAST({k} AS BIGINT) AS band, floor(round(greatest(0e0, least(1e0, o{k})) * 255, 9) + 0.5) AS v FROM p JOIN rgb USING (c0, c1, c2, c3)' for k in range(3))}"""


SQL |= {"icc_primaries": _primaries(), "icc_tables": _tables()}


SQL["freqmult"] = f"SELECT {_PLACE}, round(avg(v) OVER (PARTITION BY image_id, y, band), 6) + 0e0 AS v FROM {raster_sql('stack')}"


def animation(rgba: str, frames: str) -> str:
    """The canvas before each frame, frame by frame; what is shown is made of it and the frame's pixel."""
    bands = ("r", "g", "b", "a")
    alpha = "(f.a + (w.a * (255 - f.a) + 127) // 255)"
    over = {c: f"least(255, (f.{c} * f.a + (w.{c} * w.a * (255 - f.a)) // 255 + {alpha} // 2) // {alpha})" for c in "rgb"} | {"a": alpha}
    shown = ", ".join(f"CASE WHEN f.x IS NULL OR (f.blend = 'over' AND f.a = 0) THEN w.{c} WHEN f.blend = 'source' OR f.a = 255 THEN f.{c} ELSE {over[c]} END AS s{c}" for c in bands)
    after = ", ".join(f"CASE WHEN f.x IS NULL OR f.dispose = 'previous' THEN w.{c} WHEN f.dispose = 'background' THEN 0 ELSE CASE WHEN f.blend = 'over' AND f.a = 0 THEN w.{c} WHEN f.blend = 'source' OR f.a = 255 THEN f.{c} ELSE {over[c]} END END AS {c}" for c in bands)
    return f"""WITH RECURSIVE t AS MATERIALIZED ({frames}),
f AS MATERIALIZED (SELECT t.anim, t.frame, p.x + t.left_ AS x, p.y + t.top_ AS y, t.dispose, t.blend, {', '.join(f'CAST(max(p.v) FILTER (band = {k}) AS BIGINT) AS {c}' for k, c in enumerate(bands))} FROM ({rgba}) p JOIN t ON t.image_id = p.image_id GROUP BY ALL),
c AS (SELECT anim, max(x) + 1 AS w, max(y) + 1 AS h FROM f GROUP BY anim),
every AS MATERIALIZED (SELECT anim, x, unnest(range(h)) AS y FROM (SELECT anim, h, unnest(range(w)) AS x FROM c)),
walk AS (
  SELECT anim, x, y, CAST(-1 AS BIGINT) AS frame, {', '.join(f'CAST(0 AS BIGINT) AS s{c}' for c in bands)}, {', '.join(f'CAST(0 AS BIGINT) AS {c}' for c in bands)} FROM every
  UNION ALL
  SELECT w.anim, w.x, w.y, w.frame + 1, {shown}, {after} FROM walk w JOIN t ON t.anim = w.anim AND t.frame = w.frame + 1
  LEFT JOIN f ON f.anim = w.anim AND f.frame = w.frame + 1 AND f.x = w.x AND f.y = w.y
)
{' UNION ALL '.join(f'SELECT CAST(anim AS BIGINT) AS anim, frame, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST({k} AS BIGINT) AS band, CAST(s{c} AS DOUBLE) AS v FROM walk WHERE frame >= 0' for k, c in enumerate(bands))}"""
