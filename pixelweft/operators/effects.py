"""Artistic effects, turning by any angle, and what straightens scanned documents."""

from __future__ import annotations

import math

from ..plans.sqlop import DUCKDB, KEY, operator, pel, size_of
from . import analysis, geometry, pointwise, stencil


def _grey(d, r: str, bands: int) -> str:
    """Subquery: one band of luma with the weights of BT.709, rounded; the only band of a one-band image."""
    if bands == 1:
        return f"(SELECT {KEY}, v FROM {r} WHERE band = 0)"
    return f"(SELECT image_id, x, y, 0 AS band, {d.u8_round('v0 * 2126e-4 + v1 * 7152e-4 + v2 * 722e-4')} AS v FROM {pel(r, bands)} p)"


def _mean(r: str, radius: int) -> str:
    """Subquery: whole means of squares, clipped at the edges."""
    frame = f" ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING"
    rows = f"(SELECT {KEY}, v, sum(v) OVER {stencil._row(frame)} AS s, count(*) OVER {stencil._row(frame)} AS n FROM {r})"
    return f"(SELECT {KEY}, v, floor(sum(s) OVER {stencil._column(frame)} / sum(n) OVER {stencil._column(frame)}) AS m FROM {rows} a)"


def _spread(r: str, values: str) -> str:
    """The values of a one-band subquery in all bands of r but an alpha band."""
    return f"SELECT r.image_id, r.x, r.y, r.band, CASE WHEN r.band = 3 THEN r.v ELSE e.v END AS v FROM {r} r JOIN {values} e ON e.image_id = r.image_id AND e.x = r.x AND e.y = r.y"


def _blur_radius(radius: float, sigma: float) -> int:
    return max(1, round(radius), math.ceil(2 * sigma))


@operator(1)
def charcoal(d, r, radius: float = 1.0, sigma: float = 0.5, bands: int = 3):
    """White less three times what differs from the mean around it."""
    edges = f"(SELECT image_id, x, y, greatest(0e0, 255 - 3 * abs(v - m)) AS v FROM {_mean(_grey(d, r, bands), _blur_radius(radius, sigma))} b)"
    return _spread(r, edges)


@operator(1)
def sketch(d, r, radius: float = 1.0, sigma: float = 0.5, angle: float = 0.0, bands: int = 3):
    """White less twice the slope of the blurred image along one direction."""
    blurred = f"(SELECT {KEY}, m AS v FROM {_mean(_grey(d, r, bands), _blur_radius(radius, sigma))} b)"
    dx, dy = round(math.cos(math.radians(angle)), 12), round(math.sin(math.radians(angle)), 12)
    edges = f"(SELECT image_id, x, y, greatest(0e0, 255 - 2 * floor(abs((p12 - p10) * {d.num(dx)} + (p21 - p01) * {d.num(dy)}))) AS v FROM {stencil.nine(d, blurred)} n)"
    return _spread(r, edges)


@operator(1)
def oil_paint(d, r, radius: float = 3.0, sigma: float = 1.0, bands: int = 3):
    """The mean colour of the commonest cell of a cube of levels around each pixel; of equally common ones that which fills up first, row by row."""
    reach, levels = max(1, round(radius)), min(32, max(4, round(8 + 4 * sigma)))
    colours = ("v0", "v1", "v2") if bands >= 3 else ("v0",) * 3
    cell = [f"CAST(floor({c} * {levels} / 256e0) AS INT)" for c in colours]
    side = 2 * reach + 1
    pels = f"(SELECT p.*, s.w, s.h, ({cell[0]} * {levels} + {cell[1]}) * {levels} + {cell[2]} AS cell FROM {pel(r, bands)} p JOIN {size_of(r)} s ON s.image_id = p.image_id)"
    around = (f"(SELECT q.image_id, q.x - (i.i - {reach}) AS x, q.y - (j.j - {reach}) AS y, q.w, q.h, q.cell, j.j * {side} + i.i AS place, {', '.join(f'q.{c} AS c{k}' for k, c in enumerate(colours))} "
              f"FROM {pels} q CROSS JOIN {d.series(0, side, 'i')} i CROSS JOIN {d.series(0, side, 'j')} j)")
    cells = (f"(SELECT image_id, x, y, cell, count(*) AS n, max(place) AS last_place, {', '.join(f'floor(sum(c{k}) / count(*)) AS m{k}' for k in range(3))} FROM {around} a "
             f"WHERE x >= 0 AND y >= 0 AND x < w AND y < h GROUP BY image_id, x, y, cell)")
    rank = f"n * {side * side} - last_place"
    best = f"(SELECT image_id, x, y, {', '.join(f'{d.arg_max(f'm{k}', rank)} AS m{k}' for k in range(3))} FROM {cells} c GROUP BY image_id, x, y)"
    return (f"SELECT r.image_id, r.x, r.y, r.band, CASE r.band WHEN 0 THEN b.m0 WHEN 1 THEN b.m1 WHEN 2 THEN b.m2 ELSE r.v END AS v FROM {r} r "
            f"JOIN {best} b ON b.image_id = r.image_id AND b.x = r.x AND b.y = r.y")


#: Columns and rows of the pieces that a turned image's surroundings are made in, and side of the tiles that its pixels are gathered in.
#: Along the columns of a short piece the coordinates of a result repeat soon, so that files of it stay small; a task holds the places of one piece.
WIDE, STRIP, TILE = 64, 256, 32


def _box(d, sizes: str, angles: str, more: str = "") -> str:
    """Subquery: sizes(image_id, w, h) with cosine, sine and the sides of the box around the turned image."""
    rad = f"(a.degrees * {d.num(math.pi / 180)})"
    c, s = f"round(cos{rad}, 15)", f"round(sin{rad}, 15)"
    return f"(SELECT z.image_id, z.w, z.h, {more}{c} AS c, {s} AS s, CAST(ceil(round(abs({c}) * z.w + abs({s}) * z.h, 9)) AS INT) AS ow, CAST(ceil(round(abs({s}) * z.w + abs({c}) * z.h, 9)) AS INT) AS oh FROM {sizes} z JOIN {angles} a ON a.image_id = z.image_id)"


def _tiles(pixels: str, fill: str) -> str:
    """Subquery (image_id, band, tx, ty, vals): the pixels of tiles, with those of the next column and row, row by row; `fill` where there are none.

    Where places between others are empty or taken twice, rows are gathered one by one; pixels of one place are summed.
    """
    of = lambda n: f"explode(CASE WHEN {n} % {TILE} = 0 THEN array(CAST(floor({n} / {TILE}e0) AS INT) - 1, CAST(floor({n} / {TILE}e0) AS INT)) ELSE array(CAST(floor({n} / {TILE}e0) AS INT)) END) AS t{n}"
    dealt = f"(SELECT o.*, {of('y')} FROM (SELECT p.*, {of('x')} FROM {pixels} p) o)"
    found = (f"(SELECT image_id, band, tx, ty, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, sort_array(collect_list(struct(y, x, coalesce(v, {fill}) AS v))) AS found "
             f"FROM {dealt} t GROUP BY image_id, band, tx, ty)")
    place = f"pmod(e.y, {2 * TILE}) * {2 * TILE} + pmod(e.x, {2 * TILE})"
    all_there = f"cardinality(found) = (x1 - x0 + 1) * (y1 - y0 + 1) AND cardinality(array_distinct(transform(found, e -> {place}))) = cardinality(found)"
    cell = f"CASE WHEN exists(g, e -> e.x = xx) THEN aggregate(filter(g, e -> e.x = xx), 0e0, (a, e) -> a + e.v) ELSE {fill} END"
    rows = f"flatten(transform(transform(sequence(y0, y1), yy -> filter(found, e -> e.y = yy)), g -> transform(sequence(x0, x1), xx -> {cell})))"
    left, right = f"array_repeat({fill}, x0 - tx * {TILE})", f"array_repeat({fill}, tx * {TILE} + {TILE} - x1)"
    row = f"CASE WHEN yy BETWEEN y0 AND y1 THEN concat({left}, slice(vals, (yy - y0) * (x1 - x0 + 1) + 1, x1 - x0 + 1), {right}) ELSE array_repeat({fill}, {TILE + 1}) END"
    # As the argument of a function, what is in the bounds is made once.
    bounded = f"array(CASE WHEN {all_there} THEN found.v ELSE {rows} END)"
    return f"(SELECT image_id, band, tx, ty, transform({bounded}, vals -> flatten(transform(sequence(ty * {TILE}, ty * {TILE} + {TILE}), yy -> {row})))[0] AS vals FROM {found} b)"


def _turned_in_pieces(d, pixels: str, bands: str, cut: str | None = None, fill: str = "0e0") -> str:
    """What _turned says, on Spark: pixels(image_id, x, y, band, v) are at (dx, dy) of images of the sizes of bands, `fill` around them.

    Each tile of the image makes the places that lie in it; no place travels. The surroundings are made in pieces of columns, most of which
    lie outside from end to end; with cut(image_id, l, u, iw, ih) only that part of the box is made, its corner at 0.
    """
    part = f"(SELECT b.*, k.l, k.u, least(k.iw, b.ow - k.l) AS nw, least(k.ih, b.oh - k.u) AS nh FROM {bands} b JOIN {cut} k ON k.image_id = b.image_id)" if cut else f"(SELECT b.*, 0 AS l, 0 AS u, b.ow AS nw, b.oh AS nh FROM {bands} b)"
    rx = lambda oy: f"w / 2e0 + c * (ox - ow / 2e0) + s * ({oy} - oh / 2e0)"
    ry = lambda oy: f"h / 2e0 - s * (ox - ow / 2e0) + c * ({oy} - oh / 2e0)"
    # Far outside is told before anything is rounded.
    within = "rx > -1 AND ry > -1 AND rx < w AND ry < h AND round(rx, 9) >= 0 AND round(ry, 9) >= 0 AND round(rx, 9) < w - 1 AND round(ry, 9) < h - 1"

    pieces = d.spread(d.expand(d.expand(part, f"ceil(nh / {STRIP}e0)", "k"), f"ceil(nw / {WIDE}e0)", "g"))
    columns = f"(SELECT e.*, l + i AS ox, k * {STRIP} AS j, least({STRIP}, nh - k * {STRIP}) AS n FROM (SELECT o.*, g * {WIDE} + m AS i FROM {d.expand(pieces, f'least({WIDE}, nw - g * {WIDE})', 'm')} o) e)"
    ends = f"(SELECT e.*, {rx('(u + j)')} AS rx0, {rx('(u + j + n - 1)')} AS rx1, {ry('(u + j)')} AS ry0, {ry('(u + j + n - 1)')} AS ry1 FROM {columns} e)"
    near = "greatest(rx0, rx1) > -1 AND least(rx0, rx1) < w AND greatest(ry0, ry1) > -1 AND least(ry0, ry1) < h"
    far = d.expand(f"(SELECT image_id, band, i, j, n FROM {ends} e WHERE NOT ({near}))", "n", "q")
    around = f"(SELECT p.*, {rx('(u + j + q)')} AS rx, {ry('(u + j + q)')} AS ry FROM {d.expand(f'(SELECT * FROM {ends} e WHERE {near})', 'n', 'q')} p)"

    first = lambda at: f"CAST(floor(-{at} / {TILE}e0) AS INT)"
    count = lambda n, at: f"floor(({n} - 2 - {at}) / {TILE}e0) - {first(at)} + 1"
    grid = f"(SELECT e.*, {first('dx')} + p AS tx, {first('dy')} + q AS ty FROM {d.expand(d.spread(d.expand(part, count('h', 'dy'), 'q')), count('w', 'dx'), 'p')} e)"
    # The middle of what a tile makes and half its sides, of which the box around it, turned, follows.
    sides = f"(SELECT e.*, greatest(0, left_) AS x0, greatest(0, top_) AS y0, least(w - 1, left_ + {TILE}) AS x1, least(h - 1, top_ + {TILE}) AS y1 FROM (SELECT o.*, tx * {TILE} + dx AS left_, ty * {TILE} + dy AS top_ FROM {grid} o) e)"
    middle, half = ("(x0 + x1 - w) / 2e0", "(y0 + y1 - h) / 2e0"), ("(x1 - x0) / 2e0", "(y1 - y0) / 2e0")
    boxes = (f"(SELECT o.*, ow / 2e0 + c * {middle[0]} - s * {middle[1]} AS cx, oh / 2e0 + s * {middle[0]} + c * {middle[1]} AS cy, "
             f"abs(c) * {half[0]} + abs(s) * {half[1]} + 1 AS rx, abs(s) * {half[0]} + abs(c) * {half[1]} + 1 AS ry FROM {sides} o)")
    spans = (f"(SELECT image_id, band, w, h, c, s, ow, oh, l, u, tx, ty, left_, top_, x0, x1, y0, y1, greatest(l, CAST(floor(cx - rx) AS INT)) AS ox0, least(l + nw, CAST(ceil(cx + rx) AS INT) + 1) AS ox1, "
             f"greatest(u, CAST(floor(cy - ry) AS INT)) AS oy0, least(u + nh, CAST(ceil(cy + ry) AS INT) + 1) AS oy1 FROM {boxes} b)")
    filled = (f"(SELECT g.*, coalesce(f.vals, array_repeat({fill}, {(TILE + 1) ** 2})) AS vals FROM {spans} g LEFT JOIN {_tiles(pixels, fill)} f "
              f"ON f.image_id = g.image_id AND f.band = g.band AND f.tx = g.tx AND f.ty = g.ty)")
    every = f"(SELECT o.*, oy0 + q AS oy FROM {d.expand(f'(SELECT e.*, ox0 + p AS ox FROM {d.expand(filled, "ox1 - ox0", "p")} e)', 'oy1 - oy0', 'q')} o)"
    at = f"(SELECT image_id, band, l, u, left_, top_, x0, x1, y0, y1, vals, ox, oy, round({rx('oy')}, 9) AS sx, round({ry('oy')}, 9) AS sy FROM {every} p)"
    here = (f"(SELECT image_id, band, ox - l AS x, oy - u AS y, vals, CAST((floor(sy) - top_) * {TILE + 1} + floor(sx) - left_ AS INT) AS k, sx - floor(sx) AS fx, sy - floor(sy) AS fy FROM {at} o "
            f"WHERE sx >= x0 AND sy >= y0 AND sx < x1 AND sy < y1)")
    shares = [f"round({'fx' if i else '(1 - fx)'} * {'fy' if j else '(1 - fy)'} * get(vals, k + {j * (TILE + 1) + i}), 9)" for i, j in ((0, 0), (1, 0), (0, 1), (1, 1))]
    return (f"(SELECT image_id, x, y, band, {d.u8_trunc(f'round({" + ".join(shares)}, 6)')} AS v FROM {here} t "
            f"UNION ALL SELECT image_id, i AS x, j + q AS y, band, 0e0 AS v FROM {around} q WHERE NOT ({within}) "
            f"UNION ALL SELECT image_id, i AS x, j + q AS y, band, 0e0 AS v FROM {far} q)")


def _turned(d, r: str, angles: str, cut: str | None = None) -> str:
    """r turned about its middle by the degrees of angles(image_id, degrees), clockwise, in the box around it; bilinear, 0 outside."""
    some = f"(SELECT DISTINCT image_id, band FROM {r})"
    if d is not DUCKDB:
        return _turned_in_pieces(d, r, f"(SELECT k.band, z.* FROM {some} k JOIN {_box(d, size_of(r), angles, '0 AS dx, 0 AS dy, ')} z ON z.image_id = k.image_id)", cut)
    bands = f"(SELECT k.band, z.* FROM {some} k JOIN {_box(d, size_of(r), angles)} z ON z.image_id = k.image_id)"
    every = d.expand(d.expand(bands, "ow", "ox"), "oh", "oy")
    at = (f"(SELECT o.*, round(o.w / 2e0 + c * (o.ox - o.ow / 2e0) + s * (o.oy - o.oh / 2e0), 9) AS sx, round(o.h / 2e0 - s * (o.ox - o.ow / 2e0) + c * (o.oy - o.oh / 2e0), 9) AS sy FROM {every} o)")
    return f"(SELECT image_id, x, y, band, {d.u8_trunc('round(v, 6)')} AS v FROM {geometry.sampled(r, at)} t)"


@operator(1)
def rotate(d, r, degrees: float = 30.0):
    """By any angle, clockwise; quarters are exact, others are bilinear in the box around the turned image."""
    quarter = degrees % 360
    if quarter == 0:
        return f"SELECT {KEY}, v FROM {r}"
    if quarter in (90, 180, 270):
        return geometry.rotate90.write(d, r, angle=int(quarter))
    return f"SELECT {KEY}, v FROM {_turned(d, r, f'(SELECT DISTINCT image_id, {d.num(degrees)} AS degrees FROM {r})')} t"


@operator(1)
def polaroid(d, r, angle: float = -5.0, bands: int = 3):
    """In a white frame, wider below, turned; images of one or three bands get an opaque alpha."""
    some = {1: (0, 0, 0), 3: (0, 1, 2), 4: (0, 1, 2, 3)}[bands]
    layers = " UNION ALL ".join([f"SELECT image_id, x, y, {b} AS band, v FROM {r} l{b} WHERE band = {s}" for b, s in enumerate(some)]
                                + ([f"SELECT image_id, x, y, 3 AS band, 255e0 AS v FROM {r} l3 WHERE band = 0"] if bands < 4 else []))
    side, top = (f"greatest(4, CAST(ceil(round({n} * 8e-2, 9)) AS INT))" for n in ("w", "h"))
    bottom = f"greatest({top} + 4, CAST(ceil(round(h * 18e-2, 9)) AS INT))"
    if d is not DUCKDB and angle % 90:
        # The frame and an alpha of its own are what is around pixels; neither becomes rows.
        framed = f"(SELECT image_id, w + 2 * {side} AS w, h + {top} + {bottom} AS h, {side} AS dx, {top} AS dy FROM {size_of(r)} z)"
        box = _box(d, framed, f"(SELECT DISTINCT image_id, {d.num(angle)} AS degrees FROM {r})", "z.dx, z.dy, ")
        shown = f"(SELECT {KEY}, v FROM {r} l WHERE band IN ({', '.join(map(str, some))}))" if bands > 1 else f"(SELECT l.image_id, l.x, l.y, b.band, l.v FROM {r} l CROSS JOIN {d.series(0, 3, 'band')} b WHERE l.band = 0)"
        return f"SELECT {KEY}, v FROM {_turned_in_pieces(d, shown, f'(SELECT b.band, z.* FROM {box} z CROSS JOIN {d.series(0, 4, "band")} b)', fill='255e0')} t"
    four = f"(SELECT z.*, b.band, {side} AS side, {top} AS top FROM {size_of(r)} z CROSS JOIN {d.series(0, 4, 'band')} b)"
    every = d.expand(d.spread(d.expand(four, f"w + 2 * {side}", "ox")), f"h + {top} + {bottom}", "oy")
    framed = (f"(SELECT e.image_id, e.ox AS x, e.oy AS y, e.band, coalesce(l.v, 255e0) AS v FROM {every} e LEFT JOIN ({layers}) l "
              f"ON l.image_id = e.image_id AND l.band = e.band AND l.x = e.ox - e.side AND l.y = e.oy - e.top)")
    return rotate.write(d, framed, degrees=angle)


@operator(1)
def analysis_copy(d, r, most: int = 1200, bands: int = 3):
    """One grey band, images of more than `most` pixels a side made that small."""
    ratio = f"least(1e0, {d.num(most)} / greatest(w, h))"
    return geometry._resized(d, _grey(d, r, bands), ratio, ratio, "linear")


def _skews(d, r: str, most: float, theta: int = 360, rho: int = 400) -> str:
    """Subquery (image_id, degrees): the angle near the horizontal whose votes are gathered most, between bins by a parabola; 0 without votes."""
    dark = f"({pointwise.threshold.write(d, f'(SELECT image_id, x, y, band, 255 - v AS v FROM {r} i)', value=128)})"
    votes = f"({analysis.hough_line.write(d, dark, width=theta, height=rho)})"
    half = math.ceil(most * theta / 180)
    low, high = max(0, theta // 2 - half), min(theta, theta // 2 + half + 1) - 1
    scores = f"(SELECT image_id, theta, sum(CAST(n AS DOUBLE) * n) AS score FROM {votes} v WHERE theta BETWEEN {low} AND {high} GROUP BY image_id, theta)"
    sides = (f"(SELECT image_id, theta, score, coalesce(lag(score) OVER (PARTITION BY image_id ORDER BY theta), 0e0) AS l, coalesce(lead(score) OVER (PARTITION BY image_id ORDER BY theta), 0e0) AS r, "
             f"row_number() OVER (PARTITION BY image_id ORDER BY score DESC, theta) AS k FROM {scores} s)")
    bend = "(2 * (l - 2 * score + r))"
    between = f"CASE WHEN theta > {low} AND theta < {high} AND abs{bend} > 1e-9 THEN greatest(-1e0, least(1e0, (l - r) / CASE WHEN {bend} = 0 THEN 1e0 ELSE {bend} END)) ELSE 0e0 END"
    return (f"(SELECT i.image_id, coalesce(b.degrees, 0e0) AS degrees FROM (SELECT DISTINCT image_id FROM {r}) i "
            f"LEFT JOIN (SELECT image_id, round({d.num(180 / theta)} * (theta + {between}) - 90, 9) AS degrees FROM {sides} t WHERE k = 1) b ON b.image_id = i.image_id)")


@operator(1)
def detect_skew(d, r, most: float = 10.0):
    """(image_id, degrees) by which lines of dark pixels of a grey image (see analysis_copy) are turned from the horizontal."""
    return f"SELECT image_id, degrees FROM {_skews(d, r, most)} s"


@operator(2)
def deskew(d, r, skews, least: float = 0.1):
    """Turned back by skews(image_id, degrees) and cut to the largest upright rectangle within; images of less skew than `least` stay."""
    back = f"(SELECT image_id, -degrees AS degrees FROM {skews} k WHERE abs(degrees) >= {d.num(least)})"
    rad = f"(abs(b.degrees) * {d.num(math.pi / 180)})"
    long = f"((greatest(z.w, z.h) * cos{rad} - least(z.w, z.h) * sin{rad}) / cos(2 * {rad}))"
    short = f"((least(z.w, z.h) * cos{rad} - greatest(z.w, z.h) * sin{rad}) / cos(2 * {rad}))"
    wide = lambda a, b: f"CAST(floor(round(CASE WHEN z.w >= z.h THEN {a} ELSE {b} END, 9)) AS INT)"
    box = lambda a, b: f"CAST(ceil(round(cos{rad} * {a} + sin{rad} * {b}, 9)) AS INT)"
    sizes = f"(SELECT z.image_id, {wide(long, short)} AS iw, {wide(short, long)} AS ih, {box('z.w', 'z.h')} AS ow, {box('z.h', 'z.w')} AS oh FROM {size_of(r)} z JOIN {back} b ON b.image_id = z.image_id)"
    cut = f"(SELECT image_id, greatest(0, CAST(floor((ow - iw) / 2e0) AS INT)) AS l, greatest(0, CAST(floor((oh - ih) / 2e0) AS INT)) AS u, iw, ih FROM {sizes} b)"
    stay = f"UNION ALL SELECT r.image_id, r.x, r.y, r.band, r.v FROM {r} r JOIN {skews} k ON k.image_id = r.image_id WHERE abs(k.degrees) < {d.num(least)}"
    if d is not DUCKDB:
        return f"SELECT image_id, x, y, band, v FROM {_turned(d, r, back, cut)} t {stay}"
    return (f"SELECT t.image_id, t.x - c.l AS x, t.y - c.u AS y, t.band, t.v FROM {_turned(d, r, back)} t JOIN {cut} c ON c.image_id = t.image_id WHERE t.x >= c.l AND t.y >= c.u AND t.x < c.l + c.iw AND t.y < c.u + c.ih {stay}")


@operator(1)
def auto_crop(d, r, bright: int = 160, dark: int = 60, fraction: float = 0.3, gap: int = 3):
    """The part within the page's bounds; images of which none are found stay whole."""
    bounds = f"({analysis.page_bounds.write(d, r, bright=bright, dark=dark, fraction=fraction, gap=gap)})"
    box = f"(SELECT image_id, max(CASE WHEN axis = 'x' THEN first END) AS l, max(CASE WHEN axis = 'x' THEN last END) AS rt, max(CASE WHEN axis = 'y' THEN first END) AS t, max(CASE WHEN axis = 'y' THEN last END) AS b FROM {bounds} p GROUP BY image_id)"
    whole = f"(SELECT s.image_id, CASE WHEN c.l IS NULL OR c.t IS NULL THEN 0 ELSE c.l END AS l, CASE WHEN c.l IS NULL OR c.t IS NULL THEN s.w - 1 ELSE c.rt END AS rt, CASE WHEN c.l IS NULL OR c.t IS NULL THEN 0 ELSE c.t END AS t, CASE WHEN c.l IS NULL OR c.t IS NULL THEN s.h - 1 ELSE c.b END AS b FROM {size_of(r)} s LEFT JOIN {box} c ON c.image_id = s.image_id)"
    return f"SELECT r.image_id, r.x - w.l AS x, r.y - w.t AS y, r.band, r.v FROM {r} r JOIN {whole} w ON w.image_id = r.image_id WHERE r.x BETWEEN w.l AND w.rt AND r.y BETWEEN w.t AND w.b"


@operator(1)
def edge(d, r, method: str = "sobel"):
    """One of the edge detectors that are stencils."""
    return getattr(stencil, method).write(d, r)
