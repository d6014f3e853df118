"""Aggregations and analysis: statistics, histograms, projections, detection.

Whole-image results are aggregates that Spark combines before the shuffle; what goes back to the pixels is a table of at
most 256 rows a band.
"""

from __future__ import annotations

import math

from ..plans.sqlop import KEY, operator, pair, pel, size_of, sized


@operator(1)
def stats(d, r):
    """Least, largest, sum, sum of squares, mean and population deviation per band, and over all bands (band -1)."""
    return (f"SELECT image_id, coalesce(band, -1) AS band, min(v) AS lo, max(v) AS hi, sum(v) AS total, sum(v * v) AS squares, avg(v) AS mean, "
            f"sqrt(greatest(0e0, avg(v * v) - avg(v) * avg(v))) AS deviation FROM {r} GROUP BY GROUPING SETS ((image_id, band), (image_id))")


def _statistic(column: str):
    @operator(1)
    def one(d, r):
        return f"SELECT image_id, band, {column} AS v FROM ({stats.write(d, r)}) s WHERE band = -1"

    return one


avg, minimum, maximum, deviate = map(_statistic, ("mean", "lo", "hi", "deviation"))


@operator(1)
def hist_find(d, r, bands: int = 1):
    """(image_id, band, bin, n) with all 256 bins; 8-bit values."""
    every = f"(SELECT i.image_id, b.band, s.bin FROM (SELECT DISTINCT image_id FROM {r}) i CROSS JOIN {d.series(0, bands, 'band')} b CROSS JOIN {d.series(0, 256, 'bin')} s)"
    count = f"(SELECT image_id, band, {d.long('v')} AS bin, count(*) AS n FROM {r} GROUP BY 1, 2, 3)"
    return f"SELECT e.image_id, e.band, e.bin, coalesce(c.n, 0) AS n FROM {every} e LEFT JOIN {count} c ON c.image_id = e.image_id AND c.band = e.band AND c.bin = e.bin"


@operator(1)
def hist_cum(d, hist):
    return f"SELECT image_id, band, bin, sum(n) OVER (PARTITION BY image_id, band ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM {hist}"


@operator(1)
def hist_norm(d, hist):
    top = "max(n) OVER (PARTITION BY image_id, band)"
    return f"SELECT image_id, band, bin, CASE WHEN {top} = 0 THEN 0e0 ELSE floor(n * 255e0 / {top}) END AS n FROM {hist}"


def _cumulated(d, r: str, bands: int) -> str:
    return f"({hist_cum.write(d, '(' + hist_find.write(d, r, bands=bands) + ') h')})"


@operator(1)
def hist_equal(d, r, bands: int = 1):
    lut = f"({hist_norm.write(d, _cumulated(d, r, bands) + ' c')})"
    return f"SELECT r.image_id, r.x, r.y, r.band, CAST(t.n AS DOUBLE) AS v FROM {r} r JOIN {lut} t ON t.image_id = r.image_id AND t.band = r.band AND t.bin = r.v"


@operator(2)
def hist_match(d, r, reference, bands: int = 1):
    """Each value becomes the first one of the reference whose share of values up to it is at least its own."""
    def shares(t):
        return f"(SELECT image_id, band, bin, n / CAST(max(n) OVER (PARTITION BY image_id, band) AS DOUBLE) AS s FROM {_cumulated(d, t, bands)} c)"

    lut = (f"(SELECT a.image_id, a.band, a.bin, coalesce(min(b.bin), 255) AS j FROM {shares(r)} a LEFT JOIN {shares(reference)} b "
           f"ON b.image_id = a.image_id AND b.band = a.band AND b.s >= a.s GROUP BY a.image_id, a.band, a.bin)")
    return f"SELECT r.image_id, r.x, r.y, r.band, CAST(t.j AS DOUBLE) AS v FROM {r} r JOIN {lut} t ON t.image_id = r.image_id AND t.band = r.band AND t.bin = r.v"


@operator(1)
def hist_entropy(d, r):
    """Bits of each band's histogram, and of the pooled one (band -1)."""
    counts = f"(SELECT image_id, coalesce(band, -1) AS band, v, count(*) AS n FROM {r} GROUP BY GROUPING SETS ((image_id, band, v), (image_id, v)))"
    shares = f"(SELECT image_id, band, n / CAST(sum(n) OVER (PARTITION BY image_id, band) AS DOUBLE) AS p FROM {counts} c)"
    return f"SELECT image_id, band, -sum(p * log2(p)) AS entropy FROM {shares} s GROUP BY image_id, band"


@operator(2)
def hist_find_indexed(d, r, index, reduction: str = "sum"):
    """Sum, mean, min or max of the values by the index image's value."""
    e = {"sum": "sum(l.v)", "mean": "avg(l.v)", "min": "min(l.v)", "max": "max(l.v)"}[reduction]
    found = f"(SELECT l.image_id, l.band, {d.long('q.v')} AS bin, {e} AS v FROM {r} l JOIN {index} q ON l.image_id = q.image_id AND l.x = q.x AND l.y = q.y GROUP BY 1, 2, 3)"
    tops = f"(SELECT image_id, CAST(max(v) AS INT) + 1 AS top FROM {index} GROUP BY image_id)"
    bands = f"(SELECT b.image_id, b.band, m.top FROM (SELECT DISTINCT image_id, band FROM {r}) b JOIN {tops} m ON m.image_id = b.image_id)"
    return (f"SELECT e.image_id, e.band, e.bin, coalesce(f.v, 0e0) AS v FROM {d.expand(bands, 'top', 'bin')} e "
            f"LEFT JOIN {found} f ON f.image_id = e.image_id AND f.band = e.band AND f.bin = e.bin")


@operator(1)
def hist_find_ndim(d, r, bins: int = 10):
    """Counts in a dense cube over three bands."""
    cell = [f"CAST(floor(v{b} * {bins} / 256e0) AS INT)" for b in range(3)]
    found = f"(SELECT {cell[0]} AS i, {cell[1]} AS j, {cell[2]} AS k, count(*) AS n FROM {pel(r, 3)} p GROUP BY 1, 2, 3)"
    every = f"(SELECT a.i, b.j, c.k FROM {d.series(0, bins, 'i')} a CROSS JOIN {d.series(0, bins, 'j')} b CROSS JOIN {d.series(0, bins, 'k')} c)"
    return f"SELECT e.i, e.j, e.k, coalesce(f.n, 0) AS n FROM {every} e LEFT JOIN {found} f ON f.i = e.i AND f.j = e.j AND f.k = e.k"


@operator(1)
def hist_plot(d, hist, height: int = 256):
    """(image_id, band, x, y, v): bars from below, the highest as high as the picture."""
    share = "n / CAST(CASE WHEN max(n) OVER (PARTITION BY image_id, band) = 0 THEN 1 ELSE max(n) OVER (PARTITION BY image_id, band) END AS DOUBLE)"
    bars = f"(SELECT image_id, band, bin, {d.rint(f'({share}) * {height}')} AS top FROM {hist})"
    return f"SELECT b.image_id, b.band, b.bin AS x, s.y, CASE WHEN s.y >= {height} - b.top THEN 255e0 ELSE 0e0 END AS v FROM {bars} b CROSS JOIN {d.series(0, height, 'y')} s"


@operator(1)
def percent(d, r, share: float = 50.0):
    """Smallest value up to which at least the rounded share of all values lie, bands pooled."""
    counts = f"(SELECT image_id, v, count(*) AS n FROM {r} GROUP BY image_id, v)"
    cum = f"(SELECT image_id, v, sum(n) OVER (PARTITION BY image_id ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c, sum(n) OVER (PARTITION BY image_id) AS total FROM {counts} k)"
    return f"SELECT image_id, min(v) AS v FROM {cum} c WHERE c >= {d.rint(f'{d.num(share / 100)} * total')} GROUP BY image_id"


@operator(1)
def project(d, r):
    """Sums by column (axis x) and by row (axis y)."""
    return (f"SELECT image_id, band, 'x' AS axis, x AS place, sum(v) AS v FROM {r} a GROUP BY image_id, band, x "
            f"UNION ALL SELECT image_id, band, 'y' AS axis, y AS place, sum(v) AS v FROM {r} b GROUP BY image_id, band, y")


@operator(1)
def profile(d, r):
    """First row in each column and first column in each row where a band is not 0; height or width where there is none."""
    return (f"SELECT image_id, 'x' AS axis, x AS place, coalesce(min(CASE WHEN v <> 0 THEN y END), max(h)) AS v FROM {sized(r)} a GROUP BY image_id, x "
            f"UNION ALL SELECT image_id, 'y' AS axis, y AS place, coalesce(min(CASE WHEN v <> 0 THEN x END), max(w)) AS v FROM {sized(r)} b GROUP BY image_id, y")


@operator(1)
def find_trim(d, r, threshold: int = 10):
    """Box of the pixels that differ from the first one by more than the threshold in some band."""
    base = f"(SELECT image_id, band, v AS bg FROM {r} WHERE x = 0 AND y = 0)"
    hit = f"(SELECT r.image_id, x, y FROM {r} r JOIN {base} b ON r.image_id = b.image_id AND r.band = b.band WHERE abs(v - bg) > {threshold})"
    box = f"(SELECT image_id, min(x) AS l, min(y) AS t, max(x) AS rt, max(y) AS bt FROM {hit} h GROUP BY image_id)"
    return (f"SELECT i.image_id, coalesce(l, 0) AS left_, coalesce(t, 0) AS top_, coalesce(rt - l + 1, 0) AS width, coalesce(bt - t + 1, 0) AS height "
            f"FROM (SELECT DISTINCT image_id FROM {r}) i LEFT JOIN {box} b ON i.image_id = b.image_id")


@operator(1)
def countlines(d, r, vertical: bool = False):
    """Mean number of crossings of 128 along rows, or columns."""
    line, along = ("x", "y") if vertical else ("y", "x")
    flips = f"(SELECT image_id, band, {line} AS line, CASE WHEN (v >= 128) <> (lag(v) OVER (PARTITION BY image_id, band, {line} ORDER BY {along}) >= 128) THEN 1 ELSE 0 END AS f FROM {r})"
    return f"SELECT image_id, band, sum(f) / CAST(count(DISTINCT line) AS DOUBLE) AS v FROM {flips} k GROUP BY image_id, band"


@operator(1)
def getpoint(d, r, x: int = 3, y: int = 5):
    return f"SELECT image_id, band, v FROM {r} WHERE x = {x} AND y = {y}"


@operator(1)
def measure(d, r, across: int = 3, down: int = 4):
    """Mean of each patch of a grid, a tenth of its size left out on every side."""
    cells = ", ".join(f"({i}, {j})" for j in range(down) for i in range(across))
    low = lambda k, n, m: f"CAST(floor({k} * ({n} / {d.num(m)}) + {n} / {d.num(m)} / 10) AS INT)"
    span = lambda n, m: f"greatest(1, CAST(floor({n} / {d.num(m)} * 8e-1) AS INT))"
    patches = (f"(SELECT s.image_id, c.i, c.j, {low('c.i', 's.w', across)} AS x0, {low('c.j', 's.h', down)} AS y0, {span('s.w', across)} AS pw, {span('s.h', down)} AS ph "
               f"FROM {size_of(r)} s CROSS JOIN (VALUES {cells}) AS c(i, j))")
    return (f"SELECT r.image_id, p.i, p.j, r.band, avg(r.v) AS v FROM {r} r JOIN {patches} p ON p.image_id = r.image_id AND r.x >= p.x0 AND r.x < p.x0 + p.pw AND r.y >= p.y0 AND r.y < p.y0 + p.ph "
            f"GROUP BY r.image_id, p.i, p.j, r.band")


@operator(1)
def hough_line(d, r, width: int = 64, height: int = 64, threshold: int = 128):
    """Votes (theta, rho, n) of the pixels above the threshold for lines through them, in `width` angles and `height` distances."""
    turn = f"(t.theta * {d.num(math.pi / width)})"
    rho = f"(h.x * cos({turn}) + h.y * sin({turn}))"
    diagonal = "sqrt(h.w * h.w + h.h * h.h)"
    bin_ = f"CAST({d.rint(f'({rho} + {diagonal}) * {height - 1} / (2 * {diagonal})')} AS INT)"
    return (f"SELECT h.image_id, t.theta, {bin_} AS rho, count(*) AS n FROM (SELECT q.* FROM {sized(r)} q WHERE v > {threshold} AND band = 0) h "
            f"CROSS JOIN {d.series(0, width, 'theta')} t GROUP BY 1, 2, 3")


def circle_points(radius: int) -> list[tuple[int, int]]:
    """Offsets of a midpoint circle, the eight mirrored points of each step; those on the axes and diagonals come twice.

    The error is 0 at first. Every step goes one up in y; if the error was above 0, also one back in x.
    """
    points, x, y, err = [], radius, 0, 0
    while x >= y:
        points += [(i * a, j * b) for a, b in ((x, y), (y, x)) for i in (1, -1) for j in (1, -1)]
        y, x = y + 1, x - (err > 0)
        err += 2 * y + 1 if err <= 0 else 2 * (y - x) + 1
    return points


@operator(1)
def hough_circle(d, r, min_radius: int = 3, max_radius: int = 4, threshold: int = 128):
    """Votes (radius, x, y, n) for centres of circles."""
    rows = ", ".join(f"({k}, {dx}, {dy})" for k in range(min_radius, max_radius + 1) for dx, dy in circle_points(k))
    return (f"SELECT r.image_id, o.k AS radius, r.x + o.dx AS x, r.y + o.dy AS y, count(*) AS n FROM {sized(r)} r CROSS JOIN (VALUES {rows}) AS o(k, dx, dy) "
            f"WHERE r.v > {threshold} AND r.band = 0 AND r.x + o.dx >= 0 AND r.x + o.dx < r.w AND r.y + o.dy >= 0 AND r.y + o.dy < r.h GROUP BY 1, 2, 3, 4")


@pair
def complex_magnitude(d):
    """Of a real and an imaginary image."""
    return "sqrt(l.v * l.v + q.v * q.v)"


@pair
def complex_phase(d):
    return "atan2(q.v, l.v)"


@operator(2)
def complex_form(d, real, imag):
    return f"SELECT l.image_id, l.x, l.y, l.band, l.v AS re, q.v AS im FROM {real} l JOIN {imag} q ON l.image_id = q.image_id AND l.x = q.x AND l.y = q.y AND l.band = q.band"


@operator(1)
def complex_op(d, c, op: str = "polar"):
    """polar, rect (radians) or conj of (re, im)."""
    re, im = {"polar": ("sqrt(re * re + im * im)", "atan2(im, re)"), "rect": ("re * cos(im)", "re * sin(im)"), "conj": ("re", "-im")}[op]
    return f"SELECT {KEY}, {re} AS re, {im} AS im FROM {c}"


@operator(1)
def complex_get(d, c, mode: str = "magnitude"):
    e = {"real": "re", "imag": "im", "magnitude": "sqrt(re * re + im * im)", "phase": "atan2(im, re)"}[mode]
    return f"SELECT {KEY}, {e} AS v FROM {c}"


@operator(2)
def cross_phase(d, a, b):
    """Argument of the first times the conjugate of the second."""
    e = "atan2(l.im * q.re - l.re * q.im, l.re * q.re + l.im * q.im)"
    return f"SELECT l.image_id, l.x, l.y, l.band, {e} AS v FROM {a} l JOIN {b} q ON l.image_id = q.image_id AND l.x = q.x AND l.y = q.y AND l.band = q.band"


@operator(1)
def page_bounds(d, r, bright: int = 160, dark: int = 60, fraction: float = 0.3, gap: int = 3):
    """Longest runs of rows and of columns of which a share is bright or dark, gaps bridged: (image_id, axis, first, last)."""
    hit = f"(SELECT q.* FROM {sized(r)} q WHERE band = 0 AND (v > {bright} OR v < {dark}))"
    parts = []
    for axis, along, across in (("x", "x", "h"), ("y", "y", "w")):
        lines = f"(SELECT image_id, {along} AS p FROM {hit} t GROUP BY image_id, {along} HAVING count(*) >= {d.num(fraction)} * max({across}))"
        starts = f"(SELECT image_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY image_id ORDER BY p) <= {gap + 1} THEN 0 ELSE 1 END AS s FROM {lines} l)"
        runs = f"(SELECT image_id, p, sum(s) OVER (PARTITION BY image_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM {starts} t)"
        spans = f"(SELECT image_id, run, min(p) AS a, max(p) AS b FROM {runs} u GROUP BY image_id, run)"
        ranked = f"(SELECT image_id, a, b, row_number() OVER (PARTITION BY image_id ORDER BY b - a DESC, a) AS k FROM {spans} w)"
        parts.append(f"SELECT image_id, '{axis}' AS axis, a AS first, b AS last FROM {ranked} z WHERE k = 1")
    return " UNION ALL ".join(parts)


@operator(1)
def detect_upright(d, r, ink: int = 128, share: float = 0.2, least: int = 8):
    """(image_id, signal) of one-band pages (see analysis_copy): how much more ink lines of text have in their lower half, -1 to 1.

    Lines are runs of `least` rows or more whose ink is at least `share` of the fullest row's; islands of rows are told apart by the
    difference of row and rank. Each line counts alike; pages without ink or lines have 0.
    """
    rows = f"(SELECT image_id, y, sum(CASE WHEN 255 - v >= {ink} THEN 255e0 ELSE 0e0 END) AS s FROM {r} WHERE band = 0 GROUP BY image_id, y)"
    lit = f"(SELECT image_id, y, s, y - row_number() OVER (PARTITION BY image_id ORDER BY y) AS island FROM (SELECT q.*, max(s) OVER (PARTITION BY image_id) AS top FROM {rows} q) t WHERE top > 0 AND s >= top * {d.num(share)})"
    lines = f"(SELECT image_id, island, min(y) AS first, count(*) AS n FROM {lit} i GROUP BY image_id, island)"
    halves = (f"(SELECT i.image_id, i.island, sum(CASE WHEN i.y < l.first + floor(l.n / 2e0) THEN -i.s ELSE i.s END) / sum(i.s) AS lean FROM {lit} i JOIN {lines} l ON l.image_id = i.image_id AND l.island = i.island "
              f"WHERE l.n >= {least} GROUP BY i.image_id, i.island)")
    return f"SELECT i.image_id, coalesce(b.signal, 0e0) AS signal FROM (SELECT DISTINCT image_id FROM {r}) i LEFT JOIN (SELECT image_id, round(avg(lean), 9) AS signal FROM {halves} h GROUP BY image_id) b ON b.image_id = i.image_id"


@operator(1)
def is_upside_down(d, r, below: float = -0.02, ink: int = 128, share: float = 0.2, least: int = 8):
    """(image_id, v): 1 where the signal of detect_upright is below a threshold, else 0."""
    return f"SELECT image_id, CASE WHEN signal < {d.num(below)} THEN 1 ELSE 0 END AS v FROM ({detect_upright.write(d, r, ink=ink, share=share, least=least)}) u"
