"""Filled paths: scan lines cross a path's edges, pairs of crossings are spans, and a span joins the pixels that it covers.

A path is a list of commands: ("M", p), ("L", p), ("Q", c, p), ("C", c, d, p) with points (x, y), and ("Z",).
"""

from __future__ import annotations

from ..plans.sqlop import KEY, operator, size_of
from .draw import _ink

#: How far a curve may lie from its chord, and how often it is halved at most. Fixed values.
FLAT, DEPTH = 0.25, 17
#: Handle length of the cubic that stands for a quarter of a circle. Fixed value.
HANDLE = 0.5522847498307933


def polygon(*points) -> list:
    return [("M", points[0]), *[("L", p) for p in points[1:]], ("Z",)]


def rectangle(x: float, y: float, w: float, h: float) -> list:
    return polygon((x, y), (x + w, y), (x + w, y + h), (x, y + h))


def circle(cx: float, cy: float, radius: float) -> list:
    """Four cubics, from the right by way of the bottom."""
    out, k = [("M", (cx + radius, cy))], HANDLE
    for (a, b) in ((1, 0), (0, 1), (-1, 0), (0, -1)):
        c, d = -b, a  # a quarter further
        at = lambda u, v: (cx + radius * u, cy + radius * v)
        out.append(("C", at(a + k * c, b + k * d), at(c + k * a, d + k * b), at(c, d)))
    return [*out, ("Z",)]


def band(x1: float, y1: float, x2: float, y2: float, width: float) -> list:
    """The outline of a line of some width with butt ends."""
    length = ((x2 - x1) ** 2 + (y2 - y1) ** 2) ** 0.5
    dx, dy = (y1 - y2) / length * width / 2, (x2 - x1) / length * width / 2
    return polygon((x1 + dx, y1 + dy), (x2 + dx, y2 + dy), (x2 - dx, y2 - dy), (x1 - dx, y1 - dy))


def _flat(p: list[complex]) -> bool:
    if len(p) == 3:
        return abs((p[0] + p[2]) / 2 - p[1]) <= FLAT
    u, v = 3 * p[1] - 2 * p[0] - p[3], 3 * p[2] - 2 * p[3] - p[0]
    return max(u.real ** 2, v.real ** 2) + max(u.imag ** 2, v.imag ** 2) <= FLAT ** 2


def _chords(curve: list[complex], depth: int = 0) -> list[complex]:
    """Ends of the chords of a curve, halved by its control polygon until it is flat."""
    if depth >= DEPTH or _flat(curve):
        return [curve[-1]]
    left, right, rest = [], [], curve
    while rest:
        left, right = [*left, rest[0]], [rest[-1], *right]
        rest = [(a + b) / 2 for a, b in zip(rest, rest[1:])]
    return _chords(left, depth + 1) + _chords(right, depth + 1)


def edges(path: list) -> list[tuple[float, float, float, float]]:
    out, now, start = [], 0j, 0j
    for kind, *points in path:
        points = [complex(*p) for p in points]
        if kind == "M":
            now = start = points[0]
            continue
        for to in [start] if kind == "Z" else points if kind == "L" else _chords([now, *points]):
            out.append((now.real, now.imag, to.real, to.imag))
            now = to
    return out


def edge_rows(d, path: list) -> str:
    """A path's edges as a relation e(x0, y0, x1, y1)."""
    rows = ", ".join(f"({', '.join(d.num(v) for v in e)})" for e in edges(path))
    return f"(VALUES {rows}) AS e(x0, y0, x1, y1)"


def painted(d, r: str, outline: str, colour: str, antialiased: bool = True, source: str = "") -> str:
    """Rows of a raster with a colour inside an outline e(x0, y0, x1, y1) by the even-odd rule.

    colour is an expression in r.x, r.y and r.band, and in what `source` joins to r.
    """
    lines = 4 if antialiased else 1
    scans = f"(SELECT s.image_id, s.y, k.k, s.y + (k.k + 5e-1) / {lines} AS scan FROM {d.expand(size_of(r), 'h', 'y')} s CROSS JOIN {d.series(0, lines, 'k')} k)"
    crossings = (f"(SELECT s.image_id, s.y, s.k, round(e.x0 + (s.scan - e.y0) / (e.y1 - e.y0) * (e.x1 - e.x0), 9) AS x FROM {scans} s JOIN {outline} "
                 f"ON (e.y0 <= s.scan AND e.y1 > s.scan) OR (e.y1 <= s.scan AND e.y0 > s.scan))")
    over = "OVER (PARTITION BY image_id, y, k ORDER BY x)"
    spans = f"(SELECT image_id, y, a, b FROM (SELECT image_id, y, x AS a, lead(x) {over} AS b, row_number() {over} AS n FROM {crossings} c) t WHERE n % 2 = 1 AND b IS NOT NULL)"
    if antialiased:
        share = f"(SELECT p.image_id, p.x, p.y, round(sum(greatest(0e0, least(p.x + 1, s.b) - greatest(p.x, s.a))), 9) / {lines} AS cover FROM (SELECT DISTINCT image_id, x, y FROM {r}) p JOIN {spans} s ON s.image_id = p.image_id AND s.y = p.y AND p.x <= s.b AND p.x + 1 >= s.a GROUP BY p.image_id, p.x, p.y)"
    else:
        share = f"(SELECT DISTINCT p.image_id, p.x, p.y, 1e0 AS cover FROM {r} p JOIN {spans} s ON s.image_id = p.image_id AND s.y = p.y AND p.x >= ceil(s.a - 5e-1) AND p.x <= floor(s.b - 5e-1))"
    mixed = d.rint(f"round(r.v * (1 - c.cover) + {colour} * c.cover, 9)")
    return (f"SELECT {', '.join(f'r.{k}' for k in KEY.split(', '))}, CASE WHEN c.cover IS NULL OR c.cover <= 0 THEN r.v WHEN c.cover >= 999e-3 THEN {colour} ELSE {mixed} END AS v "
            f"FROM {r} r {source} LEFT JOIN {share} c ON c.image_id = r.image_id AND c.x = r.x AND c.y = r.y")


def _filled(d, r: str, path: list, ink, antialiased: bool) -> str:
    return painted(d, r, edge_rows(d, path), _ink(d, ink).replace("band", "r.band"), antialiased)


@operator(1)
def fill_path(d, r, path=(("M", (2, 3)), ("C", (20, 0), (22, 30), (10, 28)), ("Q", (0, 20), (2, 3)), ("Z",)), ink=(255, 0, 0), antialiased: bool = True):
    """Ink inside a path by the even-odd rule; with four scan lines a row and exact shares along x, or by the pixels' middles."""
    return _filled(d, r, list(path), ink, antialiased)


@operator(1)
def fill_polygon(d, r, points=((3, 2), (18, 9), (11, 30), (4, 18)), ink=(0, 255, 0)):
    return _filled(d, r, polygon(*points), ink, True)


@operator(1)
def fill_rectangle(d, r, x: float = 3.25, y: float = 4.5, w: float = 9.5, h: float = 20.0, ink=(0, 0, 255)):
    return _filled(d, r, rectangle(x, y, w, h), ink, True)


@operator(1)
def fill_circle(d, r, cx: float = 10.0, cy: float = 40.0, radius: float = 7.5, ink=(255, 255, 0)):
    return _filled(d, r, circle(cx, cy, radius), ink, True)


@operator(1)
def stroke_line(d, r, x1: float = 2.0, y1: float = 5.0, x2: float = 18.0, y2: float = 60.0, width: float = 3.0, ink=(255, 0, 255)):
    """A straight line of some width with butt ends."""
    return _filled(d, r, band(x1, y1, x2, y2, width), ink, True)
