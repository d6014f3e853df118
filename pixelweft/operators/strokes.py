"""Stroked paths: outlines of polylines as relations of points, with joins, caps and dashes.

Polylines are rows (path_id, part, seq, x, y, closed); any number of paths is outlined at once. An open part becomes one ring, along
its right side and back on its left; a closed part two rings, its right and its left side, between which the even-odd rule fills. Of
each vertex and side a row says how many points it gives; these are multiplied and placed. Rings are rows (path_id, part, ring, seq, x, y).

Parts of closed paths are stroked along their closing edge too, a round cap at the beginning goes round the back of the line, and round
joins go the short way round.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from ..plans.sqlop import operator
from . import paths
from .draw import _ink

#: Chords of the half circle of a cap, and of half a turn of a round join. Fixed values.
CAP_STEPS, JOIN_STEPS = 16, 8


@dataclass(frozen=True)
class Pen:
    width: float = 3.0
    cap: str = "butt"  # butt, square, round
    join: str = "bevel"  # bevel, miter, round
    miter_limit: float = 4.0
    dashes: tuple = ()
    dash_offset: float = 0.0

    def __post_init__(self):
        if self.width <= 0 or self.miter_limit < 1 or self.cap not in ("butt", "square", "round") or self.join not in ("bevel", "miter", "round"):
            raise ValueError("a pen has a width above 0, a miter limit of 1 or more, and a known cap and join")
        if self.dashes and (min(self.dashes) < 0 or sum(self.dashes) <= 0):
            raise ValueError("dashes are not negative, and one of them is above 0")


def polylines(path: list) -> list[tuple[list[tuple[float, float]], bool]]:
    """(points, closed) of the parts of a path that have two points or more, curves cut into chords."""
    out, points = [], []

    def end(closed):
        if len(points) > 1:
            out.append(([(p.real, p.imag) for p in points], closed))
        points.clear()

    for kind, *args in path:
        args = [complex(*p) for p in args]
        if kind == "M":
            end(False)
            points.append(args[0])
        elif kind == "Z":
            start = points[:1]
            end(True)
            points += start
        else:
            points += args if kind == "L" else paths._chords([points[-1], *args])
    end(False)
    return out


def polyline_rows(d, path: list) -> str:
    rows = [f"(0, {part}, {i}, {d.num(x)}, {d.num(y)}, {int(closed)})" for part, (points, closed) in enumerate(polylines(path)) for i, (x, y) in enumerate(points)]
    return f"(SELECT * FROM (VALUES {', '.join(rows)}) AS t(path_id, part, seq, x, y, closed))"


def _over(frame: str = "", by: str = "seq") -> str:
    return f"OVER (PARTITION BY path_id, part ORDER BY {by}{frame})"


def dashed(d, lines: str, dashes, offset: float) -> str:
    """Subquery of the polylines cut by arc length: an open part for each dash, in the form of polylines.

    Lengths are running sums over segments, so a dash is an interval of them; its ends lie in the segments that a join on the
    interval finds, and the vertices between them stay. A dash pattern of odd length is taken twice over.
    """
    pattern = list(dashes) * (2 if len(dashes) % 2 else 1)
    cycle, at, on = sum(pattern), 0.0, []
    phase = offset % sum(dashes)
    for k, length in enumerate(pattern):
        if k % 2 == 0 and length > 1e-12:
            on.append((at, at + length))
        at += length
    rows = ", ".join(f"({k}, {d.num(a)}, {d.num(b)})" for k, (a, b) in enumerate(on))
    closing = f"(SELECT path_id, part, seq, x, y FROM {lines} l UNION ALL SELECT path_id, part, max(seq) + 1 AS seq, max(CASE WHEN seq = 0 THEN x END) AS x, max(CASE WHEN seq = 0 THEN y END) AS y FROM {lines} l WHERE closed = 1 GROUP BY path_id, part)"
    steps = f"(SELECT path_id, part, seq, x, y, lead(x) {_over()} AS x2, lead(y) {_over()} AS y2 FROM {closing} c)"
    sized = f"(SELECT path_id, part, seq, x, y, x2, y2, CASE WHEN x2 IS NULL THEN 0e0 ELSE sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) END AS length FROM {steps} s)"
    # Lengths so far are rounded once and a segment ends where the next one begins, so that no place is in two segments or in none.
    summed = f"(SELECT path_id, part, seq, x, y, x2, y2, length, round(coalesce(sum(length) {_over(' ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING')}, 0e0), 9) AS far FROM {sized} z)"
    along = f"(SELECT path_id, part, seq, x, y, x2, y2, length, far, coalesce(lead(far) {_over()}, far) AS till FROM {summed} m)"
    whole = f"(SELECT path_id, part, max(till) AS total, CAST(floor((max(till) + {d.num(phase)}) / {d.num(cycle)}) AS INT) + 1 AS cycles FROM {along} z GROUP BY path_id, part)"
    spans = (f"(SELECT w.path_id, w.part, w.c * {len(on)} + o.k AS dash, greatest(0e0, w.c * {d.num(cycle)} + o.a - {d.num(phase)}) AS a, least(w.total, w.c * {d.num(cycle)} + o.b - {d.num(phase)}) AS b "
             f"FROM {d.expand(whole, 'cycles', 'c')} w CROSS JOIN (VALUES {rows}) AS o(k, a, b))")
    spans = f"(SELECT * FROM {spans} s WHERE b - a > 1e-9)"

    def point(end):
        return ", ".join(f"l.{c} + (l.{c}2 - l.{c}) * ((s.{end} - l.far) / l.length) AS {c}" for c in "xy")

    key = "s.path_id = l.path_id AND s.part = l.part"
    first = f"SELECT s.path_id, s.part, s.dash, -1e0 AS place, {point('a')} FROM {spans} s JOIN {along} l ON {key} AND l.far <= s.a AND s.a < l.till"
    middle = f"SELECT s.path_id, s.part, s.dash, l.far AS place, l.x, l.y FROM {spans} s JOIN {along} l ON {key} AND l.far > s.a + 1e-9 AND l.far < s.b - 1e-9 AND (l.till > l.far OR l.x2 IS NULL)"
    last = f"SELECT s.path_id, s.part, s.dash, 1e300 AS place, {point('b')} FROM {spans} s JOIN {along} l ON {key} AND l.far < s.b AND s.b <= l.till"
    return (f"(SELECT path_id, CAST(part AS BIGINT) * 1000000 + dash AS part, CAST(row_number() OVER (PARTITION BY path_id, part, dash ORDER BY place) AS INT) - 1 AS seq, x, y, 0 AS closed "
            f"FROM ({first} UNION ALL {middle} UNION ALL {last}) p)")


def outline(d, lines: str, pen: Pen) -> str:
    """Subquery of the rings around polylines."""
    if pen.dashes:
        lines = dashed(d, lines, pen.dashes, pen.dash_offset)
    half = d.num(pen.width / 2)
    # Each vertex with the directions of the segments before and after it; ends of open parts have one.
    beside = f"(SELECT path_id, part, seq, closed, x, y, {', '.join(f'{f}({c}) {_over()} AS {n}{c}' for f, n in (('lag', 'p'), ('lead', 'n')) for c in 'xy')}, first_value(x) {_over()} AS fx, first_value(y) {_over()} AS fy, last_value(x) {_over(' ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING')} AS ex, last_value(y) {_over(' ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING')} AS ey FROM {lines} l)"
    wrap = {c: f"CASE WHEN closed = 1 THEN {c} END" for c in ("fx", "fy", "ex", "ey")}
    steps = f"(SELECT path_id, part, seq, closed, x, y, x - coalesce(px, {wrap['ex']}) AS dx0, y - coalesce(py, {wrap['ey']}) AS dy0, coalesce(nx, {wrap['fx']}) - x AS dx1, coalesce(ny, {wrap['fy']}) - y AS dy1 FROM {beside} b)"
    sized = f"(SELECT s.*, sqrt(dx0 * dx0 + dy0 * dy0) AS l0, sqrt(dx1 * dx1 + dy1 * dy1) AS l1 FROM {steps} s)"
    unit = ", ".join(f"CASE WHEN l{k} < 1e-9 THEN 0e0 ELSE d{c}{k} / l{k} END AS f{c}{k}" for k in (0, 1) for c in "xy")
    ways = f"(SELECT path_id, part, seq, closed, x, y, {unit} FROM {sized} z)"  # the normal to the right of (fx, fy) is (fy, -fx)
    turns = f"(SELECT w.*, fx0 * fy1 - fy0 * fx1 AS turn, fx0 * fx1 + fy0 * fy1 AS cosine FROM {ways} w)"
    sides = f"(SELECT t.*, s.side, s.side * (CASE WHEN turn > 0 THEN 1 ELSE -1 END) AS outer_ FROM {turns} t CROSS JOIN (VALUES (1), (-1)) AS s(side))"
    miter = f"outer_ = 1 AND 1 + cosine >= 1e-9 AND sqrt(2 / greatest(1e-12, 1 + cosine)) <= {d.num(pen.miter_limit)}"
    kind = "CASE WHEN fx0 IS NULL THEN 'start' WHEN fx1 IS NULL THEN 'end' ELSE 'join' END"
    arc = "acos(greatest(-1e0, least(1e0, cosine)))"
    caps = {"start": CAP_STEPS if pen.cap == "round" else 1, "end": CAP_STEPS if pen.cap == "round" else 1}
    joins = {"bevel": "2", "miter": f"CASE WHEN {miter} THEN 1 ELSE 2 END",
             "round": f"CASE WHEN outer_ = 1 THEN greatest(1, CAST(ceil(round({arc} * {JOIN_STEPS} / {d.num(math.pi)}, 9)) AS INT)) + 1 ELSE 2 END"}[pen.join]
    # The arcs of round caps lie on the left at the start, on the right at the end, and leave out the other side's base.
    counted = (f"(SELECT s.*, {kind} AS kind, CASE {kind} WHEN 'start' THEN CASE side WHEN -1 THEN {caps['start']} ELSE 1 END WHEN 'end' THEN CASE side WHEN 1 THEN {caps['end']} ELSE 1 END "
               f"ELSE {joins} END AS points FROM {sides} s)")
    rows = d.expand(counted, "points", "k")
    normal = {0: ("fy0", "-fx0"), 1: ("fy1", "-fx1")}

    def cap(end: str, axis: int) -> str:
        which, back = (1, -1) if end == "start" else (0, 1)
        n, f = normal[which][axis], ("fx", "fy")[axis] + str(which)
        base = f"side * ({n}) * {half}"
        if pen.cap == "square":
            return f"{base} + {back} * {f} * {half}"
        if pen.cap == "round":
            # From this side's base round the end, to one step before the other's.
            turn = f"k * {d.num(math.pi / CAP_STEPS)}"
            return f"(side * ({n}) * cos({turn}) + {back} * {f} * sin({turn})) * {half}"
        return base

    def join(axis: int) -> str:
        n0, n1 = normal[0][axis], normal[1][axis]
        bevel = f"side * (CASE k WHEN 0 THEN {n0} ELSE {n1} END) * {half}"
        if pen.join == "miter":
            return f"CASE WHEN points = 1 THEN side * ({n0} + {n1}) * {half} / (1 + cosine) ELSE {bevel} END"
        if pen.join == "round":
            a, b = normal[0]
            swept = f"(k * {arc} / (points - 1)) * (CASE WHEN turn > 0 THEN 1 ELSE -1 END)"
            turned = f"({a}) * cos({swept}) - ({b}) * sin({swept})" if axis == 0 else f"({a}) * sin({swept}) + ({b}) * cos({swept})"
            return f"CASE WHEN outer_ = 1 THEN side * ({turned}) * {half} ELSE {bevel} END"
        return bevel

    at = {c: f"{c} + CASE kind WHEN 'start' THEN {cap('start', i)} WHEN 'end' THEN {cap('end', i)} ELSE {join(i)} END" for i, c in enumerate("xy")}
    # Right sides go forward and left sides back; of a closed part each is a ring by itself.
    order = "CASE WHEN side = 1 THEN seq ELSE 2000000000 - seq END, CASE WHEN side = 1 OR kind = 'start' THEN k ELSE -k END"
    placed = f"(SELECT path_id, part, CASE WHEN closed = 1 AND side = -1 THEN 1 ELSE 0 END AS ring, {order.split(', CASE')[0]} AS o1, CASE{order.split(', CASE')[1]} AS o2, {', '.join(f'{e} AS {c}' for c, e in at.items())} FROM {rows} q)"
    return f"(SELECT path_id, part, ring, CAST(row_number() OVER (PARTITION BY path_id, part, ring ORDER BY o1, o2) AS INT) - 1 AS seq, x, y FROM {placed} g)"


def ring_edges(rings: str) -> str:
    """Subquery (path_id, x0, y0, x1, y1) of rings, each closed."""
    by = "PARTITION BY path_id, part, ring ORDER BY seq"
    return f"(SELECT path_id, x AS x0, y AS y0, coalesce(lead(x) OVER ({by}), first_value(x) OVER ({by})) AS x1, coalesce(lead(y) OVER ({by}), first_value(y) OVER ({by})) AS y1 FROM {rings} r)"


@operator(1)
def stroke_outlines(d, lines, pen: Pen = Pen()):
    """Rings (path_id, part, ring, seq, x, y) around all the polylines of a table (path_id, part, seq, x, y, closed)."""
    return f"SELECT path_id, part, ring, seq, x, y FROM {outline(d, f'{lines}', pen)} o"


@operator(1)
def ring_areas(d, rings):
    """(path_id, part, ring, area): the signed area of each ring, by its edges."""
    by = "PARTITION BY path_id, part, ring ORDER BY seq"
    ends = f"(SELECT path_id, part, ring, x, y, coalesce(lead(x) OVER ({by}), first_value(x) OVER ({by})) AS x1, coalesce(lead(y) OVER ({by}), first_value(y) OVER ({by})) AS y1 FROM {rings} r)"
    return f"SELECT path_id, part, ring, sum(x * y1 - x1 * y) / 2 AS area FROM {ends} e GROUP BY path_id, part, ring"


def _stroked(d, r: str, path: list, pen: Pen, ink, antialiased: bool) -> str:
    rings = ring_edges(outline(d, polyline_rows(d, path), pen))
    return paths.painted(d, r, f"{rings} e", _ink(d, ink).replace("band", "r.band"), antialiased)


ZIGZAG = (("M", (2, 4)), ("L", (17, 12)), ("L", (4, 30)), ("C", (10, 20), (20, 60), (15, 70)))


@operator(1)
def stroke_path(d, r, path=ZIGZAG, pen: Pen = Pen(cap="round", join="round"), ink=(255, 0, 255), antialiased: bool = True):
    """Ink along a path: its outline filled by the even-odd rule."""
    return _stroked(d, r, list(path), pen, ink, antialiased)


@operator(1)
def stroke_rectangle(d, r, x: float = 3.5, y: float = 6.0, w: float = 12.0, h: float = 40.0, pen: Pen = Pen(2.5, join="miter"), ink=(0, 255, 255)):
    return _stroked(d, r, paths.rectangle(x, y, w, h), pen, ink, True)


@operator(1)
def stroke_circle(d, r, cx: float = 10.0, cy: float = 40.0, radius: float = 7.0, pen: Pen = Pen(2.0), ink=(255, 255, 0)):
    return _stroked(d, r, paths.circle(cx, cy, radius), pen, ink, True)


@operator(1)
def stroke_polygon(d, r, points=((3, 2), (18, 9), (11, 60), (4, 18)), pen: Pen = Pen(2.0, "square", "bevel", dashes=(6.0, 3.0, 1.0), dash_offset=2.5), ink=(0, 0, 255)):
    return _stroked(d, r, paths.polygon(*points), pen, ink, True)
