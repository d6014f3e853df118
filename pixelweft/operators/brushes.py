"""Brushes: what a filled path is painted with, as a function of the place. Colours are tuples by band.

Each function gives a callable that writes an expression in r.x, r.y and r.band. Image brushes read a second raster by wrapped places.
"""

from __future__ import annotations

from collections.abc import Callable

from ..plans.sqlop import operator
from . import paths
from .draw import _ink

Brush = Callable[[object], str]


def _by_band(values: list[str]) -> str:
    return "CASE r.band " + " ".join(f"WHEN {b} THEN {v}" for b, v in enumerate(values)) + f" ELSE {values[-1]} END"


def solid(colour) -> Brush:
    return lambda d: _ink(d, colour).replace("band", "r.band")


def _between(d, start, end, t: str) -> str:
    if len(start) != len(end):
        raise ValueError("the colours of a gradient have as many bands")
    return _by_band([d.rint(f"round({d.num(a)} + {d.num(b - a)} * {t}, 9)") for a, b in zip(start, end)])


def linear_gradient(x0: float, y0: float, x1: float, y1: float, start, end) -> Brush:
    """From start to end along a line, as it is beyond its ends."""
    dx, dy = x1 - x0, y1 - y0
    length = dx * dx + dy * dy

    def write(d):
        t = f"greatest(0e0, least(1e0, ((r.x - {d.num(x0)}) * {d.num(dx)} + (r.y - {d.num(y0)}) * {d.num(dy)}) / {d.num(length)}))" if length > 0 else "0e0"
        return _between(d, start, end, t)

    return write


def radial_gradient(cx: float, cy: float, radius: float, centre, edge) -> Brush:
    """From the centre's colour to the edge's, which goes on outside."""
    if radius <= 0:
        raise ValueError("a radius is above 0")
    return lambda d: _between(d, centre, edge, f"least(1e0, sqrt((r.x - {d.num(cx)}) * (r.x - {d.num(cx)}) + (r.y - {d.num(cy)}) * (r.y - {d.num(cy)})) / {d.num(radius)})")


def path_gradient(vertices, colours, centre=None) -> Brush:
    """A fan of triangles from the mean of the vertices, with the centre's colour, to each edge; outside it is the centre's colour.

    Without a colour the centre has the mean of the vertices', rounded half to even.
    """
    n = len(vertices)
    if n < 3 or len(colours) != n or len({len(c) for c in [*colours, *([centre] if centre else [])]}) != 1:
        raise ValueError("a path gradient has three vertices or more, each with a colour of as many bands")
    centre = tuple(round(sum(c[b] for c in colours) / n) for b in range(len(colours[0]))) if centre is None else tuple(centre)
    ax, ay = sum(x for x, _ in vertices) / n, sum(y for _, y in vertices) / n

    def write(d):
        cases = []
        for i in range(n):
            (bx, by), (cx, cy) = vertices[i], vertices[(i + 1) % n]
            whole = (by - cy) * (ax - cx) + (cx - bx) * (ay - cy)
            if abs(whole) < 1e-12:
                continue
            px, py = f"(r.x - {d.num(cx)})", f"(r.y - {d.num(cy)})"
            u = f"({d.num(by - cy)} * {px} + {d.num(cx - bx)} * {py}) / {d.num(whole)}"
            v = f"({d.num(cy - ay)} * {px} + {d.num(ax - cx)} * {py}) / {d.num(whole)}"
            mixed = _by_band([f"greatest(0e0, least(255e0, {d.rint(f'round({u} * {d.num(centre[b])} + {v} * {d.num(colours[i][b])} + (1 - {u} - {v}) * {d.num(colours[(i + 1) % n][b])}, 9)')}))" for b in range(len(centre))])
            cases.append(f"WHEN {u} >= -1e-9 AND {v} >= -1e-9 AND 1 - {u} - {v} >= -1e-9 THEN {mixed}")
        outside = _by_band([d.num(v) for v in centre])
        return f"CASE {' '.join(cases)} ELSE {outside} END" if cases else outside

    return write


def wrapped(v: str, size: str, tiling: str) -> str:
    """A place within 0 .. size - 1: clamped, repeated or mirrored."""
    if tiling == "clamp":
        return f"greatest(0, least({size} - 1, {v}))"
    whole = f"({v} - {size} * CAST(floor({v} / ({size} * 1e0)) AS INT))"
    if tiling == "repeat":
        return whole
    if tiling == "mirror":
        double = f"({v} - 2 * {size} * CAST(floor({v} / (2e0 * {size})) AS INT))"
        return f"CASE WHEN {double} < {size} THEN {double} ELSE 2 * {size} - 1 - {double} END"
    raise ValueError(f"no tiling {tiling}")


@operator(1)
def fill(d, r, brush: Brush = solid((250, 10, 10)), path=None, antialiased: bool = True):
    """A path (by default the whole image and more) filled with a brush by the even-odd rule, antialiased by shares of cover."""
    if path is None:
        colour = brush(d)
        return f"SELECT r.image_id, r.x, r.y, r.band, CAST({colour} AS DOUBLE) AS v FROM {r} r"
    return paths.painted(d, r, paths.edge_rows(d, list(path)), brush(d), antialiased)


@operator(2)
def fill_image(d, r, source, path=None, offset: tuple[int, int] = (0, 0), tiling: str = "clamp", antialiased: bool = True):
    """A path filled with the pixels of another raster's image of the same number, placed at an offset; `repeat` makes it a pattern.

    Where the source has fewer bands or no such image, pixels stay as they are.
    """
    path = list(path or paths.rectangle(0, 0, 1 << 20, 1 << 20))
    place = [wrapped(f"(q.{c} - {o})", f"s.{w}", tiling) for c, o, w in (("x", offset[0], "w"), ("y", offset[1], "h"))]
    sizes = f"(SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM {source} GROUP BY image_id)"
    # Wrapped places are a column, so that the join on them is one of equal keys.
    mapped = (f"(SELECT q.image_id, q.x, q.y, q.band, b.v AS paint FROM (SELECT q.image_id, q.x, q.y, q.band, {place[0]} AS sx, {place[1]} AS sy FROM {r} q JOIN {sizes} s ON s.image_id = q.image_id) q "
              f"JOIN {source} b ON b.image_id = q.image_id AND b.x = q.sx AND b.y = q.sy AND b.band = q.band)")
    return paths.painted(d, r, paths.edge_rows(d, path), "coalesce(b.paint, r.v)", antialiased,
                         f"LEFT JOIN {mapped} b ON b.image_id = r.image_id AND b.x = r.x AND b.y = r.y AND b.band = r.band")
