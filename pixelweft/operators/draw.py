"""Drawing and compositing: joins of an overlay, or predicates on the place."""

from __future__ import annotations

import math

from ..plans.sqlop import KEY, operator, pel, unpel
from .stencil import nine


def _ink(d, ink) -> str:
    return "CASE band " + " ".join(f"WHEN {b} THEN {d.num(v)}" for b, v in enumerate(ink)) + f" ELSE {d.num(ink[-1])} END"


@operator(1)
def draw_rect(d, r, left: int = 3, top: int = 4, width: int = 10, height: int = 20, ink=(255, 0, 0), fill: bool = True):
    box = f"x >= {left} AND x < {left + width} AND y >= {top} AND y < {top + height}"
    if not fill:
        box += f" AND (x = {left} OR x = {left + width - 1} OR y = {top} OR y = {top + height - 1})"
    return f"SELECT {KEY}, CASE WHEN {box} THEN {_ink(d, ink)} ELSE v END AS v FROM {r}"


@operator(1)
def draw_circle(d, r, cx: int = 10, cy: int = 50, radius: int = 8, ink=(255, 0, 0), fill: bool = True):
    if fill:
        inside = f"abs(y - {cy}) <= {radius} AND abs(x - {cx}) <= floor(sqrt(greatest(0e0, {radius * radius} - (y - {cy}) * (y - {cy}))))"
        return f"SELECT {KEY}, CASE WHEN {inside} THEN {_ink(d, ink)} ELSE v END AS v FROM {r}"
    from .analysis import circle_points
    rows = ", ".join(f"({cx + x}, {cy + y})" for x, y in sorted(set(circle_points(radius))))
    return f"SELECT {', '.join(f'r.{k}' for k in KEY.split(', '))}, CASE WHEN o.px IS NOT NULL THEN {_ink(d, ink).replace('band', 'r.band')} ELSE r.v END AS v FROM {r} r LEFT JOIN (VALUES {rows}) AS o(px, py) ON o.px = r.x AND o.py = r.y"


def line_cover(x1: int, y1: int, x2: int, y2: int) -> dict[tuple[int, int], list[float]]:
    """Pixels of an antialiased line and how much of each is covered, in the order they are drawn.

    Lines along an axis cover their pixels wholly. Others go along their longer axis, and share each step between the two
    pixels beside the line by its distance; the ends count a half.
    """
    out: dict[tuple[int, int], list[float]] = {}
    if x1 == x2 or y1 == y2:
        return {(x, y): [1.0] for x in range(min(x1, x2), max(x1, x2) + 1) for y in range(min(y1, y2), max(y1, y2) + 1)}
    steep = abs(y2 - y1) > abs(x2 - x1)
    (a1, b1), (a2, b2) = sorted([(y1, x1), (y2, x2)] if steep else [(x1, y1), (x2, y2)])
    slope = (b2 - b1) / (a2 - a1)

    def put(a: int, b: float, share: float) -> None:
        low = math.floor(b)
        for at, part in ((low, 1 - (b - low)), (low + 1, b - low)):
            out.setdefault((at, a) if steep else (a, at), []).append(part * share)

    put(a1, b1, 0.5)
    put(a2, b2, 0.5)
    across = b1 + slope
    for a in range(a1 + 1, a2):
        put(a, across, 1.0)
        across += slope
    return out


@operator(1)
def draw_line(d, r, x1: int = 2, y1: int = 3, x2: int = 17, y2: int = 40, ink=(255, 0, 0)):
    """An antialiased line, truncated after each blending."""
    cover = line_cover(x1, y1, x2, y2)
    most = max(map(len, cover.values()))
    rows = ", ".join(f"({x}, {y}, {', '.join(d.num(c) for c in (*cs, *[0.0] * (most - len(cs))))})" for (x, y), cs in cover.items())
    ink_ = _ink(d, ink).replace("band", "r.band")
    e = "r.v"
    for k in range(most):
        e = f"floor(round({e} * (1 - o.c{k}) + {ink_} * o.c{k}, 9))"
    names = ", ".join(f"c{k}" for k in range(most))
    return f"SELECT {', '.join(f'r.{k}' for k in KEY.split(', '))}, CASE WHEN o.px IS NOT NULL THEN {e} ELSE r.v END AS v FROM {r} r LEFT JOIN (VALUES {rows}) AS o(px, py, {names}) ON o.px = r.x AND o.py = r.y"


@operator(1)
def clear(d, r, color=(10, 20, 30)):
    return f"SELECT {KEY}, {_ink(d, color)} AS v FROM {r}"


@operator(2)
def draw_mask(d, r, mask, x: int = 2, y: int = 3, ink=(255, 0, 0)):
    """Ink where the one-band mask, placed at (x, y), is not 0; blended by its value, with an arithmetic shift."""
    e = f"CASE WHEN m.v IS NULL OR m.v = 0 THEN r.v WHEN m.v = 255 THEN {_ink(d, ink).replace('band', 'r.band')} ELSE r.v + floor(m.v * ({_ink(d, ink).replace('band', 'r.band')} - r.v) / 256e0) END"
    return (f"SELECT {', '.join(f'r.{k}' for k in KEY.split(', '))}, {e} AS v FROM {r} r LEFT JOIN (SELECT image_id, x + {x} AS x, y + {y} AS y, v FROM {mask}) m "
            f"ON m.image_id = r.image_id AND m.x = r.x AND m.y = r.y")


@operator(1)
def draw_smudge(d, r, x: int = 4, y: int = 5, width: int = 8, height: int = 9):
    """3 x 3 means inside a rectangle."""
    total = " + ".join(f"p{i}{j}" for i in range(3) for j in range(3))
    return f"SELECT {KEY}, CASE WHEN x >= {x} AND x < {x + width} AND y >= {y} AND y < {y + height} THEN {d.div(f'{total} + 4', '9e0')} ELSE v END AS v FROM {nine(d, r)} p"


#: Mode -> (Fa, Fb) of the alphas s of the overlay and b of the base
PORTER_DUFF = {
    "clear": ("0", "0"), "source": ("1", "0"), "dest": ("0", "1"), "over": ("1", "(1 - s)"), "dest_over": ("(1 - b)", "1"), "in": ("b", "0"), "dest_in": ("0", "s"),
    "out": ("(1 - b)", "0"), "dest_out": ("0", "(1 - s)"), "atop": ("b", "(1 - s)"), "dest_atop": ("(1 - b)", "s"), "xor": ("(1 - b)", "(1 - s)"), "add": ("1", "1"),
}


@operator(2)
def composite(d, base, overlay, mode: str = "over", x: int = 0, y: int = 0):
    """RGBA over RGBA by Porter and Duff; base pixels that the overlay does not cover stay."""
    fa, fb = PORTER_DUFF[mode]
    cols = ", ".join([*(f"b.v{i} AS b{i}" for i in range(4)), *(f"o.v{i} AS o{i}" for i in range(4))])
    both = f"(SELECT b.image_id, b.x, b.y, {cols}, o.v3 / 255e0 AS s, b.v3 / 255e0 AS b FROM {pel(base, 4)} b LEFT JOIN {pel(overlay, 4)} o ON o.image_id = b.image_id AND o.x + {x} = b.x AND o.y + {y} = b.y)"
    if mode == "add":
        color = [d.rint(f"least(1e0, s * o{i} / 255e0 + b * b{i} / 255e0) * 255") for i in range(3)]
        alpha = d.rint("least(1e0, s + b) * 255")
    else:
        a = f"({fa} * s + {fb} * b)"
        color = [f"CASE WHEN {a} > 0 THEN {d.rint(f'greatest(0e0, least(1e0, ({fa} * s * o{i} / 255e0 + {fb} * b * b{i} / 255e0) / (CASE WHEN {a} > 0 THEN {a} ELSE 1e0 END))) * 255')} ELSE 0e0 END" for i in range(3)]
        alpha = d.rint(f"greatest(0e0, least(1e0, {a})) * 255")
    return unpel(both, [f"CASE WHEN s IS NULL THEN b{i} ELSE {e} END" for i, e in enumerate([*color, alpha])])


#: Mode -> blend of base b and overlay s, both 0..1
BLENDS = {
    "normal": "s", "multiply": "b * s", "screen": "1 - (1 - b) * (1 - s)", "overlay": "CASE WHEN b < 5e-1 THEN 2 * b * s ELSE 1 - 2 * (1 - b) * (1 - s) END",
    "darken": "least(b, s)", "lighten": "greatest(b, s)", "hard_light": "CASE WHEN s < 5e-1 THEN 2 * b * s ELSE 1 - 2 * (1 - b) * (1 - s) END",
    "soft_light": "(1 - 2 * s) * b * b + 2 * s * b", "difference": "abs(b - s)", "exclusion": "b + s - 2 * b * s", "add": "least(1e0, b + s)",
    "subtract": "greatest(0e0, b - s)", "color_dodge": "CASE WHEN s >= 1 THEN 1e0 ELSE least(1e0, b / (CASE WHEN s >= 1 THEN 1e0 ELSE 1 - s END)) END",
}


@operator(2)
def composite_blend(d, base, overlay, mode: str = "multiply", opacity: float = 1.0):
    """Blend two three-band images band by band, then lay the result over the base with an opacity."""
    both = f"(SELECT l.image_id, l.x, l.y, l.band, l.v AS bv, l.v / 255e0 AS b, q.v / 255e0 AS s FROM {base} l JOIN {overlay} q ON l.image_id = q.image_id AND l.x = q.x AND l.y = q.y AND l.band = q.band)"
    e = d.u8_round(f"({BLENDS[mode]}) * 255")
    return f"SELECT {KEY}, {d.u8_round(f'{e} * {d.num(opacity)} + bv * {d.num(1 - opacity)}')} AS v FROM {both} p"
