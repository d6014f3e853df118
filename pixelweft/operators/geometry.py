"""Geometry and mosaicing: coordinates are projected, joined or exploded; values are not touched unless resampled."""

from __future__ import annotations

import math

from ..plans.sqlop import KEY, canvas, operator, size_of, sized


@operator(1)
def extract_area(d, r, left: int = 2, top: int = 3, width: int = 10, height: int = 12):
    return f"SELECT image_id, x - {left} AS x, y - {top} AS y, band, v FROM {r} WHERE x >= {left} AND x < {left + width} AND y >= {top} AND y < {top + height}"


def _moved(r: str, x: str, y: str) -> str:
    """Pixels at new coordinates, expressions over x, y, w and h."""
    return f"SELECT image_id, {x} AS x, {y} AS y, band, v FROM {sized(r)} q"


@operator(1)
def flip(d, r, vertical: bool = False):
    return _moved(r, "x", "h - 1 - y") if vertical else _moved(r, "w - 1 - x", "y")


@operator(1)
def rotate90(d, r, angle: int = 90):
    """By 90, 180 or 270 degrees clockwise."""
    return _moved(r, *{90: ("h - 1 - y", "x"), 180: ("w - 1 - x", "h - 1 - y"), 270: ("y", "w - 1 - x")}[angle])


@operator(1)
def auto_orient(d, r, orientation: int = 6):
    """Undo an EXIF orientation 1..8."""
    w, h = "w - 1", "h - 1"
    return _moved(r, *{1: ("x", "y"), 2: (f"{w} - x", "y"), 3: (f"{w} - x", f"{h} - y"), 4: ("x", f"{h} - y"), 5: ("y", "x"), 6: (f"{h} - y", "x"), 7: (f"{h} - y", f"{w} - x"), 8: ("y", f"{w} - x")}[orientation])


@operator(1)
def shrink(d, r, across: int = 2, down: int = 3, real: bool = False):
    """Block means, whole blocks only; 8-bit sums are divided and truncated."""
    return f"SELECT {KEY}, v FROM {shrunk(f'(SELECT q.*, {across} AS fx, {down} AS fy FROM {sized(r)} q)', real)} b"


def shrunk(r: str, real: bool = False) -> str:
    """Subquery of the means of blocks of fx by fy pixels, of rows with x, y, w, h, fx and fy."""
    bx, by = (f"CAST(floor({c} / CAST({f} AS DOUBLE)) AS INT)" for c, f in (("x", "fx"), ("y", "fy")))
    e = "sum(v) / max(fx * fy)"
    return f"(SELECT image_id, {bx} AS x, {by} AS y, band, {e if real else f'floor({e})'} AS v FROM {r} q WHERE x < w - w % fx AND y < h - h % fy GROUP BY image_id, {bx}, {by}, band)"


@operator(1)
def zoom(d, r, across: int = 2, down: int = 2):
    return (f"SELECT image_id, x * {across} + i AS x, y * {down} + j AS y, band, v FROM {r} CROSS JOIN {d.series(0, across, 'i')} a CROSS JOIN {d.series(0, down, 'j')} b")


@operator(1)
def pixelate(d, r, size: int = 4):
    """Block means spread over their blocks again."""
    return zoom.write(d, f"({shrink.write(d, r, across=size, down=size)})", across=size, down=size)


@operator(1)
def replicate(d, r, across: int = 2, down: int = 2):
    return f"SELECT image_id, x + i * w AS x, y + j * h AS y, band, v FROM {sized(r)} q CROSS JOIN {d.series(0, across, 'i')} a CROSS JOIN {d.series(0, down, 'j')} b"


@operator(1)
def grid(d, r, tile_height: int = 25, across: int = 2):
    """A tall stack of tiles laid out in rows of `across`."""
    k = f"CAST(floor(y / {d.num(tile_height)}) AS INT)"
    return _moved(r, f"x + ({k} % {across}) * w", f"y % {tile_height} + CAST(floor({k} / {d.num(across)}) AS INT) * {tile_height}")


@operator(1)
def wrap(d, r, dx: int | None = None, dy: int | None = None):
    """The image moved left and up, by half its size where no number is given; what leaves comes back on the other side."""
    left, up = ("CAST(floor(w / 2e0) AS INT)" if dx is None else str(dx)), ("CAST(floor(h / 2e0) AS INT)" if dy is None else str(dy))
    return _moved(r, f"(((x - ({left})) % w) + w) % w", f"(((y - ({up})) % h) + h) % h")


def _source(at: str, n: str, extend: str) -> str:
    """Coordinate of the input that an extended one shows."""
    wrapped = lambda p: f"((({at}) % ({p}) + ({p})) % ({p}))"
    if extend == "copy":
        return f"greatest(0, least({n} - 1, {at}))"
    if extend == "repeat":
        return wrapped(n)
    if extend == "mirror":
        return f"CASE WHEN {wrapped(f'2 * {n}')} < {n} THEN {wrapped(f'2 * {n}')} ELSE 2 * {n} - 1 - {wrapped(f'2 * {n}')} END"
    return at


@operator(1)
def embed(d, r, x: int = 3, y: int = 2, right: int = 6, bottom: int = 8, extend: str = "black", background=(0,)):
    """With margins, x and y to the left and above: black, white, background, copy, repeat or mirror around it."""
    fill = {"black": "0e0", "white": "255e0"}.get(extend, d.num(background[0]) if len(background) == 1 else "CASE e.band " + " ".join(f"WHEN {b} THEN {d.num(v)}" for b, v in enumerate(background)) + " END")
    every = f"(SELECT c.image_id, c.band, c.ox, c.oy, {_source(f'c.ox - {x}', 'c.w', extend)} AS sx, {_source(f'c.oy - {y}', 'c.h', extend)} AS sy FROM {canvas(d, r, f'w + {x + right}', f'h + {y + bottom}')} c)"
    return (f"SELECT e.image_id, e.ox AS x, e.oy AS y, e.band, coalesce(r.v, {fill}) AS v FROM {every} e LEFT JOIN {r} r ON r.image_id = e.image_id AND r.band = e.band "
            f"AND r.x = e.sx AND r.y = e.sy")


#: The four pixels around a place, and the share of each.
_CORNERS = "(VALUES (0, 0), (1, 0), (0, 1), (1, 1)) AS c(i, j)"
_SHARE = "(CASE WHEN i = 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) * (CASE WHEN j = 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END)"


def sampled(r: str, at: str, nearest: bool = False) -> str:
    """Subquery: r at the places (sx, sy) of at(image_id, band, w, h, ox, oy, sx, sy), bilinear or nearest; 0 outside and on the last row and column."""
    if nearest:
        near = f"(SELECT p.*, CAST(floor(sx + 5e-1) AS INT) AS gx, CAST(floor(sy + 5e-1) AS INT) AS gy, 1e0 AS share FROM {at} p)"
    else:
        near = f"(SELECT p.*, CAST(floor(sx) AS INT) + i AS gx, CAST(floor(sy) AS INT) + j AS gy, {_SHARE} AS share FROM {at} p CROSS JOIN {_CORNERS})"
    return (f"(SELECT g.image_id, g.ox AS x, g.oy AS y, g.band, sum(round(g.share * coalesce(r.v, 0e0), 9)) AS v FROM {near} g LEFT JOIN {r} r "
            f"ON r.image_id = g.image_id AND r.band = g.band AND r.x = g.gx AND r.y = g.gy AND g.sx >= 0 AND g.sy >= 0 AND g.sx < g.w - 1 AND g.sy < g.h - 1 "
            f"GROUP BY g.image_id, g.ox, g.oy, g.band)")


@operator(1)
def affine(d, r, matrix=(1.1, 0.2, -0.1, 0.9), shift=(0.0, 0.0), nearest: bool = False):
    """Inverse-mapped bilinear (or nearest) sampling, same size; outside the image, and on its last row and column, 0."""
    a, b, c, e = matrix
    det = a * e - b * c
    sx = f"({d.num(e / det)} * (o.ox - {d.num(shift[0])}) + {d.num(-b / det)} * (o.oy - {d.num(shift[1])}))"
    sy = f"({d.num(-c / det)} * (o.ox - {d.num(shift[0])}) + {d.num(a / det)} * (o.oy - {d.num(shift[1])}))"
    at = f"(SELECT o.*, round({sx}, 9) AS sx, round({sy}, 9) AS sy FROM {canvas(d, r)} o)"
    return f"SELECT image_id, x, y, band, v FROM {sampled(r, at, nearest)} t"


@operator(2)
def mapim(d, r, index, background: float = 0.0):
    """Sample r bilinearly at the (sx, sy) of index(image_id, x, y, sx, sy); background outside; rounded half to even."""
    near = (f"(SELECT p.*, least(s.w - 1, CAST(floor(sx) AS INT) + i) AS gx, least(s.h - 1, CAST(floor(sy) AS INT) + j) AS gy, {_SHARE} AS share FROM {index} p "
            f"JOIN {size_of(r)} s ON s.image_id = p.image_id CROSS JOIN {_CORNERS} WHERE sx >= 0 AND sy >= 0 AND sx <= s.w - 1 AND sy <= s.h - 1)")
    found = f"(SELECT g.image_id, g.x, g.y, r.band, sum(round(g.share * r.v, 9)) AS v FROM {near} g JOIN {r} r ON r.image_id = g.image_id AND r.x = g.gx AND r.y = g.gy GROUP BY g.image_id, g.x, g.y, r.band)"
    every = f"(SELECT i.image_id, i.x, i.y, b.band FROM {index} i JOIN (SELECT DISTINCT image_id, band FROM {r}) b ON b.image_id = i.image_id)"
    return (f"SELECT e.image_id, e.x, e.y, e.band, {d.u8_round(f'coalesce(f.v, {d.num(background)})')} AS v FROM {every} e LEFT JOIN {found} f "
            f"ON f.image_id = e.image_id AND f.x = e.x AND f.y = e.y AND f.band = e.band")


@operator(1)
def rot45(d, r, angle: int = 45):
    """Images (odd squares, as a rule) turned by multiples of 45 degrees about their middle, nearest pixel, 0 outside."""
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    m, n = "CAST(floor(o.w / 2e0) AS INT)", "CAST(floor(o.h / 2e0) AS INT)"
    sx = f"CAST({d.rint(f'{d.num(c)} * (o.x - {m}) + {d.num(s)} * (o.y - {n}) + {m}')} AS INT)"
    sy = f"CAST({d.rint(f'{d.num(-s)} * (o.x - {m}) + {d.num(c)} * (o.y - {n}) + {n}')} AS INT)"
    return f"SELECT o.image_id, o.x, o.y, o.band, coalesce(r.v, 0e0) AS v FROM (SELECT o.*, {sx} AS sx, {sy} AS sy FROM {sized(r)} o) o LEFT JOIN {r} r ON r.image_id = o.image_id AND r.band = o.band AND r.x = o.sx AND r.y = o.sy"


@operator(1)
def arrayjoin(d, r, across: int = 2, shim: int = 1, background: float = 0.0):
    """All images of a raster in a grid of cells of the largest size, row by row; a shim of background between them and where none is."""
    cell = f"(SELECT max(x) + 1 AS w, max(y) + 1 AS h, CAST(floor(max(image_id) / {d.num(across)}) AS INT) + 1 AS down FROM {r})"
    box = f"(SELECT b.band, c.w, c.h, c.down FROM (SELECT DISTINCT band FROM {r}) b CROSS JOIN {cell} c)"
    every = d.expand(d.expand(box, f"{across} * (w + {shim}) - {shim}", "ox"), f"down * (h + {shim}) - {shim}", "oy")
    placed = (f"(SELECT r.band, r.x + (r.image_id % {across}) * (c.w + {shim}) AS x, r.y + CAST(floor(r.image_id / {d.num(across)}) AS INT) * (c.h + {shim}) AS y, r.v FROM {r} r CROSS JOIN {cell} c)")
    return f"SELECT 0 AS image_id, e.ox AS x, e.oy AS y, e.band, coalesce(p.v, {d.num(background)}) AS v FROM {every} e LEFT JOIN {placed} p ON p.band = e.band AND p.x = e.ox AND p.y = e.oy"


def _both(a: str, b: str) -> str:
    """Subquery (image_id, band, w, h, bw, bh): the bands of a, and the sizes of images of a and of b that share an image_id."""
    return (f"(SELECT k.image_id, k.band, s.w, s.h, u.w AS bw, u.h AS bh FROM (SELECT DISTINCT image_id, band FROM {a}) k JOIN {size_of(a)} s ON s.image_id = k.image_id "
            f"JOIN {size_of(b)} u ON u.image_id = k.image_id)")


@operator(2)
def join_images(d, a, b, vertical: bool = False, shim: int = 2, background: float = 0.0):
    """Abut two images, `shim` pixels of background between them and beside the smaller one."""
    w, h = ("greatest(w, bw)", f"h + bh + {shim}") if vertical else (f"w + bw + {shim}", "greatest(h, bh)")
    every = d.expand(d.expand(_both(a, b), w, "ox"), h, "oy")
    dx, dy = ("0", f"s.h + {shim}") if vertical else (f"s.w + {shim}", "0")
    parts = f"(SELECT {KEY}, v FROM {a} a UNION ALL SELECT b.image_id, b.x + {dx} AS x, b.y + {dy} AS y, b.band, b.v FROM {b} b JOIN {size_of(a)} s ON s.image_id = b.image_id)"
    return f"SELECT e.image_id, e.ox AS x, e.oy AS y, e.band, coalesce(p.v, {d.num(background)}) AS v FROM {every} e LEFT JOIN {parts} p ON p.image_id = e.image_id AND p.band = e.band AND p.x = e.ox AND p.y = e.oy"


@operator(2)
def insert(d, base, sub, x: int = 5, y: int = 7):
    """sub over base at (x, y), within base."""
    return (f"SELECT b.image_id, b.x, b.y, b.band, coalesce(s.v, b.v) AS v FROM {base} b LEFT JOIN (SELECT image_id, x + {x} AS x, y + {y} AS y, band, v FROM {sub}) s "
            f"ON s.image_id = b.image_id AND s.x = b.x AND s.y = b.y AND s.band = b.band")


@operator(2)
def insert_expand(d, base, sub, x: int = -3, y: int = 40, background: float = 0.0):
    """sub over base at (x, y) in the box around both."""
    left, top = min(0, x), min(0, y)
    every = d.expand(d.expand(_both(base, sub), f"greatest(w, bw + ({x})) - ({left})", "ox"), f"greatest(h, bh + ({y})) - ({top})", "oy")
    return (f"SELECT e.image_id, e.ox AS x, e.oy AS y, e.band, coalesce(s.v, b.v, {d.num(background)}) AS v FROM {every} e "
            f"LEFT JOIN {base} b ON b.image_id = e.image_id AND b.band = e.band AND b.x = e.ox + ({left}) AND b.y = e.oy + ({top}) "
            f"LEFT JOIN {sub} s ON s.image_id = e.image_id AND s.band = e.band AND s.x = e.ox + ({left - x}) AND s.y = e.oy + ({top - y})")


@operator(1)
def vignette(d, r, strength: float = 0.5):
    far = "((x - w / 2e0) * (x - w / 2e0) + (y - h / 2e0) * (y - h / 2e0)) / (w * w / 4e0 + h * h / 4e0)"
    return f"SELECT {KEY}, {d.u8_trunc(f'v * (1 - {d.num(strength)} * least(1e0, {far}))')} AS v FROM {sized(r)} q"


@operator(1)
def similarity(d, r, scale: float = 1.2, angle: float = 10.0, dx: float = 0.0, dy: float = 0.0):
    """Scale, turn and shift by one affine map of the same size."""
    c, s = scale * math.cos(math.radians(angle)), scale * math.sin(math.radians(angle))
    return affine.write(d, r, matrix=(c, -s, s, c), shift=(dx, dy))


@operator(1)
def skew(d, r, degrees_x: float = 5.0, degrees_y: float = 2.0):
    """Shear; a degenerate one returns the input."""
    tx, ty = math.tan(math.radians(degrees_x)), math.tan(math.radians(degrees_y))
    if abs(1 - tx * ty) < 1e-12:
        return f"SELECT {KEY}, v FROM {r}"
    return affine.write(d, r, matrix=(1.0, tx, ty, 1.0))


@operator(1)
def quadratic(d, r, coefficients=(0.5, 0.9, 0.02, 0.001, 0.0, 0.0, -1.0, 0.05, 0.98, 0.0, 0.001, 0.0), background: float = 0.0):
    """Second-degree warp with bilinear sampling: six coefficients of (1, x, y, xx, xy, yy) for each source coordinate."""
    sx, sy = (" + ".join(f"{d.num(c)} * {t}" for c, t in zip(part, ("1", "x", "y", "x * x", "x * y", "y * y"))) for part in (coefficients[:6], coefficients[6:]))
    return mapim.write(d, r, f"(SELECT image_id, x, y, round({sx}, 9) AS sx, round({sy}, 9) AS sy FROM {r} WHERE band = 0)", background=background)


def _resized(d, r: str, scale: str, vscale: str, kernel: str) -> str:
    """Whole-block means first where a scale is below a half, then resampling along x and along y; scales are expressions over w and h.

    A side shorter than a block is one block on Spark; the SQL for DuckDB divides by 0 there.
    """
    from .stencil import resampled
    scales = f"(SELECT image_id, w, h, {scale} AS sx, {vscale} AS sy FROM {size_of(r)} z)"
    factor = lambda c: f"CASE WHEN sx < 5e-1 OR sy < 5e-1 THEN greatest(1, CAST(floor(1 / {c}) AS INT)) ELSE 1 END"
    sizes = f"(SELECT z.*, {d.block(factor('sx'), 'w')} AS fx, {d.block(factor('sy'), 'h')} AS fy FROM {scales} z)"
    blocks = shrunk(f"(SELECT p.*, z.w, z.h, z.fx, z.fy FROM {r} p JOIN {sizes} z ON z.image_id = p.image_id)")
    length = lambda n, f: f"CAST(floor({n} / CAST({f} AS DOUBLE)) AS INT)"
    rest = lambda c, n, f: f"(SELECT image_id, {c} * {n} / CAST({length(n, f)} AS DOUBLE) AS scale, {length(n, f)} AS n FROM {sizes} y)"
    wide = resampled(d, blocks, rest("sx", "w", "fx"), False, kernel, False)
    return f"SELECT {KEY}, v FROM {resampled(d, wide, rest('sy', 'h', 'fy'), True, kernel, False)} k"


@operator(1)
def resize(d, r, scale: float = 0.4, vscale: float | None = None, kernel: str = "linear"):
    return _resized(d, r, d.num(scale), d.num(vscale or scale), kernel)


@operator(1)
def thumbnail(d, r, size: int = 10, out_height: int = 0, kernel: str = "linear"):
    """Within size x out_height (a square, if 0) at each image's own proportions."""
    ratio = f"least({d.num(size)} / w, {d.num(out_height or size)} / h)"
    return _resized(d, r, ratio, ratio, kernel)
