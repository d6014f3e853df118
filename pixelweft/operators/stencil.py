"""Neighbourhoods: window functions over rows and columns, which keep one row a pixel. Images have all their pixels, so that
what a window function finds missing lies outside the image; no size is needed."""

from __future__ import annotations

import math

from ..plans.sqlop import DUCKDB, KEY, operator, size_of

BOX3 = ((1, 1, 1), (1, 1, 1), (1, 1, 1))


def _row(extra: str = "") -> str:
    return f"(PARTITION BY image_id, band, y ORDER BY x{extra})"


def _column(extra: str = "") -> str:
    return f"(PARTITION BY image_id, band, x ORDER BY y{extra})"


def _strip(extra: str = "") -> str:
    """A column within a strip, see `strips`."""
    return f"(PARTITION BY image_id, band, x, strip ORDER BY y{extra})"


#: Rows of an image whose columns one window runs over.
STRIP = 1024


def strips(d, r: str, reach: int) -> str:
    """Subquery: r with `strip`, some rows of an image, and `copy`, 0 for a strip's own pixels and 1 for the `reach` rows lent by its neighbours.

    Windows down the columns of a strip then see as far as they reach, and a tall image is many strips instead of one column a task.
    """
    rows = max(STRIP, 2 * reach)
    near = f"(y % {rows} < {reach} AND y >= {rows}) OR y % {rows} >= {rows - reach}"
    lent = d.expand(f"(SELECT * FROM {r})", f"CASE WHEN {near} THEN 2 ELSE 1 END", "copy")
    return f"(SELECT e.*, CAST(floor(y / {rows}e0) AS INT) + CASE WHEN copy = 0 THEN 0 WHEN y % {rows} < {reach} THEN -1 ELSE 1 END AS strip FROM {lent} e)"


def _down(d, r: str, reach: int, columns: str, names: str) -> str:
    """Subquery: columns with windows down the strips of r, for each pixel once; names are those that go on."""
    return f"(SELECT {names} FROM (SELECT {KEY}, copy, {columns} FROM {strips(d, r, reach)} s) w WHERE copy = 0)"


def along(d, vertical: bool):
    """Writer of windows along rows or columns, columns in strips on Spark: what is at a strip's end is used at an image's edge only."""
    return _row if not vertical else _column if d is DUCKDB else _strip


def passed(d, r: str, reach: int, value: str, vertical: bool) -> str:
    """Subquery: r with a value of windows as `along` writes them."""
    return _down(d, r, reach, value, f"{KEY}, v") if vertical and d is not DUCKDB else f"(SELECT {KEY}, {value} FROM {r})"


def nine(d, r: str) -> str:
    """Subquery with p00 .. p22 (row, column) around each pixel, edges repeated."""
    across = f"(SELECT {KEY}, v, coalesce(lag(v) OVER {_row()}, v) AS l, coalesce(lead(v) OVER {_row()}, v) AS n FROM {r})"
    cells = []
    for k, c in (("0", "l"), ("1", "v"), ("2", "n")):
        cells += [f"coalesce(lag({c}) OVER {_strip()}, {c}) AS p0{k}", f"{c} AS p1{k}", f"coalesce(lead({c}) OVER {_strip()}, {c}) AS p2{k}"]
    return _down(d, f"{across} a", 1, f"v, {', '.join(cells)}", f"{KEY}, v, {', '.join(f'p{i}{j}' for i in range(3) for j in range(3))}")


def around(d, r: str, cells) -> str:
    """Subquery with c0, c1, ...: the values at (x + dx, y + dy) for cells (dx, dy), null outside the image."""
    def shifted(e: str, by: int, over: str) -> str:
        return e if by == 0 else f"{'lag' if by < 0 else 'lead'}({e}, {abs(by)}) OVER {over}"

    across = sorted({dx for dx, _ in cells})
    row = f"(SELECT {KEY}, v, {', '.join(f'{shifted('v', dx, _row())} AS a{k}' for k, dx in enumerate(across))} FROM {r})"
    down = ", ".join(f"{shifted(f'a{across.index(dx)}', dy, _strip())} AS c{k}" for k, (dx, dy) in enumerate(cells))
    return _down(d, f"{row} q", max(1, *(abs(dy) for _, dy in cells)), f"v, {down}", f"{KEY}, v, {', '.join(f'c{k}' for k in range(len(cells)))}")


def _cells(mask) -> list[tuple[int, int]]:
    """Cells of a mask that are not 0, from its middle at (w div 2, h div 2)."""
    cy, cx = len(mask) // 2, len(mask[0]) // 2
    return [(i - cx, j - cy) for j, line in enumerate(mask) for i, w in enumerate(line) if w]


@operator(1)
def conv(d, r, mask=((0, 1, 0), (1, 4, 1), (0, 1, 0)), divisor: float = 8.0, real: bool = False):
    """Correlation with a mask, its middle at (w div 2, h div 2); places outside count 0."""
    weights = [w for line in mask for w in line if w]
    e = f"({' + '.join(f'coalesce(c{k}, 0e0) * {d.num(w)}' for k, w in enumerate(weights))}) / {d.num(divisor)}"
    return f"SELECT {KEY}, {e if real else d.u8_trunc(e)} AS v FROM {around(d, r, _cells(mask))} n"


def gauss_kernel(sigma: float) -> list[float]:
    size = max(3, int(6 * sigma) | 1)
    k = [math.exp(-((i - size // 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    return [x / sum(k) for x in k]


def _pass(d, r: str, kernel, vertical: bool, real: bool) -> str:
    over, m = _strip() if vertical else _row(), len(kernel) // 2
    terms = []
    for i, w in enumerate(kernel):
        at = "v" if i == m else f"coalesce({'lag' if i < m else 'lead'}(v, {abs(i - m)}) OVER {over}, 0e0)"
        terms.append(f"{at} * {d.num(w)}")
    e = " + ".join(terms)
    e = e if real else d.u8_trunc(e)
    return _down(d, r, m, f"{e} AS v", f"{KEY}, v") if vertical and m else f"(SELECT {KEY}, {e} AS v FROM {r})"


@operator(1)
def conv1d(d, r, kernel=(0.25, 0.5, 0.25), vertical: bool = False, real: bool = False):
    return f"SELECT {KEY}, v FROM {_pass(d, r, kernel, vertical, real)} p"


@operator(1)
def conv_sep(d, r, kernel=(0.25, 0.5, 0.25), real: bool = False):
    return f"SELECT {KEY}, v FROM {_pass(d, _pass(d, r, kernel, False, real) + ' h', kernel, True, real)} p"


@operator(1)
def gauss_blur(d, r, sigma: float = 1.0, real: bool = False):
    if sigma < 0.1:
        return f"SELECT {KEY}, v FROM {r}"
    return conv_sep.write(d, r, kernel=gauss_kernel(sigma), real=real)


def _with_blur(d, r: str, sigma: float, expression: str) -> str:
    blur = f"({gauss_blur.write(d, r, sigma=sigma)})"
    return f"SELECT l.image_id, l.x, l.y, l.band, {expression} AS v FROM {r} l JOIN {blur} q ON l.image_id = q.image_id AND l.x = q.x AND l.y = q.y AND l.band = q.band"


@operator(1)
def unsharp_mask(d, r, sigma: float = 1.0, amount: float = 1.0):
    return _with_blur(d, r, sigma, d.u8_trunc(f"l.v + {d.num(amount)} * (l.v - q.v)"))


@operator(1)
def glow(d, r, sigma: float = 1.0, strength: float = 0.3):
    return _with_blur(d, r, sigma, d.u8_trunc(f"l.v + {d.num(strength)} * q.v"))


@operator(1)
def box_blur(d, r, radius: int = 1, passes: int = 2):
    """Running means, edges repeated, rounded half to even at the end."""
    n = 2 * radius + 1
    for _ in range(passes):
        for vertical in (False, True):
            over = along(d, vertical)
            frame = f" ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING"
            key = over()
            first = " + ".join(f"CASE WHEN lag(v, {k}) OVER {key} IS NULL THEN {d.end('v', over)} ELSE 0e0 END" for k in range(1, radius + 1))
            last = " + ".join(f"CASE WHEN lead(v, {k}) OVER {key} IS NULL THEN {d.end('v', over, last=True)} ELSE 0e0 END" for k in range(1, radius + 1))
            r = passed(d, r, radius, f"round((sum(v) OVER {over(frame)} + {first} + {last}) / {n}, 9) AS v", vertical) + " b"
    return f"SELECT {KEY}, {d.u8_round('v')} AS v FROM {r}"


@operator(1)
def rank(d, r, width: int = 3, height: int = 3, index: int = 4):
    """index-th smallest of the window; pixels outside are left out and the index kept within what there is."""
    cells = [(i - width // 2, j - height // 2) for j in range(height) for i in range(width)]
    near = f"(SELECT {KEY}, {d.sorted_present(d.array([f'c{k}' for k in range(len(cells))]))} AS s FROM {around(d, r, cells)} n)"
    return f"SELECT {KEY}, {d.item('s', f'least({index}, {d.length('s')} - 1)')} AS v FROM {near} m"


@operator(1)
def morph(d, r, mask=BOX3, method: str = "dilate"):
    """Largest (dilate) or smallest (erode) value under the mask's cells that are not 0; those outside are left out."""
    cells = _cells(mask)
    name, none = ("greatest", "0e0") if method == "dilate" else ("least", "255e0")
    every = ", ".join(f"c{k}" for k in range(len(cells)))
    return f"SELECT {KEY}, coalesce({f'{name}({every})' if len(cells) > 1 else every}, {none}) AS v FROM {around(d, r, cells)} n"


@operator(1)
def opening(d, r, mask=BOX3):
    """Erode, then dilate."""
    return morph.write(d, f"({morph.write(d, r, mask=mask, method='erode')})", mask=mask)


@operator(1)
def closing(d, r, mask=BOX3):
    return morph.write(d, f"({morph.write(d, r, mask=mask)})", mask=mask, method="erode")


def _gradient(d, r: str, gx: str, gy: str, divisor: float = 1.0) -> str:
    e = f"sqrt(({gx}) * ({gx}) + ({gy}) * ({gy})) / {d.num(divisor)}"
    return f"SELECT {KEY}, {d.u8_trunc(e)} AS v FROM {nine(d, r)} p"


@operator(1)
def sobel(d, r):
    return _gradient(d, r, "p02 + 2 * p12 + p22 - p00 - 2 * p10 - p20", "p20 + 2 * p21 + p22 - p00 - 2 * p01 - p02")


@operator(1)
def prewitt(d, r):
    return _gradient(d, r, "p02 + p12 + p22 - p00 - p10 - p20", "p20 + p21 + p22 - p00 - p01 - p02")


@operator(1)
def kayyali(d, r):
    return _gradient(d, r, "6 * p00 - 6 * p02 + 10 * p10 - 10 * p12 + 6 * p20 - 6 * p22", "6 * p20 + 10 * p21 + 6 * p22 - 6 * p00 - 10 * p01 - 6 * p02", 22.0)


@operator(1)
def roberts(d, r):
    return _gradient(d, r, "p11 - p22", "p12 - p21")


@operator(1)
def laplacian(d, r):
    return f"SELECT {KEY}, {d.u8_trunc('abs(4 * p11 - p01 - p10 - p12 - p21)')} AS v FROM {nine(d, r)} p"


@operator(1)
def compass(d, r):
    """Largest of the eight Kirsch responses, a fifteenth of it."""
    ring = ["p00", "p01", "p02", "p12", "p22", "p21", "p20", "p10"]
    responses = [f"abs({' + '.join(f'{5 if (k - turn) % 8 < 3 else -3} * {c}' for k, c in enumerate(ring))})" for turn in range(8)]
    return f"SELECT {KEY}, {d.u8_trunc(d.div(f'greatest({chr(44).join(responses)})', '15e0'))} AS v FROM {nine(d, r)} p"


@operator(1)
def stdif(d, r, width: int = 5, height: int = 5, sigma: float = 50.0, mean: float = 128.0, a: float = 0.5):
    """Bring each pixel's window, clipped at the edges, toward a mean and deviation."""
    fx, fy = (f" ROWS BETWEEN {k // 2} PRECEDING AND {k // 2} FOLLOWING" for k in (width, height))
    rows = f"(SELECT {KEY}, v, sum(v) OVER {_row(fx)} AS s, sum(v * v) OVER {_row(fx)} AS q, count(*) OVER {_row(fx)} AS n FROM {r})"
    sums = f"(SELECT {KEY}, v, sum(s) OVER {_column(fy)} AS s, sum(q) OVER {_column(fy)} AS q, sum(n) OVER {_column(fy)} AS n FROM {rows} a)"
    stat = f"(SELECT {KEY}, v, s / n AS m, sqrt(greatest(0e0, q / n - s / n * s / n)) AS sd FROM {sums} b)"
    e = f"CASE WHEN sd = 0 THEN {d.num(mean)} ELSE (v - m) * {d.num(a * sigma)} / CASE WHEN sd = 0 THEN 1e0 ELSE sd END + {d.num(mean)} END"
    return f"SELECT {KEY}, {d.u8_trunc(f'round({e}, 9)')} AS v FROM {stat} c"


def _placed(r: str, reference: str, sums: str) -> str:
    """Subquery: sums over the products of a template with the image at every place where it lies within."""
    within = "a.x - t.x >= 0 AND a.x - t.x <= s.w - u.w AND a.y - t.y >= 0 AND a.y - t.y <= s.h - u.h"
    return (f"(SELECT a.image_id, a.x - t.x AS x, a.y - t.y AS y, a.band, max(u.w * u.h) AS n, {sums} FROM {r} a JOIN {reference} t ON t.image_id = a.image_id AND t.band = a.band "
            f"JOIN {size_of(r)} s ON s.image_id = a.image_id JOIN {size_of(reference)} u ON u.image_id = a.image_id WHERE {within} GROUP BY a.image_id, a.x - t.x, a.y - t.y, a.band)")


@operator(2)
def fastcor(d, r, reference):
    """Sums of products with the template of the same image_id wherever it lies within the image."""
    return f"SELECT {KEY}, v FROM {_placed(r, reference, 'sum(a.v * t.v) AS v')} k"


@operator(2)
def spcor(d, r, reference):
    """Pearson's correlation with a template, -1..1 mapped to 0..255; 0 where one of them is flat."""
    sums = _placed(r, reference, "sum(a.v * t.v) AS st, sum(a.v) AS s, sum(t.v) AS u, sum(a.v * a.v) AS ss, sum(t.v * t.v) AS uu")
    norm = "((n * ss - s * s) * (n * uu - u * u))"
    e = f"CASE WHEN {norm} <= 0 THEN 0e0 ELSE {d.u8_trunc(f'round(((n * st - s * u) / sqrt(CASE WHEN {norm} <= 0 THEN 1e0 ELSE {norm} END) + 1) * 127.5e0, 9)')} END"
    return f"SELECT {KEY}, {e} AS v FROM {sums} k"


#: Half-widths of the resampling kernels. Fixed values.
SUPPORT = {"nearest": 1, "linear": 1, "hermite": 1, "cubic": 2, "mitchell": 2, "bicubic_sharper": 2, "bicubic_smoother": 2, "lbb": 2, "lanczos2": 2, "lanczos3": 3, "lanczos5": 5}
#: B and C of the kernels of the family of two cubics. Fixed values.
CUBICS = {"cubic": (0, 0.5), "lbb": (0, 0.5), "mitchell": (1 / 3, 1 / 3), "bicubic_sharper": (0, 1), "bicubic_smoother": (1.5, -0.25)}


def kernel_at(d, kernel: str, x: str) -> str:
    """Weight of a resampling kernel at an offset."""
    t = f"abs({x})"
    if kernel in CUBICS:
        b, c = CUBICS[kernel]
        powers = lambda *k: " + ".join(f"{d.num(w / 6)}" + f" * {t}" * n for n, w in zip((3, 2, 1, 0), k) if w)
        near, far = powers(12 - 9 * b - 6 * c, -18 + 12 * b + 6 * c, 0, 6 - 2 * b), powers(-b - 6 * c, 6 * b + 30 * c, -12 * b - 48 * c, 8 * b + 24 * c)
        return f"CASE WHEN {t} < 1 THEN {near} WHEN {t} < 2 THEN {far} ELSE 0e0 END"
    if kernel.startswith("lanczos"):
        a = SUPPORT[kernel]
        p = f"({d.num(math.pi)} * {x})"
        return f"CASE WHEN {t} >= {a} THEN 0e0 WHEN {x} = 0 THEN 1e0 ELSE sin{p} / {p} * sin({p} / {a}) / ({p} / {a}) END"
    return {"nearest": f"CASE WHEN {t} < 5e-1 THEN 1e0 ELSE 0e0 END", "linear": f"greatest(0e0, 1 - {t})",
            "hermite": f"CASE WHEN {t} < 1 THEN (2 * {t} - 3) * {t} * {t} + 1 ELSE 0e0 END"}[kernel]


def resampled(d, r: str, scales: str, vertical: bool, kernel: str, real: bool) -> str:
    """Subquery: r along one axis by the scale and the length of each image in scales(image_id, scale, n); edges repeated, weights normed, truncated."""
    along, other = ("y", "x") if vertical else ("x", "y")
    half = SUPPORT[kernel]
    sizes = f"(SELECT image_id, scale, n, greatest(1, {d.rint('n * scale')}) AS m FROM {scales} s)"
    at = f"(SELECT o.*, (o + 5e-1) / scale - 5e-1 AS pos FROM {d.expand(sizes, 'm', 'o')} o)"
    taps = ", ".join(f"({i})" for i in range(2 * half))
    near = f"(SELECT p.image_id, p.n, p.o, p.scale, p.pos, CAST(floor(p.pos) AS INT) - {half - 1} + i.i AS k FROM {at} p CROSS JOIN (VALUES {taps}) AS i(i))"
    # At a scale of 1 the image stays as it is, whatever the kernel.
    weights = f"(SELECT q.image_id, q.n, q.o, q.k, round(CASE WHEN scale = 1 THEN CASE WHEN k = o THEN 1e0 ELSE 0e0 END ELSE {kernel_at(d, kernel, '(k - pos)')} END, 15) AS w FROM {near} q)"
    total = f"(SELECT e.*, sum(w) OVER (PARTITION BY image_id, o) AS total FROM {weights} e)"
    used = f"(SELECT image_id, o, greatest(0, least(n - 1, k)) AS k, round(w / CASE WHEN total = 0 THEN 1e0 ELSE total END, 12) AS w FROM {total} t)"
    e = "round(sum(round(r.v * u.w, 9)), 6)"
    place = "u.o AS x, r.y" if not vertical else "r.x, u.o AS y"
    return f"(SELECT r.image_id, {place}, r.band, {e if real else d.u8_trunc(e)} AS v FROM {r} r JOIN {used} u ON u.image_id = r.image_id AND u.k = r.{along} GROUP BY r.image_id, r.band, r.{other}, u.o)"


@operator(1)
def resize1d(d, r, scale: float = 0.7, vertical: bool = False, kernel: str = "linear", real: bool = False):
    """Resampling along one axis with one of the kernels of SUPPORT."""
    return f"SELECT {KEY}, v FROM {resampled(d, r, f'(SELECT image_id, {d.num(scale)} AS scale, {"h" if vertical else "w"} AS n FROM {size_of(r)} z)', vertical, kernel, real)} k"


def hexagon(radius: int) -> list[list[float]]:
    """A flat-topped hexagon's cells, summing to 1."""
    side = math.sqrt(3) / 2
    inside = [[float(abs(y) <= radius * side and abs(x) * side + abs(y) / 2 <= radius * side) for x in range(-radius, radius + 1)] for y in range(-radius, radius + 1)]
    total = sum(map(sum, inside))
    return [[v / total for v in row] for row in inside]


@operator(1)
def bokeh_blur(d, r, radius: int = 2):
    kernel = hexagon(radius)
    n = round(1 / max(map(max, kernel)))
    return conv.write(d, r, mask=[[1 if v else 0 for v in row] for row in kernel], divisor=float(n))


@operator(1)
def sharpen(d, r, sigma: float = 0.5, m1: float = 1.0, m2: float = 1.0, x1: int = 2):
    """Add to a one-band image what it has over its Gaussian, edges repeated: beyond a dead band, by one gain up and one down."""
    reach = max(1, math.ceil(3 * sigma))
    k = [math.exp(-(i - reach) ** 2 / (2 * sigma * sigma)) for i in range(2 * reach + 1)]
    k = [w / sum(k) for w in k]

    def blurred(t: str, vertical: bool) -> str:
        over = along(d, vertical)
        first, last = d.end("v", over), d.end("v", over, last=True)
        terms = [f"{d.num(w)} * " + ("v" if i == reach else f"coalesce(lag(v, {reach - i}) OVER {over()}, {first})" if i < reach else f"coalesce(lead(v, {i - reach}) OVER {over()}, {last})") for i, w in enumerate(k)]
        return passed(d, f"{t} b", reach, f"{' + '.join(terms)} AS v", vertical)

    blur = blurred(blurred(r, False), True)
    diff = "(l.v - q.v)"
    e = f"l.v + CASE WHEN abs{diff} < {x1} THEN 0e0 WHEN {diff} > 0 THEN {d.num(m1)} * {diff} ELSE {d.num(m2)} * {diff} END"
    return (f"SELECT l.image_id, l.x, l.y, l.band, {d.u8_trunc(f'round({e}, 9)')} AS v FROM {r} l JOIN {blur} q ON l.image_id = q.image_id AND l.x = q.x AND l.y = q.y AND l.band = q.band")
