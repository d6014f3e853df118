"""Generators: images that are expressions of x and y over a range."""

from __future__ import annotations

import math

from ..plans.sqlop import operator


def _grid(d, width: int, height: int, expression: str, bands: int = 1) -> str:
    return f"SELECT 0 AS image_id, x, y, band, {expression} AS v FROM {d.series(0, width, 'x')} a CROSS JOIN {d.series(0, height, 'y')} b CROSS JOIN {d.series(0, bands, 'band')} c"


@operator(0)
def black(d, width: int = 16, height: int = 12, bands: int = 3):
    return _grid(d, width, height, "0e0", bands)


@operator(0)
def xyz(d, width: int = 16, height: int = 12):
    return _grid(d, width, height, "CASE WHEN band = 0 THEN x ELSE y END", 2)


@operator(0)
def identity(d, bands: int = 1, size: int = 256):
    return _grid(d, size, 1, "x", bands)


@operator(0)
def grey(d, width: int = 64, height: int = 8, uchar: bool = False):
    return _grid(d, width, height, d.div("x * 255e0", d.num(width - 1)) if uchar else f"x / {d.num(width - 1)}")


@operator(0)
def sines(d, width: int = 32, height: int = 32, h_freq: float = 0.5, v_freq: float = 0.5):
    return _grid(d, width, height, f"sin({d.num(2 * math.pi)} * (x * {d.num(h_freq)} / {width} + y * {d.num(v_freq)} / {height}))")


def _middle(d, width: int, height: int) -> tuple[str, str]:
    return f"(x - {d.num(width / 2)})", f"(y - {d.num(height / 2)})"


@operator(0)
def zone(d, width: int = 32, height: int = 24):
    dx, dy = _middle(d, width, height)
    return _grid(d, width, height, f"cos(({dx} * {dx} + {dy} * {dy}) * {d.num(math.pi / (min(width, height) / 2))})")


@operator(0)
def eye(d, width: int = 32, height: int = 24, factor: float = 0.5):
    return _grid(d, width, height, f"(1 - y / {d.num(height - 1)}) * cos({d.num(math.pi * factor)} * x * x / {width})")


@operator(0)
def gaussmat(d, sigma: float = 1.0, least: float = 0.1):
    radius = math.ceil(math.sqrt(-2 * sigma * sigma * math.log(least)))
    n = 2 * radius + 1
    return _grid(d, n, n, f"exp(-((x - {radius}) * (x - {radius}) + (y - {radius}) * (y - {radius})) / {d.num(2 * sigma * sigma)})")


@operator(0)
def logmat(d, sigma: float = 1.0, least: float = 0.1):
    radius = math.ceil(math.sqrt(-2 * sigma * sigma * math.log(least)))
    n, r2 = 2 * radius + 1, f"((x - {radius}) * (x - {radius}) + (y - {radius}) * (y - {radius}))"
    return _grid(d, n, n, f"({r2} - {d.num(2 * sigma * sigma)}) / {d.num(sigma ** 4)} * exp(-{r2} / {d.num(2 * sigma * sigma)})")


@operator(0)
def tonelut(d, shadows: float = 0.1, midtones: float = 1.5, highlights: float = 0.2):
    return _grid(d, 256, 1, d.u8_round(f"({d.num(shadows)} + pow(x / 255e0, {d.num(1 / midtones)}) * {d.num(1 - highlights - shadows)}) * 255"))


@operator(0)
def buildlut(d, points=((0, 0.0), (100, 50.0), (255, 255.0))):
    """Piecewise linear between points, rounded half to even."""
    parts = [f"WHEN x <= {b[0]} THEN {d.num(a[1])} + (x - {a[0]}) * {d.num((b[1] - a[1]) / (b[0] - a[0]))}" for a, b in zip(points, points[1:])]
    return _grid(d, points[-1][0] - points[0][0] + 1, 1, d.rint(f"CASE {' '.join(parts)} END"))


@operator(1)
def invertlut(d, lut, size: int = 256):
    """Of a rising LUT image with values 0..1: for each output the first input whose value reaches it, as a share."""
    crossing = f"(SELECT t.band, s.o, min(t.x) AS k, (SELECT max(x) FROM {lut} m) AS top FROM {d.series(0, size, 'o')} s JOIN {lut} t ON t.v >= s.o / {d.num(size - 1)} GROUP BY t.band, s.o)"
    return f"SELECT 0 AS image_id, o AS x, 0 AS y, band, CAST(k AS DOUBLE) / top AS v FROM {crossing} c"


@operator(0)
def sdf(d, width: int = 32, height: int = 24, shape: str = "circle", radius: float = 8.0, half_width: float = 6.0, half_height: float = 4.0, corner: float = 2.0):
    """Signed distance to a circle, box or rounded_box in the middle."""
    dx, dy = _middle(d, width, height)
    if shape == "circle":
        return _grid(d, width, height, f"sqrt({dx} * {dx} + {dy} * {dy}) - {d.num(radius)}")
    k = corner if shape == "rounded_box" else 0.0
    qx, qy = f"(abs({dx}) - {d.num(half_width - k)})", f"(abs({dy}) - {d.num(half_height - k)})"
    e = f"sqrt(greatest({qx}, 0e0) * greatest({qx}, 0e0) + greatest({qy}, 0e0) * greatest({qy}, 0e0)) + least(greatest({qx}, {qy}), 0e0) - {d.num(k)}"
    return _grid(d, width, height, e)


def _peaks(d, width, height, fx, fy):
    dx, dy = _middle(d, width, height)
    px, py = d.num(fx * width / 2), d.num(fy * height / 2)
    return [f"(({dx} {s} {px}) * ({dx} {s} {px}) + ({dy} {s} {py}) * ({dy} {s} {py}))" for s in "-+"]


@operator(0)
def mask_ideal(d, width: int = 32, height: int = 24, cutoff: float = 0.5, kind: str = "lowpass", fx: float = 0.3, fy: float = 0.2, ring: float = 0.2, reject: bool = False):
    dx, dy = _middle(d, width, height)
    half = min(width, height) / 2
    if kind == "band":
        a, b = _peaks(d, width, height, fx, fy)
        inside = f"{a} <= {d.num((ring * half) ** 2)} OR {b} <= {d.num((ring * half) ** 2)}"
        return _grid(d, width, height, f"CASE WHEN {inside} THEN {0 if reject else 1}e0 ELSE {1 if reject else 0}e0 END")
    low = kind == "lowpass"
    return _grid(d, width, height, f"CASE WHEN {dx} * {dx} + {dy} * {dy} <= {d.num((cutoff * half) ** 2)} THEN {int(low)}e0 ELSE {int(not low)}e0 END")


@operator(0)
def mask_gaussian(d, width: int = 32, height: int = 24, cutoff: float = 0.5, kind: str = "lowpass", fx: float = 0.3, fy: float = 0.2, ring: float = 0.2):
    dx, dy = _middle(d, width, height)
    half = min(width, height) / 2
    r2 = f"({dx} * {dx} + {dy} * {dy})"
    s2 = d.num(2 * ((ring if kind in ("ring", "band") else cutoff) * half) ** 2)
    if kind == "band":
        a, b = _peaks(d, width, height, fx, fy)
        return _grid(d, width, height, f"least(1e0, exp(-{a} / {s2}) + exp(-{b} / {s2}))")
    if kind == "ring":
        off = f"(sqrt({r2}) - {d.num(cutoff * half)})"
        return _grid(d, width, height, f"exp(-{off} * {off} / {s2})")
    return _grid(d, width, height, f"exp(-{r2} / {s2})" if kind == "lowpass" else f"1 - exp(-{r2} / {s2})")


@operator(0)
def mask_butterworth(d, width: int = 32, height: int = 24, cutoff: float = 0.5, order: int = 2, kind: str = "lowpass", fx: float = 0.3, fy: float = 0.2, ring: float = 0.2):
    dx, dy = _middle(d, width, height)
    half = min(width, height) / 2
    dist, c, w = f"sqrt({dx} * {dx} + {dy} * {dy})", d.num(max(1e-12, cutoff * half)), d.num(max(1e-12, ring * half))
    low = lambda e: f"1 / (1 + pow({e}, {d.num(2 * order)}))"
    if kind == "band":
        a, b = _peaks(d, width, height, fx, fy)
        return _grid(d, width, height, low(f"sqrt(least({a}, {b})) / {w}"))
    if kind == "ring":
        return _grid(d, width, height, f"CASE WHEN {dist} = 0 THEN 0e0 ELSE {low(f'({dist} * {dist} - {c} * {c}) / (CASE WHEN {dist} = 0 THEN 1e0 ELSE {dist} END * {w})')} END")
    return _grid(d, width, height, low(f"{dist} / {c}") if kind == "lowpass" else f"1 - {low(f'{dist} / {c}')}")


@operator(0)
def mask_fractal(d, width: int = 32, height: int = 24, dimension: float = 2.5):
    dx, dy = _middle(d, width, height)
    dist = f"sqrt({dx} * {dx} + {dy} * {dy})"
    return _grid(d, width, height, f"CASE WHEN {dist} = 0 THEN 0e0 ELSE 1 / pow(CASE WHEN {dist} = 0 THEN 1e0 ELSE {dist} END, {d.num(dimension / 2)}) END")


@operator(0)
def worley(d, width: int = 64, height: int = 48, cell: int = 16, seed: int = 1):
    """Distance to the nearest of one point a cell; the points come from a 32-bit hash of the cell."""
    def point(cx: int, cy: int) -> tuple[float, float]:
        h = (cx * 374761393 ^ cy * 668265263 ^ seed * 2147483647) & 0xFFFFFFFF
        h = ((h ^ h >> 13) * 1274126177) & 0xFFFFFFFF
        h ^= h >> 16
        return cx * cell + (h & 0xFFFF) / 65535 * cell, cy * cell + (h >> 16 & 0xFFFF) / 65535 * cell

    rows = ", ".join(f"({cx}, {cy}, {d.num(px)}, {d.num(py)})" for cx in range(-1, -(-width // cell) + 1) for cy in range(-1, -(-height // cell) + 1) for px, py in [point(cx, cy)])
    every = f"(SELECT x, y FROM {d.series(0, width, 'x')} a CROSS JOIN {d.series(0, height, 'y')} b)"
    near = f"abs(p.cx - floor(g.x / {d.num(cell)})) <= 1 AND abs(p.cy - floor(g.y / {d.num(cell)})) <= 1"
    return (f"SELECT 0 AS image_id, g.x, g.y, 0 AS band, sqrt(min((g.x - p.px) * (g.x - p.px) + (g.y - p.py) * (g.y - p.py))) AS v FROM {every} g "
            f"JOIN (VALUES {rows}) AS p(cx, cy, px, py) ON {near} GROUP BY g.x, g.y")


def _uniform(d, *terms: str) -> str:
    """A number in (0, 1] from whole numbers: three rounds of a linear congruence, with the high bits brought down between them."""
    h = "0"
    for t in terms:
        h = f"((({h}) + CAST({t} AS BIGINT) + 12345) * 1103515245 % 2147483648)"
        h = f"({h} + CAST(floor({h} / 65536e0) AS BIGINT)) % 2147483648"
    return f"(({h}) + 1) / 2147483648e0"


@operator(0)
def gaussnoise(d, width: int = 64, height: int = 48, mean: float = 128.0, sigma: float = 30.0, seed: int = 1):
    """Normal noise, each pixel's from a hash of the seed and its place, so that it is the same however it is divided."""
    u, v = _uniform(d, str(seed), "y", "x", "1"), _uniform(d, str(seed), "x", "y", "2")
    return _grid(d, width, height, f"{d.num(mean)} + {d.num(sigma)} * sqrt(-2 * ln({u})) * cos({d.num(2 * math.pi)} * {v})")


def _permutation(seed: int) -> list[int]:
    """The whole numbers below 256 in an order of the seed, twice."""
    import random
    order = list(range(256))
    random.Random(seed).shuffle(order)
    return order + order


def _noise(d, width: int, height: int, octaves: list[tuple[int, int, float]]) -> str:
    """The sum of gradient noises of (cell, seed, weight): places in the lattice first, then the corners' hashes, then the blend."""
    places, corners, terms = [], [], []
    fade = lambda t: f"({t} * {t} * {t} * ({t} * ({t} * 6 - 15) + 10))"
    mix = lambda t, a, b: f"({a} + {t} * ({b} - {a}))"
    for k, (cell, seed, weight) in enumerate(octaves):
        for c in "xy":
            at = f"{c} / {d.num(cell)}"
            places += [f"CAST(floor({at}) AS INT) % 256 AS {c}c{k}", f"{at} - floor({at}) AS {c}f{k}"]
        table = d.array([str(p) for p in _permutation(seed)])
        slopes = {}
        for i in (0, 1):
            for j in (0, 1):
                corners.append(f"{d.item(table, f'{d.item(table, f'xc{k} + {i}')} + yc{k} + {j}')} % 8 AS h{k}{i}{j}")
                h, x, y = f"h{k}{i}{j}", f"(xf{k} - {i})", f"(yf{k} - {j})"
                u, v = f"CASE WHEN {h} < 4 THEN {x} ELSE {y} END", f"CASE WHEN {h} < 4 THEN {y} ELSE {x} END"
                slopes[i, j] = f"(CASE WHEN {h} % 2 = 0 THEN 1 ELSE -1 END * {u} + CASE WHEN {h} % 4 < 2 THEN 1 ELSE -1 END * {v})"
        u, v = fade(f"xf{k}"), fade(f"yf{k}")
        terms.append(f"{d.num(weight)} * {mix(v, mix(u, slopes[0, 0], slopes[1, 0]), mix(u, slopes[0, 1], slopes[1, 1]))}")
    every = f"(SELECT x, y, {', '.join(places)} FROM {d.series(0, width, 'x')} a CROSS JOIN {d.series(0, height, 'y')} b)"
    return f"SELECT 0 AS image_id, x, y, 0 AS band, {' + '.join(terms)} AS v FROM (SELECT p.*, {', '.join(corners)} FROM {every} p) q"


@operator(0)
def perlin(d, width: int = 64, height: int = 48, cell: int = 16, seed: int = 1):
    """Gradient noise over a lattice of cells."""
    return _noise(d, width, height, [(cell, seed, 1.0)])


@operator(0)
def fractsurf(d, width: int = 64, height: int = 48, octaves: int = 6, cell: int = 32, dimension: float = 2.5, seed: int = 1):
    """Octaves of gradient noise, each on half the cells of the one before and weaker by the fractal dimension."""
    return _noise(d, width, height, [(max(1, cell >> k), seed + k, 0.5 ** ((3 - dimension) * k)) for k in range(octaves)])
