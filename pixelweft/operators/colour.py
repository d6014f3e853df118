"""Colour: recombination, tone, colour spaces, differences. Pixels of three bands (four for CMYK and RGBA)."""

from __future__ import annotations

import math

from ..plans.sqlop import cross_band, operator, pel, point, unpel

# Colour matrices, weights and white point of the public standards, and the preset matrices.
REC709 = (0.2126, 0.7152, 0.0722)
SEPIA = ((0.393, 0.769, 0.189), (0.349, 0.686, 0.168), (0.272, 0.534, 0.131))
RGB_TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
XYZ_TO_RGB = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
WHITE_D65 = (0.95047, 1.0, 1.08883)
XYZ_TO_LMS = ((0.8189330101, 0.3618667424, -0.1288597137), (0.0329845436, 0.9293118715, 0.0361456387), (0.0482003018, 0.2643662691, 0.6338517070))
LMS_TO_OKLAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
OKLAB_TO_LMS = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.2914855480))
LMS_TO_XYZ = ((1.2270138511, -0.5577999807, 0.2812561489), (-0.0405801784, 1.1122568696, -0.0716766787), (-0.0763812845, -0.4214819784, 1.5861632204))


def _times(d, matrix, inputs) -> list[str]:
    return ["(" + " + ".join(f"{d.num(m)} * {v}" for m, v in zip(row, inputs)) + ")" for row in matrix]


V = ("v0", "v1", "v2")


def hue_matrix(degrees: float):
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    a, b, e = (1 + 2 * c) / 3, (1 - c - math.sqrt(3) * s) / 3, (1 - c + math.sqrt(3) * s) / 3
    return (a, b, e), (e, a, b), (b, e, a)


def saturation_matrix(s: float):
    return tuple(tuple((1 - s) * w + (s if i == k else 0) for i, w in enumerate(REC709)) for k in range(3))


@cross_band(3)
def recomb(d, matrix=saturation_matrix(1.5), real: bool = False):
    return [e if real else d.u8_trunc(e) for e in _times(d, matrix, V)]


@cross_band(3)
def saturate(d, s: float = 1.5):
    return recomb_values(d, saturation_matrix(s))


def recomb_values(d, matrix) -> list[str]:
    return [d.u8_trunc(e) for e in _times(d, matrix, V)]


@cross_band(3)
def greyscale(d):
    return recomb_values(d, saturation_matrix(0.0))


@cross_band(3)
def hue(d, degrees: float = 90.0):
    return recomb_values(d, hue_matrix(degrees))


@cross_band(3)
def sepia(d):
    return recomb_values(d, SEPIA)


@operator(1)
def color_matrix(d, r, matrix=((0.5, 0.2, 0.1, 0.0, 0.1), (0.0, 1.0, 0.0, 0.0, -0.1), (0.3, 0.3, 0.3, 0.0, 0.0), (0.0, 0.0, 0.0, 1.0, 0.0))):
    """4 x 5 matrix on RGBA; the last column is an offset in units of 255."""
    return unpel(pel(r, 4), [d.u8_round(" + ".join([*(f"{d.num(m)} * v{i}" for i, m in enumerate(row[:4])), d.num(row[4] * 255)])) for row in matrix])


@point
def brightness(d, amount: float = 1.2, bands: int = 3):
    e = d.u8_trunc(f"v * {d.num(amount)}")
    return f"CASE WHEN band = {bands - 1} THEN v ELSE {e} END" if bands in (2, 4) else e


@point
def contrast(d, amount: float = 1.2, bands: int = 3):
    e = d.u8_trunc(f"v * {d.num(amount)} + {d.num(128.0 * (1 - amount))}")
    return f"CASE WHEN band = {bands - 1} THEN v ELSE {e} END" if bands in (2, 4) else e


@point
def gamma(d, exponent: float = 2.2, real: bool = False):
    return f"pow(v, {d.num(1 / exponent)})" if real else d.u8_trunc(f"pow(v / 255e0, {d.num(1 / exponent)}) * 255")


def _to_linear(u: str) -> str:
    return f"(CASE WHEN {u} <= 0.04045e0 THEN {u} / 12.92e0 ELSE pow(({u} + 0.055e0) / 1.055e0, 2.4e0) END)"


def _to_srgb(u: str) -> str:
    return f"(CASE WHEN {u} <= 0.0031308e0 THEN {u} * 12.92e0 ELSE 1.055e0 * pow(greatest({u}, 0e0), {1 / 2.4!r}e0) - 0.055e0 END)"


@point
def linearize(d, real: bool = False):
    return _to_linear("v") if real else d.u8_trunc(f"{_to_linear('(v / 255e0)')} * 255")


@point
def delinearize(d, real: bool = False):
    return _to_srgb("v") if real else d.u8_trunc(f"{_to_srgb('(v / 255e0)')} * 255")


@cross_band(3)
def to_grey(d):
    """Rec.709 luma, truncated."""
    return [d.u8_trunc(_times(d, (REC709,), V)[0])]


@cross_band(3)
def to_cmyk(d):
    k = "(1 - greatest(v0, v1, v2) / 255e0)"
    inks = [f"CASE WHEN {k} < 1 THEN {d.u8_trunc(f'(1 - {v} / 255e0 - {k}) / (CASE WHEN {k} < 1 THEN 1 - {k} ELSE 1e0 END) * 255')} ELSE 0e0 END" for v in V]
    return [*inks, d.u8_trunc(f"{k} * 255")]


def _srgb_to_xyz(d) -> list[str]:
    return _times(d, RGB_TO_XYZ, [_to_linear(f"({v} / 255e0)") for v in V])


@cross_band(3)
def to_scrgb(d):
    return [_to_linear(f"({v} / 255e0)") for v in V]


@cross_band(3)
def to_xyz(d):
    return _srgb_to_xyz(d)


def _lab_f(t: str) -> str:
    return f"(CASE WHEN {t} > {(6 / 29) ** 3!r}e0 THEN cbrt({t}) ELSE {t} / {3 * (6 / 29) ** 2!r}e0 + {4 / 29!r}e0 END)"


def _lab_f_short(t: str) -> str:
    return f"(CASE WHEN {t} > 0.008856e0 THEN cbrt({t}) ELSE 7.787e0 * {t} + {16 / 116!r}e0 END)"


def _lab(xyz: list[str], f) -> list[str]:
    fx, fy, fz = (f(f"({e} / {w!r}e0)") for e, w in zip(xyz, WHITE_D65))
    return [f"116 * {fy} - 16", f"500 * ({fx} - {fy})", f"200 * ({fy} - {fz})"]


@operator(1)
def to_lab(d, r):
    """8-bit sRGB to Lab, with the short constants of the toe."""
    xyz = unpel_pel(r, d, _srgb_to_xyz(d))
    return unpel(xyz, _lab(list(V), _lab_f_short))


def unpel_pel(r: str, d, values: list[str], bands: int = 3) -> str:
    """Subquery of pels with new values, for another step on them."""
    return f"(SELECT image_id, x, y, {', '.join(f'{e} AS v{i}' for i, e in enumerate(values))} FROM {pel(r, bands)} p0)"


@cross_band(3)
def xyz2lab(d):
    return _lab(list(V), _lab_f)


@cross_band(3)
def lab2xyz(d):
    def back(t, w):
        return f"{w!r}e0 * (CASE WHEN {t} > {6 / 29!r}e0 THEN pow({t}, 3e0) ELSE {3 * (6 / 29) ** 2!r}e0 * ({t} - {4 / 29!r}e0) END)"

    fy = "((v0 + 16) / 116e0)"
    return [back(f"({fy} + v1 / 500e0)", WHITE_D65[0]), back(fy, WHITE_D65[1]), back(f"({fy} - v2 / 200e0)", WHITE_D65[2])]


def _degrees(b: str, a: str) -> str:
    h = f"(atan2({b}, {a}) * {180 / math.pi!r}e0)"
    return f"(CASE WHEN {h} < 0 THEN {h} + 360 ELSE {h} END)"


@cross_band(3)
def lab2lch(d):
    return ["v0", "sqrt(v1 * v1 + v2 * v2)", _degrees("v2", "v1")]


@cross_band(3)
def lch2lab(d):
    turn = f"(v2 * {math.pi / 180!r}e0)"
    return ["v0", f"v1 * cos({turn})", f"v1 * sin({turn})"]


_C16, _S16, _R16 = math.cos(math.radians(16)), math.sin(math.radians(16)), math.radians(16)


@cross_band(3)
def lab2din99(d):
    e, f = f"(v1 * {_C16!r}e0 + v2 * {_S16!r}e0)", f"((v2 * {_C16!r}e0 - v1 * {_S16!r}e0) * 0.7e0)"
    c, h = f"(ln(1 + 0.045e0 * sqrt({e} * {e} + {f} * {f})) / 0.045e0)", f"(atan2({f}, {e}) + {_R16!r}e0)"
    return ["105.51e0 * ln(1 + 0.0158e0 * v0)", f"{c} * cos({h})", f"{c} * sin({h})"]


@cross_band(3)
def din992lab(d):
    g, h = "((exp(0.045e0 * sqrt(v1 * v1 + v2 * v2)) - 1) / 0.045e0)", f"(atan2(v2, v1) - {_R16!r}e0)"
    e, f = f"({g} * cos({h}))", f"({g} * sin({h}) / 0.7e0)"
    return ["(exp(v0 / 105.51e0) - 1) / 0.0158e0", f"{e} * {_C16!r}e0 - {f} * {_S16!r}e0", f"{e} * {_S16!r}e0 + {f} * {_C16!r}e0"]


@cross_band(3)
def lab2labs(d):
    return [f"greatest(-32768e0, least(32767e0, {d.rint(f'{v} * {k}')}))" for v, k in zip(V, ("327.67e0", "256e0", "256e0"))]


@cross_band(3)
def labs2lab(d):
    return ["v0 / 327.67e0", "v1 / 256e0", "v2 / 256e0"]


@cross_band(3)
def xyz2yxy(d):
    total = "(v0 + v1 + v2)"
    return ["v1", f"CASE WHEN {total} = 0 THEN 0e0 ELSE v0 / {total} END", f"CASE WHEN {total} = 0 THEN 0e0 ELSE v1 / {total} END"]


@cross_band(3)
def yxy2xyz(d):
    return ["CASE WHEN v2 = 0 THEN 0e0 ELSE v1 * v0 / v2 END", "CASE WHEN v2 = 0 THEN 0e0 ELSE v0 END", "CASE WHEN v2 = 0 THEN 0e0 ELSE (1 - v1 - v2) * v0 / v2 END"]


@cross_band(3)
def xyz2oklab(d):
    return _times(d, LMS_TO_OKLAB, [f"cbrt({e})" for e in _times(d, XYZ_TO_LMS, V)])


@cross_band(3)
def oklab2xyz(d):
    return _times(d, LMS_TO_XYZ, [f"pow({e}, 3e0)" for e in _times(d, OKLAB_TO_LMS, V)])


@cross_band(3)
def oklab2oklch(d):
    return ["v0", "sqrt(v1 * v1 + v2 * v2)", _degrees("v2", "v1")]


@cross_band(3)
def oklch2oklab(d):
    turn = f"(v2 * {math.pi / 180!r}e0)"
    return ["v0", f"v1 * cos({turn})", f"v1 * sin({turn})"]


@cross_band(3)
def scrgb2xyz(d):
    return _times(d, RGB_TO_XYZ, V)


@cross_band(3)
def xyz2scrgb(d):
    return _times(d, XYZ_TO_RGB, V)


def _hue_sextant(r: str, g: str, b: str) -> str:
    """0 to 6."""
    span = f"(greatest({r}, {g}, {b}) - least({r}, {g}, {b}))"
    safe = f"(CASE WHEN {span} = 0 THEN 1e0 ELSE {span} END)"
    top = f"greatest({r}, {g}, {b})"
    h = f"(CASE WHEN {span} = 0 THEN 0e0 WHEN {top} = {r} THEN ({g} - {b}) / {safe} WHEN {top} = {g} THEN ({b} - {r}) / {safe} + 2 ELSE ({r} - {g}) / {safe} + 4 END)"
    return f"(CASE WHEN {h} < 0 THEN {h} + 6 ELSE {h} END)"


@cross_band(3)
def srgb2hsv(d):
    top, low = "greatest(v0, v1, v2)", "least(v0, v1, v2)"
    h = d.rint(f"{_hue_sextant(*V)} * 256e0 / 6e0")
    return [f"({h}) % 256", f"CASE WHEN {top} = 0 THEN 0e0 ELSE {d.div(f'255 * ({top} - {low})', f'CASE WHEN {top} = 0 THEN 1e0 ELSE {top} END')} END", top]


@cross_band(3)
def hsv2srgb(d):
    h = "(v0 * 6e0 / 256e0)"
    k, f, v = f"floor({h})", f"({h} - floor({h}))", "(v2 / 255e0)"
    p, q, t = f"({v} * (1 - v1 / 255e0))", f"({v} * (1 - v1 / 255e0 * {f}))", f"({v} * (1 - v1 / 255e0 * (1 - {f})))"
    out = []
    for parts in ((v, q, p, p, t, v), (t, v, v, q, p, p), (p, p, t, v, v, q)):
        cases = " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(parts))
        out.append(f"CASE WHEN v1 = 0 THEN v2 ELSE {d.u8_round(f'(CASE {d.long(k)} {cases} END) * 255')} END")
    return out


@cross_band(4)
def cmyk2xyz(d):
    return _times(d, RGB_TO_XYZ, [_to_linear(f"((1 - {v} / 255e0) * (1 - v3 / 255e0))") for v in V])


@cross_band(3)
def xyz2cmyk(d):
    rgb = [f"greatest(0e0, least(1e0, {_to_srgb(f'greatest(0e0, least(1e0, {e}))')}))" for e in _times(d, XYZ_TO_RGB, V)]
    k = f"(1 - greatest({', '.join(rgb)}))"
    inks = [f"CASE WHEN {k} >= 1 THEN 0e0 ELSE {d.u8_round(f'(1 - {e} - {k}) / (CASE WHEN {k} >= 1 THEN 1e0 ELSE 1 - {k} END) * 255')} END" for e in rgb]
    return [*inks, d.u8_round(f"{k} * 255")]


def _lab_pairs(a: str, b: str) -> str:
    cols = ", ".join(f"l.v{i} AS l{i}, q.v{i} AS q{i}" for i in range(3))
    return f"(SELECT l.image_id, l.x, l.y, {cols} FROM {pel(a, 3)} l JOIN {pel(b, 3)} q ON l.image_id = q.image_id AND l.x = q.x AND l.y = q.y)"


@operator(2)
def de76(d, a, b):
    e = "sqrt((l0 - q0) * (l0 - q0) + (l1 - q1) * (l1 - q1) + (l2 - q2) * (l2 - q2))"
    return f"SELECT image_id, x, y, 0 AS band, {e} AS v FROM {_lab_pairs(a, b)} p"


@operator(2)
def decmc(d, a, b, l: float = 2.0, c: float = 1.0):  # noqa: E741
    """CMC(l:c); the first image is the standard."""
    rad = f"{math.pi / 180!r}e0"
    s1 = f"(SELECT *, sqrt(l1 * l1 + l2 * l2) AS c1, sqrt(q1 * q1 + q2 * q2) AS c2, {_degrees('l2', 'l1')} AS h1 FROM {_lab_pairs(a, b)} p)"
    s2 = (f"(SELECT *, l0 - q0 AS dl, c1 - c2 AS dc, greatest(0e0, (l1 - q1) * (l1 - q1) + (l2 - q2) * (l2 - q2) - (c1 - c2) * (c1 - c2)) AS dh2, "
          f"CASE WHEN l0 < 16 THEN 0.511e0 ELSE 0.040975e0 * l0 / (1 + 0.01765e0 * l0) END AS sl, 0.0638e0 * c1 / (1 + 0.0131e0 * c1) + 0.638e0 AS sc, "
          f"sqrt(c1 * c1 * c1 * c1 / (c1 * c1 * c1 * c1 + 1900)) AS f, "
          f"CASE WHEN h1 >= 164 AND h1 <= 345 THEN 0.56e0 + abs(0.2e0 * cos((h1 + 168) * {rad})) ELSE 0.36e0 + abs(0.4e0 * cos((h1 + 35) * {rad})) END AS t FROM {s1} s1)")
    e = f"sqrt(pow(dl / ({d.num(l)} * sl), 2e0) + pow(dc / ({d.num(c)} * sc), 2e0) + dh2 / pow(sc * (f * t + 1 - f), 2e0))"
    return f"SELECT image_id, x, y, 0 AS band, {e} AS v FROM {s2} s2"


@operator(2)
def de2000(d, a, b):
    """CIEDE2000 with unit weights."""
    rad, p7 = f"{math.pi / 180!r}e0", "pow(25e0, 7e0)"
    s1 = f"(SELECT *, (sqrt(l1 * l1 + l2 * l2) + sqrt(q1 * q1 + q2 * q2)) / 2 AS cm FROM {_lab_pairs(a, b)} p)"
    s2 = f"(SELECT *, 1 + 0.5e0 * (1 - sqrt(pow(cm, 7e0) / (pow(cm, 7e0) + {p7}))) AS g FROM {s1} s1)"
    s3 = (f"(SELECT *, sqrt(l1 * g * l1 * g + l2 * l2) AS c1, sqrt(q1 * g * q1 * g + q2 * q2) AS c2, {_degrees('l2', '(l1 * g)')} AS h1, {_degrees('q2', '(q1 * g)')} AS h2 FROM {s2} s2)")
    s4 = (f"(SELECT *, q0 - l0 AS dl, c2 - c1 AS dc, (l0 + q0) / 2 AS lm, (c1 + c2) / 2 AS cm2, "
          f"CASE WHEN c1 * c2 = 0 THEN 0e0 WHEN abs(h2 - h1) <= 180 THEN h2 - h1 WHEN h2 - h1 > 180 THEN h2 - h1 - 360 ELSE h2 - h1 + 360 END AS dh, "
          f"CASE WHEN c1 * c2 = 0 THEN h1 + h2 WHEN abs(h1 - h2) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS hm FROM {s3} s3)")
    s5 = (f"(SELECT *, 2 * sqrt(c1 * c2) * sin(dh / 2 * {rad}) AS dhh, "
          f"1 - 0.17e0 * cos((hm - 30) * {rad}) + 0.24e0 * cos(2 * hm * {rad}) + 0.32e0 * cos((3 * hm + 6) * {rad}) - 0.2e0 * cos((4 * hm - 63) * {rad}) AS t, "
          f"2 * sqrt(pow(cm2, 7e0) / (pow(cm2, 7e0) + {p7})) AS rc, 30 * exp(-((hm - 275) / 25e0) * ((hm - 275) / 25e0)) AS turn, "
          f"1 + 0.015e0 * (lm - 50) * (lm - 50) / sqrt(20 + (lm - 50) * (lm - 50)) AS sl, 1 + 0.045e0 * cm2 AS sc FROM {s4} s4)")
    s6 = f"(SELECT *, 1 + 0.015e0 * cm2 * t AS sh, -sin(2 * turn * {rad}) * rc AS rt FROM {s5} s5)"
    e = "sqrt(greatest(0e0, dl / sl * dl / sl + dc / sc * dc / sc + dhh / sh * dhh / sh + rt * (dc / sc) * (dhh / sh)))"
    return f"SELECT image_id, x, y, 0 AS band, {e} AS v FROM {s6} s6"


@point
def dither_bayer(d, levels: int = 2, size: int = 4):
    """Ordered dithering with the Bayer matrix of size 4 or 8, by place."""
    matrix = [[0]]
    while len(matrix) < size:
        n = len(matrix)
        matrix = [[4 * matrix[y % n][x % n] + ((0, 2), (3, 1))[y // n][x // n] for x in range(2 * n)] for y in range(2 * n)]
    cells = " ".join(f"WHEN {y * size + x} THEN {matrix[y][x]}e0" for y in range(size) for x in range(size))
    step = 255 / (levels - 1)
    biased = f"(v + ((CASE (y % {size}) * {size} + x % {size} {cells} END) / {size * size}e0 - 5e-1) * {d.num(step)})"
    level = d.rint(f"greatest(0e0, least(255e0, {biased})) * {levels - 1} / 255e0")
    return d.u8_trunc(f"{level} * 255 / {d.num(levels - 1)}")


# Matrices of the film and colour-blindness presets.
KODACHROME = ((0.7297023, 0.4567681, -0.1530), (-0.0250, 0.8794651, 0.0512), (0.0270, 0.0972, 0.7406))
LOMOGRAPH = ((1.5, 0.0, 0.0), (0.0, 1.45, 0.0), (0.0, 0.0, 1.09))
COLOR_BLINDNESS = {
    "protanopia": ((0.567, 0.433, 0.000), (0.558, 0.442, 0.000), (0.000, 0.242, 0.758)),
    "protanomaly": ((0.817, 0.183, 0.000), (0.333, 0.667, 0.000), (0.000, 0.125, 0.875)),
    "deuteranopia": ((0.625, 0.375, 0.000), (0.700, 0.300, 0.000), (0.000, 0.300, 0.700)),
    "deuteranomaly": ((0.800, 0.200, 0.000), (0.258, 0.742, 0.000), (0.000, 0.142, 0.858)),
    "tritanopia": ((0.950, 0.050, 0.000), (0.000, 0.433, 0.567), (0.000, 0.475, 0.525)),
}


@cross_band(3)
def kodachrome(d):
    return recomb_values(d, KODACHROME)


@cross_band(3)
def lomograph(d):
    return recomb_values(d, LOMOGRAPH)


@cross_band(3)
def color_blindness(d, mode: str = "protanopia"):
    return recomb_values(d, COLOR_BLINDNESS[mode])


@operator(1)
def lightness(d, r, amount: float = 0.1):
    """Shift the L of HSL; hue and saturation stay."""
    top, low = "greatest(r, g, b)", "least(r, g, b)"
    rgb = unpel_pel(r, d, [f"{v} / 255e0" for v in V])
    named = f"(SELECT image_id, x, y, v0 AS r, v1 AS g, v2 AS b FROM {rgb} p1)"
    hsl = (f"(SELECT image_id, x, y, {_hue_sextant('r', 'g', 'b')} / 6e0 AS h, CASE WHEN {top} = {low} THEN 0e0 WHEN ({top} + {low}) / 2 > 5e-1 "
           f"THEN ({top} - {low}) / (2 - {top} - {low} + CASE WHEN {top} = {low} THEN 1e0 ELSE 0e0 END) ELSE ({top} - {low}) / (CASE WHEN {top} + {low} = 0 THEN 1e0 ELSE {top} + {low} END) END AS s, "
           f"greatest(0e0, least(1e0, ({top} + {low}) / 2 + {d.num(amount)})) AS l FROM {named} p2)")
    q = "(CASE WHEN l < 5e-1 THEN l * (1 + s) ELSE l + s - l * s END)"
    pq = f"(SELECT image_id, x, y, h, s, l, {q} AS q, 2 * l - {q} AS p FROM {hsl} p3)"

    def channel(shift: float) -> str:
        t = f"(h + {d.num(shift)} + CASE WHEN h + {d.num(shift)} < 0 THEN 1 WHEN h + {d.num(shift)} > 1 THEN -1 ELSE 0 END)"
        e = f"CASE WHEN s = 0 THEN l WHEN {t} < {1 / 6!r}e0 THEN p + (q - p) * 6 * {t} WHEN {t} < 5e-1 THEN q WHEN {t} < {2 / 3!r}e0 THEN p + (q - p) * ({2 / 3!r}e0 - {t}) * 6 ELSE p END"
        return d.u8_trunc(f"round(({e}) * 255 + 5e-1, 9)")

    return unpel(pq, [channel(1 / 3), channel(0.0), channel(-1 / 3)])


@cross_band(3)
def lab2labq(d):
    """10, 11 and 11 bits in four bytes; the second and third are the signed high parts, as bytes."""
    whole = [d.long(f"greatest({lo}e0, least({hi}e0, {d.rint(f'{v} * {k}')}))") for v, k, lo, hi in (("v0", "1023e0 / 100e0", 0, 1023), ("v1", "8e0", -1024, 1023), ("v2", "8e0", -1024, 1023))]
    high = [f"floor({w} / {n}e0)" for w, n in zip(whole, (4, 8, 8))]
    return [high[0], f"({high[1]} + 256) % 256", f"({high[2]} + 256) % 256",
            f"({whole[0]} - 4 * {high[0]}) * 64 + ({whole[1]} - 8 * {high[1]}) * 8 + ({whole[2]} - 8 * {high[2]})"]


@cross_band(4)
def labq2lab(d):
    signed = lambda v: f"(CASE WHEN {v} > 127 THEN {v} - 256 ELSE {v} END)"
    return ["(v0 * 4 + floor(v3 / 64e0)) * 100 / 1023e0", f"({signed('v1')} * 8 + floor(v3 / 8e0) % 8) / 8e0", f"({signed('v2')} * 8 + v3 % 8) / 8e0"]


# Constants of the perceptual quantizer and of the hybrid log-gamma curve, and the matrix of wide to narrow primaries.
PQ = {"m1": 2610 / 16384, "m2": 2523 / 4096 * 128, "c1": 3424 / 4096, "c2": 2413 / 4096 * 32, "c3": 2392 / 4096 * 32}
HLG_A = 0.17883277
WIDE_TO_NARROW = ((1.6605, -0.5876, -0.0728), (-0.1246, 1.1329, -0.0083), (-0.0182, -0.1006, 1.1187))


def _to_light(d, e: str, transfer: str) -> str:
    """Light of a code in 0 .. 1 by a transfer function; 100 candelas a square metre of PQ are 1."""
    if transfer == "linear":
        return e
    if transfer in ("bt709", "bt2020"):
        return f"CASE WHEN {e} < 81e-3 THEN {e} / 45e-1 ELSE power(({e} + 99e-3) / 1099e-3, {d.num(1 / 0.45)}) END"
    if transfer == "pq":
        p = f"power(greatest({e}, 0e0), {d.num(1 / PQ['m2'])})"
        return f"power(greatest({p} - {d.num(PQ['c1'])}, 0e0) / ({d.num(PQ['c2'])} - {d.num(PQ['c3'])} * {p}), {d.num(1 / PQ['m1'])}) * 100"
    if transfer == "hlg":
        b, c = 1 - 4 * HLG_A, 0.5 - HLG_A * math.log(4 * HLG_A)
        return f"CASE WHEN {e} <= 5e-1 THEN {e} * {e} / 3 ELSE (exp(({e} - {d.num(c)}) / {d.num(HLG_A)}) + {d.num(b)}) / 12 END"
    raise ValueError(f"no transfer function {transfer}")


@cross_band(3)
def cicp2scrgb(d, primaries: str = "bt2020", transfer: str = "pq", most: int = 255):
    """Codes 0 .. most of wide (bt2020) or narrow (bt709) primaries to linear light of narrow ones."""
    light = [f"({_to_light(d, f'({v} / {d.num(most)})', transfer)})" for v in V]
    return light if primaries == "bt709" else _times(d, WIDE_TO_NARROW, light)
