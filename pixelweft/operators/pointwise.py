"""Pointwise arithmetic, relational, boolean and mathematical operators. 8-bit images unless `real` is set."""

from __future__ import annotations

import math

from ..plans.sqlop import KEY, operator, pair, point


def _by_band(d, values: list[float]) -> str:
    """The band's value of a short list, that of the first for further bands."""
    if len(values) == 1:
        return d.num(values[0])
    return "CASE band " + " ".join(f"WHEN {b} THEN {d.num(v)}" for b, v in enumerate(values)) + f" ELSE {d.num(values[0])} END"


@point
def invert(d, real: bool = False):
    return "-v" if real else "255 - v"


@point
def linear(d, a=(1.0,), b=(0.0,), real: bool = False):
    e = f"v * ({_by_band(d, list(a))}) + ({_by_band(d, list(b))})"
    return e if real else d.u8_trunc(e)


@pair
def add(d, real: bool = False):
    return "l.v + q.v" if real else "least(255e0, l.v + q.v)"


@pair
def subtract(d, real: bool = False):
    return "l.v - q.v" if real else "greatest(0e0, l.v - q.v)"


@pair
def multiply(d, real: bool = False):
    return "l.v * q.v" if real else d.div("l.v * q.v + 127", "255e0")


@pair
def divide(d, real: bool = False):
    return "CASE WHEN q.v = 0 THEN 0 ELSE l.v / q.v END" if real else f"CASE WHEN q.v = 0 THEN 0 ELSE least(255e0, {d.div('l.v * 255', 'CASE WHEN q.v = 0 THEN 1e0 ELSE q.v END')}) END"


@pair
def remainder(d):
    return "CASE WHEN q.v = 0 THEN 0 ELSE l.v % (CASE WHEN q.v = 0 THEN 1 ELSE q.v END) END"


@operator(1)
def sum_images(d, r):
    """Sum over all images of a raster, place by place."""
    return f"SELECT 0 AS image_id, x, y, band, least(255e0, sum(v)) AS v FROM {r} GROUP BY x, y, band"


@operator(1)
def min_image(d, r):
    return f"SELECT 0 AS image_id, x, y, band, min(v) AS v FROM {r} GROUP BY x, y, band"


@operator(1)
def max_image(d, r):
    return f"SELECT 0 AS image_id, x, y, band, max(v) AS v FROM {r} GROUP BY x, y, band"


#: Function -> (8-bit form of u = v / 255 before scaling to 255, or None where 8-bit values stay; form for real values)
MATH = {
    "abs": (None, "abs(v)"), "sin": ("(sin({u} * {tau}) + 1) * 5e-1", "sin(v)"), "cos": ("(cos({u} * {tau}) + 1) * 5e-1", "cos(v)"),
    "tan": ("(tan({u} * {tau}) + 1) * 5e-1", "tan(v)"), "log": ("ln(1 + {u} * ({e} - 1))", "ln(v)"), "log10": ("log10(1 + 9 * {u})", "log10(v)"),
    "exp": ("(exp({u}) - 1) / ({e} - 1)", "exp(v)"), "exp10": ("(pow(10e0, {u}) - 1) / 9", "pow(10e0, v)"), "sqrt": ("sqrt({u})", "sqrt(v)"),
    "sign": ("CASE WHEN {u} > 0 THEN 1e0 ELSE 0e0 END", "CAST(sign(v) AS DOUBLE)"), "floor": (None, "floor(v)"), "ceil": (None, "ceil(v)"),
    "rint": (None, "{rint}"), "atan": ("atan({u}) / ({pi} / 4)", "atan(v)"), "pow": ("pow({u}, {p})", "pow(v, {p})"),
}


@point
def math_op(d, function: str = "sin", operand: float = 1.0, real: bool = False):
    """One of MATH; 8-bit values are read as v / 255 and scaled back, clamped and truncated."""
    small, raw = MATH[function]
    names = {"u": "(v / 255e0)", "tau": d.num(2 * math.pi), "pi": d.num(math.pi), "e": d.num(math.e), "p": d.num(operand), "rint": d.rint("v")}
    if real:
        return raw.format(**names)
    return "v" if small is None else d.u8_trunc(f"({small.format(**names)}) * 255")


@pair
def math2(d, function: str = "pow", real: bool = True):
    """pow(l, q), wop = pow(q, l), or atan2(l, q)."""
    e = {"pow": "pow(l.v, q.v)", "wop": "pow(q.v, l.v)", "atan2": "atan2(l.v, q.v)"}[function]
    return e if real else d.u8_trunc(e)


def _bits(d, op: str, a: str, c: str) -> str:
    a, c = d.long(a), d.long(c)
    e = {"and": f"(({a}) & ({c}))", "or": f"(({a}) | ({c}))", "xor": d.xor(a, c),
         "lshift": f"least(255, {d.shift_left(a, f'CAST((({c}) & 7) AS INT)')})", "rshift": d.shift_right(a, f"CAST((({c}) & 7) AS INT)")}[op]
    return f"CAST({e} AS DOUBLE)"


@point
def boolean_const(d, op: str = "and", c=(15,)):
    return _bits(d, op, "v", _by_band(d, [min(255, max(0, int(k))) for k in c]))


@pair
def boolean(d, op: str = "and"):
    return _bits(d, op, "l.v", "q.v")


RELATIONS = {"equal": "=", "noteq": "<>", "less": "<", "lesseq": "<=", "more": ">", "moreeq": ">="}


@point
def relational_const(d, op: str = "more", c=(128,)):
    return f"CASE WHEN v {RELATIONS[op]} ({_by_band(d, list(c))}) THEN 255e0 ELSE 0e0 END"


@pair
def relational(d, op: str = "more"):
    return f"CASE WHEN l.v {RELATIONS[op]} q.v THEN 255e0 ELSE 0e0 END"


@point
def clamp(d, low: float = 0.0, high: float = 255.0):
    return f"greatest({d.num(low)}, least({d.num(high)}, v))"


@point
def threshold(d, value: float = 128.0):
    return f"CASE WHEN v >= {d.num(value)} THEN 255e0 ELSE 0e0 END"


@operator(3)
def ifthenelse(d, condition, then, other):
    """Where the condition's band (or its only one) is not 0, the second image, else the third."""
    on = lambda a, b: f"{a}.image_id = {b}.image_id AND {a}.x = {b}.x AND {a}.y = {b}.y"
    return (f"SELECT a.image_id, a.x, a.y, a.band, CASE WHEN c.v <> 0 THEN a.v ELSE b.v END AS v FROM {then} a JOIN {other} b ON {on('a', 'b')} AND a.band = b.band "
            f"JOIN {condition} c ON {on('a', 'c')} AND c.band = a.band")


@operator(1)
def switch(d, r, images: int = 5):
    """Number of the first image that is not 0, their number if none is."""
    return f"SELECT 0 AS image_id, x, y, band, CAST(coalesce(min(CASE WHEN v <> 0 THEN image_id END), {images}) AS DOUBLE) AS v FROM {r} GROUP BY x, y, band"


@operator(2)
def case(d, index, cases, images: int = 5):
    """At each place the value of the image that the index names, the last for larger ones."""
    return f"SELECT i.image_id, c.x, c.y, c.band, c.v FROM {index} i JOIN {cases} c ON c.image_id = least(i.v, {images} - 1) AND c.x = i.x AND c.y = i.y AND c.band = i.band"


#: Least and largest value of the whole-number formats. Fixed values.
FORMATS = {"uchar": (0, 255), "char": (-128, 127), "ushort": (0, 65535), "short": (-32768, 32767), "uint": (0, 4294967295), "int": (-2147483648, 2147483647)}


@point
def cast(d, format: str = "ushort"):
    """To a whole-number format, rounded half to even and clamped; float and double stay as they are."""
    if format in ("float", "double"):
        return "CAST(v AS DOUBLE)"
    low, high = FORMATS[format]
    return f"CAST(greatest({d.num(low)}, least({d.num(high)}, {d.rint('v')})) AS DOUBLE)"


@point
def byteswap(d, bytes: int = 2):
    """The bytes of unsigned whole numbers in the other order."""
    parts = [f"(CAST(floor(v / {d.num(256 ** k)}) AS BIGINT) % 256) * {256 ** (bytes - 1 - k)}" for k in range(bytes)]
    return f"CAST({' + '.join(parts)} AS DOUBLE)"


@point
def copy(d):
    return "v"


@point
def cast_uchar(d):
    return d.u8_round("v")


@point
def cast_float(d):
    return "CAST(CAST(v AS FLOAT) AS DOUBLE)"


@operator(1)
def scale(d, r, log: bool = False, exponent: float = 0.25):
    """Stretch each image from its own least to its largest value, over all bands, to 0..255."""
    p = d.num(exponent)
    e = (f"ln(1 + pow(abs(v), {p})) * 255 / CASE WHEN hi = 0 THEN 1e0 ELSE ln(1 + pow(abs(hi), {p})) END" if log
         else "CASE WHEN hi = lo THEN 0e0 ELSE (v - lo) * 255 / (CASE WHEN hi = lo THEN 1e0 ELSE hi - lo END) END")
    return f"SELECT r.image_id, x, y, band, {d.u8_trunc(e)} AS v FROM {r} r JOIN (SELECT image_id, min(v) AS lo, max(v) AS hi FROM {r} GROUP BY image_id) m ON r.image_id = m.image_id"


@operator(2)
def maplut(d, r, lut):
    """Look every value up in lut(band, idx, val); a table of at most 65,536 places per band."""
    return f"SELECT r.image_id, r.x, r.y, r.band, CAST(t.val AS DOUBLE) AS v FROM {r} r JOIN {lut} t ON t.band = r.band AND t.idx = r.v"


@operator(1)
def falsecolor(d, r):
    """Jet colours of a one-band image."""
    def ramp(k):
        return d.u8_trunc(f"greatest(0e0, least(1e0, 1.5e0 - abs(4 * v / 255e0 - {k}))) * 255")

    return f"SELECT image_id, x, y, b AS band, CASE b WHEN 0 THEN {ramp(3)} WHEN 1 THEN {ramp(2)} ELSE {ramp(1)} END AS v FROM {r} CROSS JOIN (VALUES (0), (1), (2)) AS t(b)"


__all__ = [n for n in dir() if not n.startswith("_")]
