"""The band axis: extraction, joining, folding, alpha."""

from __future__ import annotations

from ..plans.sqlop import KEY, Operator, operator, pel, unpel


@operator(1)
def extract_band(d, r, band: int = 0, n: int = 1):
    return f"SELECT image_id, x, y, band - {band} AS band, v FROM {r} WHERE band >= {band} AND band < {band + n}"


@operator(2)
def bandjoin(d, first, second, bands: int = 3):
    """The bands of the first, which has `bands`, then those of the second."""
    return f"SELECT {KEY}, v FROM {first} a UNION ALL SELECT image_id, x, y, band + {bands} AS band, v FROM {second} b"


@operator(1)
def bandjoin_const(d, r, c=(255,), bands: int = 3):
    rows = ", ".join(f"({bands + i}, {d.num(min(255, max(0, k)))})" for i, k in enumerate(c))
    return f"SELECT {KEY}, v FROM {r} a UNION ALL SELECT image_id, x, y, c.band, c.v FROM {r} b CROSS JOIN (VALUES {rows}) AS c(band, v) WHERE b.band = 0"


@operator(1)
def bandmean(d, r, real: bool = False):
    e = "sum(v) / count(*)" if real else "floor((sum(v) + floor(count(*) / 2e0)) / count(*))"
    return f"SELECT image_id, x, y, 0 AS band, CAST({e} AS DOUBLE) AS v FROM {r} GROUP BY image_id, x, y"


@operator(1)
def bandbool(d, r, op: str = "and"):
    return f"SELECT image_id, x, y, 0 AS band, CAST(bit_{op}({d.long('v')}) AS DOUBLE) AS v FROM {r} GROUP BY image_id, x, y"


@operator(1)
def bandrank(d, r, index: int = -1, images: int = 5):
    """Of all images of a raster the index-th smallest value at each place; -1 is the middle one."""
    k = images // 2 if index < 0 else index
    return f"SELECT 0 AS image_id, x, y, band, {d.item(d.sorted_list('v'), k)} AS v FROM {r} GROUP BY x, y, band"


@operator(1)
def bandfold(d, r, factor: int = 3, bands: int = 3):
    """Each stretch of `factor` pixels of a row becomes one pixel of factor times as many bands."""
    return f"SELECT image_id, floor(x / {d.num(factor)}) AS x, y, band + {bands} * (x % {factor}) AS band, v FROM {r}"


@operator(1)
def bandunfold(d, r, factor: int = 3, bands: int = 3):
    """The inverse: `bands` is the number of bands before, a multiple of factor."""
    per = bands // factor
    return f"SELECT image_id, x * {factor} + floor(band / {d.num(per)}) AS x, y, band % {per} AS band, v FROM {r}"


@operator(1)
def add_alpha(d, r, alpha: float = 255.0, bands: int = 3):
    if bands in (2, 4):
        return f"SELECT {KEY}, v FROM {r}"
    return bandjoin_const.write(d, r, c=(alpha,), bands=bands)


@operator(1)
def opacity(d, r, amount: float = 0.5, bands: int = 4):
    if bands not in (2, 4):
        return f"SELECT {KEY}, v FROM {r}"
    return f"SELECT {KEY}, CASE WHEN band = {bands - 1} THEN {d.u8_round(f'v * {d.num(amount)}')} ELSE v END AS v FROM {r}"


@operator(1)
def premultiply(d, r, bands: int = 4):
    a = f"v{bands - 1}"
    return unpel(pel(r, bands), [d.div(f"v{b} * {a} + 127", "255e0") for b in range(bands - 1)] + [a])


@operator(1)
def unpremultiply(d, r, bands: int = 4):
    a = f"v{bands - 1}"
    return unpel(pel(r, bands), [f"CASE WHEN {a} = 0 THEN 0e0 ELSE least(255e0, {d.div(f'v{b} * 255', f'CASE WHEN {a} = 0 THEN 1e0 ELSE {a} END')}) END" for b in range(bands - 1)] + [a])


def _flat(d, bands: int, background) -> list[str]:
    a = f"v{bands - 1}"
    bg = [d.num(background[b] if b < len(background) else background[0]) for b in range(bands - 1)]
    return [f"CASE WHEN {a} = 255 THEN v{b} WHEN {a} = 0 THEN {bg[b]} ELSE {d.div(f'v{b} * {a} + {bg[b]} * (255 - {a}) + 127', '255e0')} END" for b in range(bands - 1)]


@operator(1)
def flatten(d, r, background=(0,), bands: int = 4):
    return unpel(pel(r, bands), _flat(d, bands, background))


@operator(1)
def background_color(d, r, background=(0,), bands: int = 4):
    """Flatten and give the result an opaque alpha again."""
    return unpel(pel(r, bands), [*_flat(d, bands, background), "255e0"])


def _permuted(doc: str, pick) -> Operator:
    def write(d, r, bands: int = 3):
        return unpel(pel(r, bands), pick(d, bands))

    write.__doc__ = doc
    return Operator(write, 1)


def _rgb(n: int) -> list[str]:
    return ["v0", "v1", "v2"] if n >= 3 else ["v0"] * 3


def _alpha(n: int) -> list[str]:
    return [f"v{n - 1}"] if n in (2, 4) else ["255e0"]


to_l8 = _permuted("Luma by ITU-R BT.601.", lambda d, n: [d.luma601("v0", "v1", "v2") if n >= 3 else "v0"])
to_la16 = _permuted("Luma and alpha.", lambda d, n: [d.luma601("v0", "v1", "v2") if n >= 3 else "v0", *_alpha(n)])
to_rgb24 = _permuted("Three bands, alpha dropped.", lambda d, n: _rgb(n))
to_rgba32 = _permuted("Three bands and alpha.", lambda d, n: [*_rgb(n), *_alpha(n)])
swap_rb = _permuted("First and third band change places.", lambda d, n: ["v2", "v1", "v0", *(["v3"] if n > 3 else [])])
to_argb = _permuted("Alpha first.", lambda d, n: [*_alpha(n), *_rgb(n)])
