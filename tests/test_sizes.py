"""Operators on images of unequal sizes in one raster, against plain NumPy."""

import math

import numpy as np
import pytest

from pixelweft.operators import analysis, draw, effects, geometry, paths, pointwise, stencil

SCHEMA = "image_id int, x int, y int, band int, v double"
SHAPES = ((23, 37), (31, 14))  # rows and columns
RNG = np.random.default_rng(4)
IMAGES = [RNG.integers(0, 256, shape).astype(float) for shape in SHAPES]


@pytest.fixture(scope="module")
def raster(spark):
    rows = [(k, x, y, 0, float(m[y, x])) for k, m in enumerate(IMAGES) for y in range(m.shape[0]) for x in range(m.shape[1])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    df.cache().count()
    return df


def arrays(df):
    rows = df.toPandas()
    assert not rows.duplicated(["image_id", "x", "y", "band"]).any()
    out = []
    for k in range(len(IMAGES)):
        part = rows[rows.image_id == k]
        m = np.full((part.y.max() + 1, part.x.max() + 1), np.nan)
        m[part.y, part.x] = part.v
        assert not np.isnan(m).any()
        out.append(m)
    return out


def window(m, cells, outside):
    padded = np.pad(m, 3, constant_values=outside)
    return np.stack([padded[3 + dy: 3 + dy + m.shape[0], 3 + dx: 3 + dx + m.shape[1]] for dx, dy in cells])


NINE = [(i - 1, j - 1) for j in range(3) for i in range(3)]


def conv(m):
    w = np.array([0, 1, 0, 1, 4, 1, 0, 1, 0])
    return np.floor((window(m, NINE, 0) * w[:, None, None]).sum(0) / 8)


def rank(m, index=4):
    w = np.sort(window(m, NINE, np.nan), axis=0)
    n = (~np.isnan(w)).sum(0)
    return np.take_along_axis(w, np.minimum(index, n - 1)[None], 0)[0]


def embed(m):
    out = np.full((m.shape[0] + 10, m.shape[1] + 9), 7.0)
    out[2: 2 + m.shape[0], 3: 3 + m.shape[1]] = m
    return out


def mirrored(m):
    y, x = (np.array([t if t < n else 2 * n - 1 - t for t in np.arange(-a, n + b) % (2 * n)]) for n, a, b in ((m.shape[0], 2, 8), (m.shape[1], 3, 6)))
    return m[y][:, x]


def resample(m, scale, kernel, support):
    """Rows along x."""
    n, size = m.shape[1], max(1, round(m.shape[1] * scale))
    out = np.zeros((m.shape[0], size))
    for o in range(size):
        at = (o + 0.5) / scale - 0.5
        k = np.arange(math.floor(at) - support + 1, math.floor(at) + support + 1)
        w = np.array([kernel(t - at) for t in k])
        out[:, o] = (m[:, np.clip(k, 0, n - 1)] * w).sum(1) / (w.sum() or 1)
    return np.floor(np.clip(np.round(out, 6), 0, 255))


def lanczos3(x):
    return 0.0 if abs(x) >= 3 else 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x) * math.sin(math.pi * x / 3) / (math.pi * x / 3)


def linear(x):
    return max(0.0, 1 - abs(x))


def shrink(m):
    h, w = m.shape[0] // 3 * 3, m.shape[1] // 2 * 2
    return np.floor(m[:h, :w].reshape(h // 3, 3, w // 2, 2).mean((1, 3)))


def box(m, radius):
    out = np.zeros_like(m)
    for y in range(m.shape[0]):
        for x in range(m.shape[1]):
            out[y, x] = math.floor(m[max(0, y - radius): y + radius + 1, max(0, x - radius): x + radius + 1].mean())
    return out


def oil(m, radius=2, levels=12):
    out = np.zeros_like(m)
    for y in range(m.shape[0]):
        for x in range(m.shape[1]):
            count, total, best, most = {}, {}, 0, -1
            for v in m[max(0, y - radius): y + radius + 1, max(0, x - radius): x + radius + 1].ravel():
                cell = int(v) * levels // 256
                count[cell], total[cell] = count.get(cell, 0) + 1, total.get(cell, 0) + v
                if count[cell] > most:
                    best, most = cell, count[cell]
            out[y, x] = total[best] // count[best]
    return out


def hexagonal(m):
    k = np.array(stencil.hexagon(2)) > 0
    return np.floor(window(m, [(i - 2, j - 2) for j in range(5) for i in range(5) if k[j, i]], 0).sum(0) / k.sum())


CASES = {
    "conv": (stencil.conv, {}, conv),
    "median": (stencil.rank, {}, rank),
    "dilate": (stencil.morph, {}, lambda m: window(m, NINE, -1).max(0)),
    "erode": (stencil.morph, {"method": "erode"}, lambda m: window(m, NINE, 999).min(0)),
    "bokeh": (stencil.bokeh_blur, {}, hexagonal),
    "resize1d": (stencil.resize1d, {"scale": 0.7}, lambda m: resample(m, 0.7, linear, 1)),
    "lanczos": (stencil.resize1d, {"scale": 1.6, "vertical": True, "kernel": "lanczos3"}, lambda m: resample(m.T, 1.6, lanczos3, 3).T),
    "resize": (geometry.resize, {"scale": 0.8}, lambda m: resample(resample(m, round(0.8 * m.shape[1] / m.shape[1], 15), linear, 1).T, 0.8, linear, 1).T),
    "flip": (geometry.flip, {}, lambda m: m[:, ::-1]),
    "flip_vertical": (geometry.flip, {"vertical": True}, lambda m: m[::-1]),
    "rotate_90": (geometry.rotate90, {}, lambda m: np.rot90(m, -1)),
    "rotate_180": (geometry.rotate90, {"angle": 180}, lambda m: np.rot90(m, 2)),
    "rotate_270": (geometry.rotate90, {"angle": 270}, lambda m: np.rot90(m)),
    "orient_7": (geometry.auto_orient, {"orientation": 7}, lambda m: m.T[::-1, ::-1]),
    "shrink": (geometry.shrink, {}, shrink),
    "replicate": (geometry.replicate, {}, lambda m: np.tile(m, (2, 2))),
    "wrap": (geometry.wrap, {}, lambda m: np.roll(m, (-(m.shape[0] // 2), -(m.shape[1] // 2)), (0, 1))),
    "embed": (geometry.embed, {"extend": "background", "background": (7,)}, embed),
    "mirror": (geometry.embed, {"extend": "mirror"}, mirrored),
    "charcoal": (effects.charcoal, {"bands": 1}, lambda m: np.maximum(0, 255 - 3 * abs(m - box(m, 1)))),
    "oil": (effects.oil_paint, {"bands": 1, "radius": 2}, oil),
    "byteswap": (pointwise.byteswap, {}, lambda m: m * 256),
}


@pytest.mark.parametrize("name", CASES)
def test_like_numpy(raster, name):
    op, how, plain = CASES[name]
    for got, m in zip(arrays(op(raster, **how)), IMAGES):
        np.testing.assert_array_equal(got, plain(m))


def test_wrap_direction(raster):
    got = arrays(geometry.wrap(raster, dx=1, dy=0))
    assert all((g == np.roll(m, -1, 1)).all() for g, m in zip(got, IMAGES))


def test_template_of_each_image(raster):
    got = arrays(stencil.fastcor(raster, raster.where("x < 3 AND y < 4")))
    for g, m in zip(got, IMAGES):
        want = sum(m[j: m.shape[0] - 3 + j, i: m.shape[1] - 2 + i] * m[j, i] for j in range(4) for i in range(3))
        np.testing.assert_array_equal(g, want)


def test_measures_of_unequal_images(raster):
    rows = analysis.profile(raster.where("NOT (image_id = 1 AND y = 0 AND x < 3)").unionByName(raster.where("image_id = 1 AND y = 0 AND x < 3").selectExpr("image_id", "x", "y", "band", "0e0 AS v"))).collect()
    got = {(r.image_id, r.axis, r.place): r.v for r in rows}
    for k, m in enumerate(IMAGES):
        m = m.copy()
        if k:
            m[0, :3] = 0
        assert all(got[k, "x", x] == next((y for y in range(m.shape[0]) if m[y, x]), m.shape[0]) for x in range(m.shape[1]))
        assert all(got[k, "y", y] == next((x for x in range(m.shape[1]) if m[y, x]), m.shape[1]) for y in range(m.shape[0]))


def test_skew_is_found_and_taken_back(spark):
    side = 120
    rows = [(k, x, y, 0, 0.0 if 10 < (y - k * 0.08 * x) < 110 and (y - k * 0.08 * x) % 24 < 6 else 255.0) for k in range(2) for y in range(side) for x in range(side)]
    df = spark.createDataFrame(rows, SCHEMA)
    skews = effects.detect_skew(effects.analysis_copy(df, bands=1))
    got = {r.image_id: r.degrees for r in skews.collect()}
    assert abs(got[0]) < 0.6 and abs(got[1] - math.degrees(math.atan(0.08))) < 0.8
    straight = effects.deskew(df, skews)
    again = {r.image_id: r.degrees for r in effects.detect_skew(effects.analysis_copy(straight, bands=1)).collect()}
    assert abs(again[1]) < 0.8


def test_line_shares_its_steps():
    cover = draw.line_cover(0, 0, 4, 2)
    assert cover[0, 0][0] == 0.5 and cover[1, 0] == [0.5] and cover[1, 1] == [0.5] and cover[2, 1] == [1.0]
    assert draw.line_cover(3, 1, 3, 4) == {(3, y): [1.0] for y in range(1, 5)}


def covered(m, path):
    """Shares of the pixels inside a path, by scan lines in plain Python."""
    out = np.zeros(m.shape)
    for y in range(m.shape[0]):
        for k in range(4):
            scan = y + (k + 0.5) / 4
            xs = sorted(x0 + (scan - y0) / (y1 - y0) * (x1 - x0) for x0, y0, x1, y1 in paths.edges(path) if (y0 <= scan < y1) or (y1 <= scan < y0))
            for a, b in zip(xs[::2], xs[1::2]):
                for x in range(m.shape[1]):
                    out[y, x] += max(0.0, min(x + 1, b) - max(x, a)) / 4
    return out


@pytest.mark.parametrize("name", ["polygon", "circle"])
def test_filled_paths(raster, name):
    points = ((1, 2), (12, 6), (9, 18), (3, 15))
    path, op, how = {"polygon": (paths.polygon(*points), paths.fill_polygon, {"points": points}), "circle": (paths.circle(7, 9, 5.5), paths.fill_circle, {"cx": 7.0, "cy": 9.0, "radius": 5.5})}[name]
    for got, m in zip(arrays(op(raster, ink=(200,), **how)), IMAGES):
        cover = covered(m, path)
        want = np.where(cover >= 0.999, 200, np.rint(m * (1 - cover) + 200 * cover))
        assert np.abs(got - want).max() <= 1 and (got == want).mean() > 0.99  # a rounding tie apart
    assert abs(covered(np.zeros((30, 30)), paths.circle(15, 15, 9)).sum() - math.pi * 81) < 2


@pytest.mark.parametrize("strip", [4, 5, 1024])
def test_windows_down_strips_see_across_them(spark, monkeypatch, strip):
    """Tall images in strips of few rows give what one strip gives."""
    monkeypatch.setattr(stencil, "STRIP", strip)
    rng = np.random.default_rng(8)
    images = [rng.integers(0, 256, (h, w)) for h, w in ((23, 5), (8, 4), (1, 3), (16, 1))]
    rows = [(k, x, y, 0, float(v)) for k, m in enumerate(images) for (y, x), v in np.ndenumerate(m)]
    tall = spark.createDataFrame(rows, "image_id int, x int, y int, band int, v double").repartition(5)
    mask = rng.integers(-2, 3, (5, 3))
    got = {(r.image_id, r.x, r.y): r.v for r in stencil.conv(tall, mask=mask.tolist(), divisor=1.0, real=True).collect()}
    edge = {(r.image_id, r.x, r.y): r.v for r in stencil.sobel(tall).collect()}
    down = {(r.image_id, r.x, r.y): r.v for r in stencil.conv1d(tall, kernel=(0.5, 0.25, 0.125, 0.0625, 0.0625), vertical=True, real=True).collect()}
    assert len(got) == len(edge) == len(down) == len(rows)
    for k, m in enumerate(images):
        p, e, q = np.pad(m, ((2, 2), (1, 1))), np.pad(m, 1, mode="edge"), np.pad(m, ((2, 2), (0, 0)))
        for (y, x), _ in np.ndenumerate(m):
            assert got[k, x, y] == (p[y: y + 5, x: x + 3] * mask).sum()
            assert down[k, x, y] == (q[y: y + 5, x] * (0.5, 0.25, 0.125, 0.0625, 0.0625)).sum()
            n = e[y: y + 3, x: x + 3]
            gx, gy = n[0, 2] + 2 * n[1, 2] + n[2, 2] - n[0, 0] - 2 * n[1, 0] - n[2, 0], n[2, 0] + 2 * n[2, 1] + n[2, 2] - n[0, 0] - 2 * n[0, 1] - n[0, 2]
            assert edge[k, x, y] in (min(255, int(math.hypot(gx, gy))), min(255, abs(gx) + abs(gy)))
