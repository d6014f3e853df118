"""Pyramids and their files, transfer functions, upright pages and error diffusion against plain ports."""

import math
import re

import numpy as np
import pytest

from pixelweft.operators import analysis, arrays, colour, geometry, pyramid
from pixelweft.sources.codecs import decode_jpeg, decode_png
from tests.test_arrays import frame, image


def halve(a):
    """Linear resampling to half the size, odd sides up, along x and then along y; truncated each time."""
    for axis in (1, 0):
        n = a.shape[axis]
        m = (n + 1) // 2
        if m == n:
            continue
        at = (np.arange(m) + 0.5) * n / m - 0.5
        low = np.floor(at).astype(int)
        w = at - low
        one, two = (a.take(np.clip(k, 0, n - 1), axis=axis).astype(float) for k in (low, low + 1))
        w = w[None, :, None] if axis == 1 else w[:, None, None]
        a = np.floor((one * (1 - w) + two * w).round(6)).astype(int)
    return a


def ladder(a):
    out = [a]
    while max(out[-1].shape[:2]) > 1:
        out.append(halve(out[-1]))
    return out[::-1]


IMAGES = [np.random.default_rng(1).integers(0, 256, (37, 22, 3)), np.random.default_rng(2).integers(0, 256, (5, 64, 3)), np.full((1, 1, 3), 7)]


def test_levels_of_unequal_images(spark):
    got = pyramid.levels(frame(spark, *IMAGES))
    depth = {r.image_id: r.d for r in got.groupBy("image_id").agg({"level": "max"}).withColumnRenamed("max(level)", "d").collect()}
    for k, a in enumerate(IMAGES):
        want = ladder(a)
        assert depth[k] == len(want) - 1
        for level, b in enumerate(want):
            assert (image(got.where(f"level = {level}").drop("level"), k) == b).all()
    assert pyramid.levels(frame(spark, *IMAGES).limit(0)).collect() == []


def rectangles(w, h, tile, overlap):
    for row in range(-(-h // tile)):
        for col in range(-(-w // tile)):
            x, y = col * tile - (overlap if col else 0), row * tile - (overlap if row else 0)
            yield col, row, x, y, min((col + 1) * tile + overlap, w), min((row + 1) * tile + overlap, h)


@pytest.mark.parametrize("tile, overlap", [(8, 1), (16, 0), (5, 2), (256, 1)])
def test_files_of_a_viewer(spark, tile, overlap):
    files = {r.name: bytes(r.content) for r in pyramid.deep_zoom(frame(spark, *IMAGES), tile=tile, overlap=overlap).collect()}
    want = {}
    for k, a in enumerate(IMAGES):
        for level, b in enumerate(ladder(a)):
            for col, row, x, y, right, bottom in rectangles(b.shape[1], b.shape[0], tile, overlap):
                want[f"image{k}_files/{level}/{col}_{row}.png"] = b[y:bottom, x:right]
    tiles = {n: decode_png(c) for n, c in files.items() if n.endswith(".png")}
    assert tiles.keys() == want.keys() and all((tiles[n] == want[n]).all() for n in want)
    assert sorted(n for n in files if n not in want) == [f"image{k}.dzi" for k in range(3)]
    about = files["image0.dzi"].decode()
    assert f'TileSize="{tile}" Overlap="{overlap}" Format="png"' in about and 'Width="22" Height="37"' in about


def test_other_layouts(spark):
    df = frame(spark, IMAGES[0])
    names = {layout: {r.name: bytes(r.content) for r in pyramid.deep_zoom(df, tile=8, layout=layout, format="jpeg").collect()} for layout in ("google", "zoomify", "iiif")}
    sizes = [(b.shape[1], b.shape[0]) for b in ladder(IMAGES[0])]
    cells = [(level, col, row) for level, (w, h) in enumerate(sizes) for col, row, *_ in rectangles(w, h, 8, 0)]
    assert set(names["google"]) == {f"image0/{level}/{col}/{row}.jpg" for level, col, row in cells}
    assert set(names["zoomify"]) == {f"image0/TileGroup{k // 256}/{level}-{col}-{row}.jpg" for k, (level, col, row) in enumerate(sorted(cells, key=lambda c: (c[0], c[2], c[1])))} | {"image0/ImageProperties.xml"}
    assert f'NUMTILES="{len(cells)}"' in names["zoomify"]["image0/ImageProperties.xml"].decode()
    assert re.search(r'"scaleFactors": \[64,32,16,8,4,2,1\]', names["iiif"]["image0/info.json"].decode())
    assert {"image0/0,0,8,8/8,/0/default.jpg", "image0/16,32,6,5/6,/0/default.jpg", "image0/0,0,22,37/1,/0/default.jpg"} <= set(names["iiif"])
    assert decode_jpeg(names["google"]["image0/6/0/0.jpg"]).shape == (8, 8, 3)
    with pytest.raises(ValueError):
        pyramid.deep_zoom(df, layout="other")


def test_a_rerun_leaves_no_stray_tile(spark, tmp_path):
    target = f"{tmp_path}/tiles"
    for size in (8, 16):
        pyramid.deep_zoom(frame(spark, IMAGES[0]), tile=size).write.mode("overwrite").parquet(target)
    names = {r.name for r in spark.read.parquet(target).collect()}
    assert names == {r.name for r in pyramid.deep_zoom(frame(spark, IMAGES[0]), tile=16).collect()}


def light(e, transfer):
    if transfer == "linear":
        return e
    if transfer in ("bt709", "bt2020"):
        return e / 4.5 if e < 0.081 else ((e + 0.099) / 1.099) ** (1 / 0.45)
    if transfer == "pq":
        p = e ** (32 / 2523)
        return (max(p - 0.8359375, 0) / (18.8515625 - 18.6875 * p)) ** (16384 / 2610) * 100
    c = 0.5 - 0.17883277 * math.log(4 * 0.17883277)
    return e * e / 3 if e <= 0.5 else (math.exp((e - c) / 0.17883277) + 1 - 4 * 0.17883277) / 12


@pytest.mark.parametrize("transfer", ["linear", "bt709", "bt2020", "pq", "hlg"])
def test_codes_to_light(spark, transfer):
    a = np.arange(256 * 3).reshape(16, 16, 3) * 37 % 256
    want = np.vectorize(lambda v: light(v / 255, transfer))(a)
    assert np.allclose(image(colour.cicp2scrgb(frame(spark, a), primaries="bt709", transfer=transfer)), want, atol=1e-9)
    wide = want @ np.array([[1.6605, -0.5876, -0.0728], [-0.1246, 1.1329, -0.0083], [-0.0182, -0.1006, 1.1187]]).T
    assert np.allclose(image(colour.cicp2scrgb(frame(spark, a), transfer=transfer)), wide, atol=1e-9)


def upright(a, share=0.2, least=8):
    rows = ((255 - a[:, :, 0]) >= 128).sum(axis=1) * 255.0
    if not rows.max():
        return 0.0
    lit, out, y = rows >= rows.max() * share, [], 0
    while y < len(rows):
        end = y
        while end < len(rows) and lit[end]:
            end += 1
        if end - y >= least:
            mid = y + (end - y) // 2
            out.append((rows[mid:end].sum() - rows[y:mid].sum()) / rows[y:end].sum())
        y = max(end, y + 1)
    return sum(out) / len(out) if out else 0.0


def page(seed, lines=4):
    """Lines of letters, all with a body in the lower half and few with a rise."""
    rng = np.random.default_rng(seed)
    a = np.full((24 * lines + 10, 90, 1), 250)
    for k in range(lines):
        for x in range(4, 84, 8):
            a[24 * k + 14: 24 * k + 24, x: x + 6] = 5
            if rng.random() < 0.45:
                a[24 * k + 6: 24 * k + 14, x: x + 2] = 5
    return a


def test_upright_and_turned_pages(spark):
    images = [page(1), page(1)[::-1, ::-1], np.full((30, 30, 1), 255), page(2, 2)[:40], np.random.default_rng(4).integers(0, 256, (40, 30, 1))]
    df = frame(spark, *images)
    got = {r.image_id: r.signal for r in analysis.detect_upright(df).collect()}
    assert all(abs(got[k] - upright(a)) < 1e-8 for k, a in enumerate(images)) and got[0] > 0.1 > -0.1 > got[1] and got[2] == 0
    assert {r.image_id: r.v for r in analysis.is_upside_down(df).collect()} == {k: int(upright(a) < -0.02) for k, a in enumerate(images)}
    turned = {r.image_id: r.signal for r in analysis.detect_upright(geometry.rotate90(df, angle=180)).collect()}
    assert turned[0] < 0 < turned[1]


@pytest.mark.parametrize("method", arrays.DIFFUSION)
@pytest.mark.parametrize("levels", [2, 5])
def test_diffusion_pixel_by_pixel(spark, method, levels):
    a = np.random.default_rng(6).integers(0, 256, (13, 11, 2))
    kernel, divisor = arrays.DIFFUSION[method]
    h, w, bands = a.shape
    want = np.zeros_like(a)
    for b in range(bands):
        work = [[np.float32(v) for v in row] for row in a[:, :, b]]
        for y in range(h):
            for x in range(w):
                v = float(work[y][x])
                want[y, x, b] = round(min(255, max(0, v)) * (levels - 1) / 255) * 255 // (levels - 1)
                for dx, dy, k in kernel:
                    if 0 <= x + dx < w and y + dy < h:
                        work[y + dy][x + dx] = np.float32(work[y + dy][x + dx] + np.float32((v - float(want[y, x, b])) * (k / divisor)))
    assert (image(arrays.dither(frame(spark, a), method, levels)) == want).all()
