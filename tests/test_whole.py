"""Whole-image operators against plain Python ports of their rules."""

import math

import numpy as np
import pytest

from pixelweft.operators import local, palette, regions
from tests.test_arrays import frame, image


def smooth_image(seed, h, w, bands=1):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w]
    out = np.stack([127 + 70 * np.sin(x / (3 + b) + b) + 50 * np.cos(y / (4 - b)) for b in range(bands)], axis=2) + rng.normal(0, 6, (h, w, bands))
    return np.clip(out, 0, 255).astype(int)


# ---------------------------------------------------------------- octree

def octree(a, colors):
    """The tree grown pixel by pixel and folded from the deepest depth on, the node registered last first."""
    tree, registered, order = {}, {}, 0
    h, w, bands = a.shape
    leaves = {}
    for y in range(h):
        for x in range(w):
            if bands == 4 and a[y, x, 3] == 0:
                continue
            c = tuple(int(v) for v in a[y, x, :3])
            for depth in range(8):
                node, child = (depth, tuple(v >> (8 - depth) for v in c)), (depth + 1, tuple(v >> (7 - depth) for v in c))
                if child not in tree.setdefault(node, set()):
                    tree[node].add(child)
                    order += 1
                    registered[node] = order
            n, total = leaves.get((8, c), (0, np.zeros(3, int)))
            leaves[8, c] = n + 1, total + np.array(c)
    for depth in range(7, -1, -1):
        for node in sorted((n for n in tree if n[0] == depth), key=lambda n: -registered[n]):
            if len(leaves) <= colors:
                break
            parts = [leaves.pop(c) for c in tree[node]]
            leaves[node] = sum(p[0] for p in parts), sum(p[1] for p in parts)
    out = a.copy()
    for y in range(h):
        for x in range(w):
            if bands == 4 and a[y, x, 3] == 0:
                out[y, x] = 0
                continue
            found = next((d, tuple(int(v) >> (8 - d) for v in a[y, x, :3])) for d in range(9) if (d, tuple(int(v) >> (8 - d) for v in a[y, x, :3])) in leaves)
            n, total = leaves[found]
            out[y, x, :3] = total // n
    return out


@pytest.mark.parametrize("colors", [2, 7, 16, 100])
def test_octree_like_a_tree_grown_pixel_by_pixel(spark, colors):
    images = [smooth_image(1, 17, 23, 3), np.random.default_rng(2).integers(0, 256, (12, 9, 3)), smooth_image(3, 5, 4, 3) // 64 * 64]
    df = frame(spark, *images)
    got = palette.quantize(df, colors=colors)
    for k, a in enumerate(images):
        assert (image(got, k) == octree(a, colors)).all()


def test_octree_beside_alpha(spark):
    a = np.concatenate((smooth_image(4, 14, 15, 3), np.random.default_rng(5).integers(0, 3, (14, 15, 1)) * 120), axis=2)
    assert (image(palette.quantize(frame(spark, a), colors=9, bands=4)) == octree(a, 9)).all()


def test_given_palettes(spark):
    a = np.random.default_rng(6).integers(0, 256, (11, 13, 4))
    for colours in (None, [(10, 10, 10), (200, 0, 0), (0, 0, 200), (10, 10, 10)]):
        p = np.array(palette.web_safe() if colours is None else colours)
        want = a.copy()
        want[:, :, :3] = p[((a[:, :, None, :3] - p) ** 2).sum(axis=3).argmin(axis=2)]
        assert (image(palette.quantize_palette(frame(spark, a), palette=colours, bands=4)) == want).all()


def greys(a, colors):
    hist = np.bincount(a.reshape(-1), minlength=256)
    target, out, s, n = max(1, hist.sum() // colors), [], 0, 0
    for v, c in enumerate(hist.tolist()):
        if c:
            s, n = s + v * c, n + c
            if n >= target and len(out) < colors - 1:
                out.append(s // n)
                s = n = 0
    if n and len(out) < colors:
        out.append(s // n)
    return np.array(out)[np.abs(np.array(out) - a[..., None]).argmin(axis=-1)]


@pytest.mark.parametrize("colors", [2, 5, 200])
def test_greys_of_equal_population(spark, colors):
    images = [smooth_image(7, 20, 21), np.full((4, 4, 1), 9), np.random.default_rng(8).integers(0, 2, (9, 9, 1)) * 255]
    got = palette.quantize_grey(frame(spark, *images), colors)
    for k, a in enumerate(images):
        assert (image(got, k) == greys(a, colors)).all()


# ---------------------------------------------------------------- equalisation and edges

def clahe(a, tiles, clip):
    h, w, bands = a.shape
    luts = {}
    for b in range(bands):
        for i in range(tiles):
            for j in range(tiles):
                part = a[i * h // tiles: (i + 1) * h // tiles, j * w // tiles: (j + 1) * w // tiles, b]
                if not part.size:
                    continue
                hist = np.bincount(part.reshape(-1), minlength=256)
                most = int(max(1, clip * part.size / 256))
                spare = int(np.maximum(hist - most, 0).sum())
                hist = np.minimum(hist, most) + spare // 256
                hist[: spare % 256] += 1
                luts[b, i, j] = np.clip(np.cumsum(hist) * 255 // part.size, 0, 255)
    out = np.zeros_like(a)
    keep = lambda k: min(max(k, 0), tiles - 1)
    for y in range(h):
        fy = y * tiles / h - 0.5
        for x in range(w):
            fx = x * tiles / w - 0.5
            for b in range(bands):
                v = a[y, x, b]
                p = [[float(luts[b, keep(math.floor(fy) + i), keep(math.floor(fx) + j)][v]) if (b, keep(math.floor(fy) + i), keep(math.floor(fx) + j)) in luts else float(v) for j in (0, 1)] for i in (0, 1)]
                tx, ty = fx - math.floor(fx), fy - math.floor(fy)
                out[y, x, b] = int(min(255, max(0, round((p[0][0] * (1 - tx) + p[0][1] * tx) * (1 - ty) + (p[1][0] * (1 - tx) + p[1][1] * tx) * ty, 9))))
    return out


@pytest.mark.parametrize("tiles, clip", [(8, 3.0), (3, 1.0), (4, 40.0)])
def test_equalisation_within_tiles(spark, tiles, clip):
    images = [smooth_image(9, 30, 26, 2), np.full((16, 17, 2), 77), smooth_image(10, 5, 6, 2)]
    got = local.hist_local(frame(spark, *images), tiles=tiles, clip=clip)
    for k, a in enumerate(images):
        assert (image(got, k) == clahe(a, tiles, clip)).all()


def canny(a, sigma, low, high):
    a = a[:, :, 0].astype(float)
    h, w = a.shape
    radius = max(1, math.ceil(3 * sigma))
    k = np.exp(-np.arange(-radius, radius + 1) ** 2 / (2 * sigma * sigma))
    k /= k.sum()
    for axis in (1, 0):
        p = np.pad(a, [(radius, radius) if i == axis else (0, 0) for i in range(2)], mode="edge")
        a = sum(c * p.take(range(i, i + a.shape[axis]), axis=axis) for i, c in enumerate(k))
    p = np.pad(a, 1, mode="edge")
    at = lambda y, x: p[1 + y: 1 + y + h, 1 + x: 1 + x + w]
    gx = at(-1, 1) - at(-1, -1) + 2 * (at(0, 1) - at(0, -1)) + at(1, 1) - at(1, -1)
    gy = at(1, -1) - at(-1, -1) + 2 * (at(1, 0) - at(-1, 0)) + at(1, 1) - at(-1, 1)
    gx, gy = gx.round(9), gy.round(9)
    m = np.hypot(gx, gy).round(9)
    thin = np.zeros_like(m)
    for y in range(1, h - 1):
        for x in range(1, w - 1):
            angle = math.degrees(math.atan2(gy[y, x], gx[y, x]))
            angle += 180 * (angle < 0)
            (i, j) = (0, 1) if angle < 22.5 or angle >= 157.5 else (-1, 1) if angle < 67.5 else (1, 0) if angle < 112.5 else (1, 1)
            if m[y, x] >= m[y + i, x + j] and m[y, x] >= m[y - i, x - j]:
                thin[y, x] = m[y, x]
    out, todo = thin >= high, list(zip(*np.nonzero(thin >= high)))
    while todo:
        y, x = todo.pop()
        for i in range(max(0, y - 1), min(h, y + 2)):
            for j in range(max(0, x - 1), min(w, x + 2)):
                if thin[i, j] >= low and not out[i, j]:
                    out[i, j] = True
                    todo.append((i, j))
    return np.where(out, 255, 0)[:, :, None]


@pytest.mark.parametrize("tile", [256, 5])
def test_canny_like_its_rule(spark, tile):
    images = [smooth_image(11, 24, 19), np.random.default_rng(12).integers(0, 256, (20, 22, 1)), np.where(np.arange(20)[None, :, None] < 10, 0, 200) * np.ones((12, 1, 1), int), np.full((3, 2, 1), 5)]
    got = local.canny(frame(spark, *images), low=25, high=70, tile=tile)
    for k, a in enumerate(images):
        assert (image(got, k) == canny(a, 1.4, 25, 70)).all()


# ---------------------------------------------------------------- regions and distances

def flood_fill(on, diagonal):
    h, w = on.shape
    out, n = np.zeros(on.shape, int), 0
    for y in range(h):
        for x in range(w):
            if on[y, x] and not out[y, x]:
                n, todo = n + 1, [(y, x)]
                while todo:
                    i, j = todo.pop()
                    if 0 <= i < h and 0 <= j < w and on[i, j] and not out[i, j]:
                        out[i, j] = n
                        todo += [(i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if diagonal or not a * b]
    return out


def spiral(n):
    """One region that winds through all tiles."""
    out = np.zeros((n, n), int)
    out[::2] = 1
    for k, y in enumerate(range(1, n, 2)):
        out[y, -1 if k % 2 == 0 else 0] = 1
    return out


@pytest.mark.parametrize("tile", [4, 7, 256])
def test_regions_across_tiles(spark, tile):
    rng = np.random.default_rng(13)
    images = [(rng.random((23, 19)) < p).astype(int) for p in (0.3, 0.55, 0.65)] + [spiral(25), np.zeros((3, 3), int), np.ones((9, 9), int)]
    df = frame(spark, *(a[:, :, None] * 200 for a in images))
    got = regions.label_regions(df, tile=tile)
    for k, a in enumerate(images):
        assert (image(got, k)[:, :, 0] == flood_fill(a, False)).all()
    both = {(r.image_id, r.x, r.y): r.root for r in regions.regions(df.where("v > 0").select("image_id", "x", "y"), diagonal=True, tile=tile).collect()}
    for k, a in enumerate(images):
        want = flood_fill(a, True)
        first = {n: min((int(y) << 32) + int(x) for y, x in zip(*np.nonzero(want == n))) for n in range(1, want.max() + 1)}
        assert {p[1:]: v for p, v in both.items() if p[0] == k} == {(int(x), int(y)): first[want[y, x]] for y, x in zip(*np.nonzero(want))}


@pytest.mark.parametrize("tile", [4, 256])
def test_flood_of_several_bands(spark, tile):
    rng = np.random.default_rng(14)
    a = np.stack([rng.integers(0, 2, (15, 18)), np.zeros((15, 18), int)], axis=2)
    small, inked = np.ones((2, 2, 2), int), np.full((15, 18, 2), (7, 8))
    got = regions.draw_flood(frame(spark, a, small, inked), 6, 5, (7, 8), tile=tile)
    same = flood_fill((a == a[5, 6]).all(axis=2), False)
    assert (image(got) == np.where((same == same[5, 6])[:, :, None], (7, 8), a)).all()
    assert (image(got, 1) == small).all() and (image(got, 2) == inked).all()


def test_distances_in_strips(spark):
    rng = np.random.default_rng(15)
    sparse = (rng.random((40, 33)) < 0.01).astype(int)
    tall = np.zeros((900, 3), int)
    tall[[3, 500], [0, 2]] = 1
    images = [sparse, tall, np.zeros((4, 5), int), np.ones((3, 3), int)]
    got = regions.nearest(frame(spark, *(a[:, :, None] for a in images)), rows=7)
    for k, a in enumerate(images):
        points = np.argwhere(a)
        y, x = np.indices(a.shape)
        far = np.min([np.hypot(y - i, x - j) for i, j in points], axis=0) if len(points) else np.full(a.shape, 1e9)
        assert (image(got, k)[:, :, 0] == np.floor(np.minimum(far, 255))).all()


def test_tables_of_tiles_do_not_ride_along(spark):
    """No table is carried from one look-up to the next."""
    plan = local.hist_local(frame(spark, np.arange(300).reshape(20, 15, 1) % 256))._jdf.queryExecution().optimizedPlan()
    carried = []

    def walk(node):
        if node.nodeName() == "Join":
            left = node.left().output()
            carried.extend(left.apply(k).dataType().typeName() for k in range(left.size()))
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(plan)
    assert carried and "array" not in carried


def test_bands_of_a_place_meet_in_its_tile(spark):
    rows = spark.createDataFrame([(0, 0, 0, True), (0, 0, 0, True), (0, 1, 0, True), (0, 1, 0, False), (0, 2, 0, None), (0, 2, 0, True), (0, 3, 0, None), (0, 9, 0, False)], "image_id int, x int, y int, same boolean")
    assert sorted((r.x, r.part) for r in regions._in_tiles(rows, False, 8).collect()) == [(0, 0), (2, 2)]
