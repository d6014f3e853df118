"""Stroke outlines against a plain port of the rules, cover line by line, brushes against formulas."""

import math

import numpy as np
import pytest

from pixelweft.operators import brushes, paths, strokes
from tests.test_arrays import frame, image


def unit(a, b):
    n = math.dist(a, b)
    return (0.0, 0.0) if n < 1e-9 else ((b[0] - a[0]) / n, (b[1] - a[1]) / n)


def rings(points, closed, pen):
    """Rings of a polyline, vertex by vertex."""
    half, n = pen.width / 2, len(points)
    ways = [unit(points[i], points[(i + 1) % n]) for i in range(n if closed else n - 1)]
    sides = {1: [], -1: []}

    def at(p, v, k=1.0):
        return p[0] + v[0] * half * k, p[1] + v[1] * half * k

    def end(p, f, start):
        normal, back = (f[1], -f[0]), -1 if start else 1
        for side in (1, -1):
            base = (side * normal[0], side * normal[1])
            if pen.cap == "square":
                sides[side].append(at(p, (base[0] + back * f[0], base[1] + back * f[1])))
            elif pen.cap == "round" and side == (-1 if start else 1):
                arc = [at(p, (base[0] * math.cos(math.pi * k / 16) + back * f[0] * math.sin(math.pi * k / 16), base[1] * math.cos(math.pi * k / 16) + back * f[1] * math.sin(math.pi * k / 16))) for k in range(16)]
                sides[side] += arc[::-1] if start else arc
            else:
                sides[side].append(at(p, base))

    def join(p, f, g):
        turn, cosine = f[0] * g[1] - f[1] * g[0], f[0] * g[0] + f[1] * g[1]
        n0, n1 = (f[1], -f[0]), (g[1], -g[0])
        outer = 1 if turn > 0 else -1
        for side in (1, -1):
            if side == outer and pen.join == "miter" and 1 + cosine >= 1e-9 and math.sqrt(2 * (1 + cosine)) / (1 + cosine) <= pen.miter_limit:
                sides[side].append(at(p, (side * (n0[0] + n1[0]) / (1 + cosine), side * (n0[1] + n1[1]) / (1 + cosine))))
            elif side == outer and pen.join == "round":
                angle = math.acos(max(-1, min(1, cosine)))
                steps = max(1, math.ceil(round(angle * 8 / math.pi, 9)))
                for k in range(steps + 1):
                    a = angle * k / steps * (1 if turn > 0 else -1)
                    sides[side].append(at(p, (side * (n0[0] * math.cos(a) - n0[1] * math.sin(a)), side * (n0[0] * math.sin(a) + n0[1] * math.cos(a)))))
            else:
                sides[side] += [at(p, (side * n0[0], side * n0[1])), at(p, (side * n1[0], side * n1[1]))]

    for i, p in enumerate(points):
        if not closed and i in (0, n - 1):
            end(p, ways[0] if i == 0 else ways[-1], i == 0)
        else:
            join(p, ways[i - 1], ways[i])
    return [sides[1], sides[-1][::-1]] if closed else [sides[1] + sides[-1][::-1]]


def dash(points, closed, dashes, offset):
    """Polylines that are left of a polyline walked by small steps of the pattern."""
    walk = [*points, points[0]] if closed else list(points)
    pattern = list(dashes) * (1 + len(dashes) % 2)
    edges, at = [], -(offset % sum(dashes))
    ends = np.concatenate(([0], np.cumsum([math.dist(a, b) for a, b in zip(walk, walk[1:])])))

    def place(s):
        k = min(max(int(np.searchsorted(ends, s, "right")) - 1, 0), len(walk) - 2)
        t = (s - ends[k]) / (ends[k + 1] - ends[k])
        return walk[k][0] + (walk[k + 1][0] - walk[k][0]) * t, walk[k][1] + (walk[k + 1][1] - walk[k][1]) * t

    k = 0
    while at < ends[-1]:
        a, b = max(0.0, at), min(float(ends[-1]), at + pattern[k % len(pattern)])
        if k % 2 == 0 and b - a > 1e-9:
            edges.append([place(a), *[walk[i] for i in range(len(walk)) if a + 1e-9 < ends[i] < b - 1e-9], place(b)])
        at, k = at + pattern[k % len(pattern)], k + 1
    return edges


LINES = [
    ([(0, 0), (10, 0), (10, 8), (3, 9), (3.5, 2), (20, 2)], False), ([(1, 1), (9, 2), (8, 8), (2, 7)], True), ([(0, 0), (5, 5)], False), ([(0, 0), (6, 0), (0, 0.1)], False), ([(0, 0), (6, 0), (2, 0)], False),
    ([(0, 0), (4, 0), (8, 0)], False),
]
PENS = [strokes.Pen(2.0, cap, join, 2.5) for cap in ("butt", "square", "round") for join in ("bevel", "miter", "round")]


def table(spark):
    rows = [(k, 0, i, float(x), float(y), int(closed)) for k, (points, closed) in enumerate(LINES) for i, (x, y) in enumerate(points)]
    return spark.createDataFrame(rows, "path_id int, part int, seq int, x double, y double, closed int").repartition(3)


@pytest.mark.parametrize("pen", PENS, ids=lambda p: f"{p.cap}-{p.join}")
def test_outlines_of_many_paths(spark, pen):
    got = {}
    for r in sorted(strokes.stroke_outlines(table(spark), pen=pen).collect(), key=lambda r: (r.path_id, r.ring, r.seq)):
        got.setdefault(r.path_id, {}).setdefault(r.ring, []).append((r.x, r.y))
    for k, (points, closed) in enumerate(LINES):
        want = rings(points, closed, pen)
        assert len(got[k]) == len(want)
        for i, ring in enumerate(want):
            assert np.allclose(got[k][i], ring, atol=1e-9)


@pytest.mark.parametrize("dashes, offset", [((3.0, 1.0), 0.0), ((2.0,), 0.5), ((4.0, 1.5, 0.5), -2.0), ((100.0, 1.0), 3.0), ((2.0, 0.0, 1.0, 1.0), 1.0)])
def test_dashes_by_arc_length(spark, dashes, offset):
    pen = strokes.Pen(1.0, dashes=dashes, dash_offset=offset)
    got = {}
    for r in sorted(strokes.stroke_outlines(table(spark), pen=pen).collect(), key=lambda r: (r.path_id, r.part, r.ring, r.seq)):
        got.setdefault(r.path_id, {}).setdefault(r.part, []).append((r.x, r.y))
    for k, (points, closed) in enumerate(LINES):
        want = [rings(piece, False, pen)[0] for piece in dash(points, closed, dashes, offset)]
        assert len(got[k]) == len(want)
        for (_, ring), w in zip(sorted(got[k].items()), want):
            assert np.allclose(ring, w, atol=1e-7)


def test_areas_of_rings(spark):
    rows = [(1, 0, 0, i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)])] + [(1, 0, 1, i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (0.0, 2.0), (2.0, 0.0)])]
    got = {(r.path_id, r.ring): r.area for r in strokes.ring_areas(spark.createDataFrame(rows, "path_id int, part int, ring int, seq int, x double, y double")).collect()}
    assert got == {(1, 0): 12.0, (1, 1): -2.0}


def cover(edges, w, h):
    """Share of each pixel inside by the even-odd rule, along four lines a row."""
    out = np.zeros((h, w))
    for y in range(h):
        for k in range(4):
            scan = y + (k + 0.5) / 4
            xs = sorted(round(x0 + (scan - y0) / (y1 - y0) * (x1 - x0), 9) for x0, y0, x1, y1 in edges if (y0 <= scan < y1) or (y1 <= scan < y0))
            for a, b in zip(xs[::2], xs[1::2]):
                for x in range(w):
                    out[y, x] += max(0.0, min(x + 1, b) - max(x, a))
    return out.round(9) / 4


def stroke_edges(path, pen):
    out = []
    for points, closed in strokes.polylines(path):
        pieces = [(p, False) for p in dash(points, closed, pen.dashes, pen.dash_offset)] if pen.dashes else [(points, closed)]
        for piece, loop in pieces:
            for ring in rings(piece, loop, pen):
                out += [(*a, *b) for a, b in zip(ring, ring[1:] + ring[:1])]
    return out


def mixed(a, share, colour):
    new = np.rint((a * (1 - share)[:, :, None] + np.asarray(colour, float) * share[:, :, None]).round(9))
    return np.where((share >= 0.999)[:, :, None], colour, np.where((share <= 0)[:, :, None], a, new))


@pytest.mark.parametrize("op, path, pen", [
    (strokes.stroke_path, strokes.ZIGZAG, strokes.Pen(cap="round", join="round")),
    (strokes.stroke_rectangle, paths.rectangle(3.5, 6.0, 12.0, 40.0), strokes.Pen(2.5, join="miter")),
    (strokes.stroke_circle, paths.circle(10.0, 40.0, 7.0), strokes.Pen(2.0)),
    (strokes.stroke_polygon, paths.polygon((3, 2), (18, 9), (11, 60), (4, 18)), strokes.Pen(2.0, "square", "bevel", dashes=(6.0, 3.0, 1.0), dash_offset=2.5)),
])
def test_strokes_cover_what_their_outlines_do(spark, op, path, pen):
    a = np.random.default_rng(1).integers(0, 256, (72, 22, 3))
    share = cover(stroke_edges(path, pen), 22, 72)
    assert share.sum() > 40 and (image(op(frame(spark, a), pen=pen, ink=(9, 100, 201))) == mixed(a, share, (9, 100, 201))).all()


def test_all_four_edges_of_a_rectangle(spark):
    got = image(strokes.stroke_rectangle(frame(spark, np.zeros((20, 20, 1), int)), x=4.0, y=5.0, w=10.0, h=8.0, pen=strokes.Pen(2.0, join="miter"), ink=(255,)))[:, :, 0]
    want = np.zeros((20, 20))
    want[4:14, 3:15] = 255
    want[6:12, 5:13] = 0
    off = got != want  # on the inside a join is a bevel, whose crossing takes half a pixel out of each corner
    assert off.sum() == 4 and (got[off] == 128).all() and set(zip(*np.nonzero(off))) <= {(y, x) for y in (5, 12) for x in (4, 13)}


SHAPE = paths.polygon((2, 2), (14, 4), (9, 15))


def gradient(kind, x, y):
    if kind == "linear":
        t = min(1, max(0, ((x - 2) * 10 + (y - 3) * 6) / 136))
        return [round(round(s + (e - s) * t, 9)) for s, e in ((255, 0), (0, 200))]
    if kind == "radial":
        t = min(1, math.hypot(x - 8, y - 7) / 6)
        return [round(round(s + (e - s) * t, 9)) for s, e in ((255, 10), (5, 240))]
    corner, colour, centre = [(2, 2), (14, 4), (9, 15)], [(255, 0), (0, 255), (60, 90)], (105, 115)
    ax, ay = 25 / 3, 7
    for i in range(3):
        (bx, by), (cx, cy) = corner[i], corner[(i + 1) % 3]
        u, v = np.linalg.solve([[ax - cx, bx - cx], [ay - cy, by - cy]], [x - cx, y - cy])
        if u >= -1e-9 and v >= -1e-9 and 1 - u - v >= -1e-9:
            return [round(round(u * centre[b] + v * colour[i][b] + (1 - u - v) * colour[(i + 1) % 3][b], 9)) for b in (0, 1)]
    return centre


@pytest.mark.parametrize("kind", ["linear", "radial", "path"])
def test_gradient_brushes(spark, kind):
    brush = {"linear": brushes.linear_gradient(2, 3, 12, 9, (255, 0), (0, 200)), "radial": brushes.radial_gradient(8, 7, 6, (255, 5), (10, 240)),
             "path": brushes.path_gradient([(2, 2), (14, 4), (9, 15)], [(255, 0), (0, 255), (60, 90)])}[kind]
    a = np.random.default_rng(2).integers(0, 256, (17, 16, 2))
    colour = np.array([[gradient(kind, x, y) for x in range(16)] for y in range(17)])
    df = frame(spark, a)
    assert (image(brushes.fill(df, brush=brush)) == colour).all()
    assert (image(brushes.fill(df, brush=brush, path=SHAPE)) == mixed(a, cover(paths.edges(SHAPE), 16, 17), colour)).all()


@pytest.mark.parametrize("tiling", ["clamp", "repeat", "mirror"])
def test_image_brushes(spark, tiling):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 256, (17, 16, 2)), rng.integers(0, 256, (4, 5, 2))
    mode = {"clamp": "edge", "repeat": "wrap", "mirror": "symmetric"}[tiling]
    place = lambda n, size, off: np.pad(np.arange(size), 60, mode=mode)[60 - off: 60 - off + n]
    colour = b[place(17, 4, -3)][:, place(16, 5, 6)]
    got = image(brushes.fill_image(frame(spark, a), frame(spark, b), path=SHAPE, offset=(6, -3), tiling=tiling))
    assert (got == mixed(a, cover(paths.edges(SHAPE), 16, 17), colour)).all()


def test_pens_and_brushes_refuse_what_has_no_meaning():
    for how in ({"width": 0}, {"miter_limit": 0.5}, {"cap": "x"}, {"dashes": (0.0,)}, {"dashes": (1.0, -1.0)}):
        with pytest.raises(ValueError):
            strokes.Pen(**how)
    for make in (lambda: brushes.radial_gradient(0, 0, 0, (1,), (2,)), lambda: brushes.path_gradient([(0, 0), (1, 1)], [(1,), (2,)]), lambda: brushes.wrapped("x", "w", "tile")):
        with pytest.raises(ValueError):
            make()
