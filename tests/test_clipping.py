"""Booleans of polygons against cover line by line, triangles against areas and a plain ear clipping."""

import math
import random

import numpy as np
import pytest

from pixelweft.operators import clipping, strokes

POINTS = "path_id long, seq int, x double, y double"


def table(spark, *rings):
    rows = [(k, i, float(x), float(y)) for k, ring in enumerate(rings) for i, (x, y) in enumerate(ring or ())]
    return spark.createDataFrame(rows, POINTS).repartition(3)


def rings_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.path_id, r.part, r.ring, r.seq)):
        out.setdefault(r.path_id, {}).setdefault((r.part, r.ring), []).append((r.x, r.y))
        assert r.seq == len(out[r.path_id][r.part, r.ring]) - 1
    return out


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def star(seed, cx, cy, n=40, turned=False):
    r = random.Random(seed)
    ring = [(cx + (q := r.uniform(3, 30)) * math.cos(2 * math.pi * k / n + 0.01), cy + q * math.sin(2 * math.pi * k / n + 0.01)) for k in range(n)]
    return ring[::-1] if turned else ring


def test_overlapping_boxes_have_the_corners_of_their_booleans(spark):
    a, b = table(spark, box(0, 0, 10, 10)), table(spark, box(5, 5, 10, 10))
    corners = lambda op: [set(r) for r in rings_of(clipping.boolean(a, b, op))[0].values()]
    assert corners("intersect") == [{(5, 5), (10, 5), (10, 10), (5, 10)}]
    assert corners("union") == [{(0, 0), (10, 0), (10, 5), (15, 5), (15, 15), (5, 15), (5, 10), (0, 10)}]
    assert corners("subtract") == [{(0, 0), (10, 0), (10, 5), (5, 5), (5, 10), (0, 10)}]
    assert len(corners("xor")) == 2


def test_apart_within_and_alone(spark):
    a, b = table(spark, box(0, 0, 5, 5), box(0, 0, 30, 30), box(4, 4, 2, 2), box(1, 1, 3, 3)), table(spark, box(20, 20, 5, 5), box(4, 4, 2, 2), box(0, 0, 30, 30), None)
    many = {op: {k: sorted(len(r) for r in v.values()) for k, v in rings_of(clipping.boolean(a, b, op)).items()} for op in ("union", "intersect", "subtract")}
    assert many == {"union": {0: [4, 4], 1: [4], 2: [4], 3: [4]}, "intersect": {1: [4], 2: [4]}, "subtract": {0: [4], 1: [4, 4], 3: [4]}}
    areas = {r.ring: r.area for r in strokes.ring_areas(clipping.boolean(a, b, "subtract").where("path_id = 1")).collect()}
    assert sorted(areas.values()) == [-4.0, 900.0]  # a hole turns the other way


def length_inside(ring, scan):
    """The stretches of a line of one height that a ring holds."""
    xs = sorted(x0 + (scan - y0) / (y1 - y0) * (x1 - x0) for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]) if (y0 <= scan) != (y1 <= scan))
    return list(zip(xs[::2], xs[1::2]))


def area_by_lines(rings, step=0.02):
    return {op: step * sum(total(op, [length_inside(r, y) for r in rings]) for y in np.arange(-40, 80, step)) for op in ("union", "intersect", "subtract")}


def total(op, two):
    edges = sorted({e for s in two for pair in s for e in pair})
    out = 0.0
    for lo, hi in zip(edges, edges[1:]):
        a, b = (any(s <= lo and hi <= e for s, e in spans) for spans in two)
        out += (hi - lo) * {"union": a or b, "intersect": a and b, "subtract": a and not b}[op]
    return out


def test_stars_by_lines(spark):
    pairs = [(star(1, 10, 10), star(2, 18, 6)), (star(3, 10, 10, 25, True), star(4, 2, 20, 33)), (star(5, 0, 0, 60), star(6, 1, 1, 60, True))]
    a, b = table(spark, *(p[0] for p in pairs)), table(spark, *(p[1] for p in pairs))
    want = [area_by_lines(p) for p in pairs]
    for op in ("union", "intersect", "subtract"):
        got = {r.path_id: r.area for r in clipping.boolean_areas(a, b, op=op).collect()}
        rings = {}
        for r in strokes.ring_areas(clipping.boolean(a, b, op)).collect():
            rings[r.path_id] = rings.get(r.path_id, 0) + r.area
        for k in range(3):
            assert abs(got[k] - want[k][op]) < 2e-3 * want[k]["union"] and abs(rings[k] - got[k]) < 1e-6
    both = {(r.path_id, r.part): r.area for r in strokes.ring_areas(clipping.boolean(a, b, "xor")).groupBy("path_id", "part").agg({"area": "sum"}).withColumnRenamed("sum(area)", "area").collect()}
    for k in range(3):
        assert abs(both[k, 0] + both[k, 1] - (want[k]["union"] - want[k]["intersect"])) < 4e-3 * want[k]["union"]


def plain_ears(ring):
    cross = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    if sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) < 0:
        ring = ring[::-1]
    left, out = list(ring), []
    while len(left) > 3:
        for i in range(len(left)):
            a, b, c = left[i - 1], left[i], left[(i + 1) % len(left)]
            others = [p for p in left if p not in (a, b, c)]
            if cross(a, b, c) > 0 and not any(min(s) >= 0 or max(s) <= 0 for s in ((cross(p, a, b), cross(p, b, c), cross(p, c, a)) for p in others)):
                out.append((a, b, c))
                del left[i]
                break
        else:
            return out
    return out + [tuple(left)]


def test_triangles(spark):
    rings = [star(7, 5, 5), star(8, 0, 0, 17, True), box(0, 0, 3, 4), [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)], [(0, 0), (1, 0), (0, 1), (0, 0)], [(0, 0), (5, 5)]]
    got = {}
    for r in sorted(clipping.tessellate(table(spark, *rings)).collect()):
        got.setdefault(r.path_id, []).append(((r.x0, r.y0), (r.x1, r.y1), (r.x2, r.y2)))
    assert set(got) == {0, 1, 2, 3, 4}
    for k in range(4):
        assert got[k] == [tuple((float(x), float(y)) for x, y in t) for t in plain_ears(rings[k])] and len(got[k]) == len(rings[k]) - 2
    assert len(got[4]) == 1


def test_places_in_triangles(spark):
    rings = [star(9, 5, 5), box(2, 2, 9, 30)]
    r = random.Random(3)
    places = [(r.uniform(-20, 40), r.uniform(-20, 40), k) for k in range(300)]
    got = clipping.located(spark.createDataFrame(places, "x double, y double, `a.b` int"), clipping.tessellate(table(spark, *rings)), strip=5.0).collect()
    want = {(n, k) for x, y, n in places for k, ring in enumerate(rings) if any(a <= x <= b for a, b in length_inside(ring, y))}
    assert {(g["a.b"], g.path_id) for g in got} == want and len(got) == len(want)


def test_many_polygons_lose_their_ears_at_once():
    rings = [star(k, 0, 0, 12 + k % 3, k % 2 == 0) for k in range(9)] + [[(0, 0), (5, 5)], [], [(0, 0), (4, 4), (4, 0), (0, 4)]]
    got = clipping.ears([np.array(r, float).reshape(-1, 2) for r in rings])
    for ring, triangles in zip(rings[:9], got):
        assert [tuple(map(tuple, t)) for t in triangles.tolist()] == [tuple(map(tuple, t)) for t in plain_ears(ring)]
    assert [len(t) for t in got[9:11]] == [0, 0]


@pytest.mark.parametrize("op", ["union", "subtract"])
def test_only_runs_of_nodes_are_walked(spark, monkeypatch, op):
    circle = lambda x, n: [(x + 10 * math.cos(2 * math.pi * k / n + 0.013), 10 * math.sin(2 * math.pi * k / n + 0.013)) for k in range(n)]
    sizes = []
    plain = clipping.checkpointed

    def counted(df):
        out = plain(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(clipping, "checkpointed", counted)
    rings = rings_of(clipping.boolean(table(spark, circle(0, 200)), table(spark, circle(5, 170)), op))[0]
    assert len(rings) == 1 and len(next(iter(rings.values()))) > 150
    assert sizes[0] > 150 and max(sizes[1:]) < 10
