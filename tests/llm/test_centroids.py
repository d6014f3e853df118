"""Centroid clustering against plain Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from pixelweft.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster string, units int, distance string"


def brute(rows, k, rounds=5, dims=64):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    cents = [list(v) for _, v in seeds]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents)) for _, v in kept]

    for _ in range(rounds):
        own = assign()
        for j in range(len(cents)):
            mine = [v for (_, v), (_, c) in zip(kept, own) if c == j]
            if mine:
                cents[j] = [sum(col) // len(mine) for col in zip(*mine)]
    own = assign()
    inertia = {}
    for far, c in own:
        inertia[c] = inertia.get(c, 0) + far
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted((str(i), c, far, inertia[c], sum(inertia.values()), digest[c]) for (i, _), (far, c) in zip(kept, own))


def corpus(n, seed=5, dims=64):
    rng = random.Random(seed)
    middles = [[rng.uniform(-0.5, 0.5) for _ in range(dims)] for _ in range(7)]
    # Halves are exact in 32 bits, so brute force reads the same numbers.
    return [(i, [round((m + rng.gauss(0, 0.05)) * 512) / 512 for m in middles[i % 3 if i % 2 else i % 7]]) for i in range(n)]


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, v, "x", 7, "y") for i, v in rows], SCHEMA).repartition(3)
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in centroids.cluster(df, **how).collect())


def test_like_brute_force_with_bad_rows_ties_and_repeats(spark):
    rows = corpus(150)
    rows += [(900, None), (901, []), (902, [0.5] * 63), (903, [0.5] * 65), (904, [0.5] * 63 + [None]), (905, [0.5] * 63 + [float("nan")]), (906, [float("inf")] + [0.5] * 63)]
    rows += [rows[3], (3, rows[4][1]), (None, rows[5][1]), (907, [0.0] * 64), (908, [0.0] * 64)]
    assert run(spark, rows, k=12) == brute(rows, 12)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_fewer_vectors_than_centroids(spark, n):
    assert run(spark, corpus(n)) == brute(corpus(n), 40)


def test_all_equal_vectors_share_the_first_centroid(spark):
    got = run(spark, [(i, [0.25] * 64) for i in range(60)])
    assert len(got) == 60 and {r[1] for r in got} == {0} and {r[4] for r in got} == {0}


def test_largest_components_stay_exact(spark):
    rows = [(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)]
    got = run(spark, rows, k=1, rounds=0)
    assert max(r[2] for r in got) <= 64 * (2 * centroids.LARGEST) ** 2 < 2**63


def test_partial_distances_abandon_nothing_nearer():
    rng = np.random.default_rng(1)
    for spread in (1, 3, 200):
        x, c = rng.integers(-spread, spread + 1, (500, 64)), rng.integers(-spread, spread + 1, (40, 64))
        c[7] = c[3]  # a tie with every vector
        own, far = centroids.nearest(x, c, np.argsort(-x.var(axis=0)))
        whole = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert (own == whole.argmin(axis=1)).all() and (far == whole.min(axis=1)).all()
