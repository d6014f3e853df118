import math

import numpy as np

from pixelweft.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int, node long, weight int"


def corpus(seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(150):
        x = rng.normal(size=64)
        x /= np.linalg.norm(x)
        for _ in range(4):
            cos = rng.choice([0.86, 0.895, 0.905, 0.93, 0.97, 1.0])
            z = rng.normal(size=64)
            z -= (z @ x) * x
            rows.append((cos * x + math.sqrt(1 - cos * cos) * z / np.linalg.norm(z)) * rng.uniform(0.5, 3))
    rows = [r.astype(np.float32).tolist() for r in rows]
    rows += [rows[5]] * 30 + [rows[9]] * 3
    rows += [None, [0.0] * 64, [float("nan")] * 64, [None] + rows[0][1:], [], rows[0][:10], rows[0][:10]]
    return rows


def brute(rows):
    ok = [i for i, r in enumerate(rows) if r and all(v is not None and math.isfinite(v) for v in r) and any(r)]
    pairs = set()
    for i in ok:
        for j in ok:
            if i < j and len(rows[i]) == len(rows[j]):
                x, y = np.array(rows[i], float), np.array(rows[j], float)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.9:
                    pairs.add((i, j))
    return pairs


def test_links_and_components(spark):
    rows = corpus()
    pairs = brute(rows)
    df = spark.createDataFrame([(i, r, None, 1, 2) for i, r in enumerate(rows)], SCHEMA).repartition(3)
    got = {r.vec_id: r for r in E.near_duplicates(df).collect()}
    degree = [0] * len(rows)
    for a, b in pairs:
        degree[a] += 1
        degree[b] += 1
    assert all(got[i].n_links <= degree[i] for i in got)
    assert sum(got[i].n_links for i in got) >= 0.98 * sum(degree)
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in sorted(pairs):
        p, q = sorted((top(a), top(b)))
        parent[q] = p
    assert np.mean([got[i].component_id == top(i) for i in got]) > 0.98
    assert all(got[i].kept == (got[i].component_id == i) for i in got)


def test_large_cells_are_shared(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=64)
    rows = [(i, (x + rng.normal(size=64) * 0.02).tolist(), 0, 0, 0) for i in range(60)]
    monkeypatch.setattr(E, "CELL_ROWS", 7)
    got = E.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(59, 0)}


def test_nulls_and_empty(spark):
    v = [1.0, 2.0, 3.0]
    df = spark.createDataFrame([(None, v, 0, 0, 0), (3, v, 0, 0, 0), (3, v, 0, 0, 0), (2, None, 0, 0, 0)], SCHEMA)
    got = sorted(((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df).collect()))
    assert got == [(-1, 0, None, False), (2, 0, 2, True), (3, 1, 3, True), (3, 1, 3, True)]
    assert E.near_duplicates(df.limit(0)).count() == 0
