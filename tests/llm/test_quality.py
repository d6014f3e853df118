import numpy as np
from pyspark.sql import functions as F

from pixelweft.llm import quality as Q


def test_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    truth = {r.doc_id: r.quality for r in labels.where(held).collect()}
    rows = {r.doc_id: r for r in Q.classify(docs, labels.where(~held)).collect()}
    assert len(rows) == docs.count()
    y, q = np.array(list(truth.values())), np.array([rows[d].quality for d in truth])
    assert np.mean((q >= 0.5) == (y == 1)) > 0.97
    assert np.mean(q[y == 1] >= 0.5) > 0.985


def test_posteriors_equal_a_plain_computation(spark):
    rng = np.random.default_rng(1)
    rows = [(i, ["a", "b", "c", None][k := int(rng.integers(0, 4))], ["x", "y", None][int(rng.integers(0, 3))], float(np.clip(rng.normal(0.3 + 0.15 * k, 0.1), 0.01, 0.99)))
            for i in range(300)] + [(999, "lonely", "z", 0.01)]
    got = {r.doc_id: r for r in Q.posteriors(spark.createDataFrame(rows, "doc_id long, host string, path string, p double")).collect()}
    mu = (sum(r[3] for r in rows) + 1) / (len(rows) + 2)

    def sums(key):
        out = {}
        for r in rows:
            n, s = out.get(key(r), (0, 0.0))
            out[key(r)] = n + 1, s + r[3]
        return out

    def strength(groups, prior):
        n = sum(g[0] for g in groups.values())
        beyond = (sum(g[0] * (g[1] / g[0] - prior(k)) ** 2 for k, g in groups.items()) - sum(prior(k) * (1 - prior(k)) for k in groups)) / n
        spread = sum(g[0] * prior(k) * (1 - prior(k)) for k, g in groups.items()) / n
        return max(1.0, min(1e6, spread / beyond - 1 if beyond > 1e-12 else 1e6))

    hosts, paths = sums(lambda r: r[1]), sums(lambda r: (r[1], r[2]))
    kh = strength(hosts, lambda k: mu)
    kp = strength(paths, lambda k: (hosts[k[0]][1] + mu) / (hosts[k[0]][0] + 1))
    for d, h, p, v in rows:
        host = (hosts[h][1] - v + kh * mu) / (hosts[h][0] - 1 + kh)
        path = (paths[h, p][1] - v + kp * host) / (paths[h, p][0] - 1 + kp)
        assert abs(got[d].host_mean - host) < 1e-9 and abs(got[d].path_mean - path) < 1e-9
    assert abs(got[999].path_mean - mu) < 1e-9  # a site of one page has nothing but the prior


def test_nulls_and_empty(spark):
    docs = spark.createDataFrame([(1, "a good text", "s", "en", 1), (1, "a good text", "s", "en", 1), (2, None, None, None, 1), (None, "", "s", "en", 1)],
                                 "doc_id long, text string, source string, lang string, p int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (7, None)], "doc_id long, quality int")
    rows = Q.classify(docs, labels).collect()
    assert len(rows) == 4 and all(0 <= r.quality <= 1 for r in rows)
    assert len(Q.classify(docs, labels.limit(0)).collect()) == 4
    assert Q.classify(docs.limit(0), labels).count() == 0
