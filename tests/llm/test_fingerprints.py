import hashlib

from pixelweft.llm import fingerprints as P

SCHEMA = "doc_id long, text string, next_text string, fp long"


def texts():
    words = ["alpha", "beta", "gamma", "delta", "Ünder", "zeta", "eta", "theta"]
    out = [" ".join(words[(i * k) % 8] + str(i * k % 13) for k in range(1, 6 + 7 * i)) for i in range(12)]
    return out + [None, "", "\U0001f600 ok é" * 5, out[3]]


def test_edited_text_and_order(spark):
    rows = [(7 * i + (5000 if i % 3 else 0), t, "x", 1) for i, t in enumerate(texts())]
    got = {r.doc_id: r for r in P.edited_fingerprints(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    order = sorted(rows)
    for k, (doc, text, *_) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        assert got[doc].n_chars == len(text)
        assert got[doc].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[doc].near_edited <= 1 and 0 <= got[doc].near_next <= 1
    by_text = {}
    for doc, text, *_ in rows:
        by_text.setdefault(text or "", set()).add(got[doc].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


def test_near_edited_is_above_near_next(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = P.edited_fingerprints(docs).collect()
    assert len(rows) == docs.count()
    assert sum(r.near_edited for r in rows) > 10 * sum(r.near_next for r in rows)


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b", "", 1), (1, "a b c d", "", 1), (1, "a b c d", "", 1), (1, None, "", 1)], SCHEMA)
    rows = P.edited_fingerprints(df).collect()
    assert len(rows) == 4
    assert P.edited_fingerprints(df.limit(0)).count() == 0


def test_large_group_of_copies_keeps_its_terms(spark):
    import random

    r = random.Random(6)
    vocabulary = [f"w{k}" for k in range(2000)]
    copy = r.sample(vocabulary, 80)
    near = copy[:40] + ["changed"] + copy[41:]
    others = [" ".join(r.sample(vocabulary, 60)) for _ in range(198)]
    rows = [(k, t, "x", 1) for k, t in enumerate([" ".join(copy)] * 100 + [" ".join(near)] * 2 + others)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    df = {x.term: x.df for x in P.lexicon(docs).collect()}
    apart = {x.term: x.df for x in P.lexicon(docs.dropDuplicates(["text"])).collect()}
    assert df == apart
    got = {x.doc_id: x.fingerprint for x in P.edited_fingerprints(docs).collect()}
    a, b = ([f[k: k + 8] for k in range(0, len(f), 8)] for f in (got[0], got[100]))
    assert any(x == y != "0" * 8 for x, y in zip(a, b))
