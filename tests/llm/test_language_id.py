import zlib

import numpy as np

from pixelweft.llm import language_id as L

SCHEMA = "doc_id long, text string, lang string, source string, lang_pred string, kind long"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = L.identify(docs).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_places_are_those_of_each_ngram():
    a, b = set(L.places("Été!").tolist()), set(L.places("  ÉTÉ... ").tolist())
    assert a == b
    assert L.places("12 .,!") is None and L.places("") is None
    assert set(L.places("ab").tolist()) <= set(L.places("ab ab").tolist())


def test_folded_weights_equal_the_features():
    rng = np.random.default_rng(0)
    found = (rng.random((40, L.PLACES)) < 0.01).astype(np.float32)
    model = L.fit_presence(found, ["a", "b"] * 20, np.arange(40) < 12, ridge=1e-2)
    unit = found / np.sqrt(found.sum(1, keepdims=True))
    z = unit[:12].astype(float)
    value, vector = np.linalg.eigh(z @ z.T)
    phi = unit @ z.T @ (vector / np.sqrt(value) @ vector.T)
    y = np.array([[1, 0], [0, 1]] * 20)
    w = np.linalg.solve(phi.T @ phi + 0.4 * np.eye(12), phi.T @ y)
    assert np.allclose(model.scores(found), phi @ w, atol=1e-4)


def test_nulls_and_empty(spark):
    rows = [(1, "the cat and the dog", "en", "s", "x", 1), (2, "le chat et le chien", "fr", "s", "x", 1), (3, None, "en", "s", "x", 1),
            (None, "der hund", None, None, "x", 1), (5, "1234 !!", "en", "s", "x", 1), (6, "", "en", "s", "x", 1)] * 2
    df = spark.createDataFrame(rows, SCHEMA)
    got = L.identify(df).collect()
    assert len(got) == len(rows)
    assert {r.lang_pred for r in got if r.doc_id in (3, 5, 6)} == {"und"}
    assert {r.held_out for r in got if r.doc_id is None} == {False}
    kept = L.keep_known(df)
    assert kept.columns == df.columns
    assert not {r.doc_id for r in kept.collect()} & {3, 5, 6}
    assert L.identify(df.limit(0)).count() == 0


def test_more_labels_than_languages_are_all_learned(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(70):
        words = ["".join(chr(0x4E00 + 40 * k + c) for c in rng.integers(0, 20, 3)) for _ in range(30)]
        for _ in range(12 if k < 64 else 8):
            rows.append((len(rows), " ".join(rng.choice(words, 20)), f"l{k:02d}", "s", "x", 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    assert L.fit(docs).languages == [f"l{k:02d}" for k in range(70)]
    got = {r.doc_id: r.lang_pred for r in L.identify(docs).collect()}
    assert all(got[d] == lang for d, _, lang, *_ in rows)
    assert len(L.fit(docs, languages=1, per_language=70, landmarks=7).languages) == 70


def test_foreign_texts_and_gibberish_in_latin_letters_go(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    foreign = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "xqzv wkjp bvxt qgfh zzkw pldm vqxr hjkt wbnz xcvq mfgh jkqw zxpt vbnk qwrt hgfd lkjz xvbm ptkw qzxj",
    ]
    more = spark.createDataFrame([(-1 - k, t, None) for k, t in enumerate(foreign)], docs.schema)
    kept = L.keep_known(docs.unionByName(more)).select("doc_id").collect()
    assert {r.doc_id for r in kept} == {r.doc_id for r in docs.where(F.col("text").isNotNull()).collect()}
