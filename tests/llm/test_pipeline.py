import collections

import corpus_pipeline as P
from test_jaccard_join import brute


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for k, (name, step) in enumerate(P.STAGES[:4]):
        before = docs
        step(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.columns == before.columns == list(P.COLUMNS)
        sizes.append(docs.count())
        if name == "n-gram Jaccard join":
            groups = brute([(r.doc_id, r.text) for r in before.collect()])
            assert {r.doc_id for r in docs.collect()} == {d for d, (_, c) in groups.items() if c == d}
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] > 0 and sizes[1] > 0.95 * sizes[0]
    mixed = collections.Counter(r.doc_id for r in docs.collect())
    assert max(mixed.values()) <= 2
    out = P.STAGES[4][1](spark, docs, sf).collect()
    assert {r.doc_id for r in out} == set(mixed)
    used = collections.defaultdict(list)
    for r in out:
        used[r.sequence_id].append((r.offset, r.length))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in out)
    assert len(used) <= 1.05 * -(-total // 4096) + 1


def test_stages_with_nulls_repeats_and_clashing_columns(spark):
    """Every stage but the last returns the columns it gets; null texts and ids, repeated rows and any column names are let through it."""
    import corpus_pipeline

    text = "the first line of a plain document that says one thing\nand a second line that says another"
    rows = [(1, text, "en", "a", 5, 1.0, "x"), (1, text, "en", "a", 5, 1.0, "x"), (2, None, "en", "a", None, 2.0, "y"), (None, "a text without an id, of eight words", None, None, 7, 3.0, "z"),
            (3, "", "en", "b", 0, 4.0, "v"), (4, "short", "en", None, 5, 5.0, "w")]
    names = "doc_id long, text string, lang string, source string, n_chars long, rate double, dropped string"
    docs = spark.createDataFrame(rows, names)
    for k, (_, step) in enumerate(corpus_pipeline.STAGES[:-1]):
        got = step(spark, docs, "")
        assert got.columns == docs.columns
        kept = [tuple(r) for r in got.collect()]
        assert {r[5:] for r in kept} <= {r[5:] for r in rows}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").select("doc_id").distinct().count() == 5


def test_empty_documents(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
