"""Columns that clash with those an operator uses inside, empty tables and very long texts."""

import pytest

from pixelweft.llm import fingerprints, jaccard_join, language_id, line_dedup, mixing, packing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_lines_beside_clashing_columns(spark):
    rows = [(1, "the very same line of words\nalone", 10, 11, 12, 13), (2, "The very same line of words!\nother", 20, 21, 22, 23)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, dropped long, line_doc long, line_hash long, line_gone long")
    got = sorted(map(tuple, line_dedup.dedup_lines(docs, least_exact=1).collect()))
    assert got == [(1, rows[0][1], 10, 11, 12, 13, 2, 0), (2, "other", 20, 21, 22, 23, 2, 1)]


def test_mix_keeps_the_callers_columns(spark):
    rows = [(k, "a b c", "s" if k % 2 else None, 7.0, "t", 3, 4, 5) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rate double, target string, source_size long, copies long, mix_size long")
    mixed = [tuple(r) for r in mixing.mix(docs).collect()]
    assert set(mixed) <= set(rows) and len(mixed) >= len(rows)


def test_pack_beside_clashing_columns(spark):
    rows = [(1, 0, 5, 77, 1, 2, 3), (2, 0, 6, 78, 4, 5, 6)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length long, offset long, part long, rank long, many long")
    got = sorted(packing.pack(pieces, 16).collect())
    assert [(r.part, r.rank, r.many) for r in got] == [(1, 2, 3), (4, 5, 6)] and sorted(r.offset for r in got) in ([0, 5], [0, 6])


def test_known_languages_beside_clashing_columns(spark):
    rows = [(k, f"plain words number {k} and some more of them", "en", "s", 5, "x", 0.5) for k in range(40)]
    docs = spark.createDataFrame(rows, DOCS + ", lang_pred string, score double")
    assert {tuple(r) for r in language_id.keep_known(docs, least=0.0).collect()} == set(rows)


@pytest.mark.parametrize("run", [
    lambda d: line_dedup.dedup_lines(d, least_exact=1), mixing.mix, language_id.identify, language_id.keep_known, jaccard_join.drop_near_duplicates,
    fingerprints.edited_fingerprints,
])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], DOCS)).collect() == []


def test_a_very_long_text(spark):
    long = "\n".join(" ".join(f"w{(i * j) % 9973}" for j in range(1, 40)) for i in range(1, 2500))
    rows = [(1, long, "en", "s", len(long)), (2, long, "en", "s", len(long)), (3, "short", "en", None, 5)]
    docs = spark.createDataFrame(rows, DOCS)
    left = {r.doc_id: r for r in line_dedup.dedup_lines(docs, least_exact=1).collect()}
    assert left[2].text == "" and left[2].n_dropped == 2499 and left[3].text == "short"
    same = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect()}
    assert same[1].fingerprint == same[2].fingerprint and same[1].near_next == 1.0


def test_scattered_ids_are_followed_in_order(spark):
    """Ids far apart, each in a stretch of its own: the next document is that of the next id."""
    import hashlib

    rows = [(k * 7_919_000_003 - 5 * 10**11, f"text number {k} " * (k % 5 + 1), "en", "s", 1) for k in range(300)]
    got = {r.doc_id: r.edited_sha256 for r in fingerprints.edited_fingerprints(spark.createDataFrame(rows, DOCS)).collect()}
    for (doc, text, *_), (_, after, *_) in zip(rows, rows[1:] + rows[:1]):
        n = len(text) // 4
        assert got[doc] == hashlib.sha256((text[: len(text) - n] + after[:n]).encode()).hexdigest()


def test_columns_named_with_dots(spark):
    from pixelweft.llm import fill_in_middle

    rows = [(k, f"plain words number {k} and some more of them\nline {k}", "en", "s", 5, "x", 2) for k in range(40)]
    docs = spark.createDataFrame(rows, DOCS + ", `a.b` string, `c``d` int")
    for run in (mixing.mix, lambda d: language_id.keep_known(d, least=0.0), jaccard_join.drop_near_duplicates, line_dedup.dedup_lines, fill_in_middle.rearrange):
        got = run(docs)
        assert got.columns[5:7] == ["a.b", "c`d"] and {r[5:7] for r in got.collect()} == {("x", 2)}
    pieces = spark.createDataFrame([(1, 0, 5, 77, 1), (2, 0, 6, 78, 4)], "doc_id long, piece int, length long, ids_crc32 long, `a.b` int")
    assert sorted(r["a.b"] for r in packing.pack(pieces, 16).collect()) == [1, 4]
