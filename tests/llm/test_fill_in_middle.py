"""Rearranged texts against plain Python, and back."""

import hashlib

from pyspark.sql import functions as F

from pixelweft.llm import fill_in_middle

SCHEMA = "doc_id long, text string, `a.b` int, fim_form string, fim_low int"


def brute(doc_id, text, unit=None):
    t = text or ""
    units = list(t) if unit is None else unit(t)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k: 8 * k + 8], 16) for k in range(4))
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, t
    if h4 % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = ["", None, "a", "two words", "line\nends\r\n\x85 too", "\U0001f600\U0001f601é́", "has <P> inside", "<S>", "x<M>", "<P", "S>", "<<P<S", "><", "\0\0", "�" * 3, "\U0001f468‍\U0001f469" * 20, "<" * 50, "long " * 30000]


def test_like_plain_python(spark):
    rows = [(i, TEXTS[i % len(TEXTS)], i, "mine", 3) for i in range(400)] + [(None, "without an id", 1, "x", 1), (5, "twice", 1, "x", 1), (5, "twice", 1, "x", 1)]
    done = fill_in_middle.rearrange(spark.createDataFrame(rows, SCHEMA).repartition(3)).withColumn("back", fill_in_middle.restored("fim_text", "fim_form"))
    assert done.columns == ["doc_id", "text", "a.b", "fim_low", "fim_units", "fim_form", "fim_prefix", "fim_middle", "fim_suffix", "fim_text", "back"]
    got = done.collect()
    assert len(got) == len(rows) and {r.fim_form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r.fim_units, r.fim_form, None if r.fim_prefix is None else len(r.fim_prefix), None if r.fim_middle is None else len(r.fim_middle), r.fim_text) == brute(r.doc_id, r.text)
        assert r.back == (r.text or "") and (r.fim_form == "plain" or r.fim_prefix + r.fim_middle + r.fim_suffix == r.text)


def test_units_of_words(spark):
    import re

    rows = [(i, f"some words  of\ttext {i} ", 0, "", 0) for i in range(60)]
    got = fill_in_middle.rearrange(spark.createDataFrame(rows, SCHEMA), unit=r"\s*\S+|\s+").collect()
    for r in got:
        assert (r.fim_units, r.fim_form, r.fim_text) == (lambda b: (b[0], b[1], b[4]))(brute(r.doc_id, r.text, lambda t: re.findall(r"\s*\S+|\s+", t)))


def test_empty_table_and_a_plan_without_shuffle_or_python(spark):
    empty = spark.createDataFrame([], SCHEMA)
    done = fill_in_middle.rearrange(empty)
    assert done.collect() == []
    plan = done.select(F.sha2(fill_in_middle.restored("fim_text", "fim_form"), 256))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
