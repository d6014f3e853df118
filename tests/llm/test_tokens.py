import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from pixelweft.llm import packing, token_counts, token_output, tokens

SCHEMA = "doc_id long, text string, source string, start long, length long"
TEXTS = ["", None, "One two's, THREE!?\n\tfour  five", "x<|endoftext|> y ź İI 12 3", "ΟΔΟΣ! क़ a1.", "word " * 6000, "ÉTÉ!! Über; " * 50, "a" * 5000, "same", "same"]


def expected(texts):
    t = Tokenizer.from_file(tokens.default_vocabulary())
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_words_equal_whole_texts(spark):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts = [x or "" for x in TEXTS] + docs
    enc = tokens.WordEncoder(tokens.default_vocabulary())
    assert enc.by_word
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.many(texts)] == expected(texts)


def test_small_cache_changes_nothing(monkeypatch):
    texts = [" ".join(f"w{random.Random(i).randrange(900)}x" for i in range(k, k + 300)) for k in range(9)]
    monkeypatch.setattr(tokens, "CACHE_WORDS", 100)
    enc = tokens.WordEncoder(tokens.default_vocabulary())
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.many(texts)] == expected(texts)


def test_trees_count_like_whole_texts(spark):
    r = random.Random(1)
    enc = tokens.encoder(tokens.default_vocabulary())
    for text in [x or "" for x in TEXTS] + [" ".join(f"w{r.randrange(500)}" for _ in range(2000))]:
        tree = token_counts.SegmentTree.of(text, enc)
        for _ in range(25):
            a = r.randrange(len(text) + 1)
            text, _ = tree.edit(text, a, a + r.choice([0, 1, 3, 50, 900]), r.choice(["", " ", "word", "a b c", "x" * 900, " new\n"]), enc)
            assert tree.count() == enc.count(text)
            assert tree.chars[1] == len(text)


def test_edits_over_a_table(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, x, "s", 1, 2) for i, x in enumerate(TEXTS)] + [(None, "a b", "s", 1, 2)], SCHEMA)
    edits = F.array(F.struct(F.lit(2).alias("start"), F.lit(5).alias("stop"), F.lit("new words ").alias("replacement")))
    vocabulary = tokens.default_vocabulary()
    rows = token_counts.apply_edits(token_counts.build_trees(df, vocabulary), edits, vocabulary, keep_text=True).collect()
    assert len(rows) == len(TEXTS) + 1
    for row, ids in zip(rows, expected([r.edited_text for r in rows])):
        assert row.edited_n_tokens == len(ids) == row.tree_tokens[1]
    none = token_counts.apply_edits(token_counts.build_trees(df, vocabulary), F.lit(None), vocabulary).collect()
    assert all(r.n_tokens == r.edited_n_tokens for r in none)


def test_files_round_trip(spark):
    rows = [(i * 7 % 11, x, "s", 1, 2) for i, x in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    manifest = token_output.write_tokens(df, tokens.default_vocabulary(), length=64, rows_per_batch=4, file_ids=3000)
    got = {r.doc_id: r for r in token_output.read_tokens(manifest).collect()}
    assert manifest.count() > 2
    at = 0
    for doc, text, *_ in sorted(rows):
        ids = np.array([*expected([text])[0], 1], "<u4")
        assert (got[doc].start, got[doc].n_tokens, got[doc].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    for m in manifest.collect():
        ids, mask = token_output.open_sequences("file://" + m.path)
        flat = np.concatenate([c.values.to_numpy(zero_copy_only=True) for c in ids.chunks])
        assert sum(c.values.to_numpy(zero_copy_only=False).sum() for c in mask.chunks) == m.ids <= len(flat)
    empty = token_output.read_tokens(token_output.write_tokens(df.limit(0), tokens.default_vocabulary()))
    assert empty.count() == 0


def check_packing(rows, capacity):
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(used)


def test_packing_of_documents(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 3)
    rows = [(i, x, "s", 1, 2) for i, x in enumerate(TEXTS * 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = [r.asDict() for r in packing.pack(packing.token_pieces(df, tokens.default_vocabulary())).collect()]
    check_packing(out, 4096)
    by_doc = {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for doc, text, *_ in rows:
        ids = np.array([*expected([text])[0], 1], "<u4")
        pieces = sorted(by_doc[doc], key=lambda r: r["piece"])
        assert [r["start"] for r in pieces] == list(range(0, len(ids), 4096))
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"]: r["start"] + r["length"]].tobytes()) for r in pieces)
    assert packing.pack(packing.token_pieces(df.limit(0), tokens.default_vocabulary())).count() == 0


def test_plans_fill_sequences():
    r = random.Random(3)
    for histogram in [{4096: 5, 3000: 1000, 1096: 900, 100: 5000}, {1: 100000}, {2049: 77}, {x: r.randrange(50) for x in range(1, 4097)},
                      {int(r.lognormvariate(6.5, 1)) % 4096 + 1: r.randrange(1, 99) for _ in range(3000)}]:
        plan = packing.plan_packing(histogram)
        rows = [{"sequence_id": s + i // e, "offset": o + i % e * x, "length": x} for x, _, n, s, o, e in plan.runs for i in range(n)]
        assert sorted(x["length"] for x in rows) == sorted(x for x, n in histogram.items() for _ in range(n))
        used = check_packing(rows, 4096)
        assert used == plan.sequences
        least = max(-(-sum(x * n for x, n in histogram.items()) // 4096), sum(n for x, n in histogram.items() if x > 2048))
        assert used <= 1.02 * least + 3


def test_trees_and_edits_of_an_empty_table(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([], "doc_id long, text string, `a.b` int")
    trees = token_counts.build_trees(docs, tokens.default_vocabulary())
    assert trees.collect() == [] and token_counts.apply_edits(trees, F.lit(None), tokens.default_vocabulary(), keep_text=True).collect() == []
