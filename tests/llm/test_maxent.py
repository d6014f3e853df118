"""The language model against counts and a plain evaluation of the same weights; its held-out gain over the base; nulls and the like."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pixelweft.llm import maxent

SCHEMA = "doc_id long, text string, held_out string, rare int, key string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def split(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(low), None]  # None: the end


def base(rows):
    """(doc_id, held_out, n_tokens, n_known, N, base_score) by plain counting."""
    train = [t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for t in train for w in split(t))
    whole, distinct = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        words = split(t)
        s = sum(math.log10((counts[w] + 0.1) / (whole + 0.1 * (distinct + 1))) for w in words)
        out.append((-1 if i is None else i, i is not None and zlib.crc32(str(i).encode()) % 10 == 0, len(words), sum(counts[w] > 0 for w in words), whole, s))
    return sorted(out)


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA).repartition(3)
    return maxent.score(df, **how).collect()


def corpus(n, seed=3):
    """Sentences of two tongues whose words follow each other in pairs."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        tongue = "ka lo mi ne pu ra so tu".split() if i % 2 else "Bex cux dix fox gux hax jex kix".split()
        out = []
        for _ in range(int(rng.integers(5, 40))):
            k = int(rng.integers(0, 8))
            out += [tongue[k], tongue[(k + 3) % 8] + (f"{rng.integers(0, 400)}" if rng.random() < 0.1 else "")]
        rows.append((i, " ".join(out)))
    return rows


def same(got, want):
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-12, atol=1e-9)


@pytest.mark.parametrize("listed", [maxent.LISTED, 64])
def test_base_by_counting(spark, monkeypatch, listed):
    """With few words listed all others meet their counts in the join."""
    monkeypatch.setattr(maxent, "LISTED", listed)
    rows = corpus(120) + [(500, None), (501, ""), (502, " \t\x0b"), (None, "ka lo"), (503, "Ünknown \x1cÄ ka"), (7, "again ka"), (7, "again ka"), (504, "long ka " * 40000)]
    got = run(spark, rows)
    same(got, base(rows))
    assert all(r.score < 0 for r in got)


@pytest.mark.parametrize("rows", [[], [(None, "a b")], [(i, "held out text") for i in range(2000) if zlib.crc32(str(i).encode()) % 10 == 0][:3], [(1, None), (2, None)]])
def test_empty_and_nothing_to_learn(spark, rows):
    same(run(spark, rows), base(rows))


def test_held_out_texts_are_likelier_than_by_the_base(spark):
    got = [r for r in run(spark, corpus(1500)) if r.held_out]
    tokens = sum(r.n_tokens for r in got)
    gain = sum(r.score - r.base_score for r in got) / tokens
    assert len(got) > 100 and gain > 0.35  # two tongues and fixed pairs: well over a bit a token


def test_reruns_agree(spark):
    rows = corpus(200)
    a, b = ({r.doc_id: (r.base_score, r.score) for r in run(spark, rows)} for _ in range(2))
    assert a.keys() == b.keys() and np.allclose([a[k] for k in a], [b[k] for k in a], rtol=1e-9)


def model(bits=8, seed=1):
    rng = np.random.default_rng(seed)
    listed = np.array([maxent.mix64(np.array([k], np.uint64))[0] for k in range(1, 600)], np.uint64)
    words = maxent.Vocabulary(10**6, 700, listed, np.sort(rng.integers(1, 9999, len(listed)))[::-1], rng.random(maxent.WIDTH**2) * 500 + 0.1)
    return words, rng.normal(0, 0.7, (1 << bits, maxent.WIDTH)).astype(np.float32), bits


def plain(words, weights, keys, place, bits):
    """P(place | context) token by token, in doubles."""
    base, out = maxent.bases(words), []
    for i in range(len(place)):
        cls, own = divmod(int(place[i]), maxent.WIDTH)
        r1, r2 = maxent._rows(keys[:, i: i + 1], np.array([cls]), bits)
        p = 1.0
        for rows, offset, target in ((r1, base[0], cls), (r2, base[1][cls], own)):
            z = [float(offset[j]) + sum(float(weights[int(r[0]), j]) for r in rows) for j in range(maxent.WIDTH)]
            p *= math.exp(z[target]) / sum(map(math.exp, z))
        out.append(math.log(p))
    return out


def contexts(words):
    texts = pa.array(["one two three four one two", None, "five", "six seven eight"])
    lookup, n = words.lookup(False), 100
    return [maxent._features(h, t, lookup(h), start, n) for _, h, t, start in maxent.tokens(texts)]


def test_shares_like_a_plain_evaluation_and_sum_to_one():
    words, weights, bits = model()
    for keys, place in contexts(words):
        assert np.allclose(maxent.log_shares(weights, maxent.bases(words), keys, place, bits), plain(words, weights, keys, place, bits), atol=1e-4)
        every = np.arange(maxent.WIDTH**2)
        total = np.exp(maxent.log_shares(weights, maxent.bases(words), np.repeat(keys[:, :1], len(every), axis=1), every, bits)).sum()
        assert abs(total - 1) < 1e-5


def test_contexts_end_with_the_text():
    words, _, _ = model()
    together = contexts(words)[0][0]
    alone = np.concatenate([maxent._features(h, t, words.lookup(False)(h), s, 100)[0] for x in ["one two three four one two", None, "five", "six seven eight"] for _, h, t, s in maxent.tokens(pa.array([x], pa.string()))], axis=1)
    assert (together == alone).all()


def test_a_step_follows_the_gradient():
    """Small steps from zero weights move every row against its numerical gradient, scaled by its norm."""
    words, weights, bits = model(bits=6)
    keys, place = contexts(words)[0]
    trainer = maxent.Trainer(weights, np.ones(len(weights), np.float32), maxent.bases(words), bits, 1e-3)
    trainer.step(keys, place)
    moved = (trainer.weights - weights).astype(np.float64)
    rng = np.random.default_rng(0)
    at = rng.choice(np.flatnonzero(trainer.hits), 6)
    for row in at:
        grad = []
        for j in range(maxent.WIDTH):
            two = []
            for e in (1e-3, -1e-3):
                w = weights.astype(np.float64)
                w[row, j] += e
                two.append(-sum(plain(words, w, keys, place, bits)))
            grad.append((two[0] - two[1]) / 2e-3)
        want = -np.array(grad) * 1e-3 / math.sqrt(1 + 1e-6 + sum(g * g for g in grad))
        assert np.allclose(moved[row], want, atol=2e-6)
    assert trainer.hits.sum() == 2 * maxent.FEATURES * len(place) and (moved[trainer.hits == 0] == 0).all()


def test_lookup_finds_all_keys_and_no_others():
    keys = maxent.mix64(np.arange(1, 5000, dtype=np.uint64))
    lookup = maxent.Lookup(keys[:3000], np.arange(3000))
    assert (lookup(keys) == np.where(np.arange(4999) < 3000, np.arange(4999), -1)).all()
    assert (maxent.Lookup(keys[:0], np.arange(0))(keys) == -1).all()
