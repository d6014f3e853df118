import random
import re

import numpy as np
import pytest

from pixelweft.llm import jaccard_join as J

SCHEMA = "doc_id long, text string, source string, kind long, a long"


def brute(rows, percent=75):
    sets = {}
    for doc, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc] = {tuple(words[i: i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((top(a), top(b)))
                parent[q] = p
    return {d: (len(sets[d]), top(d)) for d in ids}


def corpus(seed=3):
    r = random.Random(seed)
    word = [f"w{i}" for i in range(3000)]
    rows, n = [], 0
    for size in [1, 2, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 30, 45, 60, 90, 150, 300, 700]:
        for _ in range(3):
            base = [r.choice(word) for _ in range(size)]
            rows.append((n, " ".join(base)))
            n += 1
            for _ in range(6):
                edited = list(base)
                for _ in range(r.randrange(0, 1 + size // 40 + 2)):
                    k = r.randrange(len(edited))
                    edited[k: k + r.choice((0, 1))] = [r.choice(word)] * r.choice((0, 1, 1, 2))
                    edited = edited or ["x"]
                rows.append((n, " ".join(edited).upper() if r.random() < .2 else "  " + "\n".join(edited)))
                n += 1
    shared = " ".join(r.choice(word) for _ in range(60))
    for _ in range(12):  # a passage that many documents share, in documents of many sizes
        rows.append((n, shared + " " + " ".join(r.choice(word) for _ in range(r.randrange(0, 40)))))
        n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "one two three"), (n + 4, "One  two three")]
    return [(d, t, "s", 1, 2) for d, t in rows]


def test_components_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_nulls_repeats_and_empty(spark):
    text = " ".join(f"t{i}" for i in range(40))
    rows = [(None, text, "s", 1, 2), (4, text, "s", 1, 2), (4, text, "s", 1, 2), (7, text + " more", None, 1, 2), (9, None, "s", 1, 2)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id) for r in J.near_duplicates(docs).collect() if r.doc_id is not None)
    assert got == [(False, 4, 36, 4), (False, 4, 36, 4), (False, 7, 37, 4), (False, 9, 0, 9)]
    kept = J.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["4", "9", "None"]
    assert J.near_duplicates(docs.limit(0)).count() == 0


def test_signatures_meet_for_every_similar_pair():
    import numpy as np

    rng = np.random.default_rng(5)
    bands = J.Bands(75)
    for _ in range(4000):
        n = int(rng.integers(3, 400))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        drop = int(rng.integers(0, n // 4 + 1))
        add = rng.integers(0, 2**63, int(rng.integers(0, n // 4 + 1)), dtype=np.uint64)
        b = np.unique(np.concatenate((rng.permutation(a)[drop:], add)))
        if J.similar(a, b, 75) and not np.array_equal(a, b):
            assert np.intersect1d(bands.signatures(a), bands.signatures(b)).size, (len(a), len(b))


def near_threshold(seed=9):
    """Chains of texts around a similarity of 0.75 that share a passage, so that stars do not hold together, and a third of copies."""
    r = random.Random(seed)
    word = [f"v{i}" for i in range(4000)]
    passage = [r.choice(word) for _ in range(60)]
    texts = []
    for _ in range(40):
        tail = [r.choice(word) for _ in range(r.randrange(0, 30))]
        texts.append(" ".join(passage + tail))
    for _ in range(3):
        text = [r.choice(word) for _ in range(90)]
        for _ in range(25):
            text = list(text)
            text[r.randrange(len(text))] = r.choice(word)
            texts.append(" ".join(text))
    texts += [texts[0]] * 50
    r.shuffle(texts)
    return [(d, t, "s", 1, 2) for d, t in enumerate(texts)]


def test_stars_and_blocks_give_the_same(spark, monkeypatch):
    from pixelweft.llm import common

    rows = near_threshold()
    want = brute(rows)
    assert len({c for _, c in want.values()}) < len(want) - 100
    docs = spark.createDataFrame(rows, SCHEMA)
    for few, weight in ((12, 1 << 21), (1, 1 << 21), (1, 500)):
        monkeypatch.setattr(J, "_FEW", few)
        monkeypatch.setattr(common, "BLOCK_WEIGHT", weight)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_duplicates(docs).collect()} == want


def test_columns_of_any_name_and_a_very_long_text(spark):
    long = " ".join(f"x{i % 7919}y{i % 13}" for i in range(60_000))
    rows = [(1, long, 5, 6, 7), (2, long + " end", 8, 9, 10), (3, "another text of seven words in all", 1, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_id long, kept_rows long, __n long")
    assert sorted(map(tuple, J.drop_near_duplicates(docs).collect())) == [rows[0], rows[2]]


def test_forests_cover_all_that_may_link():
    import numpy as np

    from pixelweft.llm.common import Overlaps, covered, joining

    rng = np.random.default_rng(2)
    for n in (1, 2, 9, 40, 700):
        may = np.triu(rng.random((n, n)) < 1.5 / n, 1)
        may |= may.T
        pairs, members = covered(n, lambda i, j: (may[i, j] | (i == j)))
        assert may[pairs[:, 0], pairs[:, 1]].all() and set(members) == set(np.flatnonzero(may.any(1))) == set(pairs.reshape(-1).tolist())
    sets = [np.unique(rng.integers(0, 60, 30)).astype(np.uint64) for _ in range(50)]
    over = Overlaps(sets)
    assert over.of(7).tolist() == [len(np.intersect1d(sets[7], s)) for s in sets]
    some = over.only(np.array([3, 7, 20]))
    assert some.of(1).tolist() == [len(np.intersect1d(sets[7], sets[k])) for k in (3, 7, 20)]
    links = joining(np.array([5, 5, 5, 8, 8, 9, 4]), lambda i, j: np.array([k for k in j if (i, k) in {(3, 1), (3, 2), (5, 4), (6, 6)}], np.int64))
    assert links.tolist() == [[3, 1], [5, 4]]


@pytest.mark.parametrize("bits", [24, 5, 3])
def test_signatures_shared_by_sets(bits):
    """One sort of signatures and sets, also where these are too many for one word."""
    rng = np.random.default_rng(1)
    keys, counts, nodes, want = [], [], [], {}
    for _ in range(7):
        count, node = rng.integers(0, 9, 30), rng.integers(0, 100, 30)
        key = (rng.integers(0, 400, count.sum()) * (1 << 31) // 7 + rng.integers(0, 2, count.sum())) % (1 << 40)
        keys.append(((key >> 8).astype(np.uint32), (key & 255).astype(np.uint8)))
        counts.append(count)
        nodes.append(node)
        for k, n in zip(key.tolist(), np.repeat(node, count).tolist()):
            want.setdefault(k, []).append(n)
    got = J._shared(keys, np.concatenate(nodes), counts, 100, bits)
    assert sorted(zip(*(c.tolist() for c in got))) == sorted((k, n) for k, v in want.items() if len(v) > 1 for n in set(v))
