import random
import re

import numpy as np

from pixelweft.llm import line_dedup as D

SCHEMA = "doc_id long, text string, source string, line long, n_lines int"


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_word_edit_distance():
    r = random.Random(4)
    for _ in range(400):
        a = [r.randrange(6) for _ in range(r.randrange(0, 90))]
        b = [r.randrange(6) for _ in range(r.randrange(0, 90))] if r.random() < .5 else [x for x in a if r.random() < .9]
        assert D.word_edit_distance(a, b) == levenshtein(a, b)


def words_of(line):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", line.lower())


def corpus(seed=2):
    r = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "bcdfgh" for b in range(90)]
    base = [" ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 50))) for _ in range(120)]
    docs = []
    for d in range(80):
        lines = []
        for _ in range(r.randrange(1, 9)):
            words = r.choice(base).split(" ") if r.random() < .5 else [r.choice(vocabulary) for _ in range(r.randrange(1, 60))]
            if r.random() < .4:
                words[r.randrange(len(words))] = r.choice(vocabulary)
            lines.append(" ".join(words).upper() + "!" if r.random() < .2 else "  " + ", ".join(words))
        docs.append((d * 3, "\n".join(lines) + ("\n" if r.random() < .3 else ""), "s", 1, 2))
    return docs + [(1001, None, "s", 1, 2), (1002, "", "s", 1, 2), (1003, "\n\n", None, 1, 2), (None, docs[0][1], "s", 1, 2)]


def brute(docs, exact):
    """Kept lines per document; exact: only equal lines are alike, otherwise all of edit similarity 0.75 or more."""
    seen = [(d, k, words_of(x)) for d, t, *_ in docs if d is not None for k, x in enumerate((t or "").split("\n")) if words_of(x)]
    seen.sort(key=lambda x: x[:2])
    parent = list(range(len(seen)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, _, a) in enumerate(seen):
        for j in range(i):
            b = seen[j][2]
            m = max(len(a), len(b))
            if a == b or not exact and 4 * min(len(a), len(b)) >= 3 * m and 4 * (m - levenshtein(a, b)) >= 3 * m:
                p, q = sorted((top(i), top(j)))
                parent[q] = p
    return {(d, k) for i, (d, k, _) in enumerate(seen) if top(i) != i}


def got_drops(spark, docs):
    rows = D.dropped_lines(spark.createDataFrame(docs, SCHEMA).repartition(3), least_exact=1).collect()
    return {(r.doc_id, a) for r in rows for a in r.dropped}


def test_between_exact_and_fuzzy_brute_force(spark):
    docs = corpus()
    got = got_drops(spark, docs)
    exact, fuzzy = brute(docs, True), brute(docs, False)
    assert exact <= got <= fuzzy
    assert len(got - exact) >= 0.5 * len(fuzzy - exact)


def test_large_groups_give_the_same(spark, monkeypatch):
    docs = corpus()
    few = got_drops(spark, docs)
    monkeypatch.setattr(D, "_FEW", 1)
    assert got_drops(spark, docs) == few


def test_texts(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, SCHEMA)
    out = D.dedup_lines(df, least_exact=1)
    assert out.columns == ["doc_id", "text", "source", "line", "n_lines", "n_dropped"]
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == len(docs)
    drops = got_drops(spark, docs)
    for d, t, *_ in docs:
        lines = t.split("\n") if t is not None else []
        assert rows[d].n_lines == len(lines)
        assert rows[d].text == (None if t is None else "\n".join(x for k, x in enumerate(lines) if (d, k) not in drops))
    assert D.dedup_lines(df.limit(0)).count() == 0


def test_all_fuzzy_links_by_brute_force(spark):
    docs = corpus(5)
    assert got_drops(spark, docs) == brute(docs, False)


def test_every_similarity_band_meets():
    """Lines that are similar to any allowed degree share a leading gram, whatever the order, and pass the filter."""
    r, rng = random.Random(8), np.random.default_rng(8)
    order = rng.integers(0, 9, 1 << D._TABLE_BITS).astype(np.int32)
    for percent in (75, 90, 60):
        met, all_ = {}, {}
        while sum(all_.values()) < 1500:
            a = [r.randrange(1, 1 << 62) if r.random() < .7 else r.randrange(1, 6) for _ in range(r.randrange(3, 70))]
            b = list(a)
            for _ in range(r.randrange(1, len(a) // 3 + 2)):
                k, what = r.randrange(len(b)), r.randrange(4)
                b[k: k + (what != 1)] = [] if what == 0 and len(b) > 1 else [r.randrange(1, 1 << 62)]
            n, m = sorted((len(a), len(b)))
            similar = 100 * (m - levenshtein(a, b)) // m
            if n < (4 if percent < 67 else 3) or similar < percent:
                continue
            words, first = np.array(a + b, np.uint64), np.array([0, len(a), len(a) + len(b)])
            line, gram, place = D.leading_grams(words, first, percent, order)
            at = [dict(zip(gram[line == k].tolist(), place[line == k].tolist())) for k in (0, 1)]
            common = [g for g in at[0] if g in at[1] and D.may_align(len(a), at[0][g], len(b), at[1][g], percent)]
            ok = bool(common)
            for wide in (1, D._NARROW, D._WIDE):
                parity = D.parities(words, first, wide)
                ok = ok and D.may_link(len(a), parity[0], len(b), parity[1], percent)
            all_[similar // 5] = all_.get(similar // 5, 0) + 1
            met[similar // 5] = met.get(similar // 5, 0) + bool(ok)
        assert met == all_


def test_short_lines_and_scripts_without_blanks(spark, tmp_path):
    from pixelweft.llm import queries

    thai, han = "สวัสดีครับยินดีต้อนรับ", "今天天气很好我们去公园散步吧"
    texts = ["Read more\n" + han + "\nOK", "read more!\n" + han[:-1] + "呢\n一", thai + "\nok\n--", thai + "\nRead less\nmore read"]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in queries.op2_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {0: texts[0], 1: "一", 2: thai + "\n--", 3: "Read less\nmore read"}
    data = np.frombuffer(f"ab{han[:2]}c d\n{thai[0]}".encode(), np.uint8)
    words, first, lines, size = D.line_words(data, np.array([0, len(data)]))
    assert first.tolist() == [0, 5, 6] and size.tolist() == [2, 3, 3, 1, 1, 3] and lines.tolist() == [0, 2]


def test_same_words_in_another_order_hide_no_link(spark):
    r = random.Random(12)
    docs = []
    for k in range(40):
        words = [f"{r.choice('bcdf')}{r.randrange(10**6)}" for _ in range(24)]
        turned, changed = r.sample(words, 24), list(words)
        changed[r.randrange(24)] = "other"
        docs += [(3 * k + i, " ".join(x), "s", 1, 1) for i, x in enumerate((turned, words, changed))]
    assert got_drops(spark, docs) == brute(docs, False)


def test_short_lines_lose_no_link(spark):
    """Lines of one to six words out of few words: many are near copies of three against four."""
    r = random.Random(4)
    docs = [(k, "\n".join(" ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota".split()) for _ in range(r.randrange(1, 7))) for _ in range(3)), "s", 1, 1) for k in range(60)]
    docs += [(100, "one two three four", "s", 1, 1), (101, "one two three", "s", 1, 1), (102, "two three four", "s", 1, 1), (103, "one three four", "s", 1, 1)]
    got = got_drops(spark, docs)
    assert got == brute(docs, False) and {(101, 0), (102, 0), (103, 0)} <= got


def test_gram_order_counts_all_documents(spark):
    """Frequencies come from every document, however many there are: a gram in all of them ranks above those of one."""
    docs = spark.createDataFrame([(i, f"the common start word{i} word{i + 1} word{i + 2}") for i in range(6000)], "doc_id long, text string").repartition(3)
    counts = D._lines(docs, 75, 3).where("n_words < 0")
    total = sum(np.frombuffer(r.parity, np.int64).reshape(2, -1)[1].sum() for r in counts.collect())
    assert total == 5 * 6000
    order = D._order(counts)
    assert order.max() > 30 and (order > 30).sum() == 2 and order[order > 0].min() >= 1


def test_similar_is_edit_similarity():
    """Pairs that one shift explains and pairs that need measuring, each against the plain distance."""
    r = random.Random(3)
    pairs = []
    for _ in range(600):
        a = [r.randrange(1, 12 if r.random() < .3 else 1 << 31) for _ in range(r.randrange(1, 40))]
        b = list(a)
        for _ in range(r.randrange(0, len(a) // 2 + 1)):
            k = r.randrange(len(b))
            b[k: k + r.randrange(2)] = [r.randrange(1, 1 << 31)][: r.randrange(2)] if len(b) > 1 else [7]
        pairs.append((a, b) if r.random() < .5 else (b, a))
    packed = [[np.array(p[k], np.uint32).tobytes() for p in pairs] for k in (0, 1)]
    want = [100 * (max(map(len, p)) - levenshtein(*p)) >= 75 * max(map(len, p)) for p in pairs]
    assert D.similar(*packed, 75).tolist() == want and 100 < sum(want) < 500 and D.similar([], [], 75).tolist() == []


def test_few_chance_pairs_make_no_star():
    """Of a gram under which few of many pairs may link, these pairs are candidates; a star would take in lines that link with nothing."""
    from pixelweft.llm.common import forest

    pairs, group = np.array([[0, 1], [0, 2], [1, 2], [3, 4]]), np.zeros(5, int)
    chosen, (lead, member) = forest(pairs, group, D._EACH)
    assert sorted(map(tuple, chosen.tolist())) == sorted(map(tuple, pairs.tolist())) and not len(lead) and not len(member)


def test_a_line_meets_under_no_more_grams_than_can_be_broken():
    """Of a long line's bigrams fewer than one more than half are taken, as few of those taken are neighbours; some hold against any edits."""
    rng = np.random.default_rng(5)
    order = rng.integers(0, 60, 1 << D._TABLE_BITS).astype(np.int32)
    words, first = rng.integers(1, 1 << 62, 12000).astype(np.uint64), np.arange(0, 12001, 60)
    line, _, place = D.leading_grams(words, first, 75, order)
    assert 20 < np.bincount(line).min() and len(line) < 0.45 * len(words)
    for k in range(40):  # the edits that break most: words between two of the places taken, then single ones
        left, broken = set(place[line == k].tolist()), 0
        for p in sorted(left):
            if broken < 15 and p in left and p + 1 in left:
                left -= {p, p + 1}
                broken += 1
        assert len(left) > 15 - broken


def test_pairs_of_neighbours_are_never_too_few():
    rng = np.random.default_rng(3)
    for n in [*range(1, 40)] * 3:
        at = rng.permutation(n)
        got = D._neighbours(at, np.zeros(n, np.int64))
        for k in range(n + 1):
            taken = np.isin(np.arange(n), at[:k])
            runs = "".join(" x"[int(t)] for t in taken).split()
            assert sum(len(x) // 2 for x in runs) <= got[k] <= sum(max(len(x) // 2, len(x) - 2) for x in runs)
    assert D._neighbours(np.arange(4), np.array([0, 0, 1, 1])).tolist() == [0, 0, 1, 1, 2]


def test_common_words_count_as_often_as_both_have_them():
    """Pairs with too few common words are told apart without measuring them."""
    r, rng = random.Random(6), np.random.default_rng(6)
    x, y = ([np.array([r.randrange(6) for _ in range(r.randrange(20))], np.uint32).tobytes() for _ in range(200)] for _ in range(2))
    want = [sum(min(a.count(w), b.count(w)) for w in set(a)) for a, b in ((np.frombuffer(p, np.uint32).tolist(), np.frombuffer(q, np.uint32).tolist()) for p, q in zip(x, y))]
    assert D._common(x, y).tolist() == want and D._common([], []).tolist() == [] and D._common([b""], [b""]).tolist() == [0]
    far = [rng.integers(0, 1 << 32, 400).astype(np.uint32).tobytes() for _ in range(20)]
    measured = D.word_edit_distance
    try:
        D.word_edit_distance = lambda *_: 1 / 0
        assert not D.similar(far[:10], far[10:], 75).any()
    finally:
        D.word_edit_distance = measured


def test_lower_bytes():
    from pixelweft.llm.common import lower_bytes, word_hashes

    texts = ["Some ASCII", None, "", "ÄÖ ΣΑΣ İ", "été A"]
    data, offsets = lower_bytes(texts)
    lower = [(t or "").lower() for t in texts]
    assert [data[a:b].tobytes().decode().lower() for a, b in zip(offsets, offsets[1:])] == lower
    want = np.frombuffer("".join(lower).encode(), np.uint8)
    assert word_hashes(data, offsets)[0].tolist() == word_hashes(want, np.cumsum([0] + [len(t.encode()) for t in lower]))[0].tolist()
    assert lower_bytes([])[1].tolist() == [0]
