from fractions import Fraction

from pixelweft.llm import mixing

SCHEMA = "doc_id long, text string, source string, rate long, target long"


def water_fill(sizes):
    """Targets by sharing, capping and sharing the excess again until none is above, in fractions."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = Fraction(3, 2) * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = Fraction(2 * sizes[s])
            left -= target[s]
        open_ -= over
    return target


def corpus():
    rows = []
    for k, (source, n, words) in enumerate([("a", 400, 30), ("B", 300, 12), ("é", 50, 7), (None, 200, 9), ("empty", 4, 0), ("z", 20, 100), ("\U0001f600", 30, 11)]):
        rows += [(k * 1000 + i, " ".join(["w x"] * (words + i % 3 if words else 0)) + "\x0b\t", source, 1, 2) for i in range(n)]
    return rows + [(99999, None, "a", 1, 2), (None, "one two", "a", 1, 2), (5, "twice here", "B", 1, 2), (5, "twice here", "B", 1, 2)]


def test_targets_and_taken(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    counted = mixing.mix_counts(df).collect()
    assert len(counted) == len(rows)
    sizes, taken = {}, {}
    for r in counted:
        sizes[r.source] = sizes.get(r.source, 0) + r.mix_size
        taken[r.source] = taken.get(r.source, 0) + r.mix_size * r.copies
        assert r.copies <= 2
    want = water_fill(sizes)
    for r in counted:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(60, 0.25 * t)
    again = {(r.doc_id, r.text): r.copies for r in mixing.mix_counts(df.repartition(5)).collect()}
    assert again == {(r.doc_id, r.text): r.copies for r in counted}
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in counted)
    assert mixing.mix(df.limit(0)).count() == 0


def test_sizes(spark):
    df = spark.createDataFrame([(1, "a  b\tc\u00a0d e\x1c ", "s", 1, 2), (2, None, "s", 1, 2), (3, " \n ", "s", 1, 2)], SCHEMA)
    assert {r.doc_id: r.mix_size for r in mixing.mix_counts(df).collect()} == {1: 4, 2: 0, 3: 0}
