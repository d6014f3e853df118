"""Cases worked out by hand, and parity of some registered queries with their SQL on a small table."""

import duckdb
import pytest

from pixelweft.operators import analysis, create, geometry, pointwise, stencil
from pixelweft.plans import catalogue, whole_sql

SCHEMA = "image_id int, x int, y int, band int, v double"
SF = "/root/testdata/sf0.001"


def image(spark, width, height, value):
    return spark.createDataFrame([(0, x, y, 0, float(value(x, y))) for y in range(height) for x in range(width)], SCHEMA)


def values(df):
    return [r.v for r in sorted(df.collect(), key=lambda r: (r.y, r.x))]


def test_histogram_of_two_levels(spark):
    hist = {r.bin: r.n for r in analysis.hist_find(image(spark, 10, 10, lambda x, y: 10 if y < 5 else 20)).collect()}
    assert (hist[10], hist[20], hist[30], len(hist)) == (50, 50, 0, 256)


def test_equalised_constant_is_white(spark):
    assert set(values(analysis.hist_equal(image(spark, 10, 10, lambda x, y: 10)))) == {255.0}


def test_indexed_sums_and_means(spark):
    index = image(spark, 4, 1, lambda x, y: (0, 0, 1, 1)[x])
    got = analysis.hist_find_indexed(image(spark, 4, 1, lambda x, y: (10, 20, 30, 40)[x]), index)
    assert [r.v for r in sorted(got.collect(), key=lambda r: r.bin)] == [30, 70]
    got = analysis.hist_find_indexed(image(spark, 4, 1, lambda x, y: (10, 30, 100, 200)[x]), index, reduction="mean")
    assert [r.v for r in sorted(got.collect(), key=lambda r: r.bin)] == [20, 150]


def test_hough_peak_of_a_line(spark):
    line = image(spark, 32, 32, lambda x, y: 255 if y == 15 else 0)
    votes = analysis.hough_line(line, width=180, height=200).collect()
    best = max(votes, key=lambda r: r.n)
    assert 88 <= best.theta <= 92 and best.n >= 30


def test_identities(spark):
    a = image(spark, 9, 7, lambda x, y: (x * 37 + y * 11) % 256)
    assert set(values(pointwise.boolean(a, a, op="xor"))) == {0.0}
    assert values(geometry.flip(geometry.flip(a))) == values(a)
    assert values(geometry.rotate90(geometry.rotate90(a, angle=90), angle=270)) == values(a)
    flat = image(spark, 6, 6, lambda x, y: 90)
    assert set(values(stencil.closing(stencil.opening(flat)))) == {90.0}
    assert set(values(stencil.sobel(flat))) == {0.0}


def test_rounding_rules(spark):
    a = image(spark, 3, 1, lambda x, y: (1, 3, 255)[x])
    assert values(pointwise.linear(a, a=(0.5,), b=(0.4,))) == [0.0, 1.0, 127.0]
    half = spark.createDataFrame([(0, i, 0, 0, v) for i, v in enumerate((0.5, 1.5, 2.5, 300.0))], SCHEMA)
    assert values(pointwise.cast_uchar(half)) == [0.0, 2.0, 2.0, 255.0]


def test_generators(spark):
    assert create.identity(spark=spark).count() == 256
    assert sorted(r.v for r in create.black(spark=spark, width=2, height=2, bands=1).collect()) == [0.0] * 4


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in ("embeddings", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


def test_midpoint_circles():
    """Worked out by hand: the error is 0 at first, and steps back in x once it is above 0."""
    assert set(analysis.circle_points(1)) == {(1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1)}
    assert len(analysis.circle_points(4)) == 24 and set(analysis.circle_points(4)) == {(i * a, j * b) for a, b in ((4, 0), (0, 4), (4, 1), (1, 4), (3, 2), (2, 3)) for i in (1, -1) for j in (1, -1)}


#: A tenth of the queries; all of them are compared by the driver.
SOME = [*sorted(catalogue.QUERIES)[::12], *whole_sql.SQL]


@pytest.mark.parametrize("name", SOME)
def test_parity(spark, duck, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    want = duck.execute(catalogue.oracle_sql()[name]).fetchdf()[list(got.columns)]
    keys = list(got.columns)
    got, want = (d.sort_values(keys).reset_index(drop=True) for d in (got, want))
    assert len(got) and len(got) == len(want)
    assert all(((got[k] == want[k]) | (got[k].isna() & want[k].isna())).all() for k in keys)


def test_every_query_has_sql_or_is_whole_image():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql()) | set(catalogue.WHOLE)
    assert len(set(catalogue.WHOLE) - set(catalogue.oracle_sql())) == 10
