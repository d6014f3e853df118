"""Operators on tall and narrow images and on images of unequal heights, against the same plans in DuckDB."""

import duckdb
import numpy as np
import pytest

from pixelweft.operators import analysis, arrays, bands, effects, geometry, local, stencil
from pixelweft.plans.sqlop import SPARK
from pixelweft.sources import icc

SCHEMA = "image_id int, x int, y int, band int, v double"
RNG = np.random.default_rng(8)


def rows(shapes, of=1):
    return [(k, x, y, b, float(RNG.integers(0, 256))) for k, (h, w) in enumerate(shapes) for y in range(h) for x in range(w) for b in range(of)]


def both(spark, op, data, **how):
    """Sorted rows of an operator on Spark and in DuckDB."""
    con = duckdb.connect()
    con.register("px", spark.createDataFrame(data, SCHEMA).toPandas())
    con.sql("CREATE TABLE r AS SELECT CAST(image_id AS INT) AS image_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(band AS INT) AS band, v FROM px")
    form = lambda found: sorted(tuple(None if c is None else round(float(c), 6) for c in row) for row in found)
    return form(op(spark.createDataFrame(data, SCHEMA), **how).collect()), form(con.sql(op.sql("r", **how)).fetchall())


@pytest.mark.parametrize("op, how", [(stencil.box_blur, {"radius": 2}), (stencil.sharpen, {"sigma": 1.0}), (local.thinned, {})])
def test_edges_of_columns_in_strips(spark, op, how):
    assert "CURRENT ROW AND UNBOUNDED FOLLOWING" not in op.write(SPARK, "r", **how)  # looks at what follows for every row
    ours, theirs = both(spark, op, rows([(2 * stencil.STRIP + 3, 3), (stencil.STRIP, 2), (1, 1)]), **how)
    assert ours == theirs


def test_turned_meets_pixels_within_only(spark):
    data = rows([(90, 4), (31, 7)], of=3)
    for op, how in ((effects.rotate, {"degrees": 30.0}), (effects.polaroid, {})):
        ours, theirs = both(spark, op, data, **how)
        assert ours == theirs
        assert "WHERE NOT (rx" in op.write(SPARK, "r", **how)  # those outside are no rows of the join


@pytest.mark.parametrize("op, how", [(effects.rotate, {"degrees": 30.0}), (effects.polaroid, {"bands": 1})])
def test_turned_places_do_not_travel(spark, op, how):
    assert "VALUES (0, 0)" not in op.write(SPARK, "r", **how)  # the corners of places are no rows of a join
    found = op(spark.createDataFrame(rows([(700, 2)]), SCHEMA), **how).selectExpr("spark_partition_id() AS p", "band", "x", "y").collect()
    run, longest = 0, 0
    for a, b in zip(found, found[1:]):
        run = run + 1 if (a.p, a.band, a.x, a.y + 1) == (b.p, b.band, b.x, b.y) else 0
        longest = max(longest, run + 1)
    assert longest == effects.STRIP and max(r.y for r in found) > 2 * effects.STRIP  # y starts anew, so that files of it stay small


@pytest.mark.parametrize("op, how", [(effects.rotate, {"degrees": 30.0}), (effects.rotate, {"degrees": -200.5}), (effects.polaroid, {}), (effects.polaroid, {"angle": 117.0, "bands": 4})])
def test_turned_with_gaps_and_doubles(spark, op, how):
    data = [r for r in rows([(70, 40), (33, 65), (1, 5), (2, 2)], of=4) if RNG.random() > (0.1 if r[0] == 0 else 0)]
    ours, theirs = both(spark, op, data + data[::37], **how)
    assert ours == theirs


@pytest.mark.parametrize("shapes", [[(90, 4), (31, 27)], [(40, 60)]])
def test_deskew_makes_what_is_kept(spark, shapes):
    data = rows(shapes)
    skews = "(SELECT image_id, CAST(CASE WHEN image_id = 0 THEN 4 ELSE -3.5 END AS DOUBLE) AS degrees FROM {} GROUP BY image_id)"
    con = duckdb.connect()
    con.register("px", spark.createDataFrame(data, SCHEMA).toPandas())
    theirs = sorted(tuple(round(float(c), 6) for c in row) for row in con.sql(effects.deskew.sql("px", skews.format("px"))).fetchall())
    frame = spark.createDataFrame(data, SCHEMA)
    ours = sorted(tuple(round(float(c), 6) for c in row) for row in effects.deskew(frame, spark.sql("SELECT * FROM " + skews.format("{t}"), t=frame)).collect())
    assert ours == theirs
    assert "l + i AS ox" in effects.deskew.write(SPARK, "r", "k")


def test_images_too_narrow_for_whole_blocks(spark):
    data = rows([(400, 5), (20, 20)])
    found = geometry.thumbnail(spark.createDataFrame(data, SCHEMA)).toPandas()
    theirs = both(spark, geometry.thumbnail, [r for r in data if r[0] == 1])[1]
    assert sorted(map(tuple, found[found.image_id == 1].to_numpy().tolist())) == theirs
    column = np.array([r[4] for r in data if r[0] == 0]).reshape(10, 40 * 5)  # ten blocks of all its width
    narrow = found[found.image_id == 0].sort_values("y")
    assert narrow.x.tolist() == [0] * 10 and narrow.v.tolist() == np.floor(column.mean(1)).tolist()
    page = effects.analysis_copy(spark.createDataFrame(rows([(700, 3)], of=3), SCHEMA), most=100)
    assert page.count() == 100 and analysis.detect_upright(page).count() == 1


def test_rank_of_images_of_unequal_heights(spark):
    ours, theirs = both(spark, bands.bandrank, [r for r in rows([(4, 2), (4, 2), (3, 2), (3, 2), (3, 2)])])
    assert [r[:4] for r in ours] == [r[:4] for r in theirs] and [r[4] for r in ours] == [r[4] for r in theirs]
    assert sum(r[4] is None for r in ours) == 2  # two images have no middle one of five


def test_phase_correlation_of_unequal_images(spark):
    a, b = RNG.integers(0, 256, (9, 6)).astype(float), RNG.integers(0, 256, (8, 7)).astype(float)
    frame = lambda m: spark.createDataFrame([(0, x, y, 0, float(m[y, x])) for y in range(m.shape[0]) for x in range(m.shape[1])], SCHEMA)
    found = arrays.phasecor(frame(a), frame(b)).toPandas()
    f = np.fft.fft2(np.pad(a, ((0, 0), (0, 1)))) * np.conj(np.fft.fft2(np.pad(b, ((0, 1), (0, 0)))))
    want = np.fft.ifft2(f / np.abs(f)).real
    assert np.allclose(found.v, want[found.y, found.x]) and len(found) == 63


def test_detect_upright_of_a_narrow_page(spark):
    ours, theirs = both(spark, analysis.detect_upright, rows([(30, 3)]))
    assert ours == theirs


def test_halves_of_a_profile_are_rounded_up():
    lut = icc.Lut(np.tile([0.0, 1.0], (3, 1)), np.eye(3), 2, np.full((8, 3), 0.3), np.tile([0.0, 1.0], (3, 1)))
    profile = icc.serialize(icc.Profile("RGB ", "Lab ", tags={"A2B0": icc.lut_tag(lut)}))
    assert (np.array(icc.parse(profile).lut("A2B0").colours) * 65535 == 19661).all()
