"""Staged tables."""

from pixelweft.plans.staged import checkpointed


def test_estimates_do_not_grow_in_loops(spark):
    """A join's estimate is the product of its sides'."""
    now, bits = checkpointed(spark.range(50).selectExpr("id AS a")), []
    for _ in range(3):
        now = checkpointed(now.join(now, "a"))
        bits.append(now._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length())
    assert now.count() == 50 and bits == [63] * 3
