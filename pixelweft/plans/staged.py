"""Cutting the lineage of tables that loops and reused subplans build on."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the folder of spark.checkpoint.dir and read from there; unset, to a temporary one, in a local session only.

    `DataFrame.checkpoint` hands the plan's estimate of its size on, and a join's estimate is the product of its sides', so that in a loop
    the number's length grows by a factor each round. What is returned has no estimate: sizes are known when it has been shuffled.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="pixelweft-")
        context.setCheckpointDir(root)
    kept = df.checkpoint()._jdf
    return DataFrame(spark._jsparkSession.createDataFrame(kept.toJavaRDD(), kept.schema()), spark)
