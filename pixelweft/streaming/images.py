"""Streams of pixels: running statistics and histograms, rows in order, and windows over event time (an extension).

A stream is read from a folder to which files are added; every function takes and returns streaming or batch DataFrames.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pixels(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files of pixels as they arrive."""
    return spark.readStream.schema("image_id int, x int, y int, band int, v double").option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def running_histogram(pixels: DataFrame) -> DataFrame:
    """(image_id, band, bin, n) so far; for update or complete mode."""
    return pixels.groupBy("image_id", "band", F.col("v").cast("long").alias("bin")).agg(F.count("*").alias("n"))


def running_stats(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id", "band").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation"), F.count("*").alias("n"))


def windowed(events: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count and sum of events(ts, event_type, value) by window; events later than `late` behind are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def in_order(strips: DataFrame) -> DataFrame:
    """strips(image_id, row, data) with each image's rows released from 0 on without gaps; later rows wait in the state."""
    def release(key, batches: Iterator, state):
        import pandas as pd

        due, waiting = state.get if state.exists else (0, [])
        held = {int(r): d for r, d in waiting} if waiting else {}
        for part in batches:
            held.update(zip(part["row"].astype(int), part["data"]))
        out = []
        while due in held:
            out.append((key[0], due, held.pop(due)))
            due += 1
        state.update((due, [(r, d) for r, d in held.items()]))
        yield pd.DataFrame(out, columns=["image_id", "row", "data"])

    return strips.groupBy("image_id").applyInPandasWithState(
        release, "image_id int, row int, data double", "due int, waiting array<struct<row:int,data:double>>", "append", "NoTimeout")
