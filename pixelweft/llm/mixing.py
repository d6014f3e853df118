"""Mixing of sources to target weights.

Every document of a source is emitted floor(rate) times, plus one more time with the fraction of the rate as
probability; that draw is seeded by a hash of the document, so reruns and retried tasks agree.
Only sums per source are shuffled, and they are combined before the shuffle, so a source with a third of all rows
costs one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, quoted, stage

WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column | str) -> Column:
    """Words of a text; null counts 0."""
    return F.coalesce(F.regexp_count(text if isinstance(text, Column) else F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sized: DataFrame, source: str = "source", size: str = "size", weights: Sequence[int] = (5, 2, 1),
    share: tuple[int, int] = (3, 2), most: int = 2,
) -> DataFrame:
    """(source, source_size, target, rate) per source, null being a source.

    Sources in code point order, null last, get `weights` in turn and share `share` (a fraction) of all sizes; a target
    stops at `most` times its source's size and the excess goes to the others by weight until none is above. That fixed
    point is found at once: with sources sorted by size/weight, those are capped whose cap is below their part of what
    the ones before them leave. One row per source reaches the single sorted window, never documents.
    A source without words has target 0 and rate 0.
    """
    num, den = share
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = (
        sized.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
        .withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long"))
    )
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = (
        ranked.withColumn("s_all", F.sum("source_size").over(everything)).withColumn("w_all", F.sum("w").over(everything))
        .withColumn("s_before", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("capped", (most * den * F.col("source_size")).cast("double") * (F.col("w_all") - F.col("w_before"))
                    <= F.col("w").cast("double") * (num * F.col("s_all") - most * den * F.col("s_before")))
    )
    level = left.withColumn("s_cap", F.coalesce(F.sum(F.when(F.col("capped"), F.col("source_size"))).over(everything), F.lit(0))) \
        .withColumn("w_cap", F.coalesce(F.sum(F.when(F.col("capped"), F.col("w"))).over(everything), F.lit(0)))
    target = F.when(F.col("capped"), (most * F.col("source_size")).cast("double")).otherwise(
        (F.col("w") * (num * F.col("s_all") - most * den * F.col("s_cap"))).cast("double") / (den * (F.col("w_all") - F.col("w_cap"))).cast("double"))
    return level.select("source", "source_size", target.alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))


def draw(doc_id: str = "doc_id", text: str = "text", seed: str = "") -> Column:
    """A number in [0, 1) fixed by the document: 52 bits of the md5 of its id, the seed and its text."""
    digest = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(f"{seed}:"), F.coalesce(F.col(text), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


#: Sources up to which their rates (some 50 bytes each) are sent to every executor; with more, documents are shuffled by source.
FEW_SOURCES = 200_000


def _counted(docs: DataFrame, names: list[str], seed: str, **targets) -> DataFrame:
    """docs with the size, source_size, target, rate and copies of each row, under these names."""
    size, source_size, target, rate, copies = names
    own, = free_names([*docs.columns, *names], "mix_source")
    rates = stage(source_targets(docs.select("source", word_count("text").alias("size")), **targets), "rates")
    few = rates.count() <= FEW_SOURCES
    rates = rates.toDF(own, source_size, target, rate)
    joined = docs.withColumn(size, word_count("text")).join(F.broadcast(rates) if few else rates, F.col("source").eqNullSafe(F.col(own)), "left").drop(own)
    whole = F.floor(F.col(rate))
    return joined.withColumn(copies, (whole + F.when(draw(seed=seed) < F.col(rate) - whole, 1).otherwise(0)).cast("int"))


def mix_counts(docs: DataFrame, seed: str = "", **targets) -> DataFrame:
    """docs with mix_size, source_size, target, rate and copies (how often the mix emits the row).

    Null or empty text has size 0. Rows of equal id and text are drawn alike. Columns of docs other than doc_id, text
    and source are carried along; those named like an added column are replaced.
    """
    names = ["mix_size", "source_size", "target", "rate", "copies"]
    return _counted(docs.drop(*names), names, seed, **targets)


def mix(docs: DataFrame, seed: str = "", **targets) -> DataFrame:
    """The mixed corpus: the rows of docs, each as often as the mix emits it, with the columns of docs, whatever their names."""
    names = [quoted(c) for c in docs.columns]
    *added, again = free_names(docs.columns, "mix_size", "mix_source_size", "mix_target", "mix_rate", "mix_copies", "mix_again")
    counted = _counted(docs, added, seed, **targets).where(F.col(added[-1]) > 0)
    return counted.select(*names, F.explode(F.sequence(F.lit(1), F.col(added[-1]))).alias(again)).select(*names)
