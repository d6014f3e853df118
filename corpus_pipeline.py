"""The corpus pipeline: documents in, packed token sequences out.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweft.llm import jaccard_join, language_id, line_dedup, mixing, packing
from pixelweft.llm.common import stage
from pixelweft.llm.tokens import default_vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; those without letters or unlike all of these go.

    Null and empty texts have no letters and go; rows of null lang or doc_id are judged and teach nothing; repeated rows are
    judged alike. An empty table stays empty, and with nothing to learn from none is kept.
    """
    return language_id.keep_known(docs)


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are near copies of earlier ones go, and documents of which nothing else remains; n_chars follows the text.

    Null and empty texts lose no line and stay, as do rows of null doc_id; rows of one doc_id count as one document.
    """
    done = line_dedup.dedup_lines(docs, least_exact=1)
    left = done.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def unique_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest doc_id.

    Texts without words link with nothing and stay, as do rows of null doc_id; of rows of one doc_id that stays, one does.
    """
    return jaccard_join.drop_near_duplicates(docs, part_bytes=8 << 20)  # executors hold what the stages before left them


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for; a null source is a source, a null text has no words and weighs nothing."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their places in sequences of 4096; a null text is empty, one piece of the end token. No documents give no pieces."""
    return packing.pack(packing.token_pieces(docs, default_vocabulary()))


STAGES = [
    ("language ID", known_language),
    ("line dedup", unique_lines),
    ("n-gram Jaccard join", unique_documents),
    ("source mix", source_mix),
    ("best-fit packing", packed),
]

#: None: no SQL for kernels, edit similarity and vocabularies; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, f"pipeline-{k}")
    return docs
