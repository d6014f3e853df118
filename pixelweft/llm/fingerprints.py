"""I-Match document fingerprints, in DataFrame operations only.

The lexicon is the set of terms whose document frequency lies in a band (of distinct texts): rarer terms are typing errors and names, commoner
ones say nothing. A fingerprint hashes the sorted distinct lexicon terms of a document, and those of several randomised
subsets of the lexicon, each of a fixed part of it: a small edit changes the hash of the whole, but leaves those subsets
as they were of which it touches no term. Parts from 1/16 to 1/1024 serve short and long documents.

The lexicon can't outgrow a bound: the document frequencies of all terms sum to the number of (document, term) pairs, so
no more than (distinct terms per document) / (least share) terms have at least the least share of the documents. It is
held once per task as a hash table in an uncorrelated scalar subquery; texts never meet it in a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Parts of the lexicon: (denominator, how many subsets of it).
SUBSETS = ((1, 1), (16, 4), (64, 8), (256, 8), (1024, 8))
#: Slots of the lexicon's hash table.
SLOTS = 1 << 16
LEAST_SHARE, MOST_SHARE = 3e-4, 0.1


def terms(text: Column) -> Column:
    """Hashes of the distinct terms (runs of letters and digits, lower case) of a text; null is empty."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, least_share: float = LEAST_SHARE, most_share: float = MOST_SHARE) -> DataFrame:
    """(term, df): hashes of the terms that at least max(1, least_share) and at most most_share of all distinct texts have.

    Copies count once, or a large group of them would take its own terms out of the band.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    distinct = docs.groupBy(F.xxhash64(text).alias("hash")).agg(F.min(text).alias("text"))
    counted = distinct.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = docs.select(F.xxhash64(text).alias("hash")).distinct().agg(F.count("*").alias("n"))
    return counted.crossJoin(F.broadcast(n)).where(
        (F.col("df") >= F.col("n") * least_share) & (F.col("df") <= F.greatest(F.lit(2.0), F.col("n") * most_share))).select("term", "df")


def _slot(h: Column) -> Column:
    return F.pmod(h, F.lit(SLOTS)).cast("int")


def lexicon_table(lex: DataFrame) -> DataFrame:
    """One row: the lexicon as an array of SLOTS arrays."""
    empty = F.array().cast("array<bigint>")
    filled = lex.groupBy(_slot(F.col("term")).alias("slot")).agg(F.collect_list("term").alias("terms"))
    every = lex.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("slot")).join(filled, "slot", "left")
    rows = F.array_sort(F.collect_list(F.struct("slot", F.coalesce("terms", empty).alias("terms"))))
    return every.agg(F.transform(rows, lambda r: r["terms"]).alias("table"))


def with_fingerprint(df: DataFrame, table: DataFrame, text: str, name: str) -> DataFrame:
    """df with `name`, an array of one 32-bit hash per subset, 0 where a text has none of its terms.

    A text with no lexicon term at all has the hash of its lower-case text in the place of the first.
    """
    kept = f"__{name}_terms"
    # The subquery stands inside the lambda: as a column below it, the table would be copied for every row.
    conf, key = df.sparkSession.conf, "spark.sql.analyzer.allowSubqueryExpressionsInLambdasOrHigherOrderFunctions"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        df = df.withColumn(kept, F.array_sort(F.filter(
            terms(F.col(text)), lambda h: F.array_contains(F.get(table.scalar(), _slot(h)), h))))
    finally:
        conf.set(key, before) if before is not None else conf.unset(key)

    def subset(part: int, k: int) -> Column:
        return F.filter(F.col(kept), lambda h: F.xxhash64(h, F.lit(1000 * part + k)).bitwiseAND(part - 1) == 0)

    hashes = []
    for part, n in SUBSETS:
        for k in range(n):
            chosen = F.col(kept) if part == 1 else subset(part, k)
            low = F.xxhash64(chosen).bitwiseAND(0xFFFFFFFF)
            hashes.append(F.when(F.size(chosen) > 0, low).otherwise(F.lit(0)))
    alone = F.xxhash64(F.lower(F.coalesce(F.col(text), F.lit("")))).bitwiseAND(0xFFFFFFFF)
    hashes[0] = F.when(F.size(kept) == 0, alone).otherwise(hashes[0])
    return df.withColumn(name, F.array(*hashes)).drop(kept)


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the places where one of them has any; of equal first hashes, 1."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    used = F.size(F.filter(pairs, lambda p: (p["a"] != 0) | (p["b"] != 0)))
    same = F.size(F.filter(pairs, lambda p: (p["a"] != 0) & (p["a"] == p["b"])))
    return F.coalesce(F.when(F.get(a, 0) == F.get(b, 0), F.lit(1.0)).otherwise(same / used), F.lit(0.0))


#: Documents whose ids fall in one stretch of so many are put in order by one task; null ids are the last stretch.
STRETCH, LAST = 1024, 1 << 62
#: First documents of stretches up to which a join with them is a broadcast (16 bytes each).
FEW_FIRSTS = 1_000_000


def _stretch() -> Column:
    return F.coalesce(F.floor(F.col("doc_id") / STRETCH), F.lit(LAST))


def followers(docs: DataFrame) -> DataFrame:
    """(before, first): for each stretch of ids the smallest id of the next one that has documents; the first follows the last.

    Stretches are sorted in ranges, as many as there are shuffle partitions; only the first stretch of each range is sorted
    in one task. That holds for scattered ids too, of which each has a stretch of its own.
    """
    firsts = docs.groupBy(_stretch().alias("stretch")).agg(F.min("doc_id").alias("first"))
    ranges = stage(firsts.repartitionByRange("stretch").withColumn("range", F.spark_partition_id()), "firsts")  # the ranges hold once written
    heads = ranges.groupBy("range").agg(F.min(F.struct("stretch", "first")).alias("head"))
    order = Window.orderBy("range")
    heads = heads.select(F.col("range").alias("r"), F.coalesce(F.lead("head").over(order), F.first("head").over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    inner = F.lead(F.struct("stretch", "first")).over(Window.partitionBy("range").orderBy("stretch"))
    return ranges.withColumn("inner", inner).join(F.broadcast(heads), F.col("range") == F.col("r")).select(
        F.col("stretch").alias("before"), F.coalesce("inner", "after").getField("first").alias("first"))


def with_next(docs: DataFrame, table: DataFrame) -> DataFrame:
    """docs(doc_id, text, fp) with next_text and next_fp of the following row: ascending doc_id, nulls last, ties by text; the
    first row follows the last.

    Rows are hashed by stretch of ids, so each text is shuffled once; of each stretch the first row is fetched for the last
    row of the one before.
    """
    plain = docs.select("doc_id", "text")
    follow = stage(followers(plain), "followers")
    few = F.broadcast(follow) if follow.count() <= FEW_FIRSTS else follow
    heads = plain.join(few, F.col("doc_id").eqNullSafe(F.col("first"))).groupBy("before").agg(F.min("text").alias("head_text"))
    heads = stage(with_fingerprint(heads, table, "head_text", "head_fp"), "heads")
    within = Window.partitionBy("stretch").orderBy(F.col("doc_id").asc_nulls_last(), "text")
    placed = docs.withColumn("stretch", _stretch()).select(
        "*", F.lead("text").over(within).alias("next_text"), F.lead("fp").over(within).alias("next_fp"), F.lead(F.lit(True)).over(within).alias("inside"))
    joined = placed.join(heads, F.col("stretch") == F.col("before"), "left")
    return joined.select("doc_id", "text", "fp", F.when(F.col("inside"), F.col("next_text")).otherwise(F.col("head_text")).alias("next_text"),
                         F.when(F.col("inside"), F.col("next_fp")).otherwise(F.col("head_fp")).alias("next_fp"))


def edited_fingerprints(docs: DataFrame, least_share: float = LEAST_SHARE, most_share: float = MOST_SHARE) -> DataFrame:
    """Per row of docs(doc_id, text): n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null text is empty. The edited text has its last quarter of code points replaced by as many, or all, of the first of
    the next document's in ascending doc_id (null ids last, equal ids by text); after the last comes the first, so a
    single document is its own next one. Equal texts have equal fingerprints.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    table = lexicon_table(stage(lexicon(docs, least_share, most_share), "lexicon"))
    own = with_fingerprint(docs, table, "text", "fp")
    paired = with_next(own, table)
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    done = with_fingerprint(paired.withColumn("edited", edited), table, "edited", "edited_fp")
    return done.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
