"""The queries opN_<name>, each its operator with production parameters over a whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, embedding_dedup, fill_in_middle, fingerprints, jaccard_join, language_id, line_dedup, maxent, mixing, packing, quality, token_counts, token_output
from .tokens import default_vocabulary


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text without repeated lines, and how many lines it had and lost."""
    done = line_dedup.dedup_lines(_read(spark, sf_dir, "documents"), least_exact=1)
    return done.select("doc_id", "n_lines", "n_dropped", "text")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document before and after three edits: a new beginning, a replaced third, a deletion."""
    vocabulary = default_vocabulary()
    trees = token_counts.build_trees(_read(spark, sf_dir, "documents"), vocabulary)
    n = F.length("text")
    third, half = F.floor(n / 3).cast("int"), F.floor(n / 2).cast("int")

    def edit(start, stop, replacement):
        return F.struct(start.alias("start"), stop.alias("stop"), F.lit(replacement).alias("replacement"))

    edits = F.array(edit(third, third + 25, "an edited passage, rewritten"), edit(half, half + 7, ""), edit(F.lit(0), F.lit(0), "New beginning. "))
    return token_counts.apply_edits(trees, edits, vocabulary)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_read(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_read(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_read(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_output.write_tokens(_read(spark, sf_dir, "documents"), default_vocabulary())
    return token_output.read_tokens(manifest)


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_counts(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), "source_size", "target", (F.col("mix_size") * F.col("copies")).alias("taken"))


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, text, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), ranked AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM sized GROUP BY source
), sums AS (
  SELECT *, sum(s) OVER () AS sa, sum(w) OVER () AS wa,
    coalesce(sum(s) OVER o, 0) AS sb, coalesce(sum(w) OVER o, 0) AS wb
  FROM ranked WINDOW o AS (ORDER BY s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), capped AS (SELECT *, CAST(4 * s AS DOUBLE) * (wa - wb) <= CAST(w AS DOUBLE) * (3 * sa - 4 * sb) AS c FROM sums),
level AS (
  SELECT source, s, w, c, sa, wa, coalesce(sum(CASE WHEN c THEN s END) OVER (), 0) AS sc, coalesce(sum(CASE WHEN c THEN w END) OVER (), 0) AS wc FROM capped
), rates AS (
  SELECT *, CASE WHEN s > 0 THEN target / s ELSE 0 END AS rate FROM (
    SELECT source, s, CASE WHEN c THEN CAST(2 * s AS DOUBLE) ELSE CAST(w * (3 * sa - 4 * sc) AS DOUBLE) / CAST(2 * (wa - wc) AS DOUBLE) END AS target FROM level)
)
SELECT d.doc_id, d.size, r.s AS source_size, r.target,
  d.size * (CAST(floor(r.rate) AS BIGINT) + CASE WHEN CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || coalesce(d.text, '')), 1, 13) AS BIGINT) / 4503599627370496.0 < r.rate - floor(r.rate) THEN 1 ELSE 0 END) AS taken
FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
"""


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(_read(spark, sf_dir, "documents"), default_vocabulary()))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_read(spark, sf_dir, "embeddings"))


def _op11_sql(k: int = 40, rounds: int = 5) -> str:
    """One vector's component a row; the rounds follow each other as tables."""
    start = f"""
WITH vectors AS (
  SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NOT NULL AND isfinite(CAST(x AS DOUBLE))]) = 64
), v AS (
  SELECT r, d, CAST(floor(256 * CAST(embedding[d] AS DOUBLE)) AS BIGINT) AS x FROM vectors, (SELECT unnest(range(1, 65)) AS d)
), seeds AS (SELECT r, row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR))) - 1 AS c FROM vectors QUALIFY c < {k}),
c0 AS (SELECT c, d, x FROM seeds JOIN v USING (r))"""
    steps = [f"""
a{n} AS (
  SELECT r, c, s FROM (SELECT v.r, m.c, sum((v.x - m.x) * (v.x - m.x)) AS s FROM v JOIN c{n} m USING (d) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY s, c) = 1
)""" + (f""",
n{n} AS (SELECT a.c, v.d, sum(v.x) AS s, count(*) AS n FROM a{n} a JOIN v USING (r) GROUP BY ALL),
c{n + 1} AS (SELECT c, d, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{n} LEFT JOIN n{n} USING (c, d))""" if n < rounds else "") for n in range(rounds + 1)]
    return start + "," + ",".join(steps) + f"""
SELECT w.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.s AS BIGINT) AS distance, CAST(sum(a.s) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.s) OVER () AS BIGINT) AS inertia, h.centroid_sha256
FROM a{rounds} a JOIN vectors w USING (r) JOIN (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY c) h USING (c)
"""


def op12_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(_read(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's rearranged text and of what is rebuilt from it."""
    done = fill_in_middle.rearrange(_read(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", F.col("fim_units").alias("n"), F.col("fim_form").alias("form"), F.length("fim_prefix").cast("long").alias("prefix_chars"), F.length("fim_middle").cast("long").alias("middle_chars"),
        F.sha2("fim_text", 256).alias("output_sha256"), F.sha2(fill_in_middle.restored("fim_text", "fim_form"), 256).alias("restored_sha256"))


OP13_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents
), drawn AS (
  SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (length(t) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (length(t) + 1) AS b,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS h4 FROM d
), cut AS (
  SELECT doc_id, t, n, CASE WHEN n = 0 OR h3 >= 90 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form,
    substr(t, 1, least(a, b)) AS p, substr(t, least(a, b) + 1, greatest(a, b) - least(a, b)) AS m, substr(t, greatest(a, b) + 1) AS s FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM cut
"""

QUERIES = {f.__name__: f for f in (op1_embedding_dedup, op2_line_dedup, op3_token_counts, op4_jaccard_join, op5_language_id, op6_fingerprints, op7_token_files, op8_source_mix, op9_packing, op10_quality, op11_centroids, op12_lm_score, op13_fill_in_middle)}
ORACLE_SQL = {"op8_source_mix": OP8_SQL, "op11_centroids": _op11_sql(), "op13_fill_in_middle": OP13_SQL}
