"""Quality by hierarchical empirical Bayes.

A logistic classifier of the text alone gives each document its evidence: the log odds of good quality, less those of the
labelled sample. Sites and paths within them have a share of good documents. Their posteriors come from grouped sums: a
path's mean is shrunk toward its host's and a host's toward the global one, by pseudo-counts that the method of moments
finds from how much hosts (and paths within hosts) differ beyond chance, so that sparse sites stay near the prior. A
document's own contribution is taken out of its path and host before it is judged by them. Its quality is the logistic
function of its evidence plus the log odds of its path.

The fit uses at most `per_class` labelled documents of each class, those whose ids hash lowest; everything else covers all
rows. Only sums per path are shuffled, which tasks combine first.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

FEATURES = ("words", "distinct", "upper", "signs", "digits", "word_length", "lines")


def features(text: Column) -> dict[str, Column]:
    """Measures of a whole text; null counts as empty. A text without words has zeros."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, k = F.greatest(F.length(text), F.lit(1)).cast("double"), F.size(words).cast("double")
    some = F.greatest(k, F.lit(1.0))
    return {
        "words": F.log1p(k) / 10, "distinct": F.size(F.array_distinct(words)) / some,
        "upper": F.regexp_count(text, F.lit(r"\p{Lu}")) / n, "signs": F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s.,]")) / n,
        "digits": F.regexp_count(text, F.lit(r"\p{N}")) / n, "word_length": F.length(text) / some / 10,
        "lines": F.regexp_count(text, F.lit("\n")) / some,
    }


def _terms(f: list) -> list:
    """The measures, their squares and products."""
    return [*f, *[a * b for i, a in enumerate(f) for b in f[i:]]]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Newton's method; weights of 1 and the columns of x, in the scale of x."""
    if not len(y) or y.min() == y.max():
        w = np.zeros(x.shape[1] + 1)
        w[0] = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return w
    mean, sd = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack((np.ones(len(x)), (x - mean) / sd))
    w = np.zeros(z.shape[1])
    penalty = ridge * np.diag([0.0] + [1.0] * x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(len(w)), z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return np.concatenate(([w[0] - (w[1:] * mean / sd).sum()], w[1:] / sd))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 4000) -> tuple[np.ndarray, float]:
    """(weights, log odds of the sample) from docs(doc_id, text) and labels(doc_id, quality 0 or 1); null labels don't count."""
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # Of each class the per_class smallest hashes, kept task by task and then of all: no task gets a whole class.
    of_class = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for q in (0, 1)]
    chosen = of_class[0].unionByName(of_class[1])
    measured = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", F.struct(*[c.alias(n) for n, c in features(F.col("text")).items()]).alias("f"))
    rows = measured.groupBy("doc_id", "quality").agg(F.min("f").alias("f")).select("quality", "f.*")  # of rows of one id, one
    rows = sorted(map(tuple, rows.collect()))  # at most two classes of per_class rows
    x = np.array([r[1:] for r in rows], float).reshape(len(rows), len(FEATURES))
    y = np.array([r[0] for r in rows], float)
    x = np.column_stack(_terms(list(x.T))) if len(rows) else np.zeros((0, len(_terms([0] * len(FEATURES)))))
    good = (y.sum() + 1) / (len(y) + 2)
    return fit_logistic(x, y), float(np.log(good / (1 - good)))


def evidence(model: tuple[np.ndarray, float]) -> Column:
    """Log odds by the text alone, without the sample's own, between -12 and 12; of the columns that FEATURES names."""
    weights, base = model
    terms = _terms([F.col(n) for n in FEATURES])
    total = F.lit(float(weights[0] - base))
    for w, t in zip(weights[1:], terms):
        total = total + F.lit(float(w)) * t
    return F.greatest(F.lit(-12.0), F.least(F.lit(12.0), total))


def _logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _log_odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def posteriors(scored: DataFrame) -> DataFrame:
    """scored(host, path, p, ...), p being a document's probability of good quality by itself, with host_mean and path_mean.

    Null hosts are one host, null paths one path of theirs. Pseudo-counts are between 1 and 10^6.
    """
    paths = stage(scored.groupBy("host", "path").agg(F.count("*").alias("n_path"), F.sum("p").alias("s_path")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n_path").alias("n_host"), F.sum("s_path").alias("s_host"))

    def strength(n: str, s: str, prior: Column) -> Column:
        """Pseudo-count: prior * (1 - prior) over the variance of group means that sampling does not explain, less 1."""
        mean = F.col(s) / F.col(n)
        chance = F.sum(prior * (1 - prior))
        beyond = (F.sum(F.col(n) * (mean - prior) * (mean - prior)) - chance) / F.greatest(F.sum(n), F.lit(1))
        spread = F.sum(F.col(n) * prior * (1 - prior)) / F.greatest(F.sum(n), F.lit(1))
        return F.greatest(F.lit(1.0), F.least(F.lit(1e6), F.when(beyond > 1e-12, spread / beyond - 1).otherwise(1e6)))

    total = paths.agg((F.coalesce(F.sum("s_path"), F.lit(0.0)) + 1).alias("s_all"), (F.coalesce(F.sum("n_path"), F.lit(0)) + 2).alias("n_all"))
    mu = F.col("s_all") / F.col("n_all")
    of_hosts = hosts.crossJoin(F.broadcast(total)).agg(strength("n_host", "s_host", mu).alias("k_host"))
    with_host = paths.join(hosts.withColumnRenamed("host", "__h"), F.col("host").eqNullSafe(F.col("__h"))).drop("__h")
    of_paths = with_host.crossJoin(F.broadcast(total)).withColumn("prior", (F.col("s_host") + mu) / (F.col("n_host") + 1)) \
        .agg(strength("n_path", "s_path", F.col("prior")).alias("k_path"))
    known = with_host.withColumnsRenamed({"host": "__host", "path": "__path"})
    joined = scored.join(known, F.col("host").eqNullSafe(F.col("__host")) & F.col("path").eqNullSafe(F.col("__path")))
    one_row = F.broadcast(total.crossJoin(of_hosts).crossJoin(of_paths))
    host_mean = (F.col("s_host") - F.col("p") + F.col("k_host") * mu) / (F.col("n_host") - 1 + F.col("k_host"))
    path_mean = (F.col("s_path") - F.col("p") + F.col("k_path") * F.col("host_mean")) / (F.col("n_path") - 1 + F.col("k_path"))
    bounded = lambda c: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), c))
    return joined.crossJoin(one_row).withColumn("host_mean", bounded(host_mean)).withColumn("path_mean", bounded(path_mean)) \
        .select(*scored.columns, "host_mean", "path_mean")


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, least: float = 0.5, per_class: int = 4000) -> DataFrame:
    """doc_id, evidence (log odds), host_mean, path_mean, quality (0 to 1) and keep (quality >= least) per row of docs.

    host and path default to the document's source and its language within it. Null text is judged as empty text; null hosts
    are one host, null paths one path of theirs. Repeated rows are judged alike and count as often as they are there; of rows
    of one labelled id one is fitted. An empty table gives an empty result; without labels of both classes the evidence is the
    same for all.
    """
    model = fit(docs, labels, per_class)
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    base = float(model[1])
    measured = docs.select("doc_id", host.cast("string").alias("host"), path.cast("string").alias("path"), *[c.alias(n) for n, c in features(F.col("text")).items()])
    scored = stage(measured.select("doc_id", "host", "path", evidence(model).alias("evidence"))
                   .withColumn("p", _logistic(F.col("evidence") + base)), "scored")
    judged = posteriors(scored).withColumn("quality", _logistic(F.col("evidence") + _log_odds(F.col("path_mean"))))
    return judged.select("doc_id", "evidence", "host_mean", "path_mean", "quality", (F.col("quality") >= least).alias("keep"))
