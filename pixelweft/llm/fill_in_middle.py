"""Fill-in-the-middle rearrangement of texts, and its inverse, in column functions only.

A text is cut into units (a pattern's matches, left to right; by default code points). Four numbers from a sha2 of a seed and
the document's id give two cuts and the form: psm is `<P>`prefix`<S>`suffix`<M>`middle, spm is `<S>`suffix`<P>`prefix`<M>`middle,
plain is the text itself. Texts that hold a sentinel stay plain, so a rearranged text holds each sentinel once and the parts are
found again by them alone. No row meets another: nothing is shuffled, and a retried task gives the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, quoted

SENTINELS = ("<P>", "<S>", "<M>")
#: One code point, line ends too.
CODE_POINT = r"(?s)."


def draws(doc_id: Column, seed: str = "1") -> list[Column]:
    """Four numbers of 32 bits: the first 8-digit groups of the sha256 of the seed, a colon and the id in decimal (null: nothing)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def rearrange(
    docs: DataFrame, unit: str = CODE_POINT, seed: str = "1", rate: int = 90, spm: int = 20, sentinels: Sequence[str] = SENTINELS,
) -> DataFrame:
    """docs with fim_units, fim_form, fim_prefix, fim_middle, fim_suffix and fim_text; columns of these names are replaced, others stay.

    rate and spm are percentages: of texts that are rearranged, and of these in spm form. The units must cover the text, as
    code points do: what a pattern leaves out is not in the result. Parts are null in plain form. Null text counts as empty,
    and empty text is plain. Rows of one id are cut by the same draws; repeated rows give repeated rows; an empty table an
    empty one.
    """
    added = ["fim_units", "fim_form", "fim_prefix", "fim_middle", "fim_suffix", "fim_text"]
    docs = docs.drop(*added)
    names = [quoted(c) for c in docs.columns]
    text, units, h, low, high, n = free_names([*docs.columns, *added], "fim_whole", "fim_array", "fim_draws", "fim_low", "fim_high", "fim_n")
    cut = docs.select("*", F.coalesce(F.col("text"), F.lit("")).alias(text), F.array(*draws(F.col("doc_id"), seed)).alias(h))
    cut = cut.withColumn(units, F.regexp_extract_all(text, F.lit(unit), 0)).withColumn(n, F.size(units).cast("long"))
    first, second = (F.col(h)[k] % (F.col(n) + 1) for k in (0, 1))
    marked = F.lit(False)
    for s in sentinels:
        marked = marked | F.contains(text, F.lit(s))
    plain = (F.col(text) == "") | marked | (F.col(h)[2] % 100 >= rate)
    cut = cut.withColumns({
        low: F.least(first, second).cast("int"), high: F.greatest(first, second).cast("int"),
        "fim_form": F.when(plain, "plain").when(F.col(h)[3] % 100 < spm, "spm").otherwise("psm"),
    })

    def part(start, length):
        return F.when(F.col("fim_form") != "plain", F.array_join(F.slice(units, start + 1, length), ""))

    cut = cut.withColumns({
        "fim_prefix": part(F.lit(0), F.col(low)), "fim_middle": part(F.col(low), F.col(high) - F.col(low)),
        "fim_suffix": part(F.col(high), F.col(n).cast("int") - F.col(high)),
    })
    p, s, m = map(F.lit, sentinels)
    out = (F.when(F.col("fim_form") == "psm", F.concat(p, "fim_prefix", s, "fim_suffix", m, "fim_middle"))
           .when(F.col("fim_form") == "spm", F.concat(s, "fim_suffix", p, "fim_prefix", m, "fim_middle")).otherwise(F.col(text)))
    return cut.select(*names, F.col(n).alias("fim_units"), "fim_form", "fim_prefix", "fim_middle", "fim_suffix", out.alias("fim_text"))


def restored(text: Column | str, form: Column | str, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text that was rearranged, from the output and its form: the parts lie between the sentinels."""
    text, form = (F.col(c) if isinstance(c, str) else c for c in (text, form))
    p, s, m = map(F.lit, sentinels)

    def between(before: Column, after: Column) -> Column:
        return F.split_part(F.split_part(text, before, F.lit(2)), after, F.lit(1))

    middle = F.split_part(text, m, F.lit(2))
    return (F.when(form == "psm", F.concat(between(p, s), middle, between(s, m)))
            .when(form == "spm", F.concat(between(p, m), middle, between(s, p))).otherwise(text))
