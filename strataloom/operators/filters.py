"""Row filters and first-wins deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions.text import squeeze, strip


def long_enough(text: Column, min_chars: int = 200) -> Column:
    return F.length(strip(F.coalesce(text, F.lit("")))) >= min_chars


def in_language(lang: Column, wanted: str | None = "en") -> Column:
    """Null passes; without a wanted language everything does."""
    return F.lit(True) if not wanted else lang.isNull() | (lang == wanted)


def sure_of_language(score: Column, least: float = 0.5) -> Column:
    """A missing score and one of exactly 0 count as 1."""
    return F.coalesce(F.nullif(score.cast("double"), F.lit(0.0)), F.lit(1.0)) >= least


def stream_filter(docs: DataFrame, min_chars: int = 200, lang: str | None = "en", text_col: str = "text", lang_col: str = "lang", score_col: str | None = None) -> DataFrame:
    score = F.col(score_col) if score_col else F.lit(None).cast("double")
    return docs.where(long_enough(F.col(text_col), min_chars) & in_language(F.col(lang_col), lang) & sure_of_language(score))


def usable_pair(instruction: Column, output: Column, max_output: int = 2000, max_instruction: int | None = None) -> Column:
    ok = (squeeze(instruction) != "") & (squeeze(output) != "") & (F.length(squeeze(output)) <= max_output)
    return ok if max_instruction is None else ok & (F.length(squeeze(instruction)) <= max_instruction)


def first_of_equal(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row in order of each key. Keys and orders are grouped alone - the smallest order of a key is found by partial aggregation,
    so a key with most rows costs no task more. Then rows meet their key's first order, in the one shuffle that they go through: of rows that share key and order one stays, chosen where they met.
    Null is a key like any other; a null order comes after all others. key is computed in both passes: what is dear is to be written before."""
    known = lambda c: F.coalesce(F.concat(F.lit("is "), c.cast("string")), F.lit("null"))  # noqa: E731  never null, so no filter makes it once more
    rows = df.withColumn("__key", known(key))
    first = rows.groupBy("__key").agg(known(F.min(order)).alias("__order"))
    kept = rows.withColumn("__order", known(F.col(order))).join(first, ["__key", "__order"], "left_semi")
    return kept.dropDuplicates(["__key", "__order"]).select(*df.columns)


def exact_dedup(docs: DataFrame, order: str = "doc_id", text: Column | None = None) -> DataFrame:
    """The first document of each distinct text (by SHA-256)."""
    return first_of_equal(docs, F.sha2(F.col("text") if text is None else text, 256), order)


def dedup_counters(docs: DataFrame, min_chars: int = 20, text_col: str = "text") -> DataFrame:
    """docs_kept, duplicates_removed, too_short_removed, total_chars. What is too short is never a duplicate; a null text is an empty one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(F.sha2(text, 256).alias("h"), F.length(text).alias("n"))
    short = F.col("n") < min_chars
    groups = sized.groupBy("h", "n").agg(F.count(F.lit(1)).alias("c"))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return groups.agg(
        total(F.when(short, 0).otherwise(1)).alias("docs_kept"),
        total(F.when(short, 0).otherwise(F.col("c") - 1)).alias("duplicates_removed"),
        total(F.when(short, F.col("c")).otherwise(0)).alias("too_short_removed"),
        total(F.when(short, 0).otherwise(F.col("n"))).alias("total_chars"),
    )
