"""Pre-tokens: what a byte-level BPE merges within."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: contractions; letters; digits; anything but backslash, s and those; white space. The last two are never reached, as white space belongs
# to the class before; a backslash belongs to none and is left out.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\\sA-Za-z0-9]+|\s+(?!\S)|\s+"


def pretokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PRETOKEN), F.lit(0))


def pretoken_counts(docs: DataFrame, min_frequency: int = 1, text_col: str = "text") -> DataFrame:
    """pretoken, n over all documents."""
    counts = docs.select(F.explode(pretokens(F.col(text_col))).alias("pretoken")).groupBy("pretoken").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= min_frequency) if min_frequency > 1 else counts


def byte_pair_counts(counts: DataFrame) -> DataFrame:
    """left, right (hex), n: adjacent bytes within pre-tokens, weighed by their counts."""
    data = counts.select(F.hex(F.encode("pretoken", "UTF-8")).alias("x"), "n").where(F.length("x") >= 4)
    pairs = F.explode(F.transform(F.sequence(F.lit(1), F.length("x") - 3, F.lit(2)), lambda i: F.substring("x", i, 4))).alias("p")
    return data.select(pairs, "n").groupBy("p").agg(F.sum("n").alias("n")).select(F.substring("p", 1, 2).alias("left"), F.substring("p", 3, 2).alias("right"), "n")


def best_pair(pairs: DataFrame) -> DataFrame:
    """The most frequent pair, the larger one of equal counts."""
    return pairs.agg(F.max_by(F.struct("left", "right", "n"), F.struct("n", "left", "right")).alias("b")).select("b.*")
