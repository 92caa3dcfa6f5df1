"""Passages of an evaluation set within documents.

Texts become words (letters and digits, lower-cased); a run of n words is known by 96 bits of hashes. The evaluation set's runs, a row for each distinct one, are joined with the runs of all documents: they are
broadcast where they were measured to be small, so that no document's run is shuffled, else dealt over salts, as a passage may stand in most documents. Only hits go on: positions of hits within a
text are gaps and islands, and each island is a span of words that the evaluation set covers.

Defined cases: null and empty texts have no runs, and items of fewer than n words can't be found; rows of equal id and text give their spans once; rows without an id are told apart by their texts; a run
that several items share counts for the smallest item_id; spans that touch are one; very long texts are read whole; empty tables give no rows; other columns may be carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.sources import shared

N = 8


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def runs(of_words: Column, n: int) -> Column:
    """at (from 0), h, g for every run of n words."""
    run = lambda i: F.slice(of_words, i + 1, n)
    every = F.transform(F.sequence(F.lit(0), F.size(of_words) - n), lambda i: F.struct(i.alias("at"), F.xxhash64(run(i)).alias("h"), F.hash(run(i)).alias("g")))
    return F.when(F.size(of_words) >= n, every).otherwise(F.array().cast("array<struct<at: int, h: bigint, g: int>>"))


def evaluation_runs(items: DataFrame, n: int = N, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """h, g, item, items: every distinct run, the smallest item that holds it and how many do. Written to the shared folder."""
    each = items.select(F.col(id_col).alias("item"), F.explode(runs(words(F.col(text_col)), n)).alias("r")).select("item", "r.h", "r.g")
    return shared.written(each.groupBy("h", "g").agg(F.min("item").alias("item"), F.count_distinct("item").alias("items")), "runs")


def hits(docs: DataFrame, items_runs: DataFrame, n: int = N, carry: tuple = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The carried columns as __c0, ..., __a and __b (the text), at, item, items: a row for each position of a text where a run of the evaluation set begins."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = [F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)]
    of_words = docs.select(*names, F.xxhash64(text).alias("__a"), F.xxhash64(F.lit(1), text).alias("__b"), words(text).alias("__w"))
    each = of_words.select(*[f"__c{i}" for i in range(len(carry))], "__a", "__b", F.inline(runs(F.col("__w"), n)))
    return shared.join_measured(each, items_runs, ["h", "g"], F.struct("__a", "__b", "at"), "inner").drop("h", "g").distinct()


def spans(docs: DataFrame, items_runs: DataFrame, n: int = N, carry: tuple = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The carried columns, first_word (from 0), n_words, n_hits and item (the smallest) of every span."""
    row = [*[f"__c{i}" for i in range(len(carry))], "__a", "__b"]
    found = hits(docs, items_runs, n, carry, text_col)
    order = Window.partitionBy(*row).orderBy("at")
    apart = F.coalesce(F.col("at") > F.lag("at").over(order) + n, F.lit(True))
    islands = found.withColumn("__new", apart.cast("int")).withColumn("__island", F.sum("__new").over(order))
    merged = islands.groupBy(*row, "__island").agg(F.min("at").alias("first_word"), (F.max("at") - F.min("at") + n).alias("n_words"), F.count(F.lit(1)).alias("n_hits"), F.min("item").alias("item"))
    return merged.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)], "first_word", "n_words", "n_hits", "item")


def without_passages(docs: DataFrame, items: DataFrame, n: int = N, least_words: int = N, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """docs without those that have a span of least_words or more. Only the keys of texts that have one meet docs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumns({"__ka": F.xxhash64(text), "__kb": F.xxhash64(F.lit(1), text)})
    bad = spans(keyed, evaluation_runs(items, n, id_col, text_col), n, ("__ka", "__kb"), text_col).where(F.col("n_words") >= least_words)
    bad = shared.written(bad.select("__ka", "__kb").distinct().withColumn("__bad", F.lit(True)), "passages")
    return shared.join_measured(keyed, bad, ["__ka", "__kb"], F.rand(7)).where("__bad IS NULL").select(*docs.columns)
