"""Language identification: likelihoods of letter trigrams, a model that is a table.

Training counts words for each language first and cuts the distinct ones into trigrams, so no text is cut twice; the most frequent trigrams of each language make the model, with a row for each trigram and
in it a whole-number log-likelihood for every language. Scoring joins the trigrams of each text with the model and sums: the model is broadcast where it was measured to be small, and sums are made on the
side of the texts before anything is shuffled, a narrow row for each text. Log-likelihoods are whole numbers, so sums don't depend on their order.

Defined cases: null and empty texts, and texts without a known trigram, have no language and a score of 0; rows without a language, or held out, teach nothing; the language of equal sums is the first by name;
repeated rows are scored alike and all returned; very long texts are read whole, word by word; without training rows no text has a language; other columns may be carried.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.sources import shared

#: Trigrams that each language gives to the model; weights are SCALE times natural logarithms; so many trigrams are full evidence.
TOP, SCALE, EVIDENCE = 1000, 1000, 20


@dataclass
class Model:
    """languages, by name; rows: gram, w (a weight for each language). Written to the shared folder."""

    languages: list[str]
    rows: DataFrame


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))


def grams(word: Column) -> Column:
    """Every three characters of the word with a blank on both sides; none of an empty word."""
    return F.regexp_extract_all(F.concat(F.lit(" "), word, F.lit(" ")), F.lit("(?=(...))"), F.lit(1))


def gram_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, gram, n."""
    counted = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.explode(words(F.col(text_col))).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("lang", "n", F.explode(grams(F.col("word"))).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model that docs teach. The driver sees the names of languages only."""
    counts = shared.written(gram_counts(docs, text_col, lang_col), "gram-counts")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    chosen = shared.written(counts.withColumn("rank", rank).where(F.col("rank") <= top).select("gram").distinct(), "grams")
    known = counts.join(chosen, "gram")
    totals = known.groupBy("lang").agg(F.sum("n").alias("total"))
    languages = [r["lang"] for r in totals.select("lang").orderBy("lang").collect()]
    many = chosen.count()
    # a trigram that a language hasn't: one in its total
    weighed = known.join(F.broadcast(totals), "lang")  # a row for each language
    weight = lambda n: F.round(F.lit(SCALE) * F.log((n + 1) / (F.col("total") + many))).cast("long")
    by_lang = weighed.withColumn("w", weight(F.col("n"))).groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "w"))).alias("found"))
    absent = {r["lang"]: r["w"] for r in totals.select("lang", weight(F.lit(0)).alias("w")).collect()}
    rows = by_lang.select("gram", F.array(*[F.coalesce(F.try_element_at("found", F.lit(la)), F.lit(absent[la])) for la in languages]).cast("array<long>").alias("w")) if languages else chosen.select("gram", F.array().cast("array<long>").alias("w"))
    return Model(languages, shared.written(rows, "language-model"))


def identified(docs: DataFrame, model: Model, carry: tuple = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The carried columns, predicted, language_score (0 to 1) and n_grams (known trigrams), a row for each row of docs."""
    names = [f"__c{i}" for i in range(len(carry))]
    text = F.coalesce(F.col(text_col), F.lit(""))
    # a row is known by 128 bits of its text and what it carries; a word without letters marks the row itself
    own = docs.select(*[F.col(c).alias(n) for c, n in zip(carry, names)], F.xxhash64(text).alias("__a"), F.xxhash64(F.lit(1), text).alias("__b"), F.explode(F.concat(F.array(F.lit("")), words(text))).alias("__word"))
    cut = own.select(*names, "__a", "__b", F.explode_outer(grams(F.col("__word"))).alias("gram"))
    met = shared.join_measured(cut, model.rows, ["gram"], F.struct("__a", "__b"))
    sums = [F.coalesce(F.sum(F.get("w", F.lit(i))), F.lit(0)).alias(f"__s{i}") for i in range(len(model.languages))]
    scored = met.groupBy(*names, "__a", "__b").agg(F.count("w").alias("n_grams"), F.count_if(F.col("gram").isNull()).alias("__copies"), *sums)
    scored = scored.withColumns({c: F.call_function("div", F.col(c), F.col("__copies")) for c in ["n_grams", *(f"__s{i}" for i in range(len(sums)))]})  # equal rows add up to copies of one
    if model.languages:
        best = F.array_max(F.array(*[F.struct(F.col(f"__s{i}").alias("s"), F.lit(-i).alias("i")) for i in range(len(model.languages))]))
        scored = scored.withColumn("__best", best)
        sharp = F.least(F.col("n_grams"), F.lit(EVIDENCE)) / F.col("n_grams") / SCALE
        odds = [F.exp((F.col(f"__s{i}") - F.col("__best.s")) * sharp) for i in range(len(model.languages))]
        total = odds[0]
        for o in odds[1:]:
            total = total + o
        some = F.col("n_grams") > 0
        predicted = F.when(some, F.element_at(F.array(*[F.lit(la) for la in model.languages]), 1 - F.col("__best.i")))
        score = F.when(some, F.lit(1.0) / total).otherwise(F.lit(0.0))
    else:
        predicted, score = F.lit(None).cast("string"), F.lit(0.0)
    every = scored.withColumns({"predicted": predicted, "language_score": score}).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    return every.select(*[F.col(n).alias(c) for n, c in zip(names, carry)], "predicted", "language_score", "n_grams")


def accuracy(found: DataFrame, lang_col: str = "lang") -> DataFrame:
    """lang, n, n_right of rows that carry their true language."""
    return found.groupBy(lang_col).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("predicted").eqNullSafe(F.col(lang_col))).alias("n_right"))
