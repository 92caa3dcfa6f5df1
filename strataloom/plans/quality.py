"""Registered queries that judge documents: language, quality, passages of the evaluation set. Beside each, its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.functions.hashing import md5_bucket
from strataloom.operators import contamination, filters, language, quality_score
from strataloom.plans.corpus import BUCKET, STRIPPED, documents, query

#: Of 1,000 buckets of texts so many are held out of training.
HELD_OUT = 200

_PAD = "concat(' ', w, ' ')"
_IDENTIFIED = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text, {BUCKET} < {HELD_OUT} AS held_out FROM documents),
w AS (SELECT rid, lang, held_out, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS w FROM d),
g AS MATERIALIZED (SELECT rid, lang, held_out, unnest(list_transform(range(1, length({_PAD}) - 1), lambda i: substring({_PAD}, i, 3))) AS gram FROM w),
counts AS MATERIALIZED (SELECT lang, gram, count(*) AS n FROM g WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, gram),
chosen AS MATERIALIZED (SELECT DISTINCT gram FROM (SELECT gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS r FROM counts) WHERE r <= {language.TOP}),
totals AS (SELECT lang, sum(n) AS total FROM counts JOIN chosen USING (gram) GROUP BY lang),
model AS MATERIALIZED (SELECT gram, t.lang AS la, round({language.SCALE} * ln((coalesce(c.n, 0) + 1) / (t.total + (SELECT count(*) FROM chosen))))::BIGINT AS wt FROM chosen CROSS JOIN totals t LEFT JOIN counts c USING (gram, lang)),
sums AS MATERIALIZED (SELECT rid, la, sum(wt * n)::BIGINT AS s, sum(n)::BIGINT AS n FROM (SELECT rid, gram, count(*) AS n FROM g GROUP BY rid, gram) JOIN model USING (gram) GROUP BY rid, la),
best AS (SELECT rid, max(s) AS b, arg_max(la, (s, -k)) AS predicted, max(n) AS n FROM (SELECT *, dense_rank() OVER (ORDER BY la) AS k FROM sums) GROUP BY rid),
odds AS (SELECT rid, sum(exp((s - b) * (least(sums.n, {language.EVIDENCE}) / sums.n / {language.SCALE}))) AS total FROM sums JOIN best USING (rid) GROUP BY rid),
identified AS MATERIALIZED (SELECT d.doc_id, d.lang, d.text, d.held_out, predicted, coalesce(1.0 / total, 0.0) AS language_score, coalesce(n, 0) AS n_grams FROM d LEFT JOIN best USING (rid) LEFT JOIN odds USING (rid))"""


def _identified(spark, sf_dir, *carry):
    docs = documents(spark, sf_dir).withColumn("held_out", md5_bucket(F.col("text")) < HELD_OUT)
    model = language.train(docs.where(~F.col("held_out")))
    return language.identified(docs, model, ("doc_id", "lang", "held_out", *carry))


@query(f"{_IDENTIFIED} SELECT doc_id, lang, held_out, predicted, round(language_score, 6) AS language_score, n_grams FROM identified")
def language_id(spark, sf_dir):
    """The language of every document by a model learnt from four fifths of them, without the texts held out."""
    return _identified(spark, sf_dir).withColumn("language_score", F.round("language_score", 6))


@query(f"{_IDENTIFIED} SELECT lang, count(*) AS n, count(*) FILTER (predicted = lang) AS n_right FROM identified WHERE held_out GROUP BY lang")
def language_accuracy(spark, sf_dir):
    """How many texts held out get their language."""
    return language.accuracy(_identified(spark, sf_dir).where("held_out"))


@query(f"{_IDENTIFIED} SELECT doc_id, predicted, length({STRIPPED})::BIGINT AS stripped_chars FROM identified WHERE length({STRIPPED}) >= 200 AND (predicted IS NULL OR predicted = 'en') AND (language_score = 0 OR language_score >= 0.5)")
def identified_filter(spark, sf_dir):
    """The stream's filters by length, language and score, with both computed from the text."""
    docs = documents(spark, sf_dir).withColumn("stripped_chars", F.length(filters.strip(F.coalesce("text", F.lit("")))).cast("long"))
    docs = docs.withColumn("held_out", md5_bucket(F.col("text")) < HELD_OUT)
    found = language.identified(docs, language.train(docs.where(~F.col("held_out"))), ("doc_id", "stripped_chars"))
    sure = filters.in_language(F.col("predicted"), "en") & filters.sure_of_language(F.col("language_score"))
    return found.where((F.col("stripped_chars") >= 200) & sure).select("doc_id", "predicted", "stripped_chars")


_SPACE = r"[\x20\x09-\x0D]"
_WORDED = r"[^\x20\x09-\x0D]"
_FIGURES = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT *, regexp_extract_all(t, '{_WORDED}+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORDED}')) AS l FROM d)
SELECT doc_id, ln(1 + len(w)) AS log_words, CASE WHEN len(w) + 1 > 0 THEN length(t) / (len(w) + 1) ELSE 0 END AS word_chars,
       {{}},
       CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w) ELSE 0 END AS distinct_words, CASE WHEN len(l) > 0 THEN (len(l) - len(list_distinct(l))) / len(l) ELSE 0 END AS repeated_lines,
       CASE WHEN len(l) > 0 THEN len(list_filter(l, lambda x: regexp_matches(x, '[.!?]{_SPACE}*$'))) / len(l) ELSE 0 END AS ended_lines
FROM p""".format(", ".join(f"CASE WHEN length(t) > 0 THEN length(regexp_replace(t, '[^{c}]', '', 'g')) / length(t) ELSE 0 END AS {n}" for n, c in (("symbol_share", "#*$%&|<>"), ("upper_share", "A-Z"), ("mark_share", "!?.,;:"), ("digit_share", "0-9"))))
_ROUNDED = f"SELECT doc_id, {', '.join(f'round({f}::DOUBLE, 9) AS {f}' for f in quality_score.FIGURES)} FROM ({_FIGURES})"


@query(_ROUNDED)
def quality_figures(spark, sf_dir):
    """The figures that the quality model sees, of every document."""
    rows = quality_score.with_figures(documents(spark, sf_dir))
    return rows.select("doc_id", *[F.round(F.col("x")[i], 9).alias(f) for i, f in enumerate(quality_score.FIGURES)])


def _quality(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("held_out", md5_bucket(F.col("text")) < HELD_OUT)
    model = quality_score.train(docs.where(~F.col("held_out")), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_score.scored(docs, model)


@query()
def quality(spark, sf_dir):
    """The score and calibrated quality of every document, learnt from the labels of texts that aren't held out."""
    return _quality(spark, sf_dir).select("doc_id", "held_out", F.round("quality_score", 6).alias("quality_score"), F.round("quality", 6).alias("quality"))


_HITS = f"""WITH d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS t FROM documents), n AS (SELECT row_number() OVER () AS rid, * FROM d),
dw AS (SELECT rid, doc_id, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+') AS w FROM n),
dr AS (SELECT rid, doc_id, unnest(range(0, len(w) - {contamination.N - 1})) AS pos, w FROM dw WHERE len(w) >= {contamination.N}),
bw AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark),
br AS (SELECT list_slice(w, pos + 1, pos + {contamination.N}) AS run, min(item_id) AS item FROM (SELECT item_id, w, unnest(range(0, len(w) - {contamination.N - 1})) AS pos FROM bw WHERE len(w) >= {contamination.N}) GROUP BY 1),
hits AS MATERIALIZED (SELECT rid, doc_id, pos, item FROM (SELECT rid, doc_id, pos, list_slice(w, pos + 1, pos + {contamination.N}) AS run FROM dr) JOIN br USING (run))"""
_SPANS = f"""{_HITS},
marked AS (SELECT *, CASE WHEN coalesce(pos > lag(pos) OVER (PARTITION BY rid ORDER BY pos) + {contamination.N}, TRUE) THEN 1 ELSE 0 END AS fresh FROM hits),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY rid ORDER BY pos) AS island FROM marked),
spans AS (SELECT any_value(doc_id) AS doc_id, min(pos)::INTEGER AS first_word, (max(pos) - min(pos) + {contamination.N})::INTEGER AS n_words, count(*) AS n_hits, min(item) AS item FROM islands GROUP BY rid, island)"""


def _runs(spark, sf_dir):
    return contamination.evaluation_runs(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query(f"{_SPANS} SELECT * FROM spans")
def benchmark_spans(spark, sf_dir):
    """Every passage of a document that the evaluation set covers."""
    return contamination.spans(documents(spark, sf_dir), _runs(spark, sf_dir))


@query(f"{_SPANS} SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM spans WHERE n_words >= 12)")
def decontaminated(spark, sf_dir):
    """The documents without those that hold twelve words or more of the evaluation set in a row."""
    kept = contamination.without_passages(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least_words=12)
    return kept.select("doc_id", F.md5("text").alias("text_md5"))
