"""Mixing sources to target weights by Poisson replication.

A source's rate is the mean number of times that each of its rows has to appear for the source to get its target
weight of the mixture. Each row hashes its id and the seed to u in [0, 1) and inverts the Poisson distribution of
that rate at u: it appears as many times as cumulative probabilities lie at or below u. The copies then
get an order of their own: each is sent to a partition by its seeded key and sorted by it there, so partitions
are random subsets in random order (no sampling pass, no sort of the whole).

Defined cases: a null source is a source of its own; rows that repeat (with equal ids) draw the same count; null ids
draw as an empty id would; a source with weight 0 goes; a text of any length moves once; an empty table gives no rows. Columns of the input
stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import hash60, join_small, keyed, table

#: A Poisson variable of a larger mean is drawn as a sum of ones with at most this mean.
PIECE = 32.0
#: Rows of one id are dealt over so many places.
SPREAD = 1024


def source_rates(docs: DataFrame, weights: dict | None = None, temperature: float = 0.5, total: float | None = None, source_col: str = "source") -> DataFrame:
    """__mix_src, rate: the repetition that brings each source to its weight of total rows (all rows, by default).

    weights: the target weight by source; a source without one gets 0. Without weights, a source of n rows
    weighs n ** temperature.
    """
    counts = docs.groupBy(keyed(F.col(source_col)).alias("__mix_src")).agg(F.count(F.lit(1)).alias("n"))
    if weights is not None:
        if any(w < 0 for w in weights.values()):
            raise ValueError("weights must not be negative")
        given = docs.sparkSession.createDataFrame([("n" if k is None else f"v{k}", float(w)) for k, w in weights.items()], "__mix_src string, w double")
        counts = counts.join(given, "__mix_src", "left").fillna(0.0, ["w"])
    else:
        counts = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(temperature))))
    sums = counts.agg(F.sum("w").alias("ws"), F.sum("n").alias("ns"))
    aim = F.lit(float(total)) if total is not None else F.col("ns").cast("double")
    return counts.crossJoin(F.broadcast(sums)).select("__mix_src", F.when(F.col("ws") > 0, F.col("w") / F.col("ws") * aim / F.col("n")).otherwise(0.0).alias("rate"))


def poisson_cdf(rate):
    """P(X <= k) for k = 0, 1, ... as far as double precision tells it from 1."""
    last = F.ceil(rate + 12.0 * F.sqrt(rate) + 24.0).cast("int")
    step = lambda acc, k: F.struct((acc["p"] * rate / k).alias("p"), (acc["c"] + acc["p"] * rate / k).alias("c"), F.concat(acc["a"], F.array(acc["c"] + acc["p"] * rate / k)).alias("a"))
    zero = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("a"))
    return F.aggregate(F.sequence(F.lit(1), last), zero, step, lambda acc: acc["a"])


def poisson_mix(docs: DataFrame, weights: dict | None = None, temperature: float = 0.5, total: float | None = None, seed: str = "mix-1", id_col: str = "doc_id", source_col: str = "source", numbered: bool = True) -> DataFrame:
    """docs with each row as often as drawn, shuffled; if numbered with copy (from 0) and shuffle_key, by which the order goes (in place of columns of these names)."""
    pieces = F.greatest(F.ceil(F.col("rate") / PIECE), F.lit(1)).cast("int")
    rates = source_rates(docs, weights, temperature, total, source_col).withColumn("__mix_pieces", pieces).withColumn("__mix_cdf", poisson_cdf(F.col("rate") / F.col("__mix_pieces"))).drop("rate")
    # rows of one id (or none) draw the same keys: what they are dealt by has a row number beside
    rows = docs.select(F.struct("*").alias("__mix_row"), F.col(id_col).alias("__mix_id"), keyed(F.col(source_col)).alias("__mix_src"), F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).alias("__mix_at"))
    drawn = join_small(rows, rates, "__mix_src", F.col("__mix_at"), "inner")
    # the hashes are a column of their own: within the count over the distribution they would be made for each of its values
    drawn = drawn.withColumn("__mix_u", F.transform(F.sequence(F.lit(1), F.col("__mix_pieces")), lambda j: hash60(seed, F.col("__mix_id"), j.cast("string")) / F.lit(float(1 << 60))))
    repeats = F.aggregate("__mix_u", F.lit(0), lambda acc, u: acc + F.size(F.filter("__mix_cdf", lambda c: c <= u)))
    copies = drawn.withColumn("__mix_n", repeats).where("__mix_n > 0").select("__mix_row", "__mix_id", "__mix_at", F.explode(F.sequence(F.lit(0), F.col("__mix_n") - 1)).alias("__mix_copy"))
    copies = copies.withColumn("__mix_key", hash60(seed, "order", F.col("__mix_id"), F.col("__mix_copy")))
    mixed = copies.repartition("__mix_key", "__mix_at").sortWithinPartitions("__mix_key", "__mix_id")
    own = [c for c in docs.columns if not (numbered and c in ("copy", "shuffle_key"))]
    return mixed.select(*[F.col(f"__mix_row.`{c}`").alias(c) for c in own], *([F.col("__mix_copy").alias("copy"), F.col("__mix_key").alias("shuffle_key")] if numbered else []))


def op7_mixing(spark, sf_dir):
    """Whole documents, copied and shuffled."""
    return poisson_mix(table(spark, sf_dir, "documents"))


SQL = """
WITH n AS (SELECT CASE WHEN source IS NULL THEN 'n' ELSE concat('v', source) END AS src, count(*) AS n FROM documents GROUP BY 1),
rates AS (SELECT src, pow(CAST(n AS DOUBLE), 0.5) / sum(pow(CAST(n AS DOUBLE), 0.5)) OVER () * CAST(sum(n) OVER () AS DOUBLE) / n AS r FROM n),
cdf AS (SELECT src, list_transform(range(0, 120), lambda k: list_sum(list_transform(range(0, k + 1), lambda j: exp(j * ln(r) - r - lgamma(CAST(j + 1 AS DOUBLE)))))) AS c FROM rates),
drawn AS (
  SELECT d.*, len(list_filter(c, lambda x: x <= CAST(concat('0x', substr(md5(concat('mix-1|', d.doc_id, '|1')), 1, 15)) AS BIGINT) / CAST(1152921504606846976 AS DOUBLE))) AS times
  FROM documents d JOIN cdf ON cdf.src = CASE WHEN d.source IS NULL THEN 'n' ELSE concat('v', d.source) END),
copies AS (SELECT * EXCLUDE (times), CAST(unnest(range(0, times)) AS INTEGER) AS copy FROM drawn WHERE times > 0)
SELECT *, CAST(concat('0x', substr(md5(concat('mix-1|order|', doc_id, '|', copy)), 1, 15)) AS BIGINT) AS shuffle_key FROM copies
"""
