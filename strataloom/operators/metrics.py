"""Metrics of training and evaluation runs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The step at which each leg of a run stops; later legs stop at the last.
LEG_STOPS = {1: 11_000, 2: 17_000, 3: 23_000, 4: 29_000, 5: 47_000, 6: 56_000, 7: 74_000, 8: 92_000, 9: 110_000, 10: 122_000}


def perplexity(loss: Column) -> Column:
    """exp(loss); not-a-number stays."""
    return F.when(F.isnan(loss), F.lit(float("nan"))).otherwise(F.exp(loss))


def evaluation(batches: DataFrame) -> DataFrame:
    """loss (mean of batch means), perplexity, accuracy (over all tokens), batches; of batches(loss, n_correct, n_tokens)."""
    sums = batches.agg(F.avg("loss").alias("loss"), F.sum("n_correct").alias("c"), F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("batches"))
    loss = F.coalesce("loss", F.lit(float("nan")))
    return sums.select(loss.alias("loss"), perplexity(loss).alias("perplexity"), F.when(F.col("n") > 0, F.col("c") / F.col("n")).otherwise(0.0).alias("accuracy"), "batches")


def mean_loss(batches: DataFrame) -> DataFrame:
    return batches.agg(F.coalesce(F.avg("loss"), F.lit(float("nan"))).alias("val_loss"))


def run_summary(history: DataFrame, by: list[str]) -> DataFrame:
    """by, first_loss, last_loss, last_step: the first and last step that bear a loss."""
    kept = history.where(F.col("loss").isNotNull())
    return kept.groupBy(*by).agg(F.min_by("loss", "step").alias("first_loss"), F.max_by("loss", "step").alias("last_loss"), F.max("step").alias("last_step"))


def learning_rate(step: Column, peak: float, least: float, warmup: int, last: int) -> Column:
    """Linear warm-up to the peak, then a half cosine down to the least."""
    progress = (step - warmup) / float(max(1, last - warmup))
    cosine = F.lit(least) + F.lit(peak - least) * (F.lit(0.5) * (F.lit(1.0) + F.cos(F.lit(math.pi) * progress)))
    return F.when(step < warmup, F.lit(peak) * (step + 1) / float(max(1, warmup))).when(step >= last, F.lit(least)).otherwise(cosine)


def leg_stop(leg: Column) -> Column:
    stops = F.create_map(*[F.lit(x) for kv in LEG_STOPS.items() for x in kv])
    return F.coalesce(F.try_element_at(stops, leg.cast("int")), F.lit(max(LEG_STOPS.values())))


def leg_of_step(step: Column, start: int = 5_000) -> Column:
    """The leg in which a step is run: the first one that stops after it; null before the start and after the last stop."""
    out = F.lit(None).cast("int")
    for leg, stop in sorted(LEG_STOPS.items(), reverse=True):
        out = F.when(step < stop, F.lit(leg)).otherwise(out)
    return F.when(step >= start, out)


def preference_loss(chosen: Column, rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float) -> Column:
    """-log sigmoid(beta * (margin of the policy - margin of the reference)) of a pair of log-probabilities."""
    z = ((chosen - rejected) - (ref_chosen - ref_rejected)) * beta
    return F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def sequence_logp(logps: Column, labels: Column, ignore: int = -100) -> Column:
    """The sum of log-probabilities at places whose label counts."""
    return F.aggregate(F.zip_with(logps, labels, lambda p, y: F.when(y != ignore, p).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)


def config_faults(configs: DataFrame) -> DataFrame:
    """name, fault: constraints that a model configuration (name, hidden_size, num_heads, num_kv_heads, vocab_size, ...) violates."""
    c = F.col
    checks = {
        "hidden_size must be a multiple of num_heads": (c("num_heads") > 0) & (c("hidden_size") % c("num_heads") == 0),
        "num_heads must be a multiple of num_kv_heads": (c("num_kv_heads") > 0) & (c("num_heads") % c("num_kv_heads") == 0),
        "sizes must be positive": (c("hidden_size") > 0) & (c("num_heads") > 0) & (c("vocab_size") > 0),
    }
    faults = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(text)) for text, ok in checks.items()])
    return configs.select("name", F.explode(F.filter(faults, lambda x: x.isNotNull())).alias("fault"))
