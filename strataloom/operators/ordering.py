"""Running sums and positions over a total order, without one task that sees all rows.

Rows fall into ranges of the order column, whose bounds are approximate quantiles; a window runs within a range, and the sums of
the ranges before - a few rows for each range - are added. The bounds decide balance only, never the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_ROWS = 500_000


def range_of(df: DataFrame, order: str, ranges: int | None = None) -> Column:
    """A number that grows with the order column (numeric)."""
    if ranges is None:
        ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_ROWS))
    bounds = sorted(set(df.approxQuantile(order, [i / ranges for i in range(1, ranges)], 0.5 / ranges))) if ranges > 1 else []
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: b <= F.col(order)))


def running_sum(df: DataFrame, value: Column, order: str, name: str, by: list[str] | None = None, ties: list[str] | None = None, inclusive: bool = False, ranges: int | None = None) -> DataFrame:
    """df with name: the sum of value over the rows before (and of the row itself, if inclusive), in each group of by."""
    by = list(by or [])
    rows = df.withColumn("__range", range_of(df, order, ranges)).withColumn("__value", F.coalesce(value.cast("long"), F.lit(0).cast("long")))
    sums = rows.groupBy(*by, "__range").agg(F.sum("__value").alias("__sum"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    within = Window.partitionBy(*by, "__range").orderBy(order, *(ties or [])).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__own", F.sum("__value").over(within))
    same = rows["__range"] == sums["__range"]
    for c in by:
        same = same & rows[c].eqNullSafe(sums[c])
    total = sums["__before"] + rows["__own"] - (F.lit(0) if inclusive else rows["__value"])
    return rows.join(sums, same).select(*[rows[c] for c in df.columns], total.cast("long").alias(name))


def position(df: DataFrame, order: str, name: str = "position", by: list[str] | None = None, ties: list[str] | None = None) -> DataFrame:
    """df with the row's place in the order, from 0."""
    return running_sum(df, F.lit(1), order, name, by, ties)


def offset_window(df: DataFrame, order: str, skip: int = 0, at_most: int | None = None) -> DataFrame:
    """The rows at places skip, skip + 1, ... of the order: at_most of them, or all that follow."""
    if skip < 0 or (at_most is not None and at_most < 0):
        raise ValueError("skip and at_most must not be negative")
    placed = position(df, order, "__place").where(F.col("__place") >= skip)
    return (placed if at_most is None else placed.where(F.col("__place") < skip + at_most)).drop("__place")


def within_budget(df: DataFrame, cost: Column, order: str, budget: int, ties: list[str] | None = None) -> DataFrame:
    """Rows in order as long as the cost of the rows before stays below the budget; the last one may go over it."""
    return running_sum(df, cost, order, "__spent", ties=ties).where(F.col("__spent") < budget).drop("__spent")


def char_budget(max_tokens: int, chars_per_token: float = 4.0) -> int:
    return int(max_tokens * chars_per_token)
