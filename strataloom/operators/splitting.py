"""Train and validation splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.functions.hashing import in_validation
from strataloom.operators.ordering import position


def hash_split(docs: DataFrame, val_ratio: float = 0.05, text_col: str = "text") -> DataFrame:
    """docs with split: 'val' or 'train', by the text alone, so that equal texts go together."""
    return docs.withColumn("split", F.when(in_validation(F.col(text_col), val_ratio), "val").otherwise("train"))


def require_both_splits(split: DataFrame) -> None:
    """Raises ValueError if a side is empty."""
    found = {r["split"] for r in split.select("split").distinct().collect()}  # two rows at most
    if found != {"train", "val"}:
        raise ValueError(f"degenerate split: only {sorted(found)}")


def prefix_split(blocks: DataFrame, order: str, val_ratio: float = 0.05) -> DataFrame:
    """blocks with split: the last max(1, int(n * val_ratio)) in order are 'val'."""
    if not 0 < val_ratio < 1:
        raise ValueError("val_ratio must lie between 0 and 1")
    n = blocks.count()
    cut = n - (max(1, int(n * val_ratio)) if n else 0)
    return position(blocks, order, "__place").withColumn("split", F.when(F.col("__place") < cut, "train").otherwise("val")).drop("__place")
