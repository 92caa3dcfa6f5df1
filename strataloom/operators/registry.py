"""A registry of runs and checkpoints as tables: upserts return the new table. Parquet knows no MERGE, so they are written as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUNS = "run_id string, model_name string, git_commit string, dataset_hash string, tokenizer_hash string, config string, status string, created_utc timestamp, updated_utc timestamp"
CHECKPOINTS = "run_id string, step int, tokens_seen long, train_loss double, val_loss double, checkpoint_uri string, created_utc timestamp"


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row in order of each key, by partial aggregation."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def merge(target: DataFrame, updates: DataFrame, keys: list[str], updated: list[str]) -> DataFrame:
    """target with updates (one row a key): a known key takes the updated columns from its update, a new one the whole row."""
    t, u = target.alias("t"), updates.alias("u")
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"t.{k}") == F.col(f"u.{k}"))
    known, given = F.col(f"t.{keys[0]}").isNotNull(), F.col(f"u.{keys[0]}").isNotNull()
    pick = lambda c: F.when(~known, F.col(f"u.{c}")).when(given & F.lit(c in updated), F.col(f"u.{c}")).otherwise(F.col(f"t.{c}"))
    return t.join(u, on, "full_outer").select(*[F.coalesce(f"t.{c}", f"u.{c}").alias(c) if c in keys else pick(c).alias(c) for c in target.columns])


def upsert_runs(runs: DataFrame, updates: DataFrame) -> DataFrame:
    """On conflict only status and time change. Of several updates to a new run, the first makes the row and the last its status."""
    first = updates.groupBy("run_id").agg(F.min_by(F.struct(*[c for c in updates.columns if c != "run_id"]), "updated_utc").alias("f"), F.max_by(F.struct("status", "updated_utc"), "updated_utc").alias("l"))
    made = first.select("run_id", *[F.col(f"l.{c}" if c in ("status", "updated_utc") else f"f.{c}").alias(c) for c in updates.columns if c != "run_id"])
    return merge(runs, made.select(*runs.columns), ["run_id"], ["status", "updated_utc"])


def upsert_checkpoints(checkpoints: DataFrame, updates: DataFrame, runs: DataFrame, order: str = "created_utc") -> tuple[DataFrame, DataFrame]:
    """The new checkpoints (of known runs only) and the runs, of which those with an update are in training."""
    valid = updates.join(runs.select("run_id"), "run_id", "left_semi")
    new = merge(checkpoints, latest(valid, ["run_id", "step"], order).select(*checkpoints.columns), ["run_id", "step"], ["tokens_seen", "train_loss", "val_loss", "checkpoint_uri"])
    touched = valid.groupBy("run_id").agg(F.max(order).alias("__t"))
    after = runs.join(touched, "run_id", "left")
    after = after.withColumn("status", F.when(F.col("__t").isNotNull(), "training").otherwise(F.col("status"))).withColumn("updated_utc", F.coalesce("__t", "updated_utc"))
    return new, after.select(*runs.columns)


GUARDED = ["tokenizer_sha256", "vocab_size", "seq_len", "eos_text"]


def merge_packs(packs: list[tuple[DataFrame, dict]], expect_sha: str | None = None, name: str = "merged") -> tuple[DataFrame, dict]:
    """Blocks of several packs (split, block, input_ids, labels) one after another, with the ordinal of their pack, and the manifest."""
    if not packs:
        raise ValueError("there is no pack to merge")
    base = packs[0][1]
    for _, m in packs:
        for key in GUARDED:
            if m[key] != base[key]:
                raise ValueError(f"packs disagree on {key}")
    if expect_sha is not None and base["tokenizer_sha256"] != expect_sha:
        raise ValueError("the tokenizer is not the expected one")
    rows = None
    for i, (df, _) in enumerate(packs):
        df = df.withColumn("pack", F.lit(i))
        rows = df if rows is None else rows.unionByName(df)
    counts = {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}  # a row for each split
    manifest = base | {"name": name, "train_sequences": counts.get("train", 0), "val_sequences": counts.get("val", 0)}
    manifest |= {k: sum(m.get(k, 0) for _, m in packs) for k in ("train_docs", "val_docs")}
    manifest |= {"total_tokens": manifest["train_sequences"] * base["seq_len"], "total_tokens_real": sum(m.get("total_tokens", 0) for _, m in packs)}
    return rows, manifest
