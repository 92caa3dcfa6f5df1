"""Sinks: corpus text, row shards with an index, manifests, metric logs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.operators.ordering import position
from strataloom.sources import shared


def write_corpus(docs: DataFrame, path: str, order: str, eos: str | None = None, partitions: int | None = None, text_col: str = "text") -> None:
    """Documents in order, each ended by its mark (or parted by blank lines); one file for each range of the order."""
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.repartitionByRange(n, order).sortWithinPartitions(order).select(F.col(text_col).alias("value"))
    rows.write.mode("overwrite").option("lineSep", f"\n{eos}\n" if eos else "\n\n").text(path)


def with_shards(blocks: DataFrame, rows_per_shard: int, order: str = "block", by: list[str] | None = None) -> DataFrame:
    """blocks with shard: their place in the order, divided by rows_per_shard."""
    if rows_per_shard <= 0:
        raise ValueError("rows_per_shard must be positive")
    placed = position(blocks, order, "__place", by=by)
    return placed.withColumn("shard", F.floor(F.col("__place") / rows_per_shard).cast("int")).drop("__place")


def row_hash() -> Column:
    return F.sha2(F.concat_ws("|", F.concat_ws(",", "input_ids"), F.concat_ws(",", "labels")), 256)


def shard_index(blocks: DataFrame) -> DataFrame:
    """split, shard, rows, tokens, sha256 of every shard: the hash of its rows' hashes in order. A shard has rows_per_shard rows at most."""
    rows = blocks.select("split", "shard", "block", F.size("input_ids").alias("n"), F.unhex(row_hash()).alias("h"))  # half as wide as its digits
    in_order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "h"))), lambda x: F.lower(F.hex(x["h"]))), "")
    return rows.groupBy("split", "shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").cast("long").alias("tokens"), F.sha2(in_order, 256).alias("sha256"))


def write_shards(blocks: DataFrame, folder: str, rows_per_shard: int, meta: dict | None = None, gapless: bool = False) -> DataFrame:
    """Blocks (split, block, input_ids, labels) as Parquet by split and shard, and the index beside it (folder_index).

    gapless: the blocks of a split are numbered 0, 1, ... as packing does, so that their places need no pass of their own.
    Blocks that have their shard already (pack_tokens with shard_rows) lie in its task and are written from there. Small shards that were put together (shards) share a folder and a file:
    a folder of its own costs a shard of a few blocks more than its tokens do.
    """
    if rows_per_shard <= 0:
        raise ValueError("rows_per_shard must be positive")
    if "shard" in blocks.columns:
        sharded = blocks
    else:
        sharded = (blocks.withColumn("shard", F.floor(F.col("block") / rows_per_shard).cast("int")) if gapless else with_shards(blocks, rows_per_shard, by=["split"])).repartition("split", "shard")
    sharded = sharded.sortWithinPartitions("split", *(["shards"] if "shards" in blocks.columns else []), "shard", "block")
    with shared.shuffles_removed(blocks.sparkSession):
        sharded.write.mode("overwrite").options(**shared.TOKENS).partitionBy("split", "shards" if "shards" in blocks.columns else "shard").parquet(folder)
    index = shard_index(blocks.sparkSession.read.parquet(folder))
    index.withColumn("meta", F.lit(json.dumps(meta or {}, sort_keys=True))).write.mode("overwrite").parquet(f"{folder}_index")
    return index


def verify_shards(spark, folder: str) -> DataFrame:
    """split, shard, ok: whether the stored rows still have the hash of the index; a missing or unlisted shard is not ok."""
    now = shard_index(spark.read.parquet(folder)).select("split", "shard", F.col("sha256").alias("now"))
    then = spark.read.parquet(f"{folder}_index").select("split", "shard", "sha256")
    return then.join(now, ["split", "shard"], "full_outer").select("split", "shard", F.coalesce(F.col("sha256") == F.col("now"), F.lit(False)).alias("ok"))


def index_document(index: DataFrame, version: str = "1", **meta) -> DataFrame:
    """One row: the whole index as JSON, {version, splits: {split: [shards in order]}, and meta}. It grows with the shards."""
    shard = F.struct("shard", "rows", "tokens", "sha256")
    splits = index.groupBy("split").agg(F.array_sort(F.collect_list(shard)).alias("shards"))
    whole = splits.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", "shards")))).alias("splits"))
    return whole.select(F.to_json(F.struct(F.lit(version).alias("version"), "splits", *[F.lit(v).alias(k) for k, v in sorted(meta.items())])).alias("document"))


def file_hashes(spark, path: str) -> DataFrame:
    """file, bytes, sha256 of every file of a folder (or of one file)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def fingerprint(docs: DataFrame, order: str, text_col: str = "text", chunk: int = 10_000) -> DataFrame:
    """One row: the SHA-256 over the hashes of ranges of chunk documents, each over the hashes of its documents in order. Grows with documents / chunk."""
    rows = position(docs.select(order, F.sha2(text_col, 256).alias("h")), order, "__p").withColumn("__c", F.floor(F.col("__p") / chunk))
    joined = lambda k: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, "h"))), lambda x: x["h"]), ""), 256)
    return rows.groupBy("__c").agg(joined("__p").alias("h")).agg(joined("__c").alias("corpus_sha256"))


def manifest(values: DataFrame, **fixed) -> DataFrame:
    """A one-row DataFrame with the fixed values beside, as one JSON string."""
    row = values.select("*", *[F.lit(v).alias(k) for k, v in fixed.items()])
    return row.select(F.to_json(F.struct(*sorted(row.columns))).alias("manifest"))


def append_metrics(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
