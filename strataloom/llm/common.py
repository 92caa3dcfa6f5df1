"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only up to this many rows and bytes; beyond either the join is salted.
BROADCAST_ROWS, BROADCAST_BYTES = 20_000, 32 << 20
#: Salts that a key of unknown weight is dealt over when the small side isn't broadcast.
SALTS = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only an unset one is set, to a temporary folder, and only where everything runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="strataloom-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that an operator wrote, through whatever file system holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder, so that no lost executor can take it along."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df, written to a new folder of the shared folder as Parquet, and that folder: smaller than a checkpoint, and removed by whoever asked for it."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def power_of_two(least: int) -> int:
    return 1 << max(0, (max(1, least) - 1).bit_length())


def hash60(*parts: Column | str) -> Column:
    """60 bits of the MD5 of the parts joined by '|', as a long; plain SQL engines can compute it too."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def keyed(col: Column) -> Column:
    """A string key that keeps null apart from every value, for equi-joins and windows."""
    return F.when(col.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), col.cast("string")))


def fits_broadcast(small: DataFrame) -> bool:
    """Whether small is within BROADCAST_ROWS and BROADCAST_BYTES. No more than the former and one row are read."""
    rows, size = small.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES


def join_small(big: DataFrame, small: DataFrame, key: str | list[str], spread: Column, how: str = "left") -> DataFrame:
    """big joined with small on key (a column or several, unique in small), safe for a key that holds most rows of big.

    small is measured first: up to BROADCAST_ROWS and BROADCAST_BYTES it is broadcast; beyond, every row of small is repeated for
    each of SALTS salts, and big's rows of a key are dealt over them by the hash of spread.
    """
    small = checkpointed(small)
    if fits_broadcast(small):
        return big.join(F.broadcast(small), key, how)
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted, [*([key] if isinstance(key, str) else key), "__salt"], how).drop("__salt")


#: Bits of a filter by key for each key, and at most: 16 MB, with which half of all others pass at a hundred million keys.
FILTER_EACH, FILTER_BITS, FILTER_PART = 16, 1 << 27, 1 << 16


def that_may_meet(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key (a hash as a long) is one of keys (written), and few others, found by a filter of bounded size: so that hardly more than these are shuffled to be joined."""
    spark = rows.sparkSession
    size = min(FILTER_BITS, max(FILTER_PART, power_of_two(FILTER_EACH * keys.count())))
    bits = keys.select(F.pmod(F.col(key), F.lit(size)).alias("bit")).withColumn("part", F.floor(F.col("bit") / FILTER_PART).cast("int"))

    def build(part, found):
        held = np.zeros(FILTER_PART, dtype=bool)
        held[found["bit"].to_numpy() % FILTER_PART] = True
        return pa.table([pa.array([part[0].as_py()], pa.int32()), pa.array([np.packbits(held).tobytes()], pa.binary())], names=["part", "held"])

    packed = np.zeros(size // 8, dtype=np.uint8)
    for r in bits.groupBy("part").applyInArrow(build, "part int, held binary").collect():
        packed[r["part"] * FILTER_PART // 8 : (r["part"] + 1) * FILTER_PART // 8] = np.frombuffer(r["held"], dtype=np.uint8)
    sent = spark.sparkContext.broadcast(packed)

    @F.arrow_udf("boolean")
    def may_meet(k: pa.Array) -> pa.Array:
        bit = k.to_numpy(zero_copy_only=False) % size
        return pa.array((sent.value[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1)

    return rows.where(may_meet(key))


def strings(column) -> list:
    """An Arrow string column as Python strings, null as empty."""
    return [x if x is not None else "" for x in column.to_pylist()]


def bounded_sample(rows: DataFrame, total: int, bound: int, order: Column) -> DataFrame:
    """The bound rows with the smallest order (a hash as a long), of total rows about.

    What lies far beyond the bound's share of hashes is left out before rows are ranked, so the ranking sees little more than bound rows
    in all, however many partitions there are.
    """
    share = 1.0 if total <= 2 * bound else (bound + 6 * bound**0.5 + 10) / total
    if share < 1.0:
        least = -(1 << 63) + int(share * (1 << 64))
        rows = rows.where(order <= F.lit(least).cast("long"))
    return rows.orderBy(order).limit(bound)
