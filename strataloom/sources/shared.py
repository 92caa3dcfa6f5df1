"""The folder that driver and executors share, tables written there, and joins that measure a side before it is broadcast."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast up to this many rows and bytes only.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20
#: Salts that rows of a key are dealt over where the other side isn't broadcast.
SALTS = 32
#: How tables of tokens are written.
TOKENS = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9"}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder set on the context; a temporary one only where everything runs in one process and neither is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="strataloom-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files; else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df, made once for all that reads it: written to the shared folder as Parquet and read again. Lazy results read it, so it stays until the folder is cleared."""
    path = new(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path, through whatever file system holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fits_broadcast(small: DataFrame) -> bool:
    """Whether small is within BROADCAST_ROWS and BROADCAST_BYTES. No more than the former and one row are read."""
    rows, size = small.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES


def join_measured(big: DataFrame, small: DataFrame, keys: list[str], spread: Column, how: str = "left") -> DataFrame:
    """big joined with small (written, read twice) on keys, safe for a key that holds most rows of big: small is broadcast if it fits,
    else each of its rows is repeated for SALTS salts, over which big's rows of a key are dealt by the hash of spread."""
    if fits_broadcast(small):
        return big.join(F.broadcast(small), keys, how)
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted, [*keys, "__salt"], how).drop("__salt")
