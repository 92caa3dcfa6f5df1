"""Sources: files of a folder, corpus text, JSON lines, packed shards, evaluation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions.text import strip, unix_newlines
from strataloom.operators.ordering import position

SUFFIXES = ("txt", "md", "py")


def collect_files(spark: SparkSession, folder: str, max_files: int = 100, max_bytes: int = 1 << 20) -> DataFrame:
    """path, length, content of the first max_files files in order of path with a text suffix and at most max_bytes; a missing folder gives none.

    Size and suffix are filtered before contents are read.
    """
    empty = spark.createDataFrame([], "path string, length long, content binary")
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        return empty
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    named = files.where(suffix.isin(*SUFFIXES) & ~F.col("path").endswith("/.gitkeep") & (F.col("length") <= max_bytes))
    chosen = named.select("path").orderBy("path").limit(max_files)
    return named.join(chosen, "path", "left_semi").select("path", "length", "content")


def file_documents(files: DataFrame) -> DataFrame:
    """path, chunk, text: text files are cut at blank lines, code files stay whole; a file that isn't UTF-8 is skipped."""
    text = unix_newlines(F.decode("content", "UTF-8"))
    valid = files.where(F.is_valid_utf8(F.col("content").cast("string"))).withColumn("__t", text)
    prose = F.lower("path").rlike(r"\.(txt|md)$")
    parts = F.when(prose, F.split("__t", "\n\n", -1)).otherwise(F.array("__t"))
    return valid.select("path", F.posexplode(parts).alias("chunk", "text"))


def split_documents(text: Column, eos: str | None) -> Column:
    """Documents of a corpus text: parts between end marks (or blank lines), stripped, without empty ones."""
    mark = "\\Q" + eos + "\\E" if eos else "\n\n"
    return F.filter(F.transform(F.split(text, mark, -1), strip), lambda d: d != "")


def read_corpus(spark: SparkSession, path: str, eos: str) -> DataFrame:
    """text of the documents of corpus files whose documents end with eos; files are split between them by the reader."""
    rows = spark.read.option("lineSep", eos).text(path)
    return rows.select(strip(F.col("value")).alias("text")).where("text <> ''")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_documents(spark: SparkSession, path: str, skip: int = 0, at_most: int | None = None, order: str = "doc_id") -> DataFrame:
    """A Parquet table of documents, or a window of it by order."""
    from strataloom.operators.ordering import offset_window

    rows = spark.read.parquet(path)
    return rows if not skip and at_most is None else offset_window(rows, order, skip, at_most)


#: A table of up to so many bytes may lie in fewer row groups than there are cores.
SMALL_BYTES = 256 << 20


def read_table(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """A Parquet table. The rows of a small one, whose only row group one task would read and work on alone, are dealt over the cores by key; a large
    one is left as its row groups part it, so nothing is shuffled. Column and filter pushdown reach the scan either way."""
    rows, at = spark.read.parquet(path), spark._jvm.org.apache.hadoop.fs.Path(path)
    if key is None or at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength() > SMALL_BYTES:
        return rows
    return rows.repartition(spark.sparkContext.defaultParallelism, key)


def load_sharded(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """Blocks of a split with their place, in the order of shards."""
    return position(spark.read.parquet(folder).where(F.col("split") == split), "block", "place")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def read_eval_set(spark: SparkSession, path: str) -> DataFrame:
    """One row for each item of a frozen evaluation set {version, frozen_utc, source, items}."""
    return spark.read.option("multiLine", True).json(path).select("version", F.inline("items"))


def seed_if_empty(spark: SparkSession, folder: str, docs: list[str]) -> bool:
    """Writes the given documents as text (blank lines between) if the folder has no usable file; tells whether it did."""
    if collect_files(spark, folder, 1, 1 << 40).limit(1).count():
        return False
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "ord long, text string")
    rows.coalesce(1).sortWithinPartitions("ord").select(F.col("text").alias("value")).write.mode("append").option("lineSep", "\n\n").text(folder)
    return True


def seed_pairs(spark: SparkSession, pairs: list[tuple[str, str, str]], max_pairs: int | None = None) -> DataFrame:
    """ord, instruction, input, output of the first pairs of a list."""
    rows = [(i, *p) for i, p in enumerate(pairs[:max_pairs])]
    return spark.createDataFrame(rows, "ord long, instruction string, input string, output string")
