"""The corpus build: chunks in normal form, long enough, the first of equal ones; its counters, its head sample, and packing with a tokenizer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.functions.text import normalize
from strataloom.operators import bpe, filters, ordering, packing, splitting
from strataloom.sources import shared


def normal_chunks(chunks: DataFrame, text_col: str = "text", **form) -> DataFrame:
    """chunks with their text in normal form (see normalize); a null text is an empty one."""
    return chunks.withColumn(text_col, normalize(F.coalesce(F.col(text_col), F.lit("")), **form))


def build_corpus(chunks: DataFrame, order: str, min_chars: int = 20, text_col: str = "text", **form) -> DataFrame:
    """The chunks that make the corpus, in normal form: those of min_chars or more, and of equal ones the first in order. Normal forms are made once and written to the shared folder."""
    formed = shared.written(normal_chunks(chunks, text_col, **form), "normal-forms")  # before the filter, which would have the form made for itself
    return filters.exact_dedup(formed.where(F.length(text_col) >= min_chars), order, F.col(text_col))


def build_counters(chunks: DataFrame, min_chars: int = 20, text_col: str = "text", file_col: str | None = None, **form) -> DataFrame:
    """One row: docs_kept, duplicates_removed, too_short_removed, total_chars, and files_read if a column names each chunk's file."""
    counters = filters.dedup_counters(normal_chunks(chunks, text_col, **form), min_chars, text_col)
    if file_col is None:
        return counters
    return counters.crossJoin(F.broadcast(chunks.agg(F.count_distinct(file_col).alias("files_read"))))  # one row each


def require_documents(counters: DataFrame) -> None:
    """Raises ValueError if the counters say that no document is left."""
    row = counters.first()
    if not row["docs_kept"]:
        raise ValueError(f"no document is left: {row.asDict()}")


def head_sample(docs: DataFrame, order: str, n_chars: int, text_col: str = "text", separator: int = 2) -> DataFrame:
    """The first documents in order that end within the first n_chars characters of the corpus text, whole ones only.

    separator: the characters between two documents, which count too. Only lengths go through the running sum; texts are looked up after it, so the
    order has to be unique.
    """
    sized = docs.select(order, (F.length(text_col) + separator).alias("__n"))
    ends = ordering.running_sum(sized, F.col("__n"), order, "__end", inclusive=True)
    last = ends.where(F.col("__end") - separator <= n_chars).agg(F.max(order).alias("__last"))
    return docs.join(F.broadcast(last), F.col(order) <= F.col("__last"), "left_semi")  # one row


def train_on_sample(docs: DataFrame, vocab_size: int, order: str, sample_chars: int | None = None, min_frequency: int = 1, specials: list[str] | None = None, text_col: str = "text") -> tuple[bpe.Tokenizer, DataFrame]:
    """A tokenizer of the head sample (or of all documents), and one row that says what it was trained on: sample_chars, of_chars."""
    chars = lambda df, name: df.agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0)).cast("long").alias(name))
    sample = docs if sample_chars is None else head_sample(docs, order, sample_chars, text_col)
    return bpe.train(sample, vocab_size, specials, min_frequency, text_col), chars(sample, "sample_chars").crossJoin(F.broadcast(chars(docs, "of_chars")))


def pack_corpus(docs: DataFrame, tokenizer: bpe.Tokenizer, seq_len: int, order: str, val_ratio: float = 0.05, eos: str = bpe.END_OF_TEXT, text_col: str = "text") -> DataFrame:
    """split, block, input_ids, labels: documents are split by their hash, encoded with an end mark, and packed by split."""
    coded = splitting.hash_split(docs, val_ratio, text_col).select(order, "split", bpe.encoder(tokenizer)(F.concat(F.col(text_col), F.lit(eos))).alias("tokens"))
    return packing.pack_tokens(coded, seq_len, order=order, by=["split"])


def pack_manifest(index: DataFrame, docs: DataFrame, val_ratio: float, text_col: str = "text") -> DataFrame:
    """One row: train_docs, val_docs, train_sequences, val_sequences, total_tokens of a pack with this index."""
    count = lambda of, split, name: F.coalesce(F.sum(F.when(F.col("split") == split, of)), F.lit(0)).cast("long").alias(name)
    n_docs = splitting.hash_split(docs, val_ratio, text_col).agg(*[count(F.lit(1), s, f"{s}_docs") for s in ("train", "val")])
    sequences = index.agg(*[count(F.col("rows"), s, f"{s}_sequences") for s in ("train", "val")], F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("total_tokens"))
    return n_docs.crossJoin(F.broadcast(sequences))  # one row each
