"""Packing of token sequences into blocks of one length.

Sequences are made once, meet in ranges of their order and are written to the shared folder with their offset within the range; what lies before a range is a sum over few rows. So a sequence knows its offset
without a join. Each is cut into the slices that fall into a block, and a block is put together from its slices. No token is shuffled by itself, and a block holds few rows.
Slices travel once: labels are made where blocks are, and what goes to shards travels as one slice for each folder of shards and is cut into blocks there. Whether a block is whole is a sum beside its slices, so counting blocks
moves no token. On the way tokens have the narrowest integers that hold a sequence, and what a step has shuffled is deleted when it has been written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.operators.ordering import range_of
from strataloom.sources import shared

IGNORE = -100


def _check(seq_len: int) -> None:
    if seq_len <= 0:
        raise ValueError("seq_len must be positive")


def narrow(array: Column) -> Column:
    """An array of integers as that one of the fields b (bytes), u (bytes, less 128), s (shorts) and w (as they are) that is the first to hold it; the others are null."""
    least, most = F.array_min(array), F.array_max(array)
    kind = F.when((least >= -128) & (most < 128), "b").when((least >= 0) & (most < 256), "u").when((least >= -(1 << 15)) & (most < 1 << 15), "s").otherwise("w")
    held = {"b": array.cast("array<tinyint>"), "u": F.transform(array, lambda x: (x - 128).cast("tinyint")), "s": array.cast("array<smallint>"), "w": array}
    return F.struct(*[F.when(kind == k, x).alias(k) for k, x in held.items()])


def widened(narrowed: Column, kind: str) -> Column:
    of_u = F.transform(narrowed["u"].cast("array<smallint>"), lambda x: (x + F.lit(128).cast("smallint")).cast("smallint")).cast(kind)
    return F.coalesce(narrowed["b"].cast(kind), of_u, narrowed["s"].cast(kind), narrowed["w"])


def _cut(narrowed: str, start: Column, end: Column) -> Column:
    """What lies from start to end of a sequence that begins at __at."""
    return F.struct(*[F.slice(F.col(narrowed)[k], (start - F.col("__at") + 1).cast("int"), (end - start).cast("int")).alias(k) for k in "busw"])


def _sequences(docs: DataFrame, arrays: list[str], order: str, by: list[str]) -> DataFrame:
    """by, __at, __n and the arrays (narrow) of every row that isn't empty: __at is what the rows before it in its group hold."""
    at_range = range_of(docs.select(order), order)
    made = docs.select(*by, order, *arrays).withColumn("__n", F.size(arrays[0])).withColumn("__row", F.monotonically_increasing_id()).where("__n > 0")
    made = made.select(*by, order, "__n", "__row", at_range.alias("__range"), *[narrow(F.col(a)).alias(a) for a in arrays])
    before = Window.partitionBy(*by, "__range").orderBy(order, "__row").rowsBetween(Window.unboundedPreceding, -1)
    placed = made.repartition("__range").withColumn("__own", F.coalesce(F.sum("__n").over(before), F.lit(0)).cast("long"))
    with shared.shuffles_removed(docs.sparkSession):
        rows = shared.written(placed.select(*by, "__range", "__own", "__n", *arrays), "sequences", **shared.TOKENS)
    names = [f"__by{i}" for i in range(len(by))]
    sums = rows.groupBy(*[F.col(c).alias(k) for c, k in zip(by, names)], F.col("__range").alias("__r")).agg(F.sum("__n").alias("__sum"))
    earlier = Window.partitionBy(*names).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    sums = shared.written(sums.select(*names, "__r", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).cast("long").alias("__before")), "range-sums")
    same = rows["__range"] == sums["__r"]
    for c, k in zip(by, names):
        same = same & rows[c].eqNullSafe(sums[k])
    joined = rows.join(F.broadcast(sums) if shared.fits_broadcast(sums) else sums, same)
    return joined.select(*by, (F.col("__before") + F.col("__own")).alias("__at"), "__n", *arrays)


def _first_and_last(length: int, extra: int) -> tuple[Column, Column]:
    """Of pieces of length tokens, the first and last that a sequence lies in; a piece ends with the extra tokens that follow it."""
    return F.greatest(F.lit(0), F.floor((F.col("__at") - extra) / length)).cast("long"), F.floor((F.col("__at") + F.col("__n") - 1) / length).cast("long")


def _pieces(rows: DataFrame, name: str, length: int, extra: int, arrays: list[str], by: list[str], moved: bool = False) -> DataFrame:
    """by, name, s: every piece (by number) with its tokens' slices in order, and __got, how many they are. moved: slices go to the task of their piece."""
    rows = rows.withColumn(name, F.explode(F.sequence(*_first_and_last(length, extra))))
    start, end = F.greatest(F.col("__at"), F.col(name) * length), F.least(F.col("__at") + F.col("__n"), F.col(name) * length + (length + extra))
    slices = rows.where(start < end).select(*by, name, (end - start).alias("__got"), F.struct(start.alias("__at"), *[_cut(a, start, end).alias(a) for a in arrays]).alias("s"))
    if moved:
        slices = slices.withColumn(name, F.col(name).cast("int")).repartition(*by, name)
    return slices.groupBy(*by, name).agg(F.sum("__got").alias("__got"), F.array_sort(F.collect_list("s")).alias("s"))


def _blocks(docs: DataFrame, arrays: list[str], order: str, seq_len: int, width: int, by: list[str], shard_rows: int | None = None, together: int = 1) -> DataFrame:
    """by, block, the arrays' elements from block * seq_len on, for the blocks that have width of them. shard_rows: with shard (of so many blocks), each in one task; together: so are that many shards, with shards, their number."""
    kinds, rows, extra = dict(docs.select(*arrays).dtypes), _sequences(docs, arrays, order, by), width - seq_len
    whole = lambda a: F.flatten(F.transform("s", lambda x: widened(x[a], kinds[a]))).alias(a)
    if shard_rows is None:
        return _pieces(rows, "block", seq_len, extra, arrays, by).where(F.col("__got") == width).select(*by, "block", *[whole(a) for a in arrays])
    folder, blocks = "shard" if together == 1 else "shards", shard_rows * together
    folders = _pieces(rows, folder, seq_len * blocks, extra, arrays, by, moved=True).where(F.col("__got") >= width)
    count = F.least(F.lit(blocks), F.floor((F.col("__got") - extra) / seq_len)).cast("int")
    folders = folders.select(*by, folder, count.alias("__count"), *[whole(a) for a in arrays])
    cut = folders.withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__count") - 1)))
    block = F.col(folder).cast("long") * blocks + F.col("__i")
    shard = [] if together == 1 else [F.floor(block / shard_rows).cast("int").alias("shard")]
    return cut.select(*by, folder, *shard, block.alias("block"), *[F.slice(a, F.col("__i") * seq_len + 1, F.lit(width)).alias(a) for a in arrays])


def pack_tokens(docs: DataFrame, seq_len: int, tokens: str = "tokens", order: str = "doc_id", by: list[str] | None = None, shard_rows: int | None = None, together: int = 1) -> DataFrame:
    """by, block, input_ids, labels: labels are the input shifted by one. Of N tokens there are (N - 1) div seq_len blocks. shard_rows: with shard, ready for write_shards, which puts so many shards together into a folder."""
    _check(seq_len)
    whole = _blocks(docs, [tokens], order, seq_len, seq_len + 1, list(by or []), shard_rows, together)
    return whole.select(*[c for c in whole.columns if c != tokens], F.slice(tokens, 1, seq_len).alias("input_ids"), F.slice(tokens, 2, seq_len).alias("labels"))


def sft_example(prompt: Column, response: Column, eos: int) -> tuple[Column, Column]:
    """Input and labels: the prompt bears no loss, response and end do."""
    end = F.array(F.lit(eos))
    return F.concat(prompt, response, end), F.concat(F.array_repeat(F.lit(IGNORE), F.size(prompt)), response, end)


def trainable(labels: Column) -> Column:
    return F.exists(labels, lambda x: x != IGNORE)


def pack_sft(pairs: DataFrame, seq_len: int, order: str, by: list[str] | None = None) -> DataFrame:
    """by, block, input_ids, labels, dropped: N div seq_len blocks of pairs with input_ids and labels; those without a trainable token are marked dropped."""
    _check(seq_len)
    whole = _blocks(pairs, ["input_ids", "labels"], order, seq_len, seq_len, list(by or []))
    return whole.withColumn("dropped", ~trainable(F.col("labels")))


def trainable_batches(blocks: DataFrame, batch_rows: int, by: list[str] | None = None) -> DataFrame:
    """by, batch, rows, skipped: batch_rows gapless blocks (block, labels) each; a batch without a trainable token is skipped in training."""
    if batch_rows <= 0:
        raise ValueError("batch_rows must be positive")
    rows = blocks.select(*(by or []), F.expr(f"block div {batch_rows}").alias("batch"), trainable(F.col("labels")).alias("__ok"))
    return rows.groupBy(*(by or []), "batch").agg(F.count(F.lit(1)).alias("rows"), (~F.bool_or("__ok")).alias("skipped"))


def block_counts(docs: DataFrame, seq_len: int, tokens: str = "tokens") -> DataFrame:
    """n_tokens, lm_blocks, sft_blocks that packing all of docs gives."""
    _check(seq_len)
    n = F.coalesce(F.sum(F.size(tokens)), F.lit(0)).cast("long")
    return docs.agg(n.alias("n_tokens")).select("n_tokens", F.greatest(F.lit(0).cast("long"), F.expr(f"(n_tokens - 1) div {seq_len}")).alias("lm_blocks"), F.expr(f"n_tokens div {seq_len}").alias("sft_blocks"))
