"""Sharding by proportional stratified interleaving.

Rows of each source are put in a seeded random order; a row's fractional rank is (rank + phase) / rows of its
source, with a phase in [0, 1) drawn once for each source (else all sources of one row would meet in the
middle). Sorted by fractional rank, every stretch of rows holds the sources in proportion, so the sequence is cut
into shards whose row counts differ by one at most.

One pass over the table leaves what the rest needs of each distinct row (id, source, size, CRC) with the number of its copies; it is written to the shared folder.
Copies stand next to each other in every order, so however many rows agree in id and text, they are one row until they get their slots.

No window covers a source or the whole table. Seeded hashes (of id and CRC: rows without an id differ by their texts) fall into 2^k ranges; a window ranks the rows of one
(source, range), and prefix sums over the few range counts turn these into ranks within the source. The same
holds for the global order, with ranges of the fractional rank. Counting the rows of such a range needs no
second pass: ranks within a source are gapless, so they are enumerated from the counts, in pieces of PIECE_ROWS that are dealt over the tasks whatever their source.

Defined cases: a null source is a source of its own; a null id counts as an empty one; a null text has size 1 and the CRC of no bytes; a text of any length is read once; repeated
rows each get a slot; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.llm.common import checkpointed, hash60, keyed, power_of_two, shuffle_partitions, table

#: Rows that one range holds on average, beyond which there are more ranges.
RANGE_ROWS = 200_000
#: Rows that one row of counts is enumerated to at most; copies likewise.
PIECE_ROWS = 10_000


def interleaved_shards(docs: DataFrame, n_shards: int = 8, seed: str = "shard-1", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row for each row of docs: id, size, text_crc32, law, shard, slot, grown_shard, and the source's key."""
    if n_shards < 1:
        raise ValueError("n_shards must be 1 at least")
    spark = docs.sparkSession
    read = docs.select(F.col(id_col).alias("__id"), keyed(F.col(source_col)).alias("__src"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    read = read.select("__id", "__src", (F.octet_length("__text") + 1).cast("long").alias("__size"), F.crc32(F.encode("__text", "UTF-8")).alias("__crc"))
    rows = checkpointed(read.groupBy("__id", "__src", "__size", "__crc").agg(F.count(F.lit(1)).alias("__copies")))
    total = rows.agg(F.sum("__copies")).first()[0] or 0
    ranges = power_of_two(max(shuffle_partitions(spark), -(-total // RANGE_ROWS)))
    bits = ranges.bit_length() - 1

    rows = rows.withColumn("__h", hash60(seed, F.col("__id"), F.col("__crc"))).withColumn("__r", F.shiftright("__h", 60 - bits))

    by_source = Window.partitionBy("__src")
    before = by_source.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        rows.groupBy("__src", "__r").agg(F.sum("__copies").alias("__n"))
        .withColumn("__first", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .withColumn("__all", F.sum("__n").over(by_source))
        .withColumn("__phase", F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|phase|"), F.col("__src"))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0))
    )

    def fraction(rank):
        return (rank + F.col("__phase")) / F.col("__all")

    def stretch(frac):
        return F.least(F.floor(frac * ranges), F.lit(ranges - 1)).cast("long")

    def enumerated(df, n):
        """df with __k = 0 ... n - 1: first in pieces, which are dealt out, then one by one."""
        pieces = df.withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / PIECE_ROWS))))
        dealt = pieces.repartition(shuffle_partitions(spark), *df.columns, "__piece")
        return dealt.withColumn("__k", F.explode(F.sequence(F.col("__piece") * PIECE_ROWS, F.least(n, (F.col("__piece") + 1) * PIECE_ROWS) - 1))).drop("__piece")

    after = Window.orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)  # over the ranges' counts: as many rows as there are ranges
    starts = (
        enumerated(counts, F.col("__n"))
        .groupBy(stretch(fraction(F.col("__first") + F.col("__k"))).alias("__g")).agg(F.count(F.lit(1)).alias("__m"))
        .withColumn("__start", F.coalesce(F.sum("__m").over(after), F.lit(0))).select("__g", "__start")
    )

    within = Window.partitionBy("__src", "__r").orderBy("__h", "__id", "__size", "__crc").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("__before", F.coalesce(F.sum("__copies").over(within), F.lit(0))).join(counts.select("__src", "__r", "__first", "__all", "__phase"), ["__src", "__r"])
    once = ranked.where("__copies = 1").withColumn("__k", F.lit(0).cast("long"))
    several = enumerated(ranked.where("__copies > 1"), F.col("__copies"))
    ranked = once.unionByName(several).withColumn("__frac", fraction(F.col("__first") + F.col("__before") + F.col("__k"))).withColumn("__g", stretch(F.col("__frac")))
    order = Window.partitionBy("__g").orderBy("__frac", "__src", "__h", "__id", "__size", "__crc")
    placed = ranked.withColumn("__k", F.row_number().over(order)).join(starts, "__g").withColumn("__pos", F.col("__start") + F.col("__k") - 1)
    shard = F.floor(F.col("__pos") * n_shards / F.lit(max(1, total))) if total >= 1 << 50 else F.expr(f"__pos * {n_shards} div {max(1, total)}")
    return placed.withColumn("shard", shard.cast("int")).select(
        F.col("__id").alias(id_col),
        F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        (F.col("__pos") - F.expr(f"(shard * {max(1, total)}L + {n_shards - 1}) div {n_shards}")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op1_sharding(spark, sf_dir):
    return interleaved_shards(table(spark, sf_dir, "documents"))


#: The CRC is summed from blocks of 512 bytes, counted from the end: a block's own CRC times x^(4096 j) in GF(2)[x],
#: where the first block starts from all ones. Within a block it runs over half bytes, low half first.
SQL = """
WITH RECURSIVE poly AS (SELECT list_transform(range(16), lambda i: list_reduce([i, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
power(j, v) AS (
  SELECT 0, CAST(2147483648 AS BIGINT)
  UNION ALL
  SELECT j + 1, list_reduce(list_prepend(v, range(4096)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FROM power
  WHERE j < (SELECT max(strlen(text)) // 512 FROM documents)),
powers AS (
  SELECT j, list_transform(range(32), lambda i: list_reduce(list_prepend(v, range(i)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS xs FROM power),
base AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE concat('v', source) END AS src, coalesce(text, '') AS txt, row_number() OVER () AS rid
  FROM documents),
blocks AS (
  SELECT rid, len, j, greatest(1, (len + 511) // 512) - 1 = j AS first, hx[greatest(0, len - 512 * (j + 1)) * 2 + 1 : (len - 512 * j) * 2] AS b
  FROM (SELECT rid, strlen(txt) AS len, hex(encode(txt)) AS hx, unnest(range(greatest(1, (strlen(txt) + 511) // 512))) AS j FROM base)),
block_crcs AS (
  SELECT rid, j, list_reduce(list_prepend(CASE WHEN first THEN 4294967295 ELSE 0 END, list_transform(range(strlen(b)), lambda i: CAST(instr('0123456789ABCDEF', b[i + 1 + (CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END)]) - 1 AS BIGINT))),
                             lambda c, x: xor(c >> 4, t[(xor(c, x) & 15) + 1])) AS c
  FROM blocks CROSS JOIN poly),
crcs AS (
  SELECT rid, xor(bit_xor(list_reduce(list_transform(range(32), lambda i: CASE WHEN (c >> (31 - i)) & 1 = 1 THEN xs[i + 1] ELSE 0 END), lambda a, x: xor(a, x))), 4294967295) AS crc
  FROM block_crcs JOIN powers USING (j) GROUP BY rid),
summed AS (
  SELECT doc_id, src, CAST(concat('0x', substr(md5(concat('shard-1|', coalesce(CAST(doc_id AS VARCHAR), ''), '|', crc)), 1, 15)) AS BIGINT) AS h, CAST(strlen(txt) + 1 AS BIGINT) AS size, crc
  FROM base JOIN crcs USING (rid)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY h, doc_id, size, crc) - 1 AS k, count(*) OVER (PARTITION BY src) AS n,
         CAST(concat('0x', substr(md5(concat('shard-1|phase|', src)), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS phase
  FROM summed),
placed AS (
  SELECT *, row_number() OVER (ORDER BY (k + phase) / n, src, h, doc_id, size, crc) - 1 AS pos, count(*) OVER () AS total FROM ranked)
SELECT doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law, CAST(pos * 8 // total AS INTEGER) AS shard,
       CAST(pos - (pos * 8 // total * total + 7) // 8 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed
"""
