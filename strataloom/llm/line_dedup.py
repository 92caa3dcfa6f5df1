"""Line deduplication across documents.

Pass 1 splits every text at line feeds, and normalises and hashes each line (white space stripped at both ends, A-Z lower-cased, 128 bits): one narrow row for each line that is long enough,
with the row it lies in and its position. Lines are counted by distinct documents, first for each (line, document) and then for each line, with partial sums on both ways, so that a line
that every document holds costs no task more. A line in min_docs documents or more is over the threshold; it stays in the document with the smallest id (keep_first) or nowhere.

The positions to drop come from a join of line rows with lines over the threshold. Of the latter, those with a HEAVY-th of all line rows or more - HEAVY at most, by counting -
are broadcast, so no key of the shuffled join has more than that share. Texts move once, to meet the positions that go, and are put together from what stays, by position.

Defined cases: a null or empty text is one empty line; a document is all rows of one id, and rows without an id are one document, which comes after all others; repeated rows lose
the same lines; equal lines within the one document that keeps them all stay; a text that loses all lines is empty; very long texts are split and put together whole; an empty table
gives no rows; other columns are ignored unless carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import checkpointed, remove, table, written

MIN_CHARS, MIN_DOCS = 10, 2
#: Lines with this part of all line rows or more are broadcast; there can't be more of them than this.
HEAVY = 10_000
#: Line rows that are handed over at once.
CHUNK = 100_000


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The normalised line, None if it has fewer than min_chars code points."""
    key = line.strip().lower()  # of bytes: ASCII white space and A-Z only
    if len(key) < min_chars or (len(key) < 4 * min_chars and not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return key


def line_rows(rows: DataFrame, min_chars: int) -> DataFrame:
    """__id, __r1, __r2, pos, h1, h2 for every line that is long enough, from __id, __r1, __r2, __text."""
    names = ["__id", "__r1", "__r2", "pos", "h1", "h2"]

    def run(batches):
        for batch in batches:
            ids = batch.select(names[:3])
            at, pos, digests = [], [], []

            def flush():
                h = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
                own = ids.take(pa.array(at, pa.int64()))
                out = pa.RecordBatch.from_arrays([*own.columns, pa.array(pos, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1])], names=names)
                at.clear(), pos.clear(), digests.clear()
                return out

            for i, t in enumerate(batch.column(3).cast(pa.binary())):
                for p, line in enumerate((t.as_py() or b"").split(b"\n")):
                    key = line_key(line, min_chars)
                    if key is not None:
                        at.append(i), pos.append(p), digests.append(xxhash.xxh3_128_digest(key))
                        if len(at) == CHUNK:
                            yield flush()
            if at:
                yield flush()

    kind = dict(rows.dtypes)["__id"]
    return rows.select("__id", "__r1", "__r2", "__text").mapInArrow(run, f"__id {kind}, __r1 long, __r2 long, pos int, h1 long, h2 long")


def lines_over(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """h1, h2, first, rows: every line in min_docs documents or more, its smallest document and its rows."""
    by_doc = lines.groupBy("h1", "h2", "__id").agg(F.count(F.lit(1)).alias("rows"))
    counted = by_doc.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.min("__id").alias("first"), F.sum("rows").alias("rows"))
    return counted.where(F.col("docs") >= min_docs).select("h1", "h2", "first", "rows")


def dropped_positions(lines: DataFrame, over: DataFrame, keep_first: bool = True) -> DataFrame:
    """__r1, __r2, gone: the positions that each row loses."""
    heavy_from = max(1, -(-lines.count() // HEAVY))
    heavy = F.broadcast(over.where(F.col("rows") >= heavy_from))
    light = over.where(F.col("rows") < heavy_from)
    hits = lines.join(heavy, ["h1", "h2"]).unionByName(lines.join(heavy, ["h1", "h2"], "left_anti").join(light, ["h1", "h2"]))
    if keep_first:
        hits = hits.where(~F.col("__id").eqNullSafe(F.col("first")))
    return hits.groupBy("__r1", "__r2").agg(F.collect_set("pos").alias("gone"))


def without_repeated_lines(docs: DataFrame, carry: tuple = ("doc_id",), min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, keep_first: bool = True, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The carried columns, n_lines and n_dropped (longs), and kept: the text without its dropped lines."""
    spark = docs.sparkSession
    kinds, names = dict(docs.dtypes), [f"__c{i}" for i in range(len(carry))]
    text = F.coalesce(F.col(text_col), F.lit(""))
    # a row is known by 128 bits of its id and text; rows that share them lose the same lines
    row = [F.xxhash64(F.lit(k), F.col(id_col), text).alias(f"__r{k}") for k in (1, 2)]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(carry, names)], F.col(id_col).alias("__id"), text.alias("__text"), *row)
    lines, folder = written(line_rows(rows, min_chars), "lines")
    over = checkpointed(lines_over(lines, min_docs))
    gone = checkpointed(dropped_positions(lines, over, keep_first))
    remove(spark, folder)

    def run(batches):
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for t, g in zip(batch.column(len(carry)).cast(pa.binary()), batch.column(len(carry) + 1)):
                data = t.as_py()
                n_lines.append(data.count(b"\n") + 1)
                n_dropped.append(len(g) if g.is_valid else 0)
                if g.is_valid:
                    out = set(g.as_py())
                    data = b"\n".join([line for p, line in enumerate(data.split(b"\n")) if p not in out])
                kept.append(data)
            made = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], *made], names=[*names, "n_lines", "n_dropped", "kept"])

    joined = rows.join(gone, ["__r1", "__r2"], "left").select(*names, "__text", "gone")
    cleaned = joined.mapInArrow(run, ", ".join([f"{n} {kinds[c]}" for c, n in zip(carry, names)] + ["n_lines long, n_dropped long, kept string"]))
    return cleaned.select(*[F.col(n).alias(c) for c, n in zip(carry, names)], "n_lines", "n_dropped", "kept")


def op11_line_dedup(spark, sf_dir):
    cleaned = without_repeated_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH base AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
lines AS (SELECT rid, doc_id, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS p FROM base),
keyed AS (SELECT *, translate(regexp_replace(l, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
over AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 2),
judged AS (SELECT keyed.*, over.k IS NOT NULL AND doc_id IS DISTINCT FROM first AS dropped FROM keyed LEFT JOIN over ON keyed.k = over.k)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped, sha256(coalesce(string_agg(l, chr(10) ORDER BY p) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY rid
"""
