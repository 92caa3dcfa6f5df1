"""Quality rules with cross-document line frequency.

Pass 1 hashes every normalised line (A-Z lower-cased, digit runs as 0, white space runs as one space) and counts, for each host,
the distinct documents that hold it; documents of equal text count as one. A line is above its limits if more than
max_docs documents of the host and more than max_share of the host's distinct documents hold it. Both limits are applied to rows of (host, line), before anything is
put together for a host; then at most (lines a document) / max_share lines of a host are left.

Pass 2 reads the table again, with the lines above limits beside: up to BROADCAST_LINES of all hosts go to every task once, beyond that each host's are joined to its rows.
It removes these lines, and judges: the base rules on
the whole text, then depletion - a document is rejected if its other lines hold fewer than min_words words, or
less than min_left of its words.

Base rules: fewer than 10 words, or over 20 % of words in 5-word windows that the text repeats.

Defined cases: null and empty texts have no words and fail the base rules; a null host is a host of its own; repeated rows
are judged alike; lines without a word are never counted and stay in cleaned texts; very long texts and lines are hashed and counted whole, one text at a time; an empty table gives no rows;
other columns are ignored (rules) or stay (cleaned documents).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import checkpointed, join_small, keyed, table

MAX_DOCS, MAX_SHARE, MIN_WORDS, MIN_LEFT = 10, 0.05, 10, 0.3
#: Lines above limits (a host and a long each) that are broadcast, of all hosts together.
BROADCAST_LINES = 100_000
WINDOW = 5

_digits = re.compile(rb"[0-9]+")
_symbols = re.compile(r"[#*$%&|<>]")


def line_hash(line: bytes) -> int | None:
    """A signed long for the normalised line, None for a line without a word."""
    words = line.lower().split()
    if not words:
        return None
    h = xxhash.xxh64_intdigest(_digits.sub(b"0", b" ".join(words)), 42)
    return h - (1 << 64) if h >> 63 else h


def words_in_repeats(words: list, window: int = WINDOW) -> int:
    """Words that lie in a window of so many words found twice or more, the first one included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
    rank = codes  # of the window that begins at each word, one word longer each time
    for k in range(1, window):
        pair = rank[:-1] * len(words) + codes[k:]
        rank = np.unique(pair, return_inverse=True)[1]
    often = np.bincount(rank)[rank] > 1
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(covered, np.flatnonzero(often), 1)
    np.add.at(covered, np.flatnonzero(often) + window, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8", "replace").split()
    chars = sum(len(w.decode("utf-8")) for w in words) if not text.isascii() else sum(map(len, words))
    seen, dups = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dups += 1
        elif line.encode("utf-8", "replace").strip():
            seen.add(line)
    return len(words), chars, len(_symbols.findall(text)), dups, words_in_repeats(words)


def lines_above_limits(docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """__host, __line: the hash of each line that is above its host's limits."""

    def run(batches):
        for batch in batches:
            lines, whole = [], []
            for t in batch.column(1):
                data = (t.as_py() or "").encode("utf-8", "replace")
                whole.append(xxhash.xxh64_intdigest(data, 7) - (1 << 63))
                lines.append({h for h in map(line_hash, data.split(b"\n")) if h is not None})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(whole, pa.int64()), pa.array(map(list, lines), pa.list_(pa.int64()))], names=["__host", "__doc", "__lines"])

    found = docs.select(keyed(F.col(host_col)).alias("__host"), F.col(text_col).alias("__text")).mapInArrow(run, "__host string, __doc long, __lines array<long>")
    # null stands for the document itself, so that the same pass counts a host's documents
    lines = found.select("__host", "__doc", F.explode(F.concat(F.array(F.lit(None).cast("long")), "__lines")).alias("__line")).distinct()
    counts = checkpointed(lines.groupBy("__host", "__line").agg(F.count(F.lit(1)).alias("n")).where(F.col("__line").isNull() | (F.col("n") > max_docs)))
    hosts = counts.where("__line IS NULL").select("__host", F.col("n").alias("docs"))
    return counts.where("__line IS NOT NULL").join(hosts, "__host").where(F.col("n") > F.col("docs") * max_share).select("__host", "__line")


VERDICT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_removed_lines long, n_words_left long, base_failed boolean, kept boolean, __clean string"


def judge(text: str | None, hot, min_words: int, min_left: float) -> tuple:
    text = text or ""
    counts = base_counts(text)
    base_failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
    removed, gone, clean = 0, 0, text
    if hot:
        stay = []
        for line in text.split("\n"):
            data = line.encode("utf-8", "replace")
            if line_hash(data) in hot:
                removed += 1
                gone += len(data.split())
            else:
                stay.append(line)
        clean = "\n".join(stay) if removed else text
    left = counts[0] - gone
    depleted = left < min_words or left < min_left * counts[0]
    return (*counts, removed, left, base_failed, not base_failed and not depleted, clean)


def _judged(docs: DataFrame, carry: list[str], with_text: bool, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_words: int = MIN_WORDS, min_left: float = MIN_LEFT, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The carried columns as __c0, __c1, ...; the counts and verdict of every row; the text without the lines above limits (if with_text)."""
    lines = checkpointed(lines_above_limits(docs, max_docs, max_share, text_col, host_col))
    kinds = dict(docs.dtypes)
    names = [f"__c{i}" for i in range(len(carry))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(carry, names)], F.col(text_col).alias("__text"), keyed(F.col(host_col)).alias("__host"))
    everywhere: dict[str, set] | None = None
    if lines.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES:
        everywhere = {}
        for r in lines.collect():  # BROADCAST_LINES at most
            everywhere.setdefault(r["__host"], set()).add(r["__line"])
        rows = rows.select(*names, "__text", "__host")
    else:
        hot = lines.groupBy("__host").agg(F.array_sort(F.collect_list("__line")).alias("__hot"))
        rows = join_small(rows, hot, "__host", F.col("__text")).select(*names, "__text", "__hot")
    fields = [f.split() for f in VERDICT.split(", ")][: None if with_text else -1]

    def run(batches):
        sets: dict = {}

        def of_row(h):
            if everywhere is not None:
                return everywhere.get(h.as_py(), ())
            values = h.values
            key = values.to_numpy(zero_copy_only=False).tobytes() if values is not None else b""
            if key not in sets:
                if len(sets) > 1000:
                    sets.clear()
                sets[key] = frozenset(values.to_pylist() if values is not None else ())
            return sets[key]

        for batch in batches:
            n = len(batch.schema.names)
            out = [judge(t.as_py(), of_row(h), min_words, min_left) for t, h in zip(batch.column(n - 2), batch.column(n - 1))]
            kind = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
            made = [pa.array([r[i] for r in out], kind[f[1]]) for i, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: n - 2], *made], names=[*batch.schema.names[: n - 2], *(f[0] for f in fields)])

    return rows.mapInArrow(run, ", ".join([f"{n} {kinds[c]}" for c, n in zip(carry, names)] + [" ".join(f) for f in fields]))


def judged_documents(docs: DataFrame, carry: tuple = ("doc_id",), **options) -> DataFrame:
    """The carried columns, then the counts and verdict of every row."""
    judged = _judged(docs, list(carry), False, **options)
    return judged.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)], *[f.split()[0] for f in VERDICT.split(", ")[:-1]])


def kept_documents(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", **limits) -> DataFrame:
    """The documents that stay, without their lines above limits; same columns as docs (the length follows the text)."""
    carry = [c for c in docs.columns if c != text_col]
    made = {text_col: F.col("__clean"), length_col: F.length("__clean").cast("long")}
    judged = _judged(docs, carry, True, text_col=text_col, **limits).where("kept")
    return judged.select(*[(made[c] if c in made else F.col(f"__c{carry.index(c)}")).alias(c) for c in docs.columns])


def op2_quality_rules(spark, sf_dir):
    return judged_documents(table(spark, sf_dir, "documents"))


SQL = r"""
WITH base AS (SELECT row_number() OVER () AS rid, doc_id, CASE WHEN source IS NULL THEN 'n' ELSE concat('v', source) END AS host, coalesce(text, '') AS t FROM documents),
words AS (SELECT rid, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) AS p FROM base),
grams AS (SELECT *, CASE WHEN lead(p, 4) OVER o IS NOT NULL THEN concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) END AS g FROM words WINDOW o AS (PARTITION BY rid ORDER BY p)),
often AS (SELECT rid, p, w, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY rid, g) > 1 THEN 1 ELSE 0 END AS twice FROM grams),
covered AS (SELECT rid, w, max(twice) OVER (PARTITION BY rid ORDER BY p ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM often),
word_counts AS (SELECT rid, count(*) AS n_words, sum(length(w)) AS word_chars, sum(c) AS n_repeat_words FROM covered GROUP BY rid),
lines AS (SELECT rid, host, t, unnest(string_split(t, chr(10))) AS l FROM base),
worded AS (
  SELECT *, trim(regexp_replace(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm,
         len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n
  FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dups AS (SELECT rid, count(*) - count(DISTINCT l) AS n_dup_lines FROM worded GROUP BY rid),
host_docs AS (SELECT host, count(DISTINCT t) AS d FROM base GROUP BY host),
hot AS (SELECT host, norm FROM worded JOIN host_docs USING (host) GROUP BY host, norm HAVING count(DISTINCT t) > 10 AND count(DISTINCT t) > max(d) * 0.05),
gone AS (SELECT rid, count(*) AS n_removed_lines, sum(n) AS gone FROM worded JOIN hot USING (host, norm) GROUP BY rid),
counted AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_removed_lines, 0) AS n_removed_lines, coalesce(n_words, 0) - coalesce(gone, 0) AS n_words_left
  FROM base LEFT JOIN word_counts USING (rid) LEFT JOIN dups USING (rid) LEFT JOIN gone USING (rid)),
failed AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       n_removed_lines::BIGINT AS n_removed_lines, n_words_left::BIGINT AS n_words_left, base_failed,
       NOT base_failed AND NOT (n_words_left < 10 OR n_words_left < 0.3 * n_words) AS kept
FROM failed
"""
