"""Source divergence audit by systolic rotation.

Each group - a source within a language - is a vector of smoothed term shares over the terms that its language keeps. Terms are dealt over blocks of BLOCK_TERMS at most, by hash, and a group's
vector lies in pieces, one for each block, so no task ever holds a whole vocabulary. Groups are dealt over teams of about TEAM, by hash. The pieces of a team in one block are at home in one
partition and stay there; compressed copies of them circulate: in each round of a round-robin tournament teams meet in pairs, one of the two travels to the other, and every meeting
gives the value of each pair of groups in both directions. A last round is that of each team with itself. ROUNDS_AT_ONCE rounds are one job, so of each piece so many copies travel at once, however
many sources there are. Pieces of a pair's value are summed over blocks.

The terms in which a group stands out are ranked where its pieces are made, by a heap for each piece that keeps the best TOP; only these meet in the ranking of the group.

Arithmetic is exact: shares are integers, divided as decimals in Spark, summed as longs.

Defined cases: null text, lang and source are empty strings; every row is a document, repeated ones too; a group without terms, or whose language keeps none, has its partners all the same (value 0 where
no term is kept); a language of one source has no pairs; very long texts are counted whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.llm.common import checkpointed, join_small, remove, table, written

MIN_DOCS, TOP, SCALE, PRIOR = 30, 50, 1_000_000_000, 5
#: Terms in a block (about, as terms are dealt by hash); groups in a team (about).
BLOCK_TERMS, TEAM = 4096, 8
#: Rounds of the tournament that one job plays.
ROUNDS_AT_ONCE = 8
#: Counted terms that a task holds before it hands them over.
HELD_TERMS = 200_000

_terms = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs: for every group, and with a null term for the group itself."""
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches):
        found: dict = {}
        held = 0

        def flush():
            for (lang, source), (n, docs) in found.items():
                terms = list(docs)
                many = len(terms)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * many, pa.string()), pa.array([source] * many, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([n[t] for t in terms], pa.int64()), pa.array([docs[t] for t in terms], pa.int64())], names=names
                )
            found.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                n, docs = found.setdefault((lang, source), (Counter(), Counter()))
                before = len(docs)
                own = Counter(_terms.findall(text.as_py().lower()))  # of bytes: A-Z only
                n.update(own)
                docs.update(own.keys())
                docs[None] += 1
                held += len(docs) - before
                if held > HELD_TERMS:
                    yield from flush()
                    held = 0
        yield from flush()

    read = [F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    rows = docs.select(*read).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), exactly; 0 where the language keeps no term."""
    wide = lambda c: c.cast("decimal(20,0)")
    part = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(count + PRIOR), wide(total + PRIOR * terms))
    return F.when(terms > 0, part + 1).otherwise(F.lit(0)).cast("long")


def pack(slots: np.ndarray, shares: np.ndarray) -> bytes:
    """Terms of a piece by slot, ascending: gaps between slots and shares, compressed."""
    return zlib.compress(np.diff(slots, prepend=0).astype("<u4").tobytes() + shares.astype("<i8").tobytes(), 1)


def unpack(data: bytes | None, absent: int, width: int) -> np.ndarray:
    """A piece's shares by slot; terms that the group doesn't have get its share of absent ones."""
    out = np.full(width, absent, dtype=np.int64)
    if data is not None:
        raw = zlib.decompress(data)
        many = len(raw) // 12
        out[np.cumsum(np.frombuffer(raw, "<u4", many).astype(np.int64))] = np.frombuffer(raw, "<i8", many, 4 * many)
    return out


def make_pieces(rows: DataFrame, top: int) -> DataFrame:
    """lang, source, block, piece, best: the compressed piece of each group in each block where it has terms, and its top terms there."""

    def run(key, part):
        lang, source, block = (k.as_py() for k in key)
        part = part.sort_by("slot")
        p, q = part["p"].to_numpy(), part["q"].to_numpy()
        over = np.flatnonzero(p > q)
        terms = part["term"].take(pa.array(over)).cast(pa.binary()).to_pylist()
        best = heapq.nsmallest(top, zip((q[over] - p[over]).tolist(), terms))  # the larger value first, then the smaller bytes
        kind = pa.list_(pa.struct([("item", pa.string()), ("value", pa.int64())]))
        out = [[lang], [source], [block], [pack(part["slot"].to_numpy(), p)], pa.array([[{"item": t.decode(), "value": -v} for v, t in best]], kind)]
        return pa.table(out, names=["lang", "source", "block", "piece", "best"]).cast(pa.schema([("lang", pa.string()), ("source", pa.string()), ("block", pa.int32()), ("piece", pa.binary()), ("best", kind)]))

    schema = "lang string, source string, block int, piece binary, best array<struct<item: string, value: long>>"
    return rows.select("lang", "source", "block", "slot", "term", "p", "q").groupBy("lang", "source", "block").applyInArrow(run, schema)


def meeting_place(team: Column, teams: Column, round_: Column) -> Column:
    """The team that a team travels to in a round, null if it stays at home or has no partner.

    With m teams (a bye makes an odd number even), i and j meet in round r of m - 1 if i + j is r modulo m - 1; who would meet itself meets the last one.
    Round m - 1 is that of each team with itself.
    """
    even = (teams + F.pmod(teams, F.lit(2))).cast("int")
    cycle = even - 1
    plain = F.pmod(round_ - team, cycle)
    # the last team meets x with 2 * x = r modulo m - 1
    partner = F.when(team == cycle, F.pmod(round_ * F.floor(even / 2), cycle)).when(plain == team, cycle).otherwise(plain).cast("int")
    travels = (team < partner) == (F.pmod(team + partner, F.lit(2)) == 1)
    return F.when(round_ == cycle, team).when((partner < teams) & travels, partner)


def meet(key, home, visitors):
    """Both directions of every pair of a group at home and a visitor: lang, source, item, value in one block."""
    names = ["lang", "source", "item", "value"]
    out: list = [[], [], []]
    if home.num_rows and visitors.num_rows:
        width = max(home["width"][0].as_py(), 1)
        own = home["source"].to_pylist()
        rows = np.stack([unpack(x, a, width) for x, a in zip(home["piece"].to_pylist(), home["absent"].to_pylist())])
        place = home["team"][0].as_py()
        for source, team, piece, absent in zip(*(visitors[f"visitor_{c}"].to_pylist() for c in ("source", "team", "piece", "absent"))):
            values = np.abs(rows - unpack(piece, absent, width)).sum(axis=1).tolist()
            for other, v in zip(own, values):
                if team != place or other < source:  # within a team each pair meets once
                    for a, b in ((other, source), (source, other)):
                        out[0].append(a), out[1].append(b), out[2].append(v)
    lang = key[0].as_py()
    return pa.table([pa.array([lang] * len(out[0]), pa.string()), pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=names)


def tournament(home: DataFrame, rounds: int) -> DataFrame:
    """lang, source, item, value of all pairs of groups of a language, from their pieces in every block."""
    home = home.repartition("lang", "block", "team").persist(StorageLevel.MEMORY_AND_DISK)  # made again from what is written, if an executor is lost
    played = []
    try:
        for first in range(0, rounds, ROUNDS_AT_ONCE):
            each = F.sequence(F.lit(first), F.least(F.lit(first + ROUNDS_AT_ONCE - 1), (F.col("teams") + F.pmod(F.col("teams"), F.lit(2)) - 1).cast("int")))
            there = home.where(F.col("teams") + F.pmod(F.col("teams"), F.lit(2)) - 1 >= first).withColumn("round", F.explode(each))
            there = there.withColumn("place", meeting_place(F.col("team"), F.col("teams"), F.col("round"))).where("place IS NOT NULL")
            visitors = there.select(*[F.col(c).alias(f"visitor_{c}") for c in ("lang", "block", "place", "source", "team", "piece", "absent")])
            met = home.groupBy("lang", "block", "team").cogroup(visitors.groupBy("visitor_lang", "visitor_block", "visitor_place")).applyInArrow(meet, "lang string, source string, item string, value long")
            played.append(checkpointed(met.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))))
    finally:
        home.unpersist()
    all_rounds = played[0]
    for more in played[1:]:
        all_rounds = all_rounds.unionByName(more)
    return all_rounds


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    spark = docs.sparkSession
    counts, counts_at = written(term_counts(docs, text_col, lang_col, source_col), "terms")
    terms = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    terms = checkpointed(terms.drop("docs"))
    sources = checkpointed(counts.where("term IS NULL").select("lang", "source"))
    langs = sources.groupBy("lang").agg(F.count(F.lit(1)).alias("groups")).join(terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total")), "lang", "left")
    least = lambda c, per: F.greatest(F.lit(1), F.ceil(c / per)).cast("int")
    langs = langs.fillna(0, ["v", "lang_total"]).withColumns({"blocks": least(F.col("v"), BLOCK_TERMS), "teams": least(F.col("groups"), TEAM)})
    langs = checkpointed(langs)

    placed = join_small(terms, langs.select("lang", "v", "lang_total", "blocks"), "lang", F.col("term"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")).withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("v")))
    placed = placed.withColumn("slot", F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1).select("lang", "term", "block", "slot", "q")
    kept, kept_at = written(counts.drop("docs").join(placed, ["lang", "term"]), "kept-terms")
    blocks = kept.groupBy("lang", "block").agg((F.max("slot") + 1).alias("width"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = join_small(sources.join(totals, ["lang", "source"], "left").fillna(0, ["total"]), langs, "lang", F.col("source"))
    groups = checkpointed(groups.withColumn("team", F.pmod(F.xxhash64("source"), F.col("teams")).cast("int")).withColumn("absent", share(F.lit(0), F.col("total"), F.col("v"))))

    rows = join_small(kept, groups.select("lang", "source", "total", "v"), ["lang", "source"], F.col("term")).withColumn("p", share(F.col("n"), F.col("total"), F.col("v")))
    pieces, pieces_at = written(make_pieces(rows, top), "pieces")
    best = checkpointed(pieces.select("lang", "source", F.inline("best")))

    home = groups.select("lang", "source", "team", "teams", "absent", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    home = home.join(blocks, ["lang", "block"], "left").join(pieces.drop("best"), ["lang", "source", "block"], "left").fillna(0, ["width"])
    most = langs.agg(F.max("teams")).first()[0]
    pairs = tournament(home, most + most % 2) if most else spark.createDataFrame([], "lang string, source string, item string, value long")
    for path in (counts_at, kept_at, pieces_at):
        remove(spark, path)

    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    parts = [rows.select("lang", "source", F.lit(name).alias("part"), "item", "value", ranked.alias("rank")) for name, rows in (("pair", pairs), ("term", best))]
    return parts[0].unionByName(parts[1].where(F.col("rank") <= top))


def op13_source_divergence(spark, sf_dir):
    return divergence(table(spark, sf_dir, "documents"))


SQL = r"""
WITH base AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
words AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM base),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
counts AS MATERIALIZED (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY w.lang, w.source, w.term),
langs AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM base),
totals AS (SELECT lang, source, sum(n) AS n FROM counts GROUP BY lang, source),
shares AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(s.n, 0) + 5 * l.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 5)) // (l.n + 5 * l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN totals s ON s.lang = g.lang AND s.source = g.source),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
found AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found) WHERE part = 'pair' OR rank <= 50
"""
