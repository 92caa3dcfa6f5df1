"""Byte-level BPE learnt from pre-token counts: training, encoding, decoding, and reports.

Counting pre-tokens is distributed. A few distinct ones are merged on the driver; more stay with the executors, in blocks of symbols that are rewritten round
after round, and the driver holds the totals of pairs alone, which the vocabulary bounds. A round makes as many merges as are certain to come next whatever
the ones before do. Documents are encoded by an Arrow UDF that remembers the pre-tokens it met last.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from strataloom.functions.text import ratio, word_count
from strataloom.functions.tokens import PRETOKEN, pretoken_counts
from strataloom.sources import shared

END_OF_TEXT = "<|endoftext|>"
REMEMBERED = 200_000
#: Distinct pre-tokens and bytes of them that the driver merges by itself; symbols of a block, and bytes of pre-tokens in a partition, where executors do.
DRIVER_WORDS, DRIVER_BYTES, BLOCK, PART_BYTES = 100_000, 2 << 20, 1 << 20, 2 << 20


def merged_parts(data: bytes, ranks: dict) -> list[bytes]:
    """data's bytes, joined by the pair of the lowest rank (the leftmost of equal ones) until no pair has a rank.

    Parts are linked with their neighbours and pairs wait in a heap, so a piece of n bytes takes n log n steps.
    """
    parts: list = [bytes([b]) for b in data]
    after = [*range(1, len(parts)), -1] if parts else []
    before = list(range(-1, len(parts) - 1))
    heap = [(rank, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (rank := ranks.get((a, b))) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if parts[i] == a else -1
        if j < 0 or parts[j] != b:  # one of them has been joined meanwhile
            continue
        parts[i], parts[j] = a + b, None
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right >= 0 and (rank := ranks.get((parts[left], parts[right]))) is not None:
                heapq.heappush(heap, (rank, left, parts[left], parts[right]))
    return [p for p in parts if p is not None]


@dataclass
class Tokenizer:
    """vocab: the bytes of each id; merges in order of rank; special tokens are matched exactly before anything else."""

    vocab: list[bytes] = field(default_factory=list)
    merges: list[tuple[bytes, bytes]] = field(default_factory=list)
    specials: list[str] = field(default_factory=list)

    @cached_property
    def ids(self) -> dict[bytes, int]:
        return {token: i for i, token in enumerate(self.vocab)}  # of equal tokens the last

    @cached_property
    def ranks(self) -> dict[tuple[bytes, bytes], int]:
        return {pair: rank for rank, pair in enumerate(self.merges)}

    @cached_property
    def _splitter(self):
        return regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None

    @cached_property
    def _pieces(self):
        return regex.compile(PRETOKEN)

    @cached_property
    def _known(self) -> dict[str, list[int]]:
        return {}

    def merge_piece(self, piece: str) -> list[int]:
        found = self._known.get(piece)
        if found is None:
            found = [self.ids[p] for p in merged_parts(piece.encode("utf-8", "replace"), self.ranks)]
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            self._known[piece] = found
        return found

    def encode(self, text: str) -> list[int]:
        if not self.vocab:
            raise ValueError("the tokenizer has no vocabulary; train or load one")
        out: list[int] = []
        for k, part in enumerate(self._splitter.split(text) if self._splitter else [text]):
            if k % 2:
                out.append(self.ids[part.encode()])
            else:
                for piece in self._pieces.findall(part):
                    out += self.merge_piece(piece)
        return out

    def decode(self, ids) -> str:
        return b"".join(self.vocab[i] for i in ids).decode("utf-8", errors="replace")

    def save(self, path: str) -> None:
        text = lambda b: b.decode("latin-1")  # noqa: E731  one character for each byte
        with open(path, "w", encoding="utf-8") as f:
            json.dump({"version": "1", "pretoken_pattern": PRETOKEN, "special_tokens": self.specials, "vocab": [text(t) for t in self.vocab], "merges": [[text(a), text(b)] for a, b in self.merges]}, f)

    @classmethod
    def load(cls, path: str) -> Tokenizer:
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        return cls([t.encode("latin-1") for t in d["vocab"]], [(a.encode("latin-1"), b.encode("latin-1")) for a, b in d["merges"]], d.get("special_tokens", []))

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """vocab(id, token) and merges(rank, left, right)."""
        vocab = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(self.vocab)], "id int, token binary")
        return vocab, spark.createDataFrame([(i, bytearray(a), bytearray(b)) for i, (a, b) in enumerate(self.merges)], "rank int, left binary, right binary")


class _Words:
    """Distinct pre-tokens as symbol sequences with counts; which words hold a pair, and how often all in all."""

    def __init__(self, counts):
        self.symbols, self.n = [], []
        self.total: dict = defaultdict(int)
        self.holders: dict = defaultdict(set)
        for word, n in counts:
            self.symbols.append([bytes([b]) for b in word])
            self.n.append(n)
            for pair in zip(self.symbols[-1], self.symbols[-1][1:]):
                self.total[pair] += n
                self.holders[pair].add(len(self.n) - 1)

    def merge(self, pair) -> set:
        """Joins the pair, left to right, wherever it stands; gives the pairs whose totals have changed. Only pairs next to a joint are counted anew."""
        (a, b), joined, total, holders, touched = pair, pair[0] + pair[1], self.total, self.holders, set()
        for w in holders.pop(pair, ()):
            old, n, new, i = self.symbols[w], self.n[w], [], 0
            last = len(old) - 1
            while i <= last:
                if i < last and old[i] == a and old[i + 1] == b:
                    i += 2
                    gone, come = [], []
                    if new:
                        gone.append((new[-1], a))
                        come.append((new[-1], joined))
                    if i <= last:
                        gone.append((b, old[i]))
                        come.append((joined, old[i]))
                    for p in gone:
                        total[p] -= n
                    for p in come:
                        total[p] += n
                        holders[p].add(w)
                    touched.update(gone, come)
                    new.append(joined)
                else:
                    new.append(old[i])
                    i += 1
            self.symbols[w] = new
        total.pop(pair, None)  # it stands nowhere any more
        touched.discard(pair)
        return touched


class _Top:
    """A heap entry that puts the larger count first, then the larger pair."""

    __slots__ = ("n", "pair")

    def __init__(self, n, pair):
        self.n, self.pair = n, pair

    def __lt__(self, other):
        return (self.n, self.pair) > (other.n, other.pair)


def learn_merges(counts, vocab_size: int, specials: list[str]) -> Tokenizer:
    """From (pre-token bytes, count) to a tokenizer: the most frequent pair is merged again and again; of equal ones the larger."""
    vocab = [bytes([b]) for b in range(256)]
    for s in specials:
        if s.encode() not in vocab:
            vocab.append(s.encode())
    merges, words = [], _Words(counts)
    heap = [_Top(n, p) for p, n in words.total.items()]
    heapq.heapify(heap)
    while len(vocab) < vocab_size and heap:
        top = heapq.heappop(heap)
        now = words.total.get(top.pair, 0)
        if now != top.n or now <= 0:  # counted before a later merge
            continue
        merges.append(top.pair)
        vocab.append(top.pair[0] + top.pair[1])
        for pair in words.merge(top.pair):
            n = words.total[pair]
            if n > 0:
                heapq.heappush(heap, _Top(n, pair))
            else:
                del words.total[pair]
    return Tokenizer(vocab, merges, specials)


def sums_by_key(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of n, without those that are zero."""
    if not len(keys):
        return keys, n
    by = np.argsort(keys, kind="stable")
    keys, n = keys[by], n[by]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sums = np.add.reduceat(n, starts)
    return keys[starts][sums != 0], sums[sums != 0]


def pair_keys(symbols: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of neighbours within words, as left * 2^32 + right, and their words. Every word ends with symbol 0."""
    at = np.flatnonzero((symbols[:-1] != 0) & (symbols[1:] != 0))
    return (symbols[at].astype(np.int64) << 32) | symbols[at + 1].astype(np.int64), words[at]


def merged_block(symbols: np.ndarray, counts: np.ndarray, joins: list[tuple[int, int, int]]):
    """A block of words (each ended by symbol 0) after joins (left, right, joined) of which none touches another; pairs whose totals change, and by how much.

    Without joins: the block as it is, and the totals of its pairs.
    """
    if not joins:
        keys, of = pair_keys(symbols, np.cumsum(symbols == 0) - (symbols == 0))
        return symbols, *sums_by_key(keys, counts[of])
    joins = sorted(joins)
    left, right, new = (np.array(x, dtype=np.int64) for x in zip(*joins))
    most = max(int(symbols.max(initial=0)), int(left.max()), int(right.max())) + 1
    first, second = np.zeros(most, bool), np.zeros(most, bool)
    first[left], second[right] = True, True
    at = np.flatnonzero(first[symbols[:-1]] & second[symbols[1:]])
    wanted = (left << 32) | right
    found = (symbols[at].astype(np.int64) << 32) | symbols[at + 1].astype(np.int64)
    which = np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)
    ok = wanted[which] == found
    at, which = at[ok], which[ok]
    if not len(at):
        return symbols, np.empty(0, np.int64), np.empty(0, np.int64)
    # only a pair of equal symbols can follow itself: of such a run every other one is joined, from the left
    begins = np.concatenate([[True], at[1:] != at[:-1] + 1])
    place = np.arange(len(at))
    ok = (place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0
    at, which = at[ok], which[ok]
    ends = np.flatnonzero(symbols == 0)
    hit = np.zeros(len(ends), bool)
    hit[np.searchsorted(ends, at)] = True
    sizes = np.diff(ends, prepend=-1)
    inside = np.repeat(hit, sizes)
    word = np.repeat(np.arange(len(ends)), sizes)
    before, of_before = pair_keys(symbols[inside], word[inside])
    joined, stays = symbols.copy(), np.ones(len(symbols), bool)
    joined[at], stays[at + 1] = new[which].astype(symbols.dtype), False
    after, of_after = pair_keys(joined[stays & inside], word[stays & inside])
    return joined[stays], *sums_by_key(np.concatenate([before, after]), np.concatenate([-counts[of_before], counts[of_after]]))


def certain_merges(heap: list, totals: dict, known: dict, room: int) -> list:
    """The pairs that are merged next, at least one if there is any, as many as all follow from these totals; they leave the heap.

    A merge of (a, b) changes the counts of pairs that end with a or begin with b (touched pairs), and makes new pairs, each of which is at most as frequent as the touched pair
    that stood there. So the next best pair comes next as long as neither it nor an equally frequent one is touched. After a pair of equal symbols, or one whose joint is a symbol already, all are counted anew.
    """
    batch, ends, begins = [], set(), set()
    while heap and len(batch) < room:
        n, group = None, []
        while heap and (n is None or heap[0].n == n):
            top = heapq.heappop(heap)
            if totals.get(top.pair) == top.n and (not group or group[-1] != top.pair):
                n = top.n
                group.append(top.pair)
        touched = sum(a in ends or b in begins for a, b in group)
        lefts, rights = defaultdict(int), defaultdict(int)
        for a, b in group:
            lefts[a] += 1
            rights[b] += 1
        for k, (a, b) in enumerate(group):
            again = a + b in known
            if len(batch) == room or batch and (touched or again):
                break
            batch.append((a, b))
            lefts[a] -= 1
            rights[b] -= 1
            ends.add(b)
            begins.add(a)
            touched += lefts[b] + rights[a]
            if again or a == b:
                room = len(batch)
        else:
            continue
        for pair in group[k:]:
            heapq.heappush(heap, _Top(n, pair))
        break
    return batch


def learn_in_rounds(advance, vocab_size: int, specials: list[str]) -> Tokenizer:
    """The tokenizer that learn_merges learns. advance: takes joins (left, right, joined symbol; byte b is symbol b + 1), makes them wherever the words lie, and
    gives the changes of pair totals as (left, right, n); without joins, the totals."""
    vocab = [bytes([b]) for b in range(256)]
    named = [b"", *vocab]
    known = {token: i for i, token in enumerate(named)}
    for s in specials:
        if s.encode() not in vocab:
            vocab.append(s.encode())
    merges, heap, totals, joins = [], [], defaultdict(int), []
    while len(vocab) < vocab_size:
        changed = set()
        for a, b, n in advance(joins):
            pair = (named[a], named[b])
            totals[pair] += n
            changed.add(pair)
        for pair in changed:
            if totals[pair] > 0:
                heapq.heappush(heap, _Top(totals[pair], pair))
            else:
                del totals[pair]
        batch, joins = certain_merges(heap, totals, known, vocab_size - len(vocab)), []
        if not batch:
            break
        for a, b in batch:
            merges.append((a, b))
            vocab.append(a + b)
            if a + b not in known:
                known[a + b] = len(named)
                named.append(a + b)
            joins.append((known[a], known[b], known[a + b]))
    return Tokenizer(vocab, merges, specials)


def _blocks(kind: str):
    """Partitions of (pre-token bytes, n) as blocks of words."""

    def run(batches):
        words, counts, size = [], [], 0

        def flush():
            symbols = np.frombuffer(b"\xff".join([*words, b""]), np.uint8).astype(kind) + np.array(1, kind)  # 0xff is no byte of UTF-8
            symbols[symbols == 256] = 0
            return pa.RecordBatch.from_pydict({"symbols": pa.array([symbols.tobytes()], pa.binary()), "counts": pa.array([np.array(counts, np.int64).tobytes()], pa.binary())})

        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words.append(word)
                counts.append(n)
                size += len(word) + 1
                if size >= BLOCK:
                    yield flush()
                    words, counts, size = [], [], 0
        if words:
            yield flush()

    return run


def _advanced(kind: str, joins: list):
    """Blocks after joins, with the changes of their pairs."""

    def run(batches):
        for batch in batches:
            for symbols, counts in zip(batch.column(0), batch.column(1)):
                after, keys, n = merged_block(np.frombuffer(symbols.as_buffer(), kind), np.frombuffer(counts.as_buffer(), np.int64), joins)
                columns = {"symbols": after.tobytes(), "counts": counts.as_py(), "keys": keys.tobytes(), "n": n.tobytes()}
                yield pa.RecordBatch.from_pydict({c: pa.array([x], pa.binary()) for c, x in columns.items()})

    return run


def _changes(batches):
    """The changes of blocks, summed in a task."""
    for batch in batches:
        both = [np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in c]) for c in batch.columns]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in sums_by_key(*both)], names=["key", "n"])


def learn_distributed(counts: DataFrame, vocab_size: int, specials: list[str], n_bytes: int) -> Tokenizer:
    """learn_merges where counts (pretoken, n) lie: blocks of words in the shared folder, rewritten in each round."""
    spark, kind = counts.sparkSession, "<u2" if vocab_size < 1 << 16 else "<u4"
    parts = max(spark.sparkContext.defaultParallelism, -(-n_bytes // PART_BYTES))
    words = counts.select(F.encode("pretoken", "UTF-8").alias("word"), "n").repartition(parts, "word")
    at = shared.new(spark, "words")
    words.mapInArrow(_blocks(kind), "symbols binary, counts binary").write.parquet(at)

    def advance(joins):
        nonlocal at
        before, at = at, shared.new(spark, "words")
        schema = "symbols binary, counts binary"
        spark.read.schema(schema).parquet(before).mapInArrow(_advanced(kind, joins), f"{schema}, keys binary, n binary").write.parquet(at)
        shared.remove(spark, before)
        changes = spark.read.schema("keys binary, n binary").parquet(at).mapInArrow(_changes, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n <> 0")
        return [(r["key"] >> 32, r["key"] & 0xFFFFFFFF, r["n"]) for r in changes.collect()]  # pairs of the vocabulary, whatever the words are

    try:
        return learn_in_rounds(advance, vocab_size, specials)
    finally:
        shared.remove(spark, at)


def train(docs: DataFrame, vocab_size: int, specials: list[str] | None = None, min_frequency: int = 1, text_col: str = "text") -> Tokenizer:
    """A tokenizer of the documents. Special tokens count as ordinary text here."""
    specials = [END_OF_TEXT] if specials is None else specials
    spark, path = docs.sparkSession, shared.new(docs.sparkSession, "pretokens")
    pretoken_counts(docs, min_frequency, text_col).write.parquet(path)
    try:
        counts = spark.read.schema("pretoken string, n long").parquet(path)
        words, n_bytes = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("pretoken")), F.lit(0))).first()
        if not words:
            raise ValueError("there is no pre-token to learn from")
        if words <= DRIVER_WORDS and n_bytes <= DRIVER_BYTES:
            return learn_merges(((r["pretoken"].encode(), r["n"]) for r in counts.toLocalIterator()), vocab_size, specials)
        return learn_distributed(counts, vocab_size, specials, n_bytes)
    finally:
        shared.remove(spark, path)


def encoder(tokenizer: Tokenizer):
    """An Arrow UDF from text to ids; null gives null."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else tokenizer.encode(t))

    return run


def decoder(tokenizer: Tokenizer):
    @F.pandas_udf(StringType())
    def run(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: None if x is None else tokenizer.decode(x))

    return run


def evaluation(docs: DataFrame, tokenizer: Tokenizer, split: Column, text_col: str = "text") -> DataFrame:
    """The quality report of a tokenizer. A text is encoded and decoded in one go, and only its number of tokens and whether it came back leave Python."""

    @F.pandas_udf("t int, ok boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        found = []
        for t in texts:
            ids = tokenizer.encode(t)
            found.append((len(ids), tokenizer.decode(ids) == t))
        return pd.DataFrame(found, columns=["t", "ok"])

    t = F.coalesce(F.col(text_col), F.lit(""))
    coded = docs.withColumn("__coded", run(t))
    return _report(coded, t, F.col("__coded.t"), F.col("__coded.ok"), split)


def quality_report(docs: DataFrame, tokens: Column, back: Column, split: Column, text_col: str = "text") -> DataFrame:
    """For each split, and for all documents together ('overall'): sizes, tokens_per_byte, chars_per_token, fertility and round_trip_rate."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    return _report(docs, t, F.size(tokens), back == t, split)


def _report(docs: DataFrame, t: Column, n_tokens: Column, same: Column, split: Column) -> DataFrame:
    rows = docs.select(split.alias("split"), F.length(t).alias("c"), F.octet_length(t).alias("b"), word_count(t).alias("w"), n_tokens.alias("t"), same.cast("int").alias("ok"))
    total = lambda c: F.sum(c).cast("long")
    sums = rows.rollup("split").agg(F.count(F.lit(1)).alias("n_docs"), total("c").alias("n_chars"), total("b").alias("n_bytes"), total("t").alias("n_tokens"), total("w").alias("n_words"), total("ok").alias("n_ok"), F.grouping("split").alias("g"))
    return sums.select(
        F.when(F.col("g") == 1, "overall").otherwise(F.col("split")).alias("split"), "n_docs", "n_chars", "n_bytes", "n_tokens",
        ratio(F.col("n_tokens"), F.col("n_bytes")).alias("tokens_per_byte"), ratio(F.col("n_chars"), F.col("n_tokens")).alias("chars_per_token"),
        ratio(F.col("n_tokens"), F.col("n_words")).alias("fertility"), ratio(F.col("n_ok"), F.col("n_docs")).alias("round_trip_rate"))


def frozen(tokenizer: Tokenizer, least: int = 32_000) -> bool:
    return len(tokenizer.vocab) >= least
