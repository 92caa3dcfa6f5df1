"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint has 8 positional bytes. Fingerprints that differ in d bits differ in d bytes at most, so a link
within max_bits (at most 6 of 64) shares m = 8 - max_bits positional bytes or more: the guaranteed minimum. A posting list of
single bytes would hold 1/256 of all fingerprints, and tallying over such lists is quadratic; the index
therefore has a posting for each combination of m positions with their bytes. Two fingerprints meet in a posting exactly if their tally of shared bytes
reaches m. Where they meet, positional bytes are tallied for each pair, pairs that reach the minimum are retained, and only these are verified by their
bits. The tally also tells the first combination that a pair shares, where alone it is reported.

Equal fingerprints are one entry of the index. A posting with few entries is compared pair by pair; in a larger one a
search from entry to entry gives a spanning forest of its links, so what comes out grows with the entries and not
with their square. A posting beyond CHUNK entries is cut: each chunk is searched where it lies, and its entries are dealt
to further tasks, one for each two chunks. So no task holds more than two chunks, and no link is lost.

Several fingerprints (of different hash seeds) may stand for a text. Then a pair is a candidate if one of its fingerprints
reaches the tally by itself, and is verified by the bits that differ in all of them together: the more bits, the nearer
their share lies to the angle between the texts' shingles.

Fingerprint: the text with A-Z lower-cased, words between ASCII white space, shingles of n words joined by a space
(a shorter text is one shingle), repeats included; XXH64 with seed 42 of each; bit i is 1 if set in over half.

Defined cases: null, empty and blank texts have fingerprint zero, linked like any other; a text of any length is hashed whole, SHINGLES shingles at a time; equal rows share a component; rows with a null
id get a component (null if it has no other id); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import checkpointed, table
from strataloom.llm.components import component_labels
from strataloom.llm.overlap import SHINGLES, bit_counts, component_firsts, majority, text_key

#: Entries of a posting that are compared pair by pair, and entries that a task takes of a posting at once.
PAIRWISE, CHUNK = 12, 4096
#: Where an overlap of shingles is verified afterwards: bits in which fingerprints of candidates differ at most, and positional bytes that they share at least.
NEAR_BITS, NEAR_BYTES = 12, 3


def simhash(text: str | None, n_words: int = 4, seed: int = 42) -> int:
    """The fingerprint as a signed long."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= n_words:
        starts, ends = [0], [len(joined)]
    else:
        after = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        starts = [0, *after[: len(words) - n_words].tolist()]
        ends = (after[n_words - 1 :] - 1).tolist()
    ones, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), SHINGLES):
        ones += bit_counts(np.array([digest(joined[s:e], seed) for s, e in zip(starts[at : at + SHINGLES], ends[at : at + SHINGLES])], dtype="<u8"))
    return majority(ones, len(starts))


def fingerprints(docs: DataFrame, n_words: int = 4, id_col: str = "doc_id", text_col: str = "text", seeds: tuple = (42,)) -> DataFrame:
    """__id and a fingerprint for each seed (fp, fp1, fp2, ...) of each row of docs."""
    names = ["fp", *(f"fp{k}" for k in range(1, len(seeds)))]

    def run(batches):
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([simhash(t, n_words, seed) for t in texts], type=pa.int64()) for seed in seeds)], names=["__id", *names])

    kept = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    return kept.mapInArrow(run, ", ".join(["__id long", *(f"{n} long" for n in names)]))


def byte_masks(shared: int) -> list[int]:
    """A 64-bit mask for each combination of that many positional bytes, as signed longs."""
    masks = [sum(0xFF << (8 * p) for p in c) for c in combinations(range(8), shared)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def first_combinations(shared: int) -> np.ndarray:
    """For each set of matching positions (a bit each), the first combination that lies within it, or -1."""
    sets = [sum(1 << p for p in c) for c in combinations(range(8), shared)]
    return np.array([next((k for k, s in enumerate(sets) if s & got == s), -1) for got in range(256)], dtype=np.int64)


def differing_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Over all fingerprints of the entries a and b (last axis)."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def shared_positions(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair and fingerprint (last axis) the positions of equal bytes, a bit each; their number is the tally."""
    x = np.ascontiguousarray(a ^ b)
    return np.packbits(x.view(np.uint8).reshape(*x.shape, 8) == 0, axis=-1, bitorder="little")[..., 0]


def retained(positions: np.ndarray, shared: int) -> np.ndarray:
    """Whether the tally of a fingerprint reaches the minimum."""
    return (np.bitwise_count(positions) >= shared).any(axis=-1)


def linked_pairs(entries: np.ndarray, combo: np.ndarray, size: int, max_bits: int, shared: int, first: np.ndarray, combos: int):
    """Links between the entries of many postings of one size: entries has a row for each, combo their combination."""
    i, j = np.triu_indices(size, 1)
    n = entries.shape[2]
    a, b, combo = entries[:, i].reshape(-1, n), entries[:, j].reshape(-1, n), np.repeat(combo, len(i))
    positions = shared_positions(a, b)
    ok = np.flatnonzero(retained(positions, shared))
    ok = ok[differing_bits(a[ok], b[ok]) <= max_bits]
    a, b, combo, positions = a[ok], b[ok], combo[ok], positions[ok]
    met = np.full(len(a), -1)
    for k in range(n):
        at = first[positions[:, k]]
        met = np.where((met < 0) & (at >= 0), k * combos + at, met)
    return a[met == combo], b[met == combo]


def forest(entries: np.ndarray, max_bits: int, shared: int):
    """A spanning forest of the links among entries: every entry is reached once, from one that is linked with it."""
    left, found, reached = entries, [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = retained(shared_positions(left, at[None, :]), shared)
            near[near] = differing_bits(left[near], at) <= max_bits
            if near.any():
                new = left[near]
                left = left[~near]
                found.append(np.tile(at, (len(new), 1)))
                reached.append(new)
                queue.extend(new)
    none = np.empty((0, entries.shape[1]), np.uint64)
    return (np.concatenate(found), np.concatenate(reached)) if found else (none, none)


def out_columns(n: int) -> str:
    """The schema of links (b is null for an entry of a posting that was cut)."""
    return ", ".join([*(f"a{k} long" for k in range(n)), *(f"b{k} long" for k in range(n)), "combo int, key long, chunk int"])


def search_postings(n: int, max_bits: int, shared: int, size_limit: int | None):
    """For partitions of entries (n fingerprints each) sorted by posting: links (a, b). size_limit: a posting is cut after so many entries, and entries of such postings come out too, as (a, combo, key, chunk)."""
    first, combos, chunked = first_combinations(shared), len(byte_masks(shared)), size_limit is not None
    names = [f.split()[0] for f in out_columns(n).split(", ")]

    def rows(a, b, combo=None, key=None, chunk=None):
        size = len(a)
        longs = [pa.array(np.ascontiguousarray(a[:, k]).view(np.int64)) for k in range(n)]
        longs += [pa.nulls(size, pa.int64()) if b is None else pa.array(np.ascontiguousarray(b[:, k]).view(np.int64)) for k in range(n)]
        rest = [pa.nulls(size, kind) if x is None else pa.array([x] * size, kind) for x, kind in ((combo, pa.int32()), (key, pa.int64()), (chunk, pa.int32()))]
        return pa.RecordBatch.from_arrays([*longs, *rest], names=names)

    def run(batches):
        posting, held, chunk = None, [], 0  # the posting that may go on in the next batch

        def flush(last: bool):
            nonlocal held, chunk
            fps = np.concatenate(held) if held else np.empty((0, n), np.uint64)
            held = []
            if len(fps) > 1:
                a, b = forest(fps, max_bits, shared) if len(fps) > PAIRWISE else linked_pairs(fps[None, :], np.array([posting[0]]), len(fps), max_bits, shared, first, combos)
                if len(a):
                    yield rows(a, b)
            if len(fps) and chunked and (chunk or not last):
                yield rows(fps, None, posting[0], posting[1], chunk)
            chunk += 1

        for batch in batches:
            if not batch.num_rows:
                continue
            fps = np.stack([c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns[:n]], axis=1)
            keys = [c.to_numpy(zero_copy_only=False) for c in batch.columns[n:]]
            cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(fps)]])
            if posting != tuple(int(k[0]) for k in keys):
                if posting is not None:
                    yield from flush(True)
                posting, held, chunk = tuple(int(k[0]) for k in keys), [], 0
            if len(starts) > 1:  # what was held ends in this batch
                held.append(fps[: ends[0]])
                yield from flush(True)
                sizes = (ends - starts)[1:-1]
                for size in np.unique(sizes[(sizes > 1) & (sizes <= PAIRWISE)]).tolist():
                    of = starts[1:-1][sizes == size]
                    for at in range(0, len(of), 1 << 14):
                        part = of[at : at + (1 << 14)]
                        a, b = linked_pairs(fps[part[:, None] + np.arange(size)], keys[0][part], size, max_bits, shared, first, combos)
                        if len(a):
                            yield rows(a, b)
                for k in np.flatnonzero(sizes > PAIRWISE) + 1:
                    posting, held, chunk = tuple(int(x[starts[k]]) for x in keys), [], 0
                    whole = fps[starts[k] : ends[k]]
                    for at in range(0, len(whole), size_limit or len(whole)):
                        held = [whole[at : at + size_limit] if chunked else whole]
                        yield from flush(not chunked or at + size_limit >= len(whole))
                posting, held, chunk = tuple(int(k[-1]) for k in keys), [], 0
            tail = fps[starts[-1] :]
            while chunked and sum(map(len, held)) + len(tail) > size_limit:
                room = size_limit - sum(map(len, held))
                held.append(tail[:room])
                tail = tail[room:]
                yield from flush(False)
            held.append(tail)
        if posting is not None:
            yield from flush(True)

    return run


def entry_id(names: list[str]):
    """One long for an entry: its fingerprint, or a hash of its fingerprints."""
    return F.col(names[0]) if len(names) == 1 else F.xxhash64(*names)


def fingerprint_links(distinct: DataFrame, max_bits: int = 4, size_limit: int = CHUNK, shared: int | None = None) -> DataFrame:
    """Links a, b (entry ids) that connect every two entries within max_bits, by themselves or through others.

    distinct: distinct rows of one or more fingerprints. shared: the positional bytes that a pair has in common in one of its
    fingerprints at least. By default that is what max_bits guarantees; if fewer bytes are guaranteed, it bounds the candidates.
    """
    fps = distinct.columns
    n = len(fps)
    shared = 8 - max_bits if shared is None else shared
    if not 2 <= shared <= 8:
        raise ValueError("postings of fewer than two positional bytes are too long, and there are eight: shared must be from 2 to 8 (8 - max_bits by default)")
    masks = byte_masks(shared)
    at = F.explode(F.sequence(F.lit(0), F.lit(n * len(masks) - 1))).alias("combo")
    mask = F.element_at(F.array(*[F.lit(m).cast("long") for m in masks]), F.col("combo") % len(masks) + 1)
    of = F.col(fps[0]) if n == 1 else F.element_at(F.array(*fps), F.floor(F.col("combo") / len(masks)).cast("int") + 1)
    dealt = distinct.select(*fps, at).select(*fps, "combo", of.bitwiseAND(mask).alias("key")).repartition("combo", "key").sortWithinPartitions("combo", "key", fps[0])
    found = checkpointed(dealt.mapInArrow(search_postings(n, max_bits, shared, size_limit), out_columns(n)))
    cut = found.where("b0 IS NULL").select(*[F.col(f"a{k}").alias(fp) for k, fp in enumerate(fps)], "combo", "key", "chunk")
    chunks = cut.groupBy("combo", "key").agg((F.max("chunk") + 1).alias("k"))
    others = F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other")
    twos = cut.join(chunks, ["combo", "key"]).select(*fps, "combo", "key", "chunk", others).where("chunk <> other").select(*fps, "combo", "key", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"))
    across = twos.repartition("combo", "key", "x", "y").sortWithinPartitions("combo", "key", "x", "y", fps[0]).mapInArrow(search_postings(n, max_bits, shared, None), out_columns(n))
    ends = [entry_id([f"{end}{k}" for k in range(n)]).alias(end) for end in "ab"]
    return found.where("b0 IS NOT NULL").select(*ends).union(across.select(*ends))


def component_ids(fps: DataFrame, max_bits: int, shared: int | None = None) -> DataFrame:
    """The fingerprints and component_id of every entry of fps(__id, fp, ...): the smallest id that is reachable over links."""
    names = [c for c in fps.columns if c != "__id"]
    distinct = checkpointed(fps.groupBy(*names).agg(F.min("__id").alias("__least")))
    labels = component_labels(fingerprint_links(distinct.select(*names), max_bits, shared=shared)).select(F.col("u").alias("__entry"), F.col("v").alias("__label"))
    members = distinct.withColumn("__entry", entry_id(names)).join(labels, "__entry", "left").withColumn("__label", F.coalesce("__label", "__entry"))
    # written first: the join can then split a label that holds a large part of the entries
    least = checkpointed(members.groupBy("__label").agg(F.min("__least").alias("component_id")))
    return members.join(least, "__label").select(*names, "component_id")


def simhash_components(docs: DataFrame, n_words: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (16 hex digits), component_id: the smallest id that is reachable over links."""
    fps = checkpointed(fingerprints(docs, n_words, id_col, text_col))
    found = fps.join(component_ids(fps, max_bits), "fp")
    return found.select(F.col("__id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_simhash(spark, sf_dir):
    return simhash_components(table(spark, sf_dir, "documents"))


def fingerprint_pairs(entries: DataFrame, max_bits: int = NEAR_BITS, shared: int = NEAR_BYTES) -> DataFrame:
    """Candidates a, b among entries(__entry, __fp), from the byte-position index: two for each fingerprint at most, the nearest of all that it is linked with and the nearest of those that are smaller. Entries of equal
    fingerprints are paired with the smallest of them.

    shared is less than the minimum for max_bits, so pairs beyond 8 - shared bits may go unseen; whoever asks for every pair looks for those by other means.
    """
    least = checkpointed(entries.groupBy("__fp").agg(F.min("__entry").alias("least")))
    links = fingerprint_links(least.select("__fp"), max_bits, shared=shared)
    bits = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("bits")
    ends = links.select("a", "b", bits).union(links.select(F.col("b").alias("a"), F.col("a").alias("b"), bits))
    nearest = F.array(F.min(F.struct("bits", "b")), F.min(F.when(F.col("b") < F.col("a"), F.struct("bits", "b"))))
    found = ends.groupBy("a").agg(nearest.alias("near")).select("a", F.explode("near.b").alias("b")).where("b IS NOT NULL")
    found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for end in "ab":
        found = found.join(least.select(F.col("__fp").alias(end), F.col("least").alias(f"of_{end}")), end)
    equal = entries.join(least, "__fp").where("__entry <> least").select(F.col("least").alias("a"), F.col("__entry").alias("b"))
    return found.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).union(equal)


def first_of_each_group(docs: DataFrame, overlap: float = 0.8, n_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document whose id is the smallest of its component; columns as they are.

    Two documents link if their sets of n-word shingles overlap by so much or more. Candidates come from the byte-position index of their fingerprints and are verified on the shingles. Fingerprints alone
    can't tell all links, as of 64 bits nearly 10 differ at 0.8, give or take 3: what they leave apart is looked for among min-hashes (see overlap.py).

    Rows that repeat an id with its text are one document and stay together; an id that stands for several texts is judged text by text. Rows without an id come after all
    others; where a component has no other, one row of one text stays.
    """
    first = component_firsts(docs, fingerprint_pairs, overlap, n_words, id_col, text_col)
    key = next(name for name in (f"__key{k}" for k in count()) if name not in docs.columns)
    rows = docs.withColumn(key, text_key(text_col))
    same = rows[id_col].cast("long").eqNullSafe(first["first_id"]) & (rows[key] == first["first_key"])
    named = rows.where(F.col(id_col).isNotNull()).join(first, same, "left_semi")
    unnamed = rows.where(F.col(id_col).isNull()).join(first.where("first_id IS NULL"), rows[key] == first["first_key"], "left_semi").dropDuplicates([key])
    return named.union(unnamed).drop(key)
