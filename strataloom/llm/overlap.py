"""Near copies by the overlap (Jaccard) of their word shingles: candidates from an index of fingerprints, then from bands of min-hashes, each link verified on the shingles.

Texts with the same set of shingles are one entry. Candidates of the fingerprint index (simhash.py) are verified first, and what they link is one component from then on. No guarantee of such an index reaches as far as the overlap,
so entries that are still apart meet once more: an entry has BANDS x ROWS min-hashes; two entries meet in the posting of a band if they agree
in all rows of it. At an overlap of 0.8 a pair meets nowhere with a chance of (1 - 0.8^5)^40 = 1.3e-7, and less above. No pair is
linked that doesn't reach the overlap: every link is verified on all shingles, before components are built.

What is written for every entry is small: its fingerprint, its bands and a byte of each min-hash. Shingles are made again, from the texts, for entries that meet another one only.

Postings are searched in two rounds. First every entry is compared with the smallest entry of each of its postings, unless fingerprints have linked them. Then, in postings of up to PAIRWISE entries that still hold several components,
all pairs of different components are compared. Either way the bytes of the min-hashes are compared first, and on the shingles only pairs whose bytes allow the overlap (SPREAD standard deviations below it).

Entries of larger postings that still hold several components - pages of one template, say - get postings of another kind, of their rare shingles. Shingles are ordered by how many of these entries hold them, as counted in a table of SKETCH cells (two shingles of one cell count together: any order
that is the same for all entries loses nothing), rarest first.
Of two sets that overlap by t, the larger one has a shingle among its first s - ceil(t s) + 1 that is among the first s - ceil(2 t s / (1 + t)) + 1 of the smaller one: nothing is lost by looking for such pairs only. What a
template puts into every page comes last in this order, so pages that share no more than it meet nowhere. Again, pairs of different components are compared, each in the first posting that it shares, and pairs within
the component that holds most of a posting not at all. Up to PAIRWISE entries the shingles are fetched for pairs whose bytes allow the overlap. In a larger posting, entries that are in such a pair are named first; only their
shingles are brought to it, and a spanning forest of links comes out. A posting of more than BLOCK entries is dealt over tasks, one for each two blocks.

Shingles: the text with A-Z lower-cased, words between ASCII white space, n words joined by a space (a shorter text is one
shingle), repeats left out; XXH64 with seed 42 of each. Links are verified on 32 bits of each hash: by chance two texts of n shingles each have n^2 / 2^32 more in common. Texts without a word share one entry.
Texts and sets of shingles are known by 64 bits: among 10^8 different ones two share them with a chance of 3e-4, among 10^10 it is likely, and the later of the two would go unseen.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import checkpointed, fits_broadcast, join_small, remove, that_may_meet, written
from strataloom.llm.components import component_labels

BANDS, ROWS, SPREAD, PAIRWISE, BLOCK = 40, 5, 5.0, 12, 2048
#: Cells of the table that counts shingles, and how many of them a row of it holds.
SKETCH, PART = 1 << 20, 1 << 16
#: Shingles whose bits are counted at once.
SHINGLES = 1 << 15
#: Rows of an Arrow batch that leaves a Python worker.
BATCH = 256

_rng = np.random.default_rng(11)
_factors = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_terms = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_spans(text: str | None, n_words: int) -> tuple[bytes, list[int], list[int]]:
    """The words joined by a space, and where shingles start and end in it."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    joined = b" ".join(words)
    if len(words) <= n_words:
        return joined, [0] if words else [], [len(joined)] if words else []
    after = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    return joined, [0, *after[: len(words) - n_words].tolist()], (after[n_words - 1 :] - 1).tolist()


def shingle_set(text: str | None, n_words: int = 5) -> np.ndarray:
    """The distinct hashes of the shingles, in order."""
    joined, starts, ends = shingle_spans(text, n_words)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts, ends)), dtype=np.uint64, count=len(starts)))


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), SHINGLES):
        h = hashes[at : at + SHINGLES].astype("<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return ones


def majority(ones: np.ndarray, n: int) -> int:
    """The fingerprint as a signed long: the bits that are set in over half of n hashes."""
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 512):
        least = np.minimum(least, (shingles[at : at + 512, None] * _factors + _terms).min(axis=0))
    return least


def text_key(text_col: str):
    """What tells texts apart without reading them in Python."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def distinct_entries(docs: DataFrame, n_words: int, id_col: str, text_col: str) -> DataFrame:
    """__entry, __least (of its rows the one with the smallest id: whether that is null, id, key of its text), __key (of one of its texts), __fp (the fingerprint of its shingles, each counted once), __bands and __low (a byte of each min-hash) of each set of shingles."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                entries, fps, bands, low = [], [], [], []
                for t in part.column(2):
                    s = shingle_set(t.as_py(), n_words)
                    m = min_hashes(s).astype("<u8")
                    whole = m.tobytes()
                    entries.append(signed(xxhash.xxh64_intdigest(s.astype("<u8").tobytes(), 7)))
                    fps.append(majority(bit_counts(s), len(s)))
                    bands.append([signed(xxhash.xxh64_intdigest(whole[8 * ROWS * b : 8 * ROWS * (b + 1)], b)) for b in range(BANDS)] if len(s) else [])
                    low.append(m.astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(entries, pa.int64()), pa.array(fps, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(low, pa.binary())], names=["__key", "__id", "__entry", "__fp", "__bands", "__low"])

    rows = docs.select(text_key(text_col).alias("__key"), F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    made = rows.mapInArrow(run, "__key long, __id long, __entry long, __fp long, __bands array<long>, __low binary")
    # equal entries have equal fingerprints and bands
    return checkpointed(made.groupBy("__entry").agg(F.min(F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__key").alias("key"))).alias("__least"), F.min("__key").alias("__key"), F.first("__fp").alias("__fp"), F.first("__bands").alias("__bands"), F.first("__low").alias("__low")))


def shingles_of(docs: DataFrame, asked: DataFrame, n_words: int, id_col: str, text_col: str) -> DataFrame:
    """__entry, __set (32 bits of each hash, in order) of every row of asked(__entry, __key), once each."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                sets = [np.unique(shingle_set(t.as_py(), n_words).astype("<u4")).tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["__entry", "__set"])

    texts = docs.select(text_key(text_col).alias("__key"), F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    asked = asked.select("__entry", "__key")
    if not fits_broadcast(asked):
        texts = that_may_meet(texts, asked, "__key")
    found = join_small(texts, asked, "__key", F.col("__id"), "inner")
    return checkpointed(found.groupBy("__entry").agg(F.first("__text").alias("__text")).mapInArrow(run, "__entry long, __set binary"))


def overlaps(x: np.ndarray, y: np.ndarray, overlap: float) -> bool:
    if min(len(x), len(y)) < overlap * max(len(x), len(y)) - 1e-9:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and both >= overlap * (len(x) + len(y) - both) - 1e-9


def least_agreement(overlap: float) -> float:
    """How many min-hashes at least agree for a pair that overlaps so much."""
    n = BANDS * ROWS
    return n * overlap - SPREAD * (n * overlap * (1 - overlap)) ** 0.5


def allowed(pairs: DataFrame, entries: DataFrame, overlap: float) -> DataFrame:
    """The pairs (a, b) whose min-hashes allow the overlap."""

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
            ok = (a == b).sum(axis=1) >= least_agreement(overlap)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left, right = (entries.select(F.col("__entry").alias(end), F.col("__low").alias(f"low_{end}")) for end in "ab")
    return checkpointed(pairs.join(left, "a").join(right, "b").select("a", "b", "low_a", "low_b").mapInArrow(run, "a long, b long"))


def overlapping(pairs: DataFrame, sets: DataFrame, overlap: float) -> DataFrame:
    """The pairs (a, b) whose sets of shingles overlap by so much or more."""

    def run(batches):
        for batch in batches:
            ok = [overlaps(*(np.frombuffer(z.as_py(), dtype="<u4") for z in pair), overlap) for pair in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left, right = (sets.select(F.col("__entry").alias(end), F.col("__set").alias(f"set_{end}")) for end in "ab")
    return checkpointed(pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long"))


def pairs_of_components(overlap: float, give: str, of_prefixes: bool = False):
    """For partitions sorted by key, x, y (blocks): pairs of entries of different components whose min-hashes allow the overlap.

    Columns: key, x, y, block, __entry, label, __low; of prefixes also leads (whether pairs are looked for from this entry on), __size (of its set; a pair has to have a leading entry that is no larger, or two leading ones),
    rank and __prefix (where the key stands among the entry's first shingles, and these: a pair counts in the first posting that it shares).
    give: 'pairs' (a, b), 'ends' (key, x, y, __entry of all that are in one), or 'forest' (with __set: a, b of a forest of pairs that overlap).
    """
    least = least_agreement(overlap)

    def search(at, block, entry, label, low, leads=None, size=None, rank=None, prefix=None, sets=None):
        up: dict[int, int] = {}

        def root(x):
            while x in up:
                x = up[x]
            return x

        n = len(entry)
        leads = np.ones(n, dtype=bool) if leads is None else leads
        kinds, counts = np.unique(label, return_counts=True)
        outside = label != kinds[counts.argmax()]
        named = np.zeros(n, dtype=bool)
        # a pair is looked at from one end: a leading one, and where both lead from the one outside the largest component, or the earlier one
        for i in np.flatnonzero(leads):
            ok = label != label[i]
            if size is not None:
                ok &= leads | (size >= size[i])
            if outside[i]:
                ok[:i] &= ~(leads & outside)[:i]
            else:
                ok &= ~leads
            if at[1] != at[2]:
                ok &= block != block[i]
            ok = np.flatnonzero(ok)
            ok = ok[(low[ok] == low[i]).sum(axis=1) >= least]
            if prefix is not None and rank[i] and len(ok):
                before = [prefix[j][: rank[j]] for j in ok.tolist()]
                seen = np.concatenate([[0], np.cumsum(np.isin(np.concatenate(before), prefix[i][: rank[i]]))])
                ends = np.cumsum([len(b) for b in before])
                ok = ok[seen[ends] == seen[ends - [len(b) for b in before]]]
            if not len(ok):
                continue
            if give == "ends":
                named[i] = named[ok] = True
                continue
            if give == "forest":
                links = []
                for j in ok.tolist():
                    p, q = root(int(label[i])), root(int(label[j]))
                    if p != q and overlaps(sets[i], sets[j], overlap):
                        up[max(p, q)] = min(p, q)
                        links.append(j)
                ok = np.array(links, dtype=np.int64)
            if len(ok):
                yield np.minimum(entry[i], entry[ok]), np.maximum(entry[i], entry[ok])
        if named.any():
            many = int(named.sum())
            yield np.full(many, at[0]), np.full(many, at[1], dtype=np.int32), np.full(many, at[2], dtype=np.int32), entry[named]

    def batch_of(found):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["key", "x", "y", "__entry"] if give == "ends" else ["a", "b"])

    def of_bytes(column, kind):
        out = np.empty(len(column), dtype=object)
        out[:] = [np.frombuffer(x.as_py(), dtype=kind) for x in column]
        return out

    def run(batches):
        at, held, out, size = None, [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)], axis=1)
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4, 5)]
            columns.append(np.stack([np.frombuffer(x.as_py(), dtype=np.uint8) for x in batch.column(6)]))
            if of_prefixes:
                columns += [batch.column(k).to_numpy(zero_copy_only=False) for k in (7, 8, 9)]
                columns += [of_bytes(batch.column(k), "<u4") for k in ((10, 11) if give == "forest" else (10,))]
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for s, e in zip(cuts, cuts[1:]):
                key = tuple(keys[s].tolist())
                if key != at and held:
                    for found in search(at, *(np.concatenate(c) for c in zip(*held))):
                        out.append(found)
                        size += len(found[0])
                        if size > 1 << 16:
                            yield batch_of(out)
                            out, size = [], 0
                    held = []
                at = key
                held.append([c[s:e] for c in columns])
        if held:
            out.extend(search(at, *(np.concatenate(c) for c in zip(*held))))
        if out:
            yield batch_of(out)

    return run


def cells_of(w: np.ndarray) -> np.ndarray:
    return (w * np.uint32(0x9E3779B1)) >> np.uint32(32 - (SKETCH - 1).bit_length())


def shingle_sketch(rows: DataFrame) -> np.ndarray:
    """How many of the entries of rows(__set) hold a shingle of each cell. A task hands over its counts in parts of PART cells, which are added up in Spark; SKETCH counts reach the driver."""

    def count(batches):
        total = np.zeros(SKETCH, dtype=np.uint32)
        for batch in batches:
            for x in batch.column(0):
                np.add.at(total, cells_of(np.frombuffer(x.as_py(), dtype="<u4")), 1)
        parts = [(k, part.tobytes()) for k, part in enumerate(total.reshape(-1, PART)) if part.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([b for _, b in parts], pa.binary())], names=["part", "counts"])

    def add(key, parts):
        total = np.zeros(PART, dtype=np.int64)
        for x in parts["counts"]:
            total += np.frombuffer(x.as_py(), dtype="<u4")
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([np.minimum(total, (1 << 32) - 1).astype("<u4").tobytes()], pa.binary())], names=["part", "counts"])

    counts = rows.select("__set").mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary")
    sketch = np.zeros((SKETCH // PART, PART), dtype=np.uint32)
    for r in counts.collect():
        sketch[r["part"]] = np.frombuffer(r["counts"], dtype="<u4")
    return sketch.ravel()


def first_shingles(crowd: DataFrame, sets: DataFrame, overlap: float) -> DataFrame:
    """__entry, label, __size, leading (how many of its first shingles lead), __prefix (its first shingles, the rarest first), shared (places in it of shingles that another entry may hold) of every entry of crowd(__entry, label)."""
    rows = crowd.join(sets, "__entry").select("__entry", "label", "__set")
    sketch = rows.sparkSession.sparkContext.broadcast(shingle_sketch(rows))  # of a fixed size

    def run(batches):
        names = ["__entry", "label", "__size", "leading", "__prefix", "shared"]
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                sizes, leading, prefixes, shared = [], [], [], []
                for x in part.column(2):
                    w = np.frombuffer(x.as_py(), dtype="<u4")
                    n = sketch.value[cells_of(w)]
                    order = np.lexsort((w, n))[: len(w) - math.ceil(len(w) * overlap - 1e-9) + 1]
                    sizes.append(len(w))
                    leading.append(len(w) - math.ceil(len(w) * 2 * overlap / (1 + overlap) - 1e-9) + 1)
                    prefixes.append(w[order].tobytes())
                    shared.append(np.flatnonzero(n[order] > 1).tolist())
                made = [pa.array(sizes, pa.int32()), pa.array(leading, pa.int32()), pa.array(prefixes, pa.binary()), pa.array(shared, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], names=names)

    return rows.mapInArrow(run, "__entry long, label long, __size int, leading int, __prefix binary, shared array<int>")


def crowded_links(crowd: DataFrame, meeting: DataFrame, sets: DataFrame, overlap: float) -> DataFrame:
    """Links a, b between entries of different components of crowd(__entry, label), found by rare shingles."""
    spark = crowd.sparkSession
    firsts, firsts_at = written(first_shingles(crowd, sets, overlap), "first-shingles")
    word = F.conv(F.hex(F.substring("__prefix", F.col("rank") * 4 + 1, F.lit(4))), 16, 10).cast("long")
    each = firsts.where(F.size("shared") > 0).select("__entry", "label", "leading", "__prefix", F.explode("shared").alias("rank")).select(word.alias("key"), "__entry", "label", "rank", (F.col("rank") < F.col("leading")).alias("leads"))
    each, each_at = written(each, "postings")
    mixed = each.groupBy("key").agg(F.min("label").alias("p"), F.max("label").alias("q"), F.max("leads").alias("led"), F.count(F.lit(1)).alias("n")).where("p <> q AND led").select("key", "n")
    posted, posted_at = written(each.join(mixed, "key"), "postings")
    key = ["key", "x", "y"]
    of_entry = meeting.select("__entry", "__low").join(firsts.select("__entry", "__size", "__prefix"), "__entry")
    wide = [*key, "block", "__entry", "label", "__low", "leads", "__size", "rank", "__prefix"]
    few = posted.where(F.col("n") <= PAIRWISE).withColumns({"x": F.lit(0), "y": F.lit(0), "block": F.lit(0)}).join(of_entry, "__entry").select(*wide).repartition(*key).sortWithinPartitions(*key)
    found = overlapping(checkpointed(few.mapInArrow(pairs_of_components(overlap, "pairs", True), "a long, b long").distinct()), sets, overlap)
    many = posted.where(F.col("n") > PAIRWISE).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("__entry"), F.col("blocks")).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")}).join(of_entry, "__entry").select(*wide)
    ends = checkpointed(many.repartition(*key).sortWithinPartitions(*key).mapInArrow(pairs_of_components(overlap, "ends", True), "key long, x int, y int, __entry long"))
    named = many.join(ends, [*key, "__entry"]).join(sets, "__entry").select(*wide, "__set").repartition(*key).sortWithinPartitions(*key)
    forest = checkpointed(named.mapInArrow(pairs_of_components(overlap, "forest", True), "a long, b long"))
    for path in (firsts_at, each_at, posted_at):
        remove(spark, path)
    return found.union(forest)


def labels_of(links: DataFrame) -> DataFrame:
    """__entry and label of every linked entry."""
    return component_labels(links).select(F.col("u").alias("__entry"), F.col("v").alias("label"))


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) whose entries aren't of one component yet."""
    for end in "ab":
        pairs = pairs.join(labels.select(F.col("__entry").alias(end), F.col("label").alias(f"of_{end}")), end, "left")
    return pairs.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def verified_links(docs: DataFrame, distinct: DataFrame, near: DataFrame, overlap: float, n_words: int, id_col: str, text_col: str) -> DataFrame:
    """Links a, b that connect every two entries that overlap, by themselves or through others; each of them overlaps itself. near: pairs a, b that are verified first; only entries that these leave apart are looked at again."""
    near = checkpointed(near)
    posted = distinct.select("__entry", F.explode("__bands").alias("key"))
    shared = posted.groupBy("key").agg(F.min("__entry").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "a")
    posted = checkpointed(posted.join(shared, "key"))  # only what meets another entry
    met = posted.select("__entry").union(near.select("a")).union(near.select("b")).distinct()
    meeting = checkpointed(distinct.join(met, "__entry").select("__entry", "__key", "__low"))
    sets = shingles_of(docs, meeting, n_words, id_col, text_col)
    near = overlapping(allowed(near, meeting, overlap), sets, overlap)
    stars = posted.where("a <> __entry").select("a", F.col("__entry").alias("b")).distinct()
    stars = near.union(overlapping(allowed(apart(stars, labels_of(near)), meeting, overlap), sets, overlap))
    labels = labels_of(stars)
    labelled = posted.select("key", "__entry").join(labels, "__entry", "left").withColumn("label", F.coalesce("label", "__entry"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("p"), F.max("label").alias("q"), F.count(F.lit(1)).alias("n")).where("p <> q").select("key", "n")
    mixed = checkpointed(labelled.join(mixed, "key"))
    key = ["key", "x", "y"]
    few = mixed.where(F.col("n") <= PAIRWISE).join(meeting.select("__entry", "__low"), "__entry")
    few = few.select("key", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("block"), "__entry", "label", "__low").repartition(*key).sortWithinPartitions(*key)
    found = overlapping(checkpointed(few.mapInArrow(pairs_of_components(overlap, "pairs"), "a long, b long").distinct()), sets, overlap)
    crowd = mixed.where(F.col("n") > PAIRWISE).select("__entry", "label").distinct()
    return stars.union(found).union(crowded_links(crowd, meeting, sets, overlap))


def component_firsts(docs: DataFrame, near_pairs: Callable[[DataFrame], DataFrame], overlap: float = 0.8, n_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """first_id and first_key of each component of texts that overlap: its smallest id (null if it has no other) and the key of that row's text. near_pairs gives the candidates a, b that fingerprints find among rows of __entry, __fp."""
    distinct = distinct_entries(docs, n_words, id_col, text_col)
    labels = component_labels(verified_links(docs, distinct, near_pairs(distinct.select("__entry", "__fp")), overlap, n_words, id_col, text_col)).select(F.col("u").alias("__entry"), F.col("v").alias("__label"))
    members = distinct.select("__entry", "__least").join(labels, "__entry", "left")
    least = members.groupBy(F.coalesce("__label", "__entry").alias("__label")).agg(F.min("__least").alias("__least"))
    return least.select(F.col("__least.id").alias("first_id"), F.col("__least.key").alias("first_key"))
