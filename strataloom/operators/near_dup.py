"""Near-duplicates by MinHash sketches with LSH banding.

A document is removed if an earlier one shares a band with it and their sketches agree in threshold of their places or more; a removed one
removes others all the same, so the result is a join and not a scan in order.

A sketch is made within the row that holds the text: only sketches are shuffled.

Documents of equal sketch are one sketch here: all but the first go, and only that one meets others. A band bucket
therefore holds distinct sketches, and a document leaves it with the smallest partner that it has: links aren't kept.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from strataloom.functions.text import squeeze

#: Runs whose hashes a Python worker keeps (64 longs each, 134 MB), and runs that are looked up at once.
REMEMBERED, AT_ONCE = 1 << 18, 1 << 16


def text_bytes(text: Column) -> Column:
    """What shingles are cut from: the squeezed, lower-cased text in UTF-8."""
    return F.encode(F.lower(squeeze(text)), "UTF-8")


def runs(data: Column, k: int = 5) -> Column:
    """The runs of k bytes (as hex) of data; the whole of a shorter one."""
    last = F.greatest(F.length(data) - k + 1, F.lit(1))
    return F.transform(F.sequence(F.lit(1), last), lambda i: F.hex(F.substring(data, i, k)))


class RunHashes:
    """The 64-bit hashes of runs for each seed, less 2^63 so that signed order is unsigned order; those of the runs met last are kept."""

    def __init__(self, permutations: int):
        self.prefixes = [seed.to_bytes(4, "little") for seed in range(permutations)]
        self.rows: dict[bytes, int] = {}
        self.table = np.empty((max(REMEMBERED, AT_ONCE), permutations), np.int64)

    def places(self, runs: list[bytes]) -> np.ndarray:
        """Rows of the table, for AT_ONCE distinct runs at most."""
        new = [r for r in runs if r not in self.rows]
        if len(self.rows) + len(new) > len(self.table):
            self.rows.clear()
            new = runs
        for r in new:
            hashed = np.frombuffer(b"".join(hashlib.blake2b(p + r, digest_size=8).digest() for p in self.prefixes), "<u8")
            self.table[len(self.rows)] = (hashed ^ np.uint64(1 << 63)).view("<i8")
            self.rows[r] = len(self.rows)
        return np.fromiter(map(self.rows.__getitem__, runs), np.int64, len(runs))


@lru_cache(maxsize=1)
def run_hashes(permutations: int) -> RunHashes:
    """One for a Python worker, which serves many tasks."""
    return RunHashes(permutations)


def distinct_runs(data: bytes, k: int) -> np.ndarray:
    """The distinct runs of k bytes; the whole of a shorter text."""
    if len(data) <= k:
        return np.array([data], dtype=object)
    if k > 8:
        return np.array(list({data[at : at + k] for at in range(len(data) - k + 1)}), dtype=object)
    codes, of_bytes = np.zeros(len(data) - k + 1, "<u8"), np.frombuffer(data, np.uint8).astype("<u8")
    for i in range(k):
        codes |= of_bytes[i : i + len(codes)] << np.uint64(8 * i)
    codes.sort()
    return codes[np.append(True, codes[1:] != codes[:-1])]


def blake2_sketches(permutations: int = 64, k: int = 5):
    """An Arrow UDF from a text's bytes to its sketch: for each seed the smallest hash of its runs of k bytes (RunHashes). A run that many texts share is hashed once."""

    def least(pieces: list, out: list) -> None:
        """pieces: (text, its runs), AT_ONCE runs at most."""
        hashes = run_hashes(permutations)
        for kind in ("u", "O"):
            some = [(i, runs) for i, runs in pieces if runs.dtype.kind == kind]
            if some:
                distinct, at = np.unique(np.concatenate([runs for _, runs in some]), return_inverse=True)
                places = hashes.places([x if kind == "O" else int(x).to_bytes(8, "little")[:k] for x in distinct.tolist()])[at]
                start = 0
                for i, runs in some:
                    found = hashes.table[places[start : start + len(runs)]].min(axis=0)
                    out[i] = found if out[i] is None else np.minimum(out[i], found)
                    start += len(runs)

    @F.pandas_udf(ArrayType(LongType()))
    def run(texts: pd.Series) -> pd.Series:
        out, pieces, size = [None] * len(texts), [], 0
        for i, data in enumerate(texts):
            runs = distinct_runs(bytes(data), k)
            for at in range(0, len(runs), AT_ONCE):
                piece = runs[at : at + AT_ONCE]
                if size + len(piece) > AT_ONCE:
                    least(pieces, out)
                    pieces, size = [], 0
                pieces.append((i, piece))
                size += len(piece)
        least(pieces, out)
        return pd.Series(out, index=texts.index, dtype=object)

    return run


def exact_sketches(docs: DataFrame, permutations: int = 64, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """id, sketch of BLAKE2 hashes, made where a text is read."""
    return docs.select(id_col, blake2_sketches(permutations, k)(text_bytes(F.col(text_col))).alias("sketch"))


# Fixed prime above 2^32, for hashes of the form (v a + c) mod p with v below 2^32.
PRIME = 4294967311


def linear_coefficients(n: int) -> list[tuple[int, int]]:
    """n pairs below 2^31 that follow from a multiplicative sequence."""
    return [((2654435761 * (2 * i + 1)) % 2147483647, (40503 * (i + 1) * (i + 7)) % 2147483647) for i in range(n)]


def native_sketches(docs: DataFrame, permutations: int = 16, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """id, sketch without Python: linear hashes of the first 32 bits of the MD5 of each run, made where a text is read. linear_sketches makes the same in a fraction of the time.

    Bytes and hashes are columns of their own that are used more than once, so they are made once and not for every run.
    """
    rows = docs.select(id_col, text_bytes(F.col(text_col)).alias("__b"))
    hashed = rows.select(id_col, F.transform(F.array_distinct(runs(F.col("__b"), k)), lambda s: F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("long")).alias("__v"))

    def least(a, c):
        return F.array_min(F.transform("__v", lambda v: (v * a + c) % PRIME))

    return hashed.select(id_col, F.array(*[least(a, c) for a, c in linear_coefficients(permutations)]).alias("sketch"))


class LinearHashes:
    """The linear hashes of runs of k bytes, a row for each run, sorted by run; new runs wait until there are many and are then sorted in. The runs met last are kept."""

    def __init__(self, permutations: int, k: int):
        self.k, self.coefficients = k, [np.array(x, np.uint64) for x in zip(*linear_coefficients(permutations))]
        self.known, self.rows = np.empty(0, np.uint64), np.empty((0, permutations), np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def hashed(self, runs: list[bytes]) -> np.ndarray:
        """Of any runs: from the first 32 bits of the MD5 of a run's hex."""
        first = [int.from_bytes(hashlib.md5(r.hex().upper().encode()).digest()[:4], "big") for r in runs]
        a, c = self.coefficients
        return ((np.array(first, np.uint64)[:, None] * a + c) % np.uint64(PRIME)).view(np.int64)

    def least(self, runs: np.ndarray) -> np.ndarray:
        """The least hashes of distinct runs (as distinct_runs has them)."""
        if runs.dtype.kind == "O":
            return self.hashed(list(runs)).min(axis=0)
        at = np.searchsorted(self.known, runs)
        found = np.zeros(len(runs), bool) if not len(self.known) else self.known[np.minimum(at, len(self.known) - 1)] == runs
        parts = [self.rows[at[found]]] if found.any() else []
        if not found.all():
            new = runs[~found]
            parts.append(self.hashed([int(x).to_bytes(8, "little")[: self.k] for x in new.tolist()]))
            self.waiting.append((new, parts[-1]))
            if sum(len(x) for x, _ in self.waiting) >= AT_ONCE >> 4:
                self.sort_in()
        return np.concatenate(parts).min(axis=0)

    def sort_in(self) -> None:
        new, places = np.unique(np.concatenate([x for x, _ in self.waiting]), return_index=True)
        rows, self.waiting = np.concatenate([x for _, x in self.waiting])[places], []
        if len(self.known) + len(new) > REMEMBERED:
            self.known, self.rows = self.known[:0], self.rows[:0]
        runs = np.concatenate([self.known, new])
        order = np.argsort(runs)
        self.known, self.rows = runs[order], np.concatenate([self.rows, rows])[order]


@lru_cache(maxsize=1)
def linear_hashes(permutations: int, k: int) -> LinearHashes:
    """One for a Python worker, which serves many tasks."""
    return LinearHashes(permutations, k)


def linear_sketches(permutations: int = 16, k: int = 5):
    """An Arrow UDF from a text's bytes to the sketch that native_sketches states, by array operations: a run that many texts share is hashed once."""

    @F.pandas_udf(ArrayType(LongType()))
    def run(texts: pd.Series) -> pd.Series:
        hashes, out = linear_hashes(permutations, k), []
        for data in texts:
            runs = distinct_runs(bytes(data), k)
            out.append(np.min([hashes.least(runs[at : at + AT_ONCE]) for at in range(0, len(runs), AT_ONCE)], axis=0))
        return pd.Series(out, index=texts.index, dtype=object)

    return run


def similarity(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.greatest(F.size(a), F.lit(1))


def removed_ids(sketches: DataFrame, bands: int, threshold: float, permutations: int, id_col: str = "doc_id") -> DataFrame:
    """Ids of documents that an earlier near-duplicate removes."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    firsts = sketches.groupBy("sketch").agg(F.min(id_col).alias("__first"))
    equal = sketches.join(firsts, "sketch").where(F.col(id_col) != F.col("__first")).select(id_col)
    keys = F.array(*[F.concat(*[F.slice("sketch", at + 1, n) for at, n in parts]) for parts in postings(permutations, bands, threshold)])
    banded = firsts.select(F.col("__first").alias("id"), "sketch", F.posexplode(keys).alias("band", "part")).withColumn("key", F.xxhash64("part"))
    a, b = banded.alias("a"), banded.alias("b")
    same = (F.col("a.band") == F.col("b.band")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.part") == F.col("b.part")) & (similarity(F.col("a.sketch"), F.col("b.sketch")) >= threshold)
    near = b.join(a, same, "left_semi").select(F.col("id").alias(id_col))
    return equal.union(near).distinct()


def postings(permutations: int, bands: int, threshold: float) -> list[list[tuple[int, int]]]:
    """Parts (from, length) of a sketch that make its keys: two sketches share a band and agree at threshold exactly if they also share one of these keys and agree at threshold.

    Sketches that agree may differ in d places. If those can't lie in all bands, agreement alone implies a shared band; then, of d + 2 parts of a sketch, two at least
    are equal, and keys of two parts each take far fewer sketches together than a band of few places does.
    """
    differ = max(d for d in range(permutations + 1) if (permutations - d) / permutations >= threshold)
    rows = permutations // bands
    parts = differ + 2
    if differ >= bands or parts > permutations or math.comb(parts, 2) > 3 * bands or 2 * (permutations // parts) <= rows:
        return [[(b * rows, rows)] for b in range(bands)]
    cuts = [permutations * i // parts for i in range(parts + 1)]
    return [[(cuts[i], cuts[i + 1] - cuts[i]) for i in pair] for pair in combinations(range(parts), 2)]


def kept_aside(df: DataFrame) -> DataFrame:
    """df, made once for all that reads it: written to the checkpoint folder if there is one, else persisted."""
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return df.checkpoint() if shared else df.persist()


def near_dedup(docs: DataFrame, threshold: float = 0.8, permutations: int = 64, bands: int = 8, native: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that removed_ids names. native: sketches of hashes that Spark and SQL have too."""
    made = (linear_sketches if native else blake2_sketches)(permutations)(text_bytes(F.col(text_col)))
    sketches = kept_aside(docs.select(id_col, made.alias("sketch")))
    return docs.join(removed_ids(sketches, bands, threshold, permutations, id_col), id_col, "left_anti")
