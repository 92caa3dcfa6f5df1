"""Keys of sketches find what bands and agreement define, and runs are hashed once for many tasks."""

import random

import pytest
from pyspark.sql import functions as F

from strataloom.operators import near_dup


@pytest.mark.parametrize("permutations, bands, threshold", [(16, 8, 0.8), (64, 8, 0.8), (16, 4, 0.9), (12, 3, 0.5), (16, 8, 1.0)])
def test_keys_find_what_bands_define(spark, permutations, bands, threshold):
    r = random.Random(permutations + bands)
    base = [[r.randrange(9) for _ in range(permutations)] for _ in range(6)]
    rows = [(i, [r.randrange(9) if r.random() < 0.12 else x for x in base[i % 6]]) for i in range(120)]
    rows_in_band, want = permutations // bands, set()
    for j, b in rows:
        for i, a in rows[:j]:
            shared = any(a[k * rows_in_band : (k + 1) * rows_in_band] == b[k * rows_in_band : (k + 1) * rows_in_band] for k in range(bands))
            if a == b or shared and sum(x == y for x, y in zip(a, b)) / permutations >= threshold:
                want.add(j)
    got = near_dup.removed_ids(spark.createDataFrame(rows, "doc_id long, sketch array<long>"), bands, threshold, permutations)
    assert sorted(x.doc_id for x in got.collect()) == sorted(want) and want


def test_keys_are_of_more_places_than_a_band():
    """Sketches of two places in eight, as texts of one language have by chance, meet in bands of two and not in these keys."""
    assert min(sum(n for _, n in key) for key in near_dup.postings(16, 8, 0.8)) == 6
    assert near_dup.postings(64, 8, 0.8) == [[(8 * b, 8)] for b in range(8)]


def test_a_run_is_hashed_once_for_many_texts(monkeypatch):
    import hashlib

    calls, real = [], hashlib.blake2b
    monkeypatch.setattr(near_dup.hashlib, "blake2b", lambda x, **k: calls.append(x) or real(x, **k))
    monkeypatch.setattr(near_dup, "AT_ONCE", 40)
    near_dup.run_hashes.cache_clear()
    import pandas as pd

    texts = pd.Series([b"abcdefghij" * n for n in range(1, 30)] + [b"", b"abc", bytes(range(97, 120)) * 3])
    got = near_dup.blake2_sketches(4).func(texts)
    runs = [{t[i : i + 5] for i in range(max(1, len(t) - 4))} for t in texts]
    assert len(calls) == 4 * len(set().union(*runs))
    for sketch, found in zip(got, runs):
        assert list(sketch) == [min(int.from_bytes(real(s.to_bytes(4, "little") + r, digest_size=8).digest(), "little") for r in found) - (1 << 63) for s in range(4)]
    near_dup.run_hashes.cache_clear()


def test_keys_of_four_bands_are_of_more_places_too():
    """near_dedup_native: in bands of four places of sixteen, texts of one language meet by chance as the square of their number."""
    assert min(sum(n for _, n in key) for key in near_dup.postings(16, 4, 0.8)) == 6 and len(near_dup.postings(16, 4, 0.8)) == 10


@pytest.mark.parametrize("permutations, bands, threshold", [(16, 4, 0.8)])
def test_keys_of_the_native_query_find_what_bands_define(spark, permutations, bands, threshold):
    test_keys_find_what_bands_define(spark, permutations, bands, threshold)


@pytest.mark.parametrize("k, remembered", [(5, 1 << 18), (5, 50), (9, 1 << 18)])
def test_linear_sketches_are_the_native_ones(spark, monkeypatch, k, remembered):
    """Made by array operations, a run hashed once for many texts; short, empty, null and long texts, and runs that were forgotten."""
    monkeypatch.setattr(near_dup, "AT_ONCE", 320)
    monkeypatch.setattr(near_dup, "REMEMBERED", remembered)
    near_dup.linear_hashes.cache_clear()
    texts = [None, "", "a", "abcd", "abcde", "  Abc\tDE ", "é" * 7, "the quick brown fox " * 90, *(f"text {i * i} of {'x' * (i % 9)}{i}" for i in range(60)), "".join(chr(97 + i * i % 23) for i in range(900))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    data = df.select(near_dup.text_bytes(F.col("text")).alias("b")).toPandas()["b"]
    want = [list(r.sketch) for r in near_dup.native_sketches(df, 16, k=k).orderBy("doc_id").collect()]
    assert [list(x) for x in near_dup.linear_sketches(16, k).func(data)] == want
    calls, real = [], near_dup.hashlib.md5
    monkeypatch.setattr(near_dup.hashlib, "md5", lambda x: calls.append(x) or real(x))
    assert [list(x) for x in near_dup.linear_sketches(16, k).func(data)] == want and (k > 8 or remembered == 50 or len(calls) < 30)
    near_dup.linear_hashes.cache_clear()


def test_the_native_query_sketches_in_arrays(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(5)], "doc_id long, text string")
    near_dup.linear_hashes.cache_clear()
    assert near_dup.near_dedup(df, 0.8, 16, 4, native=True).count() == 5
    assert "conv(" not in near_dup.linear_sketches(16)(near_dup.text_bytes(F.col("text")))._jc.toString()
