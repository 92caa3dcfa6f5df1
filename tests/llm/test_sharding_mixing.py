import zlib
from collections import Counter

from pyspark.sql import functions as F

from strataloom.llm import mixing, sharding
from tests.llm import helpers


def test_shards_hold_every_row_and_follow_the_mixture(spark):
    docs = helpers.table(spark)
    got = sharding.interleaved_shards(docs, 4).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in helpers.rows())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == {0, 1, 2, 3} and max(sizes.values()) - min(sizes.values()) <= 1
    for k in sizes:
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sizes[k]))
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}


def test_mixture_of_shards(spark):
    rows = [(i, "t", "hot" if i % 3 else f"s{i % 7}") for i in range(2100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    source = {i: s for i, _, s in rows}
    total = Counter(source.values())
    got = sharding.interleaved_shards(docs, 6).collect()
    for k in range(6):
        n = Counter(source[r.doc_id] for r in got if r.shard == k)
        assert all(abs(n[s] - total[s] / 6) <= 4 for s in total)
    again = sharding.interleaved_shards(docs.repartition(7), 6).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in got} == {(r.doc_id, r.shard, r.slot) for r in again}


def test_no_rows(spark):
    assert sharding.interleaved_shards(helpers.empty(spark)).count() == 0
    assert mixing.poisson_mix(helpers.empty(spark)).count() == 0


def test_poisson_counts_follow_rates(spark):
    docs = spark.createDataFrame([(i, "a" if i < 3000 else "b") for i in range(4000)], "doc_id long, source string")
    got = mixing.poisson_mix(docs, weights={"a": 1.0, "b": 3.0}).collect()
    n = Counter(r.source for r in got)
    assert abs(n["a"] - 1000) < 120 and abs(n["b"] - 3000) < 220
    copies = Counter(r.doc_id for r in got if r.source == "b")
    share = Counter(copies.values())
    assert abs(share[3] / 1000 - 0.224) < 0.05
    assert all(sorted(r.copy for r in got if r.doc_id == i) == list(range(c)) for i, c in list(copies.items())[:20])


def test_large_rates_and_missing_weights(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (None, "a"), (3, None)], "doc_id long, source string")
    got = Counter(r.source for r in mixing.poisson_mix(docs, weights={"a": 1.0}, total=2000).collect())
    assert set(got) == {"a"} and abs(got["a"] - 2000) < 250


def test_columns_and_repeats_stay(spark):
    docs = helpers.table(spark)
    got = mixing.poisson_mix(docs, numbered=False)
    assert got.columns == docs.columns and got.first()["copy"] == "c"
    n = Counter((r.doc_id, r.text) for r in mixing.poisson_mix(docs).collect())
    assert n[(3, helpers.rows()[3][1])] % 3 == 0


def test_salted_join_gives_the_same(spark, monkeypatch):
    from strataloom.llm import common

    docs = helpers.table(spark)
    plain = Counter((r.doc_id, r["copy"]) for r in mixing.poisson_mix(docs).collect())
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert plain == Counter((r.doc_id, r["copy"]) for r in mixing.poisson_mix(docs).collect())


def test_one_source_and_one_id_hold_most_rows(spark, monkeypatch):
    """Most rows have one source and no id; many of them are equal throughout. Places follow from a plain sort."""
    monkeypatch.setattr(sharding, "PIECE_ROWS", 7)
    rows = [(None, f"t{i % 40}", "hot") for i in range(900)] + [(5, "same", "hot")] * 333 + [(i, "t", f"s{i % 3}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sharding.interleaved_shards(docs, 5).collect()
    assert Counter((r.doc_id, r.text_crc32) for r in got) == Counter((i, zlib.crc32(t.encode())) for i, t, _ in rows)
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and all(sorted(r.slot for r in got if r.shard == k) == list(range(sizes[k])) for k in range(5))
    again = sharding.interleaved_shards(docs.repartition(3), 5).collect()
    assert Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in got) == Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in again)


def test_rows_without_an_id_are_mixed_over_partitions(spark):
    docs = spark.createDataFrame([(None, f"t{i}", "s") for i in range(2000)], "doc_id long, text string, source string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else small partitions are put together
    try:
        sizes = [r["count"] for r in mixing.poisson_mix(docs, weights={"s": 1.0}, total=6000).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) % 2000 == 0 and sum(sizes) and max(sizes) < 0.6 * sum(sizes)
