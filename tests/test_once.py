"""What is dear to compute is computed once for each row."""

import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from strataloom.operators import corpus, filters, packing
from strataloom.sources import files, sinks


def counted(spark, f, kind):
    calls = spark.sparkContext.accumulator(0)

    def run(x):
        calls.add(1)
        return f(x)

    return F.udf(run, kind), calls


def docs(spark, n=40):
    return spark.createDataFrame([(i, f"text number {i % 31} " * (1 + i % 4), "s") for i in range(n)], "doc_id long, text string, split string").repartition(3)


@pytest.mark.parametrize("by", [[], ["split"]])
def test_each_document_is_encoded_once(spark, by):
    encode, calls = counted(spark, lambda t: list(t.encode()), ArrayType(IntegerType()))
    blocks = packing.pack_tokens(docs(spark).withColumn("tokens", encode("text")), 16, by=by)
    n = sum(len(r.text) for r in docs(spark).collect())
    assert blocks.count() == (n - 1) // 16 and calls.value == 40


def test_each_pair_is_encoded_once(spark):
    encode, calls = counted(spark, lambda t: list(t.encode()), ArrayType(IntegerType()))
    rows = docs(spark).withColumn("input_ids", encode("text")).withColumn("labels", F.col("input_ids"))
    packing.pack_sft(rows, 16, "doc_id").collect()
    assert calls.value == 40


def test_equal_orders_lose_no_token(spark):
    rows = spark.createDataFrame([(i % 3, [i] * 5) for i in range(20)], "doc_id long, tokens array<int>")
    got = packing.pack_tokens(rows, 9).collect()
    assert len(got) == 11
    flat = [x for r in sorted(got, key=lambda r: r.block) for x in r.input_ids]
    assert all(flat[i : i + 5] == [flat[i]] * 5 for i in range(0, 95, 5)) and [x % 3 for x in flat] == sorted(x % 3 for x in flat)


def test_each_chunk_is_normalised_once(spark, monkeypatch):
    squash, calls = counted(spark, lambda t: re.sub(" +", " ", t), StringType())
    monkeypatch.setattr(corpus, "normalize", lambda c, **_: squash(c))
    built = corpus.build_corpus(docs(spark), "doc_id", min_chars=5)
    assert built.count() == len({re.sub(" +", " ", r.text) for r in docs(spark).collect()}) and calls.value == 40


def test_first_of_equal_shuffles_rows_once(spark):
    big = docs(spark).hint("merge")
    kept = filters.first_of_equal(big, F.col("text"), "doc_id")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    wide = [line for line in plan.split("Exchange hashpartitioning")[1:] if "__order" in line.split(",", 2)[1]]
    assert plan.count("Exchange hashpartitioning") == 3 and len(wide) == 2  # keys for their first order; rows and first orders to meet
    rows = spark.createDataFrame([(2, "a", 1), (1, "a", 2), (1, "a", 3), (None, "b", 4), (None, None, 5), (3, None, 6), (None, "b", 7)], "doc_id long, text string, x int")
    got = sorted((str(r.doc_id), str(r.text)) for r in filters.first_of_equal(rows, F.col("text"), "doc_id").collect())
    assert got == [("1", "a"), ("3", "None"), ("None", "b")]


def test_packing_into_shards_moves_sequences_twice(spark, tmp_path):
    """To their offsets, and as slices to their shard; counting blocks moves none."""
    rows = docs(spark).withColumn("tokens", F.transform(F.split("text", ""), lambda c: F.ascii(c))).hint("merge")
    blocks = packing.pack_tokens(rows, 16, by=["split"], shard_rows=4)
    of_arrays = lambda df: [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in line]
    assert sum("shard" in line for line in of_arrays(blocks)) == 1 and not any("block" in line for line in of_arrays(blocks))
    counted_plan = packing.pack_tokens(rows, 16, by=["split"]).groupBy("split").count()._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in counted_plan
    index = sinks.write_shards(blocks, f"{tmp_path}/a", 4, gapless=True)
    plain = sinks.write_shards(packing.pack_tokens(rows, 16, by=["split"]), f"{tmp_path}/b", 4, gapless=True)
    assert sorted(map(str, index.collect())) == sorted(map(str, plain.collect())) and index.count() > 3


def test_small_shards_share_a_folder(spark, tmp_path):
    """Shards of a few blocks have the rows and hashes that they have in folders of their own."""
    rows = docs(spark, 60).withColumn("tokens", F.transform(F.split("text", ""), lambda c: F.ascii(c))).withColumn("split", F.when(F.col("doc_id") % 7 == 0, "val").otherwise("train"))
    single = sinks.write_shards(packing.pack_tokens(rows, 16, by=["split"], shard_rows=2), f"{tmp_path}/a", 2, gapless=True)
    index = sinks.write_shards(packing.pack_tokens(rows, 16, by=["split"], shard_rows=2, together=5), f"{tmp_path}/b", 2, gapless=True)
    assert sorted(map(str, index.collect())) == sorted(map(str, single.collect())) and index.count() > 20
    folders, written = ([len(list(tmp_path.glob(f"{x}/split=*/{at}"))) for x in "ab"] for at in ("shard*", "shard*/*.parquet"))
    assert folders[0] == index.count() and folders[1] <= folders[0] // 5 + 2 and written == folders
    assert all(r.ok for r in sinks.verify_shards(spark, f"{tmp_path}/b").collect())
    read = lambda x: sorted(map(str, files.load_sharded(spark, f"{tmp_path}/{x}", "val").select("block", "place", "input_ids", "labels").collect()))
    assert read("a") == read("b") and len(read("a")) > 5


@pytest.mark.parametrize("kind", ["int", "bigint"])
def test_tokens_of_any_width_are_packed(spark, kind):
    """Sequences travel as bytes, shorts or as they are; blocks have what they had, with and without shards."""
    kinds = [[0, 127, -128], [255, 3, 128], [-5, 200], [32767, -32768], [32768, 1], [-(1 << 31), (1 << 31) - 1], [None, 4], [None], [256, None, 0], [], None]
    rows = [(i, kinds[i % len(kinds)]) for i in range(90)]
    flat = [x for _, t in rows for x in t or []]
    df = spark.createDataFrame(rows, f"doc_id long, tokens array<{kind}>").repartition(5)
    want = [(b, flat[7 * b : 7 * b + 7], flat[7 * b + 1 : 7 * b + 8]) for b in range((len(flat) - 1) // 7)]
    for shards in ({}, {"shard_rows": 2}, {"shard_rows": 2, "together": 3}):
        got = packing.pack_tokens(df, 7, **shards)
        assert sorted(((r.block, r.input_ids, r.labels) for r in got.collect()), key=lambda r: r[0]) == want and dict(got.dtypes)["labels"] == f"array<{kind}>"
        assert not shards or all(r.shard == r.block // 2 for r in got.collect())


def test_sequences_meet_their_offsets_without_a_join_of_tokens(spark):
    """What is read of the sequences is shuffled once, as slices; the totals of ranges are broadcast. Shuffle files are kept by everybody else."""
    rows = docs(spark).withColumn("tokens", F.transform(F.split("text", ""), lambda c: F.ascii(c)))
    plan = packing.pack_tokens(rows, 16, by=["split"], shard_rows=4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
