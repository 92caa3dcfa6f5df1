import random

import pytest
from pyspark.sql import functions as F

from strataloom.operators import bpe, filters, instruction, metrics, near_dup, ordering, packing, registry, splitting
from strataloom.sources import files, sinks


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


def test_running_sums_and_windows(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.randrange(9), "ab"[i % 2]) for i in rnd.sample(range(500), 200)]
    df = frame(spark, rows, "i long, v long, g string")
    got = {r.i: (r.s, r.p) for r in ordering.position(ordering.running_sum(df, F.col("v"), "i", "s", by=["g"], ranges=7), "i", "p").collect()}
    seen, want = {"a": 0, "b": 0}, {}
    for k, (i, v, g) in enumerate(sorted(rows)):
        want[i] = (seen[g], k)
        seen[g] += v
    assert got == want
    ids = sorted(i for i, *_ in rows)
    parts = [sorted(r.i for r in ordering.offset_window(df, "i", s, 60).collect()) for s in range(0, 240, 60)]
    assert [x for p in parts for x in p] == ids and parts[0] == ids[:60]
    assert ordering.offset_window(df, "i", 1000).count() == 0
    with pytest.raises(ValueError):
        ordering.offset_window(df, "i", -1)


def test_budget_may_be_overshot_once(spark):
    df = frame(spark, [(i, 40) for i in range(20)], "i long, n long")
    assert sorted(r.i for r in ordering.within_budget(df, F.col("n"), "i", 100).collect()) == [0, 1, 2]


def test_filters(spark):
    rows = [("x" * 200, "en", None), ("x" * 200, None, 0.0), ("x" * 200, "en", 0.49), ("x" * 200, "en", 0.5), ("x" * 200, "de", 0.9), (" " * 300, "en", 0.9), (None, "en", 0.9)]
    got = filters.stream_filter(frame(spark, [(i, *r) for i, r in enumerate(rows)], "i int, text string, lang string, score double"), score_col="score")
    assert sorted(r.i for r in got.collect()) == [0, 1, 3]


def test_first_of_equal_and_counters(spark):
    docs = frame(spark, [(3, "same text here"), (1, "same text here"), (2, "other text here"), (5, "tiny"), (4, "tiny"), (1, "same text here")], "doc_id long, text string")
    assert sorted(r.doc_id for r in filters.exact_dedup(docs).collect()) == [1, 2, 4]
    assert tuple(filters.dedup_counters(docs, 10).first()) == (2, 2, 2, 29)
    assert tuple(filters.dedup_counters(docs.limit(0)).first()) == (0, 0, 0, 0)


def test_splits(spark):
    docs = frame(spark, [(i, f"document {i % 50}") for i in range(60)], "doc_id long, text string")
    split = splitting.hash_split(docs, 0.2)
    sides = {r.text: r.split for r in split.collect()}
    assert len(sides) == 50 and set(sides.values()) == {"train", "val"}
    splitting.require_both_splits(split)
    with pytest.raises(ValueError):
        splitting.require_both_splits(splitting.hash_split(docs, 0.0005))
    blocks = frame(spark, [(i,) for i in range(10)], "block long")
    assert sorted(r.block for r in splitting.prefix_split(blocks, "block", 0.2).where("split = 'val'").collect()) == [8, 9]
    assert splitting.prefix_split(blocks.limit(0), "block", 0.2).count() == 0


@pytest.mark.parametrize("seq_len", [1, 3, 7, 64])
def test_packing(spark, seq_len):
    rnd = random.Random(seq_len)
    docs = [(i, [rnd.randrange(100) for _ in range(rnd.choice([0, 1, 2, 5, 40]))]) for i in range(30)]
    flat = [t for _, ids in docs for t in ids]
    want = [(flat[s : s + seq_len], flat[s + 1 : s + seq_len + 1]) for s in range(0, len(flat) - seq_len, seq_len)]
    df = frame(spark, docs, "doc_id long, tokens array<int>")
    got = sorted((r.block, r.input_ids, r.labels) for r in packing.pack_tokens(df, seq_len).collect())
    assert [(i, l) for _, i, l in got] == want and [b for b, *_ in got] == list(range(len(want)))
    n = packing.block_counts(df, seq_len).first()
    assert (n.n_tokens, n.lm_blocks, n.sft_blocks) == (len(flat), len(want), len(flat) // seq_len)
    with pytest.raises(ValueError):
        packing.pack_tokens(df, 0)


def test_instruction_packing(spark):
    rows = frame(spark, [(0, [1, 2, 3], [4, 5]), (1, [6], [7, 8]), (2, [9] * 12, [10])], "ord long, p array<int>, r array<int>")
    inp, labels = packing.sft_example(F.col("p"), F.col("r"), 0)
    pairs = rows.select("ord", inp.alias("input_ids"), labels.alias("labels"))
    flat_i = [1, 2, 3, 4, 5, 0, 6, 7, 8, 0, *[9] * 12, 10, 0]
    flat_l = [-100] * 3 + [4, 5, 0, -100, 7, 8, 0] + [-100] * 12 + [10, 0]
    got = sorted((r.block, r.input_ids, r.labels, r.dropped) for r in packing.pack_sft(pairs, 4, "ord").collect())
    assert got == [(k, flat_i[4 * k : 4 * k + 4], flat_l[4 * k : 4 * k + 4], set(flat_l[4 * k : 4 * k + 4]) == {-100}) for k in range(len(flat_i) // 4)]


def naive_merges(words, n):
    words, merges = {tuple(bytes([b]) for b in w): c for w, c in words.items()}, []
    while len(merges) < n:
        counts = {}
        for w, c in words.items():
            for p in zip(w, w[1:]):
                counts[p] = counts.get(p, 0) + c
        if not counts:
            break
        best = max(counts, key=lambda p: (counts[p], p))
        merges.append(best)
        new = {}
        for w, c in words.items():
            out, i = [], 0
            while i < len(w):
                if w[i : i + 2] == best:
                    out.append(w[i] + w[i + 1])
                    i += 2
                else:
                    out.append(w[i])
                    i += 1
            new[tuple(out)] = new.get(tuple(out), 0) + c
        words = new
    return merges


def test_learnt_merges_are_those_of_counting_anew():
    rnd = random.Random(3)
    words = {"".join(rnd.choice("aabbc é") for _ in range(rnd.randrange(1, 9))).encode(): rnd.randrange(1, 6) for _ in range(120)}
    got = bpe.learn_merges(words.items(), 256 + 60, [])
    assert got.merges == naive_merges(words, 60)


def test_tokenizer_round_trip(spark, tmp_path):
    docs = frame(spark, [(i, "the cat sat on the mat, the cats' hats " * 3) for i in range(5)], "doc_id long, text string")
    model = bpe.train(docs, 300)
    model.save(str(tmp_path / "t.json"))
    again = bpe.Tokenizer.load(str(tmp_path / "t.json"))
    assert (again.vocab, again.merges, again.specials) == (model.vocab, model.merges, model.specials)
    for t in ["the cat", "", "naïve 日本 😀", "  a\n\nb\t", "x<|endoftext|>y"]:
        assert model.decode(model.encode(t)) == t
    assert model.encode("x<|endoftext|>y")[1] == 256 and model.decode(model.encode("a\\b")) == "ab"
    coded = docs.withColumn("ids", bpe.encoder(model)(F.col("text")))
    assert [r.ids for r in coded.collect()] == [model.encode(r.text) for r in coded.collect()]
    with pytest.raises(ValueError):
        bpe.Tokenizer().encode("x")
    with pytest.raises(ValueError):
        bpe.train(docs.limit(0), 300)
    assert not bpe.frozen(model) and [t.count() for t in model.tables(spark)] == [len(model.vocab), len(model.merges)]


def test_near_duplicates(spark):
    base = "The quick brown fox jumps over the lazy dog and runs far away into the deep green forest tonight."
    rows = [(0, base), (1, base), (2, base + "!"), (3, "Something else entirely, about ships, sails and the open sea at dawn."), (4, ""), (5, "  ")]
    docs = frame(spark, rows, "doc_id long, text string")
    for native in (False, True):
        got = near_dup.near_dedup(docs, native=native, permutations=64, bands=8)
        assert sorted(r.doc_id for r in got.collect()) == [0, 3, 4]
    with pytest.raises(ValueError):
        near_dup.near_dedup(docs, threshold=0)


def test_exact_sketches_are_least_hashes(spark):
    import hashlib

    docs = frame(spark, [(0, "Hello  World again"), (1, "ab")], "doc_id long, text string")
    got = {r.doc_id: r.sketch for r in near_dup.exact_sketches(docs, 8).collect()}
    for i, t in ((0, b"hello world again"), (1, b"ab")):
        runs = {t[k : k + 5] for k in range(max(1, len(t) - 4))}
        assert got[i] == [min(int.from_bytes(hashlib.blake2b(s.to_bytes(4, "little") + r, digest_size=8).digest(), "little") for r in runs) - (1 << 63) for s in range(8)]


def test_message_pairs(spark):
    rows = [(0, "p1", None, "prompter", "en", "What is  it?"), (1, "a1", "p1", "assistant", "en", "It is this."), (2, "a2", "p1", "assistant", "en", "Another."), (3, "a3", "gone", "assistant", "en", "Orphan"), (4, "p2", None, "prompter", "de", "Was?"), (5, "a4", "p2", "assistant", "en", "Hm"), (6, "a5", "p3", "assistant", "en", "too early"), (7, "p3", None, "prompter", "en", "late"), (8, "p1", None, "prompter", "en", "New text"), (9, "a6", "p1", "assistant", "en", "Newer"), (10, "a7", "p3", "assistant", "en", "x" * 2001)]
    df = frame(spark, rows, "ord long, message_id string, parent_id string, role string, lang string, text string")
    got = sorted((r.ord, r.instruction, r.output) for r in instruction.pair_messages(df).collect())
    assert got == [(1, "What is it?", "It is this."), (9, "New text", "Newer")]
    assert instruction.pair_messages(df, max_pairs=1).count() == 1


def test_registry(spark):
    ts = lambda n: F.timestamp_seconds(F.lit(n))
    runs = spark.createDataFrame([("a", "m")], "run_id string, model_name string").select("run_id", "model_name", *[F.lit(None).cast("string").alias(c) for c in ("git_commit", "dataset_hash", "tokenizer_hash", "config")], F.lit("created").alias("status"), ts(0).alias("created_utc"), ts(0).alias("updated_utc"))
    more = runs.withColumn("run_id", F.explode(F.array(F.lit("a"), F.lit("b")))).withColumns({"model_name": F.lit("other"), "status": F.lit("done"), "updated_utc": ts(9)})
    got = {r.run_id: (r.model_name, r.status) for r in registry.upsert_runs(runs, more).collect()}
    assert got == {"a": ("m", "done"), "b": ("other", "done")}
    none = spark.createDataFrame([], registry.CHECKPOINTS)
    up = spark.createDataFrame([("a", 1, 10, 1.0, None, "u1"), ("zz", 1, 10, 1.0, None, "u")], "run_id string, step int, tokens_seen long, train_loss double, val_loss double, checkpoint_uri string").withColumn("created_utc", ts(5))
    new, after = registry.upsert_checkpoints(none, up, runs)
    assert [(r.run_id, r.tokens_seen) for r in new.collect()] == [("a", 10)] and after.first().status == "training"
    new, _ = registry.upsert_checkpoints(new, up.withColumn("tokens_seen", F.lit(99).cast("long")), runs)
    assert [(r.run_id, r.tokens_seen) for r in new.collect()] == [("a", 99)]


def test_packs_must_agree(spark):
    blocks = frame(spark, [("train", 0, [1], [2]), ("val", 0, [1], [2])], "split string, block long, input_ids array<int>, labels array<int>")
    meta = {"tokenizer_sha256": "s", "vocab_size": 5, "seq_len": 1, "eos_text": None, "total_tokens": 2, "train_docs": 1, "val_docs": 1}
    rows, m = registry.merge_packs([(blocks, meta), (blocks, meta)], "s")
    assert rows.count() == 4 and (m["total_tokens"], m["total_tokens_real"], m["train_docs"]) == (2, 4, 2)
    for bad in ([], [(blocks, meta), (blocks, meta | {"vocab_size": 6})]):
        with pytest.raises(ValueError):
            registry.merge_packs(bad)
    with pytest.raises(ValueError):
        registry.merge_packs([(blocks, meta)], "other")


def test_metrics(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(metrics.perplexity(F.lit(0.0))) == 1.0 and one(metrics.perplexity(F.lit(float("nan")))) != one(metrics.perplexity(F.lit(float("nan"))))
    assert abs(one(metrics.preference_loss(F.lit(1.0), F.lit(1.0), F.lit(2.0), F.lit(2.0), 0.1)) - 0.6931471805599453) < 1e-12
    assert one(metrics.preference_loss(F.lit(30.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), 1.0)) < 1e-9
    assert abs(one(metrics.preference_loss(F.lit(-3000.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), 1.0)) - 3000) < 1e-9
    rows = spark.range(130).select(metrics.learning_rate(F.col("id"), 1.0, 0.1, 10, 110).alias("r")).collect()
    assert rows[0].r == 0.1 and rows[9].r == 1.0 and abs(rows[60].r - 0.55) < 1e-9 and rows[110].r == 0.1
    faults = metrics.config_faults(spark.createDataFrame([("ok", 64, 4, 2, 10), ("bad", 65, 4, 3, 0)], "name string, hidden_size int, num_heads int, num_kv_heads int, vocab_size int"))
    assert {r.name for r in faults.collect()} == {"bad"} and faults.count() == 3


def test_shards_and_tampering(spark, tmp_path):
    blocks = frame(spark, [("train", i, [i, i], [i, i]) for i in range(10)] + [("val", 0, [7, 7], [7, 7])], "split string, block long, input_ids array<int>, labels array<int>")
    folder = str(tmp_path / "pack")
    index = {(r.split, r.shard): (r.rows, r.tokens) for r in sinks.write_shards(blocks, folder, 4).collect()}
    assert index == {("train", 0): (4, 8), ("train", 1): (4, 8), ("train", 2): (2, 4), ("val", 0): (1, 2)}
    assert all(r.ok for r in sinks.verify_shards(spark, folder).collect())
    assert [r.place for r in files.load_sharded(spark, folder, "train").orderBy("block").collect()] == list(range(10))
    bad = spark.createDataFrame([(8, [8, 8], [0, 0]), (9, [9, 9], [0, 0])], "block long, input_ids array<int>, labels array<int>")
    bad.write.mode("overwrite").parquet(f"{folder}/split=train/shard=2")
    assert {(r.split, r.shard) for r in sinks.verify_shards(spark, folder).where("NOT ok").collect()} == {("train", 2)}
    with pytest.raises(ValueError):
        sinks.with_shards(blocks, 0)


def test_files(spark, tmp_path):
    src = tmp_path / "src"
    (src / "deep").mkdir(parents=True)
    (src / "a.txt").write_bytes("one\r\n\r\ntwo\n\nthree".encode())
    (src / "deep" / "b.PY").write_text("x = 1\n\n\ny = 2")
    (src / "c.md").write_bytes(b"\xff\xfe bad")
    (src / ".gitkeep").write_text("")
    (src / "d.csv").write_text("no")
    (src / "big.txt").write_text("z" * 5000)
    found = files.collect_files(spark, str(src), 10, 1000)
    docs = sorted((r.path.rsplit("/", 1)[1], r.chunk, r.text) for r in files.file_documents(found).collect())
    assert docs == [("a.txt", 0, "one"), ("a.txt", 1, "two"), ("a.txt", 2, "three"), ("b.PY", 0, "x = 1\n\n\ny = 2")]
    assert files.collect_files(spark, str(src), 1, 1000).count() == 1 and files.collect_files(spark, str(tmp_path / "none")).count() == 0
    cut = lambda t, eos: spark.range(1).select(files.split_documents(F.lit(t), eos).alias("x")).first().x
    assert cut("doc one\n<E>\ndoc two\n<E>\n", "<E>") == ["doc one", "doc two"] and cut("a\n\nb\n\n\n\n", None) == ["a", "b"]


def test_seeds(spark, tmp_path):
    folder = str(tmp_path / "raw")
    assert files.seed_if_empty(spark, folder, ["first doc", "second doc"]) and not files.seed_if_empty(spark, folder, ["third"])
    docs = files.file_documents(files.collect_files(spark, folder)).where("text <> ''")
    assert sorted(r.text for r in docs.collect()) == ["first doc", "second doc"]
    assert [r.output for r in files.seed_pairs(spark, [("a", "", "b"), ("c", "", "d")], 1).collect()] == ["b"]
