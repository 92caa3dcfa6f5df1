"""Registered queries on packing, instruction pairs, metrics, the registry and streams. Beside each, its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.functions import tokens
from strataloom.operators import corpus, instruction, metrics, ordering, packing, registry, splitting
from strataloom.plans.corpus import BUCKET, PRETOKENS, STRIPPED, WS, documents, query, scratch
from strataloom.sources import files, sinks
from strataloom.streaming import streams

SEQ = 128
END = 3


def code_points(col):
    return F.when(col == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(col, ""), lambda c: F.ascii(c)))


def with_tokens(spark, sf_dir):
    """Documents as code points and an end mark, split by hash."""
    docs = splitting.hash_split(documents(spark, sf_dir))
    return docs.select("doc_id", "split", F.concat(code_points(F.col("text")), F.array(F.lit(END))).alias("tokens"))


def digest(c):
    return F.md5(F.concat_ws(",", c))


_TOKENS = f"""WITH d AS (SELECT doc_id, CASE WHEN {BUCKET} < 50 THEN 'val' ELSE 'train' END AS split, list_append(list_transform(string_split(text, ''), lambda c: CAST(unicode(c) AS INTEGER)), {END}) AS toks FROM documents),
u AS (SELECT split, doc_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS p FROM d),
o AS (SELECT split, tok, row_number() OVER (PARTITION BY split ORDER BY doc_id, p) - 1 AS pos, count(*) OVER (PARTITION BY split) AS n FROM u)"""
_BLOCKS = f"""{_TOKENS},
l AS (SELECT split, pos // {SEQ} AS block, pos, tok, lead(tok) OVER (PARTITION BY split ORDER BY pos) AS label, n FROM o)"""
_PACKED = f"""{_BLOCKS}, b AS (SELECT split, block, string_agg(tok::VARCHAR, ',' ORDER BY pos) AS i, string_agg(label::VARCHAR, ',' ORDER BY pos) AS l FROM l WHERE block < (n - 1) // {SEQ} GROUP BY split, block)"""


@query(f"{_PACKED} SELECT split, block, md5(i) AS input_ids, md5(l) AS labels FROM b")
def pack_blocks(spark, sf_dir):
    blocks = packing.pack_tokens(with_tokens(spark, sf_dir), SEQ, by=["split"])
    return blocks.select("split", "block", digest("input_ids").alias("input_ids"), digest("labels").alias("labels"))


@query(f"SELECT n AS n_tokens, greatest(0, (n - 1) // {SEQ})::BIGINT AS lm_blocks, (n // {SEQ})::BIGINT AS sft_blocks FROM (SELECT sum(length(text) + 1)::BIGINT AS n FROM documents)")
def pack_counts(spark, sf_dir):
    return packing.block_counts(with_tokens(spark, sf_dir), SEQ)


@query(f"""{_PACKED}, r AS (SELECT split, block, block // 4096 AS shard, sha256(concat(i, '|', l)) AS h FROM b)
SELECT split, shard::INTEGER AS shard, count(*) AS rows, (count(*) * {SEQ})::BIGINT AS tokens, sha256(string_agg(h, '' ORDER BY block)) AS sha256 FROM r GROUP BY split, shard""")
def shard_manifest(spark, sf_dir):
    """Blocks written as shards; the index that was read back from them."""
    blocks = packing.pack_tokens(with_tokens(spark, sf_dir), SEQ, by=["split"], shard_rows=4096)
    return sinks.write_shards(blocks, scratch(spark, "shards"), 4096, {"seq_len": SEQ}, gapless=True)


@query(f"""{_BLOCKS}, w AS (SELECT DISTINCT split, block FROM l WHERE block < (n - 1) // {SEQ}), k AS (SELECT CASE WHEN {BUCKET} < 50 THEN 'val' ELSE 'train' END AS split FROM documents)
SELECT (SELECT count(*) FROM k WHERE split = 'train') AS train_docs, (SELECT count(*) FROM k WHERE split = 'val') AS val_docs, count(*) FILTER (split = 'train') AS train_sequences, count(*) FILTER (split = 'val') AS val_sequences, (count(*) * {SEQ})::BIGINT AS total_tokens FROM w""")
def pack_manifest(spark, sf_dir):
    """Documents and sequences of a pack by split, and its tokens."""
    index = sinks.write_shards(packing.pack_tokens(with_tokens(spark, sf_dir), SEQ, by=["split"], shard_rows=4096), scratch(spark, "shards"), 4096, {"seq_len": SEQ}, gapless=True)
    return corpus.pack_manifest(index, documents(spark, sf_dir), 0.05)


@query(f"{_PACKED}, r AS (SELECT DISTINCT split, block // 4096 AS shard FROM b) SELECT split, shard::INTEGER AS shard, true AS ok FROM r")
def shard_verify(spark, sf_dir):
    folder = scratch(spark, "shards")
    sinks.write_shards(packing.pack_tokens(with_tokens(spark, sf_dir), SEQ, by=["split"], shard_rows=4096), folder, 4096, gapless=True)
    return sinks.verify_shards(spark, folder)


@query(f"{_PACKED} SELECT block, block AS place, md5(i) AS input_ids FROM b WHERE split = 'val'")
def load_shards(spark, sf_dir):
    folder = scratch(spark, "shards")
    sinks.write_shards(packing.pack_tokens(with_tokens(spark, sf_dir), SEQ, by=["split"], shard_rows=64, together=64), folder, 64, gapless=True)
    return files.load_sharded(spark, folder, "val").select("block", "place", digest("input_ids").alias("input_ids"))


# --- instruction pairs

_SQ = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '{WS}+', ' ', 'g'))"
_PAIRS = f"""WITH c AS (SELECT conv_id, turn, role, {_SQ('text')} AS t FROM conversations),
j AS (SELECT a.t AS instruction, '' AS "input", b.t AS output, b.conv_id * 1000000 + b.turn AS ord FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
  WHERE a.role = 'user' AND b.role = 'assistant' AND a.t <> '' AND b.t <> '' AND length(a.t) <= 2000 AND length(b.t) <= 2000),
pairs AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY instruction ORDER BY ord) = 1)"""


def sft(spark, sf_dir):
    return instruction.pair_messages(instruction.conversation_messages(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


@query(f"{_PAIRS} SELECT * FROM pairs")
def sft_pairs(spark, sf_dir):
    return sft(spark, sf_dir)


@query(f"{_PAIRS}, t AS (SELECT * FROM pairs UNION ALL SELECT instruction, \"input\", output, ord + 1000000000 FROM pairs) SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY instruction, output ORDER BY ord) = 1")
def sft_dedup(spark, sf_dir):
    """Every pair twice, then once."""
    pairs = sft(spark, sf_dir)
    return instruction.dedup_pairs(pairs.union(pairs.withColumn("ord", F.col("ord") + 1_000_000_000)))


@query(f"""WITH d AS (SELECT doc_id AS ord, {_SQ('lang')} AS instruction, {_SQ('source')} AS "input", {_SQ('text')} AS output FROM documents) SELECT * FROM d WHERE instruction <> '' AND output <> '' AND length(output) <= 2000""")
def instruction_records(spark, sf_dir):
    rows = documents(spark, sf_dir).select(F.col("doc_id").alias("ord"), F.col("lang").alias("instruction"), F.col("source").alias("context"), F.col("text").alias("response"))
    return instruction.instruction_records(rows)


@query(f"{_PAIRS} SELECT ord, 'Instruction: ' || instruction AS prompt, 'Instruction: ' || instruction || chr(10) || 'Input: ' || output AS with_input FROM pairs")
def sft_prompts(spark, sf_dir):
    i, o = F.col("instruction"), F.col("output")
    return sft(spark, sf_dir).select("ord", instruction.prompt_text(i, F.col("input")).alias("prompt"), instruction.prompt_text(i, o).alias("with_input"))


def examples(spark, sf_dir):
    prompt = code_points(instruction.prompt_text(F.col("instruction"), F.col("input")))
    inp, labels = packing.sft_example(prompt, code_points(F.col("output")), END)
    return sft(spark, sf_dir).select("ord", inp.alias("input_ids"), labels.alias("labels"))


_EXAMPLES = f"""{_PAIRS},
e AS (SELECT ord, list_transform(string_split('Instruction: ' || instruction, ''), lambda c: CAST(unicode(c) AS INTEGER)) AS p, list_append(list_transform(string_split(output, ''), lambda c: CAST(unicode(c) AS INTEGER)), {END}) AS r FROM pairs),
x AS (SELECT ord, list_concat(p, r) AS i, list_concat(list_transform(p, lambda y: -100), r) AS l FROM e)"""


@query(f"{_EXAMPLES} SELECT ord, len(i)::BIGINT AS n, md5(array_to_string(i, ',')) AS input_ids, md5(array_to_string(l, ',')) AS labels FROM x")
def sft_mask(spark, sf_dir):
    return examples(spark, sf_dir).select("ord", F.size("input_ids").cast("long").alias("n"), digest("input_ids").alias("input_ids"), digest("labels").alias("labels"))


@query(f"""{_EXAMPLES}, u AS (SELECT ord, unnest(i) AS tok, unnest(l) AS lab, generate_subscripts(i, 1) AS p FROM x),
o AS (SELECT tok, lab, row_number() OVER (ORDER BY ord, p) - 1 AS pos, count(*) OVER () AS n FROM u)
SELECT pos // 64 AS block, md5(string_agg(tok::VARCHAR, ',' ORDER BY pos)) AS input_ids, md5(string_agg(lab::VARCHAR, ',' ORDER BY pos)) AS labels, bool_and(lab = -100) AS dropped FROM o WHERE pos // 64 < n // 64 GROUP BY 1""")
def sft_pack(spark, sf_dir):
    blocks = packing.pack_sft(examples(spark, sf_dir), 64, "ord")
    return blocks.select("block", digest("input_ids").alias("input_ids"), digest("labels").alias("labels"), "dropped")


@query(f"""{_EXAMPLES}, u AS (SELECT ord, unnest(l) AS lab, generate_subscripts(i, 1) AS p FROM x),
o AS (SELECT lab, row_number() OVER (ORDER BY ord, p) - 1 AS pos, count(*) OVER () AS n FROM u)
SELECT pos // 64 // 2 AS batch, count(DISTINCT pos // 64) AS rows, bool_and(lab = -100) AS skipped FROM o WHERE pos // 64 < n // 64 GROUP BY 1""")
def masked_batches(spark, sf_dir):
    """Batches of two blocks, and whether training skips them."""
    return packing.trainable_batches(packing.pack_sft(examples(spark, sf_dir), 64, "ord"), 2)


@query(f"""{_EXAMPLES}, u AS (SELECT ord, unnest(l) AS lab, generate_subscripts(i, 1) AS p FROM x),
o AS (SELECT lab, row_number() OVER (ORDER BY ord, p) - 1 AS pos, count(*) OVER () AS n FROM u),
b AS (SELECT pos // 64 AS block, bool_and(lab = -100) AS dropped FROM o WHERE pos // 64 < n // 64 GROUP BY 1)
SELECT count(*) FILTER (NOT dropped) AS blocks, count(*) FILTER (dropped) AS dropped_all_masked FROM b""")
def sft_pack_counts(spark, sf_dir):
    blocks = packing.pack_sft(examples(spark, sf_dir), 64, "ord")
    return blocks.agg(F.count_if(~F.col("dropped")).alias("blocks"), F.count_if("dropped").alias("dropped_all_masked"))


_ESCAPED = lambda c: f"array_to_string(list_transform(string_split({c}, ''), lambda x: CASE WHEN x IN ('\"', chr(92)) THEN concat(chr(92), x) WHEN unicode(x) BETWEEN 32 AND 127 THEN x WHEN unicode(x) < 65536 THEN concat(chr(92), 'u', printf('%04x', unicode(x))) ELSE concat(chr(92), 'u', printf('%04x', 55296 + (unicode(x) - 65536) // 1024), chr(92), 'u', printf('%04x', 56320 + (unicode(x) - 65536) % 1024)) END), '')"


@query(f"""{_PAIRS}, k AS (SELECT ord, concat('{{"input": "", "instruction": "', {_ESCAPED('instruction')}, '", "output": "', {_ESCAPED('output')}, '"}}') AS text FROM pairs) SELECT ord, CASE WHEN {BUCKET} < 200 THEN 'val' ELSE 'train' END AS split FROM k""")
def sft_split(spark, sf_dir):
    """Pairs split by the hash of their JSON with sorted keys."""
    keyed = sft(spark, sf_dir).withColumn("key", instruction.canonical_json(F.col("instruction"), F.col("input"), F.col("output")))
    return splitting.hash_split(keyed, 0.2, "key").select("ord", "split")


@query(f"{_PAIRS} SELECT instruction, \"input\", output FROM pairs")
def json_lines_roundtrip(spark, sf_dir):
    folder = scratch(spark, "pairs")
    sinks.append_metrics(sft(spark, sf_dir).drop("ord"), folder)
    return instruction.pair_source(spark, folder)


# --- metrics


def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


@query("""SELECT event_id, step, round(CASE WHEN step < 10 THEN 1.0 * (step + 1) / 10 WHEN step >= 110 THEN 0.1 ELSE 0.1 + 0.9 * (0.5 * (1 + cos(pi() * (step - 10) / 100.0))) END, 9)::DOUBLE AS lr
  FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS step FROM events)""")
def lr_schedule(spark, sf_dir):
    """A user's events are the steps of a run: the learning rate at each."""
    steps = ordering.position(events(spark, sf_dir).select("event_id", "user_id"), "event_id", "step", by=["user_id"])
    return steps.select("event_id", "step", F.round(metrics.learning_rate(F.col("step"), 1.0, 0.1, 10, 110), 9).alias("lr"))


_STOPS = ", ".join(f"({k}, {v})" for k, v in metrics.LEG_STOPS.items())
_LEGS = f"SELECT event_id, step, coalesce((SELECT min(k) FROM (VALUES {_STOPS}) l(k, s) WHERE step < s AND step >= 5000), 0)::INTEGER AS leg FROM (SELECT event_id, event_id * 13 AS step FROM events)"


def _legs(spark, sf_dir):
    steps = events(spark, sf_dir).select("event_id", (F.col("event_id") * 13).alias("step"))
    return steps.withColumn("leg", F.coalesce(metrics.leg_of_step(F.col("step")), F.lit(0)))


@query(f"SELECT leg, coalesce((SELECT s FROM (VALUES {_STOPS}) l(k, s) WHERE k = leg), {max(metrics.LEG_STOPS.values())})::INTEGER AS stop_step, count(*) AS steps, max(step) AS last_step FROM ({_LEGS}) GROUP BY leg")
def leg_ladder(spark, sf_dir):
    """The steps that events stand for, counted by leg, with the leg's stop."""
    return _legs(spark, sf_dir).groupBy("leg").agg(F.count(F.lit(1)).alias("steps"), F.max("step").alias("last_step")).select("leg", metrics.leg_stop(F.col("leg")).alias("stop_step"), "steps", "last_step")


@query(_LEGS)
def leg_of_step(spark, sf_dir):
    return _legs(spark, sf_dir)


@query("SELECT round(avg(ln(1 + exp(-0.1 * ((n_chars % 97) / 3.0 - (n_chars % 89) / 3.0)))), 9) AS loss, count(*) AS pairs FROM documents")
def dpo_loss(spark, sf_dir):
    docs, zero = documents(spark, sf_dir), F.lit(0.0)
    loss = metrics.preference_loss((F.col("n_chars") % 97) / 3.0, (F.col("n_chars") % 89) / 3.0, zero, zero, 0.1)
    return docs.agg(F.round(F.avg(loss), 9).alias("loss"), F.count(F.lit(1)).alias("pairs"))


@query("SELECT doc_id, round(list_sum(list_transform(range(20), lambda i: CASE WHEN (doc_id + i) % 3 = 0 THEN 0.0 ELSE -((doc_id * 7 + i) % 11) / 4.0 END)), 9)::DOUBLE AS logp FROM documents")
def sequence_logps(spark, sf_dir):
    at = F.sequence(F.lit(0), F.lit(19))
    logps = F.transform(at, lambda i: -((F.col("doc_id") * 7 + i) % 11) / 4.0)
    labels = F.transform(at, lambda i: F.when((F.col("doc_id") + i) % 3 == 0, -100).otherwise(1))
    return documents(spark, sf_dir).select("doc_id", F.round(metrics.sequence_logp(logps, labels), 9).alias("logp"))


@query("SELECT round(avg(n_chars / 1000.0), 9)::DOUBLE AS loss, round(exp(avg(n_chars / 1000.0)), 9)::DOUBLE AS perplexity, round(sum(n_chars % 7) / sum(7 + n_chars % 5), 9)::DOUBLE AS accuracy, count(*) AS batches FROM documents")
def eval_metrics(spark, sf_dir):
    batches = documents(spark, sf_dir).select((F.col("n_chars") / 1000.0).alias("loss"), (F.col("n_chars") % 7).alias("n_correct"), (7 + F.col("n_chars") % 5).alias("n_tokens"))
    out = metrics.evaluation(batches)
    return out.select(*[F.round(c, 9).alias(c) if k == "double" else c for c, k in out.dtypes])


@query("SELECT user_id, arg_min(value, event_id) AS first_loss, arg_max(value, event_id) AS last_loss, max(event_id) AS last_step FROM events WHERE event_type <> 'click' AND value IS NOT NULL GROUP BY user_id")
def run_metrics(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    history = events.select("user_id", F.col("event_id").alias("step"), F.when(F.col("event_type") != "click", F.col("value")).alias("loss"))
    return metrics.run_summary(history, ["user_id"])


@query("SELECT round(avg(value), 6) AS val_loss FROM events")
def val_loss(spark, sf_dir):
    return metrics.mean_loss(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("value").alias("loss"))).select(F.round("val_loss", 6).alias("val_loss"))


# --- registry


def run_updates(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    null = F.lit(None).cast("string")
    at = F.timestamp_seconds(F.col("event_id"))
    return events.select(F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("model_name"), null.alias("git_commit"), null.alias("dataset_hash"), null.alias("tokenizer_hash"), F.lit("{}").alias("config"), F.concat(F.lit("s-"), "event_type").alias("status"), at.alias("created_utc"), at.alias("updated_utc"))


def known_runs(spark, sf_dir):
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().where("user_id % 2 = 0")
    null, at = F.lit(None).cast("string"), F.timestamp_seconds(F.lit(-1))
    return users.select(F.col("user_id").cast("string").alias("run_id"), F.lit("base").alias("model_name"), null.alias("git_commit"), null.alias("dataset_hash"), null.alias("tokenizer_hash"), F.lit("{}").alias("config"), F.lit("created").alias("status"), at.alias("created_utc"), at.alias("updated_utc"))


@query("""SELECT user_id::VARCHAR AS run_id, CASE WHEN user_id % 2 = 0 THEN 'base' ELSE arg_min(event_type, event_id) END AS model_name, 's-' || arg_max(event_type, event_id) AS status,
  CASE WHEN user_id % 2 = 0 THEN -1 ELSE min(event_id) END AS created, max(event_id) AS updated FROM events GROUP BY user_id""")
def run_upsert(spark, sf_dir):
    runs = registry.upsert_runs(known_runs(spark, sf_dir), run_updates(spark, sf_dir))
    return runs.select("run_id", "model_name", "status", F.unix_seconds("created_utc").alias("created"), F.unix_seconds("updated_utc").alias("updated"))


def checkpoint_updates(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.col("user_id").cast("string").alias("run_id"), (F.col("event_id") % 5).cast("int").alias("step"), F.col("event_id").alias("tokens_seen"), F.col("value").alias("train_loss"), F.lit(None).cast("double").alias("val_loss"), F.col("event_type").alias("checkpoint_uri"), F.timestamp_seconds(F.col("event_id")).alias("created_utc"))


@query("SELECT user_id::VARCHAR AS run_id, (event_id % 5)::INTEGER AS step, max(event_id) AS tokens_seen, arg_max(value, event_id) AS train_loss, arg_max(event_type, event_id) AS checkpoint_uri FROM events WHERE user_id % 2 = 0 GROUP BY 1, 2")
def checkpoint_upsert(spark, sf_dir):
    updates = checkpoint_updates(spark, sf_dir)
    new, _ = registry.upsert_checkpoints(spark.createDataFrame([], registry.CHECKPOINTS), updates, known_runs(spark, sf_dir))
    return new.select("run_id", "step", "tokens_seen", "train_loss", "checkpoint_uri")


@query("SELECT user_id::VARCHAR AS run_id, CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 'training' ELSE 'created' END AS status FROM events WHERE user_id % 2 = 0 GROUP BY user_id")
def checkpoint_status(spark, sf_dir):
    updates = checkpoint_updates(spark, sf_dir).where("checkpoint_uri = 'purchase'")
    _, runs = registry.upsert_checkpoints(spark.createDataFrame([], registry.CHECKPOINTS), updates, known_runs(spark, sf_dir))
    return runs.select("run_id", "status")


@query(f"""{_PACKED} SELECT 2 * count(*) FILTER (split = 'train')::BIGINT AS train_sequences, 2 * count(*) FILTER (split = 'val')::BIGINT AS val_sequences,
  2 * count(*) FILTER (split = 'train')::BIGINT * {SEQ} AS total_tokens, 2 * count(*)::BIGINT * {SEQ} AS total_tokens_real FROM b""")
def merge_totals(spark, sf_dir):
    """A pack merged with itself."""
    blocks = packing.pack_tokens(with_tokens(spark, sf_dir), SEQ, by=["split"])
    meta = {"tokenizer_sha256": "0", "vocab_size": 1, "seq_len": SEQ, "eos_text": None, "total_tokens": blocks.count() * SEQ}
    _, m = registry.merge_packs([(blocks, meta), (blocks, meta)])
    return spark.createDataFrame([tuple(int(m[k]) for k in ("train_sequences", "val_sequences", "total_tokens", "total_tokens_real"))], "train_sequences long, val_sequences long, total_tokens long, total_tokens_real long")


# --- streams


def _stream(spark, sf_dir):
    schema = documents(spark, sf_dir).schema
    path = f"{sf_dir}/documents.parquet"
    # a stream source reads folders or patterns
    return streams.document_stream(spark, path if not path.endswith(".parquet") else f"{sf_dir}/document[s].parquet", schema)


@query(f"SELECT DISTINCT sha256({STRIPPED}) AS sha FROM documents")
def stream_dedup(spark, sf_dir):
    folder = scratch(spark, "stream")
    streams.run_to_table(streams.deduplicated(_stream(spark, sf_dir)), f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out").select("sha")


@query("SELECT doc_id FROM (SELECT doc_id, coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM documents WHERE length(" + STRIPPED + ") >= 200 AND (lang IS NULL OR lang = 'en')) WHERE spent < 400000")
def stream_budget(spark, sf_dir):
    """The budget is spent in order of doc_id, whatever the order of the files."""
    folder = scratch(spark, "budget")
    streams.run_with_budget(_stream(spark, sf_dir), f"{folder}/out", f"{folder}/state", "doc_id", 400_000)
    return spark.read.parquet(f"{folder}/out").select("doc_id")


@query("SELECT doc_id, cost FROM (SELECT doc_id, n AS cost, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM (SELECT doc_id, len(" + PRETOKENS + ")::BIGINT AS n FROM documents WHERE length(" + STRIPPED + ") >= 200 AND (lang IS NULL OR lang = 'en'))) WHERE spent < 90000")
def stream_token_budget(spark, sf_dir):
    """The budget in exact counts: what a document costs is the number of its pre-tokens."""
    folder = scratch(spark, "budget")
    streams.run_with_budget(_stream(spark, sf_dir), f"{folder}/out", f"{folder}/state", "doc_id", 90_000, cost=F.size(tokens.pretokens(F.col("text"))))
    return spark.read.parquet(f"{folder}/out").select("doc_id", "cost")


@query(f"""WITH k AS (SELECT {STRIPPED} AS t FROM documents WHERE length({STRIPPED}) >= 200 AND (lang IS NULL OR lang = 'en')), d AS (SELECT DISTINCT t FROM k)
SELECT (SELECT count(*) FROM documents) + 5 AS docs_scanned, count(*) AS docs_kept, sum(length(t))::BIGINT AS chars, 1000000::BIGINT AS token_budget, NULL::BIGINT AS actual_tokens, 'char-estimate' AS counting, NULL::VARCHAR AS truncated FROM d""")
def stream_manifest(spark, sf_dir):
    """Counters of a whole stream, five rows skipped before it."""
    folder = scratch(spark, "manifest")
    return streams.run_with_manifest(_stream(spark, sf_dir), f"{folder}/out", f"{folder}/state", skip=5, token_budget=1_000_000)


@query(f"""{_PACKED}, r AS (SELECT split, block, block // 512 AS shard, sha256(concat(i, '|', l)) AS h FROM b),
x AS (SELECT split, shard, concat('{{"shard":', shard, ',"rows":', count(*), ',"tokens":', count(*) * {SEQ}, ',"sha256":"', sha256(string_agg(h, '' ORDER BY block)), '"}}') AS j FROM r GROUP BY split, shard),
y AS (SELECT split, concat('"', split, '":[', string_agg(j, ',' ORDER BY shard), ']') AS j FROM x GROUP BY split)
SELECT concat('{{"version":"1","splits":{{', string_agg(j, ',' ORDER BY split), '}},"seq_len":{SEQ}}}') AS document FROM y""")
def index_document(spark, sf_dir):
    """The index of a pack as one JSON document."""
    folder = scratch(spark, "indexed")
    index = sinks.write_shards(packing.pack_tokens(with_tokens(spark, sf_dir), SEQ, by=["split"], shard_rows=512), folder, 512, gapless=True)
    return sinks.index_document(index, "1", seq_len=SEQ)
