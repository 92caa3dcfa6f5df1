import hashlib
import math
from collections import Counter

import tiktoken

import corpus_pipeline
from strataloom.llm import bpe, quality, toxicity
from tests.llm import helpers
from tests.llm.test_quality import brute as brute_quality
from tests.llm.test_overlap import first_ids
from tests.llm.test_toxicity import BAD, brute_scores

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, folder, docs, labels):
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def brute_mix(rows):
    """How often each id is drawn: the Poisson distribution of its source's rate, inverted at the hash of the id."""
    n = Counter(s for _, s in rows)
    whole = sum(math.sqrt(c) for c in n.values())
    drawn = Counter()
    for i, s in rows:
        rate = math.sqrt(n[s]) / whole * len(rows) / n[s]
        u = int(hashlib.md5(f"mix-1|{i}|1".encode()).hexdigest()[:15], 16) / 2**60
        p = c = math.exp(-rate)
        k = 0
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        drawn[i] += k
    return +drawn


def test_run_against_brute_force(spark, tmp_path):
    docs = [r[:5] for r in helpers.rows(400)]
    docs = [(i, f"{t} {BAD[i % 3]} {BAD[i % 2]}" if t and i is not None and i < 400 and i % 6 == 0 else t, la, s, n) for i, t, la, s, n in docs]
    labels = [(i, 1, int(i % 6 == 0)) for i in range(400)]
    write(spark, tmp_path, docs, labels)
    rules = brute_quality(docs, quality.MAX_DOCS, quality.MAX_SHARE, quality.MIN_WORDS, quality.MIN_LEFT)
    kept = {x[0] for x in rules if x[-1]}
    stage = spark.createDataFrame(docs, SCHEMA)
    out = {}
    for name, f in corpus_pipeline.STAGES:
        stage = f(spark, stage, str(tmp_path))
        stage.write.parquet(f"{tmp_path}/{name}")
        stage = spark.read.parquet(f"{tmp_path}/{name}")
        out[name] = stage.collect()
        if name != "bpe":
            assert stage.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert Counter(r.doc_id for r in out["quality_rules"]) == Counter(d[0] for d in docs if d[0] in kept)
    tox = {r.doc_id for r in out["quality_rules"]} - {r.doc_id for r in out["toxicity"]}
    before = spark.createDataFrame(out["quality_rules"], SCHEMA)
    sample, prior = toxicity.drawn(before, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), toxicity.MAX_POSITIVE, toxicity.MAX_UNLABELLED, toxicity.MAX_CALIBRATION, "doc_id", "text")
    scores = brute_scores([tuple(r) for r in sample.collect()], prior, [r.text for r in out["quality_rules"]])
    assert tox == {r.doc_id for r, score in zip(out["quality_rules"], scores) if score >= toxicity.THRESHOLD}
    marked = {i for i, t, *_ in docs if t and any(b in t for b in BAD)}
    assert tox <= marked and len(tox) >= 0.9 * len(marked & kept)
    stay = {r.doc_id: r.text for r in out["toxicity"]}
    ids = sorted(stay)
    first = first_ids([stay[i] for i in ids])
    assert {r.doc_id for r in out["near_dedup"]} == {ids[k] for k in first}
    assert Counter(r.doc_id for r in out["near_dedup"]) == Counter(r.doc_id for r in out["toxicity"] if ids.index(r.doc_id) in first)
    drawn = brute_mix([(r.doc_id, r.source) for r in out["near_dedup"]])
    assert Counter(r.doc_id for r in out["mixing"]) == drawn and len(set(drawn.values())) > 1
    library = tiktoken.Encoding("own", pat_str=bpe.default_vocabulary()[1], mergeable_ranks=bpe.codec(*bpe.default_vocabulary()).ranks, special_tokens={})
    coded = {}
    for r in out["mixing"]:
        ids = library.encode_ordinary(r.text)
        coded[r.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in out["bpe"]) == Counter((r.doc_id, *coded[r.doc_id]) for r in out["mixing"])
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == Counter(tuple(r) for r in out["bpe"])


def test_no_documents(spark, tmp_path):
    write(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
