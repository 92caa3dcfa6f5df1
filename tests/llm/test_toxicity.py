import pickle
import random
import zlib

import numpy as np

from strataloom.llm import toxicity
from tests.llm import helpers

BAD = ["grokky", "vilenard", "snarfish"]


def corpus(spark, n=900, seed=2):
    rnd = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        toxic = rnd.random() < 0.15
        words = [rnd.choice(helpers.WORDS) + rnd.choice(["", "s", "ly"]) for _ in range(rnd.randrange(20, 120))]
        if toxic:
            words.insert(rnd.randrange(len(words)), rnd.choice(BAD))
            words.append(rnd.choice(BAD))
        docs.append((i, " ".join(words)))
        if rnd.random() < 0.6:
            labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out_accuracy(spark):
    docs, labels, truth = corpus(spark)
    rows = toxicity.scored(docs, toxicity.train(docs, labels), ["doc_id"]).collect()
    held = [(r.score, truth[r.doc_id]) for r in rows if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 100
    assert sum(s >= 0.7 for s, y in held if y) >= 0.9 * sum(y for _, y in held) and sum(s >= 0.7 for s, y in held if not y) <= 1
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_labels_are_never_read(spark):
    docs, labels, truth = corpus(spark, 300)
    other = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in truth.items()], "doc_id long, toxic int")
    a, b = toxicity.train(docs, labels), toxicity.train(docs, other)
    assert np.array_equal(a.w, b.w) and (a.bias, a.a, a.b) == (b.bias, b.a, b.b)


def test_odd_rows_score_and_columns_stay(spark):
    docs, labels, _ = corpus(spark, 300)
    model = toxicity.train(docs, labels)
    rows = toxicity.scored(helpers.table(spark), model, ["doc_id"]).collect()
    assert len(rows) == len(helpers.rows()) and all(0 <= r.score < 0.7 for r in rows)
    kept = toxicity.kept_documents(helpers.table(spark), labels)
    assert kept.columns == helpers.table(spark).columns and kept.count() <= len(helpers.rows())


def test_without_labels_or_documents(spark):
    docs, labels, _ = corpus(spark, 50)
    none = labels.limit(0)
    assert {r.score for r in toxicity.scored(docs, toxicity.train(docs, none), ["doc_id"]).collect()} == {0.0}
    empty = helpers.empty(spark)
    assert toxicity.kept_documents(empty, labels).count() == 0
    nulls = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int")
    assert not toxicity.train(docs, nulls).known


def test_non_negative_risk_learns_from_positives_and_unlabelled():
    rng = np.random.default_rng(0)
    mark = np.int32(77)
    p = [np.unique(np.append(rng.integers(100, 400, 30), mark)).astype(np.int32) for _ in range(60)]
    u = [np.unique(np.append(rng.integers(100, 400, 30), mark) if i % 10 == 0 else rng.integers(100, 400, 30)).astype(np.int32) for i in range(400)]
    counts = [np.bincount(np.concatenate([np.unique(x) for x in lists]), minlength=1 << toxicity.BITS) for lists in (p, u)]
    scale = toxicity.feature_scale(*counts, len(p), len(u))
    assert scale[mark] > 3
    w, bias = toxicity.fit_nnpu(toxicity.Rows(p, scale), toxicity.Rows(u, scale), 0.1)
    s = toxicity.Rows(u, scale).times(w) + bias
    assert s[::10].min() > np.delete(s, np.arange(0, 400, 10)).max()


def brute_grams(text):
    """Hashes of a text's grams, one gram at a time."""
    data = bytes(c if c >= 128 or 97 <= c <= 122 or 65 <= c <= 90 else 32 for c in (" " + (text or "").lower() + " ").encode())
    m0, m1, m2, mask = 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0xFFFFFFFF
    found = set()
    for n in range(toxicity.GRAMS[0], toxicity.GRAMS[1] + 1):
        for i in range(len(data) - n + 1):
            gram = data[i : i + n]
            if 32 not in gram[1:-1]:
                raw = int.from_bytes(gram[:4], "little")
                for b in gram[4:]:
                    raw = ((raw ^ (b * m1 & mask)) * m2) & mask
                found.add((raw * m0 & mask) >> (32 - toxicity.BITS))
    return found


def test_grams_against_brute_force():
    texts = [None, "", "a", "ab cd", "Ältere größer, niño!", "x\x00yz\x00abcd", "word " * 400, "réeux" * 300, " \n\t", "one\u2028two"] + [r[1] for r in helpers.rows(20)[:20]]
    was = toxicity.PIECE
    try:
        for toxicity.PIECE in (was, 64):  # pieces that end within words
            assert [set(f.tolist()) for f in toxicity.features(texts)] == [brute_grams(t) for t in texts]
    finally:
        toxicity.PIECE = was


def brute_scores(sample, prior, texts):
    """The same risk, written out over dense rows, for every text."""
    sample = sorted(sample, key=lambda r: (r[0], r[1]))
    grams = [brute_grams(t) for _, _, _, t in sample]
    of = {k: [g for (use, *_), g in zip(sample, grams) if use == k] for k in "puc"}
    n_p, n_u = len(of["p"]), len(of["u"])
    z = {}
    for f in set().union(*of["p"], *of["u"]):
        a, b = sum(f in g for g in of["p"]), sum(f in g for g in of["u"])
        share = (a + b) / (n_p + n_u)
        z[f] = abs(a / n_p - b / n_u) / np.sqrt(max(share * (1 - share), 1e-9) * (1 / n_p + 1 / n_u))
    active = sorted(f for f in z if z[f] >= 3)
    dense = lambda lists: np.array([[z[f] if f in g else 0.0 for f in active] for g in lists]).reshape(len(lists), len(active))
    P, U, C = dense(of["p"]), dense(of["u"]), dense(of["c"])
    sig = lambda x: 1 / (1 + np.exp(-x))
    x = np.random.default_rng(0).normal(size=len(active))
    for _ in range(8):
        x = prior * P.T @ (P @ x) / n_p + U.T @ (U @ x) / n_u
        bend = np.linalg.norm(x)
        x = x / bend
    rate = 1 / (0.25 * bend + 1e-4)
    w, step, bias, bias_step = np.zeros(len(active)), np.zeros(len(active)), np.log(prior / (1 - prior)), 0.0
    for _ in range(300):
        ahead, bias_ahead = w + 0.9 * step, bias + 0.9 * bias_step
        sp, su = P @ ahead + bias_ahead, U @ ahead + bias_ahead
        clean = np.log1p(np.exp(su)).mean() - prior * np.log1p(np.exp(sp)).mean()
        d_toxic, d_clean_p, d_clean_u = prior * (sig(sp) - 1) / n_p, -prior * sig(sp) / n_p, sig(su) / n_u
        if clean < 0:
            d_toxic, d_clean_p, d_clean_u = 0 * d_toxic, -d_clean_p, -d_clean_u
        step = 0.9 * step - rate * (P.T @ (d_toxic + d_clean_p) + U.T @ d_clean_u + 1e-4 * ahead)
        bias_step = 0.9 * bias_step - min(rate, 2.0) * (d_toxic.sum() + d_clean_p.sum() + d_clean_u.sum())
        w, bias = w + step, bias + bias_step
    a, b = toxicity.fit_curve(C @ w + bias, np.array([y for use, _, y, _ in sample if use == "c"]))
    return sig(a * (dense([brute_grams(t) for t in texts]) @ w + bias) + b)


def test_scores_against_brute_force(spark):
    docs, labels, _ = corpus(spark, 260)
    texts, prior = toxicity.drawn(docs, labels, 1500, 4000, 1200, "doc_id", "text")
    want = brute_scores([tuple(r) for r in texts.collect()], prior, [r.text for r in docs.orderBy("doc_id").collect()])
    got = [r.score for r in toxicity.scored(docs, toxicity.train(docs, labels), ["doc_id"]).orderBy("doc_id").collect()]
    assert np.abs(np.array(got) - want).max() < 1e-9


def test_bounds_hold_on_repeated_ids(spark):
    docs, labels, _ = corpus(spark, 300)
    docs = docs.union(spark.range(5000).selectExpr("2 AS doc_id", "concat('again ', id) AS text"))
    texts, _ = toxicity.drawn(docs, labels.union(labels), 30, 50, 20, "doc_id", "text")
    rows = texts.collect()
    for use, bound in (("p", 30), ("u", 50), ("c", 20)):
        of = [r["__at"] for r in rows if r["__use"] == use]
        assert 0 < len(of) <= bound and len(of) == len(set(of))
    whole, _ = toxicity.drawn(docs, labels, 1500, 4000, 1200, "doc_id", "text")
    assert whole.where("__use = 'u'").count() <= 300
    model = toxicity.train(docs, labels, max_positive=30, max_unlabelled=50, max_calibration=20)
    assert len({r.score for r in toxicity.scored(docs, model, ["text"]).where("text LIKE 'again %'").collect()}) >= 1


def test_little_passes_through_the_driver(spark):
    """Features are counted and scaled in Spark: only those that tell toxic texts from others come to the driver, and a model is sent with the weights that aren't zero."""
    rnd = random.Random(4)
    texts = [("pu"[i % 2], i, 0, " ".join(f"w{rnd.randrange(10**4)}" for _ in range(60)) + (" " + BAD[i % 3] if i % 2 == 0 else "")) for i in range(600)]
    df = spark.createDataFrame(texts, "use string, at long, y int, t string")
    sums = np.zeros((2, 1 << toxicity.BITS), dtype=np.int64)
    for k, f in zip([t[0] for t in texts], toxicity.features([t[3] for t in texts])):
        sums["pu".index(k), f] += 1
    want = toxicity.feature_scale(sums[0], sums[1], 300, 300)
    got = toxicity.known_features(df, 300, 300, np.uint16).collect()
    assert {r.feature: r.scale for r in got} == {i: want[i] for i in np.flatnonzero(want).tolist()} and 0 < len(got) < 1000
    model = toxicity.Model(want, 0.5, 1.5, -0.5)
    sent = pickle.dumps(model)
    assert len(sent) < 50_000 and (pickle.loads(sent).scores([t[3] for t in texts]) == model.scores([t[3] for t in texts])).all()
