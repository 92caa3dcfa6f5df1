"""Language identification, quality scores, passages of the evaluation set: against plain versions."""

import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.functions.hashing import md5_bucket
from strataloom.operators import contamination, language, quality_score
from strataloom.sources import shared

DATA = Path("/root/testdata/sf0.01")
SCHEMA = "doc_id long, text string, lang string, w string, h int, predicted string, `__a` string, item int, x int"
EN = "the river and the stone were quiet while clouds moved over the forest".split()
DE = "der fluss und die steine waren still während wolken über den wald zogen".split()


def docs(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(EN if i % 3 else DE) for _ in range(rnd.randrange(3, 40))), "en" if i % 3 else "de") for i in range(60)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "123 + 456", "de"), (None, "wolken über wolken", None), (None, "wolken über wolken", None), (103, "Ü" * 5000, None), (104, "the " * 30_000, "en")]
    rows += [rows[3]] * 3
    return spark.createDataFrame([(*r, "w", 1, "p", "a", 2, 3) for r in rows], SCHEMA), rows


def cut(text):
    return [f" {w} "[i : i + 3] for w in re.findall(r"[^\W\d_]+", (text or "").lower()) for i in range(len(w))]


def plain_language(rows, top):
    counts = {}
    for _, t, la in rows:
        if la is not None:
            counts.setdefault(la, Counter()).update(cut(t))
    chosen = {g for c in counts.values() for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:top]}
    names = sorted(counts)
    total = {la: sum(counts[la][g] for g in chosen) for la in names}
    weight = {la: {g: round(1000 * math.log((counts[la][g] + 1) / (total[la] + len(chosen)))) for g in chosen} for la in names}
    out = []
    for i, t, la in rows:
        known = [g for g in cut(t) if g in chosen]
        sums = [sum(weight[x][g] for g in known) for x in names]
        best = max(sums) if known else 0
        score = 1 / sum(math.exp((s - best) * min(len(known), 20) / len(known) / 1000) for s in sums) if known else 0.0
        out.append((i, names[sums.index(best)] if known else None, round(score, 6), len(known)))
    return Counter(out)


@pytest.mark.parametrize(("top", "rows_broadcast"), [(1000, 100_000), (7, 100_000), (40, 0)])
def test_language_against_a_plain_version(spark, monkeypatch, top, rows_broadcast):
    monkeypatch.setattr(shared, "BROADCAST_ROWS", rows_broadcast)
    df, rows = docs(spark)
    model = language.train(df, top)
    got = language.identified(df, model)
    assert Counter((r.doc_id, r.predicted, round(r.language_score, 6), r.n_grams) for r in got.collect()) == plain_language(rows, top)


def test_language_without_training_rows_and_without_rows(spark):
    df, rows = docs(spark)
    model = language.train(df.where("doc_id < 0"))
    assert {(r.predicted, r.language_score) for r in language.identified(df, model).collect()} == {(None, 0.0)}
    assert language.identified(df.where("FALSE"), language.train(df)).count() == 0
    assert language.identified(df, language.train(df), ("predicted", "w", "doc_id")).columns == ["predicted", "w", "doc_id", "predicted", "language_score", "n_grams"]


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_languages_held_out_are_found(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("held_out", md5_bucket(F.col("text")) < 200)
    found = language.accuracy(language.identified(df, language.train(df.where("NOT held_out")), ("lang", "held_out")).where("held_out")).collect()
    assert sum(r.n_right for r in found) >= 0.97 * sum(r.n for r in found) and len(found) == 4


def plain_fit(x, y, ridge=1.0):
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread < 1e-12] = 1
    z = np.hstack([np.ones((len(y), 1)), (x - mean) / spread])
    b = np.zeros(z.shape[1])
    for _ in range(20_000):  # plain ascent
        p = 1 / (1 + np.exp(-z @ b))
        b = b + 0.01 * (z.T @ (y - p) - np.r_[1e-6, [ridge] * (len(b) - 1)] * b)
    return b[0] - (b[1:] / spread) @ mean, b[1:] / spread


def judged_docs(spark):
    rnd = random.Random(9)
    rows, labels = [], []
    for i in range(160):
        good = i % 4 != 0
        words = [rnd.choice(EN) + ("" if good or rnd.random() < 0.5 else "***") for _ in range(rnd.randrange(5, 60))]
        rows.append((i, ("\n".join if rnd.random() < 0.2 else " ".join)(words) + ("." if rnd.random() < 0.7 else ""), "en"))
        labels.append((i, int(good if rnd.random() < 0.9 else not good), 0))
    rows += [(500, None, None), (501, "", None), (None, "no id", None), (502, "a\n" * 40_000, None)]
    labels += [(501, 0, 1), (3, None, 1), (None, 1, 1), (7, 0, 1), (900, 1, 1)]
    return spark.createDataFrame([(*r, "w", 1, "p", "a", 2, 3) for r in rows], SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_fit_is_the_largest_likelihood(spark):
    df, labels = judged_docs(spark)
    rows = quality_score.labelled(df, labels)
    assert rows.count() == 162  # one of two labels, one of an empty text
    bias, weights = quality_score.fit(rows)
    held = rows.collect()
    want_bias, want = plain_fit(np.array([r.x for r in held]), np.array([r.y for r in held]))
    assert abs(bias - want_bias) < 1e-3 and np.allclose(weights, want, atol=1e-3)


def test_scores_rank_and_rise(spark):
    df, labels = judged_docs(spark)
    model = quality_score.train(df, labels)
    assert model.curve == sorted(model.curve) and len(model.curve) == quality_score.GRID and 0 <= model.curve[0] < model.curve[-1] <= 1
    scored = quality_score.scored(df, model)
    assert scored.columns == [*df.columns, "quality_score", "quality"] and scored.count() == df.count()
    assert all(0 <= r.quality_score <= 1 and 0 <= r.quality <= 1 for r in scored.collect())
    marked = scored.join(labels.where("doc_id < 160").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("id"), F.col("quality").alias("good")), F.col("doc_id") == F.col("id"))
    got = quality_score.ranking_quality(marked, "quality_score", "good")
    held = [(math.floor(r.quality_score * 10_000), r.good) for r in marked.collect() if r.good is not None]
    pairs = [(a > b) + (a == b) / 2 for a, g in held if g for b, k in held if not k]
    assert abs(got - sum(pairs) / len(pairs)) < 1e-9 and got > 0.8


def test_labels_of_one_kind_and_none(spark):
    df, labels = judged_docs(spark)
    assert {round(r.quality_score, 3) for r in quality_score.scored(df, quality_score.train(df, labels.where("FALSE"))).collect()} == {0.5}
    ones = quality_score.scored(df, quality_score.train(df, labels.where("quality = 1")))
    assert min(r.quality_score for r in ones.where("doc_id < 160").collect()) > 0.95
    assert quality_score.scored(df.where("FALSE"), quality_score.train(df, labels)).count() == 0


def test_pooling_against_all_curves():
    assert quality_score.pooled([(1, 1), (1, 0), (2, 1)]) == [0.5] * 3
    assert quality_score.pooled([(0, 0), (4, 1), (0, 0), (2, 2), (1, 0), (0, 0)]) == [0.25, 0.25, 0.25, 2 / 3, 2 / 3, 2 / 3]
    assert quality_score.pooled([(0, 0)] * 3) == [0.5] * 3
    rnd = random.Random(2)
    for _ in range(200):
        counts = [(n := rnd.randrange(1, 5), rnd.randrange(n + 1)) for _ in range(7)]
        got = quality_score.pooled(counts)
        # the least squares rising curve: largest of smallest means over windows
        want = [max(min(sum(g for _, g in counts[a : b + 1]) / sum(n for n, _ in counts[a : b + 1]) for b in range(i, 7)) for a in range(i + 1)) for i in range(7)]
        assert np.allclose(got, want)


def tokens(text):
    return [w for w in re.findall(r"[^\W_]+", (text or "").lower())]


def plain_spans(rows, items, n):
    runs = {}
    for i, t in items:
        w = tokens(t)
        for k in range(len(w) - n + 1):
            runs.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = Counter()
    for i, t in {(i, t or "") for i, t, _ in rows}:
        w = tokens(t)
        at = [k for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in runs]
        covered = {p for k in at for p in range(k, k + n)}
        start = None
        for p in range(len(w) + 1):
            if p in covered and start is None:
                start = p
            if start is not None and p not in covered:
                mine = [k for k in at if start <= k < p]
                out[i, start, p - start, len(mine), min(min(runs[tuple(w[k : k + n])]) for k in mine)] += 1
                start = None
    return out


@pytest.mark.parametrize(("n", "rows_broadcast"), [(3, 100_000), (8, 100_000), (3, 0)])
def test_passages_against_a_plain_version(spark, monkeypatch, n, rows_broadcast):
    monkeypatch.setattr(shared, "BROADCAST_ROWS", rows_broadcast)
    rnd = random.Random(6)
    items = [(i, " ".join(rnd.choice(EN + DE) for _ in range(rnd.randrange(2, 30)))) for i in range(25)] + [(90, None), (91, ""), (92, "too short")]
    items += [(95, items[4][1]), (2, items[4][1])]
    _, rows = docs(spark)
    for i in range(40):
        inside = items[rnd.randrange(25)][1]
        rows.append((200 + i, f"Start {rnd.randrange(99)}, {inside.upper() if i % 2 else inside.replace(' ', ' -- ')}! und {items[rnd.randrange(25)][1]}", "en"))
    rows += [(300, items[4][1] + " " + items[4][1], "en"), (None, items[5][1], None), rows[-1], rows[-1]]
    df = spark.createDataFrame([(*r, "w", 1, "p", "a", 2, 3) for r in rows], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = contamination.spans(df, contamination.evaluation_runs(bench, n), n)
    want = plain_spans(rows, items, n)
    assert Counter(tuple(r) for r in found.collect()) == want and want
    kept = contamination.without_passages(df, bench, n, least_words=n + 4)
    bad = {k[0] for k in want if k[2] >= n + 4}
    texts = {t or "" for i, t, _ in rows if i in bad}
    assert kept.columns == df.columns and Counter(r.doc_id for r in kept.collect()) == Counter(i for i, t, _ in rows if (t or "") not in texts)


def test_no_documents_and_no_items(spark):
    df, _ = docs(spark)
    bench = spark.createDataFrame([(1, "the river and the stone were quiet while clouds")], "item_id long, text string")
    assert contamination.spans(df.where("FALSE"), contamination.evaluation_runs(bench)).count() == 0
    assert contamination.spans(df, contamination.evaluation_runs(bench.where("FALSE"))).count() == 0
    assert contamination.without_passages(df, bench.where("FALSE")).count() == df.count()
