"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the byte 4- to 9-grams of a text's words (those whose share of P and U differs by
three standard errors or more, scaled by that distance) is trained in numpy from confirmed toxic documents (P) and labelled documents taken without their labels (U). With class prior p and logistic loss l, the risk is
p E_P[l(s)] + max(0, E_U[l(-s)] - p E_P[l(-s)]): the second part stands for the risk on clean text, and as that
can't be negative, steps that would make it so climb instead of descending. Labels of clean rows take no part in the risk. They do in two
numbers around it: the prior is the share of toxic rows among training labels, and a logistic curve, fitted on training labels that were kept out of P, turns scores
into probabilities.

Words: the text in lower case, in UTF-8; ASCII letters and bytes from 128 on belong to words, and all else parts them. A gram lies within a word with a space
at either end, and counts once for a text. Texts are hashed in numpy, many at once, in pieces of PIECE bytes: nothing is kept for each word.

Labels are learnt from rows with crc32(id as text) mod 3 other than 1 only. Fitting uses bounded samples of the labelled rows, by distinct ids, drawn by hash:
max_positive toxic ones, max_unlabelled of all kinds whose labels aren't looked at, and max_calibration for the curve; of rows that share an id the text that sorts first counts. Scoring reads every whole text.

Defined cases: null and empty texts have no features and get the score of the bias; ids that are null are never joined with
labels and are not held out; a document labelled twice is toxic if either row says so; repeated rows score alike and count once in fitting; very long texts are hashed
piece by piece, none left out; without a toxic training label every score is 0, without documents there are no rows; other columns are ignored (scores) or stay (kept documents).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import bounded_sample, checkpointed, table

MAX_POSITIVE, MAX_UNLABELLED, MAX_CALIBRATION = 1500, 4000, 1200
BITS, GRAMS, THRESHOLD, PIECE = 20, (4, 9), 0.7, 1 << 19
#: Partitions that count features, and features whose counts are added up at once. Texts that are taken from a batch at once.
COUNTERS, PART, TEXTS = 4, 1 << 16, 256

_letters = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_mix = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def padded(text: str | None) -> bytes:
    """The text's words, each with at least one space at either end."""
    return (" " + (text or "").lower() + " ").encode("utf-8", "replace").translate(_letters)


def gram_places(data: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of every gram of GRAMS[0] (four) to GRAMS[1] bytes of data that is known (by its hash). Byte 0 parts pieces: no gram holds it."""
    n = len(data)
    if n < 4:
        return np.empty(0, np.int64), np.empty(0, np.uint32)
    cut = data == 0
    part = cut | (data == 32)
    raw = data[: n - 3].astype(np.uint32)
    for k in (1, 2, 3):
        raw |= data[k : n - 3 + k].astype(np.uint32) << np.uint32(8 * k)
    whole = ~(cut[: n - 3] | part[1 : n - 2] | part[2 : n - 1])
    at, h = [], []
    for size in range(GRAMS[0], GRAMS[1] + 1):
        if size > GRAMS[0]:
            if n < size:
                break
            raw = (raw[:-1] ^ (data[size - 1 :].astype(np.uint32) * _mix[1])) * _mix[2]
            whole = whole[:-1] & ~part[size - 2 : -1]
        hashed = (raw * _mix[0]) >> np.uint32(32 - BITS)
        at.append(np.flatnonzero(known[hashed] & whole & ~cut[size - 1 :]))
        h.append(hashed[at[-1]])
    return np.concatenate(at), np.concatenate(h)


def known_grams(texts, known: np.ndarray) -> np.ndarray:
    """(number of the text << BITS | hash), sorted, for each known gram of each text once."""
    found, pieces, of, size = [], [], [], 0

    def flush():
        at, h = gram_places(np.frombuffer(b"\0".join(pieces), dtype=np.uint8), known)
        starts = np.cumsum([0, *(len(p) + 1 for p in pieces[:-1])])
        text = np.array(of, dtype=np.int64)[np.searchsorted(starts, at, side="right") - 1]
        found.append(np.unique(text << BITS | h.astype(np.int64)))

    for i, t in enumerate(texts):
        data = padded(t)
        for start in range(0, len(data), PIECE):
            pieces.append(data[start : start + PIECE + GRAMS[1] - 1])
            of.append(i)
            size += len(pieces[-1])
            if size >= PIECE:
                flush()
                pieces, of, size = [], [], 0
    if pieces:
        flush()
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def features(texts: list, known: np.ndarray | None = None) -> list[np.ndarray]:
    """For each text its hashed grams (those that are known), each once."""
    grams = known_grams(texts, np.ones(1 << BITS, dtype=bool) if known is None else known)
    cuts = np.searchsorted(grams >> BITS, np.arange(1, len(texts)))
    return [(g & ((1 << BITS) - 1)).astype(np.int32) for g in np.split(grams, cuts)]


class Rows:
    """Sparse rows; a feature weighs scale[feature], and one of scale 0 is left out: of the others, in order, weights are held."""

    def __init__(self, lists: list[np.ndarray], scale: np.ndarray):
        place = np.cumsum(scale > 0) - 1
        lists = [x[scale[x] > 0] for x in lists]
        features = np.concatenate(lists) if lists else np.empty(0, np.int32)
        self.n, self.size = len(lists), int((scale > 0).sum())
        self.at, self.value = place[features], scale[features]
        self.of = np.repeat(np.arange(self.n), [len(x) for x in lists])

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, weights=w[self.at] * self.value, minlength=self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights=g[self.of] * self.value, minlength=self.size)


def feature_scale(in_p: np.ndarray, in_u: np.ndarray, n_p: int, n_u: int, least: float = 3.0) -> np.ndarray:
    """How many standard errors a feature's share of P lies from its share of U (counts and sizes of both); 0 where that is fewer than least."""
    share = (in_p + in_u) / (n_p + n_u)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n_p + 1 / n_u))
    z = np.abs(in_p / n_p - in_u / n_u) / error
    return np.where(z >= least, z, 0.0)


def sigmoid(x):
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def fit_nnpu(p: Rows, u: Rows, prior: float, steps: int = 300, decay: float = 1e-4, momentum: float = 0.9) -> tuple[np.ndarray, float]:
    """Weights (of scaled features) and bias that bring down the non-negative risk, by accelerated gradient steps on all rows."""
    size = u.size
    w, step, bias, bias_step = np.zeros(size), np.zeros(size), np.log(prior / (1.0 - prior)), 0.0
    bend, x = 1.0, np.random.default_rng(0).normal(size=size)
    for _ in range(8):  # the largest curvature, by power iteration
        x = prior * p.back(p.times(x)) / p.n + u.back(u.times(x)) / u.n
        bend = float(np.linalg.norm(x)) or 1.0
        x /= bend
    rate = 1.0 / (0.25 * bend + decay)
    for _ in range(steps):
        ahead, bias_ahead = w + momentum * step, bias + momentum * bias_step
        sp, su = p.times(ahead) + bias_ahead, u.times(ahead) + bias_ahead
        # l(s) = log(1 + e^-s), so dl(s)/ds = sigmoid(s) - 1 and dl(-s)/ds = sigmoid(s)
        clean = np.logaddexp(0.0, su).mean() - prior * np.logaddexp(0.0, sp).mean()
        gp, gu = -prior * sigmoid(sp) / p.n, sigmoid(su) / u.n
        toxic = prior * (sigmoid(sp) - 1.0) / p.n
        if clean < 0:
            gp, gu, toxic = -gp, -gu, np.zeros(p.n)
        step = momentum * step - rate * (p.back(gp + toxic) + u.back(gu) + decay * ahead)
        bias_step = momentum * bias_step - min(rate, 2.0) * (gp.sum() + toxic.sum() + gu.sum())
        w, bias = w + step, bias + bias_step
    return w, float(bias)


def fit_curve(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of sigmoid(a s + b), by Newton steps; targets are drawn in by one row of each class."""
    n1, n0 = int(y.sum()), int((1 - y).sum())
    if not n1 or not n0:
        return 1.0, 0.0
    target = np.where(y == 1, (n1 + 1.0) / (n1 + 2.0), 1.0 / (n0 + 2.0))
    scale = max(1e-9, float(np.abs(s).max()))
    x, ab = np.stack([s / scale, np.ones_like(s)]), np.array([scale, 0.0])

    def loss(at):
        z = at @ x
        return float((np.logaddexp(0.0, z) - target * z).sum())

    for _ in range(100):
        q = sigmoid(ab @ x)
        step = np.linalg.solve((x * (q * (1 - q) + 1e-9)) @ x.T + 1e-6 * np.eye(2), x @ (q - target))
        size = 1.0
        while size > 1e-6 and loss(ab - size * step) > loss(ab):
            size /= 2
        ab = ab - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return float(ab[0] / scale), float(ab[1])


class Model:
    """Weights of grams, bias, and the curve from scores to probabilities."""

    def __init__(self, w: np.ndarray, bias: float, a: float, b: float, known: bool = True):
        self.w, self.bias, self.a, self.b, self.known = w.astype(np.float64), bias, a, b, known

    def __reduce__(self):
        # tasks get the weights that aren't zero
        at = np.flatnonzero(self.w).astype(np.int32)
        return model_of, (at, self.w[at], self.bias, self.a, self.b, self.known)

    def scores(self, texts: list) -> np.ndarray:
        if not self.known:
            return np.zeros(len(texts))
        grams = known_grams(texts, self.w != 0)
        s = np.bincount(grams >> BITS, weights=self.w[grams & ((1 << BITS) - 1)], minlength=len(texts)) + self.bias
        return sigmoid(self.a * s + self.b)

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])


def model_of(at: np.ndarray, weights: np.ndarray, bias: float, a: float, b: float, known: bool) -> Model:
    w = np.zeros(1 << BITS)
    w[at] = weights
    return Model(w, bias, a, b, known)


def remainder(id_col):
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3


def drawn(docs: DataFrame, labels: DataFrame, max_positive: int, max_unlabelled: int, max_calibration: int, id_col: str, text_col: str) -> tuple[DataFrame, float]:
    """use (p, u or c), a place, y and text of the documents to fit with, no more than the bounds of each use, and the prior (0: no toxic label)."""
    ids = docs.select(F.col(id_col).alias("__id")).where(F.col("__id").isNotNull() & (remainder(F.col("__id")) != 1)).distinct()
    known = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").alias("__y")).where(F.col("__id").isNotNull() & F.col("__y").isin(0, 1) & (remainder(F.col("__id")) != 1))
    known = known.groupBy("__id").agg(F.max("__y").alias("__y")).join(ids, "__id", "left_semi")
    aside = F.xxhash64("__id", F.lit(4)) % 4 == 0  # a quarter of the labels, for the curve
    order = F.xxhash64("__id", F.lit(9))
    n, prior = known.agg(F.count(F.lit(1)), F.avg("__y")).first()

    def pick(rows, use, total, bound):
        return bounded_sample(rows, total, bound, order).select("__id", F.lit(use).alias("__use"), F.col("__y").cast("int").alias("__y") if "__y" in rows.columns else F.lit(0).alias("__y"))

    wanted = pick(known.where((F.col("__y") == 1) & ~aside), "p", int((n or 0) * (prior or 0) * 3 // 4), max_positive)
    wanted = wanted.union(pick(known.select("__id"), "u", n or 0, max_unlabelled)).union(pick(known.where(aside), "c", (n or 0) // 4, max_calibration))
    # at most max_positive + max_unlabelled + max_calibration rows
    found = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(wanted.select("__id").distinct()), "__id")
    texts = found.groupBy("__id").agg(F.min("__text").alias("__text"))
    return texts.join(F.broadcast(wanted), "__id").select("__use", order.alias("__at"), "__y", "__text"), float(prior or 0)


def known_features(texts: DataFrame, n_p: int, n_u: int, narrow: type) -> DataFrame:
    """feature and scale of every feature of texts(use, place, y, text) whose scale isn't 0. Tasks count in parts of PART features, which are added up and scaled in Spark."""

    def count(batches):
        sums = np.zeros((2, 1 << BITS), dtype=np.int32)
        for batch in batches:
            for part in (batch.slice(at, 32) for at in range(0, batch.num_rows, 32)):
                for k, f in zip(part.column(0).to_pylist(), features(part.column(3).to_pylist())):
                    if k in ("p", "u"):
                        sums["pu".index(k), f] += 1
        for at in range(0, 1 << BITS, PART):
            part = sums[:, at : at + PART]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([part.astype(narrow).tobytes()], pa.binary())], names=["at", "sums"])

    def scaled(key, rows):
        sums = np.zeros((2, PART), dtype=np.int64)
        for x in rows["sums"]:
            sums += np.frombuffer(x.as_py(), dtype=narrow).reshape(2, -1)
        scale = feature_scale(sums[0], sums[1], n_p, n_u)
        found = np.flatnonzero(scale)
        return pa.table([pa.array(found + key[0].as_py(), pa.int32()), pa.array(scale[found])], names=["feature", "scale"])

    return texts.coalesce(COUNTERS).mapInArrow(count, "at int, sums binary").groupBy("at").applyInArrow(scaled, "feature int, scale double")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, max_calibration: int = MAX_CALIBRATION) -> Model:
    """A model from docs and labels(doc_id, toxic). It is fitted on max_positive toxic documents, max_unlabelled without their labels and max_calibration for the curve at most, all of labelled rows."""
    texts, prior = drawn(docs, labels, max_positive, max_unlabelled, max_calibration, id_col, text_col)
    if not prior:
        return Model(np.zeros(1 << BITS), 0.0, 1.0, 0.0, known=False)
    prior = min(max(prior, 1e-4), 0.9)

    texts = checkpointed(texts)
    sizes = {r["__use"]: r["count"] for r in texts.groupBy("__use").count().collect()}
    n_p, n_u = sizes.get("p", 0), sizes.get("u", 0)
    if not n_p or not n_u:
        return Model(np.zeros(1 << BITS), float(np.log(prior / (1 - prior))), 1.0, 0.0)
    found = known_features(texts, n_p, n_u, np.uint16 if max(max_positive, max_unlabelled) < 1 << 16 else np.int32).toArrow()
    scale, places = np.zeros(1 << BITS), np.sort(found.column("feature").to_numpy())
    scale[found.column("feature").to_numpy()] = found.column("scale").to_numpy()

    def run(batches):
        known = np.zeros(1 << BITS, dtype=bool)
        known[places] = True
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(features(batch.column(3).to_pylist(), known), pa.list_(pa.int32()))], names=["use", "at", "y", "f"])

    got = texts.mapInArrow(run, "use string, at long, y int, f array<int>").toArrow().sort_by([("use", "ascending"), ("at", "ascending")]).combine_chunks()
    use, y = np.array(got.column("use").to_pylist(), dtype=object), np.array(got.column("y").to_pylist(), dtype=np.int64)
    lists = [x.values.to_numpy(zero_copy_only=False) for x in got.column("f")]
    of = {kind: [lists[k] for k in np.flatnonzero(use == kind)] for kind in "puc"}
    if any(len(of[kind]) > bound for kind, bound in (("p", max_positive), ("u", max_unlabelled), ("c", max_calibration))):
        raise AssertionError("a sample is beyond its bound")
    p, u, c = (Rows(of[kind], scale) for kind in "puc")
    w, bias = fit_nnpu(p, u, prior)
    a, b = fit_curve(c.times(w) + bias, y[use == "c"])
    weights = np.zeros(1 << BITS)
    weights[places] = w * scale[places]
    return Model(weights, bias, a, b)


def scored(docs: DataFrame, model: Model, carry: list[str], text_col: str = "text") -> DataFrame:
    """The carried columns and score of every row."""
    kinds = dict(docs.dtypes)

    def run(batches):
        for batch in batches:
            n = batch.num_columns - 1
            for part in (batch.slice(at, TEXTS) for at in range(0, batch.num_rows, TEXTS)):
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(model.scores(part.column(n).to_pylist()), pa.float64())], names=[*batch.schema.names[:n], "score"])

    return docs.select(*carry, F.col(text_col).alias("__text")).mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in carry] + ["score double"]))


def kept_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents that score below the threshold; columns as they are."""
    plain = docs.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(docs.columns)])
    at = docs.columns.index(text_col)
    model = train(docs, labels, text_col=text_col)
    rows = scored(plain.withColumn("__copy", F.col(f"__{at}")), model, plain.columns, "__copy").where(F.col("score") < threshold)
    return rows.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns)])


def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = scored(docs, train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return rows.select("doc_id", (remainder(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
