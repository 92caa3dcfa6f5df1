"""Quality scores: a logistic model on figures of the text, fitted by sums over the labelled rows, and a monotone curve that turns its scores into shares of good texts.

Figures are columns of built-in functions. The labelled rows' figures are written once, without their texts; a step of the fit (Newton's method with a ridge) is one pass over them in which a task adds up
gradient and curvature and hands over one row, so the driver sees (figures + 1)^2 sums. The curve comes from counts on a grid of GRID scores: neighbours out of order are pooled until the shares rise.
Scoring all documents is one column, in the pass that reads the texts.

Defined cases: a null text is an empty one, and figures of an empty text are 0; labels that are null teach nothing, and neither do documents or labels without an id; several labels of a document are rows of
their own; without labelled rows every score is 0.5; labels of one kind give scores near that kind; repeated rows are scored alike; very long texts are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.sources import shared

RIDGE, STEPS, TOLERANCE, GRID = 1.0, 30, 1e-9, 1000

FIGURES = ("log_words", "word_chars", "symbol_share", "upper_share", "mark_share", "digit_share", "distinct_words", "repeated_lines", "ended_lines")


def figures(text: Column) -> dict[str, Column]:
    """The figures of FIGURES, as doubles."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    chars = lambda pattern: F.length(F.regexp_replace(text, f"[^{pattern}]", ""))
    part = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    ended = F.size(F.filter(lines, lambda x: x.rlike(r"[.!?][\x20\x09-\x0D]*$")))
    return {
        "log_words": F.log1p(F.size(words).cast("double")),
        "word_chars": part(F.length(text), F.size(words) + 1),
        "symbol_share": part(chars("#*$%&|<>"), F.length(text)),
        "upper_share": part(chars("A-Z"), F.length(text)),
        "mark_share": part(chars("!?.,;:"), F.length(text)),
        "digit_share": part(chars("0-9"), F.length(text)),
        "distinct_words": part(F.size(F.array_distinct(words)), F.size(words)),
        "repeated_lines": part(F.size(lines) - F.size(F.array_distinct(lines)), F.size(lines)),
        "ended_lines": part(ended, F.size(lines)),
    }


def with_figures(docs: DataFrame, text_col: str = "text", name: str = "x") -> DataFrame:
    made = figures(F.col(text_col))
    return docs.withColumn(name, F.array(*[made[f].cast("double") for f in FIGURES]))


@dataclass
class Model:
    """The logit is bias + weights . figures; curve has the share of good texts at each score of the grid."""

    bias: float
    weights: list[float]
    curve: list[float]

    def score(self, x: Column) -> Column:
        logit = F.lit(self.bias)
        for i, w in enumerate(self.weights):
            logit = logit + F.lit(w) * F.get(x, F.lit(i))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))

    def calibrated(self, score: Column) -> Column:
        return F.element_at(F.array(*[F.lit(c) for c in self.curve]), grid_cell(score) + 1)


def grid_cell(score: Column) -> Column:
    return F.least(F.floor(score * GRID), F.lit(GRID - 1)).cast("int")


def labelled(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """x, y of every labelled document, written to the shared folder."""
    rows = with_figures(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")), "__t").select("__id", "x")
    marks = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("y")).where("y IS NOT NULL")
    return shared.written(rows.join(marks, "__id").select("x", "y"), "labelled")


def _sums(rows: DataFrame, width: int, of_batch) -> np.ndarray:
    """of_batch(x, y) added up over all rows: a task hands over one row, and so many sums reach the driver."""

    def run(batches):
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += of_batch(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), batch.column(1).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])

    parts = rows.select("x", "y").mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    out = np.zeros(width)
    for r in parts.collect():
        out[r["i"]] = r["v"]
    return out


def fit(rows: DataFrame, ridge: float = RIDGE, steps: int = STEPS) -> tuple[float, list[float]]:
    """Bias and weights of the logistic model with the largest likelihood less ridge / 2 times the squares of the weights (of figures scaled to variance 1)."""
    d = len(FIGURES)
    first = _sums(rows, 2 * d + 1, lambda x, y: np.concatenate([x.sum(axis=0), np.square(x).sum(axis=0), [len(y)]]))
    n = first[-1]
    if not n:
        return 0.0, [0.0] * d
    mean = first[:d] / n
    spread = np.sqrt(np.maximum(first[d : 2 * d] / n - mean**2, 0.0))
    spread[spread < 1e-12] = 1.0
    penalty = np.diag([1e-6] + [ridge] * d)
    b = np.zeros(d + 1)
    for _ in range(steps):
        at = b.copy()

        def step(x, y, at=at):
            z = np.hstack([np.ones((len(y), 1)), (x - mean) / spread])
            p = 1.0 / (1.0 + np.exp(-np.clip(z @ at, -500, 500)))
            return np.concatenate([z.T @ (y - p), ((z * (p * (1 - p))[:, None]).T @ z).ravel()])

        sums = _sums(rows, (d + 1) * (d + 2), step)
        move = np.linalg.solve(sums[d + 1 :].reshape(d + 1, d + 1) + penalty, sums[: d + 1] - penalty @ b)
        b = b + np.clip(move, -5, 5)  # a longer step would overshoot where classes hardly overlap
        if np.abs(move).max() < TOLERANCE:
            break
    weights = b[1:] / spread
    return float(b[0] - weights @ mean), [float(w) for w in weights]


def pooled(counts: list[tuple[float, float]]) -> list[float]:
    """Rising shares from (n, good) of neighbours: those out of order are pooled. Cells without rows take the share before them, the first ones that after."""
    stack: list[list[float]] = []  # n, good, cells
    for n, good in counts:
        if n == 0:
            if stack:
                stack[-1][2] += 1
            else:
                stack.append([0.0, 0.0, 1])
            continue
        stack.append([n, good, 1])
        while len(stack) > 1 and (stack[-2][0] == 0 or stack[-2][1] * stack[-1][0] >= stack[-1][1] * stack[-2][0]):
            n2, good2, cells = stack.pop()
            stack[-1] = [stack[-1][0] + n2, stack[-1][1] + good2, stack[-1][2] + cells]
    return [0.5 if n == 0 else good / n for n, good, cells in stack for _ in range(int(cells))]


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    rows = labelled(docs, labels, label_col, id_col, text_col)
    bias, weights = fit(rows)
    if not math.isfinite(bias):
        raise ArithmeticError("the fit did not settle")
    model = Model(bias, weights, [])
    cells = rows.select(grid_cell(model.score(F.col("x"))).alias("cell"), "y").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("good"))
    found = {r["cell"]: (float(r["n"]), float(r["good"])) for r in cells.collect()}  # GRID rows at most
    model.curve = pooled([found.get(i, (0.0, 0.0)) for i in range(GRID)])
    return model


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with quality_score (the model's) and quality (its share of good texts)."""
    rows = with_figures(docs, text_col, "__x").withColumn("quality_score", model.score(F.col("__x"))).drop("__x")
    return rows.withColumn("quality", model.calibrated(F.col("quality_score")))


def ranking_quality(rows: DataFrame, score: str, label: str, cells: int = 10_000) -> float | None:
    """The chance that a good text scores above a bad one (half for equal ones), from counts on a grid of scores; None if one kind is missing."""
    grid = rows.where(F.col(label).isNotNull()).groupBy(F.floor(F.col(score) * cells).alias("c")).agg(F.sum(F.col(label)).alias("good"), F.count(F.lit(1)).alias("n")).orderBy("c").collect()  # cells + 1 rows
    good, bad, below, above = 0.0, 0.0, 0.0, 0.0
    for r in grid:
        g, b = float(r["good"]), float(r["n"] - r["good"])
        above += g * (bad + b / 2)
        good, bad = good + g, bad + b
    return above / (good * bad) if good and bad else None
