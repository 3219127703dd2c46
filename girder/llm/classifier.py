"""A quality classifier by positive-unlabelled learning.

A linear score over measures of the text is fitted so that the non-negative unbiased risk is least: trusted
positives count with the class prior, unlabelled web text stands for all classes, and the
part of the risk that the estimate gives to negatives is kept from going below zero. All rows of the table are the unlabelled text and all permitted positives
the trusted ones: measures are stored, and every Newton step is one pass over them that sums slopes and curvatures, so nothing is
drawn or cut and the model does not depend on how the table lies. The prior is estimated from all permitted labels. The fitted score is then scaled to a
probability on at most ``labelled`` labelled rows, drawn by hash of id and measures: the only bounded sample.

Every row of the table is scored, by column expressions. Nulls: a null or empty text has the measures of an empty one and a score; a
null id is unlabelled text, never labelled and not held out. Rows repeated in either table count as often as they stand; a label counts for every row of its id. Very long texts are
measured whole. Without positive labels every score is the prior ``default_prior``. An empty table gives an empty result. Columns not named are left alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.llm.text import WORD, let, words
from girder.shared import staged


@dataclass(frozen=True)
class Learning:
    """labelled: rows for the scaling, at most. steps: passes over the table, at most. decay: weight of the squared weights, columns being standardised."""

    labelled: int = 20_000
    steps: int = 40
    decay: float = 1e-2
    threshold: float = 0.3
    default_prior: float = 0.5
    seed: int = 5


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


#: Names of the measures, in the order of the weights.
MEASURES = ["short", "log_words", "symbols", "marks", "capitals", "digits", "letters", "word_length", "same_word", "distinct", "distinct_pairs", "dup_lines", "words_a_line"]


def measures(text: Column) -> Column:
    """An array of doubles: shares and logarithms that describe a whole text; its words are found once."""
    t = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(t), F.lit(1))
    without = lambda pattern: F.length(t) - F.length(F.regexp_replace(t, pattern, ""))

    def of_words(w: Column) -> Column:
        n = F.greatest(F.size(w), F.lit(1))
        pairs = F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i)))).otherwise(F.array().cast("array<bigint>"))
        same = F.size(F.filter(w, lambda x, i: (i > 0) & (x == F.get(w, i - 1))))
        lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
        length = F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", ""))
        return F.array(
            (F.size(w) < 50).cast("double"),
            F.log1p(F.size(w).cast("double")) / 8,
            F.least(F.lit(3.0), (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))) / n),
            F.least(F.lit(3.0), (F.length(t) - F.length(F.translate(t, "!?", ""))) / n),
            without("[A-Z]+") / chars,
            without("[0-9]+") / chars,
            without(r"[\p{L}\p{M}]+") / chars,
            F.least(F.lit(30.0), length / n) / 10,
            same / n,
            F.size(F.array_distinct(w)) / n,
            F.when(F.size(w) > 1, F.size(F.array_distinct(pairs)) / (F.size(w) - 1)).otherwise(1.0),
            let(lines, lambda x: F.when(F.size(x) > 0, 1 - F.size(F.array_distinct(x)) / F.size(x)).otherwise(0.0)),
            F.least(F.lit(200.0), n / F.greatest(F.size(lines), F.lit(1))) / 100,
        )

    return let(words(t), of_words)


def spread(x: np.ndarray) -> np.ndarray:
    """Measures and their squares: one side of a measure may be bad at both ends."""
    return np.hstack([x, x * x])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass(frozen=True)
class Model:
    """score = sigmoid(bias + weights . (measures, their squares))."""

    bias: float
    weights: list[float]


def measured(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, m, up, down of every row: its measures and how many permitted labels of either kind its id has. Stored."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.count_if(F.col("quality") == 1).alias("up"), F.count_if(F.col("quality") == 0).alias("down"))
    rows = docs.select("doc_id", measures(F.col("text")).alias("m")).join(known, "doc_id", "left")
    return staged(rows.na.fill(0, ["up", "down"]), "measures")


def spread_rows(batch: pa.RecordBatch) -> np.ndarray:
    return spread(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(MEASURES)))


def totals(rows: DataFrame, part: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows (m, up, down) of what ``part`` makes of a batch; a task sends one array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            if batch.num_rows:
                total = total + part(spread_rows(batch), *[c.to_numpy().astype(float) for c in batch.columns[1:]])
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["i", "v"])

    sums = rows.select("m", "up", "down").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    return np.array([r["v"] for r in sums.orderBy("i").collect()])  # as many as there are columns, squared


@dataclass(frozen=True)
class Moments:
    """Rows, positive and negative labels, and the means of the columns over all rows, their deviations, and the means over positives."""

    rows: float
    up: float
    down: float
    mean: np.ndarray
    scale: np.ndarray
    positive: np.ndarray


def moments(rows: DataFrame) -> Moments | None:
    k = 2 * len(MEASURES)
    t = totals(rows, lambda x, up, down: np.concatenate([[len(x), up.sum(), down.sum()], x.sum(0), (x * x).sum(0), up @ x]))
    if not len(t) or not t[1]:
        return None
    mean = t[3 : 3 + k] / t[0]
    scale = np.sqrt(np.maximum(t[3 + k : 3 + 2 * k] / t[0] - mean * mean, 0)) + 1e-6
    return Moments(t[0], t[1], t[2], mean, scale, t[3 + 2 * k :] / t[1])


def risk_at(a: np.ndarray, known: Moments, rows: DataFrame, prior: float, how: Learning) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Risk, its part for negatives, slope and curvature at weights and bias ``a``, by one pass over all rows.

    With the logistic loss prior * (loss(+) - loss(-)) is linear in the score, so positives enter the slope by their mean alone.
    """
    k = len(a)
    mean, scale = known.mean, known.scale

    def part(x: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
        x = np.column_stack([(x - mean) / scale, np.ones(len(x))])
        z = x @ a
        s, loss = sigmoid(z), np.logaddexp(0, z)
        return np.concatenate([[loss.sum(), up @ loss], s @ x, (x.T @ (x * (s * (1 - s))[:, None])).ravel()])

    t = totals(rows, part)
    positive = np.append((known.positive - mean) / scale, 1.0)
    decay = np.append(np.full(k - 1, how.decay), 1e-9)
    risk = t[0] / known.rows - prior * positive @ a + 0.5 * decay @ (a * a)
    return risk, t[0] / known.rows - prior * t[1] / known.up, t[2 : 2 + k] / known.rows - prior * positive + decay * a, t[2 + k :].reshape(k, k) / known.rows + np.diag(decay)


def fit_pu(known: Moments, rows: DataFrame, prior: float, how: Learning) -> tuple[np.ndarray, float]:
    """Weights over standardised columns, and a bias, by Newton steps on the unbiased risk.

    Risk: prior * E_p[loss(+)] + E_u[loss(-)] - prior * E_p[loss(-)], the last two not below zero together: a step that
    would make them so, or not lessen the risk, is halved, and one halved for the former is the last.
    """
    a = np.zeros(len(known.mean) + 1)
    risk, _, slope, curve = risk_at(a, known, rows, prior, how)
    step, length, last = np.linalg.solve(curve, slope), 1.0, False
    for _ in range(how.steps):
        if slope @ step < 1e-9 or length < 1e-3:
            break
        there = a - length * step
        new = risk_at(there, known, rows, prior, how)
        if new[1] >= 0 and new[0] <= risk - 1e-4 * length * (slope @ step):
            a, (risk, _, slope, curve) = there, new
            if last:
                break
            step, length = np.linalg.solve(curve, slope), 1.0
        else:
            length, last = length / 2, last or new[1] < 0
    return a[:-1], float(a[-1])


def scaled(z: np.ndarray, up: np.ndarray, down: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make sigmoid(slope * z + shift) a probability of a positive label, by Newton steps with smoothed labels."""
    n = up + down
    target = (up * (up.sum() + 1) / (up.sum() + 2) + down / (down.sum() + 2)) / n
    x = np.column_stack([z, np.ones_like(z)])
    a = np.array([1.0, 0.0])
    for _ in range(50):
        s = sigmoid(x @ a)
        h = x.T @ (x * (n * s * (1 - s))[:, None]) + 1e-3 * np.eye(2)
        a = a - np.clip(np.linalg.solve(h, x.T @ (n * (s - target)) + 1e-3 * (a - [1.0, 0.0])), -2, 2)
    return max(float(a[0]), 1e-3), float(a[1])


def train(docs: DataFrame, labels: DataFrame, how: Learning = Learning()) -> Model:
    """Fit on documents (doc_id, text) and labels (doc_id, quality), without held-out labels."""
    return fit(measured(docs, labels), how)


def fit(rows: DataFrame, how: Learning = Learning()) -> Model:
    """The model of stored rows (doc_id, m, up, down)."""
    known = moments(rows)
    if known is None:
        return Model(float(np.log(how.default_prior / (1 - how.default_prior))), [0.0] * (2 * len(MEASURES)))
    prior = float(np.clip(known.up / (known.up + known.down), 0.02, 0.98))
    w, b = fit_pu(known, rows, prior, how)
    turn = F.xxhash64("doc_id", "m", F.lit(how.seed))
    named = rows.where("up + down > 0").orderBy(turn, "up", "down").limit(how.labelled).select("m", "up", "down").toArrow().combine_chunks().to_batches()[0]
    up, down = (c.to_numpy().astype(float) for c in named.columns[1:])
    slope, shift = scaled((spread_rows(named) - known.mean) / known.scale @ w + b, up, down)
    w = slope * w / known.scale
    return Model(float(slope * b + shift - w @ known.mean), [float(v) for v in w])


def scores(docs: DataFrame, model: Model, threshold: float = Learning.threshold) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return scored(docs.select("doc_id", measures(F.col("text")).alias("m")), model, threshold)


def scored(rows: DataFrame, model: Model, threshold: float = Learning.threshold) -> DataFrame:
    """The same of rows (doc_id, m) whose measures are there."""
    k = len(MEASURES)

    def total(m: Column) -> Column:
        z = F.lit(model.bias)
        for i in range(k):
            x = F.get(m, F.lit(i))
            z = z + x * F.lit(model.weights[i]) + x * x * F.lit(model.weights[k + i])
        return z

    z = F.greatest(F.lit(-35.0), F.least(F.lit(35.0), total(F.col("m"))))
    t = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), (1 / (1 + F.exp(-z))).alias("score"))
    return t.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
