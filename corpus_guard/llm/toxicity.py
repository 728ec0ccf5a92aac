"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features of a text are the sets of its lower-cased 4-, 5- and 6-grams of characters. A logistic
model on the scaled indicators is fit by stochastic gradient steps with per-weight step sizes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpus_guard.llm import arrays
from corpus_guard.llm.labelled import Examples, Linear, Sampling, examples, fitted, sample, scored
from corpus_guard.llm.shared import remainder, table

BOUNDS = Sampling(per_class=4000, max_features=20_000)
THRESHOLD = 0.7
ORDERS = (4, 5, 6)


def features(column: pa.Array):
    """N-grams do not reach over the end of a text, nor over a NUL character inside one."""
    data, offsets = arrays.text_bytes(column)
    for first, last in arrays.blocks(offsets):
        texts = column.slice(first, last - first).to_pylist()
        texts = ["" if t is None else t.lower() for t in texts]
        owner = np.repeat(np.arange(first, last), [len(t) + 1 for t in texts])
        joined = "\0".join(texts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        blank = np.flatnonzero(points == 0)
        # distance to the next NUL: an n-gram fits in if it is at least n
        room = np.repeat(blank, np.diff(blank, prepend=-1)) - np.arange(len(points))
        total = points.astype(np.uint64)
        points = total.copy()
        for n in range(2, max(ORDERS) + 1):
            if len(points) < n:
                break
            total = total[:-1] * arrays.BASE + points[n - 1 :]
            if n in ORDERS:
                fits = room[: len(total)] >= n
                yield owner[: len(total)][fits], arrays.salted(total[fits], n)


def logistic_steps(
    data: Examples, rows: np.ndarray, rate: float = 0.3, decay: float = 1e-4, epochs: int = 15
) -> tuple[np.ndarray, float]:
    """Logistic loss by adaptive stochastic gradient steps; weights have the ratio multiplied in."""
    weights, seen = np.zeros(len(data.keys)), np.full(len(data.keys), 1e-8)
    bias, bias_seen = 0.0, 1e-8
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(rows):
            at = data.row(i)
            values = data.ratios[at]
            margin = np.clip(bias + weights[at] @ values, -35, 35)
            slope = 1 / (1 + np.exp(-margin)) - data.labels[i]
            step = slope * values + decay * weights[at]
            seen[at] += step**2
            weights[at] -= rate * step / np.sqrt(seen[at])
            bias_seen += slope**2
            bias -= rate * slope / np.sqrt(bias_seen)
    return weights * data.ratios, bias


def fit(docs: DataFrame, labels: DataFrame, bounds: Sampling = BOUNDS) -> Linear:
    rows = sample(docs, labels, "toxic", bounds.per_class)
    return fitted(examples(rows, features, bounds), logistic_steps)


def toxicity(docs: DataFrame, model: Linear, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted (1: score >= threshold) for every row of ``docs``.

    A null or empty text, or one of fewer than four characters, has no features and gets the
    model's score for that. Repeated rows are scored alike. Without labels of both kinds every
    score is one half. Further columns of ``docs`` are ignored.
    """
    result = scored(docs, model, features, threshold)
    return result.withColumn("held_out", remainder("doc_id", 3) == 1).select(
        "doc_id", "held_out", "score", "predicted"
    )


def op8(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
