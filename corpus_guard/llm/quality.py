"""Quality classifier: a support vector machine on naive Bayes scaled n-gram indicators.

Features of a text are the sets of its word 1- and 2-grams and of its word-shape 1- to 4-grams. A
shape is the kinds of characters in a word, whether it starts with a capital and whether it repeats
the word before it. Indicators are scaled by the class log-count ratio; the hinge-loss model is fit
by dual coordinate descent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpus_guard.llm import arrays
from corpus_guard.llm.labelled import Examples, Linear, Sampling, examples, fitted, sample, scored
from corpus_guard.llm.shared import remainder, table

BOUNDS = Sampling(per_class=3000)
THRESHOLD = 0.5


def _kinds() -> np.ndarray:
    kinds = np.full(256, 1 << 9, np.uint64)
    for i, chars in enumerate(
        (
            "abcdefghijklmnopqrstuvwxyz",
            "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
            "0123456789",
            ".,;:",
            "!",
            "?",
            "|",
            "#$%&*+=<>@^_~`\\/",
            "'\"()[]{}-",
        )
    ):
        kinds[list(chars.encode())] = 1 << i
    kinds[128:] = 1
    return kinds


KINDS = _kinds()
UPPER, FIRST, SAME = np.uint64(1 << 1), np.uint64(1 << 10), np.uint64(1 << 11)


def features(column: pa.Array):
    data, offsets = arrays.text_bytes(column)
    for first, last in arrays.blocks(offsets):
        part = data[offsets[first] : offsets[last]]
        starts, ends, owner = arrays.word_spans(part, offsets[first : last + 1] - offsets[first])
        if not len(starts):
            continue
        owner = owner + first
        words = arrays.word_hashes(arrays.LOWER[part], starts, ends)
        # bytes between the words are blank: their kind is cleared
        kinds = np.where(arrays.SPACE[part], np.uint64(0), KINDS[part])
        shapes = np.bitwise_or.reduceat(kinds, starts)
        shapes |= np.where(KINDS[part[starts]] == UPPER, FIRST, np.uint64(0))
        same = np.zeros(len(words), bool)
        same[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
        shapes |= np.where(same, SAME, np.uint64(0))
        shapes = arrays.salted(shapes, 99)
        for hashes, orders in ((words, (1, 2)), (shapes, (1, 2, 3, 4))):
            for n in orders:
                keys, text = arrays.grams(hashes, owner, n)
                yield text, keys


def hinge_descent(
    data: Examples, rows: np.ndarray, cost: float = 1.0, epochs: int = 12
) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for min |w|^2 / 2 + cost * sum of hinge losses; bias as a feature.

    Returns the weights per indicator, with the ratio multiplied in, and the bias.
    """
    y = np.where(data.labels == 1, 1.0, -1.0)
    weights = np.zeros(len(data.keys))
    bias = 0.0
    alpha = np.zeros(len(y))
    square = data.ratios**2
    norms = {i: 1.0 + square[data.row(i)].sum() for i in rows}
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(rows):
            at = data.row(i)
            values = data.ratios[at]
            gradient = y[i] * (bias + weights[at] @ values) - 1.0
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost)
            change = (new - alpha[i]) * y[i]
            if change:
                alpha[i] = new
                weights[at] += change * values
                bias += change
    return weights * data.ratios, bias


def fit(docs: DataFrame, labels: DataFrame, bounds: Sampling = BOUNDS) -> Linear:
    rows = sample(docs, labels, "quality", bounds.per_class)
    return fitted(examples(rows, features, bounds), hinge_descent)


def quality(docs: DataFrame, model: Linear, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted (1: score >= threshold) for every row of ``docs``.

    A null or empty text has no features and gets the model's score for that; so do texts of blanks.
    Repeated rows are scored alike. Without labels of both kinds every score is one half. Further
    columns of ``docs`` are ignored.
    """
    result = scored(docs, model, features, threshold)
    return result.withColumn("held_out", remainder("doc_id", 3) == 1).select(
        "doc_id", "held_out", "score", "predicted"
    )


def op10(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality(docs, fit(docs, table(spark, sf_dir, "labels")))


def keep(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with the columns they had.

    The model is learnt from the labels of these documents, and each row is scored by its own text.
    """
    model = fit(docs, table(spark, sf_dir, "labels"))
    return accepted(docs, model)


def accepted(docs: DataFrame, model: Linear, threshold: float = THRESHOLD) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            score = shared.value.scores(batch.column("text"), features)
            yield batch.filter(pa.array(score >= threshold))

    return docs.mapInArrow(run, docs.schema)
