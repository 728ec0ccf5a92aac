"""What the two label classifiers share: a bounded sample, naive Bayes ratios, scoring.

A text is a set of features, 64-bit hashes of n-grams. Counts per class and the choice of features
are Spark jobs over the sample; the fit itself sees only the chosen features of the sample.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_guard.llm.arrays import KeyTable, distinct_pairs
from corpus_guard.llm.shared import cutoff, lottery, remainder, written

#: From texts to (text number, feature) pairs, block by block; pairs may repeat.
Features = Callable[[pa.Array], Iterator[tuple[np.ndarray, np.ndarray]]]


@dataclass(frozen=True)
class Sampling:
    """Bounds of a fit. ``per_class`` labelled documents at most are read for each label.

    Features need ``min_z`` standard errors between their log-count ratio and zero, and of those
    the ``max_features`` strongest are kept.
    """

    per_class: int = 4000
    min_z: float = 4.0
    max_features: int = 50_000
    smoothing: float = 1.0


@dataclass
class Examples:
    """The chosen features' ratios, and the sample as rows of places among them."""

    keys: np.ndarray
    ratios: np.ndarray
    starts: np.ndarray
    places: np.ndarray
    labels: np.ndarray

    def row(self, i: int) -> np.ndarray:
        return self.places[self.starts[i] : self.starts[i + 1]]


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, text, label) of at most ``per_class`` training documents of each label.

    They are those of smallest ``lottery`` number. Rows with crc32(doc_id) mod 3 = 1, without doc_id
    or with another label than 0 and 1 are not used. Of repeated ids one row is used.
    """
    train = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(
        F.col("doc_id").isNotNull() & (remainder("doc_id", 3) != 1)
    )
    counts = {r.label: r["count"] for r in train.where("label IN (0, 1)").groupBy("label").count().collect()}
    picked = None
    for value in (0, 1):
        part = train.where(F.col("label") == value)
        part = part.where(lottery("doc_id") < cutoff(counts.get(value, 0), per_class)).distinct()
        part = part.orderBy(lottery("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionAll(part)
    # bounded by two times per_class ids
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


#: Features that a task gathers before it sends their counts on.
_GATHERED = 2_000_000


def _counts(features: Features):
    def sums(parts):
        keys, back = np.unique(np.concatenate([k for _, k in parts]), return_inverse=True)
        ones = np.bincount(back, np.concatenate([x for x, _ in parts]), len(keys)).astype(np.int64)
        both = np.bincount(back, minlength=len(keys))
        columns = [pa.array(keys.view(np.int64)), pa.array(both - ones), pa.array(ones)]
        return pa.RecordBatch.from_arrays(columns, ["key", "n0", "n1"])

    def run(batches):
        for batch in batches:
            label = np.asarray(batch.column("label"))
            parts, size = [], 0
            for pairs in features(batch.column("text")):
                owner, keys = distinct_pairs(*pairs)
                parts.append((label[owner], keys))
                size += len(keys)
                if size >= _GATHERED:
                    yield sums(parts)
                    parts, size = [], 0
            if size:
                yield sums(parts)

    return run


def _rows(features: Features, table: KeyTable):
    def run(batches):
        for batch in batches:
            count = batch.num_rows
            found = [np.zeros(0, np.int64)] * count
            for owner, keys in features(batch.column("text")):
                place = table.find(keys)
                hit = place >= 0
                owner, place = distinct_pairs(owner[hit], place[hit])
                for i in np.unique(owner):
                    found[i] = np.union1d(found[i], place[owner == i])
            sizes = np.cumsum([0] + [len(x) for x in found])
            values = np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int32)
            places = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), places],
                ["doc_id", "label", "places"],
            )

    return run


def examples(rows: DataFrame, features: Features, bounds: Sampling) -> Examples | None:
    """Count, choose and gather; None if the rows do not hold both labels or no feature is left."""
    rows = written(rows)
    classes = {r.label for r in rows.select("label").distinct().collect()}
    if classes != {0, 1}:
        return None
    counts = rows.mapInArrow(_counts(features), "key long, n0 long, n1 long")
    counts = written(counts.groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    s = bounds.smoothing
    total = counts.agg(F.count("*").alias("n"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).first()
    if not total.n:
        return None
    base = float(np.log((total.n1 + s * total.n) / (total.n0 + s * total.n)))
    ratio = F.log((F.col("n1") + s) / (F.col("n0") + s)) - base
    error = F.sqrt(1 / (F.col("n1") + s) + 1 / (F.col("n0") + s))
    chosen = counts.select("key", ratio.alias("ratio"), F.abs(ratio / error).alias("z"))
    chosen = chosen.where(F.col("z") >= bounds.min_z).orderBy(F.desc("z"), "key")
    chosen = chosen.limit(bounds.max_features).select("key", "ratio").toPandas()
    if chosen.empty:
        return None
    keys = chosen["key"].to_numpy(np.int64).view(np.uint64)
    kind = dict(rows.dtypes)["doc_id"]
    found = rows.mapInArrow(
        _rows(features, KeyTable(keys)), f"doc_id {kind}, label int, places array<int>"
    )
    found = found.orderBy("doc_id", "label").toArrow()
    lists = found.column("places").combine_chunks()
    return Examples(
        keys,
        chosen["ratio"].to_numpy(np.float64),
        np.asarray(lists.offsets, np.int64) - lists.offsets[0].as_py(),
        np.asarray(lists.flatten(), np.int64),
        np.asarray(found.column("label"), np.int64),
    )


@dataclass
class Linear:
    """score = 1 / (1 + exp(-(slope * (bias + sum of the weights of a text's features) + shift)))"""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def __post_init__(self):
        self.table = KeyTable(self.keys)

    def scores(self, column: pa.Array, features: Features) -> np.ndarray:
        total = np.full(len(column), self.bias)
        for owner, keys in features(column):
            place = self.table.find(keys)
            hit = place >= 0
            owner, place = distinct_pairs(owner[hit], place[hit])
            total += np.bincount(owner, self.weights[place], len(column))
        return 1 / (1 + np.exp(-np.clip(self.slope * total + self.shift, -500, 500)))


def calibrated(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the margins (Newton steps, smoothed targets)."""
    ones = labels.sum()
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))
    x = np.stack([margins, np.ones(len(margins))])
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2), x @ (p - target))
        theta -= np.clip(step, -5, 5)
    return (float(theta[0]), float(theta[1])) if theta[0] > 0 else (1.0, 0.0)


def fitted(data: Examples | None, learn: Callable[[Examples, np.ndarray], tuple]) -> Linear:
    """Learn on four fifths of the sample, calibrate on the rest, then learn on all of it.

    Without data of both labels every score is one half.
    """
    if data is None or min(data.labels.sum(), (1 - data.labels).sum()) < 5:
        return Linear(np.zeros(0, np.uint64), np.zeros(0), 0.0, 1.0, 0.0)
    every = np.arange(len(data.labels))
    rest = np.zeros(len(every), bool)
    for value in (0, 1):
        rest[np.flatnonzero(data.labels == value)[::5]] = True
    weights, bias = learn(data, every[~rest])
    margins = np.array([bias + weights[data.row(i)].sum() for i in every[rest]])
    slope, shift = calibrated(margins, data.labels[rest])
    weights, bias = learn(data, every)
    return Linear(data.keys, weights, bias, slope, shift)


def scored(docs: DataFrame, model: Linear, features: Features, threshold: float) -> DataFrame:
    """doc_id, score and predicted for every row of ``docs``; a null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            score = shared.value.scores(batch.column("text"), features)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score)], ["doc_id", "score"]
            )

    result = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return result.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
