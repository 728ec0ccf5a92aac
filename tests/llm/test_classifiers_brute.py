"""Ratios, descent and scores of the label classifiers against loops over the texts themselves."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpus_guard.llm import quality, toxicity
from corpus_guard.llm.labelled import Examples, Linear, Sampling, calibrated, examples

BOUNDS = Sampling(per_class=500, min_z=1.5, max_features=10_000)


def _rows(n=80, seed=3):
    draw = random.Random(seed)
    words = ["Tal", "ösen", "merta", "x", "RIN!!", "a-b", "sol,", "12", "été"]
    for i in range(n):
        label = i % 2
        yield i, " ".join(draw.choice(words[label * 2 : label * 2 + 7]) for _ in range(draw.randint(0, 25))), label


def _grams(text):
    text = text.lower()
    return {(n, text[i : i + n]) for n in (4, 5, 6) for i in range(len(text) - n + 1)}


def test_ratios_and_choice_of_character_grams(spark, documents):
    rows = list(_rows())
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int")
    data = examples(frame, toxicity.features, BOUNDS)
    counts = [Counter(), Counter()]
    for _, text, label in rows:
        counts[label].update(_grams(text))
    every = set(counts[0]) | set(counts[1])
    base = math.log((counts[1].total() + len(every)) / (counts[0].total() + len(every)))
    ratios = {}
    for gram in every:
        a, b = counts[1][gram] + 1, counts[0][gram] + 1
        ratio = math.log(a / b) - base
        if abs(ratio) / math.sqrt(1 / a + 1 / b) >= BOUNDS.min_z:
            ratios[gram] = ratio
    assert sorted(data.ratios) == pytest.approx(sorted(ratios.values())) and len(ratios) > 30
    for i, (_, text, label) in enumerate(sorted(rows)):
        own = [ratios[g] for g in _grams(text) if g in ratios]
        assert sorted(data.ratios[data.row(i)]) == pytest.approx(sorted(own)) and data.labels[i] == label


def _data(seed, n=60, features=25):
    draw = np.random.default_rng(seed)
    rows = [np.sort(draw.choice(features, draw.integers(0, 12), replace=False)) for _ in range(n)]
    labels = np.array([int(len(r) and r.mean() > features / 2) ^ int(draw.random() < 0.1) for r in rows])
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    return Examples(np.arange(features, dtype=np.uint64), draw.normal(0, 1, features), starts, np.concatenate(rows), labels)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_dual_coordinate_descent_minimises_the_hinge_loss(seed):
    data = _data(seed)
    rows = np.arange(len(data.labels))
    weights, bias = quality.hinge_descent(data, rows, epochs=400)
    w = weights / data.ratios  # of the scaled indicators

    def loss(w, bias):
        margins = np.array([bias + (w * data.ratios)[data.row(i)].sum() for i in rows])
        return (w @ w + bias**2) / 2 + np.maximum(0, 1 - (2 * data.labels - 1) * margins).sum()

    best, draw = loss(w, bias), np.random.default_rng(9)
    for scale in (1e-3, 1e-2, 0.1, 1):
        for _ in range(100):
            assert loss(w + scale * draw.normal(size=len(w)), bias + scale * draw.normal()) > best - 1e-3
    assert best < loss(np.zeros(len(w)), 0.0)


def test_logistic_steps_are_those_of_single_numbers():
    data = _data(5, n=25)
    rows = np.arange(len(data.labels))
    got, got_bias = toxicity.logistic_steps(data, rows, epochs=3)
    weights, seen, bias, bias_seen = Counter(), Counter(), 0.0, 1e-8
    order = np.random.default_rng(7)
    for _ in range(3):
        for i in order.permutation(rows):
            margin = bias + sum(weights[k] * data.ratios[k] for k in data.row(i))
            slope = 1 / (1 + math.exp(-max(-35, min(35, margin)))) - data.labels[i]
            for k in data.row(i):
                step = slope * data.ratios[k] + 1e-4 * weights[k]
                seen[k] += step * step
                weights[k] -= 0.3 * step / math.sqrt(1e-8 + seen[k])
            bias_seen += slope * slope
            bias -= 0.3 * slope / math.sqrt(bias_seen)
    assert got == pytest.approx([weights[k] * data.ratios[k] for k in range(len(data.keys))]) and got_bias == pytest.approx(bias)


def test_calibration_fits_the_smoothed_targets():
    draw = np.random.default_rng(4)
    margins = draw.normal(0, 2, 400)
    labels = (draw.random(400) < 1 / (1 + np.exp(-(0.7 * margins - 0.4)))).astype(int)
    slope, shift = calibrated(margins, labels)
    ones = labels.sum()
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))

    def loss(a, b):
        p = 1 / (1 + np.exp(-(a * margins + b)))
        return -(target * np.log(p) + (1 - target) * np.log(1 - p)).sum()

    assert all(loss(slope + a, shift + b) >= loss(slope, shift) for a in (-0.01, 0, 0.01) for b in (-0.01, 0, 0.01))


def test_scores_add_up_the_features_of_a_text():
    texts = [t for _, t, _ in _rows(20)] + [None, "", "abc"]
    column = pa.array(texts, pa.string())
    pairs = [(o, k) for owner, keys in toxicity.features(column) for o, k in zip(owner.tolist(), keys.tolist())]
    known = sorted({k for _, k in pairs})[::2]
    weights = np.random.default_rng(2).normal(size=len(known))
    model = Linear(np.array(known, np.uint64), weights, 0.3, 1.5, -0.2)
    got = model.scores(column, toxicity.features)
    weight = dict(zip(known, weights))
    for i in range(len(texts)):
        total = 0.3 + sum(weight.get(k, 0.0) for k in {k for o, k in pairs if o == i})
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(1.5 * total - 0.2))))


def test_word_and_shape_features_of_quality():
    """Texts of equal words in lower case share word grams; shapes tell them apart."""
    column = pa.array(["one TWO two", "One two TWO", "three", None, " one\ntwo\ttwo"], pa.string())
    sets = [set() for _ in range(5)]
    sizes = Counter()
    for owner, keys in quality.features(column):
        for o, k in zip(owner.tolist(), keys.tolist()):
            sets[o].add(k)
            sizes[o] += 1
    # 3 + 2 grams of words, 3 + 2 + 1 of shapes
    assert sizes == {0: 11, 1: 11, 2: 2, 4: 11} and not sets[3]
    words = len(set(re.findall(r"\S+", "one two two"))) + 2
    assert len(sets[0] & sets[1]) >= words and sets[0] != sets[1] and sets[0] & sets[4] and not sets[0] & sets[2] - sets[2]
