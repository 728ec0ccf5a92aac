"""Subword lattice likelihood against enumerated cuts and plain counts."""

import math
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from corpus_guard.llm import lattice
from corpus_guard.llm.shared import table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def cuts(word: bytes):
    for n in range(len(word)):
        for at in combinations(range(1, len(word)), n):
            ends = [0, *at, len(word)]
            yield [word[a:b] for a, b in zip(ends, ends[1:])]


def spelled(word: str, weights: dict, stop: float) -> float:
    paths = (c for c in cuts(b" " + word.encode()) if all(p in weights for p in c))
    return math.log(sum(math.exp(sum(weights[p] for p in c)) for c in paths)) + stop


def packed(*words):
    enc = [b" " + w.encode() for w in words]
    return np.frombuffer(b"".join(enc), np.uint8), np.concatenate([[0], np.cumsum([len(e) for e in enc])])


def test_pieces_of_the_vocabulary():
    known, first = lattice.pieces()
    assert len(set(known)) == len(known) == len(first) and (first > 0).all()
    assert b" " in known and b" t" in known and b"\xff" in known
    assert not any(65 <= x <= 90 for p in known for x in p)
    assert not any(b" " in p[1:] or b"\n" in p for p in known)


def test_forward_adds_up_all_cuts():
    known = sorted({b" ", b" a", b" ab", b"a", b"b", b"ab", b"ba", b"aba", "é".encode(), b"\xc3", b"\xa9"})
    weight = np.log(np.random.default_rng(1).random(len(known)))
    words = ["a", "abab", "b", "ébaé", "aaaaaaa", "abaab"]
    got = lattice.Lattice(known).log_probabilities(*packed(*words), weight)
    weights = dict(zip(known, weight))
    assert np.allclose(got, [spelled(w, weights, 0.0) for w in words])


def test_expected_counts_are_those_of_all_cuts():
    known = sorted({b" ", b" a", b"a", b"b", b"ab", b"ba"})
    weight = np.log(np.random.default_rng(2).random(len(known)))
    weights, words, seen = dict(zip(known, weight)), ["abab", "b", "aab"], np.array([2.0, 1.0, 5.0])
    want = Counter()
    for word, times in zip(words, seen):
        paths = [c for c in cuts(b" " + word.encode()) if all(p in weights for p in c)]
        chance = [math.exp(sum(weights[p] for p in c)) for c in paths]
        for path, x in zip(paths, chance):
            for piece in path:
                want[piece] += times * x / sum(chance)
    got, _ = lattice.Lattice(known).expected(*packed(*words), seen, weight)
    assert np.allclose(got, [want[p] for p in known])


def test_blocks_do_not_change_a_word(monkeypatch):
    known, first = lattice.pieces()
    weight = np.log(first / first.sum())
    words = [f"word{'x' * (i % 70)}y{i}" for i in range(300)]
    model = lattice.Lattice(known)
    whole = model.log_probabilities(*packed(*words), weight)
    monkeypatch.setattr(lattice, "LATTICE_BYTES", 64)
    assert np.allclose(model.log_probabilities(*packed(*words), weight), whole)


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def compare(rows, model, result):
    """Rows (doc_id, text) against counts in Python; scores against enumerated cuts of short words."""
    train = [words_of(t) for i, t in rows if not held_out(i)]
    counts = Counter(w for ws in train for w in ws)
    ends = len(train)
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
    d = min(max(once / (once + 2 * twice) if once else 0.5, 0.05), 0.95)
    weights = dict(zip(model.known, model.weight))
    lat = {w: math.exp(spelled(w, weights, model.stop)) for w in {w for _, t in rows for w in words_of(t)}}
    want = []
    for i, text in rows:
        words = words_of(text)
        score = math.log10((ends + d) / (n + 2 * d)) + sum(
            math.log10((max(counts[w] - d, 0) + d * (len(counts) + 1) * lat[w]) / (n + 2 * d)) for w in words
        )
        base = sum(math.log10((c + 1) / (n + v + 1)) for c in [counts[w] for w in words] + [ends])
        known = sum(counts[w] > 0 for w in words) + (ends > 0)
        want.append((i, held_out(i), len(words) + 1, known, n, pytest.approx(base), pytest.approx(score)))
    got = sorted(map(tuple, result.collect()), key=lambda r: repr(r[:5]))
    assert got == sorted(want, key=lambda r: repr(r[:5]))


ROWS = [
    (1, "The cat the Cat"), (2, "a dog, a cat"), (3, None), (4, ""), (5, " \n "), (None, "the end"), (7, "éa éa xyz"),
    (7, "éa éa xyz"), (9, "cat dog the a qq"), (10, "the unseen wug"), (11, "zz the"), (16, "rare wug"), (20, "ß the"),
]


@pytest.mark.parametrize("frequent", [1 << 16, 3, 1])
def test_scores_equal_brute_force(spark, documents, monkeypatch, frequent):
    monkeypatch.setattr(lattice, "FREQUENT", frequent)
    docs = documents(*ROWS)
    assert {held_out(i) for i, _ in ROWS} == {True, False}
    model = lattice.fit(docs, passes=2)
    assert len(model.frequent) <= max(frequent, 3)
    result = lattice.scored(docs, model)
    assert result.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    compare(ROWS, model, result)


def test_a_document_the_model_has_not_counted(spark, documents):
    model = lattice.fit(documents(*ROWS), passes=1)
    row = lattice.scored(documents((2, "neverseen cat")), model).first()
    assert row.n_tokens == 3 and row.n_known == 2 and row.score < 0


def test_empty_table_and_no_training_rows(spark, documents):
    empty = documents((1, "x")).where("false")
    assert lattice.scored(empty, lattice.fit(empty)).collect() == []
    held = [i for i in range(40) if held_out(i)][:2]
    docs = documents(*[(i, "only held out") for i in held])
    for row in lattice.scored(docs, lattice.fit(docs)).collect():
        assert row.held_out and row.n_known == 0 and row.train_tokens == 0 and row.base_score == 0
        assert -1e4 < row.score < 0


def test_clashing_columns_and_long_texts(spark, documents):
    docs = documents((1, "ab " * 200_000), (2, "x" * 100_000), (4, "ab x")).selectExpr(
        "*", "1 AS row", "2 AS rest", "3 AS key", "4 AS score", "5 AS held_out", "6 AS train", "7 AS n"
    )
    rows = {r.doc_id: r for r in lattice.scored(docs, lattice.fit(docs, passes=1)).collect()}
    assert rows[1].n_tokens == 200_001 and rows[2].n_tokens == 2 and all(math.isfinite(r.score) for r in rows.values())


def test_passes_raise_the_likelihood_and_spelling_adds_up(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    model = lattice.fit(docs, passes=3)
    assert model.likelihoods == sorted(model.likelihoods)
    starts = lattice.Lattice(model.known).starts
    assert np.exp(model.weight[starts]).sum() == pytest.approx(1)
    assert np.exp(model.weight[~starts]).sum() + math.exp(model.stop) == pytest.approx(1)


def test_held_out_texts_of_known_words_are_likelier_than_shuffled_letters(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").where("length(text) BETWEEN 200 AND 5000")
    model = lattice.fit(docs)
    turned = docs.selectExpr("doc_id", "concat_ws(' ', transform(split(text, ' '), w -> reverse(w))) AS text")
    scores = {r.doc_id: r for r in lattice.scored(docs, model).collect() if r.held_out}
    other = {r.doc_id: r for r in lattice.scored(turned, model).collect() if r.held_out}
    better = [scores[i].score / scores[i].n_tokens > other[i].score / other[i].n_tokens for i in scores]
    assert len(better) > 10 and sum(better) >= 0.95 * len(better)
