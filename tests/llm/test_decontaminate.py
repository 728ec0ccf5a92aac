import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpus_guard.llm import decontaminate
from corpus_guard.llm.decontaminate import Tiling, tiles


def _greedy(test, text, least):
    """Mark the longest match of unmarked words, the first by place of equals, again and again."""
    free_a, free_b = [x != 0 for x in test], [x != 0 for x in text]
    lengths = []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(test)):
            for j in range(len(text)):
                k = 0
                while i + k < len(test) and j + k < len(text) and test[i + k] == text[j + k] and free_a[i + k] and free_b[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        size, i, j = best
        if size < least:
            return sorted(lengths, reverse=True)
        for k in range(size):
            free_a[i + k] = free_b[j + k] = False
        lengths.append(size)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=25), st.lists(st.integers(0, 3), max_size=25), st.integers(1, 4))
def test_longest_first(test, text, least):
    found = tiles(np.array(test, np.uint64), np.array(text, np.uint64), Tiling(least_match=least))
    assert [size for size, _, _ in found][:1] == _greedy(test, text, least)[:1]
    taken = [set(), set()]
    for size, i, j in found:
        assert size >= least and test[i : i + size] == text[j : j + size] and 0 not in test[i : i + size]
        for side, at in ((0, i), (1, j)):
            assert not taken[side] & set(range(at, at + size))
            taken[side] |= set(range(at, at + size))


def test_reordered_passage():
    draw = np.random.default_rng(3)
    test = draw.integers(1, 1 << 60, 90).astype(np.uint64)
    parts = [test[60:], draw.integers(1, 1 << 60, 7).astype(np.uint64), test[:20], test[20:60]]
    assert sum(size for size, _, _ in tiles(test, np.concatenate(parts))) == 90


WORDS = [f"word{i}" for i in range(500)]


def _prose(draw, size):
    return " ".join(draw.choice(WORDS) for _ in range(size))


def test_planted_items(spark, documents):
    draw = random.Random(8)
    items = [(i, _prose(draw, 40)) for i in range(12)]
    rows, want = [], {}
    for i in range(80):
        text = _prose(draw, 120)
        if i % 4 == 0:
            words = items[i % 12][1].split()
            if i % 8 == 0:
                words = [w.upper() + "," for w in words[20:] + words[:20]]
            text = f"{text} {' '.join(words)} {_prose(draw, 9)}"
            want[i] = [i % 12]
        elif i % 4 == 1:
            text = f"{text} {' '.join(items[i % 12][1].split()[:15])}"  # too little of it
        rows.append((i, text))
    got = decontaminate.contaminated(documents(*rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id: r.item_ids for r in got.collect()} == want
    assert all(r.coverage == 1.0 for r in got.collect())


def test_odd_rows(spark, documents):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    items = [(1, item), (1, item), (2, None), (3, ""), (4, "too short"), (None, "the " * 60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, None), (2, ""), (3, item), (3, item), (None, item + " " + item), (5, "too short"), (6, "the " * 30_000)]
    schema = "doc_id long, text string, item_id string, words string, covered int"
    docs = documents(*rows, schema=schema, defaults=("i", "w", 0))
    got = [(r.doc_id, r.item_ids, r.coverage) for r in decontaminate.contaminated(docs, bench).collect()]
    assert sorted(got, key=str) == [(3, [1], 1.0), (5, [4], 1.0), (6, [], 1.0), (None, [1], 1.0)]
    kept = decontaminate.without(docs, decontaminate.contaminated_pairs(docs, bench))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]
    empty = docs.where("false")
    assert decontaminate.contaminated(empty, bench).collect() == []
    assert decontaminate.contaminated(docs, bench.where("false")).collect() == []


def test_short_items_match_whole_documents(spark, documents):
    items = [(1, "what is the capital"), (2, "Yes"), (3, "a b c d e"), (4, "no, no")]
    rows = [(1, "What is the CAPITAL?"), (2, "what is the capital of it"), (3, "yes"), (4, "yes yes"), (5, "is the capital"),
            (6, "a b c d e"), (7, "no no"), (8, "no"), (9, "...")]
    got = decontaminate.contaminated(documents(*rows), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_ids, r.coverage) for r in got.collect()) == [
        (1, [1], 1.0), (3, [2], 1.0), (6, [3], 1.0), (7, [4], 1.0)
    ]


def _covered(item, text, tiling):
    """Words of an item that greedy tiles cover, by loops over the words themselves."""
    test, words = (re.findall(r"[a-z0-9]+", x.lower()) for x in (item, text))
    if len(test) < tiling.least_match:
        return len(test) if test == words else 0, len(test)
    names = {w: i + 1 for i, w in enumerate(dict.fromkeys(test + words))}
    return sum(_greedy([names[w] for w in test], [names[w] for w in words], tiling.least_match)), len(test)


def test_coverage_equals_brute_force(spark, documents):
    """Whole results over documents that hold parts of items in any order."""
    draw = random.Random(21)
    items = [(i, _prose(draw, draw.randint(2, 40))) for i in range(14)]
    rows = []
    for i in range(90):
        pieces = [_prose(draw, draw.randint(1, 12)) for _ in range(3)]
        for _ in range(draw.randint(0, 3)):
            words = draw.choice(items)[1].split()
            at = draw.randrange(len(words))
            pieces.append(" ".join(words[at : at + draw.randint(3, 30)]))
        draw.shuffle(pieces)
        rows.append((i, " ".join(pieces)))
    rows += [(100 + i, text) for i, (_, text) in enumerate(items)]
    tiling = Tiling()
    want = {}
    for i, text in rows:
        for item, passage in items:
            covered, size = _covered(passage, text, tiling)
            if covered and covered * 100 >= size * tiling.percent:
                want[i, item] = covered
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated_pairs(documents(*rows), bench, tiling).collect()
    assert {(r.doc_id, r.item_id): r.covered for r in got} == want and len(want) > 30
