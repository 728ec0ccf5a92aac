import random
import re
from collections import Counter

import numpy as np
import pytest

from corpus_guard.llm import jaccard
from corpus_guard.llm.components import components
from corpus_guard.llm.jaccard import Frequency, Join, prefix


def _sets(rows):
    out = []
    for doc_id, text in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(
            b + 32 if 65 <= b <= 90 else b for b in range(256))))
        if len(words) >= 5:
            out.append((doc_id, {tuple(words[i : i + 5]) for i in range(len(words) - 4)}))
        else:
            out.append((doc_id, {tuple(words)} if words else set()))
    return out


def _brute(rows):
    """(doc_id, size, component) of every row, from all pairs."""
    sets = _sets(rows)
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    least = {}
    for (doc_id, _), x in zip(sets, label):
        if doc_id is not None:
            least[x] = min(doc_id, least.get(x, doc_id))
    return Counter((d, len(s), least.get(x) if s else d) for (d, s), x in zip(sets, label))


def _corpus(seed, groups=12, copies=8):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    shared = " ".join(draw.choice(words) for _ in range(30))
    rows = []
    for g in range(groups):
        base = [draw.choice(words) for _ in range(draw.randint(3, 90))]
        if draw.random() < 0.5:
            base += shared.split()
        for _ in range(draw.randint(1, copies)):
            text = list(base)
            for _ in range(draw.randint(0, 4)):
                text[draw.randrange(len(text))] = draw.choice(words)
            rows.append(" ".join(text))
    draw.shuffle(rows)
    return list(enumerate(rows))


def _got(docs, join=jaccard.JOIN):
    return Counter(tuple(r) for r in jaccard.classes(docs, join).collect())


@pytest.mark.parametrize("seed,join", [(1, Join()), (2, Join(pivot_rounds=0, counters=4096, salt_over=3))])
def test_components_are_those_of_all_pairs(documents, seed, join):
    rows = _corpus(seed)
    assert _got(documents(*rows), join) == _brute(rows)


def test_odd_rows(documents):
    text = "one two three four five six seven eight nine ten"
    rows = [(9, text), (3, text.upper()), (3, text.upper()), (4, text + " eleven"), (None, text)]
    rows += [(5, None), (6, ""), (6, ""), (7, " \t"), (10, "a b"), (11, "A\nB"), (12, "a"), (None, None)]
    rows += [(13, "x y z v u " * 20_000), (14, "x y z v u " * 20_000 + "t")]
    schema = "doc_id long, text string, node string, row string, root string"
    docs = documents(*rows, schema=schema, defaults=("n", "r", "t"))
    assert _got(docs) == _brute(rows)
    kept = jaccard.one_of_each(docs)
    assert kept.schema == docs.schema
    got = Counter(r.doc_id for r in kept.collect())
    assert got == Counter([3, 5, 6, 6, 7, 10, 12, 13, None])


def test_empty_table(documents):
    empty = documents("a").where("false")
    assert jaccard.classes(empty).collect() == [] and jaccard.one_of_each(empty).collect() == []


def test_prefixes_share_what_they_must():
    """Of any two similar sets the prefixes share at least the smaller l, whatever the order."""
    draw = np.random.default_rng(5)
    counters = draw.integers(0, 40, 4096).astype(np.uint32)
    frequency = Frequency(counters)
    pool = draw.integers(1, 1 << 60, 4000).astype(np.uint64)
    checked = 0
    for _ in range(400):
        size = int(draw.integers(1, 120))
        a = np.unique(draw.choice(pool, size))
        swap = int(draw.integers(0, max(1, len(a) // 5) + 1))
        b = np.unique(np.concatenate([a[swap:], draw.choice(pool, draw.integers(0, 4))]))
        both = len(np.intersect1d(a, b))
        if len(b) == 0 or 100 * both < 75 * len(np.union1d(a, b)):
            continue
        checked += 1
        need_a, first, _ = prefix(a, frequency.of(a), Join(counters=4096))
        need_b, second, _ = prefix(b, frequency.of(b), Join(counters=4096))
        assert len(np.intersect1d(first, second)) >= min(need_a, need_b)
    assert checked > 100


def test_components(spark):
    draw = random.Random(2)
    links = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    links += [(5, 5), (None, 3)]
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            label[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert Counter((r.node, r.root) for r in got) == Counter((x, find(x)) for x in label)


def _brute_links(rows):
    sets = _sets(rows)
    links = [
        sum(i != j and bool(a and b) and 100 * len(a & b) >= 75 * len(a | b) for j, (_, b) in enumerate(sets))
        for i, (_, a) in enumerate(sets)
    ]
    return Counter((doc_id, n) for (doc_id, _), n in zip(rows, links))


@pytest.mark.parametrize("join", [Join(), Join(counters=4096, salt_over=3, block=3)])
def test_every_link_is_counted(documents, join):
    """Also those inside a group of many near copies, and those of equal rows."""
    rows = _corpus(6, groups=6, copies=30)
    rows += [(1000 + i, text) for i, (_, text) in enumerate(rows[:9])] + [(2000, None), (2001, ""), (2002, "a b")]
    got = jaccard.counted(documents(*rows), join).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == _brute(rows)
    assert Counter((r.doc_id, r.n_links) for r in got) == _brute_links(rows)
    assert max(r.n_links for r in got) > 8
    assert jaccard.counted(documents("a").where("false"), join).collect() == []


@pytest.mark.parametrize("join", [Join(), Join(pivot_rounds=0), Join(counters=4096, salt_over=3, dense=2)])
def test_sets_and_verified_pairs_span_the_components(documents, join):
    rows = _corpus(8, groups=6, copies=30)
    rows += [(1000 + i, text) for i, (_, text) in enumerate(rows[:9])] + [(2000, None), (2001, ""), (2002, "a b"), (2003, "A b")]
    got = jaccard.grouped(documents(*rows), join).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == _brute(rows)
    sets = _sets(rows)
    equal = {i: [j for j, other in sets if own and other == own] or [i] for i, own in sets}
    shingles = dict(sets)
    joined = {}
    for r in got:
        assert (r.set_id, r.n_equal) == (min(equal[r.doc_id]), len(equal[r.doc_id]))
        joined.setdefault(r.set_id, r.set_id)
        if r.linked_set is not None:
            a, b = shingles[r.set_id], shingles[r.linked_set]
            assert a != b and 100 * len(a & b) >= 75 * len(a | b)
    # every component of several sets is held together by the pairs of the smallest set of each
    for component in {r.component_id for r in got}:
        own = [r for r in got if r.component_id == component]
        linked = {r.set_id for r in own if r.linked_set is not None}
        assert linked == ({r.set_id for r in own} if len({r.set_id for r in own}) > 1 else set())
    assert jaccard.grouped(documents("a").where("false"), join).collect() == []


def test_nodes_that_leave_too_little_behind_their_first_common_token_are_not_paired(spark):
    """40 nodes share 30 tokens, after 37 of their own: 109 of 146 are left, and 126 must be common."""
    rows = [(token, node, 37 + token, node, 146, 20) for node in range(40) for token in range(30)]
    # with 20 of their own 126 are left
    rows += [(100 + token, node, 20 + token, node, 146, 20) for node in (100, 101) for token in range(30)]
    # of the 30 tokens they share 10, fewer than they must
    rows += [(200 + token + 20 * (node - 200), node, token, node, 146, 20) for node in (200, 201) for token in range(30)]
    entries = spark.createDataFrame(rows, "token long, node long, place int, root long, size long, need int")
    assert [(r.a, r.b) for r in jaccard._candidates(entries, 75).collect()] == [(100, 101)]


def test_shingles_of_the_same_nodes_are_one_token(documents):
    """Nodes are joined with their tokens in every turn: 12 near copies of 400 words had 12 rows for each shingle."""
    draw = random.Random(3)
    base = [f"w{draw.randrange(10_000)}" for _ in range(400)]
    rows = [(i, " ".join([*base, f"own{i}"])) for i in range(12)] + [(100 + i, f"x{i} y{i} z{i} v u t") for i in range(40)]
    rows += [(200, " ".join(base)), (201, " ".join(base[:390]))]
    members, entries, facts, _ = jaccard._prepared(documents(*rows), Join())
    got = entries.collect()
    # tokens of all 14 copies, and of all but the shortest
    assert len(got) <= 3 * 14 and max(r.weight for r in got) > 20
    sizes = {r.node: (r.n_shingles, r.need) for r in members.collect()}
    assert all(sizes[r.node] == (r.size, r.need) for r in got)
    assert _got(documents(*rows)) == _brute(rows)
