"""Spelling variants against plain comparisons of all words."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from corpus_guard.llm import spelling
from corpus_guard.llm.spelling import Index, Spelling, _points, crc32, near_words, occurring, variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_error(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[same:] == b[same + 1 :] or (len(a) == len(b) and a[same + 1 :] == b[same + 1 :])


def brute_words(rows, rules):
    seen = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if rules.slip and h % rules.slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= rules.least_length and n >= rules.least_seen}


def brute(words, ratio):
    near = {w: [x for x in words if one_error(w, x)] for w in words}
    forms = {}
    for w in words:
        if near[w]:
            best = min(near[w], key=lambda x: (-words[x], x))
            if words[best] >= ratio * words[w]:
                forms[w] = best
    result = []
    for w in words:
        root = w
        while root in forms:
            root = forms[root]
        form = forms.get(w)
        result.append((w, form, root, words[w], len(near[w]), words[form] if form else None))
    return sorted(result)


def some_words(n, letters="aab", longest=9, seed=1):
    draw = random.Random(seed)
    return sorted({"".join(draw.choice(letters) for _ in range(draw.randint(2, longest))) for _ in range(n)})


def test_crc32_of_many_runs():
    part = np.frombuffer("abcxyzéüx".encode() * 3, np.uint8)
    draw = np.random.default_rng(1)
    starts = draw.integers(0, len(part), 200)
    ends = np.minimum(starts + draw.integers(0, 12, 200), len(part))
    before = [f"{i}:".encode() for i in range(200)]
    got = crc32(part, starts, ends, np.array([zlib.crc32(b) for b in before], np.uint32))
    assert got.tolist() == [zlib.crc32(b + part[s:e].tobytes()) for b, s, e in zip(before, starts, ends)]


@pytest.mark.parametrize("letters", ["ab", "aaab", "abcdé", "aÿ×"])
def test_index_counts_and_finds_words(letters):
    words = some_words(120, letters, seed=len(letters))
    index = Index(*_points(words))
    text = "".join(w + "$" for w in words)
    for part in ["a", "ab", "ba", letters[-1] * 2, "aab", "zz", words[3], words[-1]]:
        low, high = np.zeros(1, np.int64), np.full(1, index.size)
        for letter in reversed(part):
            low, high = index.left(index.coded(_points([letter])[0]), low, high)
        assert high[0] - low[0] == len(re.findall(f"(?={part})", text))
    low, high = np.zeros(len(words), np.int64), np.full(len(words), len(words))
    flat, offsets = _points(words)
    for i, word in enumerate(words):
        for letter in reversed(word):
            code = index.coded(_points([letter])[0])
            low[i : i + 1], high[i : i + 1] = index.left(code, low[i : i + 1], high[i : i + 1])
    whole, number = index.words(low, high)
    assert whole.all() and number.tolist() == list(range(len(words)))


@pytest.mark.parametrize("letters", ["ab", "aaab", "abcdé", "abcdefghij"])
def test_both_searches_find_all_near_words(letters):
    words = some_words(400, letters, seed=7)
    for turn in (lambda w: w, lambda w: w[::-1]):
        turned = [turn(w) for w in words]
        index = Index(*_points(turned))
        flat, offsets = _points([*turned, "zzzzb"])
        sizes = np.diff(offsets)
        for exact in (sizes // 2, sizes - sizes // 2):
            asked, found = index.near(flat, offsets, exact)
            want = [(i, j) for i, w in enumerate(turned) for j, x in enumerate(turned) if one_error(w, x) and x.endswith(w[len(w) - exact[i] :])]
            assert sorted(zip(asked.tolist(), found.tolist())) == want


@pytest.mark.parametrize("block", [50_000, 40, 7])
def test_near_words_equal_brute_force(spark, block):
    words = some_words(300, "aab", 8) + some_words(200, "abcdefgh", 12, 3) + ["übermäßig", "übermässig", "ubermäßig", "x", "xy"]
    counts = {w: 1 + zlib.crc32(w.encode()) % 40 for w in set(words)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: (r.n, r.n_near, r.best, r.best_n) for r in near_words(frame, block).collect()}
    want = {}
    for w, n in counts.items():
        near = [x for x in counts if one_error(w, x) and len(x) > 1]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        want[w] = (n, len(near), best, counts[best] if best else None)
    want.pop("x")
    assert got == want


def texts(seed=1):
    draw = random.Random(seed)
    base = ["committee", "Accommodate", "señorita", "Übermaß", "separate", "weiß×keit", "received", "abc"]
    rows = []
    for i in range(120):
        words = []
        for _ in range(60):
            word = draw.choice(base[: draw.randint(1, len(base))])
            if draw.random() < 0.25:
                at = draw.randrange(len(word))
                word = word[:at] + draw.choice(["", "e", word[at] * 2]) + word[at + 1 :]
            words.append(word)
        rows.append((i if i % 50 else None, draw.choice([" ", ", ", "1"]).join(words)))
    return [*rows, (500, None), (501, ""), (502, "a " * 1000), (503, "long" * 30_000), (504, rows[3][1]), (504, rows[3][1])]


@pytest.mark.parametrize("rules", [Spelling(), Spelling(least_length=4, least_seen=2, ratio=2, slip=5, block=30), Spelling(slip=0)])
def test_variants_equal_brute_force(spark, documents, monkeypatch, rules):
    monkeypatch.setattr(spelling, "TEXT_BYTES", 1000)
    rows = texts()
    words = brute_words(rows, rules)
    assert {r.word: r.n for r in occurring(documents(*rows), rules).collect()} == words
    got = variants(documents(*rows).repartition(3), rules)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute(words, rules.ratio)
    assert sorted(map(tuple, got.collect())) == want
    assert any(r[1] and r[2] != r[1] for r in want) or rules.ratio == 5


def test_chains_of_forms(spark):
    links = [(f"w{i}", f"w{i + 1}") for i in range(17)] + [("a", "w16"), ("b", "a")]
    frame = spark.createDataFrame(links, "word string, root string")
    assert {r.word: r.root for r in spelling._last(frame).collect()} == {w: "w17" for w, _ in links}


def test_empty_table_and_clashing_columns(spark, documents):
    empty = documents((1, "x")).where("false")
    assert variants(empty).collect() == []
    docs = documents(*[(i, "spelling") for i in range(10)]).selectExpr("*", "1 AS word", "2 AS n", "3 AS id", "4 AS half", "5 AS root")
    assert [r.n for r in variants(docs, Spelling(slip=0)).collect()] == [10]
    assert variants(documents(*[(i, "spelling") for i in range(4)])).collect() == []


def test_query_equals_its_sql(spark):
    duck = duckdb.connect()
    duck.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = sorted(duck.execute(spelling.OP12_SQL).fetchall())
    assert sorted(map(tuple, spelling.op12(spark, "/root/testdata/sf0.001").collect())) == want
