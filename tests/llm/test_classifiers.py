import random

import pytest

from corpus_guard.llm import quality, toxicity
from corpus_guard.llm.labelled import Sampling
from corpus_guard.llm.shared import remainder

WORDS = [a + b for a in ("ran", "tol", "mer", "sil", "dan", "pru") for b in ("ta", "nel", "os", "ib")]
BOUNDS = Sampling(per_class=200, min_z=3.0)


def _texts(count, spoil):
    draw = random.Random(4)
    for i in range(count):
        words = [draw.choice(WORDS) for _ in range(draw.randint(5, 60))]
        yield i, int(i % 3 != 0), spoil(words, draw) if i % 3 == 0 else " ".join(words)


def _junk(words, draw):
    return " ".join(w.upper() + "!!" for w in words) if draw.random() < 0.5 else " ".join([words[0]] * 20)


def _insult(words, draw):
    words.insert(draw.randrange(len(words)), draw.choice(["grobbler", "Snivelwit"]))
    return " ".join(words)


@pytest.mark.parametrize(
    "module,run,label,spoil",
    [(quality, quality.quality, "quality", _junk), (toxicity, toxicity.toxicity, "toxic", _insult)],
)
def test_held_out_accuracy(spark, documents, module, run, label, spoil):
    good = 1 if label == "quality" else 0
    rows = list(_texts(450, spoil))
    docs = documents(*[(i, text) for i, _, text in rows])
    labels = spark.createDataFrame([(i, y if good else 1 - y) for i, y, _ in rows], f"doc_id long, {label} int")
    model = module.fit(docs, labels, BOUNDS)
    got = {r.doc_id: r for r in run(docs, model).collect()}
    held = [(i, y if good else 1 - y) for i, y, _ in rows if got[i].held_out]
    assert 100 < len(held) < 200
    assert sum(got[i].predicted == y for i, y in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


@pytest.mark.parametrize(
    "module,run,label", [(quality, quality.quality, "quality"), (toxicity, toxicity.toxicity, "toxic")]
)
def test_odd_rows(spark, documents, module, run, label):
    """Null, empty, blank, very long and repeated texts, null ids, clashing columns."""
    long_text = "tolta merta " * 50_000
    odd = [(1, None), (2, ""), (3, " \n"), (4, "x"), (5, long_text), (6, "a\0b"), (6, "a\0b"), (None, "é " * 9)]
    rows = [(100 + i, t) for i, _, t in _texts(120, _junk if label == "quality" else _insult)]
    schema = "doc_id long, text string, score string, label string, places int"
    docs = documents(*odd, *rows, schema=schema, defaults=("s", "l", 0))
    pairs = [(100 + i, y) for i, y, _ in _texts(120, _junk)] + [(None, 1), (5, None), (7, 3)]
    model = module.fit(docs, spark.createDataFrame(pairs, f"doc_id long, {label} int"), BOUNDS)
    got = run(docs, model).collect()
    assert len(got) == len(odd) + len(rows)
    score = {}
    for r in got:
        assert 0 <= r.score <= 1
        score.setdefault(r.doc_id, set()).add(r.score)
    assert score[1] == score[2] and len(score[6]) == 1


@pytest.mark.parametrize("module,run,label", [(quality, quality.quality, "quality"), (toxicity, toxicity.toxicity, "toxic")])
def test_without_labels_or_documents(spark, documents, module, run, label):
    docs = documents("one two", None)
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    assert [r.score for r in run(docs, module.fit(docs, none)).collect()] == [0.5, 0.5]
    empty = docs.where("false")
    assert run(empty, module.fit(empty, none)).collect() == []


def test_held_out_is_the_remainder(spark):
    import zlib

    rows = spark.range(50).select("id", remainder("id", 3).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 3 for r in rows)


def test_rejected_documents_go(spark, documents):
    rows = list(_texts(450, _junk))
    docs = documents(*[(i, text) for i, _, text in rows])
    labels = spark.createDataFrame([(i, y) for i, y, _ in rows], "doc_id long, quality int")
    model = quality.fit(docs, labels, BOUNDS)
    kept = quality.accepted(docs, model)
    assert kept.schema == docs.schema
    wanted = {r.doc_id for r in quality.quality(docs, model).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept.collect()} == wanted
