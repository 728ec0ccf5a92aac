import hashlib
import math
from collections import Counter

from corpus_guard.llm import mixing
from corpus_guard.llm.mixing import Mix


def _times(doc_id, rate, text=""):
    name = "mix|" + ("~" + hashlib.md5((text or "").encode()).hexdigest() if doc_id is None else str(doc_id))
    parts = max(1, math.ceil(rate / 8))
    return sum(_inverse(name + (f"|part|{p}" if p > 1 else ""), rate / parts) for p in range(1, parts + 1))


def _inverse(text, rate):
    draw = int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2**52
    p = below = math.exp(-rate)
    times = 0
    while draw >= below and times < 60:
        times += 1
        p *= rate / times
        below += p
    return times


def _docs(documents):
    return documents(*[(i, "x" * (i % 90), "en", "big" if i % 3 else f"s{i % 5}") for i in range(600)])


def test_counts_are_the_inverse_poisson_draws(documents):
    docs = _docs(documents)
    rate = {r.source: r.rate for r in mixing.rates(docs).collect()}
    rows = mixing.mixed(docs).collect()
    got = Counter(r.doc_id for r in rows)
    source = {r.doc_id: r.source for r in docs.collect()}
    assert got == Counter({i: n for i, s in source.items() if (n := _times(i, rate[s]))})
    assert all(sorted(r.copy for r in rows if r.doc_id == i) == list(range(1, n + 1)) for i, n in list(got.items())[:50])
    assert len({r.order_key for r in rows}) == len(rows)
    again = mixing.mixed(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_target_weights(spark, documents):
    docs = documents(*[(i, "x" * 9, "en", "abc"[i % 3] if i % 6 else "a") for i in range(6000)])
    targets = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", None)], "source string, weight double")
    rows = mixing.mixed(docs, targets).groupBy("source").count().collect()
    share = {r.source: r["count"] / sum(x["count"] for x in rows) for r in rows}
    assert set(share) == {"a", "b"} and abs(share["b"] - 0.75) < 0.02


def test_join_beyond_the_broadcast_bound(documents):
    docs = _docs(documents)
    few, many = (mixing.mixed(docs, mix=Mix(broadcast_sources=n, salts=4)) for n in (100, 2))
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))


def test_odd_rows(documents):
    rows = [(1, None, "en", None), (2, "", None, "s"), (None, "a", "en", "s"), (4, "b" * 500_000, "en", "t"), (2, "", None, "s")]
    schema = "doc_id long, text string, lang string, source string, copy string"
    docs = documents(*rows, schema=schema, defaults=("en", "s", "c"))
    rate = {r.source: r.rate for r in mixing.rates(docs).collect()}
    got = Counter(r.doc_id for r in mixing.mixed(docs).collect())
    want = Counter()
    for doc_id, text, _, source in rows:
        want[doc_id] += _times(doc_id, rate[source], text)
    assert got == +want
    assert mixing.mixed(docs).columns == ["doc_id", "text", "lang", "source", "copy", "order_key"]
    assert mixing.mixed(docs.where("false")).collect() == []


def test_small_sources_reach_their_rate(documents):
    """A mean far beyond one draw's table is the sum of several draws."""
    docs = documents(*[(i, "y" * 50_000, "en", "huge") for i in range(400)], *[(1000 + i, "x" * 100, "en", f"tiny{i % 3}") for i in range(30)])
    rate = {r.source: r.rate for r in mixing.rates(docs).collect()}
    assert rate["tiny0"] > 100 and 0 < rate["huge"] < 1
    rows = mixing.mixed(docs).groupBy("doc_id", "source").count().collect()
    for r in rows:
        if r.source.startswith("tiny"):
            assert r["count"] == _times(r.doc_id, rate[r.source])
    got = sum(r["count"] for r in rows if r.source == "tiny0")
    assert abs(got - 10 * rate["tiny0"]) < 6 * (10 * rate["tiny0"]) ** 0.5
    plan = {r.source: r for r in mixing.planned(docs).collect()}
    weights = {"huge": (400 * 50_001) ** 0.5} | {f"tiny{i}": (10 * 101) ** 0.5 for i in range(3)}
    for source, weight in weights.items():
        assert abs(plan[source].share - weight / sum(weights.values())) < 1e-9


def test_rows_without_id_draw_by_their_text(spark, documents):
    docs = documents(*[(None, f"text {i}", "en", "s") for i in range(3000)], *[(i, "z", "en", "t") for i in range(50)])
    rows = mixing.mixed(docs).where("doc_id IS NULL")
    got = Counter(r.text for r in rows.collect())
    assert len(set(got.values())) > 2 and rows.select("order_key").distinct().count() == sum(got.values())
