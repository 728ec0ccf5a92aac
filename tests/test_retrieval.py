"""Retrieval for a table of queries against one query after the other."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corpus_guard.operators import retrieval
from corpus_guard.operators.retrieval import secure_retrieve, secure_retrieve_all, source_counts

DOCUMENTS = "doc_id long, tenant_id string, allowed_roles array<string>, embedding array<float>"
QUERIES = "query_id string, tenant_id string, roles array<string>, embedding array<float>"


def rows(documents, queries, seed=1, size=6):
    draw = random.Random(seed)

    def vector():
        return [draw.choice([-1.0, 0.0, 0.5, 1.0, 2.0]) for _ in range(size)]

    def roles(names):
        return draw.sample(names, draw.randint(0, 3))

    docs = [(i, draw.choice("ab"), roles("xyzw"), vector()) for i in range(documents)]
    asked = [(f"q{i}", draw.choice("abc"), roles("xyzv"), vector()) for i in range(queries)]
    docs += [(9001, None, ["x"], vector()), (9002, "a", None, vector()), (9003, "a", ["x", None], None), (9004, "a", ["x"], [1.0]),
             (9005, "a", ["x", "x"], [None] * size), (9006, "a", ["x"], []), (None, "a", ["x"], vector())]
    asked += [("none", None, ["x"], vector()), ("roleless", "a", None, vector()), ("zero", "a", ["x"], [0.0] * size),
              ("short", "a", ["x"], [1.0]), ("null", "a", ["x"], None)]
    return docs, asked


def same(got, want):
    """Keys in order, similarities but for what rounding makes of them."""
    assert got.keys() == want.keys()
    for q, found in got.items():
        assert [k for k, _ in found] == [k for k, _ in want[q]], q
        assert [s is None for _, s in found] == [s is None for _, s in want[q]]
        assert [s or 0 for _, s in found] == pytest.approx([s or 0 for _, s in want[q]], abs=1e-8)


def brute(docs, asked, k):
    found = {}
    for name, tenant, roles, vector in asked:
        own = []
        for key, other, allowed, embedding in docs:
            if tenant is None or other != tenant or not set(roles or ()) & (set(allowed or ()) - {None}):
                continue
            similarity = None
            if vector and embedding and len(vector) == len(embedding) and None not in embedding:
                norm = math.hypot(*vector) * math.hypot(*embedding)
                similarity = round(sum(a * b for a, b in zip(vector, embedding)) / norm, 9) if norm else None
            own.append((similarity is None, -(similarity or 0), key is None, key or 0, key, similarity))
        found[name] = [(key, s) for *_, key, s in sorted(own)[:k]]
    return found


@pytest.mark.parametrize("k, block, documents", [(5, 4096, 1024), (3, 7, 16), (400, 10, 50)])
def test_equal_to_brute_force(spark, monkeypatch, k, block, documents):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
    monkeypatch.setattr(retrieval, "DOCUMENT_BLOCK", documents)
    docs, asked = rows(300, 40)
    table = spark.createDataFrame(docs, DOCUMENTS).repartition(5)
    queries = spark.createDataFrame(asked, QUERIES)
    got = {}
    for r in secure_retrieve_all(table, queries, k).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, None if r.similarity is None else round(r.similarity, 9)))
        assert r.place == len(got[r.query_id]) - 1
    want = brute(docs, asked, k)
    same(got, {q: v for q, v in want.items() if v})
    counts = {r.query_id: r.source_count for r in source_counts(secure_retrieve_all(table, queries, k), queries).collect()}
    assert counts == {q: len(v) for q, v in want.items()}


def test_a_thousand_queries_without_shuffling_documents(spark):
    docs, asked = rows(2000, 1000, seed=3, size=8)
    docs, asked = docs[:2000], asked[:1000]
    table, queries = spark.createDataFrame(docs, DOCUMENTS), spark.createDataFrame(asked, QUERIES)
    found = secure_retrieve_all(table, queries, 5)
    got = {}
    for r in found.orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, None if r.similarity is None else round(r.similarity, 9)))
    same(got, {q: v for q, v in brute(docs, asked, 5).items() if v})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    # what is shuffled is what tasks keep of each query, not documents
    assert "embedding" not in plan[: plan.index("MapInArrow")]


def test_one_query_is_as_before(spark):
    docs, asked = rows(200, 1, seed=5)
    asked = [("q", "a", ["x", "z"], [0.25, -1.0, 0.5, 2.0, 0.0, 1.0])]
    table = spark.createDataFrame(docs[:200], DOCUMENTS)
    one = secure_retrieve(table, F.lit(asked[0][3]), "a", ["x", "z"], 10).collect()
    many = secure_retrieve_all(table, spark.createDataFrame(asked, QUERIES), 10).orderBy("place").collect()
    assert [round(r.similarity, 9) for r in one if r.similarity] == [round(r.similarity, 9) for r in many if r.similarity]


def test_empty_tables(spark):
    docs, asked = rows(10, 3)
    table, queries = spark.createDataFrame(docs, DOCUMENTS), spark.createDataFrame(asked, QUERIES)
    assert secure_retrieve_all(table.where("false"), queries).collect() == []
    assert secure_retrieve_all(table, queries.where("false")).collect() == []
