"""Each stage's decisions against the reports of its operator, over the smallest given tables."""

import pytest

import corpus_pipeline
from corpus_guard.llm import decontaminate, jaccard, language, quality
from corpus_guard.llm.shared import table

SF = "/root/testdata/sf0.001"


def ids(frame):
    return sorted((r.doc_id for r in frame.collect()), key=lambda x: (x is None, x))


@pytest.fixture(scope="module")
def docs(spark):
    """The documents with odd rows behind them."""
    given = table(spark, SF, "documents")
    odd = [(9001, None, "en", None, None), (9002, "", None, "src0", 0), (None, "the and of " * 40, "en", "src0", 1)]
    return given.unionAll(spark.createDataFrame(odd, given.schema))


def test_stages_take_effect(spark, docs):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == [
        "quality classifier",
        "language ID",
        "n-gram Jaccard join",
        "benchmark decontamination",
        "mixing sources to target weights",
    ]
    first = stages["quality classifier"](spark, docs, SF)
    assert first.columns == docs.columns
    model = quality.fit(docs, table(spark, SF, "labels"))
    assert ids(first) == ids(quality.quality(docs, model).where("predicted = 1"))

    second = stages["language ID"](spark, docs, SF)
    named = language.identify(docs, language.fit(docs))
    assert ids(second) == ids(named.where("lang_pred <> 'und'"))
    assert second.columns == docs.columns and not {9001, 9002} & set(ids(second))

    third = stages["n-gram Jaccard join"](spark, docs, SF)
    groups = jaccard.classes(docs).collect()
    empty = [r.doc_id for r in groups if not r.n_shingles]
    kept = {r.component_id for r in groups if r.n_shingles}
    assert third.count() == len(kept) + len(empty) and third.columns == docs.columns
    assert kept - {None} <= set(ids(third)) and {9001, 9002} <= set(ids(third))

    fourth = stages["benchmark decontamination"](spark, docs, SF)
    found = set(ids(decontaminate.contaminated(docs, table(spark, SF, "benchmark"))))
    assert found and set(ids(fourth)) == set(ids(docs)) - found and fourth.columns == docs.columns

    last = stages["mixing sources to target weights"](spark, docs, SF)
    assert last.columns == [*docs.columns, "copy", "order_key"]


def test_empty_input_passes_all_stages(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), SF).collect() == []


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and len({(r.doc_id, r.copy) for r in rows}) == len(rows)
