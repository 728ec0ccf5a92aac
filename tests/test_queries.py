"""The registry: every query has a stable name, and the driver's contract holds."""

import pytest

import __spark_entry__ as entry_point
from corpus_guard.plans.stage import stored
from queries import registry


def test_contract():
    queries, sqls = registry.queries(), registry.oracle_sql()
    assert set(queries) <= set(entry_point.queries()) and set(sqls) <= set(entry_point.oracle_sql())
    assert set(sqls) <= set(queries) and len(queries) > 70
    assert set(queries) == set(sqls)


def test_stored_below_the_named_folder(spark, tmp_path):
    kept = stored(spark.range(5))
    assert kept.count() == 5
    assert spark.conf.get("spark.checkpoint.dir") in kept.inputFiles()[0]
    assert str(tmp_path) in stored(spark.range(5), str(tmp_path)).inputFiles()[0]


@pytest.mark.parametrize("name", ["scan_documents", "scan_python", "scan_pages", "scan_chat"])
def test_scan_needs_no_shuffle(spark, name):
    """Without verdicts a scan is one stage: no exchange but the broadcast of the rules."""
    frame = registry.queries()[name](spark, "/root/testdata/sf0.001")
    plan = frame._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert "BroadcastExchange" in physical
    assert "Exchange hashpartitioning" not in physical
    assert "Exchange RoundRobinPartitioning" not in physical
    assert "EvalPython" not in physical
