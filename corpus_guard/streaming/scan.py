"""The built-in scan on a stream of units.

Matching, filters, snippets and the first-per-line rule work inside a row, so the batch functions
run on a stream as they are, without state. Only the hourly counts keep state, bounded by the
watermark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_guard.operators.findings import BRIEF
from corpus_guard.operators.matching import KEY
from corpus_guard.plans.scan import ScanConfig, scan


def scan_stream(
    units: DataFrame,
    config: ScanConfig = ScanConfig(),
    event_time: str = "ts",
    columns: Sequence[str] = BRIEF,
) -> DataFrame:
    """Findings of arriving units, with the unit's event time."""
    return scan(units, config, columns=columns, keep=[*KEY, event_time])


def severity_per_hour(
    findings: DataFrame, event_time: str = "ts", lateness: str = "1 hour"
) -> DataFrame:
    """Findings per hour and severity."""
    return (
        findings.withWatermark(event_time, lateness)
        .groupBy(F.window(event_time, "1 hour"), "severity")
        .agg(F.count("*").alias("findings"))
        .select(F.col("window.start").alias("hour"), "severity", "findings")
    )
