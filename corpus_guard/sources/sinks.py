"""JSON reports: one line per finding and a one-line summary, written by the tasks."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_guard.operators.findings import in_report_order, in_severity_order
from corpus_guard.operators.summary import scan_summary
from corpus_guard.plans.stage import stored

# Columns that place a finding in the engine but are not part of a report.
_INTERNAL = ("rule_no", "offset", "tool", "unit_id")
META = {"tool": "corpus-guard", "version": "0.1.0", "owasp_version": "LLM Top 10 2025"}
STANDALONE_FIELDS = (
    "rule_id",
    "title",
    "severity",
    "category",
    "owasp_id",
    "file",
    "line",
    "description",
    "recommendation",
    "confidence",
    "code_snippet",
)


def report_rows(findings: DataFrame) -> DataFrame:
    """Findings with the report's column names, most severe first."""
    rows = in_report_order(findings).withColumnRenamed("path", "file_path")
    rows = rows.withColumn("false_positive_likelihood", F.lit(0.1))
    return rows.select(*[c for c in rows.columns if c not in _INTERNAL])


def standalone_report_rows(findings: DataFrame) -> DataFrame:
    """The standalone report: flat rows, sorted by severity only."""
    flat = in_severity_order(findings).select(
        "*", F.col("owasp.id").alias("owasp_id"), F.col("path").alias("file")
    )
    return flat.select(*STANDALONE_FIELDS)


def as_json(findings: DataFrame) -> DataFrame:
    """Each finding as one JSON object with all its fields; an absent value is null."""
    return findings.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def write_report(
    findings: DataFrame,
    units: DataFrame,
    directory: str,
    rows: Callable[[DataFrame], DataFrame] = report_rows,
    **meta: str,
) -> None:
    """Write ``findings`` (JSON lines in order) and ``summary`` (one line) below a directory.

    ``scanned_at`` (ISO 8601) and ``scanned_at_label`` are part of the summary; by default the time
    of the call. A global sort reads its input twice and the summary once more, so the findings are
    stored first where there is a shared folder, and the scan runs once.
    """
    kept = stored(findings)
    at = meta.get("scanned_at") or datetime.now(timezone.utc).isoformat(timespec="seconds")
    meta = {**META, **meta, "scanned_at": at}
    rows(kept).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{directory}/findings")
    summary = summary_row(kept, units, meta)
    summary.coalesce(1).write.mode("overwrite").json(f"{directory}/summary")


def summary_row(findings: DataFrame, units: DataFrame, meta: dict[str, str]) -> DataFrame:
    """The summary of a report; ``scanned_at`` gets a label next to it."""
    row = scan_summary(findings, units, meta)
    label = timestamp_label(F.to_timestamp("scanned_at")).alias("scanned_at_label")
    return row.select("*", label) if "scanned_at" in meta else row


def percent(confidence: Column) -> Column:
    """A confidence as a whole percentage."""
    return F.concat(F.bround(confidence * 100, 0).cast("int").cast("string"), F.lit("%"))


def timestamp_label(at: Column) -> Column:
    """A scan time as shown in reports (session time zone UTC)."""
    return F.date_format(at, "yyyy-MM-dd HH:mm 'UTC'")


def recommendation_excerpt(recommendation: Column) -> Column:
    """What the terminal list shows of a recommendation."""
    return F.substring(recommendation, 1, 200)
