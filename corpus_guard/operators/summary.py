"""Counts over findings. All are partial aggregates with few groups, or one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_guard.catalogue.names import CATEGORY_LABELS, SEVERITY_RANK
from corpus_guard.operators.findings import severity_rank

REPORTED = ("critical", "high", "medium", "low")
BAR_LENGTH = 20


def _count_of(severity: str) -> Column:
    return F.count_if(F.col("severity") == severity).alias(severity)


def severity_counts(findings: DataFrame) -> DataFrame:
    """One row: total and the four reported severities."""
    return findings.agg(F.count("*").alias("total"), *[_count_of(s) for s in REPORTED])


def by_severity(findings: DataFrame) -> DataFrame:
    """Count per severity, with a row for each of the five even where nothing was found."""
    every = findings.agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY_RANK]
    )
    pairs = ", ".join(f"'{s}', `{s}`" for s in SEVERITY_RANK)
    return every.selectExpr(f"stack({len(SEVERITY_RANK)}, {pairs}) AS (severity, findings)")


def by_category(findings: DataFrame) -> DataFrame:
    return findings.groupBy("category").agg(F.count("*").alias("findings"))


def by_path(findings: DataFrame) -> DataFrame:
    return findings.groupBy("path").agg(F.count("*").alias("findings"))


def path_severity_table(findings: DataFrame) -> DataFrame:
    """Per path: the four reported severities and the total (which includes info)."""
    return findings.groupBy("path").agg(
        *[_count_of(s) for s in REPORTED], F.count("*").alias("total")
    )


def counts_cube(findings: DataFrame) -> DataFrame:
    """path, severity, category, level and findings: counts by every choice of the three in one pass.

    level is the grouping id: bit 2 is set where path is left out, bit 1 for severity, bit 0 for
    category, and the column is null then. Where severity is asked for without the path, all
    severities have a row: within a category that occurs, and over all. The rows with all three
    are those that hold findings. Values that are null in the findings have rows of their own.
    """
    columns = ("path", "severity", "category")
    # the findings are read once: everything else is told from the counts by all three
    counts = findings.groupBy(*columns).agg(F.count("*").alias("findings"))

    def row(level: int, severity: str = "severity", n: str = "findings") -> str:
        own = {"path": "path", "severity": severity, "category": "category"}
        left_out = {c for bit, c in zip((4, 2, 1), columns) if level & bit}
        shown = [f"'{c}', {'CAST(NULL AS STRING)' if c in left_out else own[c]}" for c in columns]
        return f"named_struct({', '.join(shown)}, 'level', {level}L, 'findings', {n})"

    rows = [row(level) for level in range(8)]
    # known severities, within the category and over all, that may have no finding there
    rows += [row(level, f"'{s}'", "0L") for level in (4, 5) for s in SEVERITY_RANK]
    every = counts.select(F.inline(F.expr(f"array({', '.join(rows)})")))
    return every.groupBy(*columns, "level").agg(F.sum("findings").alias("findings"))


def category_histogram(findings: DataFrame) -> DataFrame:
    """Labelled categories, most findings first."""
    label = F.col("category")
    for category, text in CATEGORY_LABELS.items():
        label = F.when(F.col("category") == category, text).otherwise(label)
    counted = by_category(findings).select("category", label.alias("label"), "findings")
    return counted.orderBy(F.desc("findings"), "category")


def severity_bars(findings: DataFrame) -> DataFrame:
    """Severities that occur, with a bar of at most 20 blocks."""
    return (
        findings.where(F.col("severity").isin(*REPORTED))
        .groupBy("severity")
        .agg(F.count("*").alias("findings"))
        .select(
            "severity",
            "findings",
            F.repeat(F.lit("█"), F.least("findings", F.lit(BAR_LENGTH)).cast("int")).alias("bar"),
        )
        .orderBy(severity_rank().desc())
    )


def worst_severity(findings: DataFrame) -> DataFrame:
    """One row; null without findings."""
    return findings.agg(F.max_by("severity", severity_rank()).alias("worst"))


def severity_gate(findings: DataFrame, severity: str) -> DataFrame:
    """One row: whether any finding reaches a severity; an unknown word means any finding."""
    reached = F.bool_or(severity_rank() >= SEVERITY_RANK.get(severity, 0))
    return findings.agg(F.coalesce(reached, F.lit(False)).alias("failed"))


def severity_sections(findings: DataFrame) -> DataFrame:
    """Findings above info with the size of their severity's section, for a sectioned report.

    The counts are joined back from a five-row aggregate; a window over the section would put a
    third of all findings into one task. Findings are read twice: pass stored ones, not a scan.
    """
    shown = findings.where(severity_rank() > 0)
    sizes = shown.groupBy("severity").agg(F.count("*").alias("section_findings"))
    # at most one row per severity, so the broadcast is bounded
    return shown.join(F.broadcast(sizes), "severity")


def unit_counts(units: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """One row: units scanned, those that could not be read included, and files found.

    ``listed`` are all files found, skipped ones included; for a table each unit is one.
    """
    scanned = units.select(F.lit(1).alias("scanned"), F.lit(1 if listed is None else 0).alias("found"))
    if listed is not None:
        scanned = scanned.unionAll(listed.select(F.lit(0), F.lit(1)))
    return scanned.agg(
        F.coalesce(F.sum("scanned"), F.lit(0)).alias("scanned_files"),
        F.coalesce(F.sum("found"), F.lit(0)).alias("total_files_discovered"),
    )


def scan_summary(findings: DataFrame, units: DataFrame, meta: dict[str, str]) -> DataFrame:
    """One row: caller's meta values, unit count and severity counts.

    Both sides are single rows, so pairing them is no product.
    """
    one = F.lit(1).alias("one")
    scanned = units.agg(F.count("*").alias("scanned_files")).select("*", one)
    counted = severity_counts(findings).select("*", one)
    fixed = [F.lit(value).alias(name) for name, value in meta.items()]
    return scanned.join(F.broadcast(counted), "one").select(
        *fixed, "scanned_files", "total", *REPORTED
    )


def remainder(findings: DataFrame, shown: int = 50) -> DataFrame:
    """One row: how many findings a list of the first ``shown`` leaves out."""
    return findings.agg(
        F.greatest(F.count("*") - F.lit(shown), F.lit(0)).cast("long").alias("not_shown")
    )
