"""The findings table: rule metadata, severity, de-duplication and order."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpus_guard.catalogue.model import Rule
from corpus_guard.catalogue.names import SEVERITY_RANK, TOOL_SEVERITY
from corpus_guard.plans.stage import kept

UNIT_KEY = ("unit_id", "path")
DISCOVERY_ORDER = ("path", "unit_id", "rule_no", "offset")
#: ``pattern_no``: place of the pattern among those of its rule id, which other rules do not change.
BRIEF = ("rule_id", "pattern_no", "severity", "category", "confidence", "detected_by")
DETAIL = (
    *BRIEF,
    "title",
    "owasp",
    "description",
    "description_pt",
    "recommendation",
    "recommendation_pt",
    "fix_example",
    "references",
    "tags",
)

_RULES_SCHEMA = pa.schema(
    [
        ("rule_no", pa.int32()),
        ("rule_id", pa.string()),
        ("pattern_no", pa.int32()),
        ("title", pa.string()),
        ("severity", pa.string()),
        ("category", pa.string()),
        (
            "owasp",
            pa.struct([("id", pa.string()), ("name", pa.string()), ("url", pa.string())]),
        ),
        ("description", pa.string()),
        ("description_pt", pa.string()),
        ("recommendation", pa.string()),
        ("recommendation_pt", pa.string()),
        ("fix_example", pa.string()),
        ("confidence", pa.float64()),
        ("references", pa.list_(pa.string())),
        ("tags", pa.list_(pa.string())),
        ("detected_by", pa.string()),
        ("languages", pa.list_(pa.string())),
        ("pattern", pa.string()),
        ("kind", pa.string()),
    ]
)


def severity_rank(severity: Column | str = "severity") -> Column:
    """4 for critical down to 0 for info and for unknown words."""
    column = F.col(severity) if isinstance(severity, str) else severity
    rank = F.lit(0)
    for name, value in SEVERITY_RANK.items():
        rank = F.when(column == name, value).otherwise(rank)
    return rank


def rules_frame(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """The rules as a table, one row per pattern, numbered in discovery order."""
    before: Counter[str] = Counter()
    pattern_nos: list[int] = []
    for rule in rules:
        pattern_nos.append(before[rule.rule_id])
        before[rule.rule_id] += 1
    rows = [
        {
            **{name: getattr(rule, name) for name in _RULES_SCHEMA.names if hasattr(rule, name)},
            "rule_no": number,
            "pattern_no": pattern_nos[number],
            "owasp": rule.owasp_id
            and {"id": rule.owasp_id, "name": rule.owasp_name or "", "url": rule.owasp_url or ""},
        }
        for number, rule in enumerate(rules)
    ]
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=_RULES_SCHEMA))


def attach_rules(
    matches: DataFrame, rules: Sequence[Rule], columns: Sequence[str] = DETAIL
) -> DataFrame:
    """Findings: matches joined with their rule's metadata.

    The rules side is the catalogue this call got, a few hundred rows held by the driver already,
    so it is broadcast. Steps that only count or join should ask for ``BRIEF`` and leave the
    long texts to the final report.
    """
    rules_side = rules_frame(matches.sparkSession, rules).select("rule_no", *columns)
    findings = matches.join(F.broadcast(rules_side), "rule_no")
    if "tool" not in matches.columns:
        return findings
    filled: dict[str, Column] = {}
    found = F.col("tool").isNotNull()
    tool = F.coalesce("tool", F.lit(""))
    if "severity" in columns:
        severity = F.lit("medium")
        for name, value in TOOL_SEVERITY.items():
            severity = F.when(F.col("tool") == name, value).otherwise(severity)
        filled["severity"] = F.when(found, severity).otherwise(F.col("severity"))
    for name in ("title", "description", "description_pt"):
        if name in columns:
            text = F.replace(F.col(name), F.lit("{tool}"), tool)
            filled[name] = F.when(found, text).otherwise(F.col(name))
    if "tags" in columns:
        tags = F.transform("tags", lambda t: F.replace(t, F.lit("{tool}"), F.lower(tool)))
        filled["tags"] = F.when(found, tags).otherwise(F.col("tags"))
    return findings.withColumns(filled)


def at_or_above(findings: DataFrame, severity: str) -> DataFrame:
    """Findings of a minimum severity; an unknown word keeps everything."""
    return findings.where(severity_rank() >= SEVERITY_RANK.get(severity, 0))


def first_findings(findings: DataFrame, unit: Sequence[str] = UNIT_KEY) -> DataFrame:
    """One finding per (unit, line, rule id): the first in discovery order."""
    return first_of(findings, [*unit, "line", "rule_id"], ("rule_no", "offset"))


def first_of(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first by ``order``.

    The rank has a limit, which Spark applies before the shuffle too: of a hot key one row per task
    is moved, and only ``order`` is compared, not the rest of the row.
    """
    first = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__rank", F.row_number().over(first)).where("__rank = 1").drop("__rank")


def in_report_order(findings: DataFrame) -> DataFrame:
    """Most severe first, then by path, line and discovery.

    A global sort samples its input before it sorts it: pass stored findings, not a scan.
    """
    return findings.orderBy(
        severity_rank().desc(), "path", "line", "unit_id", "rule_no", "offset"
    )


def in_severity_order(findings: DataFrame) -> DataFrame:
    """Most severe first, otherwise in discovery order; pass stored findings here too."""
    return findings.orderBy(severity_rank().desc(), *DISCOVERY_ORDER)


def top_findings(findings: DataFrame, n: int = 50) -> DataFrame:
    """The first ``n`` findings of the report (a top-k, not a full sort)."""
    return in_report_order(findings).limit(n)


def localized(findings: DataFrame, language: str = "en-US") -> DataFrame:
    """Description and recommendation in the report language where a translation exists."""
    if language != "pt-BR":
        return findings
    return findings.withColumns(
        {
            name: F.when(F.length(f"{name}_pt") > 0, F.col(f"{name}_pt")).otherwise(F.col(name))
            for name in ("description", "recommendation")
        }
    )


def non_negative(position: str) -> Column:
    """A line or column read from elsewhere: missing and negative values count as 0."""
    return F.greatest(F.lit(0), F.coalesce(F.col(position).cast("int"), F.lit(0)))


def placed(ordered: DataFrame, name: str = "place") -> DataFrame:
    """The rows of a sorted frame with their place in it, from 0, in a column of that name.

    A row's place is that in its part of the sort plus the rows of all parts before: one row a part
    is gathered, and parts may be empty. ``monotonically_increasing_id`` has the part's number above
    33 bits of the row's. The numbered rows are read twice and kept for that, as sorting them again
    may cut them elsewhere.
    """
    rows = ordered.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33))
    rows = kept(rows)
    sizes = rows.groupBy("__part").agg((F.max("__at") - F.min("__at") + 1).alias("__n"), F.min("__at").alias("__first"))
    before = F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")
    starts = sizes.select("__part", "__first", before.alias("__before"))
    place = F.col("__at") - F.col("__first") + F.col("__before")
    return rows.join(F.broadcast(starts), "__part").select(*ordered.columns, place.alias(name))
