"""The declarative rules table: reading, validating, listing."""

from __future__ import annotations

import json
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_guard.catalogue.model import Rule
from corpus_guard.catalogue.names import SEVERITY_RANK
from corpus_guard.functions.dialect import compiles
from corpus_guard.functions.required import is_required

RULES_DIR = Path(__file__).parent.parent / "catalogue" / "declarative"
RULE_SCHEMA = (
    "id string, name string, category string, severity string, language string, "
    "description string, description_pt string, pattern string, pattern_type string, "
    "recommendation string, recommendation_pt string, fix_example string, owasp_id string, "
    "owasp_name string, confidence double, enabled boolean, tags array<string>, "
    "references array<string>, needs array<array<string>>"
)
REQUIRED = ("id", "name", "category", "severity")
OWASP_SITE = "https://owasp.org/www-project-top-10-for-large-language-model-applications/"


def read_rules(spark: SparkSession, directory: str = str(RULES_DIR)) -> DataFrame:
    """Enabled, valid rules of all JSON-lines files below a directory, in file-name order.

    Lines that do not parse and rules that lack a required field are dropped.
    """
    rows = (
        spark.read.schema(RULE_SCHEMA)
        .option("mode", "DROPMALFORMED")
        .option("pathGlobFilter", "*.json")
        .json(directory)
        .select("*", F.col("_metadata.file_name").alias("file"))
        .withColumn("at", F.monotonically_increasing_id())
    )
    valid = F.coalesce(F.col("enabled"), F.lit(True))
    for name in REQUIRED:
        valid &= F.col(name).isNotNull()
    valid &= F.col("severity").isin(*SEVERITY_RANK)
    valid &= F.coalesce(F.col("confidence"), F.lit(0.8)).between(0, 1)
    return rows.where(valid)


def collect_rules(rules: DataFrame) -> list[Rule]:
    """The rules of a table for a scan; pattern types other than regex are not run.

    Every rule is a literal in the scan's expression: a rules table is configuration, read whole.
    """
    rows = rules.orderBy("file", "at").collect()
    return [r for row in rows if (r := rule_of(row.asDict(recursive=True))) is not None]


def shipped_rules() -> list[Rule]:
    """The declarative rules that come with the package."""
    rows = [
        json.loads(line)
        for file in sorted(RULES_DIR.glob("*.json"))
        for line in file.read_text(encoding="utf-8").splitlines()
    ]
    return [r for row in rows if (r := rule_of(row)) is not None]


def rule_of(row: dict) -> Rule | None:
    """The rule of a table's row, or None if its pattern does not run.

    Required strings that the pattern does not imply would silence it: they are left out
    (``rule_problems`` lists them).
    """
    pattern = row.get("pattern") or ""
    if (row.get("pattern_type") or "regex") != "regex" or not compiles(pattern):
        return None
    owasp_id = row.get("owasp_id")
    return Rule(
        rule_id=row["id"],
        title=row["name"],
        category=row["category"],
        severity=row["severity"],
        pattern=pattern,
        description=row.get("description") or "",
        description_pt=row.get("description_pt") or "",
        recommendation=row.get("recommendation") or "",
        recommendation_pt=row.get("recommendation_pt") or "",
        fix_example=row.get("fix_example") or "",
        confidence=0.8 if row.get("confidence") is None else row["confidence"],
        owasp_id=owasp_id,
        owasp_name=(row.get("owasp_name") or "") if owasp_id else None,
        owasp_url=f"{OWASP_SITE}#{owasp_id.lower()}" if owasp_id else None,
        tags=tuple(row.get("tags") or ()),
        references=tuple(row.get("references") or ()),
        languages=(row["language"],) if row.get("language") else (),
        # required strings are searched in folded text
        needs=tuple(
            tuple(w.lower() for w in group) for group in row.get("needs") or () if is_required(tuple(group), pattern)
        ),
        before=1,
        after=1,
        column=True,
    )


def rule_problems(rules: DataFrame) -> DataFrame:
    """(id, problem) of what is wrong with the rules of a table; a rule may have several problems.

    A pattern of another type than regex or that does not compile is not run. Required strings that
    a match need not hold are not used.
    """

    def problems(frames):
        for frame in frames:
            rows = []
            for row in frame.to_dict("records"):
                pattern = row["pattern"] or ""
                if (row["pattern_type"] or "regex") != "regex":
                    rows.append((row["id"], "pattern type is not run"))
                elif not compiles(pattern):
                    rows.append((row["id"], "pattern does not compile"))
                else:
                    for group in [] if row["needs"] is None else row["needs"]:
                        if not is_required(tuple(group), pattern):
                            rows.append((row["id"], "needs is not implied: " + ", ".join(group)))
            yield pd.DataFrame(rows, columns=["id", "problem"])

    return rules.select("id", "pattern", "pattern_type", "needs").mapInPandas(problems, "id string, problem string")


def rules_of_category(rules: DataFrame, category: str) -> DataFrame:
    return rules.where(F.col("category") == category)


def rule_by_id(rules: DataFrame, rule_id: str) -> DataFrame:
    """The first rule with an id, or no row."""
    return rules.where(F.col("id") == rule_id).orderBy("file", "at").limit(1)


def rule_listing(rules: DataFrame, category: str | None = None) -> DataFrame:
    """Rules by id for display; a rule without a language applies to any."""
    shown = rules if category is None else rules_of_category(rules, category)
    language = F.coalesce("language", F.lit("any")).alias("language")
    return shown.select("id", "name", "category", "severity", language).orderBy("id")


def rules_as_json(rules: DataFrame) -> DataFrame:
    """One JSON object per rule."""
    fields = [c for c in rules.columns if c not in ("file", "at", "needs")]
    return rules.select(F.to_json(F.struct(*fields)).alias("json"))
