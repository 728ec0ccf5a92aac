"""The two scans: built-in rules (with severity filter and verdicts) and standalone rules."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_guard.catalogue import Rule, package_rules, standalone_rules
from corpus_guard.catalogue.names import SUPPORTED_LANGUAGES
from corpus_guard.operators.concat import concat_array
from corpus_guard.operators.findings import (
    BRIEF,
    DETAIL,
    at_or_above,
    attach_rules,
    first_findings,
    localized,
)
from corpus_guard.operators.judge import apply_verdicts
from corpus_guard.operators.matching import KEY, at_least, findings_array
from corpus_guard.operators.summary import severity_gate
from corpus_guard.sources.rules import shipped_rules


@dataclass(frozen=True)
class ScanConfig:
    """Parameters of a scan."""

    min_severity: str = "low"
    # ``failed`` says whether a finding of this severity or above is there
    fail_on: str | None = None
    # descriptions and recommendations are in this language where there is a translation
    report_language: str = "en-US"
    languages: tuple[str, ...] = SUPPORTED_LANGUAGES
    detectors: tuple[Detector, ...] = ()


@dataclass(frozen=True)
class Detector:
    """A detector of the caller's own: from units of its languages to findings.

    ``find`` gets units (unit_id, path, language, text) and returns findings with the key columns
    of the scan and ``fields``; what it leaves out is null. Its findings follow the built-in ones.
    """

    name: str
    find: Callable[[DataFrame], DataFrame]
    languages: tuple[str, ...] = SUPPORTED_LANGUAGES


def scan(
    units: DataFrame,
    config: ScanConfig = ScanConfig(),
    declarative: Sequence[Rule] | None = None,
    verdicts: DataFrame | None = None,
    columns: Sequence[str] = DETAIL,
    keep: Sequence[str] = KEY,
) -> DataFrame:
    """Findings of the built-in rules, one per (unit, line, rule id).

    Units are one row each (``sources``), so without verdicts the de-duplication happens inside
    the row and the whole scan runs without a shuffle. With verdicts this is ``settle`` over
    ``candidates``; call those two to ask for verdicts in between without scanning twice.
    """
    wanted = _both(columns, config)
    if verdicts is not None:
        found = candidates(units, config, declarative, keep)
        found = settle(found, verdicts, declarative, wanted, keep)
    else:
        rules = _rules(declarative)
        found = attach_rules(_matches(units, rules, config, True, keep), rules, wanted)
    found = _localized(found, columns, config)
    return _with_own(found, units, config, keep)


def _with_own(found: DataFrame, units: DataFrame, config: ScanConfig, keep: Sequence[str]) -> DataFrame:
    """The findings, and those of the caller's detectors at the minimum severity, once each."""
    for number, detector in enumerate(config.detectors):
        own = detector.find(units.where(F.col("language").isin(*detector.languages)))
        own = own.withColumn("detected_by", F.lit(detector.name))
        own = own.withColumn("rule_no", F.lit(OWN_RULES + number))
        missing = [c for c in found.columns if c not in own.columns]
        own = own.withColumns({c: F.lit(None).cast(found.schema[c].dataType) for c in missing})
        own = own.withColumn("offset", F.coalesce("offset", F.lit(0)))
        own = first_findings(at_or_above(own.select(*found.columns), config.min_severity), keep)
        found = found.unionByName(own)
    return found


#: Numbers of the caller's detectors start here, behind those of all rules.
OWN_RULES = 1_000_000


def failed(findings: DataFrame, config: ScanConfig) -> DataFrame:
    """One row, ``failed``: whether the findings reach ``config.fail_on``; without it, never."""
    return severity_gate(findings, config.fail_on) if config.fail_on else findings.agg(
        F.lit(False).alias("failed")
    )


_TRANSLATED = ("description", "recommendation")


def _both(columns: Sequence[str], config: ScanConfig) -> Sequence[str]:
    """``columns`` and the translations that the report language asks for."""
    if config.report_language == "en-US":
        return columns
    extra = [f"{c}_pt" for c in _TRANSLATED if c in columns and f"{c}_pt" not in columns]
    return [*columns, *extra]


def _localized(found: DataFrame, columns: Sequence[str], config: ScanConfig) -> DataFrame:
    if config.report_language == "en-US" or not set(_TRANSLATED) <= set(columns):
        return found
    extra = [f"{c}_pt" for c in _TRANSLATED if f"{c}_pt" not in columns]
    return localized(found, config.report_language).drop(*extra)


def candidates(
    units: DataFrame,
    config: ScanConfig = ScanConfig(),
    declarative: Sequence[Rule] | None = None,
    keep: Sequence[str] = KEY,
) -> DataFrame:
    """Every finding from the minimum severity up, before verdicts and de-duplication."""
    rules = _rules(declarative)
    return attach_rules(_matches(units, rules, config, False, keep), rules, BRIEF)


def settle(
    found: DataFrame,
    verdicts: DataFrame,
    declarative: Sequence[Rule] | None = None,
    columns: Sequence[str] = DETAIL,
    keep: Sequence[str] = KEY,
) -> DataFrame:
    """Candidates after their verdicts, one per (unit, line, rule id).

    The long texts join the findings that are left, not those that are shuffled.
    """
    first = first_findings(apply_verdicts(found, verdicts), keep)
    return attach_rules(first, _rules(declarative), [c for c in columns if c not in BRIEF])


def _rules(declarative: Sequence[Rule] | None) -> list[Rule]:
    return package_rules(shipped_rules() if declarative is None else declarative)


def scan_standalone(
    units: DataFrame,
    columns: Sequence[str] = DETAIL,
    keep: Sequence[str] = KEY,
) -> DataFrame:
    """Findings of the standalone rules; there is no severity filter and no verdict here."""
    rules = standalone_rules()
    config = ScanConfig("info", languages=("python", "typescript"))
    literals = ("string", "constant")
    matches = _matches(units, rules, config, True, keep, attributes=False, literals=literals)
    return attach_rules(matches, rules, columns)


def _matches(
    units: DataFrame,
    rules: Sequence[Rule],
    config: ScanConfig,
    first_only: bool,
    keep: Sequence[str],
    **options,
) -> DataFrame:
    """Regex matches and concatenations in one pass; their rule ids differ, so they never clash."""
    units = units.where(F.col("language").isin(*config.languages))
    found = findings_array(rules, config.min_severity, first_only)
    reported = at_least(rules, config.min_severity)
    for number, rule in enumerate(rules):
        if rule.kind == "concat" and rule in reported:
            concatenated = concat_array(number, rule, **options)
            found = f"concat(coalesce({found}, array()), coalesce({concatenated}, array()))"
    return units.select(*keep, F.inline(F.expr(found))).drop("rule_group")
