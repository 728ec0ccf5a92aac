"""Verdicts on findings as a batch job: requests out, responses in as a table.

A finding is identified by (unit_id, rule_id, pattern_no, line, offset), so stored verdicts stay right
when rules are added; a concatenation has no offset of its own and is one finding per line. Which model answers is not this engine's
business: ``judge_requests`` yields the prompts, ``parse_verdicts`` reads the answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_guard.catalogue.names import EMPTY_SNIPPET, JUDGE_PROMPT
from corpus_guard.operators.findings import first_of, severity_rank

FINDING_KEY = ("unit_id", "rule_id", "pattern_no", "line", "offset")
MIN_JUDGED_RANK = 2
DROP_CONFIDENCE = 0.8


def judge_requests(findings: DataFrame) -> DataFrame:
    """The prompt for every finding of medium severity or above; others are not judged."""
    fields = {
        "{rule_id}": F.col("rule_id"),
        "{title}": F.col("title"),
        "{severity}": F.col("severity"),
        "{code_snippet}": F.when(F.col("code_snippet") == "", EMPTY_SNIPPET).otherwise(
            F.col("code_snippet")
        ),
        "{description}": F.col("description"),
    }
    # fill the slots in one pass, so that a value holding a slot's name is left alone
    parts: list[Column] = []
    rest = JUDGE_PROMPT
    for slot, value in fields.items():
        before, _, rest = rest.partition(slot)
        parts += [F.lit(before), F.coalesce(value, F.lit(""))]
    prompt = F.concat(*parts, F.lit(rest)).alias("prompt")
    return findings.where(severity_rank() >= MIN_JUDGED_RANK).select(*FINDING_KEY, prompt)


def parse_verdicts(responses: DataFrame, response: str = "response") -> DataFrame:
    """(key, verdict, verdict_confidence) from JSON answers; unusable answers are left out.

    An answer needs both keys, ``verdict`` and ``confidence``; a verdict that is JSON null is no
    false positive. A confidence that is not a number makes only its own answer unusable, where the
    scanner this follows gives up on the whole batch.
    """
    answer = F.trim(response)
    parsed = F.from_json(answer, "verdict string, confidence double, reasoning string")
    keyed = F.coalesce(F.array_contains(F.json_object_keys(answer), "verdict"), F.lit(False))
    parsed = F.when(keyed, parsed)
    return (
        responses.select(*FINDING_KEY, parsed.alias("answer"))
        .select(
            *FINDING_KEY,
            F.when(F.col("answer").isNotNull(), F.coalesce("answer.verdict", F.lit("null"))).alias("verdict"),
            F.col("answer.confidence").alias("verdict_confidence"),
        )
        .where(F.col("verdict").isNotNull() & F.col("verdict_confidence").isNotNull())
        .where(~F.isnan("verdict_confidence"))
    )


def apply_verdicts(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Findings after judgement: sure false positives go, other verdicts set the confidence.

    Findings below medium and those without a verdict pass unchanged. The join is on the finding
    key, which no single unit or rule dominates; a verdict that is repeated counts once.
    """
    judged = first_of(verdicts, FINDING_KEY, ("verdict", "verdict_confidence"))
    applies = (severity_rank() >= MIN_JUDGED_RANK) & F.col("verdict").isNotNull()
    sure = (F.col("verdict") == "false_positive") & (
        F.col("verdict_confidence") >= DROP_CONFIDENCE
    )
    confidence = F.least(
        F.lit(0.99), F.col("confidence") * (0.5 + F.col("verdict_confidence") * 0.5)
    )
    return (
        findings.join(judged, list(FINDING_KEY), "left")
        .where(~F.coalesce(applies & sure, F.lit(False)))
        .withColumns(
            {
                "confidence": F.when(applies, confidence).otherwise(F.col("confidence")),
                "detected_by": F.when(
                    applies, F.concat("detected_by", F.lit("+llm_judge"))
                ).otherwise(F.col("detected_by")),
            }
        )
        .select(*findings.columns)
    )
