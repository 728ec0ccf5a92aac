"""A training-data pipeline: five operators in a row, each over what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpus_guard.llm import decontaminate, jaccard, language, mixing, quality
from corpus_guard.llm.shared import removed, stored, table

STAGES = [
    ("quality classifier", quality.keep),
    ("language ID", language.keep),
    ("n-gram Jaccard join", jaccard.keep),
    ("benchmark decontamination", decontaminate.keep),
    ("mixing sources to target weights", mixing.stage),
]

#: The classifiers cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read as the next one's.

    A stage's table is removed when the next one's is there.
    """
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs, path = stored(stage(spark, docs, sf_dir))
        if last:
            removed(spark, last)
        last = path
    return docs
