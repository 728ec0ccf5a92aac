"""Units from tables: any rows with a key and a text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def units_from_table(
    table: DataFrame,
    key: str | Sequence[str],
    text: str,
    path: str | None = None,
    language: str | Column = "python",
) -> DataFrame:
    """Rows as units. The key must identify a row; ``path`` defaults to it and need not.

    ``language`` is a language name or a column; rules only run on units of their languages.
    """
    keys = [key] if isinstance(key, str) else list(key)
    unit_id = F.concat_ws(":", *[F.col(k).cast("string") for k in keys])
    return table.select(
        unit_id.alias("unit_id"),
        (F.col(path) if path else unit_id).alias("path"),
        (F.lit(language) if isinstance(language, str) else language).alias("language"),
        F.col(text).alias("text"),
        F.octet_length(text).cast("long").alias("size_bytes"),
    )


def distinct_units(units: DataFrame) -> DataFrame:
    """One unit per path: that of smallest unit_id, then of smallest text hash.

    The survivor is chosen on keys and hashes alone, so whole texts are only moved for the join.
    """
    order = F.struct("unit_id", F.xxhash64("text").alias("hash"))
    first = units.groupBy("path").agg(F.min(order).alias("first"))
    first = first.select("path", "first.unit_id", F.col("first.hash").alias("__hash"))
    marked = units.withColumn("__hash", F.xxhash64("text"))
    kept = marked.join(first, ["path", "unit_id", "__hash"], "left_semi")
    return kept.drop("__hash").dropDuplicates(["path"])
