"""Results that several reports read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def stored(result: DataFrame, folder: str | None = None) -> DataFrame:
    """The result as a table written once, so that reports on it do not repeat the scan.

    ``folder`` is a place that all executors share, by default what spark.checkpoint.dir names.
    Without either the result is not stored, and every report repeats the scan. The caller owns the
    folder and what is written there.
    """
    spark = result.sparkSession
    folder = folder or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return result
    path = f"{folder}/findings-{uuid.uuid4().hex}"
    result.write.parquet(path)
    return spark.read.schema(result.schema).parquet(path)


def kept(result: DataFrame) -> DataFrame:
    """The result for several readers that must see the same rows in the same parts.

    It is written where a shared folder is known, and persisted otherwise.
    """
    table = stored(result)
    return result.persist() if table is result else table
