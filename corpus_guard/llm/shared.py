"""Steps that several operators of this package share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: str | Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; a null key counts as the empty text."""
    text = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus


def lottery(key: str) -> Column:
    """A number from 0 to 2 ** 32 - 1 by hash of the key: samples are the rows of smallest number."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 32))


def cutoff(rows: int, wanted: int) -> int:
    """Numbers below this are about twice the rows wanted of ``rows``, or all.

    It leaves few rows to rank, however many tasks there are; a sample stays bounded by its rank.
    """
    return 1 << 32 if rows <= 4 * wanted else ((2 * wanted) << 32) // rows


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; in local mode without it, a folder of this session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not re.match(r"local($|\[)", context.master):
        # a folder of one machine would lose what the others write
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="corpus-guard-"))
    return context.getCheckpointDir()


#: Rows of a batch that Python workers get, instead of Spark's 10,000: rows are whole texts here, and a
#: batch is held several times over, in the JVM and in each worker.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stored(frame: DataFrame) -> tuple[DataFrame, str]:
    """The frame as a table in the shared folder, and the table's path, for ``removed``.

    From the first table on the session's batches are ``BATCH_ROWS`` long, unless it sets its own length.
    """
    spark = frame.sparkSession
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path), path


def written(frame: DataFrame) -> DataFrame:
    """The frame as a table in the shared folder: its lineage ends there, and no executor holds it."""
    return stored(frame)[0]


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table of ``stored`` that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


#: Rows of a few numbers each that a broadcast may hold.
BROADCAST_ROWS = 1_000_000


def checked(frame: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The frame, marked for broadcast if it has at most ``rows`` rows; beyond that it is shuffled."""
    return F.broadcast(frame) if frame.limit(rows + 1).count() <= rows else frame


def row_key(*columns: str) -> Column:
    """A hash that names a row by its contents; nulls differ from all values."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c), F.col(c).isNull())])


#: A column name for such hashes that tables do not have.
ROW = "__row_key"


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key of doc_id and text is not in ``rows`` (ROW), columns as before."""
    found = docs.withColumn(ROW, row_key("doc_id", "text"))
    return found.join(checked(rows.select(ROW).distinct()), ROW, "left_anti").drop(ROW)
