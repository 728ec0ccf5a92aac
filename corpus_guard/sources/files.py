"""Units from source files.

Spark's file sources never list names that start with an underscore, which would lose every
``__init__.py``. So a tree on a file system that all executors mount is walked and read in Python
tasks: they list one level of directories after the other, and the files are spread over tasks again
before their content is read. For object stores, where there is no
mount, ``binary_units`` uses the built-in source and shares its limit on names.
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_guard.catalogue.names import (
    DEFAULT_IGNORE_PATTERNS,
    MAX_FILE_SIZE_BYTES,
    SUPPORTED_LANGUAGES,
)
from corpus_guard.plans.stage import stored
from corpus_guard.sources.ignore import find_ignore_file, ignored, read_ignore_file
from corpus_guard.sources.paths import (
    has_language,
    language_of,
    standalone_language_of,
    standalone_walks,
    within_size,
)

# rows per batch of a listing, and files per batch of content
_ROWS = 10_000
_FILES = 64


def list_files(spark: SparkSession, target: str) -> DataFrame:
    """(path relative to the target, size_bytes) of every file below a directory, or of a file.

    The tree is walked level by level: every directory of a level is a row, and tasks list them.
    A level is stored where the session names a shared folder, so that it is listed once.
    """
    target = os.path.abspath(target)
    if os.path.isfile(target):
        rows = [(os.path.basename(target), os.path.getsize(target))]
        return spark.createDataFrame(rows, "path string, size_bytes long")

    # defined here so that workers get the code by value and need no copy of this package
    def entries(directory: str) -> Iterator[tuple[str, int, bool]]:
        try:
            with os.scandir(os.path.join(target, directory)) as found:
                for entry in found:
                    path = f"{directory}/{entry.name}" if directory else entry.name
                    if entry.is_dir():
                        yield path, 0, True
                    elif entry.is_file():
                        yield path, entry.stat().st_size, False
        except OSError:
            return

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for directory in batch["path"]:
                found = entries(directory)
                while rows := list(itertools.islice(found, _ROWS)):
                    yield pd.DataFrame(rows, columns=["path", "size_bytes", "is_directory"])

    files, directories = None, spark.createDataFrame([("",)], "path string")
    while files is None or not directories.isEmpty():
        level = directories.repartition("path").mapInPandas(
            walk, "path string, size_bytes long, is_directory boolean"
        )
        level = stored(level)
        own = level.where("NOT is_directory").select("path", "size_bytes")
        files = own if files is None else files.unionAll(own)
        directories = level.where("is_directory").select("path")
    return files


def with_reason(
    files: DataFrame,
    languages: Sequence[str] = SUPPORTED_LANGUAGES,
    ignore_patterns: Sequence[str] = DEFAULT_IGNORE_PATTERNS,
    max_bytes: int = MAX_FILE_SIZE_BYTES,
) -> DataFrame:
    """Listed files with ``skipped``, why the built-in scan leaves a file out, null if it does not."""
    path = F.col("path")
    reason = F.when(ignored(path, ignore_patterns), F.lit("ignored"))
    reason = reason.when(~has_language(path, languages), F.lit("language"))
    reason = reason.when(~within_size(F.col("size_bytes"), max_bytes), F.lit("size"))
    return files.withColumn("skipped", reason)


def read_files(files: DataFrame, target: str) -> DataFrame:
    """Listed files with their ``content``; that of a file that cannot be read is null."""
    root = os.path.abspath(target)
    if os.path.isfile(root):
        root = os.path.dirname(root)

    def content(path: str) -> bytes | None:
        try:
            with open(os.path.join(root, path), "rb") as file:
                return file.read()
        except OSError:
            return None

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), _FILES):
                part = batch.iloc[start : start + _FILES]
                yield part.assign(content=[content(p) for p in part["path"]])

    return (
        files.select("path", "size_bytes")
        .repartition("path")
        .mapInPandas(read, "path string, size_bytes long, content binary")
    )


def decode(content: Column) -> Column:
    """UTF-8 text with bad bytes replaced by U+FFFD and every line break read as "\\n"."""
    text = F.make_valid_utf8(content.cast("string"))
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def file_units(
    spark: SparkSession,
    target: str,
    languages: Sequence[str] = SUPPORTED_LANGUAGES,
    ignore_patterns: Sequence[str] | None = None,
    max_bytes: int = MAX_FILE_SIZE_BYTES,
) -> DataFrame:
    """Units of the built-in scan: known extension, size within the limit, not ignored.

    Without ``ignore_patterns`` the default ones hold and those of the ignore file of the target or
    of the nearest directory above it. A file that cannot be read is a unit without text: it counts
    as scanned. ``with_reason`` over ``list_files`` tells what is left out and why.
    """
    if ignore_patterns is None:
        file = find_ignore_file(target)
        ignore_patterns = read_ignore_file(file) if file else DEFAULT_IGNORE_PATTERNS
    if os.path.isfile(target):
        ignore_patterns = ()
    listed = with_reason(list_files(spark, target), languages, ignore_patterns, max_bytes)
    return _units(read_files(listed.where("skipped IS NULL"), target), language_of(F.col("path")))


def standalone_units(spark: SparkSession, target: str) -> DataFrame:
    """Units of the standalone scan, which has its own rules on names and no size limit."""
    path = F.col("path")
    single = os.path.isfile(target)
    wanted = standalone_language_of(path).isNotNull() if single else standalone_walks(path)
    files = list_files(spark, target).where(wanted)
    return _units(read_files(files, target), standalone_language_of(path))


def binary_units(
    spark: SparkSession, uri: str, max_bytes: int = MAX_FILE_SIZE_BYTES
) -> DataFrame:
    """Units from any file system Spark reads; names starting with "_" or "." are not listed."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(uri)
        .where(F.col("length") <= max_bytes)
        .select("path", F.col("length").alias("size_bytes"), "content")
    )
    return _units(files.where(has_language(F.col("path"))), language_of(F.col("path")))


def _units(files: DataFrame, language: Column) -> DataFrame:
    return files.select(
        F.col("path").alias("unit_id"),
        "path",
        language.alias("language"),
        decode(F.col("content")).alias("text"),
        "size_bytes",
    )
