"""Ignore patterns in the style of ``.gitignore``, as conditions on a path column."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_guard.catalogue.names import DEFAULT_IGNORE_PATTERNS
from corpus_guard.functions.dialect import SPACE

IGNORE_FILE = ".scanignore"


def ignore_regex(pattern: str) -> tuple[bool, str] | None:
    """(ignores, anchored regex) of one pattern; None for blank lines and comments.

    ``!`` re-includes. A slash at the start or inside anchors the pattern at the root, one at the
    end limits it to directories, that is to the paths below. ``**`` spans directories.
    """
    pattern = pattern if pattern.endswith("\\ ") else pattern.rstrip()
    if not pattern or pattern.startswith("#") or pattern == "/":
        return None
    ignores = not pattern.startswith("!")
    pattern = pattern[0 if ignores else 1 :]
    if pattern.startswith(("\\#", "\\!")):
        pattern = pattern[1:]
    below_only = pattern.endswith("/")
    anchored = "/" in pattern[:-1]
    segments = pattern.strip("/").split("/")
    regex = "^" if anchored else "^(?:.+/)?"
    for i, segment in enumerate(segments):
        last = i == len(segments) - 1
        if segment == "**":
            if last:
                regex += ".+" if i else ".*"
                return ignores, regex + "$"
            regex += "(?:.+/)?"
        else:
            regex += _segment_regex(segment) + ("" if last else "/")
    return ignores, regex + ("/.*$" if below_only else "(?:/.*)?$")


_GLOB = re.compile(r"\\(.)|\[(!|\^)?(\]?[^\]]*)\]|(\*+)|(\?)|(.)", re.DOTALL)


def _segment_regex(segment: str) -> str:
    out = []
    for escaped, negated, members, stars, question, other in _GLOB.findall(segment):
        if escaped or other:
            out.append(re.escape(escaped or other))
        elif stars:
            out.append("[^/]*")
        elif question:
            out.append("[^/]")
        else:
            members = members.replace("\\", "\\\\").replace("[", r"\[")
            out.append(f"[{'^/' if negated else ''}{members}]")
    return "".join(out)


def ignored(path: Column, patterns: Sequence[str] = DEFAULT_IGNORE_PATTERNS) -> Column:
    """Whether a walk from the root leaves a relative path out.

    The last matching pattern decides, and a directory that is left out is not entered, so its
    files cannot be re-included. Without ``!`` patterns that is one regex search on the path.
    """
    compiled = [c for c in map(ignore_regex, patterns) if c is not None]
    if all(ignores for ignores, _ in compiled):
        return path.rlike("|".join(regex for _, regex in compiled) or r"\A\z(?!)")

    def decided(p: Column) -> Column:
        result = F.lit(False)
        for ignores, regex in compiled:
            result = F.when(p.rlike(regex), F.lit(ignores)).otherwise(result)
        return result

    return F.exists(_prefixes(path), decided)


def _prefixes(path: Column) -> Column:
    """The directories on the way to a path, from the root, and the path."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )


def compiled_lines(lines: DataFrame) -> DataFrame:
    """(directory, number, ignores, regex) of a table of ignore-file lines (directory, number, line).

    Blank lines and comments are left out, null lines too.
    """

    def run(frames):
        for frame in frames:
            rows = []
            for directory, number, line in frame[["directory", "number", "line"]].itertuples(index=False):
                if isinstance(line, str) and (rule := ignore_regex(line.strip())) is not None:
                    rows.append((directory, number, *rule))
            yield pd.DataFrame(rows, columns=["directory", "number", "ignores", "regex"])

    kinds = dict(lines.dtypes)
    schema = f"directory string, number {kinds['number']}, ignores boolean, regex string"
    return lines.select("directory", "number", "line").mapInPandas(run, schema)


def ignored_by_files(
    paths: DataFrame, lines: DataFrame, path: str = "path", patterns: Sequence[str] = DEFAULT_IGNORE_PATTERNS
) -> DataFrame:
    """``paths`` with ignored: by the default patterns and the ignore file nearest to each path.

    ``lines``: directory, number and line of every ignore file; directory "" is the root. A file's
    patterns hold for paths relative to its directory and come after the default ones, which hold from
    the root. The last matching pattern decides, and what is below a directory that is left out is left
    out. The files are data: they are joined with the paths by directory, each path with the patterns
    of one file, so their number does not matter to the plan. Null paths have a null result.
    """
    own = F.sort_array(F.collect_list(F.struct("number", "ignores", "regex"))).alias("__patterns")
    files = compiled_lines(lines).groupBy("directory").agg(own)
    found = paths.select(path).where(F.col(path).isNotNull()).distinct()
    nearest = nearest_ignore_file(found, lines, path).withColumnRenamed("directory", "__directory")
    nearest = nearest.join(files.withColumnRenamed("directory", "__directory"), "__directory", "left")
    found = found.join(nearest, path, "left")
    compiled = [c for c in map(ignore_regex, patterns) if c is not None]

    def decided(p: Column) -> Column:
        result = F.lit(False)
        for ignores, regex in compiled:
            result = F.when(p.rlike(regex), F.lit(ignores)).otherwise(result)
        # paths at or above the file's directory are not its own
        start = F.when(F.col("__directory") == "", F.lit(0)).otherwise(F.length("__directory") + 1)
        inside = F.length(p) > start
        relative = F.substring(p, start + 1, F.length(p))
        matched = F.filter("__patterns", lambda r: F.call_function("rlike", relative, r["regex"]))
        last = F.element_at(matched, -1)["ignores"]
        own = F.when(inside & (F.size(matched) > 0), last)
        return F.coalesce(own, result)

    number = dict(lines.dtypes)["number"]
    known = F.coalesce(F.col("__patterns"), F.array().cast(f"array<struct<number:{number},ignores:boolean,regex:string>>"))
    found = found.withColumn("__patterns", known).withColumn("__directory", F.coalesce("__directory", F.lit("")))
    found = found.select(path, F.exists(_prefixes(F.col(path)), decided).alias("ignored"))
    return paths.drop("ignored").join(found, path, "left")


def ignored_by_substring(
    path: Column, patterns: Sequence[str] = DEFAULT_IGNORE_PATTERNS
) -> Column:
    """The fallback without a pattern matcher: any pattern's bare text anywhere in the path."""
    words = [p.rstrip("/").lstrip("*.") for p in patterns]
    return path.rlike("|".join(re.escape(w) for w in dict.fromkeys(words) if w))


def parse_ignore_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """The patterns of an ignore file's lines: trimmed, without blanks and comments."""
    trimmed = F.regexp_replace(F.col(line), rf"^[{SPACE}]+|[{SPACE}]+\z", "")
    return lines.withColumn(line, trimmed).where(
        (F.col(line) != "") & ~F.col(line).startswith("#")
    )


def read_ignore_file(path: str) -> list[str]:
    """Default patterns followed by those of a file, which the driver reads as configuration."""
    with open(path, encoding="utf-8") as file:
        lines = [line.strip() for line in file.read().splitlines()]
    return [*DEFAULT_IGNORE_PATTERNS, *(p for p in lines if p and not p.startswith("#"))]


def find_ignore_file(target: str, name: str = IGNORE_FILE) -> str | None:
    """The ignore file of a directory or of the nearest one above it."""
    directory = os.path.abspath(target)
    directory = directory if os.path.isdir(directory) else os.path.dirname(directory)
    while True:
        if os.path.isfile(found := os.path.join(directory, name)):
            return found
        if directory == (above := os.path.dirname(directory)):
            return None
        directory = above


def nearest_ignore_file(
    paths: DataFrame, ignore_dirs: DataFrame, path: str = "path", directory: str = "directory"
) -> DataFrame:
    """(path, directory): for each path the deepest listed directory that contains it.

    Each path is expanded into its parent directories (as many as it has slashes) and joined on
    equality, so neither side has to be small.
    """
    parts = F.split(path, "/")
    parents = F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )
    expanded = paths.select(path).distinct().select(path, F.explode(parents).alias(directory))
    found = expanded.join(ignore_dirs.select(directory).distinct(), directory)
    deepest = F.max_by(F.col(directory), F.length(directory)).alias(directory)
    return found.groupBy(path).agg(deepest)
