"""Path expressions: language, extension and the standalone scan's name rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpus_guard.catalogue.names import (
    EXTENSION_LANGUAGE,
    MAX_FILE_SIZE_BYTES,
    STANDALONE_COUNT_SKIP_DIRS,
    STANDALONE_EXTENSION_LANGUAGE,
    STANDALONE_IGNORE_DIRS,
    SUPPORTED_LANGUAGES,
)


def extension(path: Column) -> Column:
    """Lower-cased suffix with its dot; none for a name that only starts or ends with a dot."""
    return F.lower(F.regexp_extract(path, r"[^/]+(\.[^./]+)$", 1))


def language_of(path: Column) -> Column:
    """Language by extension, ``unknown`` otherwise."""
    return F.coalesce(_lookup(extension(path), EXTENSION_LANGUAGE), F.lit("unknown"))


def standalone_language_of(path: Column) -> Column:
    """The standalone scan's language; null means the unit is skipped."""
    return _lookup(extension(path), STANDALONE_EXTENSION_LANGUAGE)


def _lookup(value: Column, table: dict[str, str]) -> Column:
    found = F.lit(None).cast("string")
    for key, result in table.items():
        found = F.when(value == key, result).otherwise(found)
    return found


def has_language(path: Column, languages: Sequence[str] = SUPPORTED_LANGUAGES) -> Column:
    """Whether the extension belongs to one of the languages."""
    allowed = [e for e, language in EXTENSION_LANGUAGE.items() if language in languages]
    return extension(path).isin(*allowed)


def within_size(size: Column, limit: int = MAX_FILE_SIZE_BYTES) -> Column:
    """Files over the limit are not scanned. A source limit, not a cut: no text is shortened."""
    return size <= limit


def _parts(path: Column) -> Column:
    return F.split(path, "/")


def standalone_walks(path: Column, ignored: Sequence[str] = STANDALONE_IGNORE_DIRS) -> Column:
    """Whether the standalone walk reaches a relative path and scans it.

    Names that start with a dot are skipped, directories of the listed names too. The list holds
    plain names: ``*.egg-info`` only skips a directory of that very name.
    """
    parts = _parts(path)
    directories = F.slice(parts, F.lit(1), F.size(parts) - 1)
    skipped = F.arrays_overlap(directories, F.array(*[F.lit(n) for n in ignored]))
    hidden = F.exists(parts, lambda part: part.startswith("."))
    return ~skipped & ~hidden & standalone_language_of(path).isNotNull()


def standalone_counts(path: Column, skipped: Sequence[str] = STANDALONE_COUNT_SKIP_DIRS) -> Column:
    """Whether the standalone file count includes a path: its rule differs from the walk's."""
    named = F.arrays_overlap(_parts(path), F.array(*[F.lit(n) for n in skipped]))
    return ~named & standalone_language_of(path).isNotNull()
