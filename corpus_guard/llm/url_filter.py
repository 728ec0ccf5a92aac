"""URL filters by a temporal list join.

A list is a log of dated entries: from ``since`` on, a pattern is listed or not. A pattern is a
host, which covers its subdomains, or a host and the first segment of a path. Entries become
validity intervals, and every capture is evaluated against the patterns active when it was fetched.

An interval is covered by aligned blocks of 1, 16, 256, ... days, few of each size, so a long listing is
some dozens of rows, not one a day. A capture looks up the block of each size that holds its day: the
as-of join is an equality join on pattern, size and block. A host with very many captures is thereby
dealt by days, and Spark splits what is still large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpus_guard.llm.shared import ROW, row_key, table, written

#: Days of a block in days of the next smaller one, and sizes beyond one day.
BLOCK, SIZES = 16, 5

_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?"
_HOST = _AUTHORITY + r"([^/?#:@]+)"
_SEGMENT = _AUTHORITY + r"[^/?#]*(/[^/?#]+)"


def host(url: Column) -> Column:
    """The lower-cased host; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit(""))


def patterns(url: Column) -> Column:
    """All patterns that would cover the URL: its host, parent domains of two labels or more, and
    the host with the first path segment."""
    labels = F.split(host(url), r"\.")
    last = F.greatest(F.size(labels) - 2, F.lit(0))
    domains = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")
    )
    segment = F.regexp_extract(url, _SEGMENT, 1)
    path = F.when(segment != "", F.array(F.concat(host(url), segment))).otherwise(F.array())
    return F.when(host(url) == "", F.array().cast("array<string>")).otherwise(F.concat(domains, path))


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, since and until of the times a pattern is listed; until is null while it lasts.

    ``entries``: pattern, since, listed. Of entries of one pattern and time a listing one wins.
    Entries with a null among the three are not used. Repeated entries change nothing.
    """
    known = entries.where("pattern IS NOT NULL AND since IS NOT NULL AND listed IS NOT NULL")
    known = known.groupBy("pattern", "since").agg(F.max("listed").alias("listed"))
    known = known.withColumn("day", F.to_date("since"))
    in_day = Window.partitionBy("pattern", "day").orderBy("since")
    known = known.withColumn("until", F.lead("since").over(in_day))
    # the last of a day ends with the first of the pattern's next day: at most one row a day here
    days = known.groupBy("pattern", "day").agg(F.min("since").alias("first"))
    after = F.lead("first").over(Window.partitionBy("pattern").orderBy("day"))
    days = days.select("pattern", "day", after.alias("next_first"))
    known = known.join(days, ["pattern", "day"]).where("listed")
    return known.select("pattern", "since", F.coalesce("until", "next_first").alias("until"))


def cover(first: str, last: str) -> Column:
    """An array of (size, block): aligned blocks that hold the days from ``first`` to ``last`` once.

    ``first`` and ``last`` name columns of day numbers. A block of size k has BLOCK ** k days and the
    number of its first day over that; up to 2 * (BLOCK - 1) blocks of a size are used.
    """
    run = "IF({a} < {b}, transform(sequence({a}, {b} - 1), n -> named_struct('size', k, 'block', n)), array())"
    whole = run.format(a="s.low", b="s.high")
    left, right = run.format(a="s.low", b=f"{BLOCK} * s.up"), run.format(a=f"{BLOCK} * s.down", b="s.high")
    done = f"(s.up >= s.down OR k = {SIZES})"
    step = f"""named_struct(
        'low', IF({done}, s.high, s.up), 'high', IF({done}, s.high, s.down),
        'found', concat(s.found, IF({done}, {whole}, concat({left}, {right}))))"""
    # up and down: the blocks of the next size that lie inside
    inside = (
        f"named_struct('low', t.low, 'high', t.high, 'found', t.found, "
        f"'up', CAST(ceil(t.low / {BLOCK}) AS INT), 'down', CAST(floor(t.high / {BLOCK}) AS INT))"
    )
    empty = "CAST(array() AS ARRAY<STRUCT<size: INT, block: INT>>)"
    step = f"element_at(transform(array({inside}), s -> {step}), 1)"
    return F.expr(
        f"aggregate(sequence(0, {SIZES}), named_struct('low', {first}, 'high', {last} + 1, 'found', {empty}), "
        f"(t, k) -> IF(t.low < t.high, {step}, t), t -> t.found)"
    )


def _day(time: str) -> Column:
    return F.unix_date(F.to_date(time))


def evaluated(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` (url, fetched and any others) with blocked, pattern and listed_since.

    blocked: whether a pattern covering the URL was listed at ``fetched``; pattern is then the
    longest such one, the last by name of equals, and listed_since when its listing began. A
    listing counts from its time on, and not any more at the time it ends. A capture without
    fetched cannot be evaluated and gets nulls; a null URL or one without host is not blocked.
    Repeated rows get the same. Columns of ``captures`` by the names of the result are replaced.
    """
    captures = captures.drop("blocked", "pattern", "listed_since").withColumn(ROW, row_key("url", "fetched"))
    bounds = captures.agg(F.max("fetched").alias("last")).first()
    keys = captures.where("fetched IS NOT NULL").select(ROW, "url", "fetched").dropDuplicates([ROW])
    keys = keys.select(ROW, "fetched", F.explode(F.array_distinct(patterns(F.col("url")))).alias("pattern"))
    listed = intervals(entries)
    if bounds.last is None:
        listed = listed.where("false")
    last = F.least(F.coalesce("until", F.lit(bounds.last)), F.lit(bounds.last))
    listed = listed.withColumns({"first_day": _day("since"), "last_day": F.unix_date(F.to_date(last))})
    listed = listed.where("first_day <= last_day").withColumn("part", F.explode(cover("first_day", "last_day")))
    listed = written(listed.select("pattern", "since", "until", "part.size", "part.block"))
    # at most one row for each size
    sizes = [r["size"] for r in listed.select("size").distinct().orderBy("size").collect()]
    blocks = [F.struct(F.lit(k).alias("size"), F.floor(_day("fetched") / BLOCK**k).cast("int").alias("block")) for k in sizes]
    parts = F.array(*blocks) if blocks else F.array().cast("array<struct<size:int,block:int>>")
    keys = keys.withColumn("part", F.explode(parts)).select(ROW, "fetched", "pattern", "part.size", "part.block")
    met = keys.join(listed, ["pattern", "size", "block"]).where("since <= fetched AND (until IS NULL OR fetched < until)")
    best = F.max(F.struct(F.length("pattern").alias("n"), "pattern", "since"))
    blocked = met.groupBy(ROW).agg(best.alias("best"))
    found = captures.join(blocked, ROW, "left").drop(ROW)
    seen = F.col("fetched").isNotNull()
    return found.withColumns(
        {
            "blocked": F.when(seen, F.col("best").isNotNull()),
            "pattern": F.col("best.pattern"),
            "listed_since": F.col("best.since"),
        }
    ).drop("best")


def captures_of(spark, sf_dir: str) -> DataFrame:
    """All pages, fetched at the time of the event of their number."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    events = table(spark, sf_dir, "events").groupBy(F.col("event_id").alias("page_id"))
    return pages.join(events.agg(F.min("ts").alias("fetched")), "page_id", "left")


def entries_of(spark, sf_dir: str) -> DataFrame:
    """A list from the events: errors list a pattern of the page of the event's user, signups take
    it off. By event_id modulo 3 it is the host, its parent, or host and first segment."""
    events = table(spark, sf_dir, "events").where("event_type IN ('error', 'signup')")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("user_id"), "url")
    both = events.join(pages, "user_id")
    own = host(F.col("url"))
    parent = F.when(
        F.size(F.split(own, r"\.")) > 3, F.expr("substring(own, length(substring_index(own, '.', 1)) + 2)")
    ).otherwise(F.col("own"))
    pattern = (
        F.when(F.col("event_id") % 3 == 0, F.col("own"))
        .when(F.col("event_id") % 3 == 1, parent)
        .otherwise(F.concat("own", F.regexp_extract("url", _SEGMENT, 1)))
    )
    return both.withColumn("own", own).select(
        pattern.alias("pattern"), F.col("ts").alias("since"), (F.col("event_type") == "error").alias("listed")
    )


def op9(spark, sf_dir: str) -> DataFrame:
    return evaluated(captures_of(spark, sf_dir), written(entries_of(spark, sf_dir)))


OP9_SQL = rf"""
WITH hosts AS (
    SELECT page_id, url, lower(regexp_extract(url, '{_HOST}', 1)) AS host,
        regexp_extract(url, '{_SEGMENT}', 1) AS segment
    FROM pages
), entries AS (
    SELECT pattern, since, bool_or(listed) AS listed FROM (
        SELECT ts AS since, event_type = 'error' AS listed, CASE
            WHEN event_id % 3 = 0 THEN host
            WHEN event_id % 3 = 1 THEN CASE WHEN length(host) - length(replace(host, '.', '')) > 2
                THEN substr(host, instr(host, '.') + 1) ELSE host END
            ELSE host || segment END AS pattern
        FROM events JOIN hosts ON hosts.page_id = events.user_id
        WHERE event_type IN ('error', 'signup'))
    GROUP BY pattern, since
), captures AS (
    SELECT h.*, e.fetched FROM hosts h
    LEFT JOIN (SELECT event_id, min(ts) AS fetched FROM events GROUP BY event_id) e ON e.event_id = h.page_id
), keys AS (
    SELECT DISTINCT page_id, url, fetched, unnest(CASE WHEN host = '' THEN []::VARCHAR[] ELSE list_concat(
        [array_to_string(string_split(host, '.')[i:], '.')
            for i in range(1, greatest(len(string_split(host, '.')), 2))],
        CASE WHEN segment <> '' THEN [host || segment] ELSE [] END) END) AS pattern
    FROM captures
), states AS (
    SELECT k.page_id, k.url, k.fetched, k.pattern,
        arg_max(e.listed, e.since) AS listed, max(e.since) AS since
    FROM keys k JOIN entries e ON e.pattern = k.pattern AND e.since <= k.fetched
    GROUP BY ALL
), best AS (
    SELECT page_id, url, fetched, max(struct_pack(n := length(pattern), pattern := pattern, since := since)) AS best
    FROM states WHERE listed GROUP BY ALL
)
SELECT c.page_id, c.url, c.fetched,
    CASE WHEN c.fetched IS NOT NULL THEN best IS NOT NULL END AS blocked,
    best.pattern AS pattern, best.since AS listed_since
FROM captures c LEFT JOIN best b
    ON b.page_id = c.page_id AND b.url IS NOT DISTINCT FROM c.url AND b.fetched = c.fetched
"""
