import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from corpus_guard.llm import url_filter

START = datetime(2024, 1, 1)
ENTRY = "pattern string, since timestamp, listed boolean"


def _covers(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest.split("/")[0].split("?")[0].split("#")[0].split("@")[-1].split(":")[0].lower()
    if not host:
        return []
    labels = host.split(".")
    found = [".".join(labels[i:]) for i in range(max(1, len(labels) - 1))]
    path = rest.split("?")[0].split("#")[0].split("/")[1:2]
    return found + [f"{host}/{p}" for p in path if p]


def _brute(capture, entries):
    url, fetched = capture
    best = None
    for pattern in set(_covers(url)):
        log = {}
        for p, since, listed in entries:
            if p == pattern and None not in (since, listed) and since <= fetched:
                log[since] = log.get(since, False) or listed
        times = sorted(log)
        if times and log[times[-1]]:
            best = max(best or (0, "", START), (len(pattern), pattern, times[-1]))
    return (True, best[1]) if best else (False, None)


def test_against_every_entry(spark):
    draw = random.Random(6)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "localhost"]
    when = lambda: START + timedelta(hours=draw.randint(0, 24 * 12))
    entries = [(draw.choice([*hosts, "a.com/p", "b.org/q"]), when(), draw.random() < 0.6) for _ in range(120)]
    captures = []
    for _ in range(300):
        scheme = draw.choice(["http", "HTTPS"])
        user, port = draw.choice(["", "u:p@"]), draw.choice(["", ":80"])
        path = draw.choice(["", "/", "/p", "/p/r?s", "/q#t", "?p"])
        captures.append((f"{scheme}://{user}{draw.choice(hosts).upper()}{port}{path}", when()))
    frame = spark.createDataFrame(captures, "url string, fetched timestamp").withColumn("n", F.monotonically_increasing_id())
    got = url_filter.evaluated(frame, spark.createDataFrame(entries, ENTRY)).collect()
    assert len(got) == 300
    want = {c: _brute(c, entries) for c in captures}
    assert all((r.blocked, r.pattern) == want[r.url, r.fetched] for r in got)
    assert {b for b, _ in want.values()} == {True, False}


def test_odd_rows(spark):
    entries = [("a.com", START, True), ("a.com", START, False), (None, START, True), ("a.com", None, True)]
    entries += [("b.com", START, True), ("b.com", START + timedelta(days=3), False), ("b.com", START, None)]
    listed = spark.createDataFrame(entries, ENTRY)
    day = timedelta(days=1)
    rows = [("http://a.com/", START, 1), ("http://a.com/", START, 1), ("http://b.com/" + "x" * 90_000, START + 2 * day, 2)]
    rows += [("http://b.com", START + 3 * day, 3), (None, START, 4), ("no url", START, 5), ("http://a.com", None, 6)]
    captures = spark.createDataFrame(rows, "url string, fetched timestamp, pattern int").withColumn("id", F.col("pattern"))
    got = sorted((r.id, r.blocked, r.pattern) for r in url_filter.evaluated(captures, listed).select("id", "blocked", "pattern").collect())
    assert got == [
        (1, True, "a.com"), (1, True, "a.com"), (2, True, "b.com"), (3, False, None), (4, False, None), (5, False, None), (6, None, None),
    ]
    assert url_filter.evaluated(captures.where("false"), listed).collect() == []
    assert {r.blocked for r in url_filter.evaluated(captures, listed.where("false")).collect()} == {False, None}


def test_blocks_cover_an_interval_once(spark):
    draw = random.Random(6)
    rows = [(a, a + draw.choice([-3, -1, 0, 1, 15, 16, 31, 200, 256, 1095, 5000, 300_000])) for a in draw.sample(range(-400, 40_000), 60)]
    frame = spark.createDataFrame(rows, "a int, b int").select("a", "b", url_filter.cover("a", "b").alias("parts"))
    for r in frame.collect():
        held = sorted((p["block"] * 16 ** p["size"], (p["block"] + 1) * 16 ** p["size"]) for p in r.parts)
        if r.b < r.a:
            assert held == []
            continue
        assert held[0][0] == r.a and held[-1][1] == r.b + 1 and all(x[1] == y[0] for x, y in zip(held, held[1:]))
        assert len(held) <= 30 * 5 + 1


def test_long_listings_are_few_rows(spark):
    """Hosts listed for thirty years, one of them with a third of all captures."""
    entries = spark.range(3000).selectExpr("concat('h', id, '.org') AS pattern", "timestamp'1990-01-05 10:00:00' AS since", "true AS listed")
    captures = spark.range(9000).selectExpr(
        "concat('http://h', IF(id % 3 = 0, 7, id), '.org/x') AS url", "timestamp'1989-12-30 00:00:00' + make_interval(0, 0, 0, CAST(id * 4 % 11000 AS INT)) AS fetched"
    )
    rows = url_filter.evaluated(captures, entries).selectExpr("blocked", "fetched >= timestamp'1990-01-05 10:00:00' AS later", "url").collect()
    listed = {f"http://h{i}.org/x" for i in range(3000)}
    assert len(rows) == 9000 and all(r.blocked == (r.later and r.url in listed) for r in rows)
    last = captures.agg({"fetched": "max"}).first()[0]
    days = (last.date() - __import__("datetime").date(1990, 1, 5)).days
    parts = spark.range(1).selectExpr("7309 AS a", f"7309 + {days} AS b").select(url_filter.cover("a", "b").alias("parts")).first().parts
    assert days > 10_000 and len(parts) < 120
