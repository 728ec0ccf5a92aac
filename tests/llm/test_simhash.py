import hashlib
import random

import xxhash
from pyspark.sql import functions as F

from corpus_guard.llm import simhash


def _fingerprint(text):
    words = [w for w in __import__("re").split(r"[ \t\n\x0b\f\r]+", (text or "").lower()) if w]
    terms = [(w, (w,)) for w in words]
    votes, weight = [0] * 128, 0
    for joined, parts in terms:
        seed = 42
        for part in parts:
            seed = xxhash.xxh64_intdigest(part.encode(), seed)
        halves = (seed, xxhash.xxh64_intdigest(seed.to_bytes(8, "little"), 42))
        w = min(len(joined), simhash.MOST_WEIGHT)
        weight += w
        for half, value in enumerate(halves):
            for b in range(64):
                votes[half * 64 + b] += w * (value >> b & 1)
    high, low = (sum((2 * votes[half * 64 + b] > weight) << b for b in range(64)) for half in (0, 1))
    return f"{high:016x}{low:016x}"


def _check(docs, rows):
    got = simhash.compared(docs).withColumn("mark", simhash.hexed("high", "low"))
    got = got.withColumn("edited", simhash.hexed("edited_high", "edited_low")).collect()
    texts = [t or "" for _, t in rows]
    want = []
    for i, (doc_id, _) in enumerate(rows):
        text, after = texts[i], texts[(i + 1) % len(rows)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        marks = [_fingerprint(t) for t in (text, edited, after)]
        apart = [bin(int(marks[0], 16) ^ int(m, 16)).count("1") for m in marks]
        want.append(
            (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), marks[0], marks[1], 1 - apart[1] / 128, 1 - apart[2] / 128)
        )
    found = [(r.doc_id, r.n_chars, r.edited_sha256, r.mark, r.edited, r.near_edited, r.near_next) for r in got]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_fingerprints_and_edits(documents, monkeypatch):
    draw = random.Random(2)
    words = ["été", "Haus", "tree", "😀", "stone", "river", "a", "überlang" * 5]
    monkeypatch.setattr(simhash, "IDS", 4)
    monkeypatch.setattr(simhash, "BUCKETS", 2)
    ids = sorted(draw.sample(range(-40, 200), 40))
    rows = [(i, " ".join(draw.choice(words) for _ in range(draw.randint(0, 40)))) for i in ids]
    rows[3] = (rows[3][0], None)
    rows[7] = (rows[7][0], "\n ")
    shuffled = rows[:]
    draw.shuffle(shuffled)
    _check(documents(*shuffled), rows)


def test_odd_rows(documents):
    rows = [(None, "one two"), (1, "x"), (2, "tall " * 9000 + "end")]
    schema = "doc_id long, text string, bucket string, seq string, extra int"
    _check(documents(*rows, schema=schema, defaults=("b", "s", 0)), rows)
    _check(documents((5, "alone here")), [(5, "alone here")])
    twice = simhash.compared(documents((1, "a b"), (1, "a b"), (2, "c d"))).collect()
    assert len(twice) == 3 and len({(r.high, r.low) for r in twice if r.doc_id == 1}) == 1
    assert simhash.compared(documents("x").where("false")).collect() == []


def test_all_neighbours_are_found_once(spark):
    draw = random.Random(9)
    base = [draw.getrandbits(128) for _ in range(6)]
    marks = {b ^ sum(1 << i for i in draw.sample(range(128), draw.randint(0, 18))) for b in base for _ in range(60)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(signed(m >> 64), signed(m & (1 << 64) - 1)) for m in marks], "high long, low long")
    queries = frame.where(F.col("low") % 3 == 0)
    got = [tuple(r) for r in simhash.within(frame.unionAll(frame), queries).collect()]
    assert len(got) == len(set(got))
    count = lambda a, b: sum(bin((x ^ y) & ((1 << 64) - 1)).count("1") for x, y in zip(a, b))
    rows, asked = [tuple(r) for r in frame.collect()], [tuple(r) for r in queries.collect()]
    want = {(*q, *r, d) for q in asked for r in rows if (d := count(q, r)) <= simhash.RADIUS}
    assert set(got) == want and len(want) > len(asked)


def test_planted_near_copies_are_found(spark, tmp_path):
    """Searches of the query against all fingerprints, by brute force, and the recall of planted copies."""
    draw = random.Random(12)
    words = ["".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(2, 9))) for _ in range(900)]
    often = [1 / (rank + 1) for rank in range(len(words))]  # as words of a language are
    rows, copies = [], {}
    for i in range(0, 2000, 50):
        base = draw.choices(words, often, k=draw.randint(120, 400))
        rows.append((i, " ".join(base)))
        rows.append((i + 1, " ".join(base)))
        for k in range(2, 6):
            text = list(base)
            for at in draw.sample(range(len(text)), len(text) // 25):
                text[at] = draw.choices(words, often)[0]
            rows.append((i + k, " ".join(text)))
        copies[i] = {i + k for k in range(2, 6)}
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in simhash.op6(spark, str(tmp_path)).collect()}
    marks = {i: int(r.fingerprint, 16) for i, r in got.items()}
    found = 0
    for i, r in got.items():
        equal = [j for j in marks if marks[j] == marks[i]]
        assert (r.class_id, r.n_equal) == (min(equal), len(equal))
        if i % 50:
            assert r.n_near is None and r.near_class is None
            continue
        near = [j for j in marks if j != i and bin(marks[i] ^ marks[j]).count("1") <= simhash.RADIUS]
        other = [got[j].class_id for j in near if marks[j] != marks[i]]
        assert (r.n_near, r.near_class) == (len(near), min(other, default=None))
        assert i + 1 in near
        found += len(copies[i] & set(near))
    assert found >= 0.9 * sum(map(len, copies.values()))
