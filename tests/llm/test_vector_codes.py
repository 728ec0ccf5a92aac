"""Ball k-means codes against plain rounds of comparing everything with everything."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from corpus_guard.llm import vector_codes
from corpus_guard.llm.shared import table
from corpus_guard.llm.vector_codes import CODEC, Codec, compressed, decoded, integers, nearest

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, codec=CODEC):
    """Rows (vec_id, components) of finite numbers, with loops."""
    kept = sorted((i, [math.floor(codec.scale * float(np.float32(x))) for x in v]) for i, v in rows)
    width = len(kept[0][1]) // codec.parts
    cut = {(n, p): v[p * width : p * width + width] for n, (_, v) in enumerate(kept) for p in range(codec.parts)}
    books = [[cut[n, p] for n in range(min(codec.entries, len(kept)))] for p in range(codec.parts)]

    def assigned(p):
        found = []
        for n in range(len(kept)):
            away = [sum((a - b) ** 2 for a, b in zip(cut[n, p], entry)) for entry in books[p]]
            found.append((away.index(min(away)), min(away)))
        return found

    for _ in range(codec.rounds):
        for p in range(codec.parts):
            codes = assigned(p)
            for e in range(len(books[p])):
                own = [cut[n, p] for n, (code, _) in enumerate(codes) if code == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    last = [assigned(p) for p in range(codec.parts)]
    result = [(i, "".join(f"{c[n][0]:02x}" for c in last), sum(c[n][1] for c in last)) for n, (i, _) in enumerate(kept)]
    flat = [x for book in books for entry in book for x in entry]
    return result, hashlib.sha256(",".join(map(str, flat)).encode()).hexdigest()


def got(codes):
    return sorted((r.vec_id, r.codes.hex(), r.error) for r in codes.rows.collect())


@pytest.mark.parametrize("seed", range(20))
def test_nearest_equals_all_distances_with_ties(seed):
    random = np.random.default_rng(seed)
    spread = [2, 5, 40, 1000][seed % 4]
    x, book = random.integers(-spread, spread, (400, 3)), random.integers(-spread, spread, (16, 3))
    book[5] = book[11]
    away = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    for own in (np.zeros(400, np.int64), random.integers(0, 16, 400), away.argmin(axis=1)):
        code, best, taken = nearest(x, own, book)
        assert (code == away.argmin(axis=1)).all() and (best == away.min(axis=1)).all()
        assert taken <= away.size


def test_balls_save_distances():
    random = np.random.default_rng(0)
    book = random.integers(-4000, 4000, (16, 8))
    own = random.integers(0, 16, 5000)
    x = book[own] + random.integers(-300, 300, (5000, 8))
    code, _, taken = nearest(x, own, book)
    assert (code == own).all() and taken < 2 * len(x)


def vectors(n, size=16, seed=1):
    random = np.random.default_rng(seed)
    return [(int(i), random.normal(0, 0.3, size).round(3).tolist()) for i in random.permutation(n)]


def test_codes_equal_brute_force(spark):
    rows = vectors(300) + [(1000 + i, [0.25] * 16) for i in range(40)] + [(2000, [-0.0001] * 16)]
    frame = spark.createDataFrame([(i, v, i % 3) for i, v in rows], SCHEMA).repartition(5)
    codes = compressed(frame)
    want, sha = brute(rows)
    assert got(codes) == sorted(want) and codes.sha256 == sha
    other = Codec(parts=4, entries=5, rounds=2, scale=100)
    codes = compressed(frame, other)
    want, sha = brute(rows, other)
    assert got(codes) == sorted(want) and codes.sha256 == sha


def test_odd_vectors_are_left_out_and_few_rows_are_coded(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(3, [0.1] * 8, 1), (1, None, 1), (2, [nan] + [0.0] * 7, 1), (4, [0.2] * 8, None), (5, [inf] * 8, 2),
            (6, [None] + [0.0] * 7, 2), (7, [], 2), (8, [0.1] * 7, 2), (9, [0.3] * 16, 2), (4, [0.2] * 8, None),
            (None, [-0.3] * 8, 4)]
    frame = spark.createDataFrame(rows, SCHEMA)
    codes = compressed(frame)
    found = sorted((r.vec_id or -1, r.error) for r in codes.rows.collect())
    assert found == [(-1, 0), (3, 0), (4, 0), (4, 0)] and codes.books.shape == (8, 4, 1)
    assert compressed(frame.where("false")).rows.collect() == []


def test_large_components_are_limited(spark):
    frame = spark.createDataFrame([(1, [3e38] * 8, 0), (2, [-3e38] * 8, 0), (3, [1.0] * 8, 0)], SCHEMA)
    packed = {r.vec_id: np.frombuffer(r.packed, "<i4") for r in integers(frame).collect()}
    most = vector_codes.limit(8)
    assert set(packed[1]) == {most} and set(packed[2]) == {-most} and set(packed[3]) == {4096}
    assert vector_codes.limit(64) == 1 << 27
    assert all(r.error >= 0 for r in compressed(frame, Codec(entries=1)).rows.collect())


def test_clashing_columns_and_decoding(spark):
    frame = spark.createDataFrame([(i, v, 0) for i, v in vectors(60)], SCHEMA)
    frame = frame.selectExpr("*", "1 AS vector", "2 AS size", "3 AS packed", "4 AS codes", "5 AS sums", "6 AS error")
    codes = compressed(frame)
    assert codes.rows.columns == ["vec_id", "label", "codes", "error"]
    rows = {i: v for i, v in vectors(60)}
    for r in decoded(codes.rows, codes.books).collect():
        given = np.floor(np.array(rows[r.vec_id], np.float32).astype(float) * 4096)
        assert ((given - np.array(r.vector) * 4096) ** 2).sum() == pytest.approx(r.error)


def test_query_equals_its_sql(spark):
    duck = duckdb.connect()
    duck.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    want = duck.execute(vector_codes.OP13_SQL).fetchall()
    assert sorted(map(tuple, vector_codes.op13(spark, "/root/testdata/sf0.01").collect())) == sorted(want)


def test_query_sums_errors_by_label_with_nulls_together(spark, tmp_path):
    rows = [(i, v, [0, 1, None][i % 3]) for i, v in vectors(40)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    found = vector_codes.op13(spark, str(tmp_path)).collect()
    want, _ = brute([(i, v) for i, v, _ in rows])
    errors = {i: e for i, _, e in want}
    for r in found:
        assert r.error == errors[r.vec_id]
        assert r.label_error == sum(e for i, e in errors.items() if i % 3 == r.vec_id % 3)


def test_rounds_leave_one_table(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    import os

    before = set(os.listdir(folder))
    assert table(spark, "/root/testdata/sf0.001", "embeddings").count() == compressed(
        table(spark, "/root/testdata/sf0.001", "embeddings")
    ).rows.count()
    assert len(set(os.listdir(folder)) - before) == 1
