"""Vector code compression by ball k-means.

Vectors become integers and are cut into equal parts; each part position has a codebook, fitted by
rounds of assigning every part to its nearest entry and moving the entries to the floored means. All
arithmetic is on integers, so results do not depend on how rows are spread over tasks.

A round does not compare every part with every entry. An entry and the parts that had it before form a
ball, whose squared radius is its farthest part's distance. With squared distances D from a part to its
entry and B between two entries, another entry can be as near only if B <= 4 D. So entries with B
beyond four times the squared radius are no neighbours of the ball; parts nearer than half the way to the
nearest neighbour are its stable core, which is not compared with anything; and the ring a part lies
in, between half the ways to two neighbours by growing distance, names the neighbours it is compared
with. Radii are those of a batch of rows, which are at most those of all rows.

Each round is a narrow job over the rows with their last codes. Its output holds the new codes and, in
an extra row of each task, sums and counts by entry; Spark adds those, and the driver gets the entries.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_guard.llm.shared import checked, removed, stored, table


@dataclass(frozen=True)
class Codec:
    """``entries``: of a codebook, 256 at most; ``scale``: of a component before it is floored."""

    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096


CODEC = Codec()
#: Rows that one step compares at a time.
_ROWS = 1 << 13


def limit(size: int) -> int:
    """Largest integer component, so that squared distances of vectors fit a long."""
    return math.isqrt((1 << 62) // size) // 2


def nearest(x: np.ndarray, own: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest entry of each row of ``x``, the first of equally near ones, and its
    squared distance; also how many distances were taken. ``own``: any entry of each row, best the
    one it had."""
    away = ((x - book[own]) ** 2).sum(axis=1)
    best, code, taken = away.copy(), own.copy(), len(x)
    between = ((book[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
    least = (between + 3) // 4  # B <= 4 D as D >= ceil(B / 4)
    order = np.argsort(own, kind="stable")
    cuts = np.searchsorted(own[order], np.arange(len(book) + 1))
    for entry in range(len(book)):
        ball = order[cuts[entry] : cuts[entry + 1]]
        if not len(ball):
            continue
        radius = away[ball].max()
        for other in np.argsort(least[entry], kind="stable"):
            if least[entry, other] > radius:
                break
            if other == entry:
                continue
            ball = ball[away[ball] >= least[entry, other]]  # the rings from here outward
            found = ((x[ball] - book[other]) ** 2).sum(axis=1)
            taken += len(ball)
            better = (found < best[ball]) | ((found == best[ball]) & (other < code[ball]))
            best[ball[better]], code[ball[better]] = found[better], other
    return code, best, taken


def _integers(codec: Codec):
    def run(batches):
        for batch in batches:
            column = batch.column("vector")
            sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
            flat = pc.list_flatten(column).cast(pa.float64())
            flat = np.asarray(flat.fill_null(np.nan), np.float64)
            starts = np.cumsum(sizes) - sizes
            odd = np.zeros(len(flat) + 1, np.int64)
            np.cumsum(~np.isfinite(flat), out=odd[1:])
            kept = (sizes > 0) & (sizes % codec.parts == 0) & (odd[starts + sizes] == odd[starts])
            packed = []
            for start, size in zip(starts[kept], sizes[kept]):
                most = limit(size)
                own = np.floor(np.clip(flat[start : start + size], -1e300, 1e300) * codec.scale)
                packed.append(np.clip(own, -most, most).astype("<i4").tobytes())
            batch = batch.filter(pa.array(kept)).drop_columns(["vector"])
            yield batch.append_column("size", pa.array(sizes[kept])).append_column("packed", pa.array(packed, pa.binary()))

    return run


def integers(vectors: DataFrame, codec: Codec = CODEC, keys: tuple[str, ...] = ("vec_id", "label"), vector: str = "embedding") -> DataFrame:
    """``keys``, size and packed (32-bit integers) of the vectors that can be coded.

    Left out are null vectors, those with null or non-finite components, and those that cannot be cut
    into equal parts. Components beyond ``limit`` count as the limit: for 64 components, 2 ** 27.
    """
    types = dict(vectors.dtypes)
    rows = vectors.select(*keys, F.col(vector).cast("array<double>").alias("vector"))
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys)
    return rows.mapInArrow(_integers(codec), f"{schema}, size long, packed binary")


def _rounds(codec: Codec, books: np.ndarray, last: bool):
    """New codes for rows with codes; errors too if it is the last time, else sums of the parts."""
    parts, entries, width = books.shape

    def coded(packed: pa.Array, codes: pa.Array, sums: np.ndarray):
        x = np.frombuffer(b"".join(packed.to_pylist()), "<i4").reshape(-1, parts, width).astype(np.int64)
        own = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)
        error = np.zeros(len(x), np.int64)
        result = np.empty_like(own, np.uint8)
        for part in range(parts):
            code, away, _ = nearest(x[:, part], own[:, part], books[part])
            error += away
            result[:, part] = code
            if not last:
                np.add.at(sums[part, :, 0], code, 1)
                np.add.at(sums[part, :, 1:], code, x[:, part])
        return [bytes(r) for r in result], error

    def run(batches):
        sums, like = np.zeros((parts, entries, width + 1), np.int64), None
        for batch in batches:
            like = batch.schema
            for at in range(0, batch.num_rows, _ROWS):
                own = batch.slice(at, _ROWS)
                codes, error = coded(own.column("packed"), own.column("codes"), sums)
                own = own.drop_columns(["codes"]).append_column("codes", pa.array(codes, pa.binary()))
                yield (
                    own.drop_columns(["packed"]).append_column("error", pa.array(error))
                    if last
                    else own.append_column("sums", pa.nulls(own.num_rows, pa.list_(pa.int64())))
                )
        if like is not None and not last:
            names = [n for n in like.names if n != "codes"]
            empty = [pa.nulls(1, like.field(n).type) for n in names]
            columns = [*empty, pa.array([None], pa.binary()), pa.array([sums.ravel().tolist()], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, [*names, "codes", "sums"])

    return run


def _means(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The entries moved to the floored means of their parts; entries without parts stay."""
    sums = state.where("sums IS NOT NULL").select(F.posexplode("sums").alias("place", "value"))
    sums = sums.groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    total = np.zeros((*books.shape[:2], books.shape[2] + 1), object)
    for row in sums:
        total[np.unravel_index(row.place, total.shape)] = int(row.value)
    moved = books.copy()
    for part, entry in np.argwhere(total[:, :, 0] > 0):
        count, *values = total[part, entry]
        moved[part, entry] = [value // count for value in values]
    return moved


@dataclass
class Codes:
    """``books``: integers by part, entry and place; ``rows``: the keys, codes (a byte each part) and error."""

    books: np.ndarray
    rows: DataFrame

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, codec: Codec = CODEC, keys: tuple[str, ...] = ("vec_id", "label"), vector: str = "embedding") -> Codes:
    """Codebooks fitted on all vectors, and the code of each.

    Rows that ``integers`` leaves out are dropped, and so are vectors that have not as many components
    as the one of smallest key. The codebooks start as the parts of the rows of smallest first key;
    null keys come last and equal keys by their vectors. With fewer rows than entries there are
    as many entries as rows; without rows the codebooks are empty. Repeated rows are coded alike and
    count each time. Parts equally near to two entries take the first. Further columns are ignored.
    """
    rows, path = stored(integers(vectors, codec, keys, vector))
    spark = rows.sparkSession
    first = rows.orderBy(F.col(keys[0]).asc_nulls_last(), "packed")
    top = first.limit(1).collect()
    if not top:
        schema = f"{rows.drop('size', 'packed').schema.simpleString()[7:-1]},codes:binary,error:bigint"
        return Codes(np.zeros((codec.parts, 0, 0), np.int64), spark.createDataFrame([], schema))
    size = top[0]["size"]
    rows = rows.where(F.col("size") == size).drop("size")
    start = first.where(F.col("size") == size).limit(codec.entries).select("packed").collect()
    books = np.stack([np.frombuffer(r.packed, "<i4").astype(np.int64).reshape(codec.parts, -1) for r in start], axis=1)

    types = dict(rows.dtypes)
    named = ", ".join(f"`{k}` {types[k]}" for k in keys)
    state = rows.withColumn("codes", F.lit(bytes(codec.parts)))
    for _ in range(codec.rounds):
        schema = f"{named}, packed binary, codes binary, sums array<long>"
        new, new_path = stored(state.mapInArrow(_rounds(codec, books, False), schema))
        removed(spark, path)
        books, path = _means(new, books), new_path
        state = new.where("sums IS NULL").drop("sums")
    rows, _ = stored(state.mapInArrow(_rounds(codec, books, True), f"{named}, codes binary, error long"))
    removed(spark, path)
    return Codes(books, rows)


def decoded(rows: DataFrame, books: np.ndarray, codec: Codec = CODEC) -> DataFrame:
    """``rows`` with vector (array<double>): the entries of the codes, scaled back."""

    def run(batches):
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, len(books))
            values = books[np.arange(len(books)), codes.astype(np.int64)].reshape(len(codes), -1) / codec.scale
            yield batch.append_column("vector", pa.array(list(values), pa.list_(pa.float64())))

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(run, f"{schema}, vector array<double>")


def op13(spark, sf_dir: str) -> DataFrame:
    codes = compressed(table(spark, sf_dir, "embeddings"))
    total = F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")
    sums, _ = stored(codes.rows.groupBy(F.col("label").alias("of")).agg(total))
    rows = codes.rows.join(checked(sums), F.col("label").eqNullSafe(F.col("of")), "left")
    code = F.lower(F.hex("codes")).alias("code")
    return rows.select("vec_id", code, "error", "label_error", F.lit(codes.sha256).alias("codebooks_sha256"))


def _sql(codec: Codec) -> str:
    rounds = []
    for r in range(codec.rounds + 1):
        rounds.append(f"""
a{r} AS MATERIALIZED (
    SELECT vec_id, p, min(d) AS d, arg_min(e, d * {codec.entries} + e) AS e FROM (
        SELECT c.vec_id, c.p, b.e, sum((c.x - b.x) * (c.x - b.x))::BIGINT AS d
        FROM cells c JOIN b{r} b ON c.p = b.p AND c.i = b.i GROUP BY ALL)
    GROUP BY ALL
)""")
        if r < codec.rounds:
            rounds.append(f"""
b{r + 1} AS MATERIALIZED (
    SELECT b.p, b.e, b.i, coalesce(n.x, b.x) AS x FROM b{r} b LEFT JOIN (
        SELECT c.p, a.e, c.i, floor(sum(c.x) / count(*))::BIGINT AS x
        FROM cells c JOIN a{r} a ON c.vec_id = a.vec_id AND c.p = a.p GROUP BY ALL
    ) n ON b.p = n.p AND b.e = n.e AND b.i = n.i
)""")
    last = codec.rounds
    return f"""
WITH kept AS MATERIALIZED (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor({codec.scale} * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cells AS MATERIALIZED (
    SELECT vec_id, (k * {codec.parts}) // len(v) AS p, k % (len(v) // {codec.parts}) AS i, v[k + 1] AS x
    FROM (SELECT vec_id, v, unnest(range(len(v))) AS k FROM kept)
), b0 AS MATERIALIZED (
    SELECT c.p, f.e, c.i, c.x FROM cells c JOIN (
        SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {codec.entries}
    ) f ON c.vec_id = f.vec_id
),{",".join(rounds)}, coded AS (
    SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{last} GROUP BY vec_id
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
    (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, i)) FROM b{last}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""


OP13_SQL = _sql(CODEC)
