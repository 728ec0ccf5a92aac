"""Access-controlled retrieval and content-free logging."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries that one pass over the documents answers; their vectors are sent to all tasks.
QUERY_BLOCK = 4096
#: Documents compared at a time, and digits to which similarities are told apart.
DOCUMENT_BLOCK = 1024
DIGITS = 12


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two equally long numeric arrays, null for a zero vector."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def secure_retrieve(
    documents: DataFrame,
    query: Column,
    tenant: str,
    roles: Sequence[str],
    k: int = 5,
    key: str = "doc_id",
) -> DataFrame:
    """The ``k`` most similar documents a user may read, best first.

    ``documents`` has ``tenant_id``, ``allowed_roles`` and ``embedding``. Access is checked before
    any similarity is computed; the top-k keeps k rows per task.
    """
    allowed = documents.where(
        (F.col("tenant_id") == tenant)
        & F.arrays_overlap("allowed_roles", F.array(*[F.lit(r) for r in roles]))
    )
    scored = allowed.withColumn("similarity", cosine(F.col("embedding"), query))
    return scored.orderBy(F.desc_nulls_last("similarity"), key).limit(k)


@dataclass
class _Queries:
    """Queries of one block: keys, unit vectors by size, and the inverted list (tenant, role) to queries."""

    keys: list
    sizes: np.ndarray
    vectors: list[np.ndarray]
    allowed: dict[tuple, np.ndarray]

    @classmethod
    def of(cls, rows: pa.Table) -> _Queries:
        allowed: dict[tuple, list[int]] = {}
        for i, (tenant, roles) in enumerate(zip(rows.column("tenant_id").to_pylist(), rows.column("roles").to_pylist())):
            for role in set(roles or ()):
                if tenant is not None and role is not None:
                    allowed.setdefault((tenant, role), []).append(i)
        vectors = [_vector(v) for v in rows.column("embedding").to_pylist()]
        sizes = np.array([len(v) for v in vectors])
        return cls(rows.column("query_id").to_pylist(), sizes, vectors, {k: np.array(v) for k, v in allowed.items()})

    def readable(self, tenant, roles) -> np.ndarray:
        """The queries that may see a document, by union of its lists."""
        lists = [self.allowed[tenant, r] for r in set(roles or ()) if (tenant, r) in self.allowed]
        return np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.int64)


def _vector(values) -> np.ndarray:
    """Of length one; not a number where there is no direction."""
    vector = np.array([np.nan if x is None else x for x in values or ()], np.float64)
    norm = np.sqrt((vector * vector).sum())
    return vector / norm if norm > 0 else np.full(len(vector), np.nan)


def _best(similarity: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, those without a similarity last; equals by their ``order``."""
    filled = np.where(np.isnan(similarity), -np.inf, similarity)
    if len(filled) > k:
        least = np.partition(filled, len(filled) - k)[len(filled) - k]
        some = np.flatnonzero(filled >= least)
    else:
        some = np.arange(len(filled))
    return some[np.lexsort((order[some], -filled[some]))][:k]


def _retrieved(queries, k: int, query_kind: pa.DataType):
    def run(batches):
        kind = None
        known: _Queries = queries.value
        top: dict[int, tuple[list, np.ndarray]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, DOCUMENT_BLOCK):
                part = batch.slice(at, DOCUMENT_BLOCK)
                kind = part.schema.field("key").type
                keys = part.column("key").to_pylist()
                rank = np.empty(len(keys), np.int64)
                rank[sorted(range(len(keys)), key=lambda i: (keys[i] is None, keys[i]))] = np.arange(len(keys))
                # documents of one tenant and the same roles have the same readers
                groups: dict[tuple, list[int]] = {}
                for i, (tenant, roles) in enumerate(zip(part.column("tenant_id").to_pylist(), part.column("roles").to_pylist())):
                    groups.setdefault((tenant, frozenset(roles or ())), []).append(i)
                vectors = part.column("embedding").to_pylist()
                for (tenant, roles), own in groups.items():
                    readers = known.readable(tenant, roles)
                    if len(readers):
                        _compare(known, readers, [_vector(vectors[i]) for i in own], [keys[i] for i in own], rank[own], k, top)
        found = [(known.keys[q], key, s) for q, (held, similar) in top.items() for key, s in zip(held, similar)]
        if found:
            names, keys, similar = zip(*found)
            values = pa.array([None if np.isnan(s) else float(s) for s in similar], pa.float64())
            columns = [pa.array(names, query_kind), pa.array(keys, kind), values]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "key", "similarity"])

    return run


def _compare(known: _Queries, readers: np.ndarray, vectors: list, keys: list, rank: np.ndarray, k: int, top: dict) -> None:
    """Put what ``readers`` find among these documents into their best k."""
    sizes = np.array([len(v) for v in vectors])
    for size in np.unique(known.sizes[readers]):
        asking = readers[known.sizes[readers] == size]
        fits = np.flatnonzero(sizes == size)
        similar = np.full((len(asking), len(vectors)), np.nan)
        if len(fits) and size:
            similar[:, fits] = np.stack([known.vectors[q] for q in asking]) @ np.stack([vectors[i] for i in fits]).T
        similar = np.round(similar, DIGITS)
        for q, row in zip(asking.tolist(), similar):
            some = _best(row, rank, k)
            held, values = top.get(q, ([], np.zeros(0)))
            held, values = held + [keys[i] for i in some], np.concatenate([values, row[some]])
            order = np.empty(len(held), np.int64)
            order[sorted(range(len(held)), key=lambda i: (held[i] is None, held[i]))] = np.arange(len(held))
            best = _best(values, order, k)
            top[q] = ([held[i] for i in best], values[best])


def secure_retrieve_all(
    documents: DataFrame,
    queries: DataFrame,
    k: int = 5,
    key: str = "doc_id",
) -> DataFrame:
    """(query_id, place, key, similarity): for every query the ``k`` most similar documents it may read.

    ``documents`` has ``tenant_id``, ``allowed_roles`` and ``embedding``; ``queries`` has query_id,
    tenant_id, roles and embedding. As ``secure_retrieve`` for each query: access comes first, by an
    inverted list of (tenant, role), and only what it leaves is multiplied. Documents are not
    shuffled: each task keeps k rows a query, and those meet by query. Queries go out in blocks, one pass
    over the documents each. Vectors of another length than the query's, without a direction or with
    nulls have a null similarity and come last; equal similarities (to ``DIGITS`` digits) are ordered
    by key. Null tenants and roles are nobody's. query_id is unique.
    """
    spark = documents.sparkSession
    kinds, own = dict(queries.dtypes), dict(documents.dtypes)[key]
    ready = queries.select("query_id", "tenant_id", "roles", F.col("embedding").cast("array<double>").alias("embedding"))
    ready = ready.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-ready.count() // QUERY_BLOCK)))))
    blocks = [r.block for r in ready.select("block").distinct().orderBy("block").collect()]
    rows = documents.select(
        F.col(key).alias("key"), "tenant_id", F.col("allowed_roles").alias("roles"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    schema = f"query_id {kinds['query_id']}, key {own}, similarity double"
    found = spark.createDataFrame([], schema)
    for block in blocks:
        table = ready.where(F.col("block") == block).drop("block").toArrow()
        shared = spark.sparkContext.broadcast(_Queries.of(table))
        found = found.unionAll(rows.mapInArrow(_retrieved(shared, k, table.schema.field("query_id").type), schema))
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("similarity"), F.col("key").asc_nulls_last())
    placed = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return placed.select("query_id", (F.col("place") - 1).alias("place"), F.col("key").alias(key), "similarity")


def source_counts(retrieved: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, source_count) for every query, 0 where it may read nothing."""
    counts = retrieved.groupBy("query_id").agg(F.count("*").alias("n"))
    named = queries.select("query_id").distinct().join(counts, "query_id", "left")
    return named.select("query_id", F.coalesce("n", F.lit(0).cast("long")).alias("source_count"))


def source_count(retrieved: DataFrame) -> DataFrame:
    """What may be told to the caller: how many sources, not which."""
    return retrieved.agg(F.count("*").alias("source_count"))


def content_free_log(units: DataFrame, metadata: Sequence[str], text: str = "text") -> DataFrame:
    """Log rows with metadata columns and the text's length, never the text."""
    return units.select(*metadata, F.char_length(text).alias("n_chars"))
