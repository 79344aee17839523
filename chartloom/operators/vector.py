"""Vector search: exact, in blocks of queries, and through hashed buckets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.functions.vectors import cosine, valid_vector
from chartloom.operators.lexical import SCOPE, narrow, pairs_in_scope, ranked

SCHEMA = "query_id bigint, chunk_id bigint, score double"


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


#: So many scores are held at once in a task.
MAX_CELLS = 4_000_000


def _scan(held, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, scopes = held.value
        queries = queries / np.linalg.norm(queries, axis=1, keepdims=True)
        best: tuple[np.ndarray, np.ndarray] | None = None  # scores and ids, a row for each query
        step = max(1, MAX_CELLS // len(ids))
        for batch in (whole.slice(i, step) for whole in batches for i in range(0, whole.num_rows, step)):
            m = _matrix(batch.column(1))
            scores = queries @ (m / np.linalg.norm(m, axis=1, keepdims=True)).T
            for name, wanted in scopes.items():
                scores[_outside(wanted, batch.column(name).to_pylist())] = -np.inf
            rows = np.broadcast_to(batch.column(0).to_numpy(), scores.shape)
            if best is not None:
                scores, rows = np.hstack([best[0], scores]), np.hstack([best[1], rows])
            # Rounded scores, then the smaller id: the order of the final ranking, so nothing that it needs is lost.
            order = np.lexsort((rows, -np.round(scores, 9)), axis=1)[:, :top]
            best = np.take_along_axis(scores, order, 1), np.take_along_axis(rows, order, 1)
        if best is not None:
            n, flat = best[0].shape[1], best[0].ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n), pa.int64()), pa.array(best[1].ravel(), pa.int64()), pa.array(flat, pa.float64())], ["query_id", "chunk_id", "score"]).filter(pa.array(np.isfinite(flat)))

    return run


def _outside(wanted: list, values: list) -> np.ndarray:
    """For each query and row whether the query is limited to another value than the row's; a null row is outside any limit."""
    number = {v: i for i, v in enumerate({*wanted, *values} - {None})}
    q, r = (np.array([number.get(v, -1) for v in x]) for x in (wanted, values))
    return (q[:, None] >= 0) & (q[:, None] != r[None, :])


def vector_top(queries: DataFrame, chunks: DataFrame, top: int = 60, block: int = 4096, scoped: bool = False) -> DataFrame:
    """(query_id, chunk_id, score, rank): the chunks with the highest cosine to each query's vector.

    With ``scoped`` both sides have the columns SCOPE, and only chunks with a query's values are scored for it: queries within a
    patient or admission are joined with its chunks, and only the others go over all of them.

    ``queries`` has query_id and vector, ``chunks`` has chunk_id and vector, all of one length. Null vectors, those with
    NaN and all-zero ones give nothing. The queries are a stated set: they are held against all chunks in blocks of
    ``block``, and each task sends on only its own best ``top`` for each query.
    """
    spark = chunks.sparkSession
    limits = SCOPE if scoped else ()
    rows = chunks.where(valid_vector(F.col("vector"))).select(F.col("chunk_id").cast("long").alias("chunk_id"), "vector", *limits)
    asks = queries.where(valid_vector(F.col("vector"))).select("query_id", "vector", *limits)
    parts = []
    if scoped:
        near = pairs_in_scope(asks.where(narrow()).withColumnRenamed("vector", "q"), rows)
        parts.append(near.select("query_id", "chunk_id", cosine(F.col("vector"), F.col("q")).alias("score")))
        asks, limits = asks.where(~narrow()), ("note_type",)
    wanted = iter(asks.toLocalIterator())
    while batch := list(islice(wanted, block)):
        held = spark.sparkContext.broadcast((np.array([r.query_id for r in batch], np.int64), np.array([r.vector for r in batch], np.float64), {c: [r[c] for r in batch] for c in limits}))
        parts.append(rows.mapInArrow(_scan(held, top), SCHEMA))
    if not parts:
        return spark.createDataFrame([], SCHEMA + ", rank bigint")
    return ranked(reduce(DataFrame.unionByName, parts), "score", top)


def _planes(dim: int, tables: int, bits: int, seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(tables * bits, dim))


def _buckets(tables: int, bits: int, flips: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _matrix(batch.column(1))
            side = (m @ _planes(m.shape[1], tables, bits).T).reshape(len(m), tables, bits)
            code = ((side > 0) << np.arange(bits)).sum(2)
            # Neighbouring buckets: the bits whose planes lie closest are turned over, one at a time and in pairs.
            near = np.argsort(np.abs(side), axis=2)[:, :, :flips]
            keys = [code] + [code ^ (1 << near[:, :, i]) for i in range(flips)]
            keys += [code ^ (1 << near[:, :, i]) ^ (1 << near[:, :, j]) for i in range(flips) for j in range(i)]
            all_keys = np.stack(keys, 2) + (np.arange(tables)[None, :, None] << bits)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(all_keys.reshape(len(m), -1).tolist(), pa.list_(pa.int64()))], ["chunk_id", "vector", "keys"])

    return run


def lsh_top(queries: DataFrame, chunks: DataFrame, top: int = 10, tables: int = 12, bits: int = 7, flips: int = 4) -> DataFrame:
    """(query_id, chunk_id, score, rank): as ``vector_top``, among the chunks that share a hash bucket with the query.

    Every chunk is in one bucket of each table; a query also looks into the buckets next to its own.
    """
    kind = "chunk_id bigint, vector array<float>, keys array<bigint>"
    rows = chunks.where(valid_vector(F.col("vector"))).select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("vector").cast("array<float>").alias("vector"))
    asks = queries.where(valid_vector(F.col("vector"))).select(F.col("query_id").cast("long").alias("chunk_id"), F.col("vector").cast("array<float>").alias("vector"))
    index = rows.mapInArrow(_buckets(tables, bits, 0), kind).select("chunk_id", F.explode("keys").alias("key"))
    probes = asks.mapInArrow(_buckets(tables, bits, flips), kind).select(F.col("chunk_id").alias("query_id"), F.explode("keys").alias("key"))
    pairs = probes.join(index, "key").select("query_id", "chunk_id").distinct()
    scored = pairs.join(rows, "chunk_id").join(asks.select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("q")), "query_id")
    return ranked(scored.select("query_id", "chunk_id", cosine(F.col("vector"), F.col("q")).alias("score")), "score", top)
