"""Exact cosine search of a set of query vectors, in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernlode.operators.best import Best

#: Query vectors that are sent to the tasks at once; more of them go in several rounds.
QUERY_BLOCK = 8192
#: Queries that a task multiplies with a batch at once.
STRIPE = 256
#: More than rounding to 6 places changes.
EDGE = 1e-6
#: Number of a stripe's first query, ids of a batch's rows, similarities.
Stripe = tuple[int, np.ndarray, np.ndarray]


def usable(vector: str, dim: int) -> Column:
    """Right length, no null or NaN entry, not all zero."""
    v = F.col(vector)
    return (
        (F.size(v) == dim)
        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")))
        & F.exists(v, lambda x: x != 0)
    )


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _stripes(batches: Iterator[pa.RecordBatch], q_unit: np.ndarray, dim: int) -> Iterator[Stripe]:
    for batch in batches:
        if batch.num_rows:
            row_ids, unit = batch.column(0).to_numpy(), _unit(_matrix(batch.column(1), dim))
            for a in range(0, len(q_unit), STRIPE):
                yield a, row_ids, q_unit[a : a + STRIPE] @ unit.T


def cosine_top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    id_col: str = "id",
    query_col: str = "query_id",
    vector_col: str = "embedding",
    dim: int = 64,
    min_similarity: float = -1.0,
) -> DataFrame:
    """(query_col, id_col, similarity, rank): the k most similar rows of each query, exactly.

    Similarities are rounded to 6 places; ties go to the lower id. Vectors that are null, zero, of
    another length or with null entries take no part, as rows or as queries; ids may be any long.
    Every task keeps only its own k best of each query before anything is shuffled.
    """

    def run(q_ids: np.ndarray, stripes: Iterator[Stripe]) -> Iterator[list[np.ndarray]]:
        best = Best(len(q_ids), k, min_similarity)
        for a, row_ids, s in stripes:
            least = best.floor[a : a + STRIPE, None] - EDGE
            keep = s >= least
            many = np.flatnonzero(np.count_nonzero(keep, axis=1) > 4 * k)
            if len(many):  # all that may tie with the k-th best of the batch stay
                part = s[many]
                keep[many] &= part >= np.partition(part, part.shape[1] - k, axis=1)[:, [part.shape[1] - k]] - EDGE
            x, y = np.nonzero(keep)
            best.add(x + a, np.round(s[x, y], 6), row_ids[y])
        q, s, ids = best.best()
        yield [q_ids[q], ids, s]

    found = _products(vectors, queries, id_col, query_col, vector_col, dim, run)
    if not found:
        return queries.sparkSession.createDataFrame([], f"{query_col} long, {id_col} long, similarity double, rank int")
    scored = reduce(DataFrame.unionByName, found)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "id"))
    top = scored.withColumn("rank", rank).where(F.col("rank") <= k)
    return top.select(F.col("q").alias(query_col), F.col("id").alias(id_col), "similarity", "rank")


def count_above(
    vectors: DataFrame,
    queries: DataFrame,
    min_similarity: float,
    id_col: str = "id",
    query_col: str = "query_id",
    vector_col: str = "embedding",
    dim: int = 64,
) -> DataFrame:
    """(query_col, above): how many rows are at least so similar to each query that has any; counts
    of a batch, not its hits, are shuffled. Vectors and rounding as in cosine_top_k()."""

    def run(q_ids: np.ndarray, stripes: Iterator[Stripe]) -> Iterator[list[np.ndarray]]:
        for a, _, s in stripes:
            n = (np.round(s, 6) >= min_similarity).sum(axis=1)
            some = np.flatnonzero(n)
            yield [q_ids[a + some], n[some].astype(np.int64), np.zeros(len(some))]

    found = _products(vectors, queries, id_col, query_col, vector_col, dim, run)
    if not found:
        return queries.sparkSession.createDataFrame([], f"{query_col} long, above long")
    return reduce(DataFrame.unionByName, found).groupBy(F.col("q").alias(query_col)).agg(F.sum("id").alias("above"))


def _products(
    vectors: DataFrame, queries: DataFrame, id_col: str, query_col: str, vector_col: str, dim: int,
    take: Callable[[np.ndarray, Iterator[Stripe]], Iterator[list[np.ndarray]]],
) -> list[DataFrame]:
    """What take(query ids, stripes) makes of a task's similarities, as (q, id, similarity)."""
    rows = vectors.where(usable(vector_col, dim)).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")
    )
    asked = queries.where(usable(vector_col, dim)).select(
        F.col(query_col).cast("long").alias("q"), F.col(vector_col).cast("array<double>").alias("v")
    )
    n = asked.count()
    rounds = max(1, -(-n // QUERY_BLOCK))
    found = []
    for r in range(rounds):  # one round unless the query set is very large
        part = asked.where(F.pmod(F.xxhash64("q"), F.lit(rounds)) == r).toArrow() if n else None
        if part is None or not part.num_rows:
            continue
        ids = part["q"].to_numpy()
        unit = _unit(_matrix(part["v"].combine_chunks(), dim))
        shared = vectors.sparkSession.sparkContext.broadcast((ids, unit))  # QUERY_BLOCK vectors at most, about

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            q_ids, q_unit = shared.value
            for cols in take(q_ids, _stripes(batches, q_unit, dim)):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["q", "id", "similarity"])

        found.append(rows.mapInArrow(run, "q long, id long, similarity double"))
    return found
