"""Exact top-k inner products by columnar branch-and-bound.

Vectors are packed into blocks in vertical layout (one row for each dimension). For every pair of a query block and a
candidate block, products are summed dimension block by dimension block; what the remaining dimensions can still add
is at most the product of the two remaining masses (Cauchy-Schwarz), so pairs that cannot reach the query's k-th best
score are dropped and the survivors compacted before the next dimension block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

K = 5
#: Values are floor(SCALE * x).
SCALE = 256
#: Vectors in a candidate block and in a query block; blocks of either kind that one task compares.
ROWS, QUERY_ROWS = 4096, 256
SIDE = 16
#: Dimensions summed between two rounds of bounding.
DIMENSIONS = 16


def quantised(vector: Column) -> Column:
    """floor(256 x) of every component; NULL for a vector that is NULL, empty or holds NULL or non-finite components."""
    doubles = vector.cast("array<double>")
    sound = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(sound & (F.size(doubles) > 0), F.transform(doubles, lambda x: F.floor(x * SCALE).cast("long")))


def packed(vectors: DataFrame, rows: int) -> DataFrame:
    """Blocks ``(width, n, ids, data)`` of vectors of one width in vertical layout; every input row is in one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(ids: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([data.shape[1]], pa.int32()), pa.array([len(ids)], pa.int32()),
                 pa.array([ids.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(data.T).tobytes()], pa.binary())],
                ["width", "n", "ids", "data"])

        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            values = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            for width in np.unique(sizes):
                own = np.flatnonzero(sizes == width)
                data = values[starts[own][:, None] + np.arange(width)]
                parts = held.setdefault(int(width), [])
                parts.append((ids[own], data))
                if sum(len(p[0]) for p in parts) >= rows:
                    all_ids, all_data = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                    full = len(all_ids) // rows * rows
                    for k in range(0, full, rows):
                        yield block(all_ids[k:k + rows], all_data[k:k + rows])
                    held[int(width)] = [(all_ids[full:], all_data[full:])]
        for parts in held.values():
            ids = np.concatenate([p[0] for p in parts])
            if len(ids):
                yield block(ids, np.concatenate([p[1] for p in parts]))

    return vectors.mapInArrow(run, "width int, n int, ids binary, data binary")


def branch_and_bound(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """``(query id, vector id, score)`` of the ``k`` best distinct other ids for each query; both sides are (dimension, row).

    Ties go to the smaller id; rows with one id count once, with their best score.
    """
    width = len(queries)
    cuts = list(range(0, width, DIMENSIONS))
    # Integers up to 2**53 are exact as doubles; larger products are summed as Python integers would be, in int64.
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * width
    kind = np.float64 if most < 2 ** 53 else np.int64
    queries, rows = queries.astype(kind), rows.astype(kind)
    mass = [np.sqrt((rows[c:].astype(np.float64) ** 2).sum(axis=0)) for c in cuts] + [np.zeros(rows.shape[1])]
    for q, own_id in enumerate(query_ids):
        one = queries[:, q]
        left = np.flatnonzero(ids != own_id)
        score = np.zeros(len(left), kind)
        for n, c in enumerate(cuts):
            part = slice(c, c + DIMENSIONS)
            score = score + one[part] @ (rows[part] if len(left) == rows.shape[1] else rows[part][:, left])
            rest = np.sqrt((one[c + DIMENSIONS:].astype(np.float64) ** 2).sum()) * mass[n + 1][left] * (1 + 1e-9) + 1e-6
            if len(left) > k and n + 1 < len(cuts):
                floor = kth_distinct(score - rest, ids[left], k)
                stay = score + rest >= floor
                if stay.sum() < 0.7 * len(left):
                    left, score = left[stay], score[stay]
        for vec_id, value in best(score, ids[left], k):
            yield int(own_id), vec_id, value


def kth_distinct(values: np.ndarray, ids: np.ndarray, k: int) -> float:
    """A value that ``k`` different ids reach at least, or minus infinity."""
    take = k
    while take <= len(values):
        top = np.argpartition(values, len(values) - take)[len(values) - take:]
        if len(np.unique(ids[top])) >= k:
            return values[top].min()
        take *= 4
    return -np.inf


def best(score: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    floor = kth_distinct(score, ids, k)
    near = np.flatnonzero(score >= floor) if np.isfinite(floor) else np.arange(len(score))
    order = near[np.lexsort((ids[near], -score[near]))]
    found: dict[int, int] = {}
    for i in order:
        found.setdefault(int(ids[i]), int(score[i]))
        if len(found) == k:
            break
    return list(found.items())


def top_k(queries: DataFrame, vectors: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding",
          query_id_col: str | None = None, query_vector_col: str | None = None) -> DataFrame:
    """The ``k`` best inner products for every query: ``query_id, rank, vec_id, score``, ranks from 1.

    Every candidate row takes part but those that bear the query's own id. Ties go to the smaller id. Vectors that are
    NULL, empty or hold NULL or non-finite components, and rows without an id, take no part; only vectors of one width
    are compared. Rows that repeat an id count once, with their best score. Queries and candidates are cut into blocks;
    the blocks meet on a grid of cells, each of which gets a bounded number of blocks of either side.
    """
    spark = vectors.sparkSession

    def sound(df: DataFrame, key: str, vector: str) -> DataFrame:
        return df.select(F.col(key).cast("long").alias("id"), quantised(F.col(vector)).alias("v")).filter(
            F.col("id").isNotNull() & F.col("v").isNotNull())

    asked = packed(sound(queries, query_id_col or id_col, query_vector_col or vector_col), QUERY_ROWS)
    rows = packed(sound(vectors, id_col, vector_col), ROWS)
    parts = spark.sparkContext.defaultParallelism
    # The grid: so many groups that a cell has about SIDE blocks of a side, and enough cells for all cores.
    n_query = max(1, asked.count() // SIDE)
    n_rows = max(1, rows.count() // SIDE, -(-2 * parts // n_query))
    deal = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")
    left = asked.select("width", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), deal(n_query).alias("q_part"),
                        F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))).alias("part"))
    right = rows.select("width", "ids", "data", deal(n_rows).alias("part"),
                        F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))).alias("q_part"))
    cells = left.join(right.hint("shuffle_hash"), ["width", "q_part", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, q_ids, q_data, ids, data in zip(*(c.to_pylist() for c in batch.columns)):
                shape = (width, -1)
                found = list(branch_and_bound(
                    np.frombuffer(q_data, np.int64).reshape(shape), np.frombuffer(q_ids, np.int64),
                    np.frombuffer(data, np.int64).reshape(shape), np.frombuffer(ids, np.int64), k))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[i] for f in found], pa.int64()) for i in range(3)], ["query_id", "vec_id", "score"])

    near = cells.select("width", "q_ids", "q_data", "ids", "data").mapInArrow(run, "query_id long, vec_id long, score long")
    merged = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
