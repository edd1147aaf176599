"""Exact search for the largest inner products, block by block."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creativeaudit.llm.common import packed

#: Vectors of one block; blocks that one task searches; queries that it searches them for.
BLOCK, BLOCKS, QUERIES = 1024, 64, 2048
BLOCK_SCHEMA = "dim int, low long, ids binary, data binary, high binary, least binary"


def _matrix(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of the usable vectors, their lengths, all their components) of a list column."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    length = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), -1), np.int64)
    values = np.asarray(pa.compute.fill_null(lists.flatten().cast(pa.float64()), np.nan))
    owner = np.repeat(np.arange(len(length)), np.maximum(length, 0))
    bad = length < 0
    bad[owner[~np.isfinite(values)]] = True
    return np.flatnonzero(~bad), length, values[~bad[owner]]


def blocks_of(vectors: DataFrame, size: int, scale: float) -> DataFrame:
    """Forward indexes of ``size`` neighbours each: ids, quantised components, and the maxima and minima of each term.

    Vectors that are null or hold a null or a component that isn't finite take
    no part, nor do those without an id. A block holds vectors of one length.
    """
    def build(batches):
        for batch in batches:
            at, length, values = _matrix(batch.column(1))
            if not len(at):
                continue
            ids = np.asarray(batch.column(0))[at]
            length = length[at]
            start = np.cumsum(length) - length
            for dim in np.unique(length):
                own = np.flatnonzero(length == dim)
                own = own[np.argsort(ids[own], kind="stable")]
                data = np.floor(scale * values[start[own][:, None] + np.arange(dim)])
                for i in range(0, len(own), size):
                    part = data[i:i + size]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([dim], pa.int32()), pa.array([ids[own[i]]], pa.int64()),
                        pa.array([packed(ids[own[i:i + size]].astype(np.int64))], pa.binary()), pa.array([packed(part)], pa.binary()),
                        pa.array([packed(part.max(axis=0))], pa.binary()), pa.array([packed(part.min(axis=0))], pa.binary())],
                        names=["dim", "low", "ids", "data", "high", "least"])

    rows = vectors.filter("vec_id IS NOT NULL")
    n = max(1, math.ceil(rows.count() / (8 * size)))
    return rows.repartitionByRange(n, "vec_id").sortWithinPartitions("vec_id").mapInArrow(build, BLOCK_SCHEMA)


def search(query_ids: np.ndarray, q: np.ndarray, ids: list, data: list, high: np.ndarray, least: np.ndarray,
           k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of some blocks for each query: (row of the query, id, score), best first.

    Each query takes the blocks in the order of its bounds, the sums of the
    largest each term can give; when the next bound is below its k-th score,
    no later block can matter. Equal bounds may still hold a smaller id.
    """
    n = len(query_ids)
    exact = np.abs(q).max(initial=0) * max(np.abs(high).max(initial=0), np.abs(least).max(initial=0)) * max(q.shape[1], 1) < 2.0 ** 53
    if exact:
        bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ least.T
    else:  # beyond what doubles add exactly: whole numbers of any size, and no bounds
        q, data = _whole(q), [_whole(d) for d in data]
        bound = np.full((n, len(ids)), np.inf)
    order = np.argsort(-bound, axis=1, kind="stable")
    kind = np.float64 if exact else object
    row, found, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)
    kth = np.full(n, -np.inf, dtype=kind)
    for r in range(order.shape[1]):
        block = order[:, r]
        alive = np.flatnonzero(bound[np.arange(n), block] >= kth)
        if not len(alive):
            break
        new = [(row, found, score)]
        for b in np.unique(block[alive]):
            who = alive[block[alive] == b]
            s = q[who] @ data[b].T
            s[query_ids[who][:, None] == ids[b]] = -np.inf
            least_useful = kth[who]
            if s.shape[1] > k:
                least_useful = np.maximum(least_useful, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
            i, j = np.nonzero((s >= least_useful[:, None]) & (s > -np.inf))
            new.append((who[i], ids[b][j], s[i, j]))
        row, found, score = (np.concatenate(x) for x in zip(*new))
        by = np.lexsort((found, -score, row))
        row, found, score = row[by], found[by], score[by]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        kth[row[nth == k - 1]] = score[nth == k - 1]
        row, found, score = row[nth < k], found[nth < k], score[nth < k]
    return row, found, score


def _whole(x: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in line] for line in x], dtype=object).reshape(x.shape)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, vec_id: str = "vec_id",
          embedding: str = "embedding") -> DataFrame:
    """Each query's ``k`` largest inner products with all other rows, equal ones by the smaller id.

    Components become floor(scale * x). Blocks of neighbours by id are searched
    in groups, queries too: a task gets one group of each, so its memory has a
    bound, and the best of each group of blocks meet at their query.

    Null vectors and those with null or infinite components or a null id take
    no part; vectors of another length than the query's aren't compared. Rows
    with a query's own id are not its candidates; a repeated query id asks once,
    with its smallest vector. Other repeated rows count each. Scores outside of
    the long range stand at its ends. Columns: query_id, rank, vec_id, score.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    asked = vectors.filter(is_query).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    asked = asked.filter(F.col("v").isNotNull() & finite).groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = blocks_of(rows, BLOCK, scale)
    queries = blocks_of(asked, QUERIES, scale)
    n_b = max(1, math.ceil(rows.count() / (BLOCK * BLOCKS)))
    n_q = max(1, math.ceil(asked.count() / QUERIES))
    spread = lambda n: F.pmod(F.xxhash64("low"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    blocks = blocks.select("*", spread(n_b).alias("b"), every(n_q).alias("q"))
    queries = queries.select("*", spread(n_q).alias("q"), every(n_b).alias("b"))

    def cell(asked: pa.Table, found: pa.Table) -> pa.Table:
        out: list[tuple] = []
        asked_by, found_by = asked.column("dim").to_pylist(), np.asarray(found.column("dim"))
        for i, dim in enumerate(asked_by):
            own = found.take(pa.array(np.flatnonzero(found_by == dim)))
            if not own.num_rows:
                continue
            load = lambda t, c, kind, at: [np.frombuffer(t.column(c)[j].as_py(), kind) for j in at]
            at = range(own.num_rows)
            qi = load(asked, "ids", np.int64, [i])[0]
            q = load(asked, "data", np.float64, [i])[0].reshape(len(qi), dim)
            ids = load(own, "ids", np.int64, at)
            data = [d.reshape(len(x), dim) for d, x in zip(load(own, "data", np.float64, at), ids)]
            high, least = (np.array(load(own, c, np.float64, at)).reshape(len(ids), dim) for c in ("high", "least"))
            row, vec, score = search(qi, q, ids, data, high, least, k)
            out.append((qi[row], vec, np.array([min(max(int(s), -2 ** 63), 2 ** 63 - 1) for s in score], np.int64)))
        parts = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table(parts, names=["query_id", "vec_id", "score"])

    found = queries.groupBy("q", "b").cogroup(blocks.groupBy("q", "b")).applyInArrow(
        cell, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
