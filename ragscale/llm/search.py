"""Exact top-k search by no-random-access aggregation over sorted component lists.

A block of rows is kept as one sorted list for each component. For a query the lists of its positive components are read from
the top and those of its negative ones from the bottom, all in step. What has been read so far bounds every row's score:
read components count as they are, unread ones at most as much as the list's frontier and at least as much as its far end.
Reading stops when few rows can still reach the k-th lower bound; only their scores are resolved. All queries of a slice
read the same stretches, so their bounds are two matrix products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ragscale.llm.vector_blocks import block_count, first_of_each, ids_of, integer_vectors, matrix, measure, past_blocks

DEPTHS = (0.25, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)  # shares of the lists read by the ends of the rounds
RESOLVED = 1 / 32  # share of a block whose scores are resolved instead of reading on


class SortedLists:
    """A block's components as sorted lists, and what the rounds have read of them from either end."""

    def __init__(self, m: np.ndarray, depths: tuple[float, ...] = DEPTHS):
        self.vectors = m
        n = len(m)
        order = np.argsort(m, axis=0, kind="stable")
        values = np.take_along_axis(m, order, axis=0)
        low, high = np.full_like(m, np.inf), np.full_like(m, -np.inf)
        self.rounds: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        done = 0
        for depth in depths:
            to = min(n, max(done, int(np.ceil(depth * n))))
            np.put_along_axis(low, order[done:to], values[done:to], axis=0)
            np.put_along_axis(high, order[n - to : n - done], values[n - to : n - done], axis=0)
            floor, ceiling = values[to - 1], values[n - to]  # frontiers of the lists read upwards and downwards
            left = to < n
            self.rounds.append((np.maximum(high, ceiling), np.minimum(low, floor), left * (ceiling - values[0]), left * (values[-1] - floor)))
            done = to

    def bounds(self, number: int, rising: np.ndarray, falling: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper bounds (queries x rows) after a round, and how far the lower bounds lie below them at most, per query."""
        high, low, above, below = self.rounds[number]
        return rising @ high.T + falling @ low.T, rising @ above - falling @ below


def best_of_block(lists: SortedLists, queries: np.ndarray, own: np.ndarray, k: int, resolved: float = RESOLVED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and score of each query's best ``k`` rows; ``own`` marks rows that take no part. Rows are in order of id."""
    m, n = lists.vectors, len(lists.vectors)
    rising, falling = np.maximum(queries, 0), np.minimum(queries, 0)
    k = min(k, n)
    reach = np.full(len(queries), -np.inf)  # k-th lower bound
    open_ = np.arange(len(queries))
    out = []
    last = len(lists.rounds) - 1
    for number in range(last + 1):
        upper, slack = lists.bounds(number, rising[open_], falling[open_])
        upper[own[open_]] = -np.inf
        leaders = np.argpartition(upper, n - k, axis=1)[:, n - k :]
        kth = upper[np.arange(len(open_))[:, None], leaders].min(axis=1)
        known = resolve(queries, m, np.repeat(open_, k), leaders.ravel()).reshape(-1, k)
        known[np.take_along_axis(own[open_], leaders, axis=1)] = -np.inf
        reach[open_] = np.maximum(reach[open_], np.maximum(kth - slack, known.min(axis=1)))
        able = (upper >= reach[open_][:, None]) & (upper > -np.inf)
        stop = np.flatnonzero((able.sum(axis=1) <= max(4 * k, resolved * n)) | (number == last))
        query, row = np.nonzero(able[stop])
        score = upper[stop[query], row] if number == last else resolve(queries, m, open_[stop][query], row)
        query = open_[stop][query]
        keep = first_of_each(query, row, score, k)
        out.append((query[keep], row[keep], score[keep]))
        open_ = np.delete(open_, stop)
        if not len(open_):
            break
    return tuple(np.concatenate(parts) for parts in zip(*out))


def resolve(queries: np.ndarray, m: np.ndarray, query: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Scores of pairs."""
    out = np.empty(len(query), m.dtype)
    for at in range(0, len(query), 1 << 14):
        out[at : at + (1 << 14)] = np.einsum("ij,ij->i", queries[query[at : at + (1 << 14)]], m[row[at : at + (1 << 14)]])
    return out


def exact_topk(queries: DataFrame, rows: DataFrame, k: int = 5, id: str = "vec_id", vector: str = "embedding", scale: int = 256, cells: int | None = None) -> DataFrame:
    """``query_id, rank, <id>, score``: each query's ``k`` rows with the highest integer inner product of ``floor(scale * x)``.

    Equal scores go by smaller id (null last); rows with the query's id take no part, a row with a null id is nobody's own. Vectors
    that are null or hold a null or a number that isn't finite take no part on either side. Shorter vectors count as filled
    up with zeros; vectors too long for 53-bit sums raise. Repeated rows count each, repeated queries are answered each. No
    queries or no rows give no rows. Other columns are not read.
    """
    held = integer_vectors(rows, id, vector, scale)
    asked = integer_vectors(queries, id, vector, scale)
    n, width, square, top = measure(held)
    _, other_width, other_square, other_top = measure(asked)
    width = max(width, other_width, 1)
    most = float(width) * top * other_top  # bounds put components of different rows together
    if most >= 2.0**53:
        raise ValueError("vectors are too long for exact bounds in 53 bits")
    kind = np.float32 if most < 2.0**24 else np.float64  # sums of integers below are exact
    blocks = block_count(held, n, width) if cells is None else block_count(held, n, width, cells, 1)

    def build(block: pa.Table):
        return SortedLists(matrix(block.column("v"), width).astype(kind)), *ids_of(block), block.column("id").combine_chunks()

    def answer(state, some: pa.Table) -> pa.Table:
        lists, ids, there, column = state
        mine, have = ids_of(some)
        own = (mine[:, None] == ids[None, :]) & have[:, None] & there[None, :]
        query, row, score = best_of_block(lists, matrix(some.column("v"), width).astype(kind), own, k)
        take = pa.array(query)
        names = ["key", "query_id", "row_id", "score"]
        return pa.table([some.column("key").combine_chunks().take(take), some.column("id").combine_chunks().take(take), column.take(pa.array(row)), pa.array(score.astype(np.int64))], names=names)

    columns = ["key", "id", "v"]
    found = past_blocks(held.select(*columns), asked.select(*columns), blocks, build, answer, "key bigint, query_id bigint, row_id bigint, score bigint")
    first = Window.partitionBy("key").orderBy(F.desc("score"), F.col("row_id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("row_id").alias(id), "score")
