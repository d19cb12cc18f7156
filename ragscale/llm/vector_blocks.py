"""Integer vectors in blocks that queries stream past.

A stated set of queries meets all rows in blocks: rows are dealt evenly over blocks of bounded size, queries are sent to every
block, and a task that holds one block lets the queries pass in slices. Shuffled are the rows once and the queries once for
each block; pairs of a query and a row exist inside a task only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ragscale.session import materialize

BLOCK_CELLS = 1 << 20  # components of a block's vectors
LEAST_ROWS = 1024  # smaller blocks aren't cut further to busy more tasks
TILE_CELLS = 1 << 21  # scores of a slice of queries against a block
MOST = 2.0**62  # squared lengths from here on could give scores beyond 64 bits


def integer_vectors(vectors: DataFrame, id: str, vector: str, scale: int = 256, **more: Column) -> DataFrame:
    """Written ``key, id, v, square`` and ``more`` of the rows with a whole vector: ``v`` has ``floor(scale * x)`` of each component.

    Rows whose vector is null or holds a null or a number that isn't finite are left out. ``key`` tells rows apart, also
    repeated ones; ``square`` is the squared length. Ids are integers or null.
    """
    there = vectors.select(F.col(id).cast("bigint").alias("id"), F.col(vector).alias("x"), *[c.alias(n) for n, c in more.items()])
    there = there.where(F.col("x").isNotNull()).withColumn("key", F.monotonically_increasing_id())
    names = ["key", "id", *more]
    rows = there.select(*names, F.col("x").cast("array<double>").alias("x"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(names))
            at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            values = lists.flatten()
            x = np.asarray(values.fill_null(np.nan).to_numpy(zero_copy_only=False), np.float64)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            whole = bad[at[1:]] == bad[at[:-1]]
            x = np.floor(np.where(np.isfinite(x), x, 0.0) * scale)
            total = np.concatenate([[0.0], np.cumsum(x * x)])
            square = np.add.reduceat(np.append(x * x, 0.0), at[:-1]) * (at[1:] > at[:-1]) if len(at) > 1 else total[:0]
            limit = float((1 << 31) - 1)
            v = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(np.clip(x, -limit, limit).astype(np.int32)))
            kept = pa.record_batch([*batch.columns[: len(names)], v, pa.array(square)], names=[*names, "v", "square"])
            yield kept.filter(pa.array(whole))

    fields = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names)
    return materialize(rows.mapInArrow(task, f"{fields}, v array<int>, square double"), "integers")


def measure(rows: DataFrame) -> tuple[int, int, float, int]:
    """Number of vectors, components of the longest, largest squared length, largest component without its sign.

    Raises if a score could leave 64 bits.
    """
    size = F.max(F.size("v"))
    top = F.max(F.greatest(F.coalesce(F.array_max("v"), F.lit(0)), -F.coalesce(F.array_min("v"), F.lit(0))))
    n, longest, square, component = rows.agg(F.count(F.lit(1)), size, F.max("square"), top).first()
    if (square or 0.0) >= MOST:
        raise ValueError("vectors are too long for scores of 64 bits")
    return n, longest or 0, square or 0.0, component or 0


def block_count(df: DataFrame, n: int, longest: int, cells: int = BLOCK_CELLS, least_rows: int = LEAST_ROWS) -> int:
    """As many blocks as their size asks for, and more while tasks would be idle and blocks don't get tiny."""
    wanted = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-n * max(longest, 1) // cells), min(wanted, -(-n // least_rows)))


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of integers, shorter vectors filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = column.offsets.to_numpy()
    sizes = np.diff(at)
    values = column.values.to_numpy()[at[0] : at[-1]]
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int32)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(at[:-1] - at[0], sizes)] = values
    return out


def by_id(block: pa.Table) -> pa.Table:
    """Rows in ascending order of id, null last: of equal scores the first is the one that counts."""
    return block.sort_by([("id", "ascending")])


def ids_of(block: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids (0 for null), and which are there."""
    column = block.column("id").combine_chunks()
    return column.fill_null(0).to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)


def past_blocks(rows: DataFrame, queries: DataFrame, n_blocks: int, build: Callable, answer: Callable, schema: str, tile_cells: int = TILE_CELLS) -> DataFrame:
    """``answer(build(rows of a block), queries)`` of every block and all queries, in slices of ``tile_cells`` scores.

    Both frames have the same columns. Both functions take an Arrow table; ``answer`` returns a table of ``schema``.
    """
    block = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_blocks)).cast("int")
    placed = rows.select(block.alias("_block"), F.lit(0).alias("_kind"), *rows.columns)
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("_block"), F.lit(1).alias("_kind"), *rows.columns)
    parts = min(n_blocks, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_blocks // 4)))
    together = placed.unionByName(asked).repartition(parts, "_block").sortWithinPartitions("_block", "_kind")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, state = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            blocks, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
                if blocks[lo] != at:
                    at, held, state = blocks[lo], [], None
                part = batch.slice(lo, hi - lo)
                if kinds[lo] == 0:
                    held.append(part)
                    continue
                if not held:  # a block without rows
                    continue
                if state is None:
                    table = by_id(pa.Table.from_batches(held))
                    state, n = build(table), table.num_rows
                step = max(1, tile_cells // n)
                for k in range(0, part.num_rows, step):
                    yield from answer(state, pa.Table.from_batches([part.slice(k, step)])).to_batches()

    return together.mapInArrow(task, schema)


def first_of_each(query: np.ndarray, row: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` pairs of each query by descending score, equal ones by ascending row."""
    order = np.lexsort((row, -score, query))
    return order[rank_in_group(query[order]) < k]


def rank_in_group(group: np.ndarray) -> np.ndarray:
    """Place of each entry among the equal ones of a sorted array."""
    if not len(group):
        return np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    return np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))
