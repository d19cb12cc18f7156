"""Nearest-chunk search over embedding vectors.

Chunks are grouped into cells around pivot vectors; a query visits only cells
that can hold one of its k nearest chunks. Neighbouring cells share a block, to
which a query goes once with a bit for each cell it visits there; cells bigger than
a block are split. A (query slice, chunk block) pair meets in one task that multiplies
two bounded matrices and lets out k rows per query, so candidate pairs are never
rows of a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from ragscale.functions.hashing import stable_key
from ragscale.operators.skew import hot_keys, replicated, with_salt
from ragscale.schemas import TOP_K
from ragscale.session import materialize

BLOCK_ROWS = 1 << 16
BLOCK_CELLS = 1 << 23  # components of a block; longer vectors make fewer rows
LEAST_ROWS = 1 << 13  # smaller blocks copy more than they spread
MAX_PIVOTS = 4096  # pivots the driver and each task hold; cells of larger collections are split into blocks
DIGITS = 9  # scores closer than this count as equal; the smaller id comes first
_TILE_COLUMNS, _TILE_CELLS = 1 << 12, 1 << 22


def unit_matrix(column, unit: bool = True) -> np.ndarray:
    """A list<float> Arrow column as a float64 matrix, rows scaled to length 1 for cosine."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    sizes = np.diff(np.asarray(column.offsets))
    if column.null_count or (sizes != sizes[:1]).any() or not np.isfinite(flat).all():
        raise ValueError("vectors must all have the same length and finite numbers")
    m = flat.reshape(len(column), -1)
    if unit:
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
    return m


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    sq = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(sq, 0.0))


def lists_of(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


def _assign(chunks: DataFrame, pivots: np.ndarray, vector: str, unit: bool) -> DataFrame:
    """Adds the nearest pivot ``_cell`` and the distance to it."""
    at = chunks.columns.index(vector)
    schema = T.StructType(chunks.schema.fields + [
        T.StructField("_cell", T.IntegerType()), T.StructField("_dist", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = distances(unit_matrix(batch.column(at), unit), pivots)
            cell = d.argmin(axis=1)
            extra = [pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(cell)), cell])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=schema.names)

    return chunks.mapInArrow(run, schema)


def visited(queries: DataFrame, pivots: np.ndarray, vector: str, unit: bool, nprobe: int,
            radius: np.ndarray | None = None) -> DataFrame:
    """One row per query and cell to visit.

    Without ``radius``: the ``nprobe`` nearest cells. With it: every other cell
    that may hold a chunk within the query's ``_reach``.
    """
    at = queries.columns.index(vector)
    reach_at = queries.columns.index("_reach") if radius is not None else -1
    schema = T.StructType(queries.schema.fields + [T.StructField("_cells", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = distances(unit_matrix(batch.column(at), unit), pivots)
            near = np.argsort(d, axis=1, kind="stable")
            if radius is None:
                cells = list(near[:, :nprobe].astype(np.int32))
            else:
                reach = batch.column(reach_at).to_numpy(zero_copy_only=False)
                open_cells = d - radius[None, :] <= np.nan_to_num(reach, nan=np.inf)[:, None] + 1e-9
                np.put_along_axis(open_cells, near[:, :nprobe], False, axis=1)
                cells = [np.flatnonzero(row).astype(np.int32) for row in open_cells]
            yield pa.RecordBatch.from_arrays([*batch.columns, lists_of(cells, pa.int32())], names=schema.names)

    found = queries.mapInArrow(run, schema)
    return found.withColumn("_cell", F.explode("_cells")).drop("_cells", *(["_reach"] if radius is not None else []))


def best_rows(
    q: np.ndarray, part: Callable[[int, int], np.ndarray], starts: np.ndarray, opened: np.ndarray, id_rank: np.ndarray, k: int,
    least: np.ndarray, score: Callable[[np.ndarray, np.ndarray], np.ndarray], margin: float = 0.0,
    exact: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``query, chunk, score`` (positions) of the k best chunks of each query, ties by ``id_rank``.

    Chunks lie cell by cell from ``starts`` on, ``part(from, to)`` gives some of them; a query meets the cells ``opened`` for it
    and only scores of at least ``least`` count. A tile's ``score`` may be off by ``margin``: what passes is scored again
    by ``exact(queries, chunks)`` on positions. Only the k best so far are kept, so that memory is bounded by a tile.
    """
    out = []
    columns = min(max(_TILE_COLUMNS, 160 * k), _TILE_CELLS)  # more chunks a tile where more are kept
    tile = _TILE_CELLS // columns
    for at in range(0, len(q), tile):
        n = min(tile, len(q) - at)
        low = least[at:at + n].copy()
        held_s, held_c = np.full((n, k), -np.inf), np.full((n, k), -1)
        for cell in range(len(starts) - 1):
            rows = np.flatnonzero(opened[at:at + n, cell])
            if not len(rows):
                continue
            some = q[at:at + n] if len(rows) == n else q[at + rows]
            for lo in range(starts[cell], starts[cell + 1], columns):
                hi = min(lo + columns, starts[cell + 1])
                s = score(some, part(lo, hi))
                cut = low[rows]
                if hi - lo > k and np.isneginf(cut).any():  # no bound yet: the k-th score here
                    free = np.flatnonzero(np.isneginf(cut))
                    cut[free] = np.partition(s[free], hi - lo - k, axis=1)[:, hi - lo - k] - margin
                r, c = np.divmod(np.flatnonzero(s >= (cut - margin).astype(s.dtype)[:, None]), hi - lo)
                if not len(r):
                    continue
                new = s[r, c] if exact is None else exact(at + rows[r], lo + c)
                r, c = rows[r], lo + c
                who = np.unique(r)
                old_r, old_k = np.nonzero(held_c[who] >= 0)
                old_r = who[old_r]
                r, c, new = np.concatenate([old_r, r]), np.concatenate([held_c[old_r, old_k], c]), np.concatenate([held_s[old_r, old_k], new])
                order = np.lexsort((id_rank[c], -new, r))
                r, c, new = r[order], c[order], new[order]
                first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
                place = np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r))))
                keep = place < k
                held_s[r[keep], place[keep]], held_c[r[keep], place[keep]] = new[keep], c[keep]
                full = held_c[who, k - 1] >= 0
                low[who[full]] = np.maximum(low[who[full]], held_s[who[full], k - 1])
        r, place = np.nonzero((held_c >= 0) & (held_s >= least[at:at + n, None]))
        out.append((at + r, held_c[r, place], held_s[r, place]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def id_ranks(ids: pa.Array) -> np.ndarray:
    return np.argsort(np.argsort(np.array(ids.to_pylist()), kind="stable"), kind="stable")


def block_rows_for(n: int, width: int, most: int, cores: int) -> int:
    """Rows of a block: few copies of either side, but some eight pairs of blocks for each core."""
    return max(1, min(most, max(LEAST_ROWS, int(n / (8 * cores) ** 0.5)), BLOCK_CELLS // max(1, width)))


def pack_cells(sizes: list[tuple[int, int]], n_cells: int, rows: int) -> np.ndarray:
    """The first cell of each block and ``n_cells``: cells in a row of at most ``rows`` rows, at least one. ``sizes``: (cell, its rows)."""
    count = np.zeros(n_cells, np.int64)
    for cell, n in sizes:
        count[cell] = n
    bounds, total = [0], 0
    for cell in range(n_cells):
        if total and total + count[cell] > rows:
            bounds.append(cell)
            total = 0
        total += count[cell]
    return np.array([*bounds, n_cells])


def routed(queries: DataFrame, pivots: np.ndarray, bounds: np.ndarray, vector: str, unit: bool, nprobe: int, radius: np.ndarray | None = None) -> DataFrame:
    """One row per query and block to visit, ``_open`` with a bit for each cell of the block.

    Without ``radius``: the ``nprobe`` nearest cells. With it: every other cell
    that may hold a chunk within the query's ``_reach``.
    """
    at = queries.columns.index(vector)
    reach_at = queries.columns.index("_reach") if radius is not None else -1
    schema = T.StructType([*queries.schema.fields, T.StructField("_block", T.IntegerType()), T.StructField("_open", T.BinaryType())])
    n_blocks = len(bounds) - 1
    width = -(-int(np.diff(bounds).max()) // 8)
    step = max(1, (1 << 16) // n_blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                d = distances(unit_matrix(batch.column(at), unit), pivots)
                near = np.argsort(d, axis=1, kind="stable")[:, :nprobe]
                if radius is None:
                    opened = np.zeros(d.shape, bool)
                    np.put_along_axis(opened, near, True, axis=1)
                else:
                    reach = batch.column(reach_at).to_numpy(zero_copy_only=False)
                    opened = d - radius[None, :] <= np.nan_to_num(reach, nan=np.inf)[:, None] + 1e-9
                    np.put_along_axis(opened, near, False, axis=1)
                for block in range(n_blocks):
                    mine = opened[:, bounds[block]:bounds[block + 1]]
                    rows = np.flatnonzero(mine.any(axis=1))
                    if not len(rows):
                        continue
                    bits = np.zeros((len(rows), width), np.uint8)
                    packed = np.packbits(mine[rows], axis=1)
                    bits[:, :packed.shape[1]] = packed
                    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
                    mask = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(bits.tobytes())])
                    columns = [c.take(pa.array(rows)) for c in batch.columns]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(rows), block, np.int32)), mask], names=schema.names)

    found = queries.mapInArrow(run, schema)
    return found.drop("_reach") if radius is not None else found


def in_blocks(chunks: DataFrame, bounds: np.ndarray) -> DataFrame:
    """Adds the ``_block`` of each chunk's ``_cell``."""
    firsts = F.array(*[F.lit(int(b)) for b in bounds[1:-1]]).cast("array<int>")
    return chunks.withColumn("_block", F.size(F.filter(firsts, lambda b: b <= F.col("_cell"))))


def opened_cells(masks: pa.Array, n_cells: int) -> np.ndarray:
    """``_open`` as a table of queries and cells."""
    bits = np.frombuffer(b"".join(masks.to_pylist()), np.uint8).reshape(len(masks), -1)
    return np.unpackbits(bits, axis=1, count=n_cells).astype(bool)


def meeting(visits: DataFrame, chunks: DataFrame, by: list[str], query_id: str, chunk_id: str, query_rows: int,
            chunk_rows: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with the keys of bounded groups in which every visit meets every chunk of its block once."""
    keys = [*by, "_block"]
    hot_chunks = hot_keys(chunks, keys, chunk_rows, fair=chunk_rows)
    hot_visits = hot_keys(visits, keys, query_rows, fair=query_rows)
    left = with_salt(visits, keys, hot_visits, query_id, "_qs")
    right = with_salt(chunks, keys, hot_chunks, chunk_id, "_cs")
    return replicated(left, keys, hot_chunks, "_cs"), replicated(right, keys, hot_visits, "_qs"), [*keys, "_cs", "_qs"]


def _search(visits: DataFrame, chunks: DataFrame, bounds: np.ndarray, by: list[str], query_id: str, chunk_id: str,
            vector: str, k: int, cosine: bool, block_rows: int) -> DataFrame:
    """Best k per query and block of the visited cells; a query's ``_least``, where there is one, is the lowest score that counts."""
    left, right, group = meeting(visits, in_blocks(chunks, bounds), by, query_id, chunk_id, block_rows, block_rows)
    schema = T.StructType([
        T.StructField(query_id, visits.schema[query_id].dataType),
        T.StructField(chunk_id, chunks.schema[chunk_id].dataType),
        T.StructField("score", T.DoubleType()),
    ])
    bounded = "_least" in visits.columns

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        q_ids, c_ids = a.column(query_id).combine_chunks(), b.column(chunk_id).combine_chunks()
        if a.num_rows == 0 or b.num_rows == 0:
            return pa.table([q_ids.slice(0, 0), c_ids.slice(0, 0), pa.array([], pa.float64())], names=schema.names)
        block = a.column("_block")[0].as_py()
        cell = b.column("_cell").to_numpy() - bounds[block]
        order = np.argsort(cell, kind="stable")
        n_cells = int(bounds[block + 1] - bounds[block])
        starts = np.searchsorted(cell[order], np.arange(n_cells + 1))
        q, c = unit_matrix(a.column(vector), cosine), unit_matrix(b.column("_vector"), cosine)[order]
        c_ids = c_ids.take(pa.array(order))
        least = a.column("_least").to_numpy() if bounded else np.full(len(q), -np.inf)
        least = np.nan_to_num(least.astype(np.float64), nan=-np.inf, neginf=-np.inf)
        told = opened_cells(a.column("_open").combine_chunks(), n_cells)
        if cosine:  # products of short numbers find what may count, which is then multiplied in full
            short_q, short_c = q.astype(np.float32), c.astype(np.float32)

            def full(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                cuts = range(0, len(i), 1 << 16)
                parts = [np.einsum("ij,ij->i", q[i[x:x + (1 << 16)]], c[j[x:x + (1 << 16)]]) for x in cuts]
                return np.round(np.concatenate(parts), DIGITS)

            margin = (q.shape[1] + 8) * 2.0 ** -22
            row, pick, score = best_rows(short_q, lambda lo, hi: short_c[lo:hi], starts, told, id_ranks(c_ids), k, least,
                                         lambda x, y: x @ y.T, margin, full)
        else:
            row, pick, score = best_rows(q, lambda lo, hi: c[lo:hi], starts, told, id_ranks(c_ids), k, least,
                                         lambda x, y: np.round(-distances(x, y) ** 2, DIGITS))
        return pa.table([q_ids.take(pa.array(row)), c_ids.take(pa.array(pick)), pa.array(score)], names=schema.names)

    lq = left.select(*group, query_id, vector, "_open", *(["_least"] if bounded else []))
    theirs = [f"_at_{g}" for g in group]  # both sides may come from one table
    rc = right.select(*[F.col(g).alias(t) for g, t in zip(group, theirs)], F.col(chunk_id).alias(chunk_id), F.col("_cell").alias("_cell"), F.col(vector).alias("_vector"))
    return lq.groupBy(*group).cogroup(rc.groupBy(*theirs)).applyInArrow(run, schema)


def search_cells(
    queries: DataFrame, placed: DataFrame, pivots: np.ndarray, by: list[str], query_id: str, chunk_id: str, vector: str, k: int,
    nprobe: int, block_rows: int = BLOCK_ROWS, cosine: bool = True,
) -> DataFrame:
    """``(query, chunk, score, rank)`` over the chunks (with ``_cell``) of the ``nprobe`` cells next to each query."""
    n, largest = _cell_sizes(placed, by)
    rows = block_rows_for(n, pivots.shape[1], block_rows, placed.sparkSession.sparkContext.defaultParallelism)
    bounds = pack_cells(largest, len(pivots), rows)
    visits = routed(queries, pivots, bounds, vector, cosine, nprobe)
    return ranked(_search(visits, placed, bounds, by, query_id, chunk_id, vector, k, cosine, rows), query_id, chunk_id, k)


def _cell_sizes(placed: DataFrame, by: list[str]) -> tuple[int, list[tuple[int, int]]]:
    """All rows, and each cell's rows in the collection that has most of it: one row per pivot reaches the driver."""
    sizes = placed.groupBy(*by, "_cell").agg(F.count(F.lit(1)).alias("n_rows"))
    found = sizes.groupBy("_cell").agg(F.max("n_rows").alias("most"), F.sum("n_rows").alias("n")).collect()
    return sum(r["n"] for r in found), [(r["_cell"], r["most"]) for r in found]


def ranked(found: DataFrame, query_id: str, chunk_id: str, k: int) -> DataFrame:
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), chunk_id)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def topk_vectors(
    queries: DataFrame, chunks: DataFrame, k: int = TOP_K, by: list[str] | None = None,
    query_id: str = "query_id", chunk_id: str = "chunk_id", vector: str = "embedding", metric: str = "cosine",
    nprobe: int | None = None, cells: int | None = None, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The k most similar chunks per query: ``(query, chunk, score, rank)``.

    With ``by`` a query meets only chunks of its own collection. Exact unless
    ``nprobe`` is given, which limits the search to that many nearest cells.
    Rows without a vector match nothing and are left out; vectors of another
    length or with numbers that are not finite raise.
    Score is the cosine, or minus the squared distance for ``metric="l2"``.
    """
    by = by or []
    cosine = metric == "cosine"
    full = F.col(vector).isNotNull() & ~F.exists(F.coalesce(F.col(vector), F.array()), lambda x: x.isNull())
    queries, chunks = queries.where(full), chunks.where(full)
    n = chunks.count()
    n_cells = cells or int(min(MAX_PIVOTS, max(1, -(-n // block_rows), int(n**0.5) if n > block_rows else 1)))
    picked = chunks.select(vector, stable_key(chunk_id).alias("_k"), chunk_id).orderBy("_k", chunk_id).limit(n_cells)
    rows = [r[vector] for r in picked.collect()]
    queries = queries.select(query_id, *by, vector)
    chunks = chunks.select(chunk_id, *by, vector)
    width = len(rows[0]) if rows else 1
    block_rows = block_rows_for(n, width, block_rows, chunks.sparkSession.sparkContext.defaultParallelism)
    if len(rows) <= 1:
        visits = queries.withColumn("_block", F.lit(0)).withColumn("_open", F.unhex(F.lit("80")))
        found = _search(visits, chunks.withColumn("_cell", F.lit(0)), np.array([0, 1]), by, query_id, chunk_id, vector, k, cosine, block_rows)
        return ranked(found, query_id, chunk_id, k)
    pivots = np.asarray(rows, dtype=np.float64)
    if cosine:
        norm = np.linalg.norm(pivots, axis=1, keepdims=True)
        pivots = np.divide(pivots, norm, out=np.zeros_like(pivots), where=norm > 0)
    placed = materialize(_assign(chunks, pivots, vector, cosine), "placed")  # read three times below
    # at most one row per pivot reaches the driver
    per_cell = placed.groupBy(*by, "_cell").agg(F.count(F.lit(1)).alias("n_rows"), F.max("_dist").alias("radius"))
    per_cell = per_cell.groupBy("_cell").agg(F.max("n_rows").alias("most"), F.max("radius").alias("radius")).collect()
    bounds = pack_cells([(r["_cell"], r["most"]) for r in per_cell], len(pivots), block_rows)
    probe = nprobe or 1
    near = _search(routed(queries, pivots, bounds, vector, cosine, probe), placed, bounds, by, query_id, chunk_id, vector, k,
                   cosine, block_rows)
    if nprobe:
        return ranked(near, query_id, chunk_id, k)
    radius = np.full(len(pivots), -np.inf)
    for row in per_cell:
        radius[row["_cell"]] = row["radius"]
    first = materialize(ranked(near, query_id, chunk_id, k), "nearest")
    kth = first.where(F.col("rank") == k).select(query_id, F.col("score").alias("_least"))
    gap = F.lit(2.0) - F.lit(2.0) * F.col("_least") if cosine else -F.col("_least")
    slack = F.lit(10.0 ** -DIGITS * 4)
    # fewer than k found so far: no bound, every cell is open
    reach = F.when(F.col("_least").isNotNull(), F.sqrt(F.greatest(gap, F.lit(0.0)) + slack))
    bounded = queries.join(kth, query_id, "left").withColumn("_reach", reach)
    rest = routed(bounded, pivots, bounds, vector, cosine, probe, radius)
    far = _search(rest, placed, bounds, by, query_id, chunk_id, vector, k, cosine, block_rows)
    return ranked(first.drop("rank").unionByName(far), query_id, chunk_id, k)


def recall_at_k(exact: DataFrame, approximate: DataFrame, query_id: str, chunk_id: str) -> DataFrame:
    """Share of the exact neighbours an approximate search found, per query."""
    hit = approximate.select(query_id, chunk_id, F.lit(1).alias("_hit"))
    return exact.join(hit, [query_id, chunk_id], "left").groupBy(query_id).agg(
        F.count(F.lit(1)).alias("n_exact"), F.count("_hit").alias("n_found"),
        (F.count("_hit") / F.count(F.lit(1))).alias("recall"),
    )
