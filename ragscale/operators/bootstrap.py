"""Distributed bootstrap confidence intervals.

Both estimators share one plan: rows are hash-partitioned on (group, salt) and
sorted, an Arrow task streams over one block at a time, and only replicate sums
leave the task. A group bigger than a task's fair share is salted over several
blocks whose replicate sums are added up by a normal aggregation, so no task
ever needs a whole hot group.

* ``poisson_ci``: every row gets a Poisson(1) weight per replicate from a hash
  of its key. Independent of partitioning and of row order.
* ``multinomial_ci``: n draws with replacement per replicate. The unit interval
  is halved until a part expects at most ``LEAF`` draws; fair bits, hashed from
  (tree node, counter, replicate), say how many draws of a node fall into its left
  half. The draws of a leaf are hashed from (leaf, counter, replicate) and fall on
  positions ``floor(u * n)``. A block reads the counts of its own leaves and makes
  their draws only, so all blocks together make each draw once.

Hashes are linear in two 31-bit numbers modulo the prime 2**31 - 1, with three random
coefficients for each replicate and lane, then scrambled; two lanes make one number of 62 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from ragscale.functions.hashing import stable_pair
from ragscale.operators.skew import hot_keys, is_small, join_same, shuffle_partitions, with_salt
from ragscale.schemas import BOOTSTRAP_RESAMPLES, BOOTSTRAP_SEED, CONFIDENCE_LEVEL
from ragscale.session import materialize

PRIME = (1 << 31) - 1
# Cumulative Poisson(1) probabilities, scaled to PRIME.
POISSON_CUTS = (790015084, 1580030168, 1975037710, 2106706891, 2139624186, 2146207645, 2147304888)
BLOCK_ROWS = 1 << 20
DRAW_BLOCK_ROWS = 1 << 18
LEAF = 1 << 12  # draws that a leaf of the tree expects at most; part of the rule, other values give other draws
BITS = 31  # fair bits of one hash
MOST_ROWS = BITS * PRIME  # rows of one group, beyond which the counters of a node would repeat
WEIGHTS, SPLITS, HIGH, LOW = range(4)  # lanes
_TILE = 64
_DRAW_CELLS = 1 << 18
_SLICE = 50  # replicates whose tree one row of the tree table stands for


def _fold(x: np.ndarray, spare: np.ndarray) -> None:
    """One in-place reduction step modulo PRIME, congruent but not yet canonical."""
    np.right_shift(x, np.uint64(31), out=spare)
    np.bitwise_and(x, np.uint64(PRIME), out=x)
    np.add(x, spare, out=x)


def _scramble(h: np.ndarray, x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """Two rounds of squaring modulo PRIME of ``h`` (below 2**32), using given buffers."""
    np.multiply(h, h, out=x)
    np.add(x, np.uint64(12345), out=x)
    _fold(x, spare)
    _fold(x, spare)
    np.multiply(x, x, out=x)
    np.add(x, h, out=x)
    _fold(x, spare)
    _fold(x, spare)
    u = x.astype(np.uint32)
    u[u >= np.uint32(PRIME)] -= np.uint32(PRIME)
    return u


def coefficients(lane: int, n_resamples: int, seed: int) -> np.ndarray:
    """Three numbers below PRIME for each replicate, the first two not 0."""
    digests = [hashlib.md5(f"{seed}-{lane}-{b}".encode()).hexdigest() for b in range(n_resamples)]
    a, b, c = (np.array([int(d[k:k + 10], 16) for d in digests], dtype=np.uint64) for k in (0, 10, 20))
    return np.stack([a % np.uint64(PRIME - 1) + np.uint64(1), b % np.uint64(PRIME - 1) + np.uint64(1), c % np.uint64(PRIME)])


def _buffers(*shape: int) -> list[np.ndarray]:
    return [np.empty(shape, dtype=np.uint64) for _ in range(3)]


def lane_hash(k1: np.ndarray, k2: np.ndarray, by: np.ndarray, buffers: list[np.ndarray] | None = None) -> np.ndarray:
    """Hashes below PRIME of pairs of numbers below PRIME, with coefficients that broadcast against them."""
    shape = np.broadcast_shapes(np.shape(k1), by[0].shape)
    h, x, spare = buffers or _buffers(*shape)
    np.multiply(k1, by[0], out=h)
    np.multiply(k2, by[1], out=x)
    np.add(h, x, out=h)
    np.add(h, by[2], out=h)  # below 2**63
    _fold(h, spare)
    _fold(h, spare)
    return _scramble(h, x, spare)


def poisson_weights(k1: np.ndarray, k2: np.ndarray, by: np.ndarray, buffers: list[np.ndarray] | None = None) -> np.ndarray:
    """Weight of every row (first axis) in every replicate (second axis)."""
    u = lane_hash(k1[:, None], k2[:, None], by[:, None, :], buffers and [b[:len(k1)] for b in buffers])
    weights = np.zeros(u.shape, dtype=np.int8)
    for cut in POISSON_CUTS:
        weights += (u >= np.uint32(cut)).view(np.int8)
    return weights


def _poisson_sums(k1: np.ndarray, k2: np.ndarray, values: np.ndarray, by: np.ndarray):
    n_resamples = by.shape[1]
    k1, k2 = ((k % PRIME).astype(np.uint64) for k in (k1, k2))
    buffers = _buffers(_TILE, n_resamples)
    total = np.zeros(n_resamples)
    sums = np.zeros((values.shape[1], n_resamples))
    for at in range(0, len(k1), _TILE):
        w = poisson_weights(k1[at:at + _TILE], k2[at:at + _TILE], by, buffers).astype(np.float64)
        total += w.sum(axis=0)
        sums += values[at:at + _TILE].T @ w
    return total, sums.T


def tree_levels(n_rows: int, leaf: int = LEAF) -> int:
    """Halvings after which a part of the unit interval expects at most ``leaf`` of ``n_rows`` draws."""
    return max(0, (-(-n_rows // leaf) - 1).bit_length())


def scaled(high: np.ndarray, low: np.ndarray, n_rows: int) -> np.ndarray:
    """``floor((high * PRIME + low) * n_rows / PRIME**2)``, exactly, for any ``n_rows`` below ``PRIME**2``."""
    high, low = high.astype(np.uint64), low.astype(np.uint64)
    prime, (n1, n0) = np.uint64(PRIME), (np.uint64(x) for x in divmod(n_rows, PRIME))
    return high * n1 + (high * n0 + low * n1 + low * n0 // prime) // prime


def split_counts(n_rows: int, by: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """How many of ``n_rows`` draws each leaf gets in one replicate, whose coefficients are ``by``."""
    counts = np.array([n_rows], dtype=np.int64)
    for level in range(tree_levels(n_rows, leaf)):
        words = -(-counts // BITS)
        at = np.concatenate([[0], np.cumsum(words)])
        node = np.repeat(np.arange(len(counts)) + (1 << level), words).astype(np.uint64)
        counter = (np.arange(at[-1]) - np.repeat(at[:-1], words)).astype(np.uint64)
        bits = lane_hash(counter, node, by[:, None])
        last = at[1:][words > 0] - 1  # a node's last hash gives the bits that are left
        bits[last] &= ((1 << (counts - BITS * (words - 1))[words > 0]) - 1).astype(np.uint32)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])
        left = ones[at[1:]] - ones[at[:-1]]
        counts = np.stack([left, counts - left], axis=1).ravel()
    return counts


def leaf_range(lo: int, hi: int, n_rows: int, levels: int) -> tuple[int, int]:
    """First and last leaf (inclusive) whose draws can fall on positions ``lo`` to ``hi`` (exclusive)."""
    return (lo << levels) // n_rows, min(((hi << levels) - 1) // n_rows, (1 << levels) - 1)


def leaf_draws(first: int, counts: np.ndarray, n_rows: int, levels: int, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Positions of the draws of consecutive leaves in one replicate, whose coefficients are ``high`` and ``low``."""
    leaf = np.repeat(np.arange(first, first + len(counts)), counts)
    counter = (np.arange(len(leaf)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.uint64)
    node = (leaf + (1 << levels)).astype(np.uint64)
    inside = scaled(lane_hash(counter, node, high[:, None]), lane_hash(counter, node, low[:, None]), n_rows)
    return (leaf.astype(np.uint64) * np.uint64(n_rows) + inside >> np.uint64(levels)).astype(np.int64)


def _draw_sums(lo: int, values: np.ndarray, n_rows: int, counts: np.ndarray | None, high: np.ndarray, low: np.ndarray):
    """Sums over the draws that fall on a block's consecutive positions, and their number, per replicate.

    ``counts`` (replicates x leaves of the block) is None for a group of a single leaf.
    """
    n_resamples, size = high.shape[1], len(values)
    total, sums = np.zeros(n_resamples), np.zeros((n_resamples, values.shape[1]))
    if counts is None:
        counter, node = np.arange(n_rows, dtype=np.uint64)[None, :], np.uint64(1)
        step = max(1, _DRAW_CELLS // n_rows)
        for b in range(0, n_resamples, step):
            h, w = (lane_hash(counter, node, x[:, b:b + step, None]) for x in (high, low))
            drawn = scaled(h, w, n_rows).astype(np.int64) - lo
            cell = drawn + size * np.arange(len(drawn))[:, None]
            times = np.bincount(cell[(drawn >= 0) & (drawn < size)], minlength=cell.shape[0] * size).reshape(-1, size)
            total[b:b + step] = times.sum(axis=1)
            sums[b:b + step] = times @ values
        return total, sums
    levels = tree_levels(n_rows)
    first, _ = leaf_range(lo, lo + size, n_rows, levels)
    for b in range(n_resamples):
        drawn = leaf_draws(first, counts[b], n_rows, levels, high[:, b], low[:, b]) - lo
        times = np.bincount(drawn[(drawn >= 0) & (drawn < size)], minlength=size)
        total[b] = times.sum()
        sums[b] = times @ values
    return total, sums


def _blocks(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Regroup sorted batches into one table per (keys, salt)."""
    pending: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        marks = np.zeros(batch.num_rows, dtype=bool)
        for i in range(n_keys + 1):
            codes = batch.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy()
            marks[1:] |= codes[1:] != codes[:-1]
        starts = [0, *np.flatnonzero(marks).tolist(), batch.num_rows]
        for lo, hi in zip(starts[:-1], starts[1:]):
            part = batch.slice(lo, hi - lo)
            if lo == 0 and pending and not _same_block(pending[-1], part, n_keys):
                yield pa.Table.from_batches(pending)
                pending = []
            elif lo > 0 and pending:
                yield pa.Table.from_batches(pending)
                pending = []
            pending.append(part)
    if pending:
        yield pa.Table.from_batches(pending)


def _same_block(a: pa.RecordBatch, b: pa.RecordBatch, n_keys: int) -> bool:
    return all(a.column(i)[0].as_py() == b.column(i)[0].as_py() for i in range(n_keys + 1))


def _intervals(total: np.ndarray, sums: np.ndarray, confidence: float) -> np.ndarray:
    live = total > 0
    alpha = 1.0 - confidence
    if not live.any():
        return np.full((2, sums.shape[1]), np.nan)
    return np.percentile(sums[live] / total[live, None], [100 * alpha / 2, 100 * (1 - alpha / 2)], axis=0)


def _resample(
    df: DataFrame, keys: list[str], metrics: list[str], salted: bool, sums_of: Callable, confidence: float,
) -> DataFrame:
    """Intervals per key as arrays ``lo`` and ``hi`` in metric order."""
    found = _block_sums(df, keys, metrics, salted, sums_of, confidence)
    return _bounds(found, keys, len(metrics), confidence) if salted else found


def _block_sums(
    df: DataFrame, keys: list[str], metrics: list[str], salted: bool, sums_of: Callable, confidence: float = CONFIDENCE_LEVEL,
) -> DataFrame:
    """Replicate sums of each block as arrays ``_w, _s0, ...`` if ``salted``; else each group is one block, and its intervals.

    ``df`` has columns keys, ``_salt``, ``_row``, ``_more``, ``_n``, ``_counts`` and the metrics. ``sums_of`` takes
    (both row keys, group size, counts, values) of a block and returns weights and sums. A row with key -1
    brings a block's counts. A row key that repeats inside a block, where rows of one key always meet, raises.
    """
    n_keys, n_metrics = len(keys), len(metrics)
    key_fields = [df.schema[k] for k in keys]
    arrays = ["_w", *[f"_s{i}" for i in range(n_metrics)]] if salted else ["_lo", "_hi"]
    out_schema = T.StructType(key_fields + [T.StructField(a, T.ArrayType(T.DoubleType())) for a in arrays])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, n_keys):
            first = block.slice(0, 1)
            counts = None
            if block.column(n_keys + 1)[0].as_py() == -1:
                counts, block = block.column(n_keys + 4)[0].values.to_numpy(), block.slice(1)
            row_keys, more = (block.column(n_keys + i).to_numpy() for i in (1, 2))
            if ((row_keys[1:] == row_keys[:-1]) & (more[1:] == more[:-1])).any():
                raise ValueError("the row key repeats inside a group; name columns that identify a record")
            values = np.column_stack([block.column(n_keys + 5 + i).to_numpy() for i in range(n_metrics)])
            total, sums = sums_of(row_keys, more, block.column(n_keys + 3)[0].as_py(), counts, values)
            if salted:
                lists = [total, *sums.T]
            else:
                lists = list(_intervals(total, sums, confidence))
            columns = [first.column(i).combine_chunks() for i in range(n_keys)]
            columns += [pa.array([a], type=pa.list_(pa.float64())) for a in lists]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, *arrays])

    columns = df.select(*keys, "_salt", "_row", "_more", "_n", "_counts", *metrics)
    ordered = columns.repartition(*keys, "_salt").sortWithinPartitions(*keys, "_salt", "_row", "_more")
    found = ordered.mapInArrow(run, out_schema)
    return found


def _bounds(found: DataFrame, keys: list[str], n_metrics: int, confidence: float) -> DataFrame:
    """Intervals as arrays ``_lo`` and ``_hi`` from parts with replicate sums ``_w, _s0, _s1, ...``, which are added up."""
    alpha = 1.0 - confidence
    points = F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))
    arrays = ["_w", *[f"_s{i}" for i in range(n_metrics)]]
    replicate = found.select(*keys, F.posexplode(F.arrays_zip(*arrays)).alias("_b", "_z")).groupBy(*keys, "_b")
    sums = replicate.agg(*[F.sum(f"_z.{a}").alias(a) for a in arrays]).where("_w > 0")
    bounds = sums.groupBy(*keys).agg(
        *[F.percentile(F.col(f"_s{i}") / F.col("_w"), points).alias(f"_p{i}") for i in range(n_metrics)]
    )
    return bounds.select(
        *keys,
        F.array(*[F.col(f"_p{i}")[0] for i in range(n_metrics)]).alias("_lo"),
        F.array(*[F.col(f"_p{i}")[1] for i in range(n_metrics)]).alias("_hi"),
    )


def combined_intervals(parts: DataFrame, stats: DataFrame, keys: list[str], metrics: list[str], confidence: float = CONFIDENCE_LEVEL) -> DataFrame:
    """``(keys, n, metric, mean, ci_lo, ci_hi, std)`` from stored replicate sums of parts of the groups and statistics as of ``metric_stats``."""
    return _finish(stats, keys, metrics, _bounds(parts, keys, len(metrics), confidence))


def metric_stats(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Row count, mean and sample standard deviation (0 for a single row), one row per key."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for m in metrics:
        aggs.append(F.avg(m).alias(f"{m}__mean"))
        aggs.append(F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}__std"))
    return df.groupBy(*keys).agg(*aggs)


def _finish(stats: DataFrame, keys: list[str], metrics: list[str], bounds: DataFrame) -> DataFrame:
    rows = [
        F.struct(
            F.lit(m).alias("metric"),
            F.col(f"{m}__mean").alias("mean"),
            F.col("_lo")[i].alias("ci_lo"),
            F.col("_hi")[i].alias("ci_hi"),
            F.col(f"{m}__std").alias("std"),
        )
        for i, m in enumerate(metrics)
    ]
    joined = join_same(stats, bounds, keys).select(*keys, "n", F.explode(F.array(*rows)).alias("_r"))
    return joined.select(*keys, "n", "_r.*")


def row_key_text(row_key: str | list[str]) -> Column:
    """One column for a record key of one or several columns; nulls are a value."""
    if isinstance(row_key, str):
        return F.col(row_key)
    if len(row_key) == 1:
        return F.col(row_key[0])
    return F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in row_key])


def _prepare(df: DataFrame, keys: list[str], metrics: list[str], *row: Column) -> DataFrame:
    return df.select(*keys, *[r.alias(name) for r, name in zip(row, ("_row", "_more"))], *[F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias(m) for m in metrics])


def poisson_ci(
    df: DataFrame, keys: list[str], metrics: list[str], row_key: str | list[str],
    n_resamples: int = BOOTSTRAP_RESAMPLES, confidence: float = CONFIDENCE_LEVEL,
    seed: int = BOOTSTRAP_SEED, block_rows: int = BLOCK_ROWS, stats: DataFrame | None = None,
) -> DataFrame:
    """``(keys, n, metric, mean, ci_lo, ci_hi, std)`` by the Poisson bootstrap.

    A missing metric counts as 0.0. ``row_key`` (one or several columns) identifies a
    row inside its group; 120 bits of its hash drive the weights, so the same rows give the same
    interval in any order. A key that repeats inside a group raises. ``stats`` (as of
    ``metric_stats``, written) saves computing them, which is the first of two reads.
    """
    data = _prepare(df, keys, metrics, *stable_pair(row_key_text(row_key)))
    if stats is None:
        stats = materialize(metric_stats(data, keys, metrics), "stats")
    hot = hot_keys(df, keys, block_rows, stats.select(*keys, F.col("n").alias("n_rows")))

    by = coefficients(WEIGHTS, n_resamples, seed)

    def sums_of(row_keys, more, n_rows, counts, values):
        return _poisson_sums(row_keys, more, values, by)

    salted = with_salt(data, keys, hot, "_row").withColumns({"_n": F.lit(0).cast("bigint"), "_counts": F.lit(None).cast("array<int>")})
    return _finish(stats, keys, metrics, _resample(salted, keys, metrics, hot is not None, sums_of, confidence))


def poisson_parts(data: DataFrame, keys: list[str], metrics: list[str], counts: DataFrame, n_resamples: int, seed: int, block_rows: int) -> DataFrame:
    """``keys, _w, _s0, _s1, ...``: replicate sums of weights and weighted metrics for parts of the groups, hot ones being split.

    ``data`` has keys, both halves of the row key (``_row, _more``) and the metrics; ``counts`` has ``n_rows`` of each group.
    """
    hot = hot_keys(data, keys, block_rows, counts)
    by = coefficients(WEIGHTS, n_resamples, seed)

    def sums_of(row_keys, more, n_rows, counted, values):
        return _poisson_sums(row_keys, more, values, by)

    salted = with_salt(data, keys, hot, "_row").withColumns({"_n": F.lit(0).cast("bigint"), "_counts": F.lit(None).cast("array<int>")})
    return _block_sums(salted, keys, metrics, True, sums_of)


def dense_positions(df: DataFrame, keys: list[str], order: str, position: str = "_pos", size: str = "_n") -> DataFrame:
    """Written rows with their position in ``order`` inside their group and the group's size.

    Ranges of (keys, order) are sorted apart; the ranges' sizes per group give the offsets.
    """
    ranged = df.repartitionByRange(shuffle_partitions(df), *keys, order).sortWithinPartitions(*keys, order)
    placed = materialize(ranged.withColumn("_mid", F.monotonically_increasing_id()), "positions")
    placed = placed.withColumn("_range", F.shiftright("_mid", 33))
    parts = placed.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_in"), F.min("_mid").alias("_first"))
    whole = Window.partitionBy(*keys)
    before = F.sum("_in").over(whole.orderBy("_range")) - F.col("_in")
    parts = materialize(parts.select(*keys, "_range", "_first", before.alias("_before"), F.sum("_in").over(whole).alias(size)), "offsets")
    joined = join_same(placed, F.broadcast(parts) if is_small(parts) else parts, [*keys, "_range"])
    return joined.withColumn(position, F.col("_before") + F.col("_mid") - F.col("_first")).select(*df.columns, position, size)


def block_counts(sizes: DataFrame, keys: list[str], n_resamples: int, seed: int, block_rows: int) -> DataFrame:
    """``keys, _salt, _counts``: for each block of the groups in ``sizes`` (``keys, _n``, more than a leaf each) the draws of its
    leaves, replicate after replicate.

    A group's tree is worked out once for each replicate, ``_SLICE`` replicates to a row of a table that is spread by group and
    slice; a task holds the leaves of one replicate.
    """
    slices = sizes.select(*keys, "_n", F.explode(F.sequence(F.lit(0), F.lit(n_resamples - 1), F.lit(_SLICE))).alias("_b"))
    spread = slices.repartition(shuffle_partitions(sizes), *keys, "_b")
    by, n_keys = coefficients(SPLITS, n_resamples, seed), len(keys)
    added = [T.StructField("_salt", T.LongType()), T.StructField("_b", T.IntegerType()), T.StructField("_some", T.ArrayType(T.IntegerType()))]
    schema = T.StructType([*[sizes.schema[k] for k in keys], *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n_rows, b = batch.column(n_keys)[i].as_py(), batch.column(n_keys + 1)[i].as_py()
                levels, n_blocks = tree_levels(n_rows), -(-n_rows // block_rows)
                spans = [leaf_range(s * block_rows, min((s + 1) * block_rows, n_rows), n_rows, levels) for s in range(n_blocks)]
                for replicate in range(b, min(b + _SLICE, n_resamples)):
                    counts = split_counts(n_rows, by[:, replicate]).astype(np.int32)
                    some = [pa.array(counts[lo:hi + 1]) for lo, hi in spans]
                    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, some)]), pa.int32()), pa.concat_arrays(some))
                    own = [pa.repeat(batch.column(k)[i], n_blocks) for k in range(n_keys)]
                    yield pa.record_batch([*own, pa.array(np.arange(n_blocks)), pa.array(np.full(n_blocks, replicate, np.int32)), lists], names=schema.names)

    parts = spread.mapInArrow(run, schema)
    gathered = F.sort_array(F.collect_list(F.struct("_b", "_some")))  # one entry for each replicate
    return parts.groupBy(*keys, "_salt").agg(F.flatten(F.transform(gathered, lambda p: p["_some"])).alias("_counts"))


def multinomial_ci(
    df: DataFrame, keys: list[str], metrics: list[str], row_key: str,
    n_resamples: int = BOOTSTRAP_RESAMPLES, confidence: float = CONFIDENCE_LEVEL,
    seed: int = BOOTSTRAP_SEED, block_rows: int = DRAW_BLOCK_ROWS,
) -> DataFrame:
    """Like ``poisson_ci`` with exactly n draws with replacement per replicate.

    ``row_key`` must be an integer that orders the rows of a group; one that repeats raises. One rule
    holds at every size: neither ``block_rows`` nor the number of partitions changes a draw. Each block makes
    the draws of its own leaves, so a replicate costs a group n draws and n / 31 hashes for each level of its
    tree, however many blocks it has. Groups of more than ``MOST_ROWS`` rows raise.
    """
    data = dense_positions(_prepare(df, keys, metrics, F.col(row_key).cast("bigint")), keys, "_row")
    repeats = data.groupBy(*keys, "_row").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1")
    if repeats.take(1):
        raise ValueError("the row key repeats inside a group; name a column that identifies a record")
    stats = materialize(metric_stats(data, keys, metrics), "stats")
    largest = stats.agg(F.max("n")).first()[0] or 0
    if largest > MOST_ROWS:
        raise ValueError(f"a group has {largest} rows; the counters of its draws reach to {MOST_ROWS}")
    salt = F.floor(F.col("_pos") / block_rows).cast("bigint")
    salted = data.select(*keys, *metrics, "_n", F.col("_pos").alias("_row"), F.lit(0).cast("bigint").alias("_more"), salt.alias("_salt"), F.lit(None).cast("array<int>").alias("_counts"))
    if largest > LEAF:
        counts = block_counts(stats.where(F.col("n") > LEAF).select(*keys, F.col("n").alias("_n")), keys, n_resamples, seed, block_rows)
        salted = salted.unionByName(counts.withColumns({"_row": F.lit(-1).cast("bigint"), "_more": F.lit(0).cast("bigint")}), allowMissingColumns=True)
    high, low = (coefficients(lane, n_resamples, seed) for lane in (HIGH, LOW))

    def sums_of(positions, more, n_rows, counts, values):
        return _draw_sums(int(positions[0]), values, n_rows, None if counts is None else counts.reshape(n_resamples, -1), high, low)

    return _finish(stats, keys, metrics, _resample(salted, keys, metrics, largest > block_rows, sums_of, confidence))
