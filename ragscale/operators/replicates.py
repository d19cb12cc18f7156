"""Replicate vectors of configurations as a table, and what can be told from them pairwise and along curves.

A row key's weight in a replicate is the same in every configuration. Keyed by the query, the replicate means of two
configurations over the same queries move together, and their differences, replicate by replicate, give the interval of the
difference itself; comparing two intervals for overlap would count what both share twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from ragscale.functions.hashing import stable_pair
from ragscale.operators.bootstrap import BLOCK_ROWS, poisson_parts, row_key_text
from ragscale.operators.curves import axis_position
from ragscale.operators.skew import join_same
from ragscale.schemas import BOOTSTRAP_RESAMPLES, BOOTSTRAP_SEED, CONFIDENCE_LEVEL, PRACTICAL_DELTA, QUANT_AXIS
from ragscale.session import materialize

PATTERNS = ["rising", "falling", "flat", "indeterminate"]
SAME = 1e-12  # residuals that are closer count as equal


def per_query(df: DataFrame, keys: list[str], metrics: list[str], query: str = "query_id") -> DataFrame:
    """Mean of each metric per configuration and query; a missing score counts as 0.0."""
    return df.groupBy(*keys, query).agg(*[F.avg(F.coalesce(F.col(m).cast("double"), F.lit(0.0))).alias(m) for m in metrics])


def replicate_vectors(
    df: DataFrame, keys: list[str], metrics: list[str], row_key: str | list[str], n_resamples: int = BOOTSTRAP_RESAMPLES,
    seed: int = BOOTSTRAP_SEED, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Written ``(keys, metric, mean, replicates)``: the mean and its value in every replicate of the Poisson bootstrap.

    A replicate in which no row has a weight is null. ``row_key`` is unique inside a configuration and names the same
    thing in all of them. A missing metric counts as 0.0.
    """
    row = stable_pair(row_key_text(row_key))
    data = df.select(*keys, *[r.alias(n) for r, n in zip(row, ("_row", "_more"))], *[F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias(m) for m in metrics])
    means = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in metrics])
    means = materialize(means, "means")
    parts = poisson_parts(data, keys, metrics, means.select(*keys, F.col("n").alias("n_rows")), n_resamples, seed, block_rows)
    arrays = ["_w", *[f"_s{i}" for i in range(len(metrics))]]
    added = parts.select(*keys, F.posexplode(F.arrays_zip(*arrays)).alias("_b", "_z")).groupBy(*keys, "_b").agg(*[F.sum(f"_z.{a}").alias(a) for a in arrays])
    values = [F.when(F.col("_w") > 0, F.col(f"_s{i}") / F.col("_w")).alias(f"r{i}") for i in range(len(metrics))]
    gathered = added.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_b", *values))).alias("_all"))  # one entry for each replicate
    rows = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("mean"), F.col("_all").getField(f"r{i}").alias("replicates")) for i, m in enumerate(metrics)]
    joined = join_same(gathered, means, keys)
    return materialize(joined.select(*keys, F.explode(F.array(*rows)).alias("_r")).select(*keys, "_r.*"), "replicates")


def _quantile(ordered: Column, share: float) -> Column:
    at = (F.size(ordered) - 1) * F.lit(share)
    low = F.floor(at).cast("int")
    here, there = F.get(ordered, low), F.get(ordered, F.least(low + 1, F.size(ordered) - 1))
    return here + (there - here) * (at - low)


def with_interval(df: DataFrame, values: Column, confidence: float = CONFIDENCE_LEVEL) -> DataFrame:
    """Adds ``ci_lo`` and ``ci_hi`` of an array of replicate values, nulls left out."""
    alpha = 1.0 - confidence
    ordered = df.withColumn("_ordered", F.array_sort(F.filter(values, lambda x: x.isNotNull())))
    return ordered.withColumns({"ci_lo": _quantile(F.col("_ordered"), alpha / 2), "ci_hi": _quantile(F.col("_ordered"), 1 - alpha / 2)}).drop("_ordered")


def differences(left: DataFrame, right: DataFrame, on: list[str], confidence: float = CONFIDENCE_LEVEL) -> DataFrame:
    """Rows of ``left`` with ``other_mean``, ``delta``, its interval and ``differs`` (the interval leaves out 0), against the row
    of ``right`` with the same keys ``on``; rows without one drop out."""
    other = right.select(*on, F.col("mean").alias("other_mean"), F.col("replicates").alias("_other"))
    joined = join_same(left, other, on).withColumn("delta", F.col("mean") - F.col("other_mean"))
    moved = F.zip_with("replicates", "_other", lambda a, b: a - b)
    out = with_interval(joined, moved, confidence).drop("replicates", "_other")
    return out.withColumn("differs", (F.col("ci_lo") > 0) | (F.col("ci_hi") < 0))


def baseline_differences(vectors: DataFrame, keys: list[str], baseline: str = QUANT_AXIS[-1], axis: str = "quantization", confidence: float = CONFIDENCE_LEVEL) -> DataFrame:
    """Every other point of a curve against its baseline point; ``practical`` if the difference is large as well."""
    rest = [k for k in keys if k != axis] + ["metric"]
    base = vectors.where(F.col(axis) == baseline)
    found = differences(vectors.where(~F.col(axis).eqNullSafe(F.lit(baseline))), base, rest, confidence)
    return found.withColumn("practical", F.col("differs") & (F.abs("delta") > PRACTICAL_DELTA))


def pair_differences(vectors: DataFrame, pairs: list[tuple[str, str]], keys: list[str], model: str = "model", confidence: float = CONFIDENCE_LEVEL) -> DataFrame:
    """Declared model pairs at equal other keys: ``<model>`` is the first of a pair, ``other`` the second."""
    wanted = vectors.sparkSession.createDataFrame(pairs, f"{model} string, other string")
    left = vectors.join(F.broadcast(wanted), model)
    rest = [k for k in keys if k != model] + ["metric"]
    right = vectors.select(F.col(model).alias("other"), *rest, "mean", "replicates")
    return differences(left, right, ["other", *rest], confidence)


def isotonic(values: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Least-squares non-decreasing fit of each row by pooling adjacent violators; where ``there`` is false a point is missing."""
    n, points = values.shape
    sums, sizes = np.zeros((n, points)), np.zeros((n, points))
    top = np.full(n, -1)
    rows = np.arange(n)
    starts = np.zeros((n, points), int)
    for j in range(points):
        new = rows[there[:, j]]
        top[new] += 1
        sums[new, top[new]], sizes[new, top[new]], starts[new, top[new]] = values[new, j], 1.0, j
        while len(new):
            new = new[top[new] > 0]
            last = top[new]
            falls = sums[new, last - 1] * sizes[new, last] > sums[new, last] * sizes[new, last - 1]
            new, last = new[falls], last[falls]
            sums[new, last - 1] += sums[new, last]
            sizes[new, last - 1] += sizes[new, last]
            top[new] -= 1
    fit = np.full((n, points), np.nan)
    for b in range(points):
        have = rows[top >= b]
        end = np.where(top[have] > b, starts[have, np.minimum(b + 1, points - 1)], points)
        for j in range(points):
            inside = (j >= starts[have, b]) & (j < end) & there[have, j]
            fit[have[inside], j] = sums[have[inside], b] / sizes[have[inside], b]
    return fit


def shapes(values: np.ndarray, delta: float) -> np.ndarray:
    """Number in PATTERNS of each row; nan points are missing."""
    there = np.isfinite(values)
    up, down = isotonic(values, there), -isotonic(-values, there)
    loss = [np.nansum((values - f) ** 2, axis=1) for f in (up, down)]
    span = [np.nanmax(np.where(there.any(axis=1)[:, None], f, 0), axis=1) - np.nanmin(np.where(there.any(axis=1)[:, None], f, 0), axis=1) for f in (up, down)]
    rises, falls = loss[0] < loss[1] - SAME, loss[1] < loss[0] - SAME
    out = np.where(rises, 0, np.where(falls, 1, 3))
    flat = np.where(rises, span[0], np.where(falls, span[1], np.maximum(*span))) <= delta
    return np.where(there.sum(axis=1) < 2, 3, np.where(flat, 2, out))


def curve_probabilities(vectors: DataFrame, keys: list[str], axis: list[str] = QUANT_AXIS, delta: float = PRACTICAL_DELTA) -> DataFrame:
    """``(keys, n_points, p_rising, p_falling, p_flat, p_indeterminate)``: shares of the replicates of each curve.

    A replicate's curve is read from the last label of the axis down to the first and fitted by the best non-decreasing and
    the best non-increasing curve. The fit with the smaller residual names it; it is flat if that fit spans at most ``delta``.
    Equal residuals are flat if both fits span at most that, and indeterminate else; so are curves of fewer than two points.
    Unknown labels and missing points are left out. A curve has one row for each label.
    """
    placed = vectors.withColumn("_x", axis_position(F.col("quantization"), axis)).where("_x is not null")
    points = placed.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((-F.col("_x")).alias("x"), "replicates")), asc=True).alias("_p"))  # one entry for each label
    rows = points.select(*keys, F.col("_p.replicates").alias("_r"))
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("n_points", T.LongType()), *[T.StructField(f"p_{p}", T.DoubleType()) for p in PATTERNS]])
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            for curve in batch.column(width):
                m = np.array([[np.nan if x is None else x for x in r] for r in curve.as_py()], dtype=float).T
                told.append([m.shape[1], *(np.bincount(shapes(m, delta), minlength=len(PATTERNS)) / max(len(m), 1))])
            columns = list(zip(*told)) if told else [()] * (1 + len(PATTERNS))
            arrays = [pa.array(columns[0], pa.int64()), *[pa.array(c, pa.float64()) for c in columns[1:]]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *arrays], names=schema.names)

    return rows.mapInArrow(run, schema)
