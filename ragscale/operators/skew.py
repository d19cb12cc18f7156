"""Finding and spreading keys that hold a large share of the rows, and joins that keep null keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ragscale.session import materialize

MIN_BLOCK_ROWS = 1 << 14  # splitting smaller groups costs more than it spreads
BROADCAST_ROWS = 100_000  # lookups of more rows are joined by a shuffle


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows spread over the cores when the input has fewer splits than cores (a few small files).

    Large inputs have more splits than that and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def spread_rows(df: DataFrame, key: str, most: int = 1 << 15) -> DataFrame:
    """Rows spread so that a task has some ``most`` of them, for work that costs far more than reading its input.

    The number of tasks grows with the rows; inputs with splits that small stay as they are.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // most))
    return df.repartition(tasks, key) if df.rdd.getNumPartitions() < tasks else df


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality on several keys."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; the columns of ``left``, then those of ``right`` that are no keys."""
    renamed = right.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_same_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_same_{k}" for k in keys])


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    return df.limit(max_rows + 1).count() <= max_rows


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for a broadcast if its rows, which are counted, are few: then the other side of a join stays where it is."""
    return F.broadcast(df) if is_small(df, max_rows) else df


def hot_keys(df: DataFrame, keys: list[str], block_rows: int, counts: DataFrame | None = None, fair: int | None = None) -> DataFrame | None:
    """Written ``keys, n_blocks`` of the keys larger than a task's fair share; None if there are none.

    The share is ``total / shuffle partitions``, within ``block_rows``. ``counts`` (``keys, n_rows``) saves counting,
    ``fair`` is another share.
    Only the total and the largest count reach the driver.
    """
    if counts is None:
        counts = materialize(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")), "counts")
    total, largest = counts.agg(F.sum("n_rows"), F.max("n_rows")).first()
    fair = fair or max(1, min(block_rows, max((total or 0) // shuffle_partitions(df), MIN_BLOCK_ROWS)))
    if (largest or 0) <= fair:
        return None
    return materialize(counts.where(F.col("n_rows") > fair).select(*keys, F.ceil(F.col("n_rows") / fair).cast("int").alias("n_blocks")), "hot")


def _with_blocks(df: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """Adds ``_n_blocks``, 1 for ordinary keys. The hot keys are broadcast only where they are few."""
    joined = join_same(df, F.broadcast(hot) if is_small(hot) else hot, keys, "left")
    return joined.withColumn("_n_blocks", F.coalesce("n_blocks", F.lit(1))).drop("n_blocks")


def with_salt(df: DataFrame, keys: list[str], hot: DataFrame | None, spread_by: str, salt: str = "_salt") -> DataFrame:
    """Add a salt column: 0 for ordinary keys, spread by row for hot ones."""
    if hot is None:
        return df.withColumn(salt, F.lit(0))
    at = F.pmod(F.xxhash64(F.col(spread_by), F.lit(17)), F.col("_n_blocks"))
    return _with_blocks(df, keys, hot).withColumn(salt, at.cast("int")).drop("_n_blocks")


def replicated(df: DataFrame, keys: list[str], hot: DataFrame | None, salt: str = "_salt") -> DataFrame:
    """Copy the rows of a split key to each of its blocks."""
    if hot is None:
        return df.withColumn(salt, F.lit(0))
    return _with_blocks(df, keys, hot).withColumn(salt, F.explode(F.sequence(F.lit(0), F.col("_n_blocks") - 1))).drop("_n_blocks")


def with_dimension(df: DataFrame, dim: DataFrame, on: list[str], how: str = "left", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Null-safe join to a lookup table, broadcast only after counting that it is small.

    A broadcast keeps frequent keys where they are. A larger table takes the
    planner's ordinary join, where adaptive execution splits skewed keys.
    """
    return join_same(df, F.broadcast(dim) if is_small(dim, max_rows) else dim, on, how)
