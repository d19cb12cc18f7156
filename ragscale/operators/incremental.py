"""Resuming work: what is done, what remains, which record of a key counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ragscale.operators.skew import BROADCAST_ROWS, is_small, join_same, with_dimension
from ragscale.session import materialize


def remaining_work(todo: DataFrame, done: DataFrame, key: list[str], query: str = "query_id") -> DataFrame:
    """Work items whose full key is not in the output; blank ids never count as done."""
    finished = done.where(F.col(query).isNotNull() & (F.col(query).cast("string") != "")).select(*key, query).distinct()
    return join_same(todo, finished, [*key, query], "left_anti")


def last_wins(df: DataFrame, key: list[str], order_by: str) -> DataFrame:
    """The last record per key, by partial aggregation instead of a sort. ``order_by`` must be a total order within a key."""
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order_by)).alias("_r"))
    return picked.select(*key, "_r.*")


def common_queries(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys present in both frames."""
    return a.select(*key).intersect(b.select(*key))


def collection_plan(found: DataFrame, existing: DataFrame, key: list[str], force: bool = False) -> DataFrame:
    """What an index build does with each collection: build, rebuild or skip.

    ``found`` has one row per indexable sample with its chunk count.
    """
    sizes = found.groupBy(*key).agg(F.sum("n_chunks").alias("n_chunks"))
    have = existing.select(*key).distinct().withColumn("_exists", F.lit(True))
    joined = join_same(sizes, have, key, "left")
    there = F.coalesce(F.col("_exists"), F.lit(False))
    action = (
        F.when(there & F.lit(not force), "skip_existing")
        .when(F.col("n_chunks") == 0, "skip_empty")
        .when(there, "rebuild")
        .otherwise("build")
    )
    return joined.select(*key, "n_chunks", action.alias("action"))


def experiment_grid(
    queries: DataFrame, configs: DataFrame, policy: DataFrame, default_passes: list[str], subset: str = "subset", block_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Planned calls: every query with every configuration and the passes of its subset.

    The product is the result here. The configurations go as one array to each query and are
    exploded there, so nothing is shuffled and no copy of them multiplied; they are counted first. More than
    ``block_rows`` of them are numbered and cut into blocks, one array each, that every query meets.
    """
    default = F.array(*[F.lit(p) for p in default_passes])
    planned = with_dimension(queries, policy, [subset]).withColumn(
        "pass", F.explode(F.coalesce(F.col("passes"), default))
    ).drop("passes")
    if not is_small(configs, block_rows):
        marked = materialize(configs.withColumn("_at", F.monotonically_increasing_id()), "configs")
        # A task numbers its rows without gaps, so a block has ``block_rows`` rows at most.
        of = F.struct(F.shiftright("_at", 33), F.floor(F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) / block_rows))
        blocks = marked.groupBy(of.alias("_block")).agg(F.collect_list(F.struct(*configs.columns)).alias("_configs"))
        met = planned.crossJoin(blocks.select("_configs"))
        return met.withColumn("_config", F.explode("_configs")).select(*planned.columns, "_config.*")
    every = configs.agg(F.collect_list(F.struct(*configs.columns)).alias("_configs"))
    return planned.withColumn("_config", F.explode(every.scalar())).select(*planned.columns, "_config.*")
