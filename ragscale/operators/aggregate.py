"""Per-configuration statistics, the paired preference gap and the aggregated record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ragscale.functions.scoring import or_zero
from ragscale.operators.bootstrap import metric_stats, poisson_ci
from ragscale.operators.skew import join_same
from ragscale.schemas import (
    BOOTSTRAP_RESAMPLES, CONFIDENCE_LEVEL, CONFIG_KEY, DEGRADED_BELOW, GAP_METRIC, JUDGE_NAME, METRICS,
    PAIR_KEY, SHORT_NAME,
)
from ragscale.session import materialize


def scores_to_short(df: DataFrame, scores: str = "scores.ragchecker") -> DataFrame:
    """Nested record scores as top-level metric columns; a missing score is 0.0."""
    rest = [c for c in df.columns if c != scores.split(".")[0]]
    return df.select(*rest, *[or_zero(F.col(f"{scores}.{raw}")).alias(short) for raw, short in SHORT_NAME.items()])


def judge_to_short(df: DataFrame, keep: list[str]) -> DataFrame:
    """A judge's score columns as metric columns; an unreported one is 0.0."""
    cols = []
    for judge, raw in JUDGE_NAME.items():
        value = F.col(judge).cast("double") if judge in df.columns else F.lit(None).cast("double")
        cols.append(or_zero(value).alias(SHORT_NAME[raw]))
    return df.select(*keep, *cols)


def unpivot_metrics(df: DataFrame, ids: list[str], metrics: list[str] = METRICS) -> DataFrame:
    """One row per record and metric."""
    return df.unpivot(ids, metrics, "metric", "value")


def order_of(order_by: str | list[str]) -> Column:
    """One comparable column for an order by one or several columns."""
    return F.col(order_by) if isinstance(order_by, str) else F.struct(*order_by)


def config_heads(df: DataFrame, order_by: str | list[str], keys: list[str] = CONFIG_KEY) -> DataFrame:
    """Row count, mean cu and the first record's source per configuration.

    Sources are grouping keys of the first, hash-based aggregation; picking one
    then runs over a few rows per configuration.
    """
    cells = df.groupBy(*keys, F.coalesce(F.col("source"), F.lit("local")).alias("source")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(or_zero(F.col("cu"))).alias("_cu"), F.min(order_of(order_by)).alias("_first"))
    return cells.groupBy(*keys).agg(
        F.sum("_n").alias("n_queries"), (F.sum("_cu") / F.sum("_n")).alias("_cu_mean"),
        F.min_by("source", "_first").alias("source"))


def stats_and_heads(df: DataFrame, order_by: str | list[str], keys: list[str], metrics: list[str]) -> DataFrame:
    """``metric_stats`` of every configuration with its first record's source and mean cu, from one read.

    Moments are taken per configuration and source and then put together, so the aggregation over all
    records stays hash-based.
    """
    source = F.coalesce(F.col("source"), F.lit("local")).alias("source")
    value = {m: or_zero(F.col(m).cast("double")) for m in metrics}
    cells = df.groupBy(*keys, source).agg(
        F.count(F.lit(1)).alias("_n"), F.min(order_of(order_by)).alias("_first"), F.sum(or_zero(F.col("cu"))).alias("_cu"),
        *[c for m, v in value.items() for c in (F.avg(v).alias(f"_m_{m}"), F.var_pop(v).alias(f"_v_{m}"))])
    n = F.sum("_n")
    out = []
    for m in metrics:
        mean = F.sum(F.col("_n") * F.col(f"_m_{m}")) / n
        square = F.sum(F.col("_n") * (F.col(f"_v_{m}") + F.col(f"_m_{m}") * F.col(f"_m_{m}"))) - n * mean * mean
        out += [mean.alias(f"{m}__mean"), F.when(n > 1, F.sqrt(F.greatest(square, F.lit(0.0)) / (n - 1))).otherwise(0.0).alias(f"{m}__std")]
    return cells.groupBy(*keys).agg(n.alias("n"), F.min_by("source", "_first").alias("source"), (F.sum("_cu") / n).alias("_cu_mean"), *out)


def config_aggregate(
    df: DataFrame, order_by: str | list[str], keys: list[str] = CONFIG_KEY, metrics: list[str] = METRICS,
) -> DataFrame:
    """Row count, representative source, mean and deviation per configuration, one row each.

    The source is that of the first record in ``order_by`` order.
    """
    aggs = []
    for m in metrics:
        value = or_zero(F.col(m))
        aggs.append(F.avg(value).alias(f"{m}_mean"))
        aggs.append(or_zero(F.stddev_samp(value)).alias(f"{m}_std"))
    stats = df.groupBy(*keys).agg(*aggs)
    return join_same(config_heads(df, order_by, keys).drop("_cu_mean"), stats, keys)


def _latest(value: str, order_by: str | list[str], when: Column) -> Column:
    """Value of the last record that meets a condition, null if that record has none."""
    return F.max_by(F.when(when, F.col(value)), F.when(when, order_of(order_by)))


def paired_passes(
    df: DataFrame, order_by: str | list[str], value: str = "cu", loose: str = "pass2", strict: str = "pass3",
    keys: list[str] = PAIR_KEY, query: str = "query_id",
) -> DataFrame:
    """Both passes' values per query; the last record of a query wins in each pass.

    One aggregation does the deduplication and the pairing, with partial
    aggregation before its only shuffle. Queries missing a pass or a value drop out.
    """
    wanted = df.where(F.col("pass").isin(loose, strict)).groupBy(*keys, query).agg(
        _latest(value, order_by, F.col("pass") == loose).alias("loose"),
        _latest(value, order_by, F.col("pass") == strict).alias("strict"),
    )
    return wanted.where("loose is not null and strict is not null")


def preference_gap(
    df: DataFrame, order_by: str | list[str], value: str = "cu", loose: str = "pass2", strict: str = "pass3",
    keys: list[str] = PAIR_KEY, query: str = "query_id", n_resamples: int = BOOTSTRAP_RESAMPLES,
    confidence: float = CONFIDENCE_LEVEL,
) -> DataFrame:
    """Mean, interval and deviation of ``strict - loose`` over the queries both passes share."""
    pairs = paired_passes(df, order_by, value, loose, strict, keys, query)
    diffs = pairs.select(*keys, query, (F.col("strict") - F.col("loose")).alias(GAP_METRIC))
    # pairing shuffles all records of both passes; its narrow result is read several times
    return poisson_ci(materialize(diffs, "gaps"), keys, [GAP_METRIC], query, n_resamples, confidence)


def attach_gap(configs: DataFrame, gaps: DataFrame, strict: str = "pass3", keys: list[str] = PAIR_KEY) -> DataFrame:
    """Gap statistics next to every configuration; zeros where there is no gap."""
    stats = ["mean", "ci_lo", "ci_hi", "std"]
    right = gaps.select(*keys, *[F.col(c).alias(f"gap_{c}") for c in stats], F.lit(strict).alias("pass"))
    joined = join_same(configs, right, [*keys, "pass"], "left")
    return joined.withColumns({f"gap_{c}": or_zero(F.col(f"gap_{c}")) for c in stats})


def degraded_flag(pass_name: Column, cu_mean: Column, below: float = DEGRADED_BELOW, strict: str = "pass3") -> Column:
    return F.coalesce(pass_name.startswith(strict) & (cu_mean < below), F.lit(False))


def aggregate_results(
    df: DataFrame, row_key: str | list[str], order_by: str | list[str], loose: str = "pass2", strict: str = "pass3",
    metrics: list[str] = METRICS, n_resamples: int = BOOTSTRAP_RESAMPLES, confidence: float = CONFIDENCE_LEVEL,
) -> DataFrame:
    """The study's aggregated result, one row per configuration and metric (gap included).

    ``row_key`` identifies a record inside its configuration and ``order_by`` orders records totally; both may be
    several columns. Null configuration keys are keys like any other. The records are read three times: for the
    statistics, for the bootstrap and for pairing the passes.
    """
    found = materialize(stats_and_heads(df, order_by, CONFIG_KEY, metrics), "configs")
    heads = found.select(
        *CONFIG_KEY, "source", F.col("n").alias("n_queries"),
        degraded_flag(F.col("pass"), F.col("_cu_mean"), strict=strict).alias("capability_degraded"))
    stats = poisson_ci(df, CONFIG_KEY, metrics, row_key, n_resamples, confidence, stats=found.drop("source", "_cu_mean"))
    gaps = preference_gap(df, order_by, "cu", loose, strict, n_resamples=n_resamples, confidence=confidence)
    gap_rows = attach_gap(heads.select(*CONFIG_KEY), gaps, strict).select(
        *CONFIG_KEY, F.lit(GAP_METRIC).alias("metric"),
        *[F.col(f"gap_{c}").alias(c) for c in ("mean", "ci_lo", "ci_hi", "std")],
    )
    rows = stats.drop("n").unionByName(gap_rows)
    return join_same(rows, heads, CONFIG_KEY).select(
        *CONFIG_KEY, "source", "n_queries", "metric", "mean", "ci_lo", "ci_hi", "std", "capability_degraded"
    )


def nest_aggregated(rows: DataFrame) -> DataFrame:
    """Aggregated rows in the nested record layout; a record holds the dozen metrics only."""
    entry = F.struct("metric", F.struct("mean", "ci_lo", "ci_hi", "std"))
    return rows.groupBy("model", "quantization", "source", "dataset", "subset", "pass", "n_queries",
                        "capability_degraded").agg(
        F.map_from_entries(F.collect_list(entry)).alias("metrics")
    ).select("model", "quantization", "source", "dataset", "subset", "pass", "n_queries", "metrics",
             "capability_degraded")


def unnest_aggregated(records: DataFrame) -> DataFrame:
    """Nested aggregated records as one row per configuration and metric again."""
    keys = ["model", "quantization", "source", "dataset", "subset", "pass", "n_queries", "capability_degraded"]
    return records.select(*keys, F.explode("metrics").alias("metric", "_s")).select(*keys, "metric", "_s.*")


__all__ = [
    "aggregate_results", "attach_gap", "config_aggregate", "degraded_flag", "judge_to_short", "metric_stats",
    "nest_aggregated", "paired_passes", "preference_gap", "scores_to_short", "unnest_aggregated", "unpivot_metrics",
]
