"""Metric curves along the ordered quantization axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ragscale.functions.scoring import interval_text, precision_flag
from ragscale.operators.skew import join_same
from ragscale.schemas import CI_WIDTH_SHARE, PRACTICAL_DELTA, QUANT_AXIS


def axis_position(quantization: Column, axis: list[str] = QUANT_AXIS) -> Column:
    """0-based position on the axis, null when the label is unknown."""
    at = F.array_position(F.array(*[F.lit(q) for q in axis]), quantization)
    return F.when(at > 0, (at - 1).cast("int"))


def on_axis(df: DataFrame, axis: list[str] = QUANT_AXIS) -> DataFrame:
    """Rows with a known label, with their position ``x``."""
    return df.withColumn("x", axis_position(F.col("quantization"), axis)).where("x is not null")


def local_series(df: DataFrame, pass_prefix: str, axis: list[str] = QUANT_AXIS) -> DataFrame:
    """Locally generated records of a pass with a known quantization."""
    return df.where(
        F.col("pass").startswith(pass_prefix)
        & F.col("quantization").isin(*axis)
        & (F.coalesce(F.col("source"), F.lit("local")) == "local")
    )


def plot_series(df: DataFrame, keys: list[str], axis: list[str] = QUANT_AXIS) -> DataFrame:
    """Ordered points per curve with error-bar offsets; a curve has one point per axis label."""
    point = F.struct(
        "x", F.col("mean").alias("y"), (F.col("mean") - F.col("ci_lo")).alias("err_lo"),
        (F.col("ci_hi") - F.col("mean")).alias("err_hi"), F.col("capability_degraded").alias("degraded"),
    )
    return on_axis(df, axis).groupBy(*keys).agg(F.sort_array(F.collect_list(point)).alias("points"))


def overlap(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    return (lo_a <= hi_b) & (lo_b <= hi_a)


def baseline_delta(df: DataFrame, keys: list[str], baseline: str = QUANT_AXIS[-1]) -> DataFrame:
    """Difference to the baseline point; practical if large and with disjoint intervals."""
    w = Window.partitionBy(*keys)
    base = {c: F.max(F.when(F.col("quantization") == baseline, F.col(c))).over(w) for c in ("mean", "ci_lo", "ci_hi")}
    out = df.select("*", *[v.alias(f"base_{c}") for c, v in base.items()])
    delta = F.col("mean") - F.col("base_mean")
    apart = ~overlap(F.col("ci_lo"), F.col("ci_hi"), F.col("base_ci_lo"), F.col("base_ci_hi"))
    return out.withColumn("delta", delta).withColumn(
        "practical", F.coalesce((F.abs(delta) > PRACTICAL_DELTA) & apart, F.lit(False))
    )


def curve_pattern(df: DataFrame, keys: list[str], axis: list[str] = QUANT_AXIS) -> DataFrame:
    """Shape of each curve, read from the baseline (last label) down to the first label, by its intervals.

    resilient never leaves the baseline's interval; gullible rises at every step and ends clear above the baseline,
    stubborn falls at every step and ends clear below it; inverted_u ends significantly below an inner peak; anything
    else is indeterminate.
    """
    last = len(axis) - 1
    steps = Window.partitionBy(*keys).orderBy(F.desc("x"))
    points = on_axis(df, axis).withColumn("_step", F.col("mean") - F.lag("mean").over(steps))
    at = lambda c, x: F.max(F.when(F.col("x") == x, F.col(c)))
    peak_rank = F.struct("mean", "x")
    seen = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_points"),
        F.every(F.col("_step") > 0).alias("_up"),
        F.every(F.col("_step") < 0).alias("_down"),
        F.max_by("x", peak_rank).alias("_peak"),
        F.max_by("ci_lo", peak_rank).alias("_peak_lo"),
        at("ci_lo", 0).alias("_end_lo"),
        at("ci_hi", 0).alias("_end_hi"),
        F.max("ci_lo").alias("_max_lo"),
        F.min("ci_hi").alias("_min_hi"),
        at("ci_lo", last).alias("_base_lo"),
        at("ci_hi", last).alias("_base_hi"),
    )
    pattern = (
        F.when(F.col("n_points") < 2, "indeterminate")
        .when((F.col("_max_lo") <= F.col("_base_hi")) & (F.col("_min_hi") >= F.col("_base_lo")), "resilient")
        .when(F.col("_up") & (F.col("_end_lo") > F.col("_base_hi")), "gullible")
        .when(F.col("_down") & (F.col("_end_hi") < F.col("_base_lo")), "stubborn")
        .when((F.col("_peak") > 0) & (F.col("_peak") < last) & (F.col("_end_hi") < F.col("_peak_lo")), "inverted_u")
        .otherwise("indeterminate")
    )
    return seen.select(*keys, "n_points", pattern.alias("pattern"))


def falsification(patterns: DataFrame, roles: DataFrame) -> DataFrame:
    """Whether no primary model shows the gullible pattern."""
    primary = patterns.join(roles.where("role = 'primary'"), "model")
    return primary.agg(
        F.countDistinct("model").alias("n_models"),
        F.countDistinct(F.when(F.col("pattern") == "gullible", F.col("model"))).alias("n_gullible_models"),
        (~F.coalesce(F.bool_or(F.col("pattern") == "gullible"), F.lit(False))).alias("refuted"),
    )


def cross_pairs(df: DataFrame, pairs: list[tuple[str, str]], keys: list[str]) -> DataFrame:
    """Declared model pairs compared at equal quantization (and other keys); a model may occur in several pairs."""
    side = ["mean", "ci_lo", "ci_hi"]
    wanted = df.sparkSession.createDataFrame(pairs, "model_a string, model_b string")
    left = df.select(F.col("model").alias("model_a"), *keys, *[F.col(c).alias(f"a_{c}") for c in side]).join(F.broadcast(wanted), "model_a")
    right = df.select(F.col("model").alias("model_b"), *keys, *[F.col(c).alias(f"b_{c}") for c in side])
    joined = join_same(left, right, ["model_b", *keys])
    return joined.select(
        "model_a", "model_b", *keys, F.col("a_mean"), F.col("b_mean"),
        (F.col("a_mean") - F.col("b_mean")).alias("delta"),
        overlap(F.col("a_ci_lo"), F.col("a_ci_hi"), F.col("b_ci_lo"), F.col("b_ci_hi")).alias("ci_overlap"),
    )


def flag_width(df: DataFrame, share: float = CI_WIDTH_SHARE) -> DataFrame:
    """Adds ``flagged`` and the warning text of too wide intervals."""
    flagged = precision_flag(F.col("mean"), F.col("ci_lo"), F.col("ci_hi"), share)
    text = F.format_string(  # fixed value: the published wording of the warning
        f"%s: CI width (%.4f) > {share * 100:.0f}%% of mean (%.4f) — needs more runs",
        F.col("metric"), F.col("ci_hi") - F.col("ci_lo"), F.col("mean"),
    )
    return df.withColumn("flagged", flagged).withColumn("warning", F.when(flagged, text))


def report_cells(df: DataFrame, share: float = CI_WIDTH_SHARE, digits: int = 3) -> DataFrame:
    flagged = precision_flag(F.col("mean"), F.col("ci_lo"), F.col("ci_hi"), share)
    return df.withColumn("cell", interval_text(F.col("mean"), F.col("ci_lo"), F.col("ci_hi"), flagged, digits))


def summary_wide(df: DataFrame, keys: list[str], metrics: list[str], share: float = CI_WIDTH_SHARE) -> DataFrame:
    """One row per configuration with mean, interval and flag columns per metric."""
    flagged = precision_flag(F.col("mean"), F.col("ci_lo"), F.col("ci_hi"), share)
    stat = {"mean": F.col("mean"), "ci_low": F.col("ci_lo"), "ci_high": F.col("ci_hi"),
            "flagged": F.when(flagged, F.lit("YES"))}
    return df.groupBy(*keys).pivot("metric", metrics).agg(*[F.first(v).alias(c) for c, v in stat.items()])


def three_pass_triple(
    df: DataFrame, order_by: str, keys: list[str], passes: tuple[str, str, str] = ("pass1", "pass2", "pass3"),
    correct_from: float = 0.5, follows_from: float = 0.5,
) -> DataFrame:
    """Diagnosis per query from its last record in each of the three passes."""
    base, loose, strict = passes
    last = lambda v, p: F.max_by(F.when(F.col("pass") == p, F.col(v)), F.when(F.col("pass") == p, F.col(order_by)))
    seen = df.where(F.col("pass").isin(*passes)).groupBy(*keys).agg(
        (last("overall_recall", base) >= correct_from).alias("knows"),
        (last("cu", loose) >= follows_from).alias("follows_loose"),
        (last("cu", strict) >= follows_from).alias("follows_strict"),
    )
    knows, loose_ok, strict_ok = F.col("knows"), F.col("follows_loose"), F.col("follows_strict")
    label = (
        F.when(knows.isNull() | loose_ok.isNull() | strict_ok.isNull(), "incomplete")
        .when(knows & loose_ok & strict_ok, "confidence_erosion")
        .when(knows & ~loose_ok & strict_ok, "preference")
        .when(~knows & loose_ok & strict_ok, "uninformative")
        .otherwise("other")
    )
    return seen.withColumn("diagnosis", label)
