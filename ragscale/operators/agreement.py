"""Agreement between two raters: confusion cells, kappas and the verdict.

Ratings are counted into confusion cells once; every statistic is arithmetic on
those few cells, so only the count ever shuffles rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ragscale.functions.scoring import discretize_closed, or_zero
from ragscale.operators.sampling import stratified_sample
from ragscale.operators.skew import join_same
from ragscale.schemas import KAPPA_THRESHOLD


def pair_judges(a: DataFrame, b: DataFrame, key: list[str], metrics: list[str]) -> DataFrame:
    """Two judges' scores of the same sample side by side as ``<metric>__a`` and ``<metric>__b``."""
    left = a.select(*key, *[F.col(m).alias(f"{m}__a") for m in metrics])
    right = b.select(*key, *[F.col(m).alias(f"{m}__b") for m in metrics])
    return left.join(right, key)


def confusion_cells(
    pairs: DataFrame, metrics: list[str], strata: list[str] | None = None,
    bins: Callable[[Column], Column] = discretize_closed,
) -> DataFrame:
    """``(strata, metric, a, b, n)``: how often the raters chose each pair of classes."""
    strata = strata or []
    entries = [
        F.struct(
            F.lit(m).alias("metric"),
            bins(or_zero(F.col(f"{m}__a"))).alias("a"),
            bins(or_zero(F.col(f"{m}__b"))).alias("b"),
        )
        for m in metrics
    ]
    rows = pairs.select(*strata, F.explode(F.array(*entries)).alias("_e")).select(*strata, "_e.*")
    return rows.groupBy(*strata, "metric", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def with_overall(cells: DataFrame, stratum: str) -> DataFrame:
    """Cells per stratum plus cells over all strata (stratum null), rolled up from the counts."""
    overall = cells.groupBy("metric", "a", "b").agg(F.sum("n").alias("n"))
    return cells.unionByName(overall.withColumn(stratum, F.lit(None).cast(cells.schema[stratum].dataType)))


def label_margins(cells: DataFrame, by: list[str]) -> DataFrame:
    """``(by, label, n_a, n_b)``: how often each rater gave each label that either of them gave."""
    sides = [
        cells.select(*by, F.col(c).alias("label"), *[(F.col("n") if c == d else F.lit(0)).cast("bigint").alias(f"n_{d}") for d in ("a", "b")])
        for c in ("a", "b")
    ]
    return sides[0].unionByName(sides[1]).groupBy(*by, "label").agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))


def _totals(cells: DataFrame, by: list[str], *more: Column) -> DataFrame:
    agree = F.sum(F.when(F.col("a").eqNullSafe(F.col("b")), F.col("n")).otherwise(0))
    return cells.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(agree, F.lit(0)).alias("agree"), *more)


def cohens_kappa(cells: DataFrame, by: list[str], digits: int = 4) -> DataFrame:
    """Unweighted kappa per group: 0 without samples, 1 when chance agreement is complete.

    The classes are the labels that either rater gave; a missing label is a class of its own.
    """
    expected = label_margins(cells, by).groupBy(*by).agg(F.sum(F.col("n_a").cast("double") * F.col("n_b")).alias("_e"))
    sums = join_same(_totals(cells, by), expected, by, "left") if by else _totals(cells, by).join(expected)
    n = F.col("n").cast("double")
    p_o, p_e = F.col("agree") / n, F.col("_e") / (n * n)
    kappa = (
        F.when(F.col("n") == 0, 0.0)
        .when(p_e >= 1.0, 1.0)
        .otherwise(F.round((p_o - p_e) / (1.0 - p_e), digits))
    )
    return sums.select(*by, "n", "agree", kappa.alias("kappa"))


def linear_kappa(cells: DataFrame, by: list[str], digits: int = 3) -> DataFrame:
    """Linear-weighted kappa per group over numeric labels: 0 without samples, 1 without expected disagreement.

    The expected disagreement is summed along the ordered labels: between two neighbours it grows by their
    distance for each pair of ratings that lie on either side. Rows with a missing label are left out.
    """
    known = cells.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    margins = label_margins(known, by)
    along = Window.partitionBy(*by).orderBy("label")
    steps = margins.select(
        *by, (F.lead("label").over(along) - F.col("label")).alias("_gap"), F.sum("n_a").over(along).cast("double").alias("_a"),
        F.sum("n_b").over(along).cast("double").alias("_b"), F.sum("n_a").over(Window.partitionBy(*by)).alias("_all"),
    )
    apart = F.col("_a") * (F.col("_all") - F.col("_b")) + F.col("_b") * (F.col("_all") - F.col("_a"))
    expected = steps.groupBy(*by).agg(or_zero(F.sum(F.col("_gap") * apart)).alias("_e"))
    observed = F.sum(F.abs(F.col("a") - F.col("b")) * F.col("n")).cast("double")
    sums = _totals(known, by, or_zero(observed).alias("_o"))
    sums = join_same(sums, expected, by, "left") if by else sums.join(expected)
    kappa = (
        F.when(F.col("n") == 0, 0.0)
        .when(F.col("_e") == 0, 1.0)
        .otherwise(F.round(1.0 - F.col("_o") * F.col("n") / F.nullif(F.col("_e"), F.lit(0.0)), digits))
    )
    return sums.select(*by, "n", "agree", kappa.alias("kappa"))


def raw_agreement(cells: DataFrame, by: list[str]) -> DataFrame:
    """Matches over samples, also as ``a/n`` text."""
    sums = cells.groupBy(*by).agg(
        F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("agree"), F.sum("n").alias("n")
    )
    return sums.withColumn("raw_agreement", F.concat_ws("/", F.col("agree").cast("string"), F.col("n").cast("string")))


def confusion_matrix(cells: DataFrame, by: list[str]) -> DataFrame:
    """The full matrix per group over the labels that either rater gave, empty cells included."""
    labels = label_margins(cells, by).select(*by, "label")
    grid = join_same(labels.withColumnRenamed("label", "a"), labels.withColumnRenamed("label", "b"), by)
    counted = join_same(grid, cells.groupBy(*by, "a", "b").agg(F.sum("n").alias("n")), [*by, "a", "b"], "left")
    return counted.select(*by, "a", "b", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def agreement_study(
    a: DataFrame, b: DataFrame, key: list[str], metrics: list[str], stratum: str, sizes: dict[str, int],
    seed: int = 42, threshold: float = KAPPA_THRESHOLD,
) -> DataFrame:
    """The whole study: a stratified sample of ``a``, paired with the second judge, binned, kappa and verdict.

    One row per metric over all strata (``stratum`` null) and per metric and stratum. ``b`` must cover the sample.
    """
    sample = stratified_sample(a, stratum, sizes, key, seed)
    pairs = pair_judges(sample, b, key, metrics)
    pairs = join_same(pairs, sample.select(*key, stratum), key)
    cells = confusion_cells(pairs, metrics, [stratum])
    return verdict(cohens_kappa(with_overall(cells, stratum), ["metric", stratum]), threshold)


def verdict(kappas: DataFrame, threshold: float = KAPPA_THRESHOLD) -> DataFrame:
    return kappas.withColumn("threshold", F.lit(threshold)).withColumn("validated", F.col("kappa") >= threshold)
