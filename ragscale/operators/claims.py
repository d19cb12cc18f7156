"""Claim-level scores of a response against its ground truth and its context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ragscale.functions.text import sentences, token_set


def entails(claim: Column, text: Column, coverage: int) -> Column:
    """Whether a token set holds at least ``coverage`` percent of a claim's tokens."""
    return F.size(F.array_intersect(claim, text)) * 100 >= F.size(claim) * coverage


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def _where(items: Column, test) -> Column:
    return F.size(F.filter(items, test))


def claim_metrics(
    df: DataFrame, keep: list[str], response: str = "response", ground_truth: str = "ground_truth",
    context: str = "context_chunks", coverage: int = 80,
) -> DataFrame:
    """The eleven scores per record; sentences are the claims, shared tokens the entailment.

    Everything a record needs is in its row, so nothing is shuffled. Incorrect
    claims count for relevant chunks first: noise_sensitivity_relevant,
    noise_sensitivity_irrelevant and hallucination add up to 1 - precision.
    """
    none = F.array().cast("array<string>")
    base = df.select(
        *keep,
        F.transform(sentences(response), lambda s: token_set(s)).alias("_r"),
        F.transform(sentences(ground_truth), lambda s: token_set(s)).alias("_g"),
        F.transform(F.coalesce(F.col(context), none), lambda s: token_set(s)).alias("_c"),
        token_set(F.coalesce(F.col(response), F.lit(""))).alias("_response"),
        token_set(F.coalesce(F.col(ground_truth), F.lit(""))).alias("_truth"),
    )
    with_chunks = base.withColumn("_chunks", F.transform("_c", lambda c: F.struct(
        c.alias("tokens"), F.exists("_g", lambda g: entails(g, c, coverage)).alias("relevant"))))
    judged = with_chunks.select(
        *keep, "_chunks",
        F.transform("_r", lambda r: F.struct(
            entails(r, F.col("_truth"), coverage).alias("correct"),
            F.exists("_chunks", lambda c: entails(r, c["tokens"], coverage)).alias("found"),
            F.exists("_chunks", lambda c: c["relevant"] & entails(r, c["tokens"], coverage)).alias("relevant"),
        )).alias("_rj"),
        F.transform("_g", lambda g: F.struct(
            entails(g, F.col("_response"), coverage).alias("answered"),
            F.exists("_chunks", lambda c: entails(g, c["tokens"], coverage)).alias("found"),
        )).alias("_gj"),
    )
    r, g, c = F.col("_rj"), F.col("_gj"), F.col("_chunks")
    counted = judged.select(
        *keep,
        F.size(r).alias("n_r"), F.size(g).alias("n_g"), F.size(c).alias("n_c"),
        _where(r, lambda x: x["correct"]).alias("r_correct"),
        _where(r, lambda x: x["found"]).alias("r_found"),
        _where(r, lambda x: x["correct"] & ~x["found"]).alias("r_self"),
        _where(r, lambda x: ~x["correct"] & ~x["found"]).alias("r_halluc"),
        _where(r, lambda x: ~x["correct"] & x["relevant"]).alias("r_noise_rel"),
        _where(r, lambda x: ~x["correct"] & x["found"] & ~x["relevant"]).alias("r_noise_irr"),
        _where(g, lambda x: x["answered"]).alias("g_answered"),
        _where(g, lambda x: x["found"]).alias("g_found"),
        _where(g, lambda x: x["found"] & x["answered"]).alias("g_used"),
        _where(c, lambda x: x["relevant"]).alias("c_relevant"),
    )
    n_r, n_g, n_c = F.col("n_r"), F.col("n_g"), F.col("n_c")
    precision, recall = _share(F.col("r_correct"), n_r), _share(F.col("g_answered"), n_g)
    f1 = F.when(precision + recall > 0, 2.0 * precision * recall / (precision + recall)).otherwise(0.0)
    return counted.select(
        *keep,
        precision.alias("overall_precision"), recall.alias("overall_recall"), f1.alias("overall_f1"),
        _share(F.col("g_found"), n_g).alias("claim_recall"),
        _share(F.col("c_relevant"), n_c).alias("context_precision"),
        _share(F.col("g_used"), F.col("g_found")).alias("context_utilization"),
        _share(F.col("r_self"), n_r).alias("self_knowledge"),
        _share(F.col("r_noise_rel"), n_r).alias("noise_sensitivity_relevant"),
        _share(F.col("r_noise_irr"), n_r).alias("noise_sensitivity_irrelevant"),
        _share(F.col("r_halluc"), n_r).alias("hallucination"),
        _share(F.col("r_found"), n_r).alias("faithfulness"),
    )
