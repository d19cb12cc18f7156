"""Mixing sources to target weights by fitting subsets of exact lengths to each source's budget.

A source's budget in words is met by whole copies of all its documents and one more copy of some. Which lengths get how
many is decided on counts alone: the documents of each exact length are counted, every length gives its proportional
share, the largest lengths fill what is left down to a bounded rest, and a bounded-knapsack dynamic program fits the rest
from the documents still free. The documents of each length are then those with the smallest seeded hashes.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ragscale.llm.arrays import WORD
from ragscale.llm.order import numbered
from ragscale.operators.skew import with_dimension
from ragscale.session import materialize

HASH_BITS = 62
DP_BUDGET = 1 << 16  # words left to the dynamic program; more is given to the largest lengths first
BUCKET_ROWS = 1024  # documents ranked together at a length's boundary


def word_size(text: Column | str) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _measured(docs: DataFrame, id: str, text: str, source: str, seed: int) -> dict[str, Column]:
    body = F.col(text).cast("string")
    return {
        "_source": F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")),  # tells null from every name
        "_size": word_size(body),
        "_hash": F.xxhash64(F.lit(seed), F.col(id), body).bitwiseAND(F.lit((1 << HASH_BITS) - 1)),
        "_row": F.monotonically_increasing_id(),  # tells repeated rows apart
    }


def water_level(sources: DataFrame, most: int) -> float:
    """The level ``x`` at which ``sum(min(most * total, x * weight))`` is the sum of all totals."""
    all_words, weights = sources.agg(F.sum("total"), F.sum("weight")).first()
    level, capped = (all_words or 0) / max(weights or 0, 1), -1
    while True:
        full = F.col("weight") * F.lit(level) > F.lit(most) * F.col("total")
        n, words, free = sources.agg(F.count_if(full), F.sum(F.when(full, F.col("total") * most)), F.sum(F.when(~full, F.col("weight")))).first()
        if n == capped or not free:
            return level
        level, capped = (all_words - (words or 0)) / free, n


def source_targets(measured: DataFrame, weights: list[int], most: int) -> DataFrame:
    """``_source, total, target`` of every source.

    Sources ordered by code point, null last, weigh ``weights`` in turn; targets add up to all words, none above ``most`` times
    its source's words, what exceeds that being shared out again by weight.
    """
    totals = measured.groupBy("_source").agg(F.sum("_size").alias("total"))
    ranked, _ = numbered(totals, [F.col("_source") == "", F.col("_source")])
    pick = F.get(F.lit(weights), (F.col("rank") % len(weights)).cast("int"))
    weighted = materialize(ranked.select("_source", "total", pick.cast("bigint").alias("weight")), "sources")
    level = water_level(weighted, most)
    return weighted.select("_source", "total", F.least(F.col("total") * float(most), F.col("weight") * F.lit(level)).alias("target"))


def fit_lengths(lengths: list[int], counts: list[int], target: float, dp_budget: int = DP_BUDGET) -> tuple[int, list[int]]:
    """Copies of every document, and for each length how many documents get one more."""
    total = sum(a * b for a, b in zip(lengths, counts))
    if not total:
        return 0, [0] * len(lengths)
    goal = round(target)
    base, budget = divmod(goal, total)
    more = [budget * c // total if n else 0 for n, c in zip(lengths, counts)]
    left = budget - sum(a * b for a, b in zip(lengths, more))
    order = sorted((i for i, n in enumerate(lengths) if n), key=lambda i: -lengths[i])
    for i in order:
        if left <= dp_budget:
            break
        take = min(counts[i] - more[i], left // lengths[i])
        more[i] += take
        left -= take * lengths[i]
    for i, take in knapsack([lengths[i] for i in order], [counts[i] - more[i] for i in order], min(left, dp_budget)).items():
        more[order[i]] += take
    return base, more


def knapsack(lengths: list[int], counts: list[int], budget: int) -> dict[int, int]:
    """How many of each length come nearest to ``budget`` from below.

    Counts are split into powers of two; one bit for each sum says whether it can be reached, and each sum keeps the
    part that reached it first, so that memory grows with the budget only.
    """
    reach, mask = 1, (1 << (budget + 1)) - 1
    parts: list[tuple[int, int]] = []
    first: dict[int, int] = {}
    for i, (n, count) in enumerate(zip(lengths, counts)):
        count, size = min(count, budget // n), 1
        while count and not reach >> budget & 1:
            take = min(size, count)
            fresh = (reach << (take * n)) & mask & ~reach
            reach |= fresh
            bits = bin(fresh)[2:][::-1]
            at = bits.find("1")
            while at >= 0:
                first[at] = len(parts)
                at = bits.find("1", at + 1)
            parts.append((i, take))
            count, size = count - take, size * 2
    at, chosen = reach.bit_length() - 1, {}
    while at:
        i, take = parts[first[at]]
        chosen[i] = chosen.get(i, 0) + take
        at -= take * lengths[i]
    return chosen


def mixing_plan(measured: DataFrame, weights: list[int], most: int, dp_budget: int = DP_BUDGET) -> DataFrame:
    """``_source, _size, total, target, base, cut, part_hash, cut_row``: all documents get ``base`` copies, those with
    ``_hash <= cut`` one more, and so do those with ``part_hash`` up to ``cut_row``.

    ``measured`` must be a written table. Counts by exact length go to one group for each source; its size is the number of
    distinct lengths, not of documents. Ranking at a boundary sees a thousandth of a length's hashes at most.
    """
    targets = source_targets(measured, weights, most)
    by_length = measured.groupBy("_source", "_size").agg(F.count(F.lit(1)).alias("n"))
    per_source = by_length.join(targets, "_source")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_size")
        base, more = fit_lengths(rows["_size"].tolist(), rows["n"].tolist(), float(rows["target"].iloc[0]), dp_budget)
        return rows.assign(base=base, more=more)[["_source", "_size", "n", "total", "target", "base", "more"]]

    fitted = per_source.groupBy("_source").applyInPandas(fit, "_source string, _size bigint, n bigint, total bigint, target double, base bigint, more bigint")
    width = F.ceil(F.lit(1 << HASH_BITS) / F.ceil(F.col("n") / BUCKET_ROWS)).cast("bigint")
    fitted = materialize(fitted.withColumn("width", width), "lengths")

    some = fitted.where("more > 0 and more < n").select("_source", "_size", "more", "width")
    group = ["_source", "_size"]
    placed = with_dimension(measured, some, group, "inner").withColumn("bucket", F.floor(F.col("_hash") / F.col("width").cast("decimal(20,0)")).cast("bigint"))
    hashes = placed.groupBy(*group, "more", "width", "bucket", "_hash").agg(F.count(F.lit(1)).alias("c"))  # repeated rows are one entry
    counts = hashes.groupBy(*group, "more", "bucket").agg(F.sum("c").alias("in_bucket"))
    upto = F.sum("in_bucket").over(Window.partitionBy(*group).orderBy("bucket"))
    edge = counts.withColumn("upto", upto).where((F.col("upto") >= F.col("more")) & (F.col("upto") - F.col("in_bucket") < F.col("more")))
    edge = edge.select(*group, "bucket", (F.col("more") - F.col("upto") + F.col("in_bucket")).alias("need"))
    place = F.sum("c").over(Window.partitionBy(*group, "bucket").orderBy("_hash"))
    last = hashes.select(*group, "bucket", "_hash", "c").join(edge, [*group, "bucket"]).withColumn("place", place)
    last = last.where((F.col("place") >= F.col("need")) & (F.col("place") - F.col("c") < F.col("need")))
    short = F.col("need") - F.col("place") + F.col("c")  # rows of the last hash that are taken
    cuts = last.select(*group, (F.col("_hash") - F.when(short < F.col("c"), 1).otherwise(0)).alias("edge"), F.when(short < F.col("c"), F.col("_hash")).alias("part_hash"), short.alias("part_need"))
    cuts = materialize(cuts, "cuts")
    everyone, nobody = F.lit((1 << HASH_BITS) - 1), F.lit(-1)
    cut = F.when(F.col("more") == 0, nobody).when(F.col("more") >= F.col("n"), everyone).otherwise(F.coalesce("edge", nobody))
    planned = fitted.join(cuts, group, "left").join(_last_rows(measured, cuts), group, "left")
    return materialize(planned.select(*group, "total", "target", "base", cut.cast("bigint").alias("cut"), "part_hash", "cut_row"), "plan")


def _last_rows(measured: DataFrame, cuts: DataFrame) -> DataFrame:
    """``_source, _size, cut_row``: of the rows that share the last hash, which repeated rows do, those up to ``cut_row`` are taken.

    They are counted by input partition first, so that only one partition's rows of that hash are ever ranked together.
    """
    group = ["_source", "_size"]
    parts = cuts.where("part_hash is not null").select(*group, "part_hash", "part_need")
    rows = with_dimension(measured, parts, group, "inner").where("_hash = part_hash").withColumn("_part", F.shiftright("_row", 33))
    counts = rows.groupBy(*group, "_part", "part_need").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*group).orderBy("_part"))
    edge = counts.withColumn("upto", upto).where((F.col("upto") >= F.col("part_need")) & (F.col("upto") - F.col("c") < F.col("part_need")))
    edge = edge.select(*group, "_part", (F.col("part_need") - F.col("upto") + F.col("c")).alias("need"))
    place = F.row_number().over(Window.partitionBy(*group, "_part").orderBy("_row"))
    return rows.select(*group, "_part", "_row").join(edge, [*group, "_part"]).withColumn("place", place).where("place = need").select(*group, F.col("_row").alias("cut_row"))


def _copies() -> Column:
    last = (F.col("_hash") == F.col("part_hash")) & (F.col("_row") <= F.col("cut_row"))
    return F.col("base") + F.when((F.col("_hash") <= F.col("cut")) | F.coalesce(last, F.lit(False)), 1).otherwise(0)


def mix_sizes(docs: DataFrame, weights: list[int], most: int = 3, id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7) -> DataFrame:
    """``id, size, source_size, target, taken`` of every row.

    ``size`` counts words (null text: 0), ``target`` is the source's, ``taken`` the words the mix takes, repeats counted:
    a multiple of the size, at most ``most`` times it. Reruns agree; of rows alike in id and text some may be taken once more than others. Sources may be
    null; a source without words has target 0. An empty table gives no rows. Other columns are not read.
    """
    measured = materialize(docs.select(F.col(id).alias("id"), *[c.alias(n) for n, c in _measured(docs, id, text, source, seed).items()]), "measured")
    plan = mixing_plan(measured, weights, most)
    mixed = with_dimension(measured, plan, ["_source", "_size"], "inner")
    return mixed.select(
        F.col("id").alias(id), F.col("_size").alias("size"), F.col("total").alias("source_size"), "target", (_copies() * F.col("_size")).alias("taken")
    )


def mix(docs: DataFrame, weights: list[int], most: int = 3, id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7) -> DataFrame:
    """The mixed documents: all columns of ``docs``, each row as often as the mix takes it. Documents without words, which
    take no part in a budget of words, stay once."""
    added = _measured(docs, id, text, source, seed)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row_of"), *[c.alias(n) for n, c in added.items()])
    measured = materialize(whole.select(*added), "measured")
    plan = mixing_plan(measured, weights, most)
    if plan.where("cut_row is not null").limit(1).count():  # repeated rows are told apart by their places, which are written once
        whole = materialize(whole, "placed")
        plan = mixing_plan(whole.select(*added), weights, most)
    times = F.when(F.col("_size") == 0, 1).otherwise(_copies()).cast("int")
    mixed = with_dimension(whole, plan.drop("total", "target"), ["_source", "_size"], "inner")
    return mixed.where(times > 0).select("_row_of", F.explode(F.sequence(F.lit(1), times)).alias("_copy")).select("_row_of.*")
