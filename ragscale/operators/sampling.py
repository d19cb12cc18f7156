"""Reproducible samples: exact size per stratum, and a seeded take over everything."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ragscale.functions.hashing import seeded_rank_key
from ragscale.operators.skew import shuffle_partitions

FAN_IN = 32  # slices whose survivors meet in one task of the next round


def stratified_sample(
    df: DataFrame, stratum: str, sizes: dict[str, int], key: list[str], seed: int = 42,
) -> DataFrame:
    """``min(size, available)`` rows of each named stratum, without replacement.

    Rows are ranked by a seeded hash in rounds: inside (stratum, slice) with ever fewer slices, each keeping at most
    the stratum's own size, until one slice is left. No task sees more than a few slices' survivors, whatever the
    stratum's size and however many rows are asked for elsewhere.
    """
    wanted = F.create_map(*[x for s, n in sizes.items() for x in (F.lit(s), F.lit(n))])
    ranked = df.where(F.col(stratum).isin(*sizes)).withColumn("_rank", seeded_rank_key(seed, *key))
    hashed = F.xxhash64("_rank")
    slices = shuffle_partitions(df)
    while True:
        ranked = ranked.withColumn("_slice", F.pmod(hashed, F.lit(slices)))
        w = Window.partitionBy(stratum, "_slice").orderBy("_rank", *key)
        ranked = ranked.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= wanted[F.col(stratum)])
        if slices == 1:
            return ranked.drop("_n", "_rank", "_slice")
        slices = max(1, slices // FAN_IN)


def seeded_take(frames: dict[str, DataFrame], n: int, key: list[str], seed: int = 42) -> DataFrame:
    """n rows of the tagged union of several frames, in seeded random order."""
    tagged = [df.withColumn("source_file", F.lit(name)) for name, df in frames.items()]
    union = reduce(lambda a, b: a.unionByName(b), tagged)
    return union.orderBy(seeded_rank_key(seed, "source_file", *key), "source_file", *key).limit(n)


def prefix(df: DataFrame, key: list[str], n: int) -> DataFrame:
    """The first n rows in key order."""
    return df.orderBy(*key).limit(n)


def union_all(*frames: DataFrame) -> DataFrame:
    """Multiset union by column name."""
    return reduce(lambda a, b: a.unionByName(b), frames)
