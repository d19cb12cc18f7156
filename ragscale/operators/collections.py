"""Resolving logical collection names against a catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def resolve_collections(
    names: DataFrame, catalog: DataFrame, prefix: str, marker: str = "_300w_", name: str = "name",
    actual: str = "actual",
) -> DataFrame:
    """``(name, actual, rule)`` per requested name; ``actual`` is null when nothing or too much matches.

    Rules in order: the exact name; the name without ``prefix`` and without the
    last ``marker`` and what follows; the only catalog name holding ``_name_``.
    Every rule is an equality join on a key derived from the catalog name.
    """
    wanted = names.select(name).distinct()
    known = catalog.select(actual).distinct()
    quoted = "".join(c if c.isalnum() or c == "_" else "\\" + c for c in marker)
    bare = F.regexp_extract(F.col(actual), f"^(.*){quoted}.*$", 1)
    at = F.instr(F.col("_cut"), prefix)
    core = F.when(at == 0, F.col("_cut")).otherwise(
        F.concat(F.substring("_cut", F.lit(1), at - 1), F.substring("_cut", at + len(prefix), F.length("_cut")))
    )
    # stripping the prefix first cannot change which marker is last
    stripped = known.withColumn(
        "_cut", F.when(F.col(actual).contains(marker), bare).otherwise(F.col(actual))
    ).withColumn("_key", core)
    parts = F.split(F.col(actual), "_")
    runs = F.flatten(F.transform(
        F.sequence(F.lit(2), F.greatest(F.size(parts) - 1, F.lit(2))),
        lambda i: F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(parts) - i, F.lit(1))),
            lambda n: F.array_join(F.slice(parts, i, n), "_"),
        ),
    ))
    inner = known.where(F.size(parts) >= 3).select(actual, F.explode(F.array_distinct(runs)).alias("_key"))
    ranked = (
        known.select(F.col(actual).alias("_key"), F.col(actual), F.lit(1).alias("_rank"))
        .unionByName(stripped.select("_key", actual, F.lit(2).alias("_rank")))
        .unionByName(inner.select("_key", actual, F.lit(3).alias("_rank")))
    )
    # one row per key before the join: a word in every catalog name is no hot key
    per_key = ranked.groupBy("_key").agg(
        F.min(F.when(F.col("_rank") == 1, F.col(actual))).alias("_exact"),
        F.min(F.when(F.col("_rank") == 2, F.col(actual))).alias("_core"),
        F.min(F.when(F.col("_rank") == 3, F.col(actual))).alias("_inner"),
        F.count(F.when(F.col("_rank") == 3, 1)).alias("_n"),
    )
    best = wanted.join(per_key, wanted[name] == per_key["_key"], "left")
    rule = (
        F.when(F.col("_exact").isNotNull(), "exact")
        .when(F.col("_core").isNotNull(), "core")
        .when(F.col("_n") == 1, "inner")
        .when(F.col("_n") > 1, "ambiguous")
        .otherwise("unknown")
    )
    found = F.coalesce("_exact", "_core", F.when(F.col("_n") == 1, F.col("_inner")))
    return best.select(name, found.alias(actual), rule.alias("rule"))
