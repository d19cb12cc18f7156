"""Checks and censuses over records: contract, failures, errors, determinism."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ragscale.operators.skew import join_same
from ragscale.schemas import CONFIG_KEY, GAP_METRIC, METRICS, PASSES, PROVIDERS, SCORE_FIELDS, SOURCES

# JSON types each field of a raw record may have.
RAW_TYPES = {
    "run_id": ["STRING"],
    "timestamp": ["STRING"],
    "model": ["STRING"],
    "quantization": ["STRING"],
    "source": ["STRING"],
    "provider": ["STRING", "VOID"],
    "dataset": ["STRING"],
    "subset": ["STRING"],
    "pass": ["STRING"],
    "seed": ["BIGINT"],
    "query_id": ["STRING"],
    "query": ["STRING"],
    "context_chunks": ["ARRAY", "VOID"],
    "ground_truth": ["STRING"],
    "response": ["STRING"],
    "generation_time_ms": ["BIGINT", "DOUBLE", "DECIMAL", "FLOAT"],
    "scores": ["OBJECT"],
}
NUMBER = ["BIGINT", "DOUBLE", "DECIMAL", "FLOAT"]


def _kinds(doc: Column, path: str) -> Column:
    """JSON type name of each field of the object at a path."""
    fields = F.try_variant_get(doc, path, "map<string,variant>")
    return F.transform_values(fields, lambda _, v: F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0))


def _type_rules(kinds: Column, allowed: dict[str, list[str]], prefix: str = "") -> Column:
    """Broken presence and type rules of a table of fields, nulls in between."""
    spec = F.array(*[
        F.struct(F.lit(name).alias("name"), F.array(*[F.lit(t) for t in types]).alias("types"))
        for name, types in allowed.items()])

    def broken(rule: Column) -> Column:
        kind = F.coalesce(F.try_element_at(kinds, rule["name"]), F.lit(""))
        label = F.concat(F.lit(prefix), rule["name"])
        return F.when(kind == "", F.concat(F.lit("missing:"), label)).when(
            ~F.array_contains(rule["types"], kind), F.concat(F.lit("type:"), label))

    return F.transform(spec, broken)


def raw_violations(lines: DataFrame, text: str = "line") -> DataFrame:
    """Adds ``violations``: the contract rules a raw JSON record breaks. Extra fields are fine.

    A line is parsed once and each field's type read once; the rules are data, so
    the generated code stays small enough to be compiled.
    """
    none = F.array().cast("array<string>")
    doc, top = F.col("_doc"), F.col("_top")
    parsed = lines.withColumn("_doc", F.try_parse_json(F.col(text)))
    typed = parsed.withColumn("_top", _kinds(doc, "$")).withColumn("_scores", _kinds(doc, "$.scores.ragchecker"))
    rules = _type_rules(top, RAW_TYPES)
    scores = _type_rules(F.col("_scores"), {f: NUMBER for f in SCORE_FIELDS}, "scores.")
    scored = F.try_element_at(top, F.lit("scores")) == "OBJECT"
    values = []
    for name, known in {"source": SOURCES, "pass": PASSES, "provider": PROVIDERS}.items():
        value = F.try_variant_get(doc, f"$.{name}", "string")
        values.append(F.when(~value.isin(*known), F.lit(f"value:{name}")))
    found = F.concat(rules, F.when(scored, scores).otherwise(none), F.array(*values))
    checked = typed.withColumn(
        "violations", F.when(top.isNull(), F.array(F.lit("malformed"))).otherwise(F.array_compact(found)))
    return checked.drop("_doc", "_top", "_scores")


def aggregated_violations(df: DataFrame) -> DataFrame:
    """Adds ``violations`` to aggregated rows: interval order, counts, missing statistics."""
    rules = [
        F.when(~((F.col("ci_lo") <= F.col("mean")) & (F.col("mean") <= F.col("ci_hi"))), F.lit("ci_order")),
        F.when(F.col("n_queries") <= 0, F.lit("n_queries")),
        F.when(F.col("std") < 0, F.lit("negative_std")),
        F.when(F.col("capability_degraded").isNull(), F.lit("missing:capability_degraded")),
        *[F.when(F.col(c).isNull(), F.lit(f"missing:{c}")) for c in ("mean", "ci_lo", "ci_hi", "std")],
    ]
    return df.withColumn("violations", F.array_compact(F.array(*rules)))


# JSON types each field of an aggregated record may have.
AGGREGATED_TYPES = {
    "model": ["STRING"], "quantization": ["STRING"], "source": ["STRING"], "dataset": ["STRING"], "subset": ["STRING"], "pass": ["STRING"],
    "n_queries": ["BIGINT"], "metrics": ["OBJECT"], "capability_degraded": ["BOOLEAN"],
}


def aggregated_record_violations(lines: DataFrame, text: str = "line", names: list[str] | None = None) -> DataFrame:
    """Adds ``violations``: the contract rules an aggregated JSON record breaks, its exact set of metrics included."""
    names = names or [*METRICS, GAP_METRIC]
    doc = F.col("_doc")
    parsed = lines.withColumn("_doc", F.try_parse_json(F.col(text)))
    held = F.map_keys(F.try_variant_get(doc, "$.metrics", "map<string,variant>"))  # names only: no rule is about a metric's type
    typed = parsed.withColumn("_top", _kinds(doc, "$")).withColumn("_metrics", held)
    have = F.col("_metrics")
    found = [_type_rules(F.col("_top"), AGGREGATED_TYPES)]
    found.append(F.transform(F.array_except(F.array(*map(F.lit, names)), have), lambda m: F.concat(F.lit("missing:metrics."), m)))
    found.append(F.transform(F.array_except(have, F.array(*map(F.lit, names))), lambda m: F.concat(F.lit("unknown:metrics."), m)))
    stats = F.from_json(F.get_json_object(F.col(text), "$.metrics"), "map<string, struct<mean: double, ci_lo: double, ci_hi: double, std: double>>")
    entries = F.map_entries(F.col("_stats"))
    typed = typed.withColumn("_stats", stats)
    incomplete = F.filter(entries, lambda e: e["value"]["mean"].isNull() | e["value"]["ci_lo"].isNull() | e["value"]["ci_hi"].isNull() | e["value"]["std"].isNull())
    crossed = F.filter(entries, lambda e: (e["value"]["ci_lo"] > e["value"]["mean"]) | (e["value"]["mean"] > e["value"]["ci_hi"]))
    found.append(F.transform(incomplete, lambda e: F.concat(F.lit("stats:"), e["key"])))
    found.append(F.transform(crossed, lambda e: F.concat(F.lit("order:"), e["key"])))
    count = F.try_variant_get(doc, "$.n_queries", "bigint")
    found.append(F.array(F.when(count <= 0, F.lit("value:n_queries"))))
    whole = F.array_compact(F.concat(*[F.coalesce(f, F.array().cast("array<string>")) for f in found]))
    checked = typed.withColumn("violations", F.when(F.col("_top").isNull(), F.array(F.lit("malformed"))).otherwise(whole))
    return checked.drop("_doc", "_top", "_metrics", "_stats")


def violation_counts(checked: DataFrame) -> DataFrame:
    # explode_outer: a plain explode would copy the whole rule set into a filter below it
    rules = checked.select(F.explode_outer("violations").alias("rule")).where("rule is not null")
    return rules.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def score_or_default(records: DataFrame, scores: DataFrame, key: list[str], metrics: list[str]) -> DataFrame:
    """Records with their scores; where scoring failed all metrics are 0.0 and ``is_failed`` is set."""
    right = scores.select(*key, *metrics, F.lit(True).alias("_scored"))
    joined = join_same(records, right, key, "left")
    rest = [c for c in records.columns]
    return joined.select(
        *rest, *[F.coalesce(F.col(m), F.lit(0.0)).alias(m) for m in metrics],
        F.col("_scored").isNull().alias("is_failed"),
    )


def error_census(df: DataFrame, keys: list[str] = CONFIG_KEY, error: str = "error") -> DataFrame:
    """Errors per configuration and category with their share of the configuration's records.

    Totals come from the category counts, so records shuffle once.
    """
    cells = df.groupBy(*keys, error).agg(F.count(F.lit(1)).alias("n"))
    totals = cells.groupBy(*keys).agg(F.sum("n").alias("n_records"))
    out = join_same(cells.where(F.col(error).isNotNull()), totals, keys)
    return out.withColumn("rate", F.col("n") / F.col("n_records"))


def determinism_per_query(df: DataFrame, query: str = "query", response: str = "response", examples: int = 5) -> DataFrame:
    """Distinct responses over seeds per query with a few examples.

    Responses are made distinct first; only ``examples`` of them are then kept
    per query, so a query with many responses never gathers in one row.
    """
    distinct = df.groupBy(query, response).agg(F.count(F.lit(1)).alias("n_runs"))
    counts = distinct.groupBy(query).agg(
        F.count(F.lit(1)).alias("n_unique_responses"), F.sum("n_runs").alias("n_runs")
    )
    rank = F.row_number().over(Window.partitionBy(query).orderBy(response))
    first = distinct.withColumn("_r", rank).where(F.col("_r") <= examples).groupBy(query).agg(
        F.sort_array(F.collect_list(response)).alias("unique_responses")
    )
    return join_same(counts, first, [query])


def determinism_summary(df: DataFrame, query: str = "query", seed: str = "seed", response: str = "response") -> DataFrame:
    """One row: seeds, queries, divergent queries and whether all runs agree."""
    distinct = df.groupBy(query, response).agg(F.count(F.lit(1)).alias("_n"))
    per_query = distinct.groupBy(query).agg(F.count(F.lit(1)).alias("_u"))
    divergent = per_query.agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.coalesce(F.sum(F.when(F.col("_u") > 1, 1).otherwise(0)), F.lit(0)).alias("n_divergent_queries"),
    )
    seeds = df.agg(F.countDistinct(seed).alias("n_seeds"))
    return divergent.select(
        (F.col("n_divergent_queries") == 0).alias("deterministic"), seeds.scalar().alias("n_seeds"),
        "n_queries", "n_divergent_queries")
