"""Scored records stored for joins: bucketed by what resuming, pairing and deduplication have in common.

Records go to buckets by their slot, a text of the pairing key and the query in which null is a value of its own. Whatever
groups or joins stored records by slot, alone or with more columns, finds them in place: the record side of resuming,
pairing and last-wins reads its buckets without a shuffle, however often it is asked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ragscale.schemas import PAIR_KEY

SLOT = "_slot"
BUCKETS = 64


def slot(keys: list[str]) -> Column:
    """Text that is equal for equal keys, nulls being equal to each other and to nothing else."""
    return F.to_json(F.struct(*[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)]), {"ignoreNullFields": "false"})


def store_records(records: DataFrame, name: str, path: str, keys: list[str] = PAIR_KEY, query: str = "query_id", buckets: int = BUCKETS, mode: str = "overwrite") -> DataFrame:
    """Write records to ``path`` as table ``name``, or add them to it with ``mode="append"`` and the same ``buckets``."""
    placed = records.withColumn(SLOT, slot([*keys, query])).repartition(buckets, SLOT)  # one file for each bucket
    placed.write.format("parquet").bucketBy(buckets, SLOT).sortBy(SLOT).option("path", path).mode(mode).saveAsTable(name)
    return records.sparkSession.table(name)


def open_store(spark: SparkSession, name: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """The stored records, known to the catalog again where a new application has lost the name."""
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        spark.sql(f"create table {name} ({columns}) using parquet clustered by ({SLOT}) sorted by ({SLOT}) into {buckets} buckets location '{path}'")
    return spark.table(name)


def last_stored(store: DataFrame, key: list[str], order_by: str) -> DataFrame:
    """``incremental.last_wins`` in place; ``key`` includes the pairing key and the query."""
    rest = [c for c in store.columns if c not in (*key, SLOT)]
    picked = store.groupBy(SLOT, *key).agg(F.max_by(F.struct(*rest), F.col(order_by)).alias("_r"))
    return picked.select(*key, "_r.*")


def stored_pairs(store: DataFrame, order_by: str, loose: str, strict: str, keys: list[str] = PAIR_KEY, query: str = "query_id", metric: str = "cu") -> DataFrame:
    """``aggregate.paired_passes`` in place: last scores of both passes of a query that has both, and their gap."""
    last = lambda p: F.max_by(F.when(F.col("pass") == p, F.struct(metric)), F.when(F.col("pass") == p, F.col(order_by)))[metric]
    both = store.where(F.col("pass").isin(loose, strict)).groupBy(SLOT, *keys, query).agg(last(loose).alias("loose"), last(strict).alias("strict"))
    return both.where("loose is not null and strict is not null").select(*keys, query, "loose", "strict", (F.col("strict") - F.col("loose")).alias("preference_gap"))


def remaining_of_store(todo: DataFrame, store: DataFrame, keys: list[str] = PAIR_KEY, query: str = "query_id") -> DataFrame:
    """``incremental.remaining_work`` in place: planned work whose pass isn't stored for its slot. Blank ids never count as done."""
    done = store.where(F.col(query).isNotNull() & (F.col(query).cast("string") != ""))
    passes = done.groupBy(SLOT).agg(F.collect_set(F.coalesce(F.concat(F.lit("="), F.col("pass")), F.lit(""))).alias("_passes"))  # the few passes of a query
    planned = todo.withColumn(SLOT, slot([*keys, query])).withColumn("_pass", F.coalesce(F.concat(F.lit("="), F.col("pass")), F.lit("")))
    joined = planned.join(passes, SLOT, "left")
    return joined.where(~F.coalesce(F.array_contains("_passes", F.col("_pass")), F.lit(False))).drop(SLOT, "_pass", "_passes")
