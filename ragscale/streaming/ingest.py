"""Running statistics over scored records as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from ragscale.functions.scoring import or_zero
from ragscale.schemas import CONFIG_KEY
from ragscale.session import work_path


def running_stats(
    stream: DataFrame, record_key: list[str], keys: list[str] = CONFIG_KEY, metric: str = "cu",
    late_after: str | None = None, event_time: str = "timestamp",
) -> DataFrame:
    """Count, mean and deviation per configuration; a record delivered twice counts once.

    The state holds one entry per record key. ``late_after`` bounds it to records
    younger than that, for callers whose re-deliveries are no later.
    """
    if late_after:
        once = stream.withWatermark(event_time, late_after).dropDuplicatesWithinWatermark([*keys, *record_key])
    else:
        once = stream.dropDuplicates([*keys, *record_key])
    return once.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.avg(or_zero(F.col(metric))).alias("mean"),
        or_zero(F.stddev_samp(or_zero(F.col(metric)))).alias("std"),
    )


def drain(stats: DataFrame, name: str = "running", keys: list[str] = CONFIG_KEY) -> DataFrame:
    """Process everything available now and return the statistics as a table.

    Each micro-batch writes the rows of the configurations that changed under its own number, so a batch that is run
    again replaces itself; the last row of each configuration counts. The streaming checkpoint replaces a list of
    finished ids.
    """
    spark = stats.sparkSession
    path = work_path(spark, name)
    spark.createDataFrame([], stats.schema).write.parquet(f"{path}/changes/batch=-1")  # stays if nothing arrives

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/changes/batch={batch_id}")

    query = (
        stats.writeStream.outputMode("update").foreachBatch(save)
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    changes = spark.read.schema(T.StructType([*stats.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{path}/changes")
    rest = [c for c in stats.columns if c not in keys]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")
