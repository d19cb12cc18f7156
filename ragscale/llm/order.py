"""Dense numbering of rows in a total order, without bringing them to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ragscale.session import materialize


def numbered(df: DataFrame, order: list[Column], out: str = "rank") -> tuple[DataFrame, int]:
    """Rows with their number (from 0) in ``order``, and how many there are: ranges are sorted apart, their sizes added up.

    Rows equal in ``order`` get consecutive numbers in any order. What reaches the driver is one size for each range.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = materialize(ranged.withColumn("_mid", F.monotonically_increasing_id()), "order")
    placed = placed.withColumn("_part", F.shiftright("_mid", 33))
    before, total = [], 0
    for row in sorted(placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()):
        before.append((row["_part"], total))
        total += row["n"]
    offsets = spark.createDataFrame(before, "_part bigint, _before bigint")
    at = F.col("_before") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(offsets), "_part").select(*df.columns, at.alias(out)), total
