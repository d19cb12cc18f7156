"""Chunk collections stored as partitions, built once."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from ragscale.operators.skew import with_dimension


def stored_collections(chunks: DataFrame, path: str, keys: list[str]) -> DataFrame | None:
    """Keys of the collections under a path, None when there is nothing yet."""
    try:
        stored = chunks.sparkSession.read.schema(chunks.schema).parquet(path)
        return stored.select(*keys).distinct()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def build_collections(chunks: DataFrame, path: str, keys: list[str], force: bool = False) -> None:
    """Write each collection as a partition; stored ones stay unless ``force`` rebuilds them.

    Rebuilding replaces only the partitions present in ``chunks``.
    """
    writer = chunks
    mode = "overwrite"
    if not force:
        stored = stored_collections(chunks, path, keys)
        mode = "append"
        if stored is not None:
            writer = with_dimension(chunks, stored, keys, "left_anti")
    writer.write.partitionBy(*keys).option("partitionOverwriteMode", "dynamic").mode(mode).parquet(path)


def read_collection(chunks_schema, spark, path: str, **wanted: str) -> DataFrame:
    """One collection; only its directory is read."""
    df = spark.read.schema(chunks_schema).parquet(path)
    for key, value in wanted.items():
        df = df.where(F.col(key) == value)
    return df
