"""JSON-lines directories: strict, tolerant and pruned scans, and the sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

BAD = "_corrupt_record"
RECORD_FILES = "{*.jsonl,part-*.json}"  # JSON lines, and what the sink writes; other JSON files are no records


def scan_jsonl(spark: SparkSession, path: str, schema: T.StructType, mode: str = "FAILFAST", glob: str = RECORD_FILES) -> DataFrame:
    """All record files of a directory; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", mode).option("pathGlobFilter", glob).json(path)


def scan_tolerant(spark: SparkSession, path: str, schema: T.StructType, glob: str = RECORD_FILES) -> DataFrame:
    """Like ``scan_jsonl``; a malformed line becomes a row with its text in ``_corrupt_record``."""
    wide = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    lines = spark.read.option("pathGlobFilter", glob).text(path).where("trim(value) <> ''")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    return lines.select(F.from_json("value", wide, options).alias("_d")).select("_d.*")


def split_tolerant(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected lines)."""
    good = scanned.where(F.col(BAD).isNull()).drop(BAD)
    return good, scanned.where(F.col(BAD).isNotNull()).select(BAD)


def scan_partitioned(
    spark: SparkSession, path: str, schema: T.StructType, dataset: str | None = None, subset: str | None = None,
) -> DataFrame:
    """A ``dataset=/subset=`` layout; only the wanted directories are read."""
    parts = [T.StructField(c, T.StringType()) for c in ("dataset", "subset")]
    fields = [f for f in schema.fields if f.name not in ("dataset", "subset")]
    df = spark.read.schema(T.StructType([*fields, *parts])).json(path)
    if dataset is not None:
        df = df.where(F.col("dataset") == dataset)
    if subset is not None:
        df = df.where(F.col("subset") == subset)
    return df


def scan_named_files(
    spark: SparkSession, root: str, schema: T.StructType, subset: str | None = None, dataset: str | None = None,
) -> DataFrame:
    """A ``<dataset>/normalized/<subset>.jsonl`` layout; names become columns, folders and files are pruned by name."""
    glob = f"{subset}.jsonl" if subset else "*.jsonl"
    fields = [f for f in schema.fields if f.name not in ("dataset", "subset")]
    df = spark.read.schema(T.StructType(fields)).option("pathGlobFilter", glob).json(f"{root}/{dataset or '*'}/normalized")
    where = F.split(F.col("_metadata.file_path"), "/")
    return df.select(
        "*", F.element_at(where, -3).alias("dataset"),
        F.regexp_replace(F.element_at(where, -1), r"\.jsonl$", "").alias("subset"),
    )


def write_jsonl(df: DataFrame, path: str, mode: str = "append", partition_by: list[str] | None = None) -> None:
    """Records as JSON lines: ``append`` for raw and scored ones, ``overwrite`` for aggregates.

    The scans know the written part files by their names.
    """
    writer = df.write.mode(mode).option("ignoreNullFields", "false")
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", sort_by: list[str] | None = None) -> None:
    """A CSV table with a header, its rows ordered through all files if ``sort_by`` is given."""
    ordered = df.orderBy(*sort_by) if sort_by else df
    ordered.write.mode(mode).option("header", "true").csv(path)
