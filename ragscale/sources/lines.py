"""Exact line numbers from a parallel read of text files.

A file is read in splits by many tasks. Inside a split its lines come one after the other, so a row's place among the
rows of its split is known without moving it; the lines of each split are counted once, and the sums over the splits
before it in the file, which are a small table, give every line its number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from ragscale.functions.text import is_blank
from ragscale.operators.chunking import fallback_id
from ragscale.operators.skew import with_dimension
from ragscale.session import materialize
from ragscale.sources.jsonl import BAD, RECORD_FILES

FILE, LINE = "_file", "_line"


def numbered_lines(spark: SparkSession, path: str | list[str], glob: str = RECORD_FILES) -> DataFrame:
    """``_file, _line, value`` of all lines, blank ones included; lines count from 1 in each file.

    The files must not change between the count and the read that follows it.
    """
    where = [F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias("_block")]
    read = spark.read.option("pathGlobFilter", glob).text(path)
    lines = read.select(*where, F.monotonically_increasing_id().alias("_at"), "value")
    splits = lines.groupBy(FILE, "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(FILE).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = materialize(splits.select(FILE, "_block", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift")), "splits")
    placed = with_dimension(lines, offsets, [FILE, "_block"], "inner")
    return placed.select(FILE, (F.col("_at") + F.col("_shift") + 1).alias(LINE), "value")


def scan_numbered(spark: SparkSession, path: str | list[str], schema: T.StructType, glob: str = RECORD_FILES) -> DataFrame:
    """Like ``scan_tolerant`` with the file and the line of every row, also of malformed ones. Blank lines are counted and skipped."""
    wide = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    lines = numbered_lines(spark, path, glob).where(~is_blank("value"))
    return lines.select(FILE, LINE, F.from_json("value", wide, options).alias("_d")).select(FILE, LINE, "_d.*")


def split_numbered(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows with file and line, rejects as ``_file, _line, _corrupt_record``)."""
    return scanned.where(F.col(BAD).isNull()).drop(BAD), scanned.where(F.col(BAD).isNotNull()).select(FILE, LINE, BAD)


def line_ids(samples: DataFrame, sample: str = "sample_id", group: list[str] | None = None) -> DataFrame:
    """Null or blank sample ids replaced by ``<dataset>_<subset>_<line>``."""
    have = F.when(~is_blank(F.col(sample).cast("string")), F.col(sample).cast("string"))
    return samples.withColumn(sample, F.coalesce(have, F.concat_ws("_", fallback_id(group or ["dataset", "subset"]), F.col(LINE).cast("string"))))


def file_part(number: int) -> Column:
    """A part of ``_file`` counted from the end (1: the file's name)."""
    return F.element_at(F.split(FILE, "/"), -number)
