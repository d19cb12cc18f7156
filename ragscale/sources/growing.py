"""Numbered chunk collections that grow as files arrive, stored chunks keeping their ids.

Each call is a build of its own under ``build=<n>``: files that no earlier build has read (by path, length and time) are read,
samples whose content is stored already are left out by their digests, and new chunks are numbered from each collection's
high-water mark on. The list of a build's files is written last and makes the build count; a build that failed
before that is replaced by the next one.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ragscale.operators.chunking import extract_passages, number_chunks
from ragscale.operators.skew import join_same
from ragscale.schemas import CHUNK_OVERLAP, CHUNK_WORDS
from ragscale.session import materialize
from ragscale.sources.lines import FILE, LINE, file_part, line_ids, scan_numbered, split_numbered

GROUP = ["dataset", "subset"]
_FILES = "path string, length bigint, modificationTime timestamp"


def _stored(spark: SparkSession, path: str, name: str, build: int) -> DataFrame | None:
    """A table of the builds that count, up to ``build``."""
    if build < 0:
        return None
    return spark.read.parquet(f"{path}/{name}").where(F.col("build") <= build).drop("build")


def last_build(spark: SparkSession, path: str) -> int:
    """Number of the last build that counts, -1 if there is none."""
    try:
        return spark.read.schema(_FILES + ", build int").parquet(f"{path}/files").agg(F.max("build")).first()[0]
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return -1
        raise


def grown(spark: SparkSession, path: str) -> DataFrame:
    """All chunks of the builds that count."""
    return spark.read.parquet(f"{path}/chunks").where(F.col("build") <= last_build(spark, path))


def grow(spark: SparkSession, root: str, path: str, schema: T.StructType, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> int:
    """Read what is new under ``root/<dataset>/normalized/<subset>.jsonl`` into the collections at ``path``; the number of new files.

    ``schema`` has ``sample_id`` and ``metadata``. Samples without an id take ``<dataset>_<subset>_<line>``; malformed lines are
    written to ``rejects`` with file and line. A file that changed is read again, and of its samples only new ones are added.
    """
    build = last_build(spark, path)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(f"{root}/*/normalized").select("path", "length", "modificationTime")
    known = _stored(spark, path, "files", build)
    new = materialize(found if known is None else found.join(known, ["path", "length", "modificationTime"], "left_anti"), "new-files")
    paths = [r["path"] for r in new.select("path").orderBy("path").collect()]  # what the driver has listed anyway
    if not paths:
        return 0
    good, bad = split_numbered(scan_numbered(spark, paths, schema, "*.jsonl"))
    tagged = good.withColumns({"dataset": file_part(3), "subset": F.regexp_replace(file_part(1), r"\.jsonl$", "")})
    samples = line_ids(tagged, group=GROUP).withColumn("digest", F.sha2(F.to_json(F.struct("sample_id", "metadata"), {"ignoreNullFields": "false"}), 256))
    samples = samples.groupBy(*GROUP, "digest").agg(F.min_by(F.struct("sample_id", "metadata"), F.struct(FILE, LINE)).alias("_s")).select(*GROUP, "digest", "_s.*")
    earlier = _stored(spark, path, "samples", build)
    if earlier is not None:
        samples = join_same(samples, earlier, [*GROUP, "digest"], "left_anti")
    samples = materialize(samples, "new-samples")
    marks = _stored(spark, path, "marks", build)
    if marks is not None:
        marks = marks.groupBy(*GROUP).agg(F.max("next").alias("first"))
    passages = extract_passages(samples.select(*GROUP, F.concat_ws("\x1f", "sample_id", "digest").alias("_order"), "sample_id", "metadata"))
    chunks = number_chunks(passages, "_order", GROUP, size=size, overlap=overlap, marks=marks)
    chunks = chunks.withColumn("chunk_id", F.concat_ws("_chunk_", "sample_id", "number")).drop("_order")
    at = build + 1

    def write(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{path}/{name}/build={at}")

    write(chunks, "chunks")
    write(samples.select(*GROUP, "digest"), "samples")
    write(bad, "rejects")
    write(spark.read.parquet(f"{path}/chunks/build={at}").groupBy(*GROUP).agg((F.max("number") + 1).alias("next")), "marks")
    write(new, "files")
    return len(paths)
