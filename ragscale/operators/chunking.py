"""From normalized samples to numbered chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ragscale.functions.text import chunk_count, chunk_words, exploded, is_blank, words
from ragscale.operators.skew import join_same, with_dimension
from ragscale.schemas import CHUNK_OVERLAP, CHUNK_WORDS
from ragscale.session import materialize


def sample_passages(original: Column, knowledge: Column) -> Column:
    """Indexable texts of a sample: the non-blank passages, then the knowledge text."""
    none = F.array().cast("array<string>")
    kept = F.filter(F.coalesce(original, none), lambda p: ~is_blank(p))
    return F.concat(kept, F.when(is_blank(knowledge), none).otherwise(F.array(knowledge)))


def extract_passages(samples: DataFrame, metadata: str = "metadata") -> DataFrame:
    """One row per indexable passage with its position in the sample."""
    texts = sample_passages(F.col(f"{metadata}.original_passages"), F.col(f"{metadata}.knowledge"))
    rest = [c for c in samples.columns if c != metadata]
    return exploded(samples, rest, texts, "text", "passage")


def chunk_passages(
    df: DataFrame, text: str = "text", size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """One row per chunk of a text, replacing the text column; ``chunk_index`` counts within it."""
    rest = [c for c in df.columns if c != text]
    split = df.withColumn("_words", words(text))
    pieces = chunk_words(F.col(text), size, overlap, F.col("_words"))
    return exploded(split, rest, pieces, text, "chunk_index")


def running_start(df: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the group, as ``start``.

    Rows are range-partitioned by (group, order) and the slice of each row is
    written once, so slice totals and in-slice sums agree whatever a retry does.
    Only slice totals meet per group; a group of any size stays spread out.
    """
    narrow = df.select(*group, *order, value)
    sliced = narrow.repartitionByRange(*group, *order)
    fixed = materialize(sliced.withColumn("_slice", F.spark_partition_id()), "slices")
    inside = Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = fixed.groupBy(*group, "_slice").agg(F.sum(value).alias("_total")).select(
        *group, "_slice", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base")
    )
    local = fixed.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return join_same(local, totals, [*group, "_slice"]).select(
        *group, *order, (F.col("_base") + F.col("_local")).cast("bigint").alias("start")
    )


def number_chunks(
    passages: DataFrame, sample: str = "sample_id", group: list[str] | None = None, text: str = "text",
    size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP, marks: DataFrame | None = None,
) -> DataFrame:
    """Chunks with ids ``<sample>_chunk_<n>``, n counting through the whole collection, from ``first`` of ``marks`` (group, first) on.

    Needs columns group, sample, ``passage`` and text, unique in the first three; any may be null. A null sample
    takes the fallback id of ``sample_ids`` in its chunk ids.
    """
    group = group or ["dataset", "subset"]
    order = [sample, "passage"]
    counts = passages.withColumn("n_chunks", chunk_count(F.size(words(text)), size, overlap))
    starts = running_start(counts, group, order, "n_chunks")
    if marks is not None:
        starts = with_dimension(starts, marks, group).withColumn("start", F.col("start") + F.coalesce("first", F.lit(0))).drop("first")
    chunks = chunk_passages(join_same(passages, starts, [*group, *order]), text, size, overlap)
    number = (F.col("start") + F.col("chunk_index")).cast("string")
    named = F.coalesce(F.col(sample).cast("string"), fallback_id(group))
    return chunks.withColumns({"chunk_id": F.concat_ws("_chunk_", named, number), "number": number.cast("bigint")}).drop("start")


def fallback_id(group: list[str], *content: str) -> Column:
    """``<group>_<digest>``: a line's number is not stable where files are read in parallel, its content is."""
    parts = [F.coalesce(F.col(g).cast("string"), F.lit("")) for g in group]
    if content:
        parts.append(F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in content]), 256), 1, 16))
    return F.concat_ws("_", *parts)


def sample_ids(samples: DataFrame, content: list[str], sample: str = "sample_id", group: list[str] | None = None) -> DataFrame:
    """Null or blank sample ids replaced by ``<dataset>_<subset>_<digest of the content columns>``."""
    have = F.when(F.trim(F.col(sample).cast("string")) != "", F.col(sample).cast("string"))
    return samples.withColumn(sample, F.coalesce(have, fallback_id(group or ["dataset", "subset"], *content)))
