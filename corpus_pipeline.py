"""From raw documents to packed training sequences, one written stage after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ragscale.llm import language
from ragscale.llm.fertility import learned_rules
from ragscale.llm.frames import neutral, restored
from ragscale.llm.mixing import mix
from ragscale.llm.packing import pack
from ragscale.llm.queries import vocabulary
from ragscale.llm.similar import one_per_similar
from ragscale.operators.skew import with_dimension
from ragscale.session import materialize

LEAST_SHARE = 0.5  # of a document's words in its main language
WEIGHTS = [1, 2, 3]
# Stages follow each other in the same executors, whose JVM keeps the heap that near-dedup needed; so less is held at once than
# where an operator has an executor to itself.
SLICE = 3 << 18  # bytes of text that packing tokenizes at once
MEASURED = 1 << 20  # and that the quality rules measure
COUNTED = 2 << 20  # and whose n-grams are counted; half of it is identified at once
CELLS = 8 << 20  # transitions of a vocabulary that a worker keeps
BATCH_ROWS = 500  # documents that travel to a Python worker at once
REJECTED_ROWS = 1_000_000  # digests of rejected texts that are broadcast at most


def bounded(spark: SparkSession) -> None:
    """From here on smaller Arrow batches than the session's, unless its own are smaller still."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(setting, "0"))  # 0: no bound
    spark.conf.set(setting, str(now if 0 < now < BATCH_ROWS else BATCH_ROWS))


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose main language has under half of the words; a null ``lang`` is filled in."""
    bounded(spark)
    plain, (text, lang) = neutral(docs, "text", "lang")
    told = language.identify(plain, language.learn(docs, slice_bytes=COUNTED), plain.columns, text, slice_bytes=COUNTED)
    good = told.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SHARE))
    return restored(good, docs, lang=F.coalesce(lang, "lang_pred"))


def check_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or lie outside the bands learned for their script and language."""
    bounded(spark)
    plain, (text, lang) = neutral(docs, "text", "lang")
    vocabularies = vocabulary("piece_bpe_32k.model"), vocabulary("word_bpe_49k.json")
    # The verdict follows from text and language. It is written with a digest of the text, so that no text is written again.
    marks = {f"mark{i}": F.xxhash64(F.lit(i), F.col(text).cast("string")) for i in range(2)}
    rows, keys = plain.withColumns(marks), [*marks, lang]
    told = learned_rules(rows.select(*keys, text), *vocabularies, keys, text, lang, MEASURED, CELLS)
    rejected = materialize(told.where(~F.coalesce("kept", F.lit(False))).select(*keys).distinct(), "rejected")
    return restored(with_dimension(rows, rejected, keys, "left_anti", REJECTED_ROWS), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group joined by a similarity of 0.8 or more of their five-word shingles."""
    bounded(spark)
    return one_per_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents until each source has its target of words."""
    return mix(docs, WEIGHTS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, with their ids."""
    bounded(spark)
    return pack(docs, vocabulary("word_bpe_49k.json"), with_ids=True, slice_bytes=SLICE, max_cells=CELLS)


STAGES = [
    ("language ID", identify_languages),
    ("quality rules", check_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # language mixtures, fertility and packing have no SQL; the tests redo the stages by brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
