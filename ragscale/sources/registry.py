"""Model registry and pass policy as dimension frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ragscale.operators.skew import with_dimension
from ragscale.schemas import REGISTRY


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file ``{model: {display_name, params, role, quants}}``, one row per model."""
    text = spark.read.text(path, wholetext=True)
    models = text.select(F.explode(F.from_json("value", REGISTRY)).alias("model", "_m"))
    return models.select("model", "_m.*")


def model_dim(registry: DataFrame) -> DataFrame:
    """One row per model and quantization, with the model's listing of them."""
    listing = F.array_join(F.array_sort(F.map_keys("quants")), ", ")
    return registry.select(
        "model", "role", listing.alias("quant_list"), F.explode("quants").alias("quantization", "file"))


def roles(registry: DataFrame) -> DataFrame:
    return registry.select("model", "role")


def pass_policy(spark: SparkSession, policy: dict[str, list[str]]) -> DataFrame:
    schema = T.StructType([
        T.StructField("subset", T.StringType()), T.StructField("passes", T.ArrayType(T.StringType()))])
    return spark.createDataFrame(list(policy.items()), schema)


def with_role(df: DataFrame, role_table: DataFrame, model: str = "model") -> DataFrame:
    """Adds the model's role, ``unknown`` when it has none."""
    known = role_table.select(F.col("model").alias(model), "role")
    return with_dimension(df, known, [model]).withColumn("role", F.coalesce("role", F.lit("unknown")))
