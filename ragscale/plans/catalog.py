"""Registry of named queries over the study tables, each with its SQL equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


NUDGE = 1.2345678e-8  # moves exact decimal ties, which engines round differently, off the tie


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison across engines."""
    out: list[Column] = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.dataType.typeName() in ("double", "float"):
            c = F.round(c + F.lit(NUDGE), digits).alias(f.name)
        out.append(c)
    return df.select(*out)


def r6(expr: str, name: str, digits: int = 6) -> str:
    """The SQL counterpart of ``rounded`` for one expression."""
    return f"round({expr} + {NUDGE}::double, {digits}) as {name}"
