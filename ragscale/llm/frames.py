"""Carrying columns of any name through operators that add their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def carry(docs: DataFrame, keep: list[str], *extra: Column) -> tuple[DataFrame, str]:
    """Columns ``keep`` as ``k0, k1, ...`` and ``extra`` as ``x0, x1, ...``; and the schema text of ``keep`` under its own names."""
    kept = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    rows = docs.select(*kept, *[e.alias(f"x{i}") for i, e in enumerate(extra)])
    return rows, ", ".join(f"`{c}` {rows.schema[f'k{i}'].dataType.simpleString()}" for i, c in enumerate(keep))


def neutral(docs: DataFrame, *reads: str) -> tuple[DataFrame, list[str]]:
    """All columns as ``c0, c1, ...``, which no operator adds, and the new names of the columns in ``reads``."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), [names[c] for c in reads]


def restored(df: DataFrame, docs: DataFrame, **instead: Column) -> DataFrame:
    """The columns of ``docs`` from ``neutral``'s names, some of them replaced."""
    return df.select(*[instead.get(c, F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)])


def with_names(df: DataFrame, keep: list[str], *added: str) -> DataFrame:
    """``k0, k1, ...`` under their own names again, and the columns ``added``."""
    return df.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *added)
