"""Raw records from normalized samples and model answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

# Where each field of a raw record is looked up, in order, and its default.
FALLBACKS = {
    "query": (["query", "question"], ""),
    "query_id": (["query_id", "sample_id", "id"], ""),
    "ground_truth": (["ground_truth", "answer"], ""),
    "subset": (["subset"], "default"),
}


def project_raw(samples: DataFrame, constants: dict[str, object] | None = None) -> DataFrame:
    """Sample columns resolved by fallback, other columns kept, run constants added.

    ``constants`` holds what is fixed for a run (run id, timestamp, seed, ...), bound
    once by the caller and not drawn per row.
    """
    used = {name for names, _ in FALLBACKS.values() for name in names}
    rest = [c for c in samples.columns if c not in used]
    picked = []
    for field, (names, default) in FALLBACKS.items():
        have = [F.col(n).cast("string") for n in names if n in samples.columns]
        picked.append(F.coalesce(*have, F.lit(default)).alias(field))
    fixed = [F.lit(v).alias(k) for k, v in (constants or {}).items()]
    return samples.select(*picked, *rest, *fixed)


def to_json_line(df: DataFrame, keep: list[str] | None = None, name: str = "line") -> DataFrame:
    """The row as one JSON text, nulls included."""
    keep = keep or []
    body = [c for c in df.columns if c not in keep]
    return df.select(*keep, F.to_json(F.struct(*body), {"ignoreNullFields": "false"}).alias(name))


def from_json_line(df: DataFrame, schema: T.StructType, name: str = "line") -> DataFrame:
    rest = [c for c in df.columns if c != name]
    return df.select(*rest, F.from_json(name, schema).alias("_d")).select(*rest, "_d.*")
