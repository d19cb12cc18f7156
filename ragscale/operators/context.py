"""From ranked chunks to the context of each query."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ragscale.operators.skew import small
from ragscale.session import materialize


def gather_context(
    found: DataFrame, chunks: DataFrame, query_id: str = "query_id", chunk_id: str = "chunk_id", text: str = "text",
) -> DataFrame:
    """``(query, context_chunks)``: the found chunks' texts, most relevant first.

    A query has as many chunks as the search returned, so a row stays small.
    """
    texts = small(materialize(found, "found")).join(chunks.select(chunk_id, text), chunk_id)  # few ids: texts stay where they are
    ordered = F.sort_array(F.collect_list(F.struct("rank", text)))
    return texts.groupBy(query_id).agg(ordered.alias("_c")).select(
        query_id, F.transform("_c", lambda c: c[text]).alias("context_chunks"))


def with_context(queries: DataFrame, contexts: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Every query with its context; null where nothing was found."""
    return queries.join(contexts, query_id, "left")
