"""Message lists for a chat endpoint."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ragscale.functions.text import format_context
from ragscale.schemas import PROMPTS

_PLACEHOLDER = re.compile(r"\{(query|context)\}")


def _fill(template: str, query: Column, context: Column) -> Column:
    """A template as one concat, so inserted text is never searched for placeholders."""
    parts = []
    for i, piece in enumerate(_PLACEHOLDER.split(template)):
        if i % 2:
            parts.append(query if piece == "query" else context)
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def build_messages(
    df: DataFrame, query: str = "query", context: str = "context_chunks", pass_name: str = "pass",
    prompts: list[dict] | None = None,
) -> DataFrame:
    """Adds ``messages`` (array of role and content) and ``reject_reason``.

    A row with an unknown pass, or without the context its pass needs, has null
    messages and says why.
    """
    prompts = prompts or PROMPTS
    which = F.col(pass_name)
    ctx = format_context(context)
    missing = F.coalesce(F.size(F.col(context)), F.lit(0)) <= 0
    reject, messages = None, None
    for p in prompts:
        here = which == p["pass"]
        user = F.struct(F.lit("user").alias("role"), _fill(p["user"], F.col(query), ctx).alias("content"))
        items = [user]
        if p["system"]:
            items.insert(0, F.struct(F.lit("system").alias("role"), F.lit(p["system"]).alias("content")))
        ok = here & ~missing if p["include_context"] else here
        messages = F.when(ok, F.array(*items)) if messages is None else messages.when(ok, F.array(*items))
    known = F.coalesce(which.isin(*[p["pass"] for p in prompts]), F.lit(False))
    needs = which.isin(*[p["pass"] for p in prompts if p["include_context"]])
    reject = F.when(~known, "unknown_pass").when(needs & missing, "missing_context")
    return df.withColumn("messages", messages).withColumn("reject_reason", reject)


def require_messages(df: DataFrame) -> DataFrame:
    """Strict mode: fail the job on the first rejected row."""
    error = F.raise_error(F.concat(F.lit("cannot build messages: "), F.col("reject_reason")))
    return df.withColumn("messages", F.when(F.col("reject_reason").isNull(), F.col("messages")).otherwise(error))


def transcript_messages(df: DataFrame, conversation: str, turn: str, role: str, text: str, page: int = 64) -> DataFrame:
    """Stored conversations as message lists, in turn order.

    A list covers the turns of one page, so a conversation of any length is never
    gathered in one row; up to ``page`` turns it is one list.
    """
    message = F.struct(F.col(turn), F.struct(F.col(role).alias("role"), F.col(text).alias("content")).alias("m"))
    paged = df.withColumn("page", F.floor(F.col(turn) / page).cast("bigint"))
    lists = paged.groupBy(conversation, "page").agg(F.sort_array(F.collect_list(message)).alias("_t"))
    return lists.select(conversation, "page", F.transform("_t", lambda t: t["m"]).alias("messages"))
