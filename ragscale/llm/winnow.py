"""Winnowing fingerprints in DataFrame functions only.

The units of a text are its words (long ones in pieces, ideographs singly). Every ``gram`` consecutive units are hashed;
of every ``window`` consecutive hashes the least is selected, the rightmost if several are least, with its position. Two
texts that share ``gram + window - 1`` consecutive units therefore share a selected hash.

Hashes have 32 bits. Between two texts chance matches hardly occur, but as an index over many texts they do: of ``n``
distinct selected hashes a given one meets another's by chance at a rate of about ``1 - exp(-n / 2**32)``, 13 % at 6e8
(roughly 30 GB of text). Matches found across a corpus must be verified on the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ragscale.llm.order import numbered

GRAM, WINDOW = 5, 16
SINGLE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}"
UNIT = rf"[{SINGLE}]|[^\x20\x09-\x0D{SINGLE}]{{1,32}}"
COPIES = 1024  # rows of one repeated row that a task makes
PLACE = (1 << 31) - 1  # a packed entry: 32 bits of hash, then the distance from the largest position


def with_fingerprint(df: DataFrame, text: str, out: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Adds array ``out`` of packed selections, in order. A text under ``gram`` units has one hash of them all; a null or
    blank one has none."""
    rest = [c for c in df.columns]
    units = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(UNIT), F.lit(0))
    hashed = df.select(*rest, F.transform(units, lambda u: F.xxhash64(u)).alias("_units"))
    n = F.size("_units")
    packed = F.transform(
        F.sequence(F.lit(1), F.greatest(n - (gram - 1), F.lit(1))),
        lambda i: F.shiftleft(F.xxhash64(F.slice("_units", i, gram)).bitwiseAND(F.lit(0xFFFFFFFF)), 31).bitwiseOR(F.lit(PLACE) - i.cast("bigint")),
    )
    none = F.array().cast("array<bigint>")
    grams = hashed.select(*rest, F.when(n == 0, none).otherwise(packed).alias("_grams"))
    m = F.size("_grams")
    least = F.transform(F.sequence(F.lit(1), F.greatest(m - (window - 1), F.lit(1))), lambda j: F.array_min(F.slice("_grams", j, window)))
    return grams.select(*rest, F.when(m == 0, none).otherwise(F.array_distinct(least)).alias(out))


def hashes(selected: Column | str) -> Column:
    """The distinct hashes of packed selections."""
    return F.array_distinct(F.transform(selected, lambda x: F.shiftright(x, 31)))


def shown(selected: Column | str) -> Column:
    """Packed selections as text: ``hash@position`` with 8 hex digits and the number of the gram's first unit."""
    return F.array_join(
        F.transform(selected, lambda x: F.concat(F.lpad(F.lower(F.hex(F.shiftright(x, 31))), 8, "0"), F.lit("@"), (F.lit(PLACE - 1) - x.bitwiseAND(F.lit(PLACE))).cast("string"))),
        " ",
    )


def likeness(a: Column | str, b: Column | str) -> Column:
    """Shared hashes over all hashes of two hash sets; 1 if both are empty."""
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / every)


def edited_fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every text and of the text whose last quarter is replaced by the next document's beginning.

    Returns ``id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. Next is by ascending
    id, nulls last; ids that repeat are ordered by a hash of their text, and a repeated row is followed by its copy.
    The last document is followed by the first, a single one by itself. Null text counts as empty. Equal texts have
    equal fingerprints. Columns besides ``id`` and ``text`` are not read. An empty table gives no rows.
    """
    kind = docs.schema[id].dataType
    key = F.coalesce(F.concat(F.lit("="), F.col(id).cast("string")), F.lit(""))  # tells null from every value
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    mark = F.xxhash64(body, F.col(id).isNull())
    rows = docs.select(F.col(id).alias("id"), key.alias("key"), mark.alias("h"), F.char_length(body).alias("n_chars"))
    distinct = rows.groupBy("key", "h").agg(F.first("id").alias("id"), F.first("n_chars").alias("n_chars"), F.count(F.lit(1)).alias("copies"))
    ranked, total = numbered(distinct, [F.col("id").asc_nulls_last(), F.col("h").asc()])
    ranked = ranked.withColumn("next_rank", (F.col("rank") + 1) % F.lit(max(total, 1)))
    following = ranked.select(F.col("rank").alias("next_rank"), F.col("key").alias("next_key"), F.col("h").alias("next_h"))
    asks = ranked.join(following, "next_rank").select(
        F.col("next_key").alias("key"), F.col("next_h").alias("h"), F.col("key").alias("to_key"), F.col("h").alias("to_h"), F.floor(F.col("n_chars") / 4).cast("int").alias("wanted")
    )

    repeated = (ranked.agg(F.max("copies")).first()[0] or 0) > 1
    base = docs.select(key.alias("key"), mark.alias("h"), body.alias("text"))
    if repeated:  # copies of a row are brought down to one before anything is shuffled
        base = base.groupBy("key", "h").agg(F.first("text").alias("text"))
    base = with_fingerprint(base, "text", "fp", gram, window).repartition("key", "h")  # shuffled once, read by both sides below
    told = base.join(asks, ["key", "h"]).select(
        F.col("to_key").alias("key"), F.col("to_h").alias("h"), F.substring("text", F.lit(1), F.col("wanted")).alias("beginning"), hashes("fp").alias("next_set")
    )
    joined = base.join(told, ["key", "h"]).withColumn("n_chars", F.char_length("text"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    joined = joined.withColumn("times", F.lit(1).cast("bigint"))
    if repeated:  # all copies but the last are followed by a copy
        again = base.join(ranked.where("copies > 1").select("key", "h", (F.col("copies") - 1).alias("times")), ["key", "h"]).withColumn("n_chars", F.char_length("text"))
        joined = joined.unionByName(again.withColumns({"beginning": F.substring("text", F.lit(1), quarter), "next_set": hashes("fp")}))
    edited = joined.select(
        F.when(F.col("key") != "", F.substring("key", 2, 1 << 30).cast(kind)).alias("id"), "n_chars", "fp", "times",
        F.concat(F.substring("text", F.lit(1), F.col("n_chars") - quarter), "beginning").alias("edited"), hashes("fp").alias("own_set"), "next_set",
    )
    both = with_fingerprint(edited, "edited", "edited_fp", gram, window)
    if repeated:  # rows of copies are made in many tasks
        blocks = both.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("times") - 1) / COPIES)))).repartition("id", "_block")
        both = blocks.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(COPIES).cast("bigint"), F.col("times") - F.col("_block") * COPIES))))
    return both.select(
        F.col("id").alias(id), F.col("n_chars").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        shown("fp").alias("fingerprint"), shown("edited_fp").alias("edited_fingerprint"),
        likeness("own_set", hashes("edited_fp")).alias("near_edited"), likeness("own_set", "next_set").alias("near_next"),
    )
