"""Word splitting, overlapping chunks and token sets, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The characters at which a plain ``str.split()`` separates words.
WHITESPACE = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# The same set in the form Spark's regular expressions match fastest.
_SPACE = r"(?U)[\s\x1c-\x1f]+"
_NON_SPACE = r"(?U)[^\s\x1c-\x1f]"
NON_TOKEN = r"[^\p{L}\p{N}]+"
SENTENCE_END = r"[.!?\n]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: Column | str) -> Column:
    """Whitespace-separated words, empty array for blank text."""
    return F.array_remove(F.split(_col(text), _SPACE), "")


def is_blank(text: Column | str) -> Column:
    """True where a text is null or holds whitespace only."""
    return F.coalesce(~F.rlike(_col(text), F.lit(_NON_SPACE)), F.lit(True))


def word_count(text: Column | str) -> Column:
    return F.size(words(text))


def chunk_count(n_words: Column, size: int, overlap: int) -> Column:
    """Number of windows ``chunk_words`` produces for a word count."""
    step = max(1, size - overlap)
    extra = F.floor((n_words - F.lit(size) + F.lit(step - 1)) / F.lit(step)).cast("int")
    return F.when(n_words == 0, 0).when(n_words <= size, 1).otherwise(extra + 1)


def chunk_words(text: Column | str, size: int, overlap: int, word_array: Column | None = None) -> Column:
    """Array of overlapping word windows of a text.

    A text of at most ``size`` words stays as it is. Windows are cut inside the
    row, so the word array is never copied once per chunk.
    """
    text = _col(text)
    ws = words(text) if word_array is None else word_array
    n = F.size(ws)
    step = max(1, size - overlap)
    starts = F.sequence(F.lit(0), chunk_count(n, size, overlap) - 1)
    windows = F.transform(starts, lambda i: F.array_join(F.slice(ws, i * step + 1, size), " "))
    return (
        F.when(n == 0, F.array().cast("array<string>"))
        .when(n <= size, F.array(text))
        .otherwise(windows)
    )


def exploded(df: DataFrame, keep: list[str], items: Column, value: str, position: str | None = None) -> DataFrame:
    """One row per array element, none for an empty array.

    The outer form keeps the planner from copying ``items`` into a filter below
    the explode, which would compute it twice.
    """
    rows = df.select(*keep, F.posexplode_outer(items).alias("_at", value)).where(F.col("_at").isNotNull())
    return rows.withColumnRenamed("_at", position) if position else rows.drop("_at")


def token_set(text: Column | str) -> Column:
    """Distinct lower-case letter/digit runs of a text."""
    return F.array_distinct(F.array_remove(F.split(F.lower(_col(text)), NON_TOKEN), ""))


def tokens(text: Column | str) -> Column:
    """All lower-case letter/digit runs of a text, in order."""
    return F.array_remove(F.split(F.lower(_col(text)), NON_TOKEN), "")


def sentences(text: Column | str) -> Column:
    """Sentences that hold at least one token."""
    parts = F.split(F.coalesce(_col(text), F.lit("")), SENTENCE_END)
    return F.filter(parts, lambda s: s.rlike(r"[\p{L}\p{N}]"))


def format_context(chunks: Column | str) -> Column:
    """Chunks joined by a blank line; null counts as no chunk."""
    return F.array_join(F.coalesce(_col(chunks), F.array().cast("array<string>")), "\n\n")
