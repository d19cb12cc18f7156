"""Quality rules by tokenizer fertility.

A public vocabulary is asked how well it fits a text: characters per token, the share of tokens that are single bytes
because the vocabulary lacks a character, and how evenly the tokens are used; a second one how many characters its tokens
have. Each script and language has a band for each measure, learned from all documents; a text outside its bands is
rejected. Plain counts of words, signs and repetitions come first.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ragscale.llm.arrays import SLICE_BYTES, codes, held, ragged_ranges, row_pieces, row_sums, slice_strings, text_buffers, text_slices, word_bounds, word_strings
from ragscale.llm.frames import carry
from ragscale.llm.word_tokens import MAX_CELLS, WordTokenizer
from ragscale.operators.skew import with_dimension
from ragscale.session import materialize

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MOST_REPEATED = 50  # per cent of the words

# Scripts by code points: name, first, last. A text's script is the one most of its letters have.
SCRIPTS = [
    ("latin", 0x41, 0x5A), ("latin", 0x61, 0x7A), ("latin", 0xC0, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF),
    ("arabic", 0x600, 0x6FF), ("devanagari", 0x900, 0x97F), ("thai", 0xE00, 0xE7F), ("kana", 0x3040, 0x30FF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
]
NAMES = ["other", *dict.fromkeys(s[0] for s in SCRIPTS), "none"]  # other: letters of no script above; none: no letters

# Bands of a 32k vocabulary with byte fallback, and the prior of learned ones: characters per token (low, high), most bytes among the tokens, least evenness.
BANDS = {
    "latin": (1.5, 8.0, 0.25, 0.4), "greek": (0.5, 6.0, 0.6, 0.35), "cyrillic": (0.8, 8.0, 0.4, 0.4), "han": (0.3, 3.0, 0.9, 0.35), "kana": (0.3, 3.0, 0.9, 0.35),
    "hangul": (0.3, 3.0, 0.95, 0.3), "arabic": (0.4, 6.0, 0.7, 0.3), "hebrew": (0.4, 6.0, 0.7, 0.3), "devanagari": (0.25, 6.0, 0.95, 0.25), "thai": (0.25, 6.0, 0.95, 0.25),
    "other": (0.2, 8.0, 1.0, 0.25), "none": (0.2, 8.0, 0.3, 0.25),
}
SPREADS = 4.0  # a learned band reaches so many robust standard deviations from the median
PRIOR = 200  # documents that BANDS count for beside a group's own
FLOOR = 0.02  # least standard deviation
PIECE_BYTES = 1 << 18  # text of a slice that is counted at once: the counts need some 70 bytes for each byte of text

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


class Pair:
    """Two vocabularies; the second gives the number of tokens of each word."""

    def __init__(self, first: str, second: str, max_cells: int = MAX_CELLS):
        self.first, self.second = Vocabulary(first), WordTokenizer(second, max_cells)


class Vocabulary:
    """Pieces of words, one encoding for each distinct word of a slice."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.size = self.model.vocab_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.size)])

    def encode(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        lengths, flat = [np.zeros(1, np.int64)], []
        for at in range(0, len(words), 1 << 14):
            told = self.model.encode(words[at : at + (1 << 14)].to_pylist(), num_threads=1)
            lengths.append(np.fromiter(map(len, told), np.int64, len(told)))
            flat.append(np.fromiter(chain.from_iterable(told), np.int64, int(lengths[-1].sum())))
        return np.concatenate(flat) if flat else np.zeros(0, np.int64), np.cumsum(np.concatenate(lengths))


def repeated_words(number: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each row how many words lie in a window of three words that the row has twice or more. ``number``: word numbers."""
    n = len(number)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(max(n - 2, 0))
    at = at[row[at] == row[at + 2]] if n > 2 else at[:0]
    if not len(at):
        return np.zeros(len(first) - 1, np.int64)
    # Two stable sorts bring equal windows of a row together: first number pairs, then pairs with the third word and the row.
    size = int(number.max()) + 1
    pair = number[at] * size + number[at + 1]
    _, pair = np.unique(pair, return_inverse=True)
    triple = pair.astype(np.int64) * size + number[at + 2]
    _, triple = np.unique(triple, return_inverse=True)
    key = row[at] * (int(triple.max()) + 1) + triple
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for step in range(3):
        covered[at[twice] + step] = True
    return row_sums(covered, first)


def repeated_lines(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each row how many lines with a word equal an earlier line of the row."""
    breaks = np.flatnonzero(data == 0x0A)
    begin = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(breaks, offsets)) + 1)
    end = np.append(begin[1:], len(data))
    last = np.append(row[1:] != row[:-1], True)
    end = np.where(last, offsets[row + 1], end - 1)
    wordy = np.searchsorted(starts, begin) < np.searchsorted(starts, end)
    begin, end, row = begin[wordy], end[wordy], row[wordy]
    number, distinct = codes(slice_strings(data, begin, end))
    different = np.unique(row * max(len(distinct), 1) + number)
    n = len(offsets) - 1
    return np.bincount(row, minlength=n) - np.bincount(different // max(len(distinct), 1), minlength=n)


def scripts(texts_data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index into NAMES of each row's most frequent script (ties: the first; no letter of a known script: other; no letter: none)."""
    points = np.frombuffer(texts_data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    chars = np.concatenate([[0], np.cumsum((texts_data & 0xC0) != 0x80)])[offsets]
    table = np.zeros(0x10000, np.uint8)
    for name, a, b in SCRIPTS:
        table[a : b + 1] = NAMES.index(name)
    script = np.where(points < 0x10000, table[np.minimum(points, 0xFFFF)], 0).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(chars))
    counts = np.bincount(row * len(NAMES) + script[: len(row)], minlength=(len(offsets) - 1) * len(NAMES)).reshape(-1, len(NAMES))
    counts[:, 0] = 0
    found = counts.argmax(axis=1)
    for i in np.flatnonzero(counts.sum(axis=1) == 0):  # few rows
        text = texts_data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
        found[i] = 0 if any(c.isalpha() for c in text) else len(NAMES) - 1
    return found


def evenness(tokens: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Entropy of each row's tokens over the most it could be (1 for under two tokens)."""
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    key = np.sort(row * size + tokens)
    cut = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(cut, len(key)))
    weight = np.bincount(key[cut] // size, weights=count * np.log2(count), minlength=len(n))
    some = n > 1
    out = np.ones(len(n))
    out[some] = (np.log2(n[some]) - weight[some] / n[some]) / np.log2(np.minimum(n[some], size))
    return out


MEASURES = [
    ("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"), ("n_repeat_words", "bigint"), ("base_failed", "boolean"), ("kept", "boolean"),
    ("script", "string"), ("n_tokens", "bigint"), ("chars_per_token", "double"), ("byte_share", "double"), ("evenness", "double"),
]


def measure(column: pa.Array, vocabulary: Vocabulary, bands: dict = BANDS, second: WordTokenizer | None = None) -> list[pa.Array]:
    """The columns of MEASURES for a slice of texts, and the characters per token of a ``second`` vocabulary."""
    data, offsets = text_buffers(column)
    starts, ends, first = word_bounds(data, offsets)
    number, distinct = codes(word_strings(data, starts, ends))
    flat, at = vocabulary.encode(distinct)
    more = None if second is None else np.diff(second.ids(distinct)[1])
    pieces = []
    for a, b in row_pieces(offsets, PIECE_BYTES) if len(column) else [(0, 0)]:
        w, z = first[a], first[b]
        row_first, begin, words = first[a : b + 1] - w, starts[w:z] - offsets[a], number[w:z]
        plain = plain_measures(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], begin, ends[w:z] - offsets[a], words, row_first)
        tokens = token_measures(flat, at, words, row_first, vocabulary)
        pieces.append([*plain, *tokens] + ([] if more is None else [row_sums(more[words], row_first)]))
    n_words, word_chars, symbols, lines, repeat, script, n_tokens, bytes_used, even, *more = (np.concatenate(c) for c in zip(*pieces))
    failed = (n_words < MIN_WORDS) | (100 * repeat > MOST_REPEATED * n_words)
    some = np.maximum(n_tokens, 1)
    per, share = word_chars / some, bytes_used / some
    low, high, most, least = (np.array([bands.get(n, bands["other"])[i] for n in NAMES])[script] for i in range(4))
    kept = ~failed & (per >= low) & (per <= high) & (share <= most) & (even >= least)
    columns = [n_words, word_chars, symbols, lines, repeat, failed, kept, np.array(NAMES)[script], n_tokens, per, share, even]
    if more:
        columns.append(word_chars / np.maximum(more[0], 1))
    return [pa.array(c) for c in columns]


def plain_measures(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, number: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Of each row: words, their characters, signs, repeated lines, repeated words, script."""
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    word_chars = row_sums(chars[ends] - chars[starts], first)
    del chars
    symbols = row_sums(_SYMBOL[data], offsets)
    return [np.diff(first), word_chars, symbols, repeated_lines(data, offsets, starts), repeated_words(number, first), scripts(data, offsets)]


def token_measures(flat: np.ndarray, at: np.ndarray, number: np.ndarray, first: np.ndarray, vocabulary: Vocabulary) -> list[np.ndarray]:
    """Of each row: tokens, byte tokens, evenness. ``flat`` and ``at``: the tokens of each word number."""
    tokens, token_at = ragged_ranges(flat, at[number], np.diff(at)[number])
    row_at = token_at[first]
    return [np.diff(row_at), row_sums(vocabulary.is_byte[tokens], row_at), evenness(tokens, row_at, vocabulary.size)]


def fertility_rules(docs: DataFrame, vocabulary: str, keep: list[str], text: str = "text", bands: dict = BANDS, slice_bytes: int = SLICE_BYTES, second: str | None = None, max_cells: int = MAX_CELLS) -> DataFrame:
    """Columns ``keep`` and MEASURES of every row, repeated rows included; ``second_per_token`` if a ``second`` vocabulary is given.

    ``kept`` is false for texts under 50 words, texts more than half of whose words lie in repeated windows of three, and
    texts outside their script's bands. Null text counts as empty: no words, failed. Words are what stands between ASCII white
    space; each is encoded by itself. Only the text is looked at. Memory is bounded by a slice of texts or one text
    and the transitions of ``second`` (``max_cells``).
    """
    own = keep.index(text) if text in keep else len(keep)  # a text that is kept anyway is sent once
    rows, fields = carry(docs, keep, *([] if text in keep else [F.col(text).cast("string")]))

    name = rows.columns[own]
    measures = MEASURES + ([("second_per_token", "double")] if second else [])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, name, slice_bytes):
            if second:
                both = held(Pair, vocabulary, second, max_cells)
                measured = measure(part.column(own), both.first, bands, both.second)
            else:
                measured = measure(part.column(own), held(Vocabulary, vocabulary), bands)
            yield pa.record_batch([*part.columns[: len(keep)], *measured], names=[*keep, *(n for n, _ in measures)])

    return rows.mapInArrow(task, ", ".join([*filter(None, [fields]), *(f"{n} {t}" for n, t in measures)]))


def learned_bands(measured: DataFrame) -> DataFrame:
    """``script, _lang, low, high, most, least, low2, high2`` from all rows of ``measured`` that pass the base rules.

    A bound lies SPREADS robust standard deviations (1.4826 times the median distance from the median) from the group's
    median; with few documents it leans on that of BANDS, which count for PRIOR documents. Exact medians of values in
    steps of a thousandth.
    """
    group = ["script", "_lang"]
    names = ["chars_per_token", "byte_share", "evenness", "second_per_token"]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("m"), F.round(F.col(n), 3).alias("x")) for n in names])).alias("e")
    counts = materialize(measured.where("not base_failed").select(*group, each).groupBy(*group, "e.m", "e.x").agg(F.count(F.lit(1)).alias("n")), "measure-counts")
    middle = counts.groupBy(*group, "m").agg(F.expr("percentile(x, 0.5, n)").alias("mid"), F.sum("n").alias("total"))
    spread = counts.join(middle, [*group, "m"]).groupBy(*group, "m").agg(
        F.first("mid").alias("mid"), F.first("total").alias("total"), F.expr("percentile(abs(x - mid), 0.5, n)").alias("mad")
    )
    reach = F.lit(SPREADS) * F.greatest(F.lit(1.4826) * F.col("mad"), F.lit(FLOOR))
    bounds = spread.groupBy(*group).agg(
        F.max("total").alias("total"), *[F.max(F.when(F.col("m") == n, F.col("mid") + sign * reach)).alias(f"{n}{sign}") for n in names for sign in (-1, 1)]
    )
    weight = F.col("total") / (F.col("total") + PRIOR)

    def bound(learned: str, place: int):
        prior = F.coalesce(*[F.when(F.col("script") == n, F.lit(BANDS[n][place])) for n in NAMES])
        return weight * F.col(learned) + (1 - weight) * prior

    return bounds.select(
        *group, bound("chars_per_token-1", 0).alias("low"), bound("chars_per_token1", 1).alias("high"), bound("byte_share1", 2).alias("most"),
        bound("evenness-1", 3).alias("least"), bound("second_per_token-1", 0).alias("low2"), bound("second_per_token1", 1).alias("high2"),
    )


def learned_rules(docs: DataFrame, vocabulary: str, second: str, keep: list[str], text: str = "text", lang: str = "lang", slice_bytes: int = SLICE_BYTES, max_cells: int = MAX_CELLS) -> DataFrame:
    """``fertility_rules`` with the bands of ``learned_bands`` for each script and value of ``lang`` (null is one), and the fixed ones
    for texts without letters. ``keep`` must not have names of MEASURES. Texts are encoded once."""
    tagged = docs.withColumn("_lang", F.coalesce(F.concat(F.lit("="), F.col(lang).cast("string")), F.lit("")))
    measured = materialize(fertility_rules(tagged, vocabulary, [*keep, "_lang"], text, slice_bytes=slice_bytes, second=second, max_cells=max_cells), "measured")
    banded = with_dimension(measured, materialize(learned_bands(measured), "bands"), ["script", "_lang"])
    inside = (
        F.col("chars_per_token").between(F.col("low"), F.col("high")) & (F.col("byte_share") <= F.col("most"))
        & (F.col("evenness") >= F.col("least")) & F.col("second_per_token").between(F.col("low2"), F.col("high2"))
    )
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(False)) & ((F.col("script") != NAMES[-1]) | F.col("kept"))
    return banded.select(*keep, *[kept.alias(n) if n == "kept" else F.col(n) for n, _ in MEASURES])
