"""Multilingual mixture inference: which languages a text holds, and in what proportions.

Language models are character n-gram frequencies in hash buckets, counted over all training documents. A word's
likelihood in a language is the product of its n-grams'. Expectation-maximisation over a document's words estimates the
proportions of the languages; the set of languages is chosen by penalised likelihood, starting from the best single
language and adding the language that helps most while the gain exceeds the penalty for one more parameter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ragscale.llm.arrays import SLICE_BYTES, let_go, ragged_ranges, text_buffers, text_slices
from ragscale.llm.frames import carry

GRAM = 3  # bytes
BUCKETS = 1 << 15
SMOOTH = 0.5  # added to every bucket's count
ROUNDS = 12  # of expectation-maximisation
PENALTY = 0.5  # for each parameter, times the logarithm of the number of words
FLOOR = 6.0  # a word's log-likelihood in a language counts at most this much below its best language's: outliers stay outliers
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)  # bytes that can be part of a letter
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[0x80:] = True


def letters_only(text: Column | str) -> Column:
    """Lower case, anything but letters and marks a blank: done by the engine before Python sees the text."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), r"[^\p{L}\p{M}]+", " ")


def has_letter(text: Column | str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(c.cast("string").rlike(r"\p{L}"), F.lit(False))


def gram_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the n-gram that ends at each letter byte, the word each belongs to, and the first word of each row.

    Words are runs of letters; a blank stands before each, so the n-grams at a word's beginning know that they are.
    """
    inside = _LETTER[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    full = offsets[1:] > offsets[:-1]
    border = offsets[:-1][full]
    starts[border] = inside[border]
    at = np.flatnonzero(inside)
    first = np.flatnonzero(starts)
    word = np.cumsum(starts)[at] - 1
    depth = at - first[word] if len(first) else at
    code = data[at].astype(np.uint32)
    for back in range(1, GRAM):
        prior = np.where(depth >= back, data[np.maximum(at - back, 0)], 0).astype(np.uint32)
        code = code + (prior << np.uint32(8 * back))
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int32), word, np.searchsorted(first, offsets)


def gram_counts(docs: DataFrame, text: str, lang: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``lang, bucket, n`` over all rows with a language; counted inside each task first."""
    rows = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), letters_only(text).alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        held: dict[str, np.ndarray] = {}
        for part in text_slices(batches, "text", slice_bytes):
            data, offsets = text_buffers(part.column(1))
            bucket, word, first_word = gram_buckets(data, offsets)
            names, codes = np.unique(np.array(part.column(0).to_pylist(), object), return_inverse=True)
            owner = codes[np.searchsorted(first_word, word, "right") - 1] if len(word) else np.zeros(0, np.int64)
            counts = np.bincount(owner * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
            for name, row in zip(names, counts):
                held[name] = held[name] + row if name in held else row
        for name, row in held.items():
            used = np.flatnonzero(row)
            yield pa.record_batch([pa.array([name] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(row[used])], names=["lang", "bucket", "n"])

    return rows.mapInArrow(task, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


MOST_LANGUAGES = 256  # that models are held of


@dataclass
class LanguageModel:
    names: list[str]
    logs: np.ndarray  # buckets x languages, log frequencies


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = MOST_LANGUAGES, slice_bytes: int = SLICE_BYTES) -> LanguageModel:
    """Models of the ``most`` languages with the most documents in ``docs`` (ties by name); rarer ones teach nothing. Their size
    is languages times buckets, whatever the number of documents."""
    held: dict[str, np.ndarray] = {}
    sizes = docs.where(F.col(lang).isNotNull()).groupBy(F.col(lang).cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    known = [r["lang"] for r in sizes.orderBy(F.desc("n"), "lang").limit(most + 1).collect()]  # most + 1 rows at most
    if len(known) > most:
        docs = docs.where(F.col(lang).cast("string").isin(known[:most]))
    for r in gram_counts(docs, text, lang, slice_bytes).collect():  # languages x buckets at most
        held.setdefault(r["lang"], np.zeros(BUCKETS))[r["bucket"]] = r["n"]
    names = sorted(held)
    logs = np.zeros((BUCKETS, len(names)), np.float32)
    for i, name in enumerate(names):
        logs[:, i] = np.log((held[name] + SMOOTH) / (held[name].sum() + SMOOTH * BUCKETS))
    return LanguageModel(names, logs)


def word_logs(model: LanguageModel, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihoods (words x languages) relative to each word's best language, and the first word of each row."""
    bucket, word, first_word = gram_buckets(data, offsets)
    if not len(bucket):
        return np.zeros((0, len(model.names)), np.float32), first_word
    starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    logs = np.add.reduceat(model.logs[bucket], starts, axis=0)
    logs -= logs.max(axis=1, keepdims=True)
    return np.maximum(logs, -FLOOR), first_word


def row_totals(values: np.ndarray, first_word: np.ndarray) -> np.ndarray:
    """Sums over the words of each row (rows without words: 0)."""
    n = np.diff(first_word)
    out = np.zeros((len(n), *values.shape[1:]), values.dtype)
    if (n > 0).any():
        out[n > 0] = np.add.reduceat(values, first_word[:-1][n > 0], axis=0)
    return out


def proportions(like: np.ndarray, first_word: np.ndarray, allowed: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation: shares (rows x languages, zero outside ``allowed``) and log-likelihoods of the rows."""
    n = np.diff(first_word)
    share = allowed / np.maximum(allowed.sum(axis=1, keepdims=True), 1)
    share = share.astype(np.float32)
    for _ in range(rounds):
        part = like * np.repeat(share, n, axis=0)
        part /= part.sum(axis=1, keepdims=True)
        share = row_totals(part, first_word) / np.maximum(n, 1)[:, None].astype(np.float32)
    mixed = np.log((like * np.repeat(share, n, axis=0)).sum(axis=1, dtype=np.float64))
    return share, row_totals(mixed, first_word)


def infer(model: LanguageModel, data: np.ndarray, offsets: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Shares (rows x languages) of the chosen language sets; rows without words get zeros."""
    languages = len(model.names)
    shares = np.zeros((len(offsets) - 1, languages), np.float32)
    if not languages:
        return shares
    logs, first_word = word_logs(model, data, offsets)
    n = np.diff(first_word)
    if not len(logs):
        return shares
    single = row_totals(logs.astype(np.float64), first_word)
    best = single.argmax(axis=1)  # ties: the first name
    rows = np.flatnonzero(n > 0)
    shares[rows, best[rows]] = 1
    if languages == 1:
        return shares
    like = np.exp(logs)
    every, likely = proportions(like, first_word, np.ones((len(n), languages)))
    price = penalty * np.log(np.maximum(n, 2))
    score = single[np.arange(len(n)), best]
    # No set can beat all languages together by more than the gain that one more round could still bring.
    most = likely + np.maximum(0, n * np.log(np.maximum(_slack(like, every, first_word, n), 1)))
    open_rows = rows[most[rows] - score[rows] > price[rows]]
    chosen = np.zeros((len(n), languages), bool)
    chosen[np.arange(len(n)), best] = True
    while len(open_rows):
        part_like, part_first = _rows_of(like, first_word, open_rows)
        trial_share, trial_score = None, np.full(len(open_rows), -np.inf)
        trial = np.zeros(len(open_rows), np.int64)
        for language in range(languages):
            allowed = chosen[open_rows].copy()
            fresh = ~allowed[:, language]
            if not fresh.any():
                continue
            allowed[:, language] = True
            share, value = proportions(part_like, part_first, allowed)
            value = np.where(fresh, value, -np.inf)
            better = value > trial_score
            trial_share = share if trial_share is None else np.where(better[:, None], share, trial_share)
            trial_score, trial = np.where(better, value, trial_score), np.where(better, language, trial)
        gain = trial_score - score[open_rows] > price[open_rows]
        taken = open_rows[gain]
        chosen[taken, trial[gain]] = True
        shares[taken], score[taken] = trial_share[gain] if trial_share is not None else 0, trial_score[gain]
        open_rows = taken[chosen[taken].sum(axis=1) < languages]
    return shares


def _slack(like: np.ndarray, share: np.ndarray, first_word: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Largest mean of a language's likelihood ratio to the mixture: by concavity it bounds what is still to gain."""
    ratio = like / (like * np.repeat(share, n, axis=0)).sum(axis=1, keepdims=True)
    return (row_totals(ratio, first_word) / np.maximum(n, 1)[:, None]).max(axis=1)


def _rows_of(values: np.ndarray, first_word: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(first_word)[rows]
    return ragged_ranges(values, first_word[rows], n)


def identify(docs: DataFrame, model: LanguageModel, keep: list[str], text: str = "text", penalty: float = PENALTY, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Columns ``keep``, ``lang_pred``, ``score`` (its share of the words) and ``languages`` (name to share) of every row.

    A text that is null or has no letter, or any text if no language was learned, is ``und`` with score 0 and no languages.
    Equal shares go to the name that comes first. Nothing but the text is looked at; repeated rows come out alike. A column
    of ``keep`` named like an added one is left out.
    """
    keep = [c for c in keep if c not in ("lang_pred", "score", "languages")]
    packed = docs.sparkSession.sparkContext.broadcast((model.names, model.logs))  # MOST_LANGUAGES x buckets at most
    rows, fields = carry(docs, keep, letters_only(text), has_letter(text))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        model = LanguageModel(*packed.value)
        room = max(1 << 18, 2 * slice_bytes // max(4, len(model.names)))
        for part in text_slices(batches, "x0", room):
            data, offsets = text_buffers(part.column(len(keep)))
            shares = infer(model, data, offsets, penalty)
            some = part.column(len(keep) + 1).to_numpy(zero_copy_only=False) & (shares.sum(axis=1) > 0) if model.names else np.zeros(part.num_rows, bool)
            best = shares.argmax(axis=1) if model.names else np.zeros(part.num_rows, np.int64)
            names = [model.names[b] if s else UNKNOWN for b, s in zip(best, some)]
            score = [min(1.0, float(shares[i, b])) if s else 0.0 for i, (b, s) in enumerate(zip(best, some))]
            told = [[(model.names[k], float(shares[i, k])) for k in np.flatnonzero(shares[i])] if s else [] for i, s in enumerate(some)]
            yield pa.record_batch(
                [*part.columns[: len(keep)], pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(told, pa.map_(pa.string(), pa.float64()))],
                names=[*keep, "lang_pred", "score", "languages"],
            )

    return rows.mapInArrow(task, ", ".join(filter(None, [fields, "lang_pred string, score double, languages map<string,double>"])))


def held_out(id: Column | str) -> Column:
    """True for the fifth of the documents that nothing is learned from; a null id counts as the empty text."""
    c = F.col(id) if isinstance(id, str) else id
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % 5 == 0
