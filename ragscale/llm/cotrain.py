"""Quality scores by co-training a text view and a page view.

The text view sees character trigrams, the page view source, language, length and layout. Both learn from a bounded
sample of labelled documents; in each round either view scores all unlabelled documents and labels those it is surest of
for the other to learn from. Labelled documents kept aside calibrate both views and weigh them; all documents get the combined score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ragscale.llm.arrays import segment_sums, text_buffers, text_slices, word_bounds
from ragscale.llm.frames import carry
from ragscale.session import materialize

TEXT_BUCKETS, PAGE_BUCKETS = 1 << 13, 1 << 10
SAMPLE = 4000  # labelled documents that are learned from at most
PICKED = 400  # documents that a view labels in a round at most
ROUNDS, SHARE = 4, 0.05  # rounds, and the part of the unlabelled documents that a view labels in each
STEPS = 60  # of gradient descent for each fit
HELD = 5  # every fifth labelled document calibrates


@dataclass
class Rows:
    """Sparse rows: entries of row ``i`` are ``at[i]:at[i + 1]``."""

    bucket: np.ndarray
    value: np.ndarray
    at: np.ndarray

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return segment_sums(weights[self.bucket] * self.value, self.at)

    def back(self, rows: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.bucket, weights=np.repeat(rows, np.diff(self.at)) * self.value, minlength=size)

    def take(self, rows: np.ndarray) -> Rows:
        n = np.diff(self.at)[rows]
        at = np.concatenate([[0], np.cumsum(n)])
        where = np.arange(at[-1]) + np.repeat(self.at[rows] - at[:-1], n)
        return Rows(self.bucket[where], self.value[where], at)


def trigram_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the byte trigram at each place, and where each row's trigrams begin (rows under three bytes have none)."""
    wide = data.astype(np.uint32)
    code = wide[:-2] | (wide[1:-1] << np.uint32(8)) | (wide[2:] << np.uint32(16)) if len(data) > 2 else np.zeros(0, np.uint32)
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(32 - TEXT_BUCKETS.bit_length() + 1)).astype(np.int64)
    n = np.maximum(np.diff(offsets) - 2, 0)
    at = np.concatenate([[0], np.cumsum(n)])
    inside = np.arange(at[-1]) + np.repeat(offsets[:-1] - at[:-1], n)
    return bucket[inside], at


def text_rows(data: np.ndarray, offsets: np.ndarray) -> Rows:
    """Trigram shares of each row, scaled by the square root of the number of buckets."""
    bucket, at = trigram_buckets(data, offsets)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    key, count = np.unique(row * TEXT_BUCKETS + bucket, return_counts=True)
    row, bucket = np.divmod(key, TEXT_BUCKETS)
    n = np.maximum(np.diff(at), 1)
    return Rows(bucket, count / n[row] * TEXT_BUCKETS**0.5, np.searchsorted(row, np.arange(len(n) + 1)))


def text_scores(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """What ``text_rows(...).dot(weights)`` gives, without sorting a row's trigrams."""
    bucket, at = trigram_buckets(data, offsets)
    return segment_sums(weights[bucket], at) / np.maximum(np.diff(at), 1) * TEXT_BUCKETS**0.5


def _log_bin(x: np.ndarray) -> np.ndarray:
    return np.floor(2 * np.log2(np.maximum(x, 0) + 1)).astype(np.int64)


def page_rows(data: np.ndarray, offsets: np.ndarray, source: np.ndarray, lang: np.ndarray, n_chars: np.ndarray) -> Rows:
    """One entry for each trait of a page: source, language, stated length, lines, words, line length, words a line, word length."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 0x0A)
    lines = np.diff(np.searchsorted(breaks, offsets)) + 1
    starts, ends, first = word_bounds(data, offsets)
    words, size = np.diff(first), np.diff(offsets)
    some = np.maximum(words, 1)
    traits = [
        source, lang, _log_bin(n_chars), _log_bin(lines), _log_bin(words), _log_bin(size / lines), _log_bin(words / lines),
        np.floor(4 * (size - words) / some).astype(np.int64).clip(0, 200),
    ]
    mixed = [((t.astype(np.int64) * 2654435761 + 40503 * i) * 2246822519 >> 15) % PAGE_BUCKETS for i, t in enumerate(traits)]
    return Rows(np.stack(mixed, axis=1).ravel(), np.ones(n * len(traits)), np.arange(n + 1) * len(traits))


def stacked(parts: list[Rows]) -> Rows:
    ends = np.cumsum([0, *(p.at[-1] for p in parts)])
    at = [p.at[:-1] + e for p, e in zip(parts, ends)]
    return Rows(np.concatenate([p.bucket for p in parts]), np.concatenate([p.value for p in parts]), np.concatenate([*at, ends[-1:]]))


@dataclass
class Linear:
    weights: np.ndarray
    bias: float

    def logit(self, rows: Rows) -> np.ndarray:
        return rows.dot(self.weights) + self.bias


def fit(rows: Rows, label: np.ndarray, size: int, strength: float, steps: int = STEPS) -> Linear:
    """Logistic regression with both classes weighing the same, by accelerated gradient descent on scaled buckets."""
    n = len(label)
    share = label.mean() if n else 0.5
    if n == 0 or share in (0.0, 1.0):
        return Linear(np.zeros(size), 0.0 if n == 0 else 4.0 * (1 if share else -1))
    weight = np.where(label == 1, 0.5 / share, 0.5 / (1 - share)) / n
    power = rows.back(np.ones(n) / n, size) if rows.value.max(initial=0) == 1 else Rows(rows.bucket, rows.value**2, rows.at).back(np.ones(n) / n, size)
    scale = 1 / np.sqrt(power + 1e-3)
    scaled = Rows(rows.bucket, rows.value * scale[rows.bucket], rows.at)
    x = prior = np.zeros(size)
    bias = prior_bias = 0.0
    width = float(np.mean(scaled.dot(scale * 0 + 1.0) ** 2) ** 0.5) + 1
    rate = 4 / width
    for step in range(steps):
        pull = step / (step + 3)
        y, b = x + pull * (x - prior), bias + pull * (bias - prior_bias)
        miss = weight * (1 / (1 + np.exp(-np.clip(scaled.dot(y) + b, -30, 30))) - label)
        prior, prior_bias = x, bias
        x = y - rate * (scaled.back(miss, size) + strength * y)
        bias = b - rate * miss.sum()
    return Linear(x * scale, float(bias))


def co_train(text: Rows, page: Rows, label: np.ndarray, rounds: int = ROUNDS, share: float = SHARE) -> tuple[Linear, Linear]:
    """Both views after the rounds over rows in memory; ``label`` is 0, 1, or -1 for unlabelled rows. ``learn`` does the same over tables."""
    sizes, views = (TEXT_BUCKETS, PAGE_BUCKETS), (text, page)
    taught = [label.astype(float).copy(), label.astype(float).copy()]
    models: list[Linear] = []
    for number in range(rounds + 1):
        models = []
        for rows, size, own, strength in zip(views, sizes, taught, (1e-4, 1e-3)):
            known = np.flatnonzero(own >= 0)
            models.append(fit(rows.take(known), own[known], size, strength))
        if number == rounds:
            break
        given = label[label >= 0]
        good = given.mean() if len(given) else 0.5
        for mine, other in ((0, 1), (1, 0)):
            open_rows = np.flatnonzero((label < 0) & (taught[other] < 0))
            if not len(open_rows) or not 0 < good < 1:
                continue
            sure = models[mine].logit(views[mine].take(open_rows))
            ranked = open_rows[np.lexsort((open_rows, -sure))]
            count = min(max(1, round(share * (label < 0).sum())), len(ranked))
            up = round(count * good)
            taught[other][ranked[:up]] = 1
            taught[other][ranked[len(ranked) - (count - up) :]] = 0
    return models[0], models[1]


def combine(a: np.ndarray, b: np.ndarray, label: np.ndarray, known: np.ndarray, steps: int = 200) -> np.ndarray:
    """Weights (constant, text, page) of the two views' logits that make the combined score a probability, from rows kept aside.

    Each view is calibrated by a line in its logit; the sum of the two lines is their joint fit, by Newton's method. Rows of
    one class only can't calibrate: then the share of good ones among all ``known`` labels stands for every document.
    """
    if not len(label) or label.min() == label.max():
        share = (known.sum() + 1) / (len(known) + 2)
        return np.array([np.log(share / (1 - share)), 0.0, 0.0])
    x = np.stack([np.ones(len(a)), a, b], axis=1)
    target = np.where(label == 1, (label.sum() + 1) / (label.sum() + 2), 1 / ((1 - label).sum() + 2))
    w = np.zeros(3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - target) + 1e-3 * w
        w_next = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(3), slope)
        w, done = w_next, np.abs(w_next - w).max() < 1e-9
        if done:
            break
    return w


@dataclass
class Scorer:
    text: Linear
    page: Linear
    mix: np.ndarray


def _page_columns(source: str, lang: str, n_chars: str) -> list[Column]:
    """Source and language as numbers by hash, and the stated length; nulls are a value of their own."""
    def number(c: str) -> Column:
        return F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(1 << 31)).cast("bigint")

    return [number(source), number(lang), F.coalesce(F.col(n_chars).cast("bigint"), F.lit(-1))]


def _features(part: pa.RecordBatch, first: int) -> tuple:
    data, offsets = text_buffers(part.column(first))
    return data, offsets, [part.column(first + i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2, 3)]


def _scored(mine: DataFrame, text: Linear, page: Linear) -> DataFrame:
    """``_id, a, b``: both views' logits (nine digits, for ties) of every document with an id; of a repeated id one row counts."""
    packed = mine.sparkSession.sparkContext.broadcast((text.weights, text.bias, page.weights, page.bias))  # two weight vectors of fixed length

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = Linear(*packed.value[:2]), Linear(*packed.value[2:])
        for part in text_slices(batches, "t"):
            data, offsets, traits = _features(part, 1)
            a, b = text_scores(data, offsets, one.weights) + one.bias, two.logit(page_rows(data, offsets, *traits))
            yield pa.record_batch([part.column(0), part.column(5), pa.array(a.round(9)), pa.array(b.round(9))], names=["_id", "h", "a", "b"])

    kind = mine.schema["_id"].dataType.simpleString()
    rows = mine.where("_id is not null").mapInArrow(task, f"_id {kind}, h bigint, a double, b double")
    return rows.groupBy("_id").agg(F.min(F.struct("h", "a", "b")).alias("r")).select("_id", "r.a", "r.b")


def _fetched(mine: DataFrame, ids: DataFrame) -> tuple[list, np.ndarray, Rows, Rows]:
    """Ids, labels and both views' rows of the documents in ``ids`` (columns ``_id, _label``), by label and id;
    one row of each id, however often it is repeated."""
    rows = mine.join(F.broadcast(ids), "_id")
    one = rows.groupBy("_id").agg(F.min("h").alias("h"))  # the row that ``_scored`` takes; its copies are alike
    columns = ["_label", "t", "p0", "p1", "p2"]
    rows = rows.join(F.broadcast(one), ["_id", "h"]).groupBy("_id").agg(F.first(F.struct(*columns)).alias("r")).select("_id", *[f"r.{c}" for c in columns])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "t"):
            data, offsets, traits = _features(part, 2)
            rows, pages = text_rows(data, offsets), page_rows(data, offsets, *traits)
            wide = [pa.ListArray.from_arrays(pa.array(r.at.astype(np.int32)), pa.array(v)) for r, v in ((rows, rows.bucket.astype(np.int32)), (rows, rows.value.astype(np.float32)), (pages, pages.bucket.astype(np.int32)))]
            yield pa.record_batch([part.column(0), part.column(1), *wide], names=["_id", "_label", "b", "v", "p"])

    kind = mine.schema["_id"].dataType.simpleString()
    told = rows.mapInArrow(task, f"_id {kind}, _label int, b array<int>, v array<float>, p array<int>").toArrow()
    told = told.sort_by([("_label", "ascending"), ("_id", "ascending")]).combine_chunks()

    def lists(name: str) -> tuple[np.ndarray, np.ndarray]:
        column = told.column(name).combine_chunks() if told.num_rows else pa.array([], pa.list_(pa.int32()))
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
        return column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets) - (column.offsets[0].as_py() if len(column) else 0)

    bucket, at = lists("b")
    text_view = Rows(bucket.astype(np.int64), lists("v")[0].astype(float), at.astype(np.int64))
    bucket, at = lists("p")
    page_view = Rows(bucket.astype(np.int64), np.ones(len(bucket)), at.astype(np.int64))
    return told.column("_id").to_pylist(), told.column("_label").to_numpy().astype(np.int64), text_view, page_view


def learn(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", label: str = "quality", text: str = "text", source: str = "source", lang: str = "lang", n_chars: str = "n_chars",
    sample: int = SAMPLE, seed: int = 11, rounds: int = ROUNDS, share: float = SHARE, most: int = PICKED,
) -> Scorer:
    """A scorer from at most ``sample`` labelled documents, those with the smallest seeded hashes, and all unlabelled ones.

    In each round all unlabelled documents are scored in tasks; the surest of both classes, ``share`` of them but ``most`` at
    most, get a view's label for the other view, and only those come to the fit. Labels other than 0 and 1, null ids and
    ids without a document teach nothing; if an id has several labels the least counts.
    """
    spark = docs.sparkSession
    given = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(id).alias("_id")).agg(F.min(label).cast("int").alias("_label")).where("_id is not null")
    picked = given.orderBy(F.xxhash64(F.lit(seed), F.col("_id")), "_id").limit(sample)
    traits = [c.alias(f"p{i}") for i, c in enumerate(_page_columns(source, lang, n_chars))]
    mine = docs.select(F.col(id).alias("_id"), F.col(text).cast("string").alias("t"), *traits).withColumn("h", F.xxhash64("t", "p0", "p1", "p2"))
    _, y, text_view, page_view = _fetched(mine, picked)
    known = np.arange(len(y))
    aside = known[known % HELD == HELD - 1]
    rest = np.setdiff1d(known, aside)
    views, sizes = (text_view, page_view), (TEXT_BUCKETS, PAGE_BUCKETS)
    rows = [[v.take(rest)] for v in views]  # what each view learns from
    target = [[y[rest]], [y[rest]]]
    taught: list[list] = [[], []]  # ids that the other view has labelled
    good = y[rest].mean() if len(rest) else 0.5
    kind = f"_id {mine.schema['_id'].dataType.simpleString()}, _label int"
    for number in range(rounds + 1):
        models = [fit(stacked(r), np.concatenate(t).astype(float), size, strength) for r, t, size, strength in zip(rows, target, sizes, (1e-4, 1e-3))]
        if number == rounds or not 0 < good < 1:
            break
        scored = materialize(_scored(mine, *models).join(given, "_id", "left_anti"), "scored")
        total = scored.count()
        new = []
        for column, other in (("a", 1), ("b", 0)):
            done = spark.createDataFrame([(i,) for i in taught[other]], kind.split(",")[0])
            left = scored.join(F.broadcast(done), "_id", "left_anti")
            count = min(max(1, round(share * total)), most, total - len(taught[other]))
            up = round(count * good)
            high = left.orderBy(F.desc(column), "_id").limit(up).select("_id").collect()  # at most ``most`` rows
            low = left.orderBy(F.asc(column), F.desc("_id")).limit(count - up).select("_id").collect()
            new.append((other, [(r[0], 1) for r in high] + [(r[0], 0) for r in low]))
        wanted = sorted({i for _, chosen in new for i, _ in chosen})
        ids, _, *found = _fetched(mine, spark.createDataFrame([(i, -1) for i in wanted], kind))
        place = {i: k for k, i in enumerate(ids)}
        for other, chosen in new:
            rows[other].append(found[other].take(np.array([place[i] for i, _ in chosen], np.int64)))
            target[other].append(np.array([c for _, c in chosen], np.int64))
            taught[other] += [i for i, _ in chosen]
    a, b = models
    return Scorer(a, b, combine(a.logit(text_view.take(aside)), b.logit(page_view.take(aside)), y[aside].astype(float), y))


def score(docs: DataFrame, scorer: Scorer, keep: list[str], text: str = "text", source: str = "source", lang: str = "lang", n_chars: str = "n_chars", least: float = 0.5) -> DataFrame:
    """Columns ``keep``, ``text_score`` and ``page_score`` (each view's probability), ``score`` and ``kept`` (``score >= least``) of
    every row, repeated rows included. Null text counts as empty, other nulls are values; labels are not looked at.
    A column of ``keep`` named like an added one is left out."""
    keep = [c for c in keep if c not in ("text_score", "page_score", "score", "kept")]
    rows, fields = carry(docs, keep, F.col(text).cast("string"), *_page_columns(source, lang, n_chars))
    views = (scorer.text.weights, scorer.text.bias, scorer.page.weights, scorer.page.bias, scorer.mix)
    packed = docs.sparkSession.sparkContext.broadcast(views)  # two weight vectors of fixed length
    width = len(keep)

    def chance(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Scorer(Linear(*packed.value[:2]), Linear(*packed.value[2:4]), packed.value[4])
        for part in text_slices(batches, "x0"):
            data, offsets, traits = _features(part, width)
            a = text_scores(data, offsets, known.text.weights) + known.text.bias
            b = known.page.logit(page_rows(data, offsets, *traits))
            both = chance(known.mix[0] + known.mix[1] * a + known.mix[2] * b)
            yield pa.record_batch([*part.columns[:width], pa.array(chance(a)), pa.array(chance(b)), pa.array(both), pa.array(both >= least)], names=[*keep, "text_score", "page_score", "score", "kept"])

    return rows.mapInArrow(task, ", ".join(filter(None, [fields, "text_score double, page_score double, score double, kept boolean"])))
