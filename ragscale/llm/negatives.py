"""Hard-negative mining over exact integer scores from a residue-number-system matrix product.

Scores of a slice of anchors and a block of rows are computed modulo several primes, each product in float32: centred residues
of at most ``half`` and sums over ``STEP`` components stay below 2**24, where float32 is exact in any order of summation.
Chinese remaindering with balanced mixed-radix digits gives the signed score. As many primes are used as the longest
vectors ask for. A first pass finds every anchor's positives, a second one the best rows of other labels inside each
positive's window of scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ragscale.llm.vector_blocks import block_count, first_of_each, ids_of, integer_vectors, matrix, measure, past_blocks, rank_in_group
from ragscale.session import materialize

STEP = 64  # components added up in float32 before a reduction
EXACT = 1 << 24  # integers below are exact in float32
NOTHING = np.iinfo(np.int64).min


def moduli(largest: float) -> list[int]:
    """Primes, descending, whose product exceeds ``2 * largest + 1`` and whose residues can be multiplied exactly."""
    out, product, p = [], 1, 2 * int(((EXACT - 1) // STEP) ** 0.5) + 1
    while product <= 2 * largest * (1 + 1e-9) + 1:
        if all(p % q for q in range(2, int(p**0.5) + 1)):
            out.append(p)
            product *= p
        p -= 1
    return out


def centred(x: np.ndarray, p: int) -> np.ndarray:
    """Residues between ``-(p - 1) / 2`` and ``(p - 1) / 2`` of float32 integers below 2**24, in place."""
    half = np.float32((p - 1) // 2)
    x -= np.rint(x * np.float32(1 / p)) * np.float32(p)
    x -= (x > half) * np.float32(p)  # the quotient may be rounded to the next integer
    x += (x < -half) * np.float32(p)
    return x


def residues(m: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """The integer matrix modulo each prime, centred, as float32."""
    return [((m.astype(np.int64) + (p - 1) // 2) % p - (p - 1) // 2).astype(np.float32) for p in primes]


def residue_product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """``a @ b.T`` modulo ``p`` of centred residues."""
    out = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, a.shape[1], STEP):
        out += centred(a[:, at : at + STEP] @ b[:, at : at + STEP].T, p)
        centred(out, p)
    return out


def signed_scores(products: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Signed integers from their centred residues: balanced digits ``v0 + p0 * (v1 + p1 * (v2 + ...))``."""
    digits: list[np.ndarray] = []
    for i, p in enumerate(primes):
        v = products[i]
        for q, digit in zip(primes[:i], digits):
            inverse = pow(q, -1, p)
            v = centred((v - digit) * np.float32(inverse if 2 * inverse < p else inverse - p), p)
        digits.append(v)
    total = digits[-1].astype(np.int64)
    for digit, p in zip(reversed(digits[:-1]), reversed(primes[:-1])):
        total *= p
        total += digit.astype(np.int64)
    return total


def exact_scores(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    return signed_scores([residue_product(x, y, p) for x, y, p in zip(a, b, primes)], primes)


class _Block:
    """A block of rows as residues, with labels as numbers."""

    def __init__(self, rows: pa.Table, width: int, primes: list[int]):
        self.width, self.primes = width, primes
        self.ids, self.there = ids_of(rows)
        self.id_column = rows.column("id").combine_chunks()
        self.parts = residues(matrix(rows.column("v"), width), primes)
        encoded = rows.column("label").combine_chunks().dictionary_encode()
        self.labels, self.names = encoded.indices.to_numpy(), encoded.dictionary

    def scores(self, anchors: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores (anchors x rows), which rows have the anchor's label, and which have its id."""
        s = exact_scores(residues(matrix(anchors.column("v"), self.width), self.primes), self.parts, self.primes)
        code = pc.index_in(anchors.column("label").combine_chunks(), self.names).fill_null(-1).to_numpy(zero_copy_only=False)
        ids, there = ids_of(anchors)
        own = (ids[:, None] == self.ids[None, :]) & there[:, None] & self.there[None, :]
        return s, code[:, None] == self.labels[None, :], own

    def found(self, anchors: pa.Table, query: np.ndarray, row: np.ndarray, score: np.ndarray, *more: tuple[str, np.ndarray]) -> pa.Table:
        """``key, id, row_id, score`` of the pairs, and ``more`` columns."""
        take = pa.array(query)
        columns = [anchors.column("key").combine_chunks().take(take), anchors.column("id").combine_chunks().take(take), self.id_column.take(pa.array(row)), pa.array(score)]
        return pa.table([*columns, *[pa.array(v) for _, v in more]], names=["key", "id", "row_id", "score", *[n for n, _ in more]])


def _best(pairs: DataFrame, keys: list[str], k: int) -> DataFrame:
    first = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("row_id").asc_nulls_last())
    return pairs.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, anchors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label",
    n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, cells: int | None = None,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    The score of two rows is the integer inner product of ``floor(scale * x)``; higher ones come first, equal ones by smaller id
    (null last). An anchor's positives are its first ``n_positives`` rows of the same label with another id; for each of them
    the first ``n_negatives`` rows of other labels whose score is ``low`` to ``high`` percent of the positive's are returned.

    Rows of either table with a null label, a null vector, or a component that is null or not finite take no part. Shorter vectors
    count as filled up with zeros; vectors too long for 64-bit scores raise. Repeated rows count each, repeated anchors are
    answered each, a row with a null id is nobody's own. No anchors or no rows give no rows. Other columns are not read.
    """
    name = F.col(label).cast("string")
    rows = integer_vectors(vectors.where(F.col(label).isNotNull()), id, vector, scale, label=name)
    asked = integer_vectors(anchors.where(F.col(label).isNotNull()), id, vector, scale, label=name)
    n, width, square, _ = measure(rows)
    _, other_width, other_square, _ = measure(asked)
    width = max(width, other_width)
    primes = moduli(max(square, other_square))
    blocks = block_count(rows, n, width) if cells is None else block_count(rows, n, width, cells, 1)
    windows = F.array().cast("array<bigint>")
    rows = rows.select("key", "id", "label", "v", windows.alias("lo"), windows.alias("hi"))
    asked = asked.select("key", "id", "label", "v", windows.alias("lo"), windows.alias("hi"))

    def build(block: pa.Table) -> _Block:
        return _Block(block, width, primes)

    def positives(block: _Block, some: pa.Table) -> pa.Table:
        s, same, own = block.scores(some)
        s = np.where(same & ~own, s, NOTHING)
        k = min(n_positives, s.shape[1])
        cut = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        query, row = np.nonzero((s >= cut[:, None]) & (s > NOTHING))
        keep = first_of_each(query, row, s[query, row], k)
        query, row = query[keep], row[keep]
        return block.found(some, query, row, s[query, row])

    def negatives(block: _Block, some: pa.Table) -> pa.Table:
        s, same, _ = block.scores(some)
        lo, hi = matrix_of(some.column("lo")), matrix_of(some.column("hi"))
        query, row = np.nonzero(~same & (s >= lo.min(axis=1)[:, None]) & (s <= hi.max(axis=1)[:, None]))
        score = s[query, row]
        order = np.lexsort((row, -score, query))
        query, row, score = query[order], row[order], score[order]
        picked, which = [], []
        for w in range(lo.shape[1]):
            inside = np.flatnonzero((score >= lo[query, w]) & (score <= hi[query, w]))
            inside = inside[rank_in_group(query[inside]) < n_negatives]
            picked.append(inside)
            which.append(np.full(len(inside), w, np.int32))
        at = np.concatenate(picked)
        return block.found(some, query[at], row[at], score[at], ("window", np.concatenate(which)))

    def matrix_of(column: pa.ChunkedArray) -> np.ndarray:
        lists = column.combine_chunks()
        return lists.flatten().to_numpy().reshape(len(lists), -1)

    pairs = "key bigint, id bigint, row_id bigint, score bigint"
    near = _best(past_blocks(rows, asked, blocks, build, positives, pairs), ["key"], n_positives)
    near = materialize(near, "positives")
    score, rest = F.col("score"), F.pmod(F.col("score"), F.lit(100))  # in two parts, so that no product leaves 64 bits
    hundreds = F.expr("(score - pmod(score, 100)) div 100")
    at_least = hundreds * low + F.ceil(rest * low / F.lit(100)).cast("bigint")
    at_most = hundreds * high + F.floor(rest * high / F.lit(100)).cast("bigint")
    none = F.lit(0).cast("bigint")  # an empty window: at least 1, at most 0
    slots = F.transform(F.sequence(F.lit(1), F.lit(n_positives)), lambda r: F.get(F.filter("all", lambda p: p["rank"] == r), F.lit(0)))
    spans = near.groupBy("key").agg(F.collect_list(F.struct("rank", at_least.alias("lo"), at_most.alias("hi"))).alias("all")).select(
        "key", F.transform(slots, lambda p: F.coalesce(p["lo"], none + 1)).alias("lo"), F.transform(slots, lambda p: F.coalesce(p["hi"], none)).alias("hi")
    )
    spanned = asked.drop("lo", "hi").join(spans, "key").select(*rows.columns)
    found = _best(past_blocks(rows, spanned, blocks, build, negatives, pairs + ", window int"), ["key", "window"], n_negatives)
    chosen = near.select("key", (F.col("rank") - 1).alias("window"), F.col("row_id").alias("positive_id"), score.alias("positive_score"))
    return found.join(chosen, ["key", "window"]).select(
        F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("row_id").alias("negative_id"), "positive_score", score.alias("negative_score")
    )
