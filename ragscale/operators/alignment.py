"""Order-aware entailment: local alignment of a claim's tokens with a text, on pairs that share enough tokens.

Token overlap finds the candidates. Each is aligned: matches count 1, substitutions, insertions and deletions cost 1, and the best
run of them anywhere in the text counts, within ``band`` places of the diagonal on which most tokens agree. A claim is
entailed if enough of its tokens match in that run, if negations occur there as often as in the claim up to pairs, and if
the run has all of the claim's numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from ragscale.functions.text import tokens
from ragscale.operators.skew import join_same, small
from ragscale.session import materialize

BAND = 16
# Tokens that turn a statement round ("don't" falls into "don" and "t").
NEGATIONS = ("no", "not", "never", "none", "neither", "nor", "nobody", "nothing", "nowhere", "cannot", "without", "t")


def best_diagonal(a: np.ndarray, b: np.ndarray) -> int:
    """The offset ``j - i`` at which most positions of ``a`` (codes) agree with ``b``; the smallest of several."""
    i, j = np.nonzero(a[:, None] == b[None, :])
    if not len(i):
        return 0
    hits = np.bincount(j - i + len(a))
    return int(hits.argmax()) - len(a)


def align(a: np.ndarray, b: np.ndarray, band: int = BAND) -> tuple[int, int, int, int]:
    """``score, matches, first, end`` of the best local alignment in the band: what it scores, how many tokens of ``a`` match, and
    the stretch of ``b``. Of equal scores the one that ends first in ``a``, then in ``b`` counts."""
    at = best_diagonal(a, b)
    lo, hi = max(0, at - band), min(len(b), at + len(a) + band)
    m = hi - lo
    if m <= 0 or not len(a):
        return 0, 0, 0, 0
    part = b[lo:hi]
    place = np.arange(m + 1)
    # Each cell packs score, matches and minus the start, so that the larger packed value is the better way there.
    scale = np.int64(m + 2)
    cost = np.int64(len(a) + 2) * scale
    empty = -place.astype(np.int64)  # nothing aligned yet, starting here
    prior = empty.copy()
    best, most = (np.int64(0), 0), 0
    for i in range(1, len(a) + 1):
        inside = np.abs(place - 1 + lo - (i - 1) - at) <= band
        same = part == a[i - 1]
        here = empty.copy()
        here[1:] = np.maximum(here[1:], prior[:-1] + np.where(same, cost + scale, -cost))
        here = np.where(inside, np.maximum(here, prior - cost), empty)
        # A gap in the claim runs along the row: the best earlier cell less its distance.
        here = np.maximum.accumulate(here + place * cost) - place * cost
        here = np.where(inside, np.maximum(here, empty), empty)
        scores = (here + scale) // cost
        top = int(scores.argmax())
        if scores[top] > most:
            best, most = (here[top], top), int(scores[top])
        prior = here
    value, end = best
    if value <= 0:
        return 0, 0, 0, 0
    score, rest = divmod(int(value) + int(scale), int(cost))
    matches, start = divmod(rest - int(scale) + m, int(scale))
    return score, matches, lo + m - start, lo + end


def aligned_claims(
    pairs: DataFrame, claims: DataFrame, texts: DataFrame, coverage: int = 80, band: int = BAND, claim_id: str = "claim_id",
    text_id: str = "text_id", claim: str = "claim", text: str = "text", negations: tuple[str, ...] = NEGATIONS,
) -> DataFrame:
    """``(claim, text, score, n_matched, n_claim, first, end, negation_ok, numbers_ok, entailed)`` of candidate pairs.

    ``pairs`` come from ``lexical.entailed_claims``: a claim of which ``coverage`` percent of the tokens match in order shares
    at least that many with the text if none repeats. ``first`` and ``end`` are token positions. Null texts have no tokens;
    a claim without tokens is entailed by nothing. Equal pairs come out alike.
    """
    left, right = claims.select(claim_id, F.col(claim).alias("_a")), texts.select(text_id, F.col(text).alias("_b"))
    asked = materialize(join_same(pairs.select(claim_id, text_id), left, [claim_id]), "asked")
    joined = join_same(small(asked), right, [text_id])  # few pairs: texts stay where they are
    cut = [F.coalesce(tokens(c), F.array().cast("array<string>")).alias(c) for c in ("_a", "_b")]  # only what is in a pair is split
    both = joined.select(claim_id, text_id, *cut)
    numbers = ["score", "n_matched", "n_claim", "first", "end"]
    schema = T.StructType([both.schema[claim_id], both.schema[text_id], *[T.StructField(n, T.IntegerType()) for n in numbers],
                           *[T.StructField(n, T.BooleanType()) for n in ("negation_ok", "numbers_ok", "entailed")]])
    turning = set(negations)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            for words, other in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                number: dict[str, int] = {}
                a, b = (np.array([number.setdefault(w, len(number)) for w in ws], np.int64) for ws in (words, other))
                score, matches, first, end = align(a, b, band)
                span = other[first:end]
                negation = (sum(w in turning for w in words) - sum(w in turning for w in span)) % 2 == 0
                digits = {w for w in words if any(c.isdigit() for c in w)} <= set(span)
                told.append((score, matches, len(words), first, end, negation, digits, bool(words) and matches * 100 >= len(words) * coverage and negation and digits))
            columns = list(zip(*told)) if told else [()] * 8
            arrays = [pa.array(c, pa.int32()) for c in columns[:5]] + [pa.array(c, pa.bool_()) for c in columns[5:]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *arrays], names=schema.names)

    return both.mapInArrow(run, schema)
