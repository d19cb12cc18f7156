import math
import random

import numpy as np
import pytest

from ragscale.llm.negatives import STEP, exact_scores, hard_negatives, moduli, residues

SCHEMA = "vec_id bigint, embedding array<float>, label int, rank string, score int"


def clean(v, scale=256):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(scale * float(np.float32(x))) for x in v]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def brute(rows, every, n_pos=5, n_neg=3):
    """Anchors are rows whose id ``every`` divides; one answer for each anchor row."""
    rows = [(i, clean(v), g) for i, v, g in rows if g is not None and clean(v) is not None]
    key = lambda t: (-t[0], t[1] is None, t[1] or 0)
    out = []
    for i, v, g in rows:
        if i is None or i % every:
            continue
        best = sorted(((dot(v, w), j) for j, w, h in rows if h == g and j != i), key=key)[:n_pos]
        for ps, p in best:
            hard = sorted(((dot(v, w), j) for j, w, h in rows if h != g and 50 * ps <= 100 * dot(v, w) <= 95 * ps), key=key)[:n_neg]
            out += [(i, p, r + 1, j, ps, s) for r, (s, j) in enumerate(hard)]
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is None, x or 0) for x in r])


def vectors(seed, n, width=8, hot=0):
    rng = random.Random(seed)
    rows = [(i, [round(rng.gauss(0, 0.5), 2) for _ in range(width)], rng.choice([0, 1, 2, None])) for i in range(n)]
    rows += [(n + i, [0.5] * width, 1) for i in range(hot)]  # one very common vector
    rows += [(3, None, 1), (4, [0.1, None] + [0.0] * (width - 2), 1), (6, [math.nan] * width, 0), (8, [math.inf] * width, 0), (None, [0.4] * width, 1), (10, [0.5] * width, 0), (10, [0.5] * width, 0)]
    rows += [(12, [0.9] * (width - 3), 2), (14, [], 1), (2**40, [-0.5] * width, 2)]
    return rows


@pytest.mark.parametrize("cells", [None, 8 * 7, 8 * 64])
def test_negatives_are_those_of_all_pairs(spark, cells):
    rows = vectors(1, 160, hot=60)
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(4)
    got = hard_negatives(table, table.where("vec_id % 5 = 0"), cells=cells).collect()
    assert ordered(tuple(r) for r in got) == ordered(brute(rows, 5)) and len(got) > 100
    assert got[0].__fields__ == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_few_positives_ties_and_empty(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.6, 0.0], 1), (3, [0.6, 0.0], 1), (4, [-1.0, 0.0], 1), (5, [0.0, 0.0], 2), (6, [0.0, 1.0], 2)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = hard_negatives(table, table).collect()
    assert ordered(tuple(r) for r in got) == ordered(brute(rows, 1))
    assert hard_negatives(table.limit(0), table).count() == hard_negatives(table, table.limit(0)).count() == 0
    assert hard_negatives(table.where("label = 0"), table.where("label = 0")).count() == 0


@pytest.mark.parametrize("size", [100, 30_000, 2**28])
def test_products_modulo_primes_are_exact(size):
    rng = np.random.default_rng(size)
    a, b = (rng.integers(-size, size, (n, 3 * STEP + 5), endpoint=True) for n in (20, 30))
    a[0], b[0] = size, -size
    bound = max(float((m.astype(float) ** 2).sum(1).max()) for m in (a, b))
    if bound >= 2.0**62:
        a, b = a // 64, b // 64
        bound = max(float((m.astype(float) ** 2).sum(1).max()) for m in (a, b))
    primes = moduli(bound)
    assert STEP * ((primes[0] - 1) // 2) ** 2 < 1 << 24 and math.prod(primes) > 2 * bound + 1
    assert len(primes) == len(set(primes)) and math.prod(primes[:-1]) <= 2 * bound * (1 + 1e-9) + 1
    got = exact_scores(residues(a, primes), residues(b, primes), primes)
    assert (got.astype(object) == a.astype(object) @ b.astype(object).T).all()


def test_too_long_vectors_raise(spark):
    table = spark.createDataFrame([(0, [1e15, 1e30], 0, "x", 1)], SCHEMA)
    with pytest.raises(ValueError, match="64 bits"):
        hard_negatives(table, table)
    big = [(0, [4e6, 1.0], 0), (1, [4e6, 2.0], 0), (2, [3e6, -5.0], 1), (3, [3e6, -6.0], 1)]  # scores far beyond 32 bits
    table = spark.createDataFrame([(*r, "x", 1) for r in big], SCHEMA)
    assert ordered(tuple(r) for r in hard_negatives(table, table).collect()) == ordered(brute(big, 1)) != []
