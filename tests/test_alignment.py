"""Local alignment against plain dynamic programming, negations and numbers."""

import numpy as np
import pytest

from ragscale.operators.alignment import align, aligned_claims, best_diagonal


def brute(a, b, band):
    """Score, matches and stretch of the best local alignment in the band, cell by cell."""
    at, cells = best_diagonal(np.array(a), np.array(b)), {}
    best = (0, 0, 0, 0)
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            ways = [(0, 0, -j)]
            if i and j and abs(j - 1 - (i - 1) - at) <= band and max(0, at - band) < j <= min(len(b), at + len(a) + band):
                s, n, f = cells.get((i - 1, j - 1), (0, 0, -(j - 1)))
                ways.append((s + 1, n + 1, f) if a[i - 1] == b[j - 1] else (s - 1, n, f))
                for other in ((i - 1, j), (i, j - 1)):
                    if other in cells:
                        s, n, f = cells[other]
                        ways.append((s - 1, n, f))
                cells[i, j] = max(ways)
                if cells[i, j][0] > best[0]:
                    s, n, f = cells[i, j]
                    best = (s, n, -f, j)
    return best


@pytest.mark.parametrize("band", [1, 3, 50])
def test_alignment_is_that_of_plain_dynamic_programming(band):
    rng = np.random.default_rng(band)
    for _ in range(250):
        b = rng.integers(0, rng.integers(2, 9), rng.integers(0, 25))
        a = rng.integers(0, 6, rng.integers(0, 9))
        if rng.random() < 0.5 and len(b) > 5:
            k = rng.integers(0, len(b) - 4)
            a = np.delete(b[k : k + 8], 1)
        score, matches, first, end = align(a, b, band)
        want = brute(a.tolist(), b.tolist(), band)
        assert (score, matches) == want[:2] and (not score or (first, end) == want[2:])


def test_order_negation_and_numbers_decide(spark):
    claims = spark.createDataFrame([(1, "The council approved 12 new parks"), (2, "the council did not approve parks"), (3, ""), (4, None)], "claim_id int, claim string")
    texts = spark.createDataFrame([
        ("yes", "Yesterday the council approved 12 new parks in town."), ("order", "parks new 12 approved council the"),
        ("number", "the council approved 14 new parks"), ("negated", "The council approved not 12 new parks"), ("gap", "the council approved, at last, 12 new parks"),
        ("both", "the council did not approve parks"), ("none", None),
    ], "text_id string, text string")
    pairs = claims.select("claim_id").crossJoin(texts.select("text_id"))
    got = {(r.claim_id, r.text_id): r for r in aligned_claims(pairs, claims, texts, coverage=80).collect()}
    assert len(got) == 28
    assert {t for (c, t), r in got.items() if c == 1 and r.entailed} == {"yes", "gap"}
    assert {t for (c, t), r in got.items() if c == 2 and r.entailed} == {"both"}
    assert not any(r.entailed for (c, t), r in got.items() if c > 2 or t == "none")
    assert not got[1, "negated"].negation_ok and not got[1, "number"].numbers_ok and got[1, "order"].n_matched <= 2
    assert (got[1, "yes"].first, got[1, "yes"].end, got[1, "yes"].n_claim) == (1, 7, 6)
    assert aligned_claims(pairs.limit(0), claims, texts).count() == 0
