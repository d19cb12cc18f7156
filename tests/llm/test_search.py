import numpy as np
import pytest
from test_negatives import SCHEMA, clean, dot, ordered, vectors

from ragscale.llm import search
from ragscale.llm.search import SortedLists, best_of_block, exact_topk


def brute(rows, every, k=5):
    rows = [(i, clean(v)) for i, v, _ in rows if clean(v) is not None]
    key = lambda t: (-t[0], t[1] is None, t[1] or 0)
    out = []
    for i, v in rows:
        if i is not None and i % every == 0:
            best = sorted(((dot(v, w), j) for j, w in rows if j != i), key=key)[:k]
            out += [(i, r + 1, j, s) for r, (s, j) in enumerate(best)]
    return out


@pytest.mark.parametrize("cells", [None, 8 * 3, 8 * 50])
def test_topk_is_that_of_all_pairs(spark, cells):
    rows = vectors(2, 200, hot=70)
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    got = exact_topk(table.where("vec_id % 5 = 0"), table, cells=cells).collect()
    assert ordered(tuple(r) for r in got) == ordered(brute(rows, 5)) and len(got) > 200
    assert got[0].__fields__ == ["query_id", "rank", "vec_id", "score"]


def test_empty_few_and_long(spark):
    rows = [(0, [1.0, 0.0], None), (1, [1.0, 0.0], 0), (2, [2e5, 1.0], 0)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert ordered(tuple(r) for r in exact_topk(table, table).collect()) == ordered(brute(rows, 1))
    assert exact_topk(table.limit(0), table).count() == exact_topk(table, table.limit(0)).count() == 0
    with pytest.raises(ValueError, match="bits"):
        far = spark.createDataFrame([(0, [1e12, 1e12], 0, "x", 1)], SCHEMA)
        exact_topk(far, far)


def test_bounds_hold_in_every_round_and_reading_stops_early(monkeypatch):
    rng = np.random.default_rng(3)
    m = rng.integers(-90, 90, (4000, 12)).astype(np.float32)
    queries = (m[:30] + rng.integers(-9, 9, (30, 12))).astype(np.float32)  # each has one near neighbour
    lists, scores = SortedLists(m), queries @ m.T
    rising, falling = np.maximum(queries, 0), np.minimum(queries, 0)
    width = None
    for number in range(len(search.DEPTHS)):
        upper, slack = lists.bounds(number, rising, falling)
        assert (upper >= scores).all() and (upper - slack[:, None] <= scores).all()
        assert width is None or (upper <= width).all()  # reading on only narrows them
        width = upper
    assert (width == scores).all()
    read = []
    original = SortedLists.bounds
    monkeypatch.setattr(SortedLists, "bounds", lambda self, number, *q: read.append((number, len(q[0]))) or original(self, number, *q))
    query, row, score = best_of_block(lists, queries, np.zeros((30, 4000), bool), 3)
    want = [(q, r, scores[q, r]) for q in range(30) for r in np.lexsort((np.arange(4000), -scores[q]))[:3]]
    assert sorted(zip(query, row, score)) == sorted(want)
    assert max(n for n, _ in read) < len(search.DEPTHS) - 1  # no list was read to its end
