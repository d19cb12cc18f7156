import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from ragscale.llm.backoff import backoff_scores, planes, squeezed, steps, unplaned, unsqueezed, unstepped

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def make_rows():
    rng = random.Random(6)
    words = ["the", "cat", "sat", "on", "a", "mat", "été", "中文", "x,", "zebra"]
    rows = [(i, " ".join(rng.choices(words, weights=[60, 8, 8, 8, 5, 4, 3, 2, 1, 1], k=rng.choice([1, 2, 3, 10, 80])))) for i in range(80)]
    return rows + [(100, None), (101, ""), (102, " \n"), (103, "lonely"), (104, "the cat unheardof"), (105, "same row twice"), (105, "same row twice"), (None, "the cat sat"), (106, "w " * 5000)]


def brute(rows, order, alpha):
    docs = [WORD.findall(t or "") for _, t in rows]
    def counted(ws):
        return Counter(tuple(ws[i : i + k]) for k in range(1, order + 1) for i in range(len(ws) - k + 1))
    own, total = [counted(d) for d in docs], Counter()
    for c in own:
        total.update(c)
    size = sum(map(len, docs))
    out = []
    for (i, _), ws, mine in zip(rows, docs, own):
        rest, hits, value = size - len(ws), Counter(), 0.0
        def c(g):
            return total[g] - mine[g]
        for at in range(len(ws)):
            top = min(at + 1, order)
            for k in range(top, -1, -1):
                g = tuple(ws[at - k + 1 : at + 1])
                if k == 0:
                    value += math.log(alpha) * top - math.log(max(rest, 1))
                elif c(g):
                    value += math.log(alpha) * (top - k) + math.log(c(g) / (c(g[:-1]) if k > 1 else rest))
                else:
                    continue
                hits[k] += 1
                break
        out.append((str(i), len(ws), tuple(hits[k] for k in range(order, -1, -1)), value / len(ws) if ws else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_against_brute_force(spark, order):
    rows = make_rows()
    docs = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id bigint, text string, block int, n_words int, docs string").repartition(3, "text")
    got = backoff_scores(docs, ["doc_id", "docs"], order=order, block_bytes=700, part_grams=90).collect()
    told = sorted(((str(r[0]), r[2], tuple(r[3 : 3 + order + 1]), r.score) for r in got), key=str)
    want = brute(rows, order, 0.4)
    assert [t[:3] for t in told] == [w[:3] for w in want]
    assert all((a[3] is None) == (b[3] is None) and (a[3] is None or a[3] == pytest.approx(b[3])) for a, b in zip(told, want))


def test_no_documents(spark):
    assert backoff_scores(spark.createDataFrame([], "doc_id int, text string"), ["doc_id"]).collect() == []
    only = backoff_scores(spark.createDataFrame([(1, "a b")], "doc_id int, text string"), ["doc_id"]).collect()
    assert (only[0].n_words, only[0].n_unseen) == (2, 2)


def test_bytes_round_trip():
    rng = np.random.default_rng(1)
    for top in (1, 255, 256, 1 << 40, (1 << 63) - 1):
        values = rng.integers(0, top, 50).astype(np.uint64)
        assert unplaned(planes(values)).tolist() == values.tolist()
        assert unsqueezed(squeezed(values)).tolist() == values.tolist()
        assert unstepped(steps(np.sort(values))).tolist() == sorted(values.tolist())
    assert unplaned(planes(np.zeros(0, np.uint64))).tolist() == []
