import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from ragscale.llm.mixing import fit_lengths, knapsack, mix, mix_sizes

SCHEMA = "doc_id bigint, text string, source string, _row int, _size string, target string, base int"


def make_docs(seed=1):
    rng = random.Random(seed)
    rows = [(i, "w " * rng.choice([1, 2, 3, 5, 50, 400, rng.randint(1, 900)]), rng.choice(["s1"] * 6 + ["S2", "é", "zz", None])) for i in range(900)]
    return rows + [(2000, None, "s1"), (2001, "", "empty"), (2002, " \n", None), (2003, "q " * 5, "zz"), (2003, "q " * 5, "zz"), (None, "a b", "S2"), (3000, "big " * 40_000, "s1")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "x", "y", 2) for i, t, s in rows], SCHEMA)


def brute_targets(rows, weights, most):
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if w[s] * level > most * sizes[s]}
        if not over:
            target |= {s: w[s] * level for s in free}
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return sizes, target


def test_mix_sizes(spark):
    rows = make_docs()
    got = mix_sizes(frame(spark, rows), [1, 2, 3]).collect()
    again = mix_sizes(frame(spark, rows).repartition(5), [1, 2, 3]).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes, target = brute_targets(rows, [1, 2, 3], 3)
    source = {i: s for i, _, s in rows}
    taken = {}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6 * max(1, target[s])
        assert r["size"] == 0 == r.taken or r.taken % r["size"] == 0 and r.taken <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 5 for s in sizes if s != "empty"), {s: (taken[s], target[s]) for s in sizes}


def test_mix_repeats_whole_rows(spark):
    rows = make_docs(2)
    docs = frame(spark, rows)
    wanted = {r.doc_id: r.taken // r["size"] if r["size"] else 1 for r in mix_sizes(docs, [1, 2, 3]).collect()}
    out = mix(docs, [1, 2, 3])
    assert out.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    rows_of = {i: sum(1 for j, _, _ in rows if j == i) for i, _, _ in rows}
    assert counts == {i: n * rows_of[i] for i, n in wanted.items() if n}
    assert out.select(F.min("_row"), F.max("_size")).first() == (1, "x")


def test_knapsack_is_exact():
    rng = random.Random(3)
    for _ in range(60):
        lengths = rng.sample(range(1, 40), rng.randint(1, 4))
        counts = [rng.randint(0, 5) for _ in lengths]
        budget = rng.randint(0, 120)
        best = max(s for c in itertools.product(*(range(n + 1) for n in counts)) if (s := sum(a * b for a, b in zip(c, lengths))) <= budget)
        chosen = knapsack(lengths, counts, budget)
        assert sum(lengths[i] * n for i, n in chosen.items()) == best and all(n <= counts[i] for i, n in chosen.items())


def test_fit_lengths():
    rng = random.Random(4)
    for _ in range(40):
        lengths = sorted(rng.sample(range(0, 3000), rng.randint(1, 300)))
        counts = [rng.randint(1, 400) for _ in lengths]
        total = sum(a * b for a, b in zip(lengths, counts))
        target = rng.random() * 3 * total
        base, more = fit_lengths(lengths, counts, target, dp_budget=rng.choice([0, 100, 1 << 16]))
        assert 0 <= base <= 3 and all(0 <= m <= c for m, c in zip(more, counts))
        assert total == 0 or abs(base * total + sum(a * b for a, b in zip(lengths, more)) - target) <= max(lengths)
    assert fit_lengths([0], [7], 0.0) == (0, [0]) and fit_lengths([3], [2], 18.0) == (3, [0])


def test_ties_and_hot_lengths(spark):
    rows = [(i, "same size text", "a") for i in range(5000)] + [(i, "w " * 7, "b") for i in range(5000, 5100)]
    got = mix_sizes(frame(spark, rows), [1, 2, 3]).collect()
    sizes, target = brute_targets(rows, [1, 2, 3], 3)
    taken = {"a": sum(r.taken for r in got if r.doc_id < 5000), "b": sum(r.taken for r in got if r.doc_id >= 5000)}
    assert all(abs(taken[s] - target[s]) <= 3 for s in "ab")


def test_no_documents(spark):
    assert mix_sizes(frame(spark, []), [1, 2, 3]).collect() == []
    assert mix(frame(spark, []), [1, 2, 3]).collect() == []


@pytest.mark.parametrize("partitions", [1, 6])
def test_repeated_rows_are_taken_up_to_the_target(spark, partitions):
    """A source of one row a hundred times over: its target falls between two copies."""
    rows = [(1, "one two three four", "a")] * 100 + [(2, "one two three", "b")] * 30 + [(i, "w " * (1 + i % 7), "b") for i in range(3, 90)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(partitions)
    got = mix_sizes(docs, [1, 2]).collect()
    taken, target = {}, {}
    for r in got:
        s = "a" if r.doc_id == 1 else "b"
        taken[s], target[s] = taken.get(s, 0) + r.taken, r.target
        assert r.taken % r.size == 0 and r.taken <= 3 * r.size
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 4 for s in "ab") and 0 < taken["a"] < 400
    mixed = mix(docs, [1, 2]).collect()
    assert sum(r.text.count(" ") + 1 for r in mixed if r.source == "a") == taken["a"]
    assert sum(len(r.text.split()) for r in mixed if r.source == "b") == taken["b"]
    assert {tuple(r) for r in mixed} <= set(rows)
