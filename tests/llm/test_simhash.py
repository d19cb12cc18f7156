import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from ragscale.llm.arrays import text_buffers
from ragscale.llm.components import connected_components
from ragscale.llm.simhash import allocate, correlated_parts, near_duplicates, near_links, plan_parts, simhash_rows

WORDS = [f"Wort{i}ä" for i in range(300)]


def brute_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items):
    """Smallest id reachable over links of at most two bits; items: (id, fingerprint)."""
    label = list(range(len(items)))
    for i in range(len(items)):
        for j in range(i):
            if (items[i][1] ^ items[j][1]).bit_count() <= 2 and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    smallest = {}
    for (i, _), c in zip(items, label):
        if i is not None:
            smallest[c] = min(smallest.get(c, i), i)
    return [smallest.get(c) for c in label]


def near_texts(seed=3):
    rng = random.Random(seed)
    rows = [(None, None), (1, ""), (2, "  \n"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "a b c"), (6, "a b c")]
    for g in range(12):
        base = rng.choices(WORDS, k=rng.choice([40, 200, 600]))
        for _ in range(6):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            rows.append((100 + len(rows), " ".join(words)))
    return rows


def test_fingerprints():
    texts = [t for _, t in near_texts()] + ["x " * 2000]
    data, offsets = text_buffers(pa.array(texts))
    assert simhash_rows(data, offsets, 3, 42).tolist() == [brute_simhash(t) for t in texts]


@pytest.mark.parametrize("paired", [64, 1])
def test_near_duplicates_against_brute_force(spark, paired):
    rows = near_texts()
    docs = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id bigint, text string, fp int, component_id int, _text string")
    got = near_duplicates(docs, ["doc_id"], paired=paired).collect()
    fps = [brute_simhash(t) for _, t in rows]
    want = sorted((str(i), f, str(c)) for (i, _), f, c in zip(rows, fps, brute_components([(i, f) for (i, _), f in zip(rows, fps)])))
    assert sorted((str(r.doc_id), r.fp & (1 << 64) - 1, str(r.component_id)) for r in got) == want
    assert len({c for _, _, c in want}) < len(want) - 20


@pytest.mark.parametrize("plan", [None, [(list(range(32)), 1), (list(range(32, 64)), 0)], [(list(range(64)), 2)]])
@pytest.mark.parametrize("paired", [64, 2])
def test_links_join_exactly_the_near_ones(spark, plan, paired):
    rng = random.Random(7)
    fps = set()
    for _ in range(25):
        seed = rng.getrandbits(64)
        fps |= {seed} | {seed ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(8)}
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint")
    links = near_links(df, 2, paired, plan).collect()
    full = (1 << 64) - 1
    assert all(((r.a & full) ^ (r.b & full)).bit_count() <= 2 for r in links)
    got = {r.node & full: r.root & full for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    label = brute_components([(f, f) for f in fps])
    groups = {}
    for f, c in zip(fps, label):
        groups.setdefault(c, set()).add(f)
    mine = {}
    for f in fps:
        mine.setdefault(got.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_allocation_is_optimal():
    rng = random.Random(1)
    for _ in range(30):
        costs = [[0.0] + sorted(rng.random() * 100 for _ in range(3)) for _ in range(rng.randint(1, 4))]
        options = [[]]
        for c in costs:
            options = [o + [s] for o in options for s in range(4)]
        best = min(sum(c[s] for c, s in zip(costs, o)) for o in options if sum(o) == 3)
        total, chosen = allocate(costs, 2)
        assert total == pytest.approx(best) and sum(t + 1 for t in chosen) == 3


def test_correlated_bits_go_together():
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2, (4000, 64))
    bits[:, 40:44] = bits[:, :1]
    both = (bits.T @ bits).astype(float)
    parts = correlated_parts(4000, both, 3)
    assert sorted(b for p in parts for b in p) == list(range(64))
    assert any({0, 40, 41, 42, 43} <= set(p) for p in parts)
    assert sum(t + 1 for _, t in plan_parts(4000, both, 2)) == 3
    assert sum(t + 1 for _, t in plan_parts(0, np.zeros((64, 64)), 2)) == 3


def test_empty_and_long_paths(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert near_duplicates(docs, ["doc_id"]).collect() == []
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(None, 3), (5, 5), (100, 101)], "a bigint, b bigint")
    roots = {r.node: r.root for r in connected_components(chain).collect()}
    assert all(roots[i] == 0 for i in range(41)) and roots[101] == 100
