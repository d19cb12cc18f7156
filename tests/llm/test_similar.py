import random

import pytest
from test_simhash import WORDS

import corpus_pipeline
from ragscale.llm import similar
from ragscale.llm.similar import simhash_pairs, similar_groups, verified, written_sets


def brute_sets(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(rows):
    """Group number of each row over links of Jaccard similarity 0.8 or more."""
    sets, label = [brute_sets(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return label


def edited(seed=4):
    """Copies with single words altered, whose similarity lies on both sides of 0.8; many share a passage."""
    rng, rows = random.Random(seed), [(0, None), (1, " "), (2, "one"), (3, "ONE"), (4, "a b c d e f"), (5, "a b c d e f"), (6, "a b c d e g")]
    passage = rng.choices(WORDS, k=30)
    for _ in range(14):
        base = rng.choices(WORDS, k=rng.choice([40, 100, 300])) + rng.choice([[], passage])
        for _ in range(6):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5, len(base) // 50])):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            rows.append((len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize("paired, distance", [(64, 2), (2, 2), (64, 3)])
def test_groups_are_those_of_exact_jaccard(spark, paired, distance):
    rows = edited()
    got = {r.doc_id: r.group_fp for r in similar_groups(spark.createDataFrame(rows, "doc_id int, text string").repartition(3), ["doc_id"], paired=paired, distance=distance).collect()}
    mine, want = {}, {}
    for (i, _), g in zip(rows, brute_groups(rows)):
        mine.setdefault(got[i], set()).add(i)
        want.setdefault(g, set()).add(i)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))
    assert 20 < len(want) < len(rows) - 20


def test_copies_in_many_tasks_and_a_crowd(spark, monkeypatch):
    """A third of the rows are one text, another third near copies of it; small limits send everything the long way."""
    monkeypatch.setattr(similar, "FREQUENT", 3)
    rng = random.Random(12)
    base = rng.choices(WORDS, k=60)
    rows = [(i, " ".join(base)) for i in range(40)]
    for i in range(40):
        words = list(base)
        for _ in range(rng.randint(1, 4)):
            words[rng.randrange(60)] = rng.choice(WORDS)
        rows.append((40 + i, " ".join(words)))
    rows += [(80 + i, " ".join(base[:20] + rng.choices(WORDS, k=40))) for i in range(40)]  # a passage in common
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(20)
    got = {r.doc_id: r.group_fp for r in similar_groups(docs, ["doc_id"], paired=4).collect()}
    mine, want = {}, {}
    for (i, _), g in zip(rows, brute_groups(rows)):
        mine.setdefault(got[i], set()).add(i)
        want.setdefault(g, set()).add(i)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_stage_drops_near_copies(spark):
    rows = edited()
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    first = {}
    for (i, _), g in zip(rows, brute_groups(rows)):
        first.setdefault(g, i)
    stage = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == sorted(first.values())
    assert stage(spark, docs.limit(0), "").count() == 0


def test_simhash_proposes_the_closest_pairs(spark):
    """Many copies with a word altered in 900 are proposed by their fingerprints alone, and what is verified is close."""
    rng, rows = random.Random(9), []
    for _ in range(40):
        base = rng.choices(WORDS, k=900)
        changed = list(base)
        changed[rng.randrange(900)] += "x"
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(changed))]
    sets = written_sets(spark.createDataFrame(rows, "doc_id int, text string"), ["doc_id"], "text", 5)
    of = {r.fp: r.k0 for r in sets.collect()}
    pairs = {tuple(sorted((of[r.a], of[r.b]))) for r in simhash_pairs(sets).collect()}
    assert len(pairs & {(2 * i, 2 * i + 1) for i in range(40)}) >= 12
    assert {tuple(sorted((of[r.a], of[r.b]))) for r in verified(simhash_pairs(sets), sets, 0.8).collect()} == pairs & {(2 * i, 2 * i + 1) for i in range(40)}


def test_outliers_of_a_crowd_are_not_compared_with_all_of_it(spark, monkeypatch):
    """Texts with many words of their own share a crowd's passages, but too few of them to be near any; copies of such a text are near it."""
    monkeypatch.setattr(similar, "FREQUENT", 3)
    rng = random.Random(21)
    base = rng.choices(WORDS, k=240)
    rows = []
    for edits, copies in ((1, 30), (2, 10), (20, 40)):
        for _ in range(copies):
            words = list(base)
            for at in rng.sample(range(240), edits):
                words[at] = f"w{len(rows)}x{at}"
            rows.append((len(rows), " ".join(words)))
    edge = rows[45][1].split()  # an outlier's near copies, which are near no others
    rows += [(80 + i, " ".join(edge[: 30 * i] + ["more"] + edge[30 * i :])) for i in range(1, 7)]
    written, plain = [], similar.materialize

    def counted(df, name, *a):
        table = plain(df, name, *a)
        written.append((name, table.count()))
        return table

    monkeypatch.setattr(similar, "materialize", counted)
    got = {r.doc_id: r.group_fp for r in similar_groups(spark.createDataFrame(rows, "doc_id int, text string").repartition(3), ["doc_id"], paired=4).collect()}
    mine, want = {}, {}
    for (i, _), g in zip(rows, brute_groups(rows)):
        mine.setdefault(got[i], set()).add(i)
        want.setdefault(g, set()).add(i)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values())) and {len(s) for s in want.values()} == {40, 7, 1}
    assert sum(n for name, n in written if name == "pairs") < 40 * 39  # as many as outliers with the crowd
