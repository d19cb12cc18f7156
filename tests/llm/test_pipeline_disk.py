import os
import random

from test_pipeline import make_docs
from test_similar import brute_sets, edited

import corpus_pipeline
from ragscale.llm import fertility, similar
from ragscale.llm.similar import similar_groups, verified, written_sets


def watch(monkeypatch, module, seen):
    """What ``module`` writes goes to ``seen`` as (name, written table)."""
    plain = module.materialize
    monkeypatch.setattr(module, "materialize", lambda df, name, *a: seen.append((name, plain(df, name, *a))) or seen[-1][1])


def test_quality_rules_write_no_texts(spark, monkeypatch):
    docs, rows = make_docs(spark)
    docs = docs.repartition(4).unionByName(docs.where("doc_id in (3, 402)"))  # repeated rows stay repeated
    told = fertility.learned_rules(docs, *map(corpus_pipeline.vocabulary, ("piece_bpe_32k.model", "word_bpe_49k.json")), docs.columns)
    want = sorted(map(str, told.where("kept").select(*docs.columns).collect()))
    seen = []
    for module in (fertility, corpus_pipeline):
        watch(monkeypatch, module, seen)
    got = corpus_pipeline.check_quality(spark, docs, "")
    assert sorted(map(str, got.collect())) == want and 100 < len(want) < docs.count()
    texts = {t for _, t, _, _ in rows if t}
    assert seen and not any(v in texts for _, table in seen for r in table.collect() for v in r if isinstance(v, str))


def test_sets_move_in_passes(spark, monkeypatch):
    """Many more pairs than sets: none is left out, and no pass has most of them."""
    rng = random.Random(3)
    monkeypatch.setattr(similar, "MOVED", 2)
    rows = edited()[:40]
    sets = written_sets(spark.createDataFrame(rows, "doc_id int, text string").repartition(1), ["doc_id"], "text", 5).where("elements is not null")
    of = {r.fp: brute_sets(rows[r.k0][1]) for r in sets.collect()}
    every = [(a, b) for a in of for b in of if a < b]
    rng.shuffle(every)
    seen = []
    watch(monkeypatch, similar, seen)
    got = verified(spark.createDataFrame(every + every[:5], "a bigint, b bigint"), sets, 0.8)
    near = sorted(p for p in every if 5 * len(of[p[0]] & of[p[1]]) >= 4 * len(of[p[0]] | of[p[1]]))
    assert sorted(map(tuple, got.collect())) == near and len(near) > 5
    assert sum(name == "verified" for name, _ in seen) >= len(every) / len(of) / 2 > 8


def test_sets_are_gone_and_copies_count_once(spark, monkeypatch):
    """What near-dedup returns reads no sets, and a text in two tasks has one set."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices("abcdefghijklmnop", k=40))) for i in range(60)]
    rows += [(i + 100, t) for i, t in rows[:4]]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "doc_id int, text string")
    seen = []
    watch(monkeypatch, similar, seen)
    groups = {r.doc_id: r.group_fp for r in similar_groups(docs, ["doc_id"]).collect()}
    assert all(groups[i] == groups[i + 100] for i in range(4)) and len(set(groups.values())) == 60 and len(groups) == 64
    paths = dict((name, table._ragscale_path) for name, table in seen)
    assert not os.path.exists(paths["sets"].removeprefix("file://")) and os.path.exists(paths["groups"].removeprefix("file://"))
    assert dict(seen)["copies"].count() >= 1  # as many as the tasks have met again
