import random

import corpus_pipeline
from ragscale.llm import language
from test_similar import brute_groups

from ragscale.session import materialize


def make_docs(spark):
    rng = random.Random(8)
    stems = {"en": ["the", "ing", "th", "er", "ou"], "de": ["sch", "ung", "ein", "keit", "über"]}
    rows = []
    for i in range(150):
        lang = rng.choice(["en", "de"])
        words = ["".join(rng.choices(stems[lang], k=rng.randint(1, 3))) for _ in range(rng.choice([60, 90, 300]))]
        rows.append((i, " ".join(words), lang, rng.choice(["a", "a", "a", "b", None])))
    rows += [(200 + i, rows[i][1] + " ende", rows[i][2], "b") for i in range(20)] + [(300 + i, rows[i][1], rows[i][2], None) for i in range(10)]
    rows += [(400, None, "en", "a"), (401, "123 456 " * 60, "en", "a"), (402, "short text", "en", "b"), (403, "same words here " * 50, None, "b"), (404, rows[3][1] + " extra", None, "c"), (5, rows[5][1], "en", "a"), (None, rows[7][1], "de", "a")]
    return spark.createDataFrame([(i, t, g, s, len(t or ""), 1) for i, t, g, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, turn int"), rows


def test_stages_against_brute_force(spark):
    docs, rows = make_docs(spark)
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language ID", "quality rules", "SimHash near-dedup", "mixing", "packing"]

    one = materialize(stages["language ID"](spark, docs, ""), "one")
    assert one.columns == columns and {400, 401} & {r.doc_id for r in one.collect()} == set()
    told = language.identify(docs, language.learn(docs), ["doc_id"]).where("lang_pred != 'und' and score >= 0.5").count()
    assert one.count() == told >= len(rows) - 4 and one.where("lang is null").count() == 0

    two = materialize(stages["quality rules"](spark, one, ""), "two")
    assert two.columns == columns and {402, 403} & {r.doc_id for r in two.collect()} == set()
    assert {r.doc_id for r in two.collect()} >= set(range(0, 150, 7)) & {r.doc_id for r in one.collect()}

    three = materialize(stages["SimHash near-dedup"](spark, two, ""), "three")
    kept = two.collect()
    rank = sorted(range(len(kept)), key=lambda i: (kept[i].doc_id is None, kept[i].doc_id or 0))
    first = {}
    for i, g in zip(rank, brute_groups([(kept[i].doc_id, kept[i].text) for i in rank])):
        first.setdefault(g, kept[i].doc_id)
    got = three.collect()
    assert three.columns == columns and sorted(r.doc_id or -1 for r in got) == sorted(x or -1 for x in first.values())
    assert len(got) < len(kept) - 20
    texts = {(r.doc_id, r.text) for r in kept}
    assert all((r.doc_id, r.text) in texts for r in got)

    four = materialize(stages["mixing"](spark, three, ""), "four")
    assert four.columns == columns and {(r.doc_id, r.text) for r in four.collect()} <= {(r.doc_id, r.text) for r in got}
    total = sum(len(r.text.split()) for r in got)
    assert abs(sum(len(r.text.split()) for r in four.collect()) - total) <= 3 * 60  # three sources whose shortest documents have 60 words

    five = stages["packing"](spark, four, "").collect()
    sums = {}
    for r in five:
        sums[r.doc_id] = sums.get(r.doc_id, 0) + r.length
    want = {}
    for r in five:
        want[r.doc_id] = r.doc_tokens
    copies = {r.doc_id: r["count"] for r in four.groupBy("doc_id").count().collect()}
    assert sums == {i: n * copies[i] for i, n in want.items()} and copies.keys() == sums.keys()


def test_run_and_empty(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.limit(5).count() == 5 and {"doc_id", "sequence_id", "offset", "length", "ids"} <= set(out.columns)
    docs, _ = make_docs(spark)
    frame = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, "")
    assert frame.count() == 0
