import random

import numpy as np
import pyarrow as pa
import pytest

from ragscale.llm import cotrain
from ragscale.llm.arrays import text_buffers

SCHEMA = "doc_id bigint, text string, source string, lang string, n_chars bigint, score double, k0 string"


def make(spark, n=400, seed=3):
    """Good pages: prose in long lines from quiet sources. Bad ones: shouting in short lines from loud ones; a few of either mixed."""
    rng, docs, labels = random.Random(seed), [], []
    for i in range(n):
        good = rng.random() < 0.7
        look = good if rng.random() < 0.9 else not good
        words = ["".join(rng.choices("etaoinshrd", k=rng.randint(2, 8))) for _ in range(60)]
        text = (" ".join(words) if good else " ".join(w.upper() + "!!" for w in words))
        if not look:
            text = text.replace(" ", "\n")
        docs.append((i, text, f"{'quiet' if look else 'loud'}{rng.randrange(3)}", rng.choice(["en", None]), len(text), 0.0, "x"))
        if i % 2:
            labels.append((i, int(good), 0))
    labels += [(1, 1 - labels[0][1], 0), (None, 1, 0), (99_999, 0, 0), (3, 7, 0), (5, None, 0)]
    truth = {d[0]: " ".join(d[1].split()).islower() for d in docs}
    docs += [(n, None, None, None, None, 0.0, "x"), (n + 1, "", "loud0", "en", 0, 0.0, "x"), (None, "text without id", "quiet1", "en", 9, 0.0, "x"), (2, docs[2][1], docs[2][2], docs[2][3], docs[2][4], 0.0, "x")]
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), truth


def test_views_learn_and_combine(spark):
    docs, labels, truth = make(spark)
    scorer = cotrain.learn(docs, labels, sample=300)
    rows = cotrain.score(docs, scorer, ["doc_id", "k0"]).collect()
    assert len(rows) == docs.count()
    right = [r.kept == truth[r.doc_id] for r in rows if r.doc_id in truth]
    assert np.mean(right) > 0.95
    assert all(0 <= x <= 1 for r in rows for x in (r.text_score, r.page_score, r.score))
    twice = [r for r in rows if r.doc_id == 2]
    assert len(twice) == 2 and twice[0] == twice[1]
    again = cotrain.score(docs.repartition(3), cotrain.learn(docs.repartition(5), labels, sample=300), ["doc_id"])
    assert {(r.doc_id, round(r.score, 9)) for r in again.collect()} == {(r.doc_id, round(r.score, 9)) for r in rows}


def test_pseudo_labels_help_the_weaker_view(spark):
    """With few labels, what the page view is sure of teaches the text view."""
    rng = np.random.default_rng(5)
    n, known = 600, 24
    label = (np.arange(n) % 2 == 0).astype(int)
    page = cotrain.Rows(np.where(rng.random(n) < 0.97, label, 1 - label), np.ones(n), np.arange(n + 1))
    signs = np.stack([np.where(rng.random(n) < 0.62, label, 1 - label) + 2 * i for i in range(25)], axis=1)
    text = cotrain.Rows(signs.ravel(), np.full(n * 25, 1.0), np.arange(n + 1) * 25)
    given = np.where(np.arange(n) < known, label, -1)
    alone = cotrain.co_train(text, page, given, rounds=0)[0].logit(text)
    taught = cotrain.co_train(text, page, given, rounds=6, share=0.1)[0].logit(text)
    score = lambda x: ((x > 0) == label)[known:].mean()
    assert score(taught) > score(alone) + 0.03 and score(taught) > 0.85


def test_scoring_equals_the_training_features():
    data, offsets = text_buffers(pa.array(["some text here", "", None, "ab", "ééé!", "x" * 500]))
    weights = np.random.default_rng(1).normal(size=cotrain.TEXT_BUCKETS)
    assert cotrain.text_scores(data, offsets, weights) == pytest.approx(cotrain.text_rows(data, offsets).dot(weights))


def test_without_labels_or_documents(spark):
    docs, labels, _ = make(spark, 20)
    none = cotrain.learn(docs, labels.limit(0))
    assert {round(r.score, 6) for r in cotrain.score(docs, none, ["doc_id"]).collect()} == {0.5}
    one_class = cotrain.learn(docs, labels.where("quality = 1"))
    assert all(r.score > 0.5 for r in cotrain.score(docs, one_class, ["doc_id"]).collect())
    assert cotrain.score(docs.limit(0), cotrain.learn(docs.limit(0), labels), ["doc_id"]).collect() == []
