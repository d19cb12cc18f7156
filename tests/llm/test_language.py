import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ragscale.llm.arrays import text_buffers
from ragscale.llm.language import FLOOR, PENALTY, ROUNDS, LanguageModel, held_out, identify, infer, learn, word_logs

STEMS = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "der", "ein"], "cc": ["éa", "ou", "què", "tre"]}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choices(STEMS[lang], k=rng.randint(1, 4))) for _ in range(n))


def training(rng):
    return [(i, sentence(rng, lang, 60), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 30)]


@pytest.fixture(scope="module")
def model(spark):
    return learn(spark.createDataFrame(training(random.Random(1)) + [(900, "kalo", None), (901, None, "aa")], "doc_id bigint, text string, lang string"))


def test_proportions_and_sets(spark, model):
    rng = random.Random(2)
    rows = [(i, sentence(rng, "aa", a) + ". " + sentence(rng, "bb", b) + "\n" + sentence(rng, "cc", c) if a + b + c else "", (a, b, c))
            for i, (a, b, c) in enumerate([(80, 0, 0), (0, 3, 0), (60, 40, 0), (30, 0, 90), (50, 50, 60), (1, 0, 0)])]
    docs = spark.createDataFrame([(i, t, "zz", 7) for i, t, _ in rows], "doc_id bigint, text string, lang_pred string, score int")
    got = {r.doc_id: r for r in identify(docs, model, ["doc_id"]).collect()}
    for i, _, parts in rows:
        want = {k: n / sum(parts) for k, n in zip(["aa", "bb", "cc"], parts) if n}
        assert got[i].languages.keys() == want.keys()
        assert all(abs(got[i].languages[k] - want[k]) < 0.08 for k in want)
        assert got[i].score == pytest.approx(max(got[i].languages.values())) and got[i].lang_pred == max(want, key=want.get)


def test_undefined_and_empty(spark, model):
    rows = [(1, None), (2, ""), (3, "12 !! ..."), (4, "12 ka"), (4, "12 ka"), (None, "schung")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((str(r.doc_id), r.lang_pred, r.score > 0) for r in identify(docs, model, ["doc_id"]).collect())
    assert got == [("1", "und", False), ("2", "und", False), ("3", "und", False), ("4", "aa", True), ("4", "aa", True), ("None", "bb", True)]
    assert identify(docs.limit(0), model, ["doc_id"]).collect() == []
    nothing = learn(docs.selectExpr("text", "cast(null as string) as lang"))
    assert {r.lang_pred for r in identify(docs, nothing, ["doc_id"]).collect()} == {"und"}
    one = learn(docs.selectExpr("text", "'aa' as lang"))
    assert {r.lang_pred for r in identify(docs, one, ["doc_id"]).collect()} == {"und", "aa"}


def brute(model, text, penalty):
    """Every growth of the language set tried with a plain loop over words."""
    data, offsets = text_buffers(pa.array([text]))
    logs, _ = word_logs(model, data, offsets)
    like = np.exp(logs.astype(float))
    n, k = like.shape

    def em(allowed):
        share = np.array([1 / len(allowed) if i in allowed else 0 for i in range(k)])
        for _ in range(ROUNDS):
            part = like * share
            share = (part / part.sum(axis=1, keepdims=True)).mean(axis=0)
        return share, np.log((like * share).sum(axis=1)).sum()

    chosen = [int(logs.astype(float).sum(axis=0).argmax())]
    share, score = np.eye(k)[chosen[0]], logs.astype(float).sum(axis=0).max()
    while len(chosen) < k:
        trials = [(em([*chosen, x]), x) for x in range(k) if x not in chosen]
        (new, value), x = max(trials, key=lambda t: t[0][1])
        if value - score <= penalty * np.log(max(n, 2)):
            break
        chosen, share, score = [*chosen, x], new, value
    return share


def test_against_plain_loops(model):
    rng = random.Random(5)
    texts = []
    for _ in range(60):
        texts.append(" ".join(sentence(rng, rng.choice(["aa", "bb", "cc"]), rng.randint(1, 40)) for _ in range(rng.randint(1, 3))))
    data, offsets = text_buffers(pa.array(texts))
    got = infer(model, data, offsets)
    for text, row in zip(texts, got):
        assert row == pytest.approx(brute(model, text, PENALTY), abs=2e-3)
    assert FLOOR > 0


def test_counting_and_split(spark):
    rows = spark.createDataFrame([(i,) for i in [0, 1, 5, 12345, None]], "doc_id bigint")
    got = {r.doc_id: r.h for r in rows.select("doc_id", held_out("doc_id").alias("h")).collect()}
    assert got == {i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0 for i in got}
    assert isinstance(learn(rows.selectExpr("doc_id", "'a' as lang", "cast(doc_id as string) as text")), LanguageModel)


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs.where(~held_out("doc_id")))
    rows = identify(docs.where(held_out("doc_id")), model, ["lang"]).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) > 0


def test_rare_languages_beyond_the_bound_teach_nothing(spark):
    rows = [(i, "the quick brown fox jumps", "en") for i in range(6)] + [(10 + i, "der schnelle braune fuchs springt", "de") for i in range(4)]
    rows += [(100 + i, "noise", f"x{i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    assert learn(docs, most=2).names == ["de", "en"] and len(learn(docs).names) == 32
    told = identify(docs.withColumn("score", F.lit("mine")), learn(docs, most=2), ["doc_id", "score"])
    assert told.columns == ["doc_id", "lang_pred", "score", "languages"] and told.count() == len(rows)


def test_a_text_longer_than_a_slice(spark):
    long = "der schnelle braune fuchs springt " * 150_000
    docs = spark.createDataFrame([(1, long, "de"), (2, "the quick brown fox jumps " * 150_000, "en"), (3, "fuchs springt", None)], "doc_id int, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in identify(docs, learn(docs), ["doc_id"]).collect()} == {1: "de", 2: "en", 3: "de"}
