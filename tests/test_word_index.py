"""The stored word index: exact scores, appending, collections, and texts that are not read again."""

import math
import random
import shutil

import pytest
from pyspark.sql import functions as F

from ragscale.operators import lexical
from ragscale.operators.word_index import RANGE, append_words, build_words, open_words, search_words

WORDS = [f"w{i}" for i in range(60)] + ["Rare", "ünder", "don't"]


def corpus(n=700, seed=3):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    rows = [(f"c{i:04}", i % 3 if i % 10 else None, " ".join(rng.choices(WORDS, weights, k=rng.randint(0, 60)))) for i in range(n)]
    return rows + [("none", 1, None), ("blank", 2, " ,. ")]


def cut(text):
    word, out = "", []
    for ch in (text or "").lower() + " ":
        if ch.isalnum():
            word += ch
        elif word:
            out.append(word)
            word = ""
    return out


def brute(queries, rows, k):
    """BM25 over all chunks of a query's collection."""
    out = set()
    for q, g, text in queries:
        mine = [(i, cut(t)) for i, h, t in rows if h == g]
        mean = sum(len(t) for _, t in mine) / len(mine)
        scores = []
        for i, t in mine:
            s = 0.0
            for w in set(cut(text)):
                df = sum(w in o for _, o in mine)
                tf = t.count(w)
                if tf:
                    s += math.log(1 + (len(mine) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))
            if any(w in t for w in cut(text)):
                scores.append((-round(s, 9), i))
        out |= {(q, i, -s, r + 1) for r, (s, i) in enumerate(sorted(scores)[:k])}
    return out


def close(got, want):
    a, b = sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in got), sorted((q, r, i, s) for q, i, s, r in want)
    assert [x[:3] for x in a] == [x[:3] for x in b]
    assert [x[3] for x in a] == pytest.approx([x[3] for x in b], abs=1e-8)


QUERIES = [(1, "w1 w2 rare"), (2, "w0 w0 w5 w59 zzz"), (3, "nothing here"), (4, ""), (5, None), (6, "Rare ünder don't w44"), (7, " ".join(WORDS))]


@pytest.mark.parametrize("seeds", [1, 4, 1000])
def test_search_is_exact(spark, tmp_path, seeds):
    rows = [(i, 0, t) for i, _, t in corpus()]
    chunks = spark.createDataFrame(rows, "chunk_id string, g int, text string").repartition(3)
    build_words(chunks, str(tmp_path / "i"))
    queries = spark.createDataFrame(QUERIES, "query_id int, query string")
    want = brute([(q, 0, t) for q, t in QUERIES], rows, 5)
    close(search_words(queries, str(tmp_path / "i"), seeds=seeds).collect(), want)
    assert {q for q, *_ in want} == {1, 2, 6, 7}
    assert search_words(queries.limit(0), str(tmp_path / "i")).count() == 0


def test_collections_with_a_null_key(spark, tmp_path):
    rows = corpus()
    build_words(spark.createDataFrame(rows, "chunk_id string, g int, text string").repartition(4), str(tmp_path / "i"), by=["g"])
    asked = [(10 * q + (g or 0) + (5 if g is None else 0), g, t) for q, t in QUERIES for g in (0, 1, None)]
    got = search_words(spark.createDataFrame(asked, "query_id int, g int, query string"), str(tmp_path / "i"), by=["g"])
    close(got.collect(), brute(asked, rows, 5))


def test_second_search_reads_no_text_and_appending_splits_new_texts_only(spark, tmp_path):
    rows = [(i, 0, t) for i, _, t in corpus()]
    source, path = str(tmp_path / "texts"), str(tmp_path / "i")
    spark.createDataFrame(rows, "chunk_id string, g int, text string").write.parquet(source)
    chunks = spark.read.parquet(source)
    build_words(chunks.where("chunk_id < 'c0500'"), path)
    before = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "i").rglob("*.parquet")}
    append_words(chunks, path)
    append_words(chunks, path)
    assert all((tmp_path / p).stat().st_mtime_ns == t for p, t in before.items())
    shutil.rmtree(source)
    queries = spark.createDataFrame(QUERIES, "query_id int, query string")
    close(search_words(queries, path).collect(), brute([(q, 0, t) for q, t in QUERIES], rows, 5))
    stored = open_words(spark, path)
    assert stored.where("token is null").agg(F.sum("n")).first()[0] == len(rows)
    claims = queries.select(F.col("query_id").alias("claim_id"), F.col("query").alias("claim"))
    texts = spark.createDataFrame(rows, "text_id string, g int, text string")
    found = lexical.entailed_claims(claims, coverage=60, index=path)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, lexical.entailed_claims(claims, texts, coverage=60).collect()))


def test_bounds_hold_for_every_range(spark, tmp_path):
    build_words(spark.createDataFrame(corpus(300), "chunk_id string, g int, text string").coalesce(1), str(tmp_path / "i"), by=["g"])
    for r in open_words(spark, str(tmp_path / "i")).collect():
        assert r.n == len(r.chunks) == len(set(r.chunks)) <= RANGE and r.min_len == min(r.lens)
        assert r.max_tf == max(r.tfs) and (r.token is not None or r.total == sum(r.lens))
