"""Chunking, numbering, prompts, retrieval and claims against plain Python on small fixtures."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragscale.functions.text import word_count
from ragscale.operators import chunking, claims, lexical, prompts, vectors


def windows(text, size, overlap):
    ws = text.split()
    if len(ws) <= size:
        return [text] if ws else []
    out, at = [], 0
    while True:
        out.append(" ".join(ws[at:at + size]))
        if at + size >= len(ws):
            return out
        at += max(1, size - overlap)


@pytest.mark.parametrize("size, overlap, counts", [
    (300, 64, [0, 1, 299, 300, 301, 535, 536, 537, 773]), (5, 7, [4, 5, 6, 9]), (10, 3, [9, 10, 11, 17, 18, 24]),
])
def test_chunks(spark, size, overlap, counts):
    texts = [" \n ".join(f"w{i}" for i in range(n)) for n in counts] + ["   ", "a b c\x1cd", " lead and trail "]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in chunking.chunk_passages(df, "text", size, overlap).orderBy("id", "chunk_index").collect():
        got.setdefault(r["id"], []).append(r["text"])
    assert [got.get(i, []) for i in range(len(texts))] == [windows(t, size, overlap) for t in texts]
    assert [r[0] for r in df.orderBy("id").select(word_count("text")).collect()] == [len(t.split()) for t in texts]


def test_numbering_runs_through_a_collection(spark):
    meta = "metadata struct<original_passages: array<string>, knowledge: string>"
    rows = [(f"s{i:03d}", "d", f"u{i % 2}", ([" ".join(["x"] * (i % 7)), None, "  ", "one two"], "k" if i % 5 == 0 else " "))
            for i in range(60)]
    samples = spark.createDataFrame(rows, f"sample_id string, dataset string, subset string, {meta}")
    got = {}
    out = chunking.number_chunks(chunking.extract_passages(samples), size=3, overlap=1)
    for r in out.collect():
        got.setdefault(r["subset"], {})[int(r["chunk_id"].split("_chunk_")[1])] = (r["chunk_id"].split("_")[0], r["chunk_index"], r["text"])
    want = {}
    for sid, _, subset, (original, knowledge) in rows:
        texts = [p for p in original if p and p.strip()] + ([knowledge] if knowledge.strip() else [])
        for text in texts:
            for i, piece in enumerate(windows(text, 3, 1)):
                numbered = want.setdefault(subset, {})
                numbered[len(numbered)] = (sid, i, piece)
    assert got == want


CASES = [
    ("q", None, "pass1_baseline", ["user"], None), ("q", ["c1", "c2"], "pass1_baseline", ["user"], None),
    ("q", ["c1", "c2"], "pass2_loose", ["user"], None), ("q", ["c1"], "pass3_strict", ["system", "user"], None),
    ("q", None, "pass2_loose", None, "missing_context"), ("q", [], "pass3_strict", None, "missing_context"),
    ("q", ["c"], "pass4", None, "unknown_pass"), ("q", ["c"], "", None, "unknown_pass"),
    ("{context}", ["{query}"], "pass2_loose", ["user"], None),
]


def test_messages(spark):
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CASES)], "i int, query string, context_chunks array<string>, pass string")
    rows = prompts.build_messages(df).orderBy("i").collect()
    for r, (q, ctx, name, roles, reason) in zip(rows, CASES):
        assert r["reject_reason"] == reason
        assert (r["messages"] and [m["role"] for m in r["messages"]]) == roles
    assert rows[0]["messages"][0]["content"] == "q" == rows[1]["messages"][0]["content"]
    assert "c1\n\nc2" in rows[2]["messages"][0]["content"]
    assert rows[3]["messages"][0]["content"].startswith("Answer using ONLY")
    assert "{query}" in rows[8]["messages"][0]["content"] and rows[8]["messages"][0]["content"].endswith("{context}\n")
    with pytest.raises(Exception, match="cannot build messages"):
        prompts.require_messages(prompts.build_messages(df)).collect()


def test_transcripts_are_paged(spark):
    df = spark.createDataFrame([(1, t, "user", f"t{t}") for t in range(10)], "c int, t int, r string, x string")
    pages = prompts.transcript_messages(df, "c", "t", "r", "x", page=4).orderBy("page").collect()
    assert [[m["content"] for m in p["messages"]] for p in pages] == [["t0", "t1", "t2", "t3"], ["t4", "t5", "t6", "t7"], ["t8", "t9"]]


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(6, 8))
    x = np.concatenate([c + 0.2 * rng.normal(size=(50, 8)) for c in centers])
    x[7] = x[8]  # a tie
    rows = [(int(i), int(i % 3), [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "id int, part int, embedding array<float>").cache(), np.array([r[2] for r in rows], dtype=np.float32).astype(float)


@pytest.mark.parametrize("by, metric, cells, block_rows", [
    ([], "cosine", None, 1 << 14), ([], "cosine", 9, 1 << 14), (["part"], "cosine", 9, 1 << 14), ([], "l2", 9, 1 << 14), ([], "cosine", 5, 20),
])
def test_vector_search_is_exact(spark, clustered, by, metric, cells, block_rows):
    df, x = clustered
    queries = df.withColumnRenamed("id", "query_id")
    found = vectors.topk_vectors(queries, df.withColumnRenamed("id", "chunk_id"), 4, by, metric=metric, cells=cells, block_rows=block_rows)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(len(x)):
        s = unit @ unit[i] if metric == "cosine" else -((x - x[i]) ** 2).sum(axis=1)
        pool = [j for j in range(len(x)) if not by or j % 3 == i % 3]
        assert got[i] == sorted(pool, key=lambda j: (-round(s[j], 9), j))[:4]


def test_probing_few_cells_reports_recall(spark, clustered):
    df, _ = clustered
    q, c = df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "chunk_id")
    recall = vectors.recall_at_k(vectors.topk_vectors(q, c, 4), vectors.topk_vectors(q, c, 4, cells=12, nprobe=3), "query_id", "chunk_id")
    mean = recall.agg(F.avg("recall")).first()[0]
    assert 0.6 < mean <= 1.0


def corpus(n=120):
    rng = np.random.default_rng(11)
    vocab = ["the", "of", "and"] + [f"word{i}" for i in range(60)]
    p = np.array([30, 20, 15] + [1.0] * 60)
    texts = [" ".join(rng.choice(vocab, size=rng.integers(5, 40), p=p / p.sum())) for _ in range(n)]
    queries = [" ".join(rng.choice(vocab, size=6, p=p / p.sum())) for _ in range(15)] + ["the of", "nothing matches"]
    return texts, queries


@pytest.mark.parametrize("seed_rows, rest_share", [(1, 1.0), (2000, 0.5), (5, 0.8)])
def test_bm25_is_exact(spark, seed_rows, rest_share):
    texts, queries = corpus()
    bags = [Counter(re.findall(r"\w+", t)) for t in texts]
    size = [sum(b.values()) for b in bags]
    mean, df = sum(size) / len(size), Counter(t for b in bags for t in b)
    idf = {t: math.log(1 + (len(texts) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    q = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    c = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, text string")
    got = {}
    for r in lexical.bm25_topk(q, c, 3, seed_rows=seed_rows, rest_share=rest_share).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], r["score"]))
    for i, text in enumerate(queries):
        score = {}
        for j, b in enumerate(bags):
            s = sum(idf[t] * b[t] * 2.2 / (b[t] + 1.2 * (0.25 + 0.75 * size[j] / mean)) for t in set(text.split()) if b[t])
            if s > 0:
                score[j] = round(s, 9)
        want = sorted(score.items(), key=lambda e: (-e[1], e[0]))[:3]
        assert [j for j, _ in got.get(i, [])] == [j for j, _ in want]
        assert [s for _, s in got.get(i, [])] == pytest.approx([s for _, s in want], abs=1e-8)


@pytest.mark.parametrize("coverage", [50, 80, 100])
def test_entailed_claims(spark, coverage):
    texts, queries = corpus()
    found = lexical.entailed_claims(
        spark.createDataFrame(list(enumerate(queries)), "claim_id int, claim string"),
        spark.createDataFrame(list(enumerate(texts)), "text_id int, text string"), coverage)
    want = set()
    for i, q in enumerate(queries):
        for j, t in enumerate(texts):
            need = set(q.split())
            if len(need & set(t.split())) * 100 >= len(need) * coverage:
                want.add((i, j))
    assert {(r["claim_id"], r["text_id"]) for r in found.collect()} == want


def test_claim_scores(spark):
    rows = [
        (0, "Paris is big. Rome is old. Cats fly.", "Paris is big. Berlin is cold.", ["Paris is big", "Cats fly high", "unrelated"]),
        (1, "", "a b.", []), (2, None, None, None), (3, "x y. z w.", "x y. z w.", ["x y z w"]),
    ]
    df = spark.createDataFrame(rows, "id int, response string, ground_truth string, context_chunks array<string>")
    got = {r["id"]: r for r in claims.claim_metrics(df, ["id"], coverage=100).collect()}
    third = pytest.approx(1 / 3)
    first = got[0]
    assert (first["overall_precision"], first["overall_recall"], first["claim_recall"]) == (third, 0.5, 0.5)
    assert (first["context_precision"], first["context_utilization"], first["faithfulness"]) == (third, 1.0, pytest.approx(2 / 3))
    assert (first["hallucination"], first["noise_sensitivity_irrelevant"], first["self_knowledge"]) == (third, third, 0.0)
    assert got[3]["overall_f1"] == got[3]["faithfulness"] == got[3]["context_utilization"] == 1.0
    for r in got.values():
        parts = r["noise_sensitivity_relevant"] + r["noise_sensitivity_irrelevant"] + r["hallucination"]
        if r["id"] in (0, 3):
            assert parts == pytest.approx(1 - r["overall_precision"])
    assert all(v == 0.0 for k, v in got[2].asDict().items() if k != "id")


def test_context_is_ordered_by_rank(spark):
    from ragscale.operators import context
    found = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (2, "c", 1)], "query_id int, chunk_id string, rank int")
    chunks = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C"), ("d", "D")], "chunk_id string, text string")
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    got = {r[0]: r[1] for r in context.with_context(queries, context.gather_context(found, chunks)).collect()}
    assert got == {1: ["B", "A"], 2: ["C"], 3: None}


def test_null_samples_keep_their_chunks(spark):
    from ragscale.operators import chunking
    rows = [("d", "s", None, 0, "a b"), ("d", "s", "x", 0, "c"), ("d", None, "y", 0, "e f")]
    df = spark.createDataFrame(rows, "dataset string, subset string, sample_id string, passage int, text string")
    got = {(r["text"], r["chunk_id"]) for r in chunking.number_chunks(df).collect()}
    assert got == {("a b", "d_s_chunk_0"), ("c", "x_chunk_1"), ("e f", "y_chunk_0")}
    named = chunking.sample_ids(df, ["text"]).collect()
    assert all(r["sample_id"] for r in named) and sum(r["sample_id"].startswith("d_s_") for r in named) == 1


def test_missing_vectors_match_nothing(spark):
    from ragscale.operators import vectors
    chunks = spark.createDataFrame([(i, [float(i), 1.0] if i % 2 else None) for i in range(8)], "chunk_id int, embedding array<double>")
    queries = spark.createDataFrame([(0, [3.0, 1.0]), (1, None)], "query_id int, embedding array<double>")
    got = vectors.topk_vectors(queries, chunks, k=2, metric="l2").collect()
    assert [(r["query_id"], r["chunk_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 3), (0, 1)]
    bad = chunks.where("embedding is not null").union(spark.createDataFrame([(99, [1.0])], chunks.schema))
    with pytest.raises(Exception, match="same length"):
        vectors.topk_vectors(queries, bad, k=2).collect()


def test_collection_names_with_signs(spark):
    from ragscale.operators import collections
    names = spark.createDataFrame([("core",)], "name string")
    catalog = spark.createDataFrame([("it's.core+v(1)",)], "actual string")
    assert collections.resolve_collections(names, catalog, "it's.", "+v(").first()["actual"] == "it's.core+v(1)"
