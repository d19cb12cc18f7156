"""Few queries against many texts: texts and postings stay where they are."""

from ragscale.operators import alignment, context, word_index


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def texts(spark):
    return spark.createDataFrame([(f"t{i}", f"word{i} one two three") for i in range(50)], "text_id string, text string").repartition(3)


def test_texts_of_few_pairs_are_not_shuffled(spark):
    pairs = spark.createDataFrame([(1, "t3"), (1, "t4"), (2, "t9")], "claim_id int, text_id string")
    claims = spark.createDataFrame([(1, "word3 one two"), (2, "word9 three")], "claim_id int, claim string")
    found = alignment.aligned_claims(pairs, claims, texts(spark), coverage=60)
    assert "SortMergeJoin" not in plan(found) and "BroadcastHashJoin" in plan(found)
    assert {(r.claim_id, r.text_id): r.n_matched for r in found.collect()} == {(1, "t3"): 3, (1, "t4"): 2, (2, "t9"): 1}


def test_contexts_of_few_queries_shuffle_no_text(spark):
    found = spark.createDataFrame([(1, "t3", 2), (1, "t4", 1)], "query_id int, chunk_id string, rank int")
    got = context.gather_context(found, texts(spark).withColumnRenamed("text_id", "chunk_id"))
    assert "SortMergeJoin" not in plan(got)
    assert [r.context_chunks for r in got.collect()] == [["word4 one two three", "word3 one two three"]]


def test_bounds_of_few_queries_are_summed_where_their_range_is(spark, tmp_path, monkeypatch):
    """Before, every token of a query sent its own row for every range."""
    chunks = spark.createDataFrame([(f"c{i:04}", f"one two three word{i}") for i in range(200)], "chunk_id string, text string")
    word_index.build_words(chunks, str(tmp_path / "i"))
    kept, plans = word_index.materialize, {}

    def written(df, name):
        plans[name] = plan(df)
        return kept(df, name)

    monkeypatch.setattr(word_index, "materialize", written)
    queries = spark.createDataFrame([(1, "one two word7"), (2, "three word9")], "query_id int, query string")
    got = word_index.search_words(queries, str(tmp_path / "i"), k=1).collect()
    assert {(r.query_id, r.chunk_id) for r in got} == {(1, "c0007"), (2, "c0009")}
    assert plans["bounds"].count("Exchange hashpartitioning") == 1
