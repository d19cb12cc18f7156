"""Agreement, sampling, scans, contract, resume, resolution and skew handling."""

import json

import pytest
from pyspark.sql import functions as F

from ragscale.functions.scoring import discretize_closed, discretize_open
from ragscale.operators import agreement, collections, curves, incremental, quality, sampling, skew
from ragscale.schemas import NORMALIZED_SAMPLE, RAW_RECORD
from ragscale.sources import jsonl, registry


def cells(spark, pairs):
    df = spark.createDataFrame(pairs, "a int, b int").withColumn("metric", F.lit("m"))
    return df.groupBy("metric", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def test_kappas(spark):
    kappa = lambda p, **k: agreement.cohens_kappa(cells(spark, p), ["metric"], **k).first()["kappa"]
    linear = lambda p, **k: agreement.linear_kappa(cells(spark, p), ["metric"], **k).first()["kappa"]
    same = [(0, 0), (1, 1), (2, 2), (1, 1)]
    assert kappa(same) == linear(same) == 1.0
    assert kappa([(1, 1)] * 5) == linear([(1, 1)] * 5) == 1.0
    mixed = [(0, 0)] * 20 + [(0, 1)] * 5 + [(1, 0)] * 10 + [(1, 1)] * 15
    assert kappa(mixed) == pytest.approx(0.4, abs=1e-4)
    assert linear(mixed) == pytest.approx(kappa(mixed), abs=1e-3)
    far = [(0, 0)] * 10 + [(0, 5)] * 10 + [(5, 0)] * 10 + [(5, 5)] * 10  # labels are what the raters gave, not a range
    assert kappa(far) == linear(far) == 0.0
    assert kappa(far + [(None, None)] * 10) > 0
    three = [(0, 0)] * 6 + [(1, 2)] * 3 + [(7, 1)] * 2 + [(2, 2)] * 4 + [(7, 7)]
    labels = sorted({v for p in three for v in p})
    share = lambda i, v: sum(p[i] == v for p in three) / len(three)
    chance = sum(share(0, a) * share(1, b) * abs(a - b) for a in labels for b in labels)
    assert linear(three) == pytest.approx(1 - sum(abs(a - b) for a, b in three) / len(three) / chance, abs=1e-3)
    grid = agreement.confusion_matrix(cells(spark, three), ["metric"]).collect()
    assert len(grid) == 16 and sum(r["n"] for r in grid) == len(three)
    assert agreement.cohens_kappa(cells(spark, mixed).where("false"), []).first()["kappa"] == 0.0
    assert agreement.linear_kappa(cells(spark, mixed).where("false"), []).first()["kappa"] == 0.0
    assert agreement.raw_agreement(cells(spark, mixed), ["metric"]).first()["raw_agreement"] == "35/50"
    assert agreement.confusion_matrix(cells(spark, mixed), ["metric"]).count() == 4


def test_bin_edges(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.33, 0.34, 0.66, 0.67, 1.0, None)], "v double")
    rows = df.select(discretize_closed(F.col("v")).alias("c"), discretize_open(F.col("v")).alias("o")).collect()
    assert [r["c"] for r in rows] == [0, 0, 1, 1, 2, 2, None]
    assert [r["o"] for r in rows] == [0, 1, 1, 1, 2, 2, None]


def test_stratified_sample_is_exact_and_stable(spark):
    df = spark.range(5000).withColumn("s", F.when(F.col("id") < 4500, "hot").when(F.col("id") < 4990, "warm").otherwise("rare"))
    take = lambda d: {(r["s"], r["id"]) for r in sampling.stratified_sample(d, "s", {"hot": 1200, "rare": 50}, ["id"]).collect()}
    got = take(df)
    assert sum(s == "hot" for s, _ in got) == 1200 and sum(s == "rare" for s, _ in got) == 10
    assert got == take(df.repartition(13))


def line(**changes):
    record = {
        "run_id": "r", "timestamp": "2025-01-02T03:04:05Z", "model": "m", "quantization": "Q4_K_M", "source": "local",
        "provider": None, "dataset": "d", "subset": "s", "pass": "pass2_loose", "seed": 42, "query_id": "q", "query": "?",
        "context_chunks": ["a"], "ground_truth": "g", "response": "r", "generation_time_ms": 870, "extra": 1,
        "scores": {"ragchecker": {k: 0.5 for k in [
            "overall_precision", "overall_recall", "overall_f1", "claim_recall", "context_precision", "context_utilization",
            "self_knowledge", "noise_sensitivity_relevant", "noise_sensitivity_irrelevant", "hallucination", "faithfulness"]}},
    }
    record.update(changes)
    return json.dumps({k: v for k, v in record.items() if v != "DROP"})


def test_contract(spark):
    scores = json.loads(line())["scores"]["ragchecker"]
    less = {k: v for k, v in scores.items() if k != "context_utilization"}
    cases = [
        (line(), []), (line(context_chunks=None), []), (line(source="api", provider="openai", quantization="API"), []),
        (line(generation_time_ms=1.5), []), (line(run_id="DROP"), ["missing:run_id"]), (line(scores="DROP"), ["missing:scores"]),
        (line(run_id="DROP", timestamp="DROP", model="DROP"), ["missing:run_id", "missing:timestamp", "missing:model"]),
        (line(seed="one"), ["type:seed"]), (line(generation_time_ms="slow"), ["type:generation_time_ms"]),
        (line(scores="no"), ["type:scores"]), (line(context_chunks="no"), ["type:context_chunks"]),
        (line(scores={"ragchecker": less}), ["missing:scores.context_utilization"]), (line(source="edge"), ["value:source"]),
        (line(**{"pass": "pass9"}), ["value:pass"]), (line(provider="acme"), ["value:provider"]), ("{oops", ["malformed"]),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, line string")
    rows = quality.raw_violations(df).orderBy("i").collect()
    assert [r["violations"] for r in rows] == [c[1] for c in cases]


def test_scans(spark, tmp_path):
    good, bad = line(), "{oops"
    (tmp_path / "a.jsonl").write_text(f"{good}\n\n   \n{bad}\n{good}\n")
    (tmp_path / "skip.txt").write_text("not a record\n")
    kept, rejected = jsonl.split_tolerant(jsonl.scan_tolerant(spark, str(tmp_path), RAW_RECORD))
    assert kept.count() == 2 and [r[0] for r in rejected.collect()] == [bad]
    with pytest.raises(Exception):
        jsonl.scan_jsonl(spark, str(tmp_path), RAW_RECORD).collect()


def test_named_files_are_pruned(spark, tmp_path):
    for dataset, subset in (("rgb", "noise"), ("rgb", "other"), ("nq", "noise")):
        d = tmp_path / dataset / "normalized"
        d.mkdir(parents=True, exist_ok=True)
        (d / f"{subset}.jsonl").write_text(json.dumps({"sample_id": f"{dataset}-{subset}"}) + "\n")
    df = jsonl.scan_named_files(spark, str(tmp_path), NORMALIZED_SAMPLE, "noise")
    assert sorted((r["dataset"], r["subset"], r["sample_id"]) for r in df.collect()) == [
        ("nq", "noise", "nq-noise"), ("rgb", "noise", "rgb-noise")]


def test_partition_pruning_reaches_the_scan(spark, tmp_path):
    df = spark.createDataFrame([("d", s, str(i)) for i, s in enumerate("abab")], "dataset string, subset string, query_id string")
    jsonl.write_jsonl(df, str(tmp_path / "x"), "append", ["dataset", "subset"])
    scan = jsonl.scan_partitioned(spark, str(tmp_path / "x"), NORMALIZED_SAMPLE, "d", "a")
    assert scan.count() == 2 and len(scan.inputFiles()) >= 1
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "(subset" in plan


def test_registry(spark, tmp_path):
    path = tmp_path / "models.json"
    path.write_text(json.dumps({"m1": {"display_name": "M", "params": "1B", "role": "primary", "quants": {"Q8_0": "a", "FP16": "b"}}}))
    rows = registry.model_dim(registry.read_registry(spark, str(path))).collect()
    assert {(r["quantization"], r["file"], r["quant_list"], r["role"]) for r in rows} == {
        ("Q8_0", "a", "FP16, Q8_0", "primary"), ("FP16", "b", "FP16, Q8_0", "primary")}


def test_resume_twice_leaves_nothing(spark):
    key = ["model"]
    todo = spark.createDataFrame([("m", "1"), ("m", "2"), ("n", "1"), ("m", "")], "model string, query_id string")
    done = spark.createDataFrame([("m", "1"), ("m", "")], "model string, query_id string")
    left = incremental.remaining_work(todo, done, key)
    assert {tuple(r) for r in left.collect()} == {("m", "2"), ("n", "1"), ("m", "")}
    finished = done.unionByName(left.where("query_id <> ''"))
    assert incremental.remaining_work(todo.where("query_id <> ''"), finished, key).count() == 0


def test_collection_plan(spark):
    found = spark.createDataFrame([("a", 3), ("a", 0), ("b", 0), ("c", 2)], "c string, n_chunks bigint")
    have = spark.createDataFrame([("c",)], "c string")
    plan = lambda force: {r["c"]: r["action"] for r in incremental.collection_plan(found, have, ["c"], force).collect()}
    assert plan(False) == {"a": "build", "b": "skip_empty", "c": "skip_existing"}
    assert plan(True) == {"a": "build", "b": "skip_empty", "c": "rebuild"}


def test_resolution(spark):
    catalog = ["pre_rgb_noise_300w_ab12", "pre_nq_wiki_300w_cd", "pre_a_x_z", "pre_b_x_z", "plain", "odd_300w_x_300w_y"]
    wanted = {
        "plain": ("plain", "exact"), "rgb_noise": ("pre_rgb_noise_300w_ab12", "core"), "nq": ("pre_nq_wiki_300w_cd", "inner"),
        "x": (None, "ambiguous"), "a_x": ("pre_a_x_z", "inner"), "none": (None, "unknown"), "z": (None, "unknown"),
        "odd_300w_x": ("odd_300w_x_300w_y", "core"),
    }
    names = spark.createDataFrame([(n,) for n in wanted], "name string")
    cat = spark.createDataFrame([(c,) for c in catalog], "actual string")
    got = collections.resolve_collections(names, cat, prefix="pre_").collect()
    assert {r["name"]: (r["actual"], r["rule"]) for r in got} == wanted


def curve(spark, means, width=0.01):
    rows = [("m", q, v, v - width, v + width) for q, v in zip(["Q3_K_M", "Q4_K_M", "Q5_K_M", "Q6_K", "Q8_0", "FP16"], means)]
    return spark.createDataFrame(rows, "model string, quantization string, mean double, ci_lo double, ci_hi double")


@pytest.mark.parametrize("means, width, pattern", [
    ([0.6, 0.5, 0.4, 0.3, 0.2, 0.1], 0.01, "gullible"), ([0.1, 0.2, 0.3, 0.4, 0.5, 0.6], 0.01, "stubborn"),
    ([0.3, 0.5, 0.6, 0.5, 0.45, 0.4], 0.01, "inverted_u"), ([0.5, 0.51, 0.5, 0.49, 0.5, 0.5], 0.05, "resilient"),
    ([0.9, 0.2, 0.8, 0.1, 0.7, 0.5], 0.01, "indeterminate"),
])
def test_curve_patterns(spark, means, width, pattern):
    assert curves.curve_pattern(curve(spark, means, width), ["model"]).first()["pattern"] == pattern


def test_falsification_and_delta(spark):
    roles = spark.createDataFrame([("m", "primary")], "model string, role string")
    rising, falling = ([0.6, 0.5, 0.4, 0.3, 0.2, 0.1], [0.1, 0.2, 0.3, 0.4, 0.5, 0.6])
    refuted = lambda means: curves.falsification(curves.curve_pattern(curve(spark, means), ["model"]), roles).first()["refuted"]
    assert not refuted(rising) and refuted(falling)
    rows = {r["quantization"]: r for r in curves.baseline_delta(curve(spark, rising), ["model"]).collect()}
    assert rows["Q3_K_M"]["practical"] and not rows["FP16"]["practical"]
    assert curves.flag_width(curve(spark, rising, 0.2).withColumn("metric", F.lit("x"))).where("flagged").count() == 6


def test_determinism(spark):
    runs = [(q, s, "same" if q == "a" else f"r{s}") for q in "ab" for s in range(8)]
    df = spark.createDataFrame(runs, "query string, seed int, response string")
    rows = {r["query"]: r for r in quality.determinism_per_query(df).collect()}
    assert rows["a"]["n_unique_responses"] == 1 and rows["b"]["n_unique_responses"] == 8
    assert len(rows["b"]["unique_responses"]) == 5
    s = quality.determinism_summary(df).first()
    assert (s["deterministic"], s["n_seeds"], s["n_queries"], s["n_divergent_queries"]) == (False, 8, 2, 1)


def test_hot_keys_are_bounded_and_split(spark):
    df = spark.range(4000).withColumn("k", F.when(F.col("id") < 2500, 0).otherwise(F.col("id")))
    hot = skew.hot_keys(df, ["k"], block_rows=500)
    assert [r["k"] for r in hot.collect()] == [0]
    spread = skew.with_salt(df, ["k"], hot, "id")
    assert spread.count() == 4000
    assert spread.where("k = 0").select("_salt").distinct().count() == hot.first()["n_blocks"] >= 5
    assert spread.where("k <> 0").select("_salt").distinct().count() == 1


def test_null_keys_stay(spark):
    df = spark.createDataFrame([(None, "a", 1), ("x", None, 2), (None, None, 3)], "k string, query_id string, n int")
    assert incremental.remaining_work(df, df.where("n = 1"), ["k"]).count() == 2
    census = quality.error_census(df.withColumn("error", F.lit("timeout")), ["k"])
    assert {(r["k"], r["n_records"]) for r in census.collect()} == {(None, 2), ("x", 1)}
    assert skew.join_same(df, df.select("k", F.lit(1).alias("one")).distinct(), ["k"]).count() == 3


def test_grid_is_the_whole_product(spark):
    queries = spark.createDataFrame([(f"q{i}", "s" if i % 2 else None) for i in range(9)], "query_id string, subset string")
    configs = spark.createDataFrame([("m", "Q4"), ("m", None)], "model string, quantization string")
    policy = spark.createDataFrame([("s", ["p1", "p2"])], "subset string, passes array<string>")
    grid = incremental.experiment_grid(queries, configs, policy, ["p1"])
    assert grid.count() == 2 * (4 * 2 + 5) and grid.where("quantization is null").count() == 13


def points(spark, means, width=0.01, model="m"):
    rows = [(model, q, float(m), m - width, m + width) for q, m in zip(["Q3", "Q4", "FP16"], means)]
    return spark.createDataFrame(rows, "model string, quantization string, mean double, ci_lo double, ci_hi double")


@pytest.mark.parametrize("means, width, pattern", [
    ([0.5002, 0.5001, 0.5], 0.2, "resilient"), ([0.9, 0.7, 0.5], 0.01, "gullible"), ([0.1, 0.3, 0.5], 0.01, "stubborn"),
    ([0.3, 0.8, 0.5], 0.01, "inverted_u"), ([0.52, 0.51, 0.5], 0.004, "gullible"), ([0.9, 0.4, 0.5], 0.01, "indeterminate"),
])
def test_patterns_go_by_intervals(spark, means, width, pattern):
    found = curves.curve_pattern(points(spark, means, width), ["model"], ["Q3", "Q4", "FP16"]).first()
    assert found["pattern"] == pattern


def test_a_model_in_two_pairs(spark):
    df = points(spark, [1, 2, 3], model="a").union(points(spark, [2, 2, 2], model="b")).union(points(spark, [5, 5, 5], model="c"))
    assert curves.cross_pairs(df, [("a", "b"), ("a", "c"), ("b", "a")], ["quantization"]).count() == 9


def test_cells_of_a_report(spark):
    from ragscale.functions.scoring import interval_text
    df = spark.createDataFrame([(0.5, 0.25, 0.75), (0.5, float("nan"), float("nan")), (None, None, None)], "m double, a double, b double")
    assert [r[0] for r in df.select(interval_text(F.col("m"), F.col("a"), F.col("b"))).collect()] == ["0.500 [0.250, 0.750]", "0.500 [nan, nan]", "N/A"]


def test_csv_is_ordered_and_other_json_is_no_record(spark, tmp_path):
    df = spark.createDataFrame([(i % 3, f"k{i}") for i in range(30)], "g int, k string")
    jsonl.write_csv(df, str(tmp_path / "csv"), sort_by=["g", "k"])
    back = [tuple(r) for r in spark.read.option("header", "true").csv(str(tmp_path / "csv")).coalesce(1).collect()]
    assert sorted(back) == back and len(back) == 30
    jsonl.write_jsonl(df, str(tmp_path / "in"))
    (tmp_path / "in" / "manifest.json").write_text('{"g": 1, "k": "stray"}')
    assert jsonl.scan_jsonl(spark, str(tmp_path / "in"), df.schema).count() == 30


def test_drain_without_data(spark, tmp_path):
    from ragscale.streaming import ingest
    (tmp_path / "none").mkdir()
    schema = "model string, quantization string, dataset string, subset string, pass string, query_id string, cu double"
    stream = spark.readStream.schema(schema).json(str(tmp_path / "none"))
    assert ingest.drain(ingest.running_stats(stream, ["query_id"])).count() == 0


def test_streaming_equals_batch(spark, tmp_path):
    from ragscale.streaming import ingest
    rows = [("m", "q", "d", "s", "p", str(i), i / 100) for i in range(50)]
    schema = "model string, quantization string, dataset string, subset string, pass string, query_id string, cu double"
    df = spark.createDataFrame(rows, schema)
    for _ in range(2):  # everything is delivered twice
        df.write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).json(str(tmp_path / "in"))
    r = ingest.drain(ingest.running_stats(stream, ["query_id"])).first()
    assert r["n_queries"] == 50 and r["mean"] == pytest.approx(sum(i / 100 for i in range(50)) / 50)


def test_collections_are_built_once(spark, tmp_path):
    from ragscale.sources import collections as stored
    path, keys = str(tmp_path / "index"), ["dataset", "subset"]
    frame = lambda rows: spark.createDataFrame(rows, "chunk_id string, text string, dataset string, subset string")
    first = frame([("1", "a", "d", "x"), ("2", "b", "d", "007")])
    stored.build_collections(first, path, keys)
    more = frame([("1", "changed", "d", "x"), ("3", "c", "d", "y")])
    read = lambda: {(r["subset"], r["chunk_id"], r["text"]) for r in spark.read.schema(first.schema).parquet(path).collect()}
    stored.build_collections(more, path, keys)
    assert read() == {("x", "1", "a"), ("007", "2", "b"), ("y", "3", "c")}
    stored.build_collections(more, path, keys, force=True)
    assert read() == {("x", "1", "changed"), ("007", "2", "b"), ("y", "3", "c")}
    assert stored.read_collection(first.schema, spark, path, dataset="d", subset="y").count() == 1


def test_events_are_spread_by_their_number(spark):
    """Tasks hold a bounded number of rows; they held a core's share of all before."""
    from ragscale.operators.skew import spread_rows
    rows = spark.range(1000).toDF("id").coalesce(1)
    assert spread_rows(rows, "id", most=20).rdd.getNumPartitions() == 50
    assert spread_rows(rows.repartition(60), "id", most=20).rdd.getNumPartitions() == 60
    assert sorted(r.id for r in spread_rows(rows, "id", most=20).collect()) == list(range(1000))
