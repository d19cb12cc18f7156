from ragscale.operators import incremental


def test_many_configurations_are_planned_in_blocks(spark):
    queries = spark.createDataFrame([(f"q{i}", "s" if i % 2 else None) for i in range(9)], "query_id string, subset string")
    configs = spark.createDataFrame([(f"m{i}", None if i % 3 else "Q4") for i in range(25)], "model string, quantization string").repartition(3)
    policy = spark.createDataFrame([("s", ["p1", "p2"])], "subset string, passes array<string>")
    whole, parts = (sorted(map(str, incremental.experiment_grid(queries, configs, policy, ["p1"], block_rows=n).collect())) for n in (100, 4))
    assert whole == parts and len(parts) == 25 * (4 * 2 + 5)
