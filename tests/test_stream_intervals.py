"""Intervals on a stream equal the bootstrap over all records, however the records arrive."""

import random

import pytest

from ragscale.operators.bootstrap import poisson_ci
from ragscale.streaming.intervals import drain_intervals, running_sums

KEYS = ["model", "quantization"]
SCHEMA = "model string, quantization string, query_id string, run_id string, ts timestamp, cu double, sk double"


def rows(n=240, seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        model, quantization = rng.choice([("a", "Q4"), ("a", None), ("b", "Q8"), ("b", "Q8"), (None, "Q4")])
        out.append((model, quantization, f"q{i // 2}", f"r{i % 2}", f"2024-01-01 00:{i // 60:02}:{i % 60:02}", rng.random(), rng.choice([None, rng.random()])))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "model string, quantization string, query_id string, run_id string, ts string, cu double, sk double").selectExpr(
        "model", "quantization", "query_id", "run_id", "cast(ts as timestamp) as ts", "cu", "sk")


def table(df):
    return {(r.model, r.quantization, r.metric): (r.n, r.mean, r.ci_lo, r.ci_hi, r["std"]) for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys() and len(got) > 0
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9)


@pytest.mark.parametrize("late", [None, "2 hours"])
def test_split_repeated_and_late_batches_give_the_batch_intervals(spark, tmp_path, late):
    data = rows()
    source, path = str(tmp_path / "in"), str(tmp_path / "work")
    batch = poisson_ci(frame(spark, data), KEYS, ["cu", "sk"], ["query_id", "run_id"], n_resamples=200)
    order = data[:]
    random.Random(5).shuffle(order)

    def drained():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(source)
        states = running_sums(stream, ["query_id", "run_id"], KEYS, ["cu", "sk"], late_after=late, event_time="ts", n_resamples=200)
        return drain_intervals(states, frame(spark, data[:1]), KEYS, ["cu", "sk"], path=path)

    for part in (order[:100], order[60:130], order[:20] + order[130:200]):  # repeated ones among them
        frame(spark, part).coalesce(1).write.mode("append").parquet(source)
    some = table(drained())
    same(some, table(poisson_ci(frame(spark, order[:200]), KEYS, ["cu", "sk"], ["query_id", "run_id"], n_resamples=200)))
    frame(spark, order[190:]).coalesce(1).write.mode("append").parquet(source)  # after a restart
    same(table(drained()), table(batch))


def test_a_state_that_expired_is_added_to_what_comes_later(spark, tmp_path):
    early = [("a", "Q4", f"q{i}", "r", f"2024-01-01 00:00:{i:02}", i / 50, 0.5) for i in range(50)]
    other = [("b", "Q4", f"q{i}", "r", f"2024-01-02 00:00:{i:02}", i / 50, 0.5) for i in range(5)]
    back = [("a", "Q4", f"p{i}", "r", f"2024-01-03 00:00:{i:02}", i / 70, 0.5) for i in range(50)]
    for i, part in enumerate((early, other, other[:1], back)):
        frame(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"part{i}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    states = running_sums(stream, ["query_id"], KEYS, ["cu"], late_after="10 minutes", event_time="ts", idle_ms=3_600_000, n_resamples=100, salts=2)
    got = drain_intervals(states, frame(spark, early[:1]), KEYS, ["cu"], path=str(tmp_path / "work"))
    same(table(got), table(poisson_ci(frame(spark, early + other + back), KEYS, ["cu"], ["query_id"], n_resamples=100)))
    epochs = spark.read.parquet(str(tmp_path / "work" / "states")).where("_group like '%\"a\"%'").select("_salt", "epoch").distinct().count()
    assert epochs == 4  # two salts, each with a state before and one after


def test_nothing_arrives(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    got = drain_intervals(running_sums(stream, ["query_id"], KEYS, ["cu"]), frame(spark, rows(1)), KEYS, ["cu"])
    assert got.count() == 0 and got.columns == ["model", "quantization", "n", "metric", "mean", "ci_lo", "ci_hi", "std"]
