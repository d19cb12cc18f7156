"""Stored records: the same answers as the plain forms, and no shuffle of the record side."""

import random
import re

import pytest

from ragscale.operators import aggregate, incremental
from ragscale.schemas import CONFIG_KEY, PAIR_KEY
from ragscale.sources import store

SCHEMA = "model string, quantization string, dataset string, subset string, pass string, query_id string, event_id bigint, cu double"


def rows(n=600, seed=1):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", None]), rng.choice(["Q4", None]), "d", rng.choice(["s", ""]), rng.choice(["pass2", "pass3", "pass1", None]),
             rng.choice([f"q{i}" for i in range(12)] + [None, "", " "]), i, rng.choice([None, rng.random()])) for i in range(n)]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    df = spark.createDataFrame(rows(), SCHEMA)
    return df, store.store_records(df, "records_of_a_test", str(tmp_path_factory.mktemp("store") / "t"), buckets=4)


def same(a, b):
    key = lambda r: [(x is None, str(x)) for x in r]
    assert sorted(map(tuple, a.collect()), key=key) == sorted(map(tuple, b.select(*a.columns).collect()), key=key) != []


def exchanges(df, table):
    """Shuffles between the scan of the table and the top of the plan."""
    plan = df._jdf.queryExecution().optimizedPlan() and df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if "Scan parquet" in line and table in line)
    depth, found = len(re.match(r"[^A-Za-z]*", lines[at]).group()), 0
    for line in reversed(lines[:at]):
        here = len(re.match(r"[^A-Za-z*(]*", line).group())
        if here < depth:
            depth, found = here, found + ("Exchange" in line)
    return found


def test_last_wins_and_pairs_in_place(stored):
    df, kept = stored
    key = [*CONFIG_KEY, "query_id"]
    last = store.last_stored(kept, key, "event_id")
    same(last, incremental.last_wins(df, key, "event_id"))
    pairs = store.stored_pairs(kept, "event_id", "pass2", "pass3")
    same(pairs.drop("preference_gap"), aggregate.paired_passes(df, "event_id"))
    assert exchanges(last, "records_of_a_test") == exchanges(pairs, "records_of_a_test") == 0
    assert exchanges(kept.groupBy("model").count(), "records_of_a_test") == 1  # what a shuffle would look like


def test_resuming_shuffles_the_plan_only(spark, stored):
    df, kept = stored
    todo = df.select(*CONFIG_KEY, "query_id").distinct().unionByName(spark.createDataFrame([("a", "Q4", "d", "s", "pass9", "q1"), ("z", "Q4", "d", "s", "pass2", "q1")], ", ".join(SCHEMA.split(", ")[:6])))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = store.remaining_of_store(todo, kept)
        same(left, incremental.remaining_work(todo, df, CONFIG_KEY))
        assert exchanges(left, "records_of_a_test") == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_store_opens_again_and_grows(spark, tmp_path):
    path, df = str(tmp_path / "t"), spark.createDataFrame(rows(50), SCHEMA)
    store.store_records(df, "grows", path, buckets=4)
    spark.sql("drop table grows")  # an external table: the files stay
    again = store.open_store(spark, "grows", path, buckets=4)
    assert again.count() == 50 and exchanges(store.last_stored(again, [*PAIR_KEY, "query_id"], "event_id"), "grows") == 0
    store.store_records(df.limit(5), "grows", path, buckets=4, mode="append")
    spark.catalog.refreshTable("grows")
    assert store.open_store(spark, "grows", path, buckets=4).count() == 55
