"""Written intermediates: pinned, discarded, and without a trace in the session's settings."""

import os

import pytest
from pyspark.sql import functions as F

from ragscale.session import _CLEANUP, _PATH, discard, materialize


def test_a_written_table_is_pinned_and_can_be_discarded(spark):
    before = spark.conf.get(_CLEANUP, None)
    df = spark.range(1000).withColumn("x", F.rand()).repartition(5, "id")
    kept = materialize(df, "pinned")
    first = {r.id: r.x for r in kept.collect()}
    assert {r.id: r.x for r in kept.collect()} == first and len(first) == 1000
    assert spark.conf.get(_CLEANUP, None) == before
    path = getattr(kept, _PATH).removeprefix("file:")
    assert os.path.isdir(path)
    discard(kept)
    assert not os.path.exists(path)


def test_a_write_that_fails_leaves_the_setting_alone(spark):
    before = spark.conf.get(_CLEANUP, None)
    with pytest.raises(Exception):
        materialize(spark.range(3).select(F.raise_error(F.lit("no")).alias("x")), "fails")
    assert spark.conf.get(_CLEANUP, None) == before
