"""Every registered query against its SQL equivalent on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracles import compare, connect  # noqa: E402

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


MAY_BE_EMPTY: set[str] = set()  # queries whose right answer on the smallest tables has no rows


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, sf_dir, name):
    ok, note = compare(spark, con, sf_dir, QUERIES[name], SQL.get(name))
    assert ok or (name in MAY_BE_EMPTY and note.endswith("EMPTY")), note


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.limit(1).count() == 1
    assert {"metric", "mean", "ci_lo", "ci_hi", "std"} <= set(df.columns)
