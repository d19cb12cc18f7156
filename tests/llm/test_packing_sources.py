import pytest
from test_packing import SCHEMA, VOCABULARY

from ragscale.llm.packing import pack


@pytest.mark.parametrize("weights", [None, {f"s{i}": 1 + i % 3 for i in range(25)}])
def test_more_sources_than_queues_give_the_same_windows(spark, weights):
    """Every source keeps its proportion, however many there are."""
    rows = [(i, "word " * (20 + i * 37 % 400), f"s{i * i % 37}", 0, "q", 1, "x") for i in range(150)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id")
    few, many = (sorted(map(tuple, pack(docs, VOCABULARY, weights=weights, length=256, cell=16, most_queues=q).collect())) for q in (256, 4))
    assert few == many and len({r[-2] for r in few}) > 50
