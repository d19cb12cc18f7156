import random
import tracemalloc

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from ragscale.llm import fertility
from ragscale.llm.arrays import row_pieces
from ragscale.llm.queries import vocabulary
from ragscale.llm.word_tokens import WordTokenizer


def some_texts(n_bytes, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijü<#", k=rng.randint(1, 9))) for _ in range(3000)]
    texts = []
    while n_bytes > 0:
        texts.append(rng.choice([" ", "\n"]).join(rng.choices(words, k=rng.choice([5, 300, 900]))))
        n_bytes -= len(texts[-1].encode())
    return texts + [None, "", "中文 " * 60, "one line here\n" * 40]


@pytest.fixture(scope="module")
def first():
    return fertility.Vocabulary(vocabulary("piece_bpe_32k.model"))


def test_counts_of_a_slice_need_bounded_memory(first):
    column = pa.array(some_texts(4 << 20), pa.string())
    fertility.measure(column.slice(0, 10), first)
    tracemalloc.start()
    fertility.measure(column, first)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * (4 << 20), peak / 1e6  # counted all at once it was over 45 bytes for each byte of text


def test_pieces_of_a_slice_change_nothing(first, monkeypatch):
    column = pa.array(some_texts(1 << 16), pa.string())
    second = WordTokenizer(vocabulary("word_bpe_49k.json"))
    got = []
    for size in (1, 4096, 1 << 30):
        monkeypatch.setattr(fertility, "PIECE_BYTES", size)
        got.append(fertility.measure(column, first, second=second))
    assert got[0] == got[1] == got[2] and len(got[0]) == len(fertility.MEASURES) + 1
    assert all(len(c) == len(column) for c in got[0]) and fertility.measure(column.slice(0, 0), first)[0].to_pylist() == []


def test_row_pieces():
    assert list(row_pieces(np.array([0, 2, 4, 9, 9, 10]), 4)) == [(0, 2), (2, 3), (3, 5)]
    assert list(row_pieces(np.array([0]), 4)) == []


def test_transitions_of_a_worker_are_bounded():
    few = WordTokenizer(vocabulary("word_bpe_49k.json"), 1 << 18)
    many = WordTokenizer(vocabulary("word_bpe_49k.json"))
    rng = random.Random(5)
    for _ in range(6):
        column = pa.array(["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 12))) for _ in range(4000)])
        a, b = few.ids(column), many.ids(column)
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all()
    assert few.lanes.next.size < many.lanes.next.size / 2


def test_pipeline_bounds_its_vocabularies(spark, monkeypatch):
    """All stages that tokenize keep fewer transitions than an operator by itself, whatever the number of documents."""
    asked = []
    monkeypatch.setattr(corpus_pipeline, "learned_rules", lambda docs, *a: asked.append(a[-2:]) or docs.selectExpr("*", "true as kept"))
    monkeypatch.setattr(corpus_pipeline, "pack", lambda docs, *a, **b: asked.append((b["slice_bytes"], b["max_cells"])) or docs)
    docs = spark.createDataFrame([(1, "a", "en", "s")], "doc_id bigint, text string, lang string, source string")
    stages = dict(corpus_pipeline.STAGES)
    stages["quality rules"](spark, docs, "")
    stages["packing"](spark, docs, "")
    assert all(slice_bytes <= 1 << 20 and cells <= 8 << 20 for slice_bytes, cells in asked) and len(asked) == 2


def test_transitions_are_kept_in_the_room_of_few_cells():
    """Words of many letters: what was learned for them is not forgotten, though the cells of all states and letters would be too many."""
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyzéèüößñóáíêàçâîôûäëï"
    words = pa.array(["".join(rng.choices(letters, k=rng.randint(4, 12))) for _ in range(5500)])
    few, many = (WordTokenizer(vocabulary("word_bpe_49k.json"), cells) for cells in (1 << 20, 1 << 26))
    learned, plain = [], few.bpe.advance
    few.bpe.advance = lambda *a: learned.append(a) or plain(*a)
    first = few.ids(words)
    assert all((x == y).all() for x, y in zip(first, many.ids(words)))
    once = len(learned)
    assert few.bpe.size() * 91 > 1 << 20  # cells of an array with a column for each symbol
    assert all((x == y).all() for x, y in zip(first, few.ids(words))) and len(learned) == once
