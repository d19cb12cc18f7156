import random
from fractions import Fraction
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ragscale.llm.packing import Layout, pack
from ragscale.llm.word_tokens import WordTokenizer

VOCABULARY = str(public_tokenizers.path("word_bpe_49k.json"))
SCHEMA = "doc_id bigint, text string, source string, n int, queue string, start int, ids string"


def make_docs(seed=5, n=160):
    rng = random.Random(seed)
    words = ["The", "quick", "brûlée", "Straße,", "it's", "42nd", "--", "ÉCOLE", "中文", "<|endoftext|>", "x" * 40, "Ünïcode…"]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 40, 300, 900]))), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(n)]
    return rows + [(500, None, "a"), (501, "", None), (501, "twice", "b"), (501, "twice", "b"), (None, "no id", "b"), (600, "long " * 9000, "c")]


def library_ids(rows):
    library = Tokenizer.from_file(VOCABULARY)
    return [library.encode(t or "", add_special_tokens=False).ids + [1] for _, t, _ in rows]


def test_words_encode_as_the_library_does():
    rng = random.Random(1)
    signs = list("aabcdeorstlmvd'''  \n\t\r.,!?0123éÉÈÖßÿ×÷中文字Ä ́​½²İΣς<|>") + ["'re", "'VE", "<|endoftext|>", "<|startoftext|>", "the", "Ing", "é"]
    texts = ["".join(rng.choices(signs, k=rng.choice([0, 1, 2, 5, 20, 100, 2000]))) for _ in range(400)] + [None, "a" * 3000]
    import pyarrow as pa

    ids, at = WordTokenizer(VOCABULARY).ids(pa.array(texts))
    want = library_ids([(0, t, 0) for t in texts])
    assert [ids[a:b].tolist() + [1] for a, b in zip(at[:-1], at[1:])] == want


@pytest.mark.parametrize("options", [{}, {"most_queues": 2}, {"weights": {"a": 1, "b": 2, None: 1}}, {"length": 64, "cell": 16}])
def test_every_id_lies_in_one_piece(spark, options):
    rows = make_docs()
    docs = spark.createDataFrame([(i, t, s, 0, "q", 1, "x") for i, t, s in rows], SCHEMA)
    got = pack(docs, VOCABULARY, with_ids=True, **options).collect()
    want = {}
    for (i, _, _), ids in zip(rows, library_ids(rows)):
        want.setdefault(i, []).append(ids)
    length = options.get("length", 2048)
    sequences, held = {}, {}
    for r in got:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        held.setdefault(r.doc_id, []).append(r)
        for ids in want[r.doc_id]:
            if len(ids) == r.doc_tokens and ids[r.start : r.start + r.length] == r.ids:
                break
        else:
            raise AssertionError(r)
    for i, all_ids in want.items():
        copies = len({tuple(x) for x in all_ids})
        if copies == 1:
            for start in {r.start for r in held[i]}:
                assert sum(r.start == start for r in held[i]) >= 1
        assert sum(r.length for r in held[i]) == sum(map(len, all_ids))
    sizes = []
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        sizes.append(at)
    assert all(s == length or s & (s - 1) == 0 for s in sizes) and max(sizes) <= length
    assert sorted(sequences) == list(range(len(sequences)))


def brute_ranks(sizes, weights, cell):
    cells = [((j + 0.5) / weights[q], q, j) for q in range(len(sizes)) for j in range(sizes[q] // cell)]
    return {(q, j): r for r, (_, q, j) in enumerate(sorted(cells))}


def test_layout_is_deficit_round_robin():
    rng = random.Random(2)
    for _ in range(30):
        queues = [(rng.choice([0, 5, 700, 4096, 20_000, rng.randint(0, 60_000)]), 0.0) for _ in range(rng.randint(1, 7))]
        queues = [(n, float(n) if rng.random() < 0.7 else rng.random() * 1e4 + 1) for n, _ in queues]
        layout = Layout(queues)
        want = brute_ranks(layout.sizes.tolist(), layout.weights.tolist(), layout.cell)
        q = np.array([k[0] for k in want], np.int64)
        j = np.array([k[1] for k in want], np.int64)
        assert layout.ranks(q, j).tolist() == list(want.values())


def served_by_deficit(sizes, weights, cell, per):
    """Queues served window by window: every slot each open queue earns its share of a cell, the queue that is owed most in units
    of its own weight is served one cell, and what it was owed or overpaid is carried on, also into the next window."""
    cells = [n // cell for n in sizes]
    taken, owed, windows = [0] * len(sizes), [Fraction(0)] * len(sizes), []
    weights = [Fraction(w) for w in weights]
    total = sum(weights)
    while any(t < c for t, c in zip(taken, cells)):
        window = []
        while len(window) < per and any(t < c for t, c in zip(taken, cells)):
            for q, w in enumerate(weights):
                owed[q] += w / total
            open_ = [q for q in range(len(cells)) if taken[q] < cells[q]]
            # Owed most for its weight: the half cell lets a queue be served in the middle of the stretch that a cell stands for.
            best = max(open_, key=lambda q: ((owed[q] - Fraction(1, 2)) / weights[q], -q))
            window.append((best, taken[best]))
            taken[best] += 1
            owed[best] -= 1
        windows.append(window)
    return windows, owed


def test_places_are_those_of_queues_that_carry_deficits():
    """The closed form against queues that are really served: the same cells in the same windows, deficits carried on."""
    rng = random.Random(6)
    for _ in range(25):
        sizes = [rng.randint(0, 9000) for _ in range(rng.randint(1, 6))]
        weights = [float(rng.randint(1, 40)) for _ in sizes]
        layout = Layout(list(zip(sizes, weights)))
        windows, _ = served_by_deficit(layout.sizes.tolist(), [w * layout.cell for w in layout.weights.tolist()], layout.cell, layout.per)
        flat = [c for w in windows for c in w]
        if not flat:
            continue
        q, j = np.array([a for a, _ in flat], np.int64), np.array([b for _, b in flat], np.int64)
        assert (layout.ranks(q, j) // layout.per).tolist() == [i for i, w in enumerate(windows) for _ in w]
        assert layout.ranks(q, j).tolist() == list(range(len(flat)))


def test_windows_keep_the_proportions():
    queues = [(1_000_000, 1e6), (500_000, 5e5), (250_000, 2.5e5), (70_000, 7e4)]
    layout = Layout(queues)
    total = sum(n for n, _ in queues)
    served = np.zeros(4)
    q, j = (np.concatenate([np.full(c, i) if k else np.arange(c) for i, c in enumerate(layout.cells)]) for k in (1, 0))
    window = layout.ranks(q, j) // layout.per
    for w in range(layout.windows):
        served += np.bincount(q[window == w], minlength=4) * layout.cell
        ideal = np.array([n for n, _ in queues]) / total * (w + 1) * layout.length
        assert np.abs(served - ideal).max() <= 2 * layout.cell  # deficits stay below two cells


def test_no_documents(spark):
    assert pack(spark.createDataFrame([], SCHEMA), VOCABULARY).collect() == []
    only = pack(spark.createDataFrame([(1, None, None, 0, "q", 1, "x")], SCHEMA), VOCABULARY).collect()
    assert [(r.start, r.length, r.doc_tokens, r.sequence_id, r.offset) for r in only] == [(0, 1, 1, 0, 0)]
