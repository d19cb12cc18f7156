import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ragscale.llm.arrays import text_buffers
from ragscale.llm.token_counts import UNKNOWN, TextCounter, composed, count_tokens, following
from ragscale.llm.transducer import Bpe

VOCABULARY = str(public_tokenizers.path("byte_bpe_50k.json"))
SIGNS = list("aabcdeorstlmvd'''  \n\t\r.,!?0123é中文字ßÄ  　 🙂½²x́") + ["'s", "'re", "'ll", "'ve", "<|endoftext|>", "<|endo", "  ", "\n\n", "the", "ing"]


def texts(seed=1, n=600):
    rng = random.Random(seed)
    out = ["".join(rng.choices(SIGNS, k=rng.choice([0, 1, 2, 5, 20, 100, 1500]))) for _ in range(n)]
    return out + ["a" * 5000, "中" * 3000, "!'" * 2000, " " * 3000, "<|endoftext|>", "<|endoftext|>" * 3, "", "ab" * 8000, "x'", "'", "'r", "'re", "\n's", " 's", "a's's"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


@pytest.mark.parametrize("chunk, max_cells", [(7, None), (64, None), (1024, None), (64, 60_000)])
def test_counts_are_the_librarys(library, chunk, max_cells):
    rows = texts() if max_cells is None else texts(2, 150)
    counter = TextCounter(VOCABULARY, chunk, max_cells)
    got = counter.count(*text_buffers(pa.array(rows)))
    want = [len(e.ids) for e in library.encode_batch(rows, add_special_tokens=False)]
    assert got.tolist() == want
    if max_cells:  # the arrays were emptied on the way and stayed within their bound, up to one step's additions
        assert counter.machine.size() * counter.lanes.n_columns < 3 * max_cells


def test_composed_maps_are_those_of_one_step_after_the_other():
    rng = np.random.default_rng(7)
    for n in (1, 2, 9, 200):
        states = 4
        leads, costs = rng.integers(0, states, (n, states)), rng.integers(0, 9, (n, states))
        open_ = np.append(rng.random(n - 1) < 0.9, False)
        have = rng.random((n, states)) < 0.8  # maps that lack some entries
        have[:, 0] = True
        chunk, entry = np.nonzero(have)
        leave, counts = leads[chunk, entry], costs[chunk, entry]
        follows = following(chunk, entry, leave, open_)
        summed, tail = composed(follows, counts)
        for i in range(len(chunk)):
            at, total = i, counts[i]
            while open_[chunk[at]] and have[chunk[at] + 1, leave[at]]:
                at = int(np.flatnonzero((chunk == chunk[at] + 1) & (entry == leave[at]))[0])
                total += counts[at]
            assert (summed[i], tail[i]) == (total, at)
            assert (follows[at] == UNKNOWN) == bool(open_[chunk[at]]) and follows[at] < 0


def test_long_texts_without_borders_need_few_rounds(library, monkeypatch):
    """Hundreds of chunks none of which begins at a border: a few rounds of lanes and a scan, not one round for each chunk."""
    rng, counter = random.Random(3), TextCounter(VOCABULARY, 64)
    rows = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=30_000)), "中文字" * 4000, "ab" * 9000]
    asked, run = [], counter.lanes.run
    monkeypatch.setattr(counter.lanes, "run", lambda data, starts, lengths, state, held: asked.append(len(starts)) or run(data, starts, lengths, state, held))
    got = counter.count(*text_buffers(pa.array(rows)))
    assert got.tolist() == [len(e.ids) for e in library.encode_batch(rows, add_special_tokens=False)]
    assert asked[0] > 1200 and len(asked) <= 12 and sum(asked) < 4 * asked[0]


def test_transducer_follows_the_merge_rules():
    bpe, rng = Bpe(VOCABULARY), random.Random(4)
    for _ in range(300):
        word = bytes(rng.choices(b" thergondisa\xc3\xa9", k=rng.randint(1, 14)))
        state, total = bpe.start, 0
        for b in word:
            state, count = bpe.advance(state, b)
            total += count
        tokens = bpe.merge(tuple(word))
        assert total == len(tokens) and bpe.last_token(state) == tokens[-1]


def test_query_columns(spark, library):
    rows = [(1, "the cat " * 300), (2, None), (2, ""), (None, "été <|endoftext|>"), (5, "same"), (5, "same")]
    docs = spark.createDataFrame([(i, t, 9, 8) for i, t in rows], "doc_id bigint, text string, n_tokens int, key int")
    got = sorted(map(str, count_tokens(docs, VOCABULARY).collect()))
    want = []
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append(f"Row(doc_id={i}, n_bytes={len((t or '').encode())}, n_tokens={n}, over_limit={n > 512})")
    assert got == sorted(want)
    assert count_tokens(docs.limit(0), VOCABULARY).collect() == []
