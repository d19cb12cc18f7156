"""Stupid-backoff scores of documents against the rest of the corpus.

The relations are n-gram counts, partitioned by hash, and the documents' exploded n-grams; both are moved in columnar blocks
because single rows of them would be many times larger than the text. Documents are kept in written blocks. Every block
asks each hash partition for its distinct n-grams there, with its own counts; the partition adds up the counts of all blocks
and answers; the answers join the block again, where the scores are summed per document. An n-gram occurs once in a
block's question however often the block has it, so frequent n-grams weigh no more than others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ragscale.llm.arrays import codes, give_back, text_buffers, text_slices, word_bounds, word_strings
from ragscale.llm.frames import carry
from ragscale.session import materialize

ALPHA = 0.4
BLOCK_BYTES = 8 << 20  # text of a block
PART_GRAMS = 3 << 19  # n-grams that a hash partition is meant for
KEY_BITS = 48  # that tell n-grams of one hash partition apart; partitions grow with the corpus, their contents do not


def planes(values: np.ndarray) -> bytes:
    """Non-negative numbers by byte position, as many positions as the largest needs; the first byte says how many."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width].tobytes()


def unplaned(data: bytes) -> np.ndarray:
    width = data[0]
    flat = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((flat.shape[1], 8), np.uint8)
    out[:, :width] = flat.T
    return out.view("<u8").ravel()


def squeezed(values: np.ndarray) -> bytes:
    """Counts, most of them alike, as compressed ``planes``."""
    return zlib.compress(planes(values), 3)


def unsqueezed(data: bytes) -> np.ndarray:
    return unplaned(zlib.decompress(data)).astype(np.int64)


def steps(keys: np.ndarray) -> bytes:
    """Ascending keys as their differences, which need fewer bytes."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unstepped(data: bytes) -> np.ndarray:
    return np.cumsum(unplaned(data), dtype=np.uint64)


def blocks(docs: DataFrame, keep: list[str], text: str, block_bytes: int) -> tuple[DataFrame, str]:
    """Written ``block, n_words, docs``: the rows in blocks of up to ``block_bytes`` of text, and the schema text of ``keep``."""
    rows, fields = carry(docs, keep, F.col(text).cast("string"))

    def packed(parts: list[pa.RecordBatch], block: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        words = sum(len(word_bounds(*text_buffers(p.column(len(keep))))[0]) for p in parts)
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as writer:
            writer.write_table(table)
        return pa.record_batch([pa.array([block]), pa.array([words]), pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["block", "n_words", "docs"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, TaskContext.get().partitionId() << 32
        for part in text_slices(batches, "x0", max(1, block_bytes // 4)):
            held.append(part)
            size += int(text_buffers(part.column(len(keep)))[1][-1])
            if size >= block_bytes:
                yield packed(held, number)
                held, size, number = [], 0, number + 1
        if held:
            yield packed(held, number)

    return materialize(rows.mapInArrow(task, "block bigint, n_words bigint, docs binary"), "blocks"), fields


def opened(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]  # fixed values of a common 64-bit mixer


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def grams(column: pa.Array, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each length up to ``order`` the hash of the n-gram ending at each word (meaningless where it would begin before
    its row), and the first word of each row."""
    from xxhash import xxh64_intdigest

    data, offsets = text_buffers(column)
    starts, ends, first = word_bounds(data, offsets)
    number, distinct = codes(word_strings(data, starts, ends))
    word = np.fromiter((xxh64_intdigest(w) for w in distinct.cast(pa.large_binary()).to_pylist()), np.uint64, len(distinct))[number]
    out = [mixed(word + _MIX[0])]
    for _ in range(1, order):
        longer = out[-1].copy()
        longer[1:] = mixed(out[-1][:-1] * _MIX[2] + word[1:] + _MIX[0])
        out.append(longer)
    return out, first


def depth_of(first: np.ndarray) -> np.ndarray:
    """How many words of its row stand before each word."""
    n = np.diff(first)
    return np.arange(first[-1]) - np.repeat(first[:-1], n)


def placed(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, int]:
    """Hashes as ``partition, key`` in one number, ascending by partition, and the bits of the key."""
    bits = min(KEY_BITS, 64 - max(parts - 1, 1).bit_length())
    part = ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return (part << np.uint64(bits)) | (hashes & np.uint64((1 << bits) - 1)), bits


def _asked(table: pa.Table, order: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """A block's n-grams as placed keys, length by length, which words of each length have one, the rows' first words, key bits."""
    hashes, first = grams(table.column(table.num_columns - 1).combine_chunks() if table.num_rows else pa.array([], pa.string()), order)
    exist = np.stack([depth_of(first) >= n for n in range(order)])
    keys, bits = placed(np.stack(hashes)[exist], parts)
    return keys, exist, first, bits


def questions(stored: DataFrame, order: int, parts: int) -> DataFrame:
    """``block, part, keys, counts``: each block's distinct n-grams in each hash partition, ascending, with its own counts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                give_back()
                keys, _, _, bits = _asked(opened(data.as_py()), order, parts)
                if not len(keys):
                    continue
                keys.sort()
                new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                counts, keys = np.diff(np.append(new, len(keys))), keys[new]
                part = keys >> np.uint64(bits)
                cut = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                ends = np.append(cut[1:], len(keys))
                keys &= np.uint64((1 << bits) - 1)
                yield pa.record_batch(
                    [pa.array(np.full(len(cut), block, np.int64)), pa.array(part[cut].astype(np.int64)), pa.array([steps(keys[a:b]) for a, b in zip(cut, ends)], pa.binary()), pa.array([squeezed(counts[a:b]) for a, b in zip(cut, ends)], pa.binary())],
                    names=["block", "part", "keys", "counts"],
                )

    return stored.select("block", "docs").mapInArrow(task, "block bigint, part bigint, keys binary, counts binary")


def answers(asked: DataFrame) -> DataFrame:
    """``block, part, others``: counts in all other blocks of the n-grams a block asked a partition for, in the question's order."""

    def count(table: pa.Table) -> pa.Table:
        keys = np.concatenate([unstepped(k.as_py()) for k in table.column("keys")])
        own = [unsqueezed(c.as_py()) for c in table.column("counts")]
        ends = np.cumsum([len(c) for c in own])
        order = np.argsort(keys)
        keys = keys[order]
        new = np.append(True, keys[1:] != keys[:-1])
        mine = np.concatenate(own)
        sums = np.add.reduceat(mine[order], np.flatnonzero(new))
        others = np.empty(len(keys), np.int64)
        others[order] = sums[np.cumsum(new) - 1]
        others -= mine
        told = [squeezed(t) for t in np.split(others, ends[:-1])]
        del keys, own, order, new, sums, others, mine
        give_back()
        return pa.table({"block": table.column("block"), "part": table.column("part"), "others": pa.array(told, pa.binary())})

    return asked.groupBy("part").applyInArrow(count, "block bigint, part bigint, others binary")


def scores(table: pa.Table, elsewhere: np.ndarray, corpus: int, order: int, alpha: float, parts: int) -> tuple[np.ndarray, ...]:
    """``n_words``, words scored at each length (order to 1, then unseen), and mean log score of a block's rows.

    ``elsewhere``: counts of the block's distinct n-grams, ascending, in all other blocks.
    """
    keys, exist, first, _ = _asked(table, order, parts)
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    # One stable sort brings equal n-grams together and keeps each row's occurrences of one next to each other.
    by = np.argsort(keys, kind="stable")
    owner = np.concatenate([row[e] for e in exist])[by]
    keys = keys[by]
    new = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
    turn = np.flatnonzero(new | np.append(True, owner[1:] != owner[:-1])) if len(keys) else np.zeros(0, np.int64)
    own = np.diff(np.append(turn, len(keys)))
    outside = np.empty(len(keys), np.int64)
    here = np.diff(np.append(np.flatnonzero(new), len(keys)))
    outside[by] = (elsewhere + here)[np.cumsum(new) - 1] - np.repeat(own, own)
    others = np.zeros(exist.shape, np.int64)  # counts outside the word's own document
    others[exist] = outside
    rest = np.maximum(corpus - n, 0)[row]
    depth = depth_of(first)
    level = np.minimum(depth, order - 1)
    used = np.full(len(row), -1)
    value = np.zeros(len(row))
    for k in range(order - 1, -1, -1):
        hit = (used < 0) & exist[k] & (others[k] > 0)
        at = np.flatnonzero(hit)
        below = others[k - 1][at - 1] if k else rest[at]
        value[at] = np.log(others[k][at] / below) + np.log(alpha) * (level[at] - k)
        used[at] = k
    unseen = np.flatnonzero(used < 0)
    value[unseen] = np.log(alpha) * (level[unseen] + 1) - np.log(np.maximum(rest[unseen], 1))
    total = np.bincount(row, weights=value, minlength=len(n))
    hits = [np.bincount(row[used == k], minlength=len(n)) for k in [*range(order - 1, -1, -1), -1]]
    return n, hits, total / np.maximum(n, 1)


def backoff_scores(docs: DataFrame, keep: list[str], text: str = "text", order: int = 3, alpha: float = ALPHA, block_bytes: int = BLOCK_BYTES, part_grams: int = PART_GRAMS) -> DataFrame:
    """Columns ``keep``, ``n_words``, ``n_<length>`` for each length down to 1, ``n_unseen`` and ``score`` of every row.

    The score is the mean over the words of the logarithm of their stupid-backoff value: the longest n-gram that other documents
    have gives its count over its context's, times ``alpha`` for each shorter length taken; a word that no other document has
    gets ``alpha`` once more over the number of their words. Counts cover all rows; a row's own are subtracted, a repeated
    row's copies are not. N-grams do not cross rows. A null text or one without words has 0 words and a null score. An empty
    table gives no rows. N-grams of a hash partition are told
    apart by up to 48 bits of their hash, which confuses about one in 10^8, whatever the size of the corpus. Memory is bounded by a block (or one longer text) and by a hash
    partition, whose number grows with the corpus.
    """
    stored, fields = blocks(docs, keep, text, block_bytes)
    corpus = stored.agg(F.sum("n_words")).first()[0] or 0
    parts = max(1, -(-order * corpus // part_grams))
    told = answers(questions(stored, order, parts))
    width = len(keep)
    names = [*keep, "n_words", *(f"n_{k}" for k in range(order, 0, -1)), "n_unseen", "score"]

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        given = sorted(zip(left.column("part").to_pylist(), left.column("others").to_pylist()))
        elsewhere = np.concatenate([unsqueezed(t) for _, t in given]) if given else np.zeros(0, np.int64)
        out = []
        for data in right.column("docs").to_pylist():
            table = opened(data)
            n, hits, score = scores(table, elsewhere, corpus, order, alpha, parts)
            columns = [*table.columns[:width], pa.array(n), *(pa.array(h.astype(np.int64)) for h in hits), pa.array(score, mask=n == 0)]
            out.append(pa.Table.from_arrays(columns, names=names))
            give_back()
        return pa.concat_tables(out)

    schema = ", ".join(filter(None, [fields, "n_words bigint", *(f"n_{k} bigint" for k in range(order, 0, -1)), "n_unseen bigint", "score double"]))
    return told.groupBy("block").cogroup(stored.groupBy("block")).applyInArrow(join, schema)
