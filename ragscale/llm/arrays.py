"""Numpy views of Arrow text columns: words, ragged gathers and bounded slices of a batch."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20  # text handled at once inside a task; a longer single text is handled alone

# The characters that separate words.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

WORD = r"[^\x20\x09-\x0D]+"  # the same rule as a regular expression


def text_slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds at most ``max_bytes`` of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffers(batch.column(batch.schema.get_field_index(column)))
        for at, to in row_pieces(offsets, max_bytes):
            yield batch.slice(at, to - at)
            give_back()


def row_pieces(offsets: np.ndarray, max_bytes: int) -> Iterator[tuple[int, int]]:
    """First row and end of runs of rows that hold at most ``max_bytes`` each, or one row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def give_back() -> None:
    """Hand freed memory back to the system between slices; the workers of an executor share its memory."""
    import ctypes  # not while a task's function is being loaded

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_HELD: dict = {}


def held(kind, *given):
    """This worker's compiled vocabulary ``kind(*given)``, kept for its next tasks. Asking for another one drops it: a worker
    serves one stage after the other, and never needs two at once."""
    if (kind, *given) not in _HELD:
        _HELD.clear()
        give_back()
        _HELD[kind, *given] = kind(*given)
    return _HELD[kind, *given]


def let_go() -> None:
    """Drop the vocabulary an earlier stage left in this worker, and what its objects that refer to each other keep; for
    tasks that need none."""
    _HELD.clear()
    gc.collect()
    give_back()


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column (or a binary one's bytes) and the row offsets into them; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the number of its first word (one more entry at the end)."""
    inside = ~SPACE[data]
    first = np.ones(len(data), bool)
    first[1:] = ~inside[:-1]
    last = np.ones(len(data), bool)
    last[:-1] = ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    first[offsets[:-1][full]] = True
    last[offsets[1:][full] - 1] = True
    starts = np.flatnonzero(inside & first)
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def slice_strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.LargeStringArray:
    """The texts between ``starts`` and ``ends`` as an Arrow array."""
    flat, offsets = ragged_ranges(data, starts, ends - starts)
    return strings(flat, offsets)


def word_strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.LargeStringArray:
    """The words of ``word_bounds`` as an Arrow array."""
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    return strings(data[~SPACE[data]], offsets)


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.LargeStringArray:
    return pa.LargeStringArray.from_buffers(
        len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))
    )


def ragged_ranges(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated ranges of ``flat`` and the offsets of the parts."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    return flat[at], offsets


def codes(words: pa.LargeStringArray) -> tuple[np.ndarray, pa.LargeStringArray]:
    """A number for each text, and the distinct texts by number."""
    encoded = words.dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ``bounds``."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def segment_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``values[at[i]:at[i + 1]]``, each added up by itself, so that equal segments have equal sums."""
    out = np.zeros(len(at) - 1, values.dtype)
    some = at[1:] > at[:-1]
    if some.any():
        out[some] = np.add.reduceat(values, at[:-1][some])
    return out
