"""Fill-in-the-middle transformation by displacement scatter.

A slice of texts is one array of bytes. Scanning it gives the places where units end and so the two cuts of each text. Every
byte moves by a shift that is constant between cuts: differences are noted at the cuts, their cumulative sum is each byte's
shift, and one scatter writes all outputs of the slice. The inverse scans the outputs for the marks, builds the same
shifts from them and gathers the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ragscale.llm.arrays import strings, text_buffers, text_slices, word_bounds
from ragscale.llm.frames import carry, with_names

PLAIN, PSM, SPM = 0, 1, 2
FORMS = np.array(["plain", "psm", "spm"])
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"  # the marks, three bytes each
MARK = 3


def hash_words(seed: int, id: str) -> list[Column]:
    """The first four groups of eight digits of the sha256 of ``<seed>:<id>`` as unsigned numbers; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def unit_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each text (words with the white space before them, and white space at the end), ends of words, first word of each text."""
    _, ends, first = word_bounds(data, offsets)
    words = np.diff(first)
    closing = offsets[:-1].copy()  # where the last word ends
    some = words > 0
    closing[some] = ends[first[1:][some] - 1]
    return words + (closing < offsets[1:]), ends, first


def cut_places(data: np.ndarray, offsets: np.ndarray, counts: np.ndarray, ends: np.ndarray, first: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Where each text is cut after ``after`` units."""
    at = offsets[:-1].copy()
    words = np.diff(first)
    inside = (after > 0) & (after <= words)
    at[inside] = ends[first[:-1][inside] + after[inside] - 1]
    whole = (after > words) & (after == counts)
    at[whole] = offsets[1:][whole]
    return at


def mark_places(data: np.ndarray, letter: int) -> np.ndarray:
    """Where ``<letter>`` begins."""
    if len(data) < MARK:
        return np.zeros(0, np.int64)
    return np.flatnonzero((data[:-2] == 0x3C) & (data[1:-1] == letter) & (data[2:] == 0x3E))


def holds_mark(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts contain one of the marks."""
    out = np.zeros(len(offsets) - 1, bool)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        at = mark_places(data, mark[1])
        row = np.searchsorted(offsets, at, "right") - 1
        out[row[at + MARK <= offsets[row + 1]]] = True
    return out


def displaced(n: int, starts: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Where each of ``n`` bytes goes: ``shifts`` hold from ``starts`` (ascending) on, of several at one place the last."""
    kind = np.int32 if n < 1 << 30 else np.int64
    difference = np.zeros(n + 1, kind)
    np.add.at(difference, starts, np.diff(shifts, prepend=0).astype(kind))
    place = np.cumsum(difference[:n], dtype=kind)
    place += np.arange(n, dtype=kind)
    return place


def transform(data: np.ndarray, offsets: np.ndarray, forms: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the outputs of texts cut at ``lo`` and ``hi``."""
    begin, end = offsets[:-1], offsets[1:]
    marked = forms != PLAIN
    out = np.zeros(len(offsets), np.int64)
    np.cumsum(end - begin + 3 * MARK * marked, out=out[1:])
    head, mid, tail = lo - begin, hi - lo, end - hi
    base = out[:-1]
    spm = forms == SPM
    # <P> prefix <S> suffix <M> middle, or <S> suffix <P> prefix <M> middle
    to_prefix = np.where(spm, base + 2 * MARK + tail, base + MARK)
    to_suffix = np.where(spm, base + MARK, base + 2 * MARK + head)
    to_middle = base + 3 * MARK + head + tail
    to_prefix, to_middle, to_suffix = (np.where(marked, x, y) for x, y in ((to_prefix, base), (to_middle, base + head), (to_suffix, base + head + mid)))
    starts = np.stack([begin, lo, hi], axis=1).ravel()
    shifts = np.stack([to_prefix - begin, to_middle - lo, to_suffix - hi], axis=1).ravel()
    flat = np.zeros(out[-1], np.uint8)
    flat[displaced(len(data), starts, shifts)] = data
    for mark, before in ((PREFIX, to_prefix), (SUFFIX, to_suffix), (MIDDLE, to_middle)):
        for i, byte in enumerate(mark):
            flat[before[marked] - MARK + i] = byte
    return flat, out


def restore(data: np.ndarray, offsets: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts that ``transform`` made the outputs from, read off the outputs and their forms alone."""
    begin, end = offsets[:-1], offsets[1:]
    marked = forms != PLAIN

    def place(mark: bytes) -> np.ndarray:
        """Where the mark begins in each text that has marks; its end in the others."""
        at = mark_places(data, mark[1])
        row = np.searchsorted(offsets, at, "right") - 1
        use = marked[row] & (at + MARK <= end[row])
        out = end.copy()
        out[row[use]] = at[use]
        if np.bincount(row[use], minlength=len(marked))[marked].tolist() != [1] * int(marked.sum()):
            raise ValueError("a transformed text needs each mark once")
        return out

    p, s, m = place(PREFIX), place(SUFFIX), place(MIDDLE)
    spm = forms == SPM
    prefix = (np.where(marked, p + MARK, begin), np.where(marked, np.where(spm, m, s), end))
    middle = (np.where(marked, m + MARK, end), end)
    suffix = (np.where(marked, s + MARK, end), np.where(marked, np.where(spm, p, m), end))
    out = np.zeros(len(offsets), np.int64)
    np.cumsum(end - begin - 3 * MARK * marked, out=out[1:])
    at_middle = out[:-1] + prefix[1] - prefix[0]
    at_suffix = at_middle + middle[1] - middle[0]
    starts = np.stack([out[:-1], at_middle, at_suffix], axis=1).ravel()
    shifts = np.stack([prefix[0] - out[:-1], middle[0] - at_middle, suffix[0] - at_suffix], axis=1).ravel()
    return data[displaced(int(out[-1]), starts, shifts)], out


def fill_in_middle(docs: DataFrame, keep: list[str], id: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm_share: int = 80) -> DataFrame:
    """Columns ``keep``, ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` of every row.

    A text has ``n`` units: words between ASCII white space with the white space before them, and white space at the end. Four
    numbers from the row's id and ``seed`` place two cuts between units and choose the form: ``plain``, ``psm``
    (prefix, suffix, middle, each after its mark) or ``spm``. ``rate`` percent of the ids are transformed, ``spm_share``
    percent of those as ``spm``. Texts that are empty (null counts so) or hold a mark stay plain; their two counts of
    code points are null. Repeated rows give repeated results, an empty table none. A column of ``keep`` named like an
    added one is left out.
    """
    added = ["n", "form", "prefix_chars", "middle_chars", "output"]
    keep = [c for c in keep if c not in added]
    rows, _ = carry(docs, keep, F.col(text).cast("string"), *hash_words(seed, id))
    names = [f"k{i}" for i in range(len(keep))]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "x0"):
            data, offsets = text_buffers(part.column(len(keep)))
            h1, h2, h3, h4 = (part.column(len(keep) + i).to_numpy() for i in range(1, 5))
            counts, ends, first = unit_counts(data, offsets)
            one, two = h1 % (counts + 1), h2 % (counts + 1)
            lo, hi = (cut_places(data, offsets, counts, ends, first, x) for x in (np.minimum(one, two), np.maximum(one, two)))
            plain = (offsets[1:] == offsets[:-1]) | holds_mark(data, offsets) | (h3 % 100 >= rate)
            forms = np.where(plain, PLAIN, np.where(h4 % 100 < spm_share, SPM, PSM))
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            flat, out = transform(data, offsets, forms, lo, hi)
            columns = [
                pa.array(counts), pa.array(FORMS[forms]), pa.array(points[lo] - points[offsets[:-1]], mask=plain),
                pa.array(points[hi] - points[lo], mask=plain), strings(flat, out).cast(pa.string()),
            ]
            yield pa.record_batch([*part.columns[: len(keep)], *columns], names=[*names, *added])

    fields = "".join(f"{n} {rows.schema[n].dataType.simpleString()}, " for n in names)
    made = rows.mapInArrow(task, f"{fields}n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    return with_names(made, keep, *added)


def restored_texts(made: DataFrame, keep: list[str], output: str = "output", form: str = "form", name: str = "restored") -> DataFrame:
    """Columns ``keep`` and ``name``, the text that each output was made from. An output that lacks a mark of its form raises;
    null outputs count as empty, null forms as plain. A column of ``keep`` called ``name`` is left out."""
    keep = [c for c in keep if c != name]
    rows, _ = carry(made, keep, F.col(output), F.coalesce(F.col(form), F.lit(str(FORMS[PLAIN]))))
    names = [f"k{i}" for i in range(len(keep))]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "x0"):
            data, offsets = text_buffers(part.column(len(keep)))
            told = part.column(len(keep) + 1).to_numpy(zero_copy_only=False).astype(str)
            forms = np.select([told == FORMS[PSM], told == FORMS[SPM]], [PSM, SPM], PLAIN)
            yield pa.record_batch([*part.columns[: len(keep)], strings(*restore(data, offsets, forms)).cast(pa.string())], names=[*names, "text_out"])

    fields = "".join(f"{n} {rows.schema[n].dataType.simpleString()}, " for n in names)
    back = rows.mapInArrow(task, f"{fields}text_out string")
    return with_names(back, keep, F.col("text_out").alias(name))
