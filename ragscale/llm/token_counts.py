"""Token counts by a compiled finite-state tokenizer.

The byte-level vocabulary and its rule for splitting texts become one deterministic transducer over bytes: a
state pairs the splitting rule's position (inside letters, numbers, other signs, white space, a possible
contraction, an unfinished character) with a state of the byte-pair transducer, and each transition carries the
number of tokens it emits. Texts are cut into chunks that run as parallel lanes. A chunk owns a map from the state before it
to the state after it and a count, filled with the entries that are asked for; the maps compose along the text by a
parallel prefix scan that doubles the composed stretch in every step. Chunks cut where every state leads to the same
one need one entry; the others get an entry for every state that the maps before them bring, until each text's way
from its known first state is composed to its end. Because states forget what is far back, maps stay very small.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ragscale.llm.arrays import held, text_buffers, text_slices
from ragscale.llm.transducer import Bpe, Lanes

CHUNK = 1024  # bytes of a lane

# What follows an apostrophe in the vocabulary's contractions.
SHORT_TAILS = b"stmd"
LONG_TAILS = {ord("r"): ord("e"), ord("v"): ord("e"), ord("l"): ord("l")}


class TextMachine:
    """The product of the splitting rule and the byte-pair transducer.

    A description is ``(mode, pair state, kept bytes, unfinished character)``. Modes: ``S`` at a border, ``L`` letters,
    ``N`` numbers, ``O`` other signs, ``W`` white space whose last character is kept back, ``A`` an apostrophe that
    may begin a contraction, ``B`` the same with the first letter of a longer one.
    """

    width = 256

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.split = library.pre_tokenizer
        self.special = [t.content.encode() for t in library.get_added_tokens_decoder().values()]
        self.bpe = Bpe(path)
        self.kinds: dict[bytes, str] = {}
        self.reset()

    def reset(self) -> None:
        self.bpe.reset()
        self.told: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.start = self._state(("S", self.bpe.start, b"", b""))

    def _state(self, d: tuple) -> int:
        n = self.number.setdefault(d, len(self.told))
        if n == len(self.told):
            self.told.append(d)
        return n

    def size(self) -> int:
        return max(len(self.told), self.bpe.size())

    def describe(self, state: int) -> tuple:
        mode, pair, kept, part = self.told[state]
        return mode, self.bpe.describe(pair), kept, part

    def intern(self, told: tuple) -> int:
        mode, pair, kept, part = told
        return self._state((mode, self.bpe.intern(pair), kept, part))

    def kind(self, char: bytes) -> str:
        """L, N, O or W: the class in which the library's own splitter puts a character."""
        if char not in self.kinds:
            text = char.decode("utf-8", "replace")
            alike = (k for k, before in (("L", "a"), ("N", "1"), ("O", "!")) if len(self.split.pre_tokenize_str(before + text)) == 1)
            self.kinds[char] = next(alike, "W")
        return self.kinds[char]

    def _feed(self, pair: int, data: bytes) -> tuple[int, int]:
        total = 0
        for b in data:
            pair, count = self.bpe.advance(pair, b)
            total += count
        return pair, total

    def advance(self, state: int, byte: int) -> tuple[int, int]:
        mode, pair, kept, part = self.told[state]
        part += bytes([byte])
        if len(part) < char_length(part[0]):
            return self._state((mode, pair, kept, part)), 0
        mode, pair, kept, count = self._char(mode, pair, kept, part)
        return self._state((mode, pair, kept, b"")), count

    def _char(self, mode: str, pair: int, kept: bytes, char: bytes) -> tuple[str, int, bytes, int]:
        fresh, count, kind = self.bpe.start, 0, self.kind(char)
        if mode == "A":
            if len(char) == 1 and char[0] in SHORT_TAILS:
                return "S", fresh, b"", self._feed(fresh, b"'" + char)[1]
            if len(char) == 1 and char[0] in LONG_TAILS:
                return "B", fresh, char, 0
            pair, count = self._feed(fresh, b"'")
            mode = "O"
        elif mode == "B":
            if char == bytes([LONG_TAILS[kept[0]]]):
                return "S", fresh, b"", self._feed(fresh, b"'" + kept + char)[1]
            count = self._feed(fresh, b"'")[1]
            pair, more = self._feed(fresh, kept)
            mode, kept, count = "L", b"", count + more
        if mode == "W":
            if kind == "W":
                pair, count = self._feed(pair, kept)
                return "W", pair, char, count
            if kept == b" ":
                pair, count = self._feed(fresh, b" ")
                pair, more = self._feed(pair, char)
                return kind, pair, b"", count + more
            count, mode, pair = self._feed(fresh, kept)[1], "S", fresh
        if mode == kind:
            pair, more = self._feed(pair, char)
            return mode, pair, b"", count + more
        if kind == "W":
            return "W", fresh, char, count
        if char == b"'" and mode != "O":
            return "A", fresh, b"", count
        pair, more = self._feed(fresh, char)
        return kind, pair, b"", count + more

    def ending(self, state: int) -> int:
        """Tokens still owed when a text, or anything before white space, ends in this state."""
        mode, pair, kept, part = self.told[state]
        fresh, owed = self.bpe.start, 0
        if mode == "W":
            owed = self._feed(pair, kept)[1]
        elif mode == "A":
            owed = self._feed(fresh, b"'")[1]
        elif mode == "B":
            owed = self._feed(fresh, b"'")[1] + self._feed(fresh, kept)[1]
        return owed + (self._feed(fresh, part)[1] if part else 0)


def char_length(lead: int) -> int:
    return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class TextCounter:
    """Token counts of texts by one compiled vocabulary."""

    def __init__(self, path: str, chunk: int = CHUNK, max_cells: int | None = None):
        self.machine, self.chunk = TextMachine(path), chunk
        self.lanes = Lanes(self.machine, max_cells) if max_cells else Lanes(self.machine)
        self.border = np.zeros(256, bool)
        self.border[0x21:0x7F] = True  # a visible ASCII sign before a blank or line end: every state leads to the same

    def sections(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and rows of the stretches between special strings, and the special strings of each row."""
        extra = np.zeros(len(offsets) - 1, np.int64)
        found = sorted((at, at + len(s)) for s in self.machine.special for at in occurrences(data.tobytes(), s))
        starts, ends, rows, last = [offsets[:-1]], [offsets[1:]], [np.arange(len(offsets) - 1)], -1
        cuts: dict[int, list[tuple[int, int]]] = {}
        for a, b in found:
            row = int(np.searchsorted(offsets, a, "right")) - 1
            if a >= last and b <= offsets[row + 1]:
                cuts.setdefault(row, []).append((a, b))
                last = b
        if cuts:
            plain = np.ones(len(offsets) - 1, bool)
            plain[list(cuts)] = False
            starts, ends, rows = ([x[0][plain]] for x in (starts, ends, rows))
            for row, spans in cuts.items():
                extra[row] = len(spans)
                edges = [int(offsets[row]), *(e for s in spans for e in s), int(offsets[row + 1])]
                starts.append(np.array(edges[::2]))
                ends.append(np.array(edges[1::2]))
                rows.append(np.full(len(edges) // 2, row))
        return np.concatenate(starts), np.concatenate(ends), np.concatenate(rows), extra

    def chunks(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Starts, ends and sections of the chunks, and whether every state leads to the same one at a chunk's start."""
        ends_of_word = np.flatnonzero(self.border[data[:-1]] & ((data[1:] == 0x20) | (data[1:] == 0x0A))) + 1
        per = np.maximum(0, (ends - starts - 1) // self.chunk)
        section = np.repeat(np.arange(len(starts)), per)
        nth = np.arange(len(section)) - np.repeat(np.cumsum(per) - per, per)
        target = starts[section] + (nth + 1) * self.chunk
        limit = np.minimum(target + self.chunk, ends[section])
        at = np.append(ends_of_word, np.iinfo(np.int64).max)[np.searchsorted(ends_of_word, target)]
        settled = at < limit
        cut = np.where(settled, at, target)
        starts_all = np.concatenate([starts, cut])
        owner = np.concatenate([np.arange(len(starts)), section])
        firm = np.concatenate([np.ones(len(starts), bool), settled])
        order = np.lexsort((starts_all, owner))
        starts_all, owner, firm = starts_all[order], owner[order], firm[order]
        last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
        ends_all = np.where(last, ends[owner], np.append(starts_all[1:], 0))
        return starts_all, ends_all, owner, firm, last

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each row."""
        machine = self.machine
        starts, ends, rows, total = self.sections(data, offsets)
        kept = ends > starts
        starts, ends, rows = starts[kept], ends[kept], rows[kept]
        if not len(starts):
            return total
        at, to, owner, firm, last = self.chunks(data, starts, ends)
        self.lanes.fit()
        open_ = np.append(~firm[1:], False)  # the next chunk goes on with this one's state
        chunk, entry, leave, counts = np.zeros(0, np.int64), *(np.zeros(0, np.int32) for _ in range(2)), np.zeros(0, np.int64)
        new_chunk, new_entry = np.arange(len(at)), np.full(len(at), machine.start, np.int32)
        roots = np.flatnonzero(firm)  # the first entries of chunks whose state before is known
        for turn in itertools.count():
            state = new_entry.copy()
            more = self.lanes.run(data, at[new_chunk], (to - at)[new_chunk], state, held=(entry, leave, new_entry))
            chunk, counts = np.concatenate([chunk, new_chunk]), np.concatenate([counts, more])
            entry, leave = np.concatenate([entry, new_entry]), np.concatenate([leave, state])
            follows = following(chunk, entry, leave, open_)
            summed, tail = composed(follows, counts)
            lost = np.flatnonzero(follows == UNKNOWN)
            if turn >= SPECULATED:  # later only what a known state has led to
                lost = np.intersect1d(lost, tail[roots])
            if not (follows[tail[roots]] == UNKNOWN).any():
                break
            width = int(leave.max()) + 1
            new_chunk, new_entry = np.divmod(np.unique((chunk[lost] + 1) * width + leave[lost]), width)
            new_entry = new_entry.astype(np.int32)
        final = leave[tail[roots]]
        owed = {int(s): machine.ending(int(s)) for s in np.unique(final)}
        np.add.at(total, rows[owner[roots]], summed[roots] + np.array([owed[int(s)] for s in final], np.int64))
        return total


UNKNOWN, END = -1, -2
SPECULATED = 2  # rounds in which chunks are also run from states that only a guess has led to


def following(chunk: np.ndarray, entry: np.ndarray, leave: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """For each entry of a chunk's map the entry of the next chunk that begins in the state it leaves; UNKNOWN if that chunk's map
    lacks it, END if the next chunk's state doesn't depend on this one."""
    width = int(max(entry.max(), leave.max())) + 1
    have, want = chunk * width + entry, (chunk + 1) * width + leave
    order = np.argsort(have, kind="stable")
    spot = np.minimum(np.searchsorted(have[order], want), len(have) - 1)
    found = order[spot]
    return np.where(~open_[chunk], END, np.where(have[found] == want, found, UNKNOWN))


def composed(follows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maps composed along the text by a parallel prefix scan: for each entry the tokens from it to the end of the known way,
    and the last entry of that way. Each step composes stretches of twice the length."""
    n = len(follows)
    summed = np.append(counts, 0)
    ahead = np.append(np.where(follows >= 0, follows, n), n)  # n: nothing further
    tail = np.arange(n + 1)
    while (ahead[:n] < n).any():
        summed = summed + summed[ahead]
        tail = np.where(ahead < n, tail[ahead], tail)
        ahead = ahead[ahead]
    return summed[:n], tail[:n]


def occurrences(data: bytes, part: bytes) -> Iterator[int]:
    at = data.find(part)
    while at >= 0:
        yield at
        at = data.find(part, at + len(part))


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id", limit: int = 512) -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` of every row, repeated rows included.

    ``vocabulary``: file of a byte-level vocabulary, readable on every executor. Special strings inside a text count
    as one token each, as the library has it. Null counts as the empty text: no bytes, no tokens. The length of a
    text is not limited; a text's memory is proportional to its own length. Other columns are not read. An empty
    table gives no rows.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            data, offsets = text_buffers(part.column(1))
            n = held(TextCounter, vocabulary).count(data, offsets)
            yield pa.record_batch(
                [part.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)],
                names=[key, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(task, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
