"""Token ids of whole texts for a vocabulary that drops white space, one encoding for each distinct word.

Words between ASCII white space are encoded apart, which gives the ids of the whole text because neither the
vocabulary's splitting nor its merges reach across white space. Words of plain Latin letters, digits and signs go
through the compiled transducer; any other word goes to the library itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ragscale.llm.arrays import codes, ragged_ranges, slice_strings, text_buffers, word_bounds, word_strings
from ragscale.llm.transducer import MAX_CELLS, WORD_END, Bpe, SparseLanes

LETTER, DIGIT, SIGN, REST = 1, 2, 3, 0
TRACE_CELLS = 2 << 20  # steps times lanes whose tokens are kept at once


class WordTokenizer:
    def __init__(self, path: str, max_cells: int = MAX_CELLS):
        """``max_cells``: transitions kept at once; with fewer, more are made again."""
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.bpe = Bpe(path, suffix="</w>", remember=False)
        self.lanes, self.last = SparseLanes(self.bpe, max_cells), _LastTokens(self.bpe)
        self.width = np.zeros(max(self.bpe.symbols) + 1, np.int64)  # symbols of each token
        for token, seq in self.bpe.symbols.items():
            self.width[token] = len(seq)
        self.kind = np.zeros(256, np.uint8)
        self.kind[0x21:0x7F] = SIGN
        self.kind[ord("0") : ord("9") + 1] = DIGIT
        for a, z in ((ord("A"), ord("Z")), (ord("a"), ord("z"))):
            self.kind[a : z + 1] = LETTER
        self.kind[ord("'")] = REST  # contractions
        self.kind[ord("<")] = REST  # special strings
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[ord("A") : ord("Z") + 1] += 32

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids one after the other, and the offsets of the rows."""
        data, offsets = text_buffers(column)
        starts, ends, first = word_bounds(data, offsets)
        number, distinct = codes(word_strings(data, starts, ends))
        flat, at = self._words(distinct)
        lengths = np.diff(at)
        out, word_at = ragged_ranges(flat, at[number], lengths[number])
        return out, word_at[first]

    def _words(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = text_buffers(words)
        kind, low = self.kind[data], self.lower[data]
        # Latin-1 letters: C3 and a second byte, but for the two that are signs.
        lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, np.int64)
        second = data[lead + 1]
        good = (second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)
        lead, second = lead[good], second[good]
        kind[lead] = kind[lead + 1] = LETTER
        low[lead + 1] = second + np.where(second < 0x9F, 0x20, 0).astype(np.uint8)
        inside = np.ones(len(data), bool)
        inside[lead + 1] = False
        slow = np.zeros(len(words), bool)
        slow[np.searchsorted(offsets, np.flatnonzero(kind == REST), "right") - 1] = True
        begin = inside.copy()
        begin[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        begin[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(data))
        owner = np.searchsorted(offsets, starts, "right") - 1
        quick = ~slow[owner]
        starts, ends, owner = starts[quick], ends[quick], owner[quick]
        number, parts = codes(slice_strings(low, starts, ends))
        part_flat, part_at = self._parts(parts)
        sizes = np.diff(part_at)[number]
        lengths = np.bincount(owner, weights=sizes, minlength=len(words)).astype(np.int64)
        flat, _ = ragged_ranges(part_flat, part_at[number], sizes)
        hard = np.flatnonzero(slow)
        if not len(hard):
            return flat, np.concatenate([[0], np.cumsum(lengths)])
        told = [np.array(e.ids, np.uint32) for e in self.library.encode_batch([words[int(i)].as_py() for i in hard], add_special_tokens=False)]
        quick_at = np.cumsum(lengths) - lengths  # where the quick words' ids are in ``flat``
        lengths[hard] = [len(t) for t in told]
        quick_at[hard] = len(flat) + np.cumsum(lengths[hard]) - lengths[hard]
        return ragged_ranges(np.concatenate([flat, *told]), quick_at, lengths)

    def _parts(self, parts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of word parts by the transducer: forward in lanes, then back along the last tokens."""
        data, offsets = text_buffers(parts)
        lengths = np.diff(offsets)
        symbols = data.astype(np.int64)
        symbols[offsets[1:] - 1] += WORD_END
        self.lanes.fit()
        counts = np.zeros(len(lengths), np.int64)
        pieces: list[tuple[np.ndarray, np.ndarray]] = []
        order = np.argsort(lengths, kind="stable")
        at = 0
        while at < len(order):  # lanes of similar length, so that the trace stays small
            width = max(int(lengths[order[min(at + 4096, len(order) - 1)]]), 1)
            to = min(at + max(1, TRACE_CELLS // width), len(order))
            to = min(to, max(at + 1, int(np.searchsorted(lengths[order], max(width, 8), "right"))))
            lanes = order[at:to]
            tokens, n = self._trace(symbols, offsets[lanes], lengths[lanes])
            counts[lanes] = n
            pieces.append((lanes, tokens))
            at = to
        where = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(counts, out=where[1:])
        flat = np.empty(where[-1], np.uint32)
        for lanes, tokens in pieces:
            at = np.arange(len(tokens)) + np.repeat(where[lanes] - (np.cumsum(counts[lanes]) - counts[lanes]), counts[lanes])
            flat[at] = tokens
        return flat, where

    def _trace(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        table = np.full((int(lengths.max()) + 1, len(lengths)), -1, np.int32)
        state = np.full(len(lengths), self.bpe.start, np.int32)
        counts = self.lanes.run(symbols, starts, lengths, state, trace=lambda step, lanes, states: table.__setitem__((step, lanes), self.last.of(states)))
        ends = np.cumsum(counts)
        flat, at = np.empty(int(ends[-1]), np.uint32), ends.copy()
        place, lane = lengths.copy(), np.arange(len(lengths))
        width = self.width
        while len(lane):
            token = table[place[lane], lane]
            at[lane] -= 1
            flat[at[lane]] = token
            place[lane] -= width[token]
            lane = lane[place[lane] > 0]
        return flat, counts


class _LastTokens:
    """The last token of each state, kept as an array; a state's number changes when the arrays were full."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.states, self.n, self.tokens = bpe, None, 0, np.zeros(0, np.int32)

    def of(self, states: np.ndarray) -> np.ndarray:
        if self.states is not self.bpe.states:
            self.states, self.n = self.bpe.states, 0
        if self.n < len(self.states):
            if len(self.tokens) < len(self.states):
                self.tokens = np.concatenate([self.tokens[: self.n], np.zeros(len(self.states) * 5 // 4 - self.n, np.int32)])
            self.tokens[self.n : len(self.states)] = [s[-1][1] for s in self.states[self.n :]]
            self.n = len(self.states)
        return self.tokens[states]
