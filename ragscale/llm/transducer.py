"""Byte-pair vocabularies as deterministic transducers whose transitions carry emitted-token counts.

A prefix of a word has one last token and one token count. The next symbol's last token is the one token that
ends there and forms a stable pair with the last token of the prefix before it. A state holds just what later
symbols can ask for: the tries still open, the token in front of each, and how many tokens back it stands.
States and transitions are determinised when a text first needs them and kept in arrays, so that many lanes step
at once. The arrays have a bounded size: when they are full, the states in use are kept and the rest forgotten.
"""

from __future__ import annotations

import json

import numpy as np

MAX_CELLS = 24 << 20  # transitions kept at once, 5 bytes each
COLUMNS = 32  # symbols for which room is made at once
WORD_END = 256  # added to the last symbol of a word in vocabularies that mark word ends


def byte_symbols() -> dict[str, int]:
    """The byte that each printable stand-in of a byte-level vocabulary means."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Bpe:
    """Merge rules of one vocabulary, and the count-annotated transitions they imply."""

    def __init__(self, path: str, suffix: str = "", remember: bool = True):
        """``remember``: keep transitions for callers that step one symbol at a time; lanes keep their own."""
        self.remember = remember
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        to_byte = byte_symbols()
        self.width = 512 if suffix else 256
        self.symbols: dict[int, tuple[int, ...]] = {}
        for text, token in model["vocab"].items():
            ended = bool(suffix) and text.endswith(suffix)
            body = text.removesuffix(suffix) if ended else text
            if body and all(c in to_byte for c in body):
                seq = [to_byte[c] for c in body]
                seq[-1] += WORD_END if ended else 0
                self.symbols[token] = tuple(seq)
        self.base = {seq[0]: token for token, seq in self.symbols.items() if len(seq) == 1}
        vocab = model["vocab"]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for order, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            if a + b in vocab:
                self.rank.setdefault((vocab[a], vocab[b]), (order, vocab[a + b]))
        self.child: dict[int, int] = {}
        self.ends, self.inner = [-1], [False]
        for token, seq in self.symbols.items():
            node = 0
            for s in seq:
                self.inner[node] = True
                node = self.child.setdefault(node * 512 + s, len(self.ends))
                if node == len(self.ends):
                    self.ends.append(-1)
                    self.inner.append(False)
            self.ends[node] = token
        self._alone: dict[int, bool] = {}
        self._pair: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.known: dict[int, tuple[int, int]] = {}
        self.start = self.intern(((0, -1, 0),))

    def intern(self, state: tuple) -> int:
        found = self.number.setdefault(state, len(self.states))
        if found == len(self.states):
            self.states.append(state)
        return found

    def merge(self, seq: tuple[int, ...]) -> list[int]:
        """Tokens of a symbol sequence by the merge rules themselves."""
        ids = [self.base[s] for s in seq]
        while len(ids) > 1:
            best, at = None, -1
            for i in range(len(ids) - 1):
                r = self.rank.get((ids[i], ids[i + 1]))
                if r is not None and (best is None or r[0] < best[0]):
                    best, at = r, i
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return ids

    def stable(self, before: int, token: int) -> bool:
        """Whether ``token`` can follow ``before`` (-1: nothing) in an encoded word."""
        if before < 0:
            if token not in self._alone:
                self._alone[token] = self.merge(self.symbols[token]) == [token]
            return self._alone[token]
        key = (before, token)
        if key not in self._pair:
            self._pair[key] = self.merge(self.symbols[before] + self.symbols[token]) == [before, token]
        return self._pair[key]

    def advance(self, state: int, symbol: int) -> tuple[int, int]:
        """The next state and the change of the token count."""
        key = state * 512 + symbol
        if key in self.known:
            return self.known[key]
        token, count, opened = -1, 0, []
        for node, before, back in self.states[state]:
            child = self.child.get(node * 512 + symbol)
            if child is None:
                continue
            if token < 0 and self.ends[child] >= 0 and self.stable(before, self.ends[child]):
                token, count = self.ends[child], back + 1
            if self.inner[child]:
                opened.append((child, before, back))
        if token < 0:
            raise ValueError(f"symbol {symbol} is not in the vocabulary")
        nxt = self.intern(tuple((n, t, b - count) for n, t, b in opened) + ((0, token, 0),))
        if self.remember:
            self.known[key] = (nxt, count)
        return nxt, count

    def last_token(self, state: int) -> int:
        return self.states[state][-1][1]

    # What a lane runner needs of a machine whose states are numbers already.
    def describe(self, state: int):
        return self.states[state]

    def size(self) -> int:
        return len(self.states)


class Lanes:
    """Steps many symbol sequences through a machine at once, over transition arrays filled on demand.

    A machine has ``start``, ``width``, ``advance(state, symbol)``, ``size()``, ``describe(state)``,
    ``intern(description)`` and ``reset()``.
    """

    def __init__(self, machine, max_cells: int = MAX_CELLS):
        self.machine, self.max_cells = machine, max_cells
        self._clear()

    def _clear(self) -> None:
        self.columns = np.full(512, -1, np.int32)
        self.n_columns = 0
        self.next = np.full((1024, COLUMNS), -1, np.int32)
        self.emit = np.zeros((1024, COLUMNS), np.int8)

    def _column(self, symbols: np.ndarray) -> None:
        for s in symbols:
            self.columns[s] = self.n_columns
            self.n_columns += 1
        if self.n_columns > self.next.shape[1]:
            self._grow(self.next.shape[0], -(-self.n_columns // COLUMNS) * COLUMNS)

    def _grow(self, rows: int, columns: int) -> None:
        r, c = self.next.shape
        if columns == c:  # rows are added in place, without a second copy for the time being
            self.next.resize((rows, c), refcheck=False)
            self.emit.resize((rows, c), refcheck=False)
            self.next[r:] = -1
            return
        nxt, emit = np.full((rows, columns), -1, np.int32), np.zeros((rows, columns), np.int8)
        nxt[:r, :c], emit[:r, :c] = self.next, self.emit
        self.next, self.emit = nxt, emit

    def _full(self) -> bool:
        return self.machine.size() * max(self.n_columns, 1) > self.max_cells

    def fit(self, *held: np.ndarray) -> None:
        """Forget all but the states in ``held`` (renumbered in place) if the arrays are full."""
        if not self._full():
            return
        kept = np.unique(np.concatenate([h.ravel() for h in held])) if held else np.zeros(0, np.int32)
        told = [self.machine.describe(int(s)) for s in kept]
        self.machine.reset()
        self._clear()
        new = np.array([self.machine.intern(d) for d in told], np.int32)
        for h in held:
            h[...] = new[np.searchsorted(kept, h)]

    def _learn(self, states: np.ndarray, symbols: np.ndarray) -> None:
        for key in np.unique(states.astype(np.int64) * 512 + symbols).tolist():
            state, symbol = divmod(key, 512)
            nxt, count = self.machine.advance(state, symbol)
            if self.machine.size() > self.next.shape[0]:
                self._grow(self.machine.size() * 5 // 4, self.next.shape[1])
            self.next[state, self.columns[symbol]] = nxt
            self.emit[state, self.columns[symbol]] = count

    def _room(self, seen: np.ndarray) -> None:
        if (self.columns[seen] < 0).any():
            self._column(seen[self.columns[seen] < 0])
        if self.machine.size() > self.next.shape[0]:
            self._grow(self.machine.size() * 5 // 4, self.next.shape[1])

    def _step(self, now: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next state of each lane and what it emits."""
        column = self.columns[symbol]
        to = self.next[now, column]
        missing = to < 0
        if missing.any():
            self._learn(now[missing], symbol[missing])
            to = self.next[now, column]
        return to, self.emit[now, column]

    def run(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, states: np.ndarray, held=(), trace=None):
        """Token-count changes of each lane; ``states`` becomes the lanes' end states.

        ``held``: further arrays of states to keep valid. ``trace(step, lanes, states)`` sees every step.
        """
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        state, counts = states[order], np.zeros(len(order), np.int64)
        seen = np.flatnonzero(np.bincount(symbols, minlength=512)) if len(symbols) else np.zeros(0, np.int64)
        step, active = 0, int(np.searchsorted(-lengths, 0, "left"))
        while active:
            self.fit(state, *held)
            self._room(seen)
            symbol = symbols[starts[:active] + step]
            to, emitted = self._step(state[:active], symbol)
            counts[:active] += emitted
            state[:active] = to
            step += 1
            if trace is not None:
                trace(step, order[:active], to)
            active = int(np.searchsorted(-lengths, -step, "left"))
        out = np.empty(len(order), np.int64)
        out[order], states[order] = counts, state
        return out


STATE_CELLS = 64  # cells that a state of SparseLanes counts for with its transitions: the bytes that the machine keeps of it count too
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class SparseLanes(Lanes):
    """Lanes for machines of which few symbols follow each state: a hash table holds the transitions that texts have needed.

    In the memory of the arrays, most of whose cells stay empty, it keeps several times the states.
    """

    def _clear(self) -> None:
        self.bits, self.used = 14, 0
        self._empty()

    def _empty(self) -> None:
        self.keys = np.full(1 << self.bits, -1, np.int64)  # state * 512 + symbol
        self.next, self.emit = np.zeros(1 << self.bits, np.int32), np.zeros(1 << self.bits, np.int8)

    def _full(self) -> bool:
        return self.machine.size() * STATE_CELLS > self.max_cells

    def _room(self, seen: np.ndarray) -> None:
        pass

    def _places(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is, or the free place that it would take."""
        at = ((keys.astype(np.uint64) * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)
        there = self.keys[at]
        other = np.flatnonzero((there != keys) & (there >= 0))
        while len(other):
            at[other] = (at[other] + 1) & (len(self.keys) - 1)
            there = self.keys[at[other]]
            other = other[(there != keys[other]) & (there >= 0)]
        return at

    def _put(self, keys: np.ndarray, to: np.ndarray, out: np.ndarray) -> None:
        """Enters distinct keys that are not there yet."""
        left = np.arange(len(keys))
        while len(left):
            at = self._places(keys[left])
            first = np.unique(at, return_index=True)[1]  # of those that want the same place one gets it
            self.keys[at[first]], self.next[at[first]], self.emit[at[first]] = keys[left[first]], to[left[first]], out[left[first]]
            left = np.delete(left, first)
        self.used += len(keys)

    def _learn(self, states: np.ndarray, symbols: np.ndarray) -> None:
        keys = np.unique(states.astype(np.int64) * 512 + symbols)
        told = np.array([self.machine.advance(*divmod(key, 512)) for key in keys.tolist()], np.int64)
        if 2 * (self.used + len(keys)) > len(self.keys):
            old, before = np.flatnonzero(self.keys >= 0), (self.keys, self.next, self.emit)
            self.bits, self.used = max(self.bits + 1, int(4 * (self.used + len(keys)) - 1).bit_length() - 1), 0
            self._empty()
            self._put(*(c[old] for c in before))
        self._put(keys, told[:, 0], told[:, 1])

    def _step(self, now: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = now.astype(np.int64) * 512 + symbol
        at = self._places(keys)
        missing = self.keys[at] != keys
        if missing.any():
            self._learn(now[missing], symbol[missing])
            at = self._places(keys)
        return self.next[at], self.emit[at]
