"""Token ids of text through distinct pre-tokens, each of which is encoded once per task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from nameshift.llm.buffers import Interner, RaggedTable, pre_tokens

_MULT = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Looks up values of symbol pairs in an open hash table of numpy arrays; -1 where there is none."""

    def __init__(self, left: np.ndarray, right: np.ndarray, values: np.ndarray):
        self.bits = max(8, int(2 * len(left)).bit_length() + 1)
        self.keys = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.full(1 << self.bits, -1, np.int32)
        keys, values = self._key(left, right), np.asarray(values, np.int32)
        slot = self._slot(keys)
        while keys.size:
            free = self.values[slot] < 0
            self.keys[slot[free]], self.values[slot[free]] = keys[free], values[free]
            left_over = self.keys[slot] != keys
            keys, values = keys[left_over], values[left_over]
            slot = (slot[left_over] + 1) & (len(self.keys) - 1)

    @staticmethod
    def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULT) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = self._key(a, b).ravel()
        slot = self._slot(keys)
        found = self.values[slot]
        wrong = np.flatnonzero((found >= 0) & (self.keys[slot] != keys))
        while wrong.size:
            slot[wrong] = (slot[wrong] + 1) & (len(self.keys) - 1)
            found[wrong] = self.values[slot[wrong]]
            wrong = wrong[(found[wrong] >= 0) & (self.keys[slot[wrong]] != keys[wrong])]
        return found.reshape(np.shape(a))


class PieceTable:
    """Maps text to ragged values of its pre-tokens.

    ``encode`` gets distinct pre-tokens and returns their values and how many each has. ``special`` strings are
    taken out of the text before it is split, and are given to ``encode`` whole.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], special: tuple[bytes, ...] = (), dtype=np.int32, limit: int = 1 << 18):
        self.encode, self.special = encode, tuple(s for s in special if s)
        self.interner, self.table = Interner(limit), RaggedTable(dtype)

    def _special_spans(self, data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int]]:
        raw, spans = data.tobytes() if self.special else b"", []
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                if offs[np.searchsorted(offs, at, "right")] >= at + len(s):
                    spans.append((at, at + len(s)))
                    at = raw.find(s, at + len(s))
                else:
                    at = raw.find(s, at + 1)
        spans.sort(key=lambda x: (x[0], -x[1]))
        out: list[tuple[int, int]] = []
        for a, b in spans:
            if not out or a >= out[-1][1]:
                out.append((a, b))
        return out

    def pieces(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pre-tokens, and their offsets by row."""
        if self.interner.full:
            self.interner.reset()
            self.table.clear()
        if spans := self._special_spans(data, offs):
            cuts = np.array(spans, np.int64)
            starts = pre_tokens(data, np.unique(np.concatenate([offs, cuts.ravel()])))
            inside = np.searchsorted(cuts[:, 0], starts, "left") - 1
            starts = starts[(inside < 0) | (starts >= cuts[inside, 1])]
        else:
            starts = pre_tokens(data, offs)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        numbers, fresh = self.interner.intern(data, starts, ends - starts)
        if fresh:
            self.table.extend(*self.encode(fresh))
        return numbers, np.searchsorted(starts, offs)

    def ids(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of all rows, and their offsets by row."""
        numbers, by_row = self.pieces(data, offs)
        values, ends = self.table.take(numbers)
        return values, ends[by_row]
