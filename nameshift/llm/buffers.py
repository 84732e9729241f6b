"""Batches of text as flat byte arrays: spans, exact interning of spans, and hashes.

Every function works on a whole Arrow batch at once. Nulls are read as empty text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: Bytes 0x20 and 0x09 to 0x0D separate words.
WORD_BREAK = np.zeros(256, bool)
WORD_BREAK[[0x20, *range(0x09, 0x0E)]] = True
#: Text is worked on in slices of about so many bytes; a longer document is a slice of its own.
SLICE_BYTES = 2 << 20
#: The strings over 16 bytes that an interner holds may take so many bytes.
LONG_BYTES = 32 << 20

_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def as_binary(column: pa.Array) -> pa.Array:
    """A string column as large binary, nulls as empty values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    return pc.fill_null(column, b"") if column.null_count else column


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column, and where each row begins (one more than rows)."""
    column = as_binary(column)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows holding about ``size`` bytes."""
    data, offs = flat(column)
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)


def row_starts(offs: np.ndarray, size: int) -> np.ndarray:
    """A flag at the first byte of every row that has one."""
    first = np.zeros(size + 1, bool)
    first[offs[:-1]] = True
    return first[:size]


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each row the number of words before it (one more than rows)."""
    ink = ~WORD_BREAK[data]
    first = row_starts(offs, len(data))
    before = np.empty_like(ink)
    before[:1] = False
    before[1:] = ink[:-1]
    starts = np.flatnonzero(ink & (~before | first))
    after = np.zeros_like(ink)
    after[:-1] = ink[1:] & ~first[1:]
    ends = np.flatnonzero(ink & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Letter, number, white space or other, by code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, points):
            table[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    return table


def char_classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    table = classes()
    kind = table[data]
    if not (high := np.flatnonzero(data >= 0xC0)).size:
        return kind
    padded = np.zeros(len(data) + 4, np.uint32)
    padded[: len(data)] = data
    a, b, c, d = (padded[high + k] for k in range(4))
    length = np.where(a < 0xE0, 2, np.where(a < 0xF0, 3, 4))
    low = np.uint32(0x3F)
    point = np.where(
        length == 2,
        (a & 0x1F) << 6 | (b & low),
        np.where(
            length == 3,
            (a & 0x0F) << 12 | (b & low) << 6 | (c & low),
            (a & 0x07) << 18 | (b & low) << 12 | (c & low) << 6 | (d & low),
        ),
    )
    of = table[np.minimum(point, 0x10FFFF)]
    for k in range(4):
        has = length > k
        kind[np.minimum(high[has] + k, len(data) - 1)] = of[has]
    return kind


def pre_tokens(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Starts of the matches of ``public_tokenizers.PATTERN`` in every row; each ends where the next begins.

    A run of one class is a match. White space before a run gives its last character away: a blank joins the
    run, another character stands alone. An apostrophe that no blank precedes takes ``s t re ve m ll d`` along.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = char_classes(data)
    first = row_starts(offs, n)
    char = (data & 0xC0) != 0x80
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    gap = kind == SPACE
    run = np.flatnonzero(start & ~gap & ~first)  # runs with something before them in the row
    run = run[gap[run - 1]]
    if run.size:
        last = run - 1  # the white space character before the run
        while (inner := ~char[last]).any():
            last = last - inner
        start[last] = True
        start[run[data[run - 1] == 0x20]] = False
    quotes = np.flatnonzero(start & (data == 0x27))
    if quotes.size:
        end = np.searchsorted(offs, quotes, "right")
        left = offs[end] - quotes
        padded = np.zeros(n + 3, np.uint8)
        padded[:n] = data
        a, b = padded[quotes + 1], padded[quotes + 2]
        one = (left >= 2) & np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = (left >= 3) & (((a == 0x72) & (b == 0x65)) | ((a == 0x76) & (b == 0x65)) | ((a == 0x6C) & (b == 0x6C)))
        for taken, length in ((one, 2), (two & ~one, 3)):
            at = quotes[taken]
            start[at + 1] = False
            at = at + length
            at = at[at < n]
            start[at[kind[at] == LETTER]] = True
    return np.flatnonzero(start)


def eights(data: np.ndarray) -> np.ndarray:
    """At every byte the eight bytes from there on, as a number; zeros beyond the end, and 17 more places."""
    n = len(data)
    x = np.zeros(n + 32, np.uint64)
    x[:n] = data
    for k, shift in ((1, 8), (2, 16), (4, 32)):
        x[:-k] |= x[k:] << np.uint64(shift)
    return x


def pack(x: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and second eight bytes of spans; ``x`` from ``eights``."""
    return x[starts] & _KEEP[np.minimum(lens, 8)], x[starts + 8] & _KEEP[np.clip(lens - 8, 0, 8)]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def hash_spans(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, the same in every task."""
    x = eights(data)
    w0, w1 = pack(x, starts, lens)
    h = mix(mix(w0 * _M1 + lens.astype(np.uint64) * _M3) ^ (w1 * _M2))
    at = np.flatnonzero(lens > 16)
    done = 16
    while at.size:
        w0, w1 = pack(x, starts[at] + done, lens[at] - done)
        h[at] = mix(mix(h[at] + w0 * _M1) ^ (w1 * _M2))
        done += 16
        at = at[lens[at] > done]
    return h


class Interner:
    """Numbers distinct byte strings from 0 on, exactly.

    Strings of up to 16 bytes lie in an open table of numpy arrays, longer ones in a dictionary. The caller
    empties it with ``reset`` when ``full``, so memory stays bounded whatever the vocabulary of the input.
    """

    def __init__(self, limit: int = 1 << 18):
        self.limit, self.bits = limit, max(limit, 2).bit_length() + 2
        self.reset()

    def reset(self) -> None:
        self.count = 0
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.w0, self.w1 = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)
        self.size = np.zeros(1024, np.int32)
        self.long: dict[bytes, int] = {}
        self.long_bytes = 0

    @property
    def full(self) -> bool:
        return self.count > self.limit or self.long_bytes > LONG_BYTES

    def _room(self, n: int) -> None:
        if (need := self.count + n) > len(self.w0):
            more = max(need, 2 * len(self.w0)) - len(self.w0)
            self.w0, self.w1, self.size = (np.concatenate([a, np.zeros(more, a.dtype)]) for a in (self.w0, self.w1, self.size))
        while need > len(self.slots) // 2:
            self.bits += 1
            self.slots = np.full(1 << self.bits, -1, np.int32)
            short = np.flatnonzero(self.size[: self.count] <= 16)
            slot = self._slot(self.w0[short], self.w1[short], self.size[short])
            while short.size:
                free = self.slots[slot] < 0
                self.slots[slot[free]] = short[free]
                left = self.slots[slot] != short
                short, slot = short[left], (slot[left] + 1) & (len(self.slots) - 1)

    def _slot(self, w0: np.ndarray, w1: np.ndarray, lens: np.ndarray) -> np.ndarray:
        h = (w0 * _M1) ^ (w1 * _M2) ^ (lens.astype(np.uint64) * _M3)
        h = (h ^ (h >> np.uint64(32))) * _MIX1
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def intern(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """Numbers of the spans, and the strings that got a new number, in its order."""
        n, known = len(starts), self.count
        out = np.full(n, -1, np.int64)
        at_first: list[np.ndarray] = []
        x = eights(data)
        raw = memoryview(np.ascontiguousarray(data))
        pend = np.flatnonzero(lens <= 16)
        self._room(0)
        w0, w1 = pack(x, starts[pend], lens[pend])
        size = lens[pend]
        slot = self._slot(w0, w1, size)
        while pend.size:
            seen = self.slots[slot]
            empty = seen < 0
            hit = ~empty & (self.w0[seen] == w0) & (self.w1[seen] == w1) & (self.size[seen] == size)
            out[pend[hit]] = seen[hit]
            if empty.any():
                new = np.flatnonzero(empty)
                self.slots[slot[new]] = np.arange(len(new)) + (1 << 30)
                won = new[self.slots[slot[new]] == np.arange(len(new)) + (1 << 30)]
                if self.count + len(won) > len(self.w0):
                    more = max(self.count + len(won), 2 * len(self.w0)) - len(self.w0)
                    self.w0, self.w1, self.size = (np.concatenate([a, np.zeros(more, a.dtype)]) for a in (self.w0, self.w1, self.size))
                ids = self.count + np.arange(len(won))
                self.slots[slot[won]] = ids
                self.w0[ids], self.w1[ids], self.size[ids] = w0[won], w1[won], size[won]
                self.count += len(won)
                out[pend[won]] = ids
                at_first.append(pend[won])
            left = out[pend] < 0
            slot = np.where(empty, slot, (slot + 1) & (len(self.slots) - 1))[left]
            pend, w0, w1, size = pend[left], w0[left], w1[left], size[left]
            if self.count > len(self.slots) // 2:
                self._room(0)
                slot = self._slot(w0, w1, size)
        fresh = [raw[s : s + k].tobytes() for at in at_first for s, k in zip(starts[at].tolist(), lens[at].tolist(), strict=True)]
        long = np.flatnonzero(lens > 16)
        if long.size:
            got = []
            for s, k in zip(starts[long].tolist(), lens[long].tolist(), strict=True):
                piece = raw[s : s + k].tobytes()
                if (i := self.long.get(piece)) is None:
                    i = self.long[piece] = self.count
                    self.long_bytes += k
                    self._room(1)
                    self.size[i] = k if k <= np.iinfo(np.int32).max else np.iinfo(np.int32).max
                    self.count += 1
                    fresh.append(piece)
                got.append(i)
            out[long] = got
        assert self.count - known == len(fresh)
        return out, fresh


def ragged_take(values: np.ndarray, offs: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the given rows of a ragged array, one after the other, and the offsets of the result."""
    lens = (offs[1:] - offs[:-1])[rows]
    ends = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(lens, out=ends[1:])
    at = np.repeat(offs[:-1][rows] - ends[:-1], lens) + np.arange(ends[-1])
    return values[at], ends


class RaggedTable:
    """Ragged rows that grow at the end."""

    def __init__(self, dtype):
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.rows, self.used = 0, 0
        self.values, self.offs = np.zeros(1024, self.dtype), np.zeros(1024, np.int64)

    def extend(self, values: np.ndarray, lens: np.ndarray) -> None:
        n, k = len(values), len(lens)
        if self.used + n > len(self.values):
            self.values = np.concatenate([self.values[: self.used], np.zeros(max(n, self.used) + 1024, self.dtype)])
        if self.rows + k + 1 > len(self.offs):
            self.offs = np.concatenate([self.offs[: self.rows + 1], np.zeros(max(k, self.rows) + 1024, np.int64)])
        self.values[self.used : self.used + n] = values
        self.offs[self.rows + 1 : self.rows + k + 1] = self.used + np.cumsum(lens)
        self.rows, self.used = self.rows + k, self.used + n

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return ragged_take(self.values, self.offs[: self.rows + 1], rows)
