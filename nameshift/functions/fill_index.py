"""Counted neighbours as mapped arrays: numbering of tokens, counting of pairs, lists of neighbours, and the fills of gaps from them.

A token's number is its place among all tokens by their bytes, so numbers order as texts do; the empty string, which marks both ends of a
text, has number 0. What belongs to number ``i`` lies in part ``i % n`` at place ``i // n``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from nameshift.functions.shared_arrays import CHUNK, arrays, deal, forget, read_dealt, slices, write_arrays, write_dealt

MICRO = 1_000_000
SIGNATURE_BITS = 32
#: Counts from this one on lie apart, with their places.
LARGE = 255
#: List entries that are merged at once; an entry's place and score are parts of one sorted number.
ENTRIES = 1 << 19
PLACE_BITS, SCORE_BITS = 22, 27


def pair_scores(counts: np.ndarray) -> np.ndarray:
    """The score of a counted pair, in micro-units; a pair that was never seen has none."""
    return np.floor(np.log1p(counts) * MICRO + 0.5).astype(np.int64)


def _row(**values) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({name: [value] for name, value in values.items()})


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - sizes), sizes)


def _ends(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both tokens of counted pairs: the place of the first one in its part, and the number of the second."""
    return keys >> 32, keys & 0xFFFFFFFF


def _row_ends(rows: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(rows, np.arange(n + 1)).astype(np.int64)


def _small(counts: np.ndarray, name: str = "c") -> dict[str, np.ndarray]:
    large = np.flatnonzero(counts >= LARGE)
    return {name: np.minimum(counts, LARGE).astype(np.uint8), f"{name}_large_at": large, f"{name}_large": counts[large].astype(np.int64)}


def _counts(file: dict[str, np.ndarray], at: np.ndarray | slice, name: str = "c") -> np.ndarray:
    out = file[name][at].astype(np.int64)
    large = np.flatnonzero(out == LARGE)
    if len(large):
        at = large + (at.start or 0) if isinstance(at, slice) else at[large]
        out[large] = file[f"{name}_large"][np.searchsorted(file[f"{name}_large_at"], at)]
    return out


@dataclass(frozen=True)
class Vocabulary:
    """Files of tokens: by number, each from one of ``starts`` on, and by hash."""

    words: tuple[str, ...]
    starts: tuple[int, ...]
    hashes: tuple[str, ...] = ()

    @property
    def size(self) -> int:
        return self.starts[-1]

    def _by_file(self, numbers: np.ndarray) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]]:
        part = np.searchsorted(self.starts, numbers, "right") - 1
        for p, at in deal(part, len(self.words)):
            yield arrays(self.words[p]), at, numbers[at] - self.starts[p]

    def column(self, name: str, numbers: np.ndarray) -> np.ndarray:
        out = np.zeros(len(numbers), np.bool_ if name == "valid" else np.int64)
        for file, at, own in self._by_file(numbers):
            out[at] = file[name][own]
        return out

    def texts(self, numbers: np.ndarray) -> pa.Array:
        """Each distinct token is read once."""
        distinct, at = np.unique(numbers, return_inverse=True)
        found = [pa.array([], pa.string())]
        for file, _, own in self._by_file(distinct):
            ends = file["ends"]
            texts = pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(file["text"])])
            found.append(texts.take(pa.array(own)).cast(pa.string()))
        return pa.concat_arrays(found).take(pa.array(at))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """-1 for a token that was never seen."""
        distinct, at = np.unique(hashes, return_inverse=True)
        out = np.full(len(distinct), -1, np.int64)
        n = len(self.hashes)
        for p, own in deal((distinct.view(np.uint64) % np.uint64(n)).astype(np.int64), n):
            file = arrays(self.hashes[p])
            place = np.searchsorted(file["hash"], distinct[own])
            place = np.minimum(place, len(file["hash"]) - 1)
            if len(file["hash"]):
                out[own] = np.where(file["hash"][place] == distinct[own], file["number"][place], -1)
        return out[at]


def word_files(batches: Iterator[pa.RecordBatch], folder: str, partition: int) -> Iterator[pa.RecordBatch]:
    """Rows ``tok, hash, right, left, valid`` sorted by token, as one file: ``partition, n, place``."""
    forget()
    filled = [b for b in batches if b.num_rows]
    if not filled:
        return
    toks = pa.concat_arrays([b.column(0).cast(pa.large_string()) for b in filled])
    _, ends, text = toks.buffers()
    ends = np.frombuffer(ends, np.int64, len(toks) + 1)
    hashes, right, left, valid = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in filled]) for i in range(1, 5))
    place = write_arrays(
        folder,
        {"ends": ends, "text": np.frombuffer(text or b"", np.uint8)[: ends[-1]], "hash": hashes, "R": right.astype(np.uint32), "L": left.astype(np.uint32), "valid": valid.astype(bool)},
    )
    yield _row(partition=partition, n=len(toks), place=place)


def hash_files(parts: Iterator[int], vocabulary: Vocabulary, n: int, folder: str) -> Iterator[pa.RecordBatch]:
    """Numbers by hash: every part holds the hashes with one remainder, sorted."""
    for p in parts:
        hashes, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for place, start in zip(vocabulary.words, vocabulary.starts, strict=False):
            found = arrays(place)["hash"]
            at = np.flatnonzero(found.view(np.uint64) % np.uint64(n) == np.uint64(p))
            hashes.append(found[at])
            numbers.append(at + start)
        hashes, numbers = np.concatenate(hashes), np.concatenate(numbers)
        order = np.argsort(hashes)
        yield _row(part=p, place=write_arrays(folder, {"hash": hashes[order], "number": numbers[order].astype(np.int32)}))


def _count_chunk(lists: list[pa.Array], vocabulary: Vocabulary, n: int, folder: str) -> str:
    toks = np.concatenate([np.asarray(x.flatten()) for x in lists])
    sizes = np.concatenate([np.asarray(x.value_lengths()) for x in lists]).astype(np.int64)
    # every text stands between two ends
    texts = np.zeros(len(toks) + 2 * len(sizes), np.int64)
    begins = np.cumsum(sizes + 2) - sizes - 2
    texts[_ranges(begins + 1, sizes)] = vocabulary.numbers(toks)
    inner = np.ones(max(len(texts) - 1, 0), bool)
    inner[begins[1:] - 1] = False
    keys, counts = np.unique(((texts[:-1] << 32) | texts[1:])[inner], return_counts=True)
    a = keys >> 32
    return write_dealt(folder, n, a % n, [a // n, keys & 0xFFFFFFFF, counts])


def pair_chunks(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, n: int, folder: str) -> Iterator[pa.RecordBatch]:
    """Hashes of texts' tokens to files of counted pairs, dealt by their first token."""
    forget()
    waiting, held = [], 0
    for batch in batches:
        lists = batch.column(0)
        for part in slices(lists.filter(lists.is_valid())):
            waiting.append(part)
            held += len(part.flatten()) + len(part)
            if held >= CHUNK:
                yield _row(uri=_count_chunk(waiting, vocabulary, n, folder))
                waiting, held = [], 0
    if waiting:
        yield _row(uri=_count_chunk(waiting, vocabulary, n, folder))


def pair_files(parts: Iterator[int], chunks: list[str], folder: str) -> Iterator[pa.RecordBatch]:
    """Counted pairs by their first token, sorted."""
    for p in parts:
        row, b, c = read_dealt(chunks, p, 3)
        key = (row.astype(np.int64) << 32) | b
        order = np.argsort(key, kind="stable")
        key = key[order]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        c = np.add.reduceat(c[order].astype(np.int64), at) if len(at) else c.astype(np.int64)
        yield _row(part=p, place=write_arrays(folder, {"key": key[at]} | _small(c)))


def dealt_files(parts: Iterator[int], pairs: "Pairs", folder: str) -> Iterator[pa.RecordBatch]:
    """The counted pairs dealt by their second token."""
    n = pairs.n
    for p in parts:
        file = arrays(pairs.files[p])
        row, b = _ends(file["key"])
        order = np.argsort(b, kind="stable")
        row, b = row[order], b[order]
        yield _row(part=p, place=write_dealt(folder, n, b % n, [b // n, row * n + p, _counts(file, slice(None))[order]]))


def _votes(rows: np.ndarray, counts: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Per row and bit, the counts of neighbours whose bit is 0 less those whose bit is 1; rows are sorted."""
    out = np.zeros((n, SIGNATURE_BITS), np.int64)
    at = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])[: len(rows)])
    if len(at):
        for i in range(SIGNATURE_BITS):
            out[rows[at], i] = np.add.reduceat(counts * (1 - 2 * ((hashes >> i) & 1)), at)
    return out


def _best(rows: np.ndarray, numbers: np.ndarray, counts: np.ndarray, k: int, n: int, side: str) -> dict[str, np.ndarray]:
    """The ``k`` most frequent neighbours of every row, equal ones by text, kept by number; rows are sorted, and numbers in each row."""
    at = np.flatnonzero(numbers)
    rows, numbers, counts = rows[at], numbers[at], counts[at]
    sizes = np.bincount(rows, minlength=n)
    long = np.flatnonzero(sizes[rows] > k)
    keep = np.ones(len(rows), bool)
    order = long[np.lexsort((-counts[long], rows[long]))]
    begins = np.searchsorted(rows[order], rows[order])
    keep[order[np.arange(len(order)) - begins >= k]] = False
    rows = rows[keep]
    return {f"{side}_ends": _row_ends(rows, n), f"{side}_id": numbers[keep].astype(np.int32)} | _small(counts[keep], f"{side}_n")


def list_files(parts: Iterator[int], vocabulary: Vocabulary, pairs: "Pairs", dealt: list[str], k: int, folder: str) -> Iterator[pa.RecordBatch]:
    """What is known of every token: how often it occurs, its signature, and its most frequent neighbours on either side."""
    for p in parts:
        file, n = arrays(pairs.files[p]), pairs.n
        size = -(-(vocabulary.size - p) // n)
        (after, b), count = _ends(file["key"]), _counts(file, slice(None))
        before, a, seen = (x.astype(np.int64) for x in read_dealt(dealt, p, 3))
        order = np.lexsort((a, before))
        before, a, seen = before[order], a[order], seen[order]
        votes = _votes(after, count, vocabulary.column("R", b), size) + _votes(before, seen, vocabulary.column("L", a), size)
        sig = ((votes >= 0) << np.arange(SIGNATURE_BITS)).sum(1).astype(np.uint32)
        total = np.bincount(after, count, size).astype(np.int64)
        found = _best(after, b, count, k, size, "after") | _best(before, a, seen, k, size, "before")
        yield _row(part=p, place=write_arrays(folder, {"n": total, "sig": sig} | found))


@dataclass(frozen=True)
class Pairs:
    """Files of counted pairs, by first token."""

    files: tuple[str, ...]

    @property
    def n(self) -> int:
        return len(self.files)

    def counts(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How often each pair was seen."""
        out, n = np.zeros(len(a), np.int64), self.n
        for p, at in deal(a % n, n):
            file = arrays(self.files[p])
            keys, want = file["key"], (a[at] // n << 32) | b[at]
            place = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            hit = np.flatnonzero(keys[place] == want) if len(keys) else np.zeros(0, np.int64)
            out[at[hit]] = _counts(file, place[hit])
        return out


@dataclass(frozen=True)
class FillIndex:
    """All that the fills of a gap need. Bit i of a token's signature is set when its counted neighbours vote non-negative; votes are whole
    numbers, so the result is exact."""

    vocabulary: Vocabulary
    pairs: Pairs
    lists: tuple[str, ...]
    k: int
    weights: tuple[str, ...] = ()

    def _column(self, files: tuple[str, ...], name: str, numbers: np.ndarray) -> np.ndarray:
        """A value per token; 0 for one that was never seen."""
        out, n = np.zeros(len(numbers), np.int64), len(self.lists)
        known = np.flatnonzero(numbers >= 0)
        for p, at in deal(numbers[known] % n, n):
            at = known[at]
            out[at] = arrays(files[p])[name][numbers[at] // n]
        return out

    def signatures(self, numbers: np.ndarray) -> np.ndarray:
        return self._column(self.lists, "sig", numbers)

    def weight(self, numbers: np.ndarray) -> np.ndarray:
        return self._column(self.weights, "w", numbers)

    def _side(self, numbers: np.ndarray, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lists of tokens: owner, entries, counts, by owner and entry, and the size of each list."""
        n = len(self.lists)
        sizes, begins = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
        known = np.flatnonzero(numbers >= 0)
        found = []
        for p, at in deal(numbers[known] % n, n):
            at, file = known[at], arrays(self.lists[p])
            row, ends = numbers[at] // n, file[f"{side}_ends"]
            begins[at], sizes[at] = ends[row], ends[row + 1] - ends[row]
            found.append((at, file))
        to = np.cumsum(sizes) - sizes
        entries, counts = np.zeros(sizes.sum(), np.int64), np.zeros(sizes.sum(), np.int64)
        for at, file in found:
            source, target = _ranges(begins[at], sizes[at]), _ranges(to[at], sizes[at])
            entries[target], counts[target] = file[f"{side}_id"][source], _counts(file, source, f"{side}_n")
        return np.repeat(np.arange(len(numbers)), sizes), entries, counts, sizes

    def fills(self, prev: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ``k`` best fills of every gap: owner, token, score; best first, equal scores by token."""
        owner, a, ahead, sizes_a = self._side(prev, "after")
        owner_b, b, behind_b, sizes_b = self._side(following, "before")
        key_a, key_b = (owner << 32) | a, (owner_b << 32) | b
        # both lists are in order, so a place in the one tells whether an entry is in both
        place = np.searchsorted(key_a, key_b)
        both = np.zeros(len(key_b), bool)
        both[inside] = key_a[place[inside]] == key_b[inside] if len(inside := np.flatnonzero(place < len(key_a))) else False
        behind = np.zeros(len(a), np.int64)
        behind[place[both]] = behind_b[both]
        single = np.ones(len(a), bool)
        single[place[both]] = False
        # a list that is not full holds all neighbours: what it lacks was never seen there
        look = np.flatnonzero(single & (sizes_b == self.k)[owner])
        behind[look] = self.pairs.counts(a[look], following[owner[look]])
        alone = np.flatnonzero(~both)
        owner_b, b, behind_b, place = owner_b[alone], b[alone], behind_b[alone], place[alone]
        ahead_b = np.zeros(len(b), np.int64)
        look = np.flatnonzero((sizes_a == self.k)[owner_b])
        ahead_b[look] = self.pairs.counts(prev[owner_b[look]], b[look])
        total = len(a) + len(b)
        at_b = place + np.arange(len(b))
        at_a = np.ones(total, bool)
        at_a[at_b] = False
        owners, toks, score = (np.empty(total, np.int64) for _ in range(3))
        owners[at_b], toks[at_b], score[at_b] = owner_b, b, pair_scores(ahead_b) + pair_scores(behind_b)
        owners[at_a], toks[at_a], score[at_a] = owner, a, pair_scores(ahead) + pair_scores(behind)
        keys = np.sort(((owners << SCORE_BITS) + (1 << SCORE_BITS) - 1 - score << PLACE_BITS) | np.arange(total))
        owners = keys >> SCORE_BITS + PLACE_BITS
        left = np.arange(total) - np.searchsorted(owners, np.arange(len(prev)))[owners] < self.k
        best = keys[left] & (1 << PLACE_BITS) - 1
        return owners[left], toks[best], score[best]

    def numbers(self, toks: pa.Array) -> np.ndarray:
        """Rows of the hashes of a gap's name and its two neighbours, as three columns of numbers."""
        return self.vocabulary.numbers(np.asarray(toks.flatten())).reshape(-1, 3).T

    def similar(self, toks: pa.Array) -> "Similar":
        """The fills of gaps by the distance of their signature to that of the name; equal ones keep the order of the fills."""
        name, prev, following = self.numbers(toks)
        ends, gap = np.unique((prev + 1 << 32) | (following + 1), return_inverse=True)
        owner, tok, score = self.fills((ends >> 32) - 1, (ends & 0xFFFFFFFF) - 1)
        sig = self.signatures(tok)
        sizes, begins = np.bincount(owner, minlength=len(ends)), np.searchsorted(owner, np.arange(len(ends)))
        at = _ranges(begins[gap], sizes[gap])
        owner = np.repeat(np.arange(len(gap)), sizes[gap])
        dist = np.bitwise_count(sig[at] ^ self.signatures(name)[owner])
        first = np.cumsum(sizes[gap]) - sizes[gap]
        keys = np.sort(((owner << 8) | dist) << PLACE_BITS | (np.arange(len(owner)) - first[owner]))
        index = keys & (1 << PLACE_BITS) - 1
        at = at[first[owner] + index]
        return Similar(owner, tok[at], score[at], (keys >> PLACE_BITS) & 255, index, sizes[gap])


@dataclass(frozen=True)
class Similar:
    """Fills of gaps, the most similar first: their gap, token, score, distance, place among the fills; and how many a gap has."""

    owner: np.ndarray
    tok: np.ndarray
    score: np.ndarray
    dist: np.ndarray
    index: np.ndarray
    sizes: np.ndarray


def gap_slices(batch: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose lists hold a bounded number of entries, one row at least."""
    step = max(1, ENTRIES // (2 * k))
    for begin in range(0, batch.num_rows, step):
        yield batch.slice(begin, step)


def pair_rows(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, n: int) -> Iterator[pa.RecordBatch]:
    """Files of pairs, by part and place, as rows ``a, b, c``."""
    for batch in batches:
        for p, place in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
            file = arrays(place)
            for begin in range(0, len(file["key"]), ENTRIES):
                part = slice(begin, begin + ENTRIES)
                row, b = _ends(file["key"][part])
                yield pa.RecordBatch.from_pydict({"a": vocabulary.texts(row * n + p), "b": vocabulary.texts(b), "c": pa.array(_counts(file, part))})


def word_rows(parts: Iterator[int], vocabulary: Vocabulary, lists: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """``tok, n, sig`` of every token."""
    for p in parts:
        file = arrays(lists[p])
        numbers = np.arange(len(file["n"])) * len(lists) + p
        at = np.flatnonzero(numbers)
        yield pa.RecordBatch.from_pydict({"tok": vocabulary.texts(numbers[at]), "n": pa.array(file["n"][at]), "sig": pa.array(file["sig"][at].astype(np.int64))})


def numbered(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, n: int) -> Iterator[pa.RecordBatch]:
    """Rows ``hash, w`` as ``part, number, w``."""
    for batch in batches:
        numbers = vocabulary.numbers(np.asarray(batch.column(0)))
        yield pa.RecordBatch.from_pydict({"part": pa.array(numbers % n), "number": pa.array(numbers), "w": batch.column(1)})


def weight_files(batches: Iterator[pa.RecordBatch], size: int, n: int, folder: str) -> Iterator[pa.RecordBatch]:
    """Rows ``part, number, w`` sorted by part, a file for each part."""
    table = [np.concatenate(x) for x in zip(*([np.asarray(c) for c in b.columns] for b in batches), strict=True)]
    if table:
        parts, numbers, weights = table
        for p in np.unique(parts):
            own = parts == p
            w = np.zeros(-(-(size - p) // n), np.int64)
            w[numbers[own] // n] = weights[own]
            yield _row(part=int(p), place=write_arrays(folder, {"w": w}))


def all_parts(rows: list, n: int) -> tuple[str, ...]:
    """The files of all parts; one without rows has none, and is not asked."""
    found = {r["part"]: r["place"] for r in rows}
    return tuple(found.get(p, "") for p in range(n))
