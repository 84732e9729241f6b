"""Periodic runs of words in whole texts, by string synchronising sets at dyadic scales.

Method: at scale T (8, 16, 32, ...) a window of T words has a hash, and positions whose window is highly periodic (period up
to T/4) are set aside. A position belongs to the synchronising set if, among its own and the next T windows that are
not set aside, the least hash is that of the first or the last one. Membership depends on the next 2T words only, so
equal contexts of 2T words are members alike; and of any T neighbouring positions one is a member, unless all of the stretch is highly
periodic. Hence a run with period p, T <= p < 2T, and at least 4p words holds a member whose context comes again p words on,
and not before: neighbours with equal contexts and a distance from T to 2T - 1 propose their distance as a period. Proposals that
overlap are one; each is extended word by word to the whole run, which also verifies it. Periods below 8 are omitted by these
scales. They come from the highly periodic regions, which are found directly, as are the windows set aside at each scale: a
window with period up to T/4 lies in a run of at least four periods that a smaller scale has found.

Every scale takes time in proportion to the words of texts that are long enough for it. Words are compared by exact numbers;
hashes of contexts have 64 bits. Texts stay where they are: no shuffle; memory follows the slice of about 2 MB, or the longest text.

Defined results: a null, empty or wordless text has no words, no runs, and the hashes of the empty text. Null keys stay, and such
rows are not rewritten. Repeated rows give equal results. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from nameshift.llm.buffers import Interner, mix, ragged_take, slices, words
from nameshift.llm.frames import small_batches

#: A run has at least so many words, and at least so many periods.
LEAST, PERIODS = 6, 4
#: The first scale; smaller periods are found directly.
FIRST = 8
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_CELLS = 1 << 20
_CHUNK = 1 << 16

#: Starts, ends and periods.
Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


def _long_enough(starts: np.ndarray, ends: np.ndarray, periods: np.ndarray) -> Runs:
    ok = ends - starts >= np.maximum(LEAST, PERIODS * periods)
    return starts[ok], ends[ok], periods[ok]


def _distinct(found: list[Runs]) -> Runs:
    """Each stretch once, with its smallest period, by start and period."""
    s, e, p = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((p, e, s))
    s, e, p = s[order], e[order], p[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    s, e, p = s[new], e[new], p[new]
    order = np.lexsort((p, s))
    return s[order], e[order], p[order]


def small_periods(ids: np.ndarray, end: np.ndarray) -> Runs:
    """Runs with periods below ``FIRST``: the stretches in which every word comes again after the period."""
    found: list[Runs] = [(np.zeros(0, np.int64),) * 3]
    at = np.arange(len(ids))
    for p in range(1, min(FIRST, len(ids))):
        same = np.zeros(len(ids) - p + 2, np.int8)
        same[1:-1] = (ids[:-p] == ids[p:]) & (at[p:] < end[:-p])
        change = np.diff(same)
        starts, stops = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        found.append(_long_enough(starts, stops + p, np.full(len(starts), p)))
    return _distinct(found)


def _window_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values, for every start of a whole window."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, _LAST)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def synchronising_set(h: np.ndarray, aside: np.ndarray, end: np.ndarray, scale: int) -> np.ndarray:
    """Positions of the set at ``scale``. ``h`` are hashes of windows of ``scale`` words, ``end`` the end of each position's text."""
    if len(h) <= scale:
        return np.zeros(0, np.int64)
    value = np.where(aside, _LAST, np.minimum(h, _LAST - np.uint64(1)))
    least = _window_least(value, scale + 1)
    m = len(least)
    hit = (least != _LAST) & ((value[:m] == least) | (value[scale : scale + m] == least)) & (np.arange(m) + 2 * scale <= end[:m])
    return np.flatnonzero(hit)


def _matching(ids: np.ndarray, at: np.ndarray, p: np.ndarray, edge: np.ndarray, step: int) -> np.ndarray:
    """How many words from ``at`` on, in the direction of ``step``, equal the word ``p`` further; ``edge`` bounds the text."""
    out = np.zeros(len(at), np.int64)
    live, width = np.arange(len(at)), 32
    while live.size:
        left = []
        for rows in np.array_split(live, -(-live.size * width // _CELLS)):
            x = (at[rows] + step * out[rows])[:, None] + step * np.arange(width)
            inside = x + p[rows, None] < edge[rows, None] if step > 0 else x >= edge[rows, None]
            x = np.clip(x, 0, len(ids) - 1)
            same = inside & (ids[x] == ids[np.minimum(x + p[rows, None], len(ids) - 1)])
            whole = same.all(axis=1)
            out[rows] += np.where(whole, width, same.argmin(axis=1))
            left.append(rows[whole])
        live, width = np.concatenate(left), min(2 * width, _CELLS)
    return out


def proposals(members: np.ndarray, contexts: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """First positions and periods that equal contexts propose; overlapping ones with one period are one."""
    order = np.argsort(contexts, kind="stable")
    at, context = members[order], contexts[order]
    far = np.diff(at)
    pair = np.flatnonzero((context[1:] == context[:-1]) & (far >= scale) & (far < 2 * scale))
    at, p = at[pair], far[pair]
    order = np.lexsort((at, p))
    at, p = at[order], p[order]
    new = np.ones(len(at), bool)
    new[1:] = (p[1:] != p[:-1]) | (at[1:] - at[:-1] >= 2 * scale)
    return at[new], p[new]


def runs(ids: np.ndarray, offs: np.ndarray) -> Runs:
    """All runs of the texts whose words ``ids`` lie between ``offs``; positions count from the first text on."""
    sizes = np.diff(offs)
    begin, end = np.repeat(offs[:-1], sizes), np.repeat(offs[1:], sizes)
    found = [small_periods(ids, end)]
    scale = 1
    kept, where = np.arange(len(sizes)), np.arange(len(ids))
    h = mix((ids.astype(np.uint64) + np.uint64(1)) * _A)
    part = offs
    while True:
        if scale >= FIRST:
            long = np.flatnonzero(np.diff(part) >= PERIODS * scale)
            if not long.size:
                return _distinct(found)
            if long.size < len(kept):
                kept = kept[long]
                h, new = ragged_take(h, part, long)
                where, part = ragged_take(where, part, long)[0], new
        doubled = np.zeros_like(h)
        doubled[: len(h) - scale] = mix(h[: len(h) - scale] * _A + (h[scale:] ^ (h[scale:] >> np.uint64(29))) * _B) if len(h) > scale else 0
        if scale >= FIRST:
            local_end = np.repeat(part[1:], np.diff(part))
            s, e, p = (np.concatenate(x) for x in zip(*found, strict=True))
            periodic = (p <= scale // PERIODS) & (e - s >= scale)
            edges = np.zeros(len(h) + 1, np.int64)
            s, e = s[periodic], e[periodic]
            if s.size:
                # the text of a run may have left this scale
                text = np.searchsorted(offs, s, "right") - 1
                slot = np.searchsorted(kept, text)
                there = (slot < len(kept)) & (kept[np.minimum(slot, len(kept) - 1)] == text)
                shift = part[slot[there]] - offs[text[there]]
                np.add.at(edges, s[there] + shift, 1)
                np.add.at(edges, e[there] + shift - scale + 1, -1)
            aside = np.cumsum(edges)[:-1] > 0
            members = synchronising_set(h, aside, local_end, scale)
            at, q = proposals(members, doubled[members], scale)
            if at.size:
                at = where[at]
                right = _matching(ids, at, q, end[at], 1)
                left = _matching(ids, at - 1, q, begin[at], -1)
                found.append(_long_enough(at - left, at + right + q, q))
        h, scale = doubled, 2 * scale


def planted(h: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Which word stands at each place, after every text whose number ``h`` ends in 0 is made periodic from some place on; -1: no number."""
    source = np.arange(offs[-1])
    for k in np.flatnonzero((h >= 0) & (h % 10 == 0) & (np.diff(offs) > 0)).tolist():
        n, g = int(offs[k + 1] - offs[k]), int(h[k]) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        source[offs[k] + a : offs[k + 1]] = offs[k] + a + np.arange(n - a) % p
    return source


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[bytes]:
    """The words, one blank between them, in bounded pieces."""
    for k in range(0, len(starts), _CHUNK):
        s, n = starts[k : k + _CHUNK], (ends - starts)[k : k + _CHUNK]
        offs = np.concatenate([[0], np.cumsum(n + 1)])
        out = np.full(offs[-1], 0x20, np.uint8)
        own = np.repeat(np.arange(len(s)), n)
        k_in = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        out[offs[own] + k_in] = data[s[own] + k_in]
        yield out[: len(out) - (k + _CHUNK >= len(starts))].tobytes()


_EMPTY = hashlib.sha256(b"").hexdigest()
RESULT = "doc_id {key}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>"


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", plant: bool = False) -> DataFrame:
    """Per row: the number of runs, the one of greatest exponent, hashes of all runs and of the text without repeated periods, and ``runs``.

    A run is a stretch of words with smallest period q and at least max(6, 4q) words that cannot be extended. ``plant`` rewrites a tenth of the
    texts first (see ``planted``), decided by the crc32 of the key.
    """
    number = F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) if plant else F.lit(None).cast("long")
    source = docs.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(number, F.lit(-1)).alias("h"), F.col(f"`{text}`").alias("t"))
    schema = RESULT.format(key=docs.schema[key].dataType.simpleString())
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs"]
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Interner()
        for batch in batches:
            for i, j, data, at in slices(batch.column(2)):
                if table.full:
                    table.reset()
                starts, ends, offs = words(data, at)
                ids, _ = table.intern(data, starts, ends - starts)
                place = planted(np.asarray(batch.column(1).slice(i, j - i)), offs)
                ids, starts, ends = ids[place], starts[place], ends[place]
                s, e, p = runs(ids, offs)
                edges = np.zeros(len(ids) + 1, np.int64)
                np.add.at(edges, s + p, 1)
                np.add.at(edges, e, -1)
                stays = np.cumsum(edges)[:-1] == 0
                begin = np.searchsorted(s, offs)
                best: list[tuple] = []
                sums, whole, lists = [], [], []
                for k in range(j - i):
                    own = [(int(s[r] - offs[k]), int(e[r] - s[r]), int(p[r])) for r in range(begin[k], begin[k + 1])]
                    lists.append([{"start": x, "length": n, "period": q} for x, n, q in own])
                    if own:
                        x, n, q = min(own, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
                        best.append((x, n, q, 1000 * n // q))
                        sums.append(hashlib.sha256("".join(f"{x},{n},{q}\n" for x, n, q in own).encode()).hexdigest())
                    else:
                        best.append((None, None, None, None))
                        sums.append(_EMPTY)
                    digest = hashlib.sha256()
                    kept = offs[k] + np.flatnonzero(stays[offs[k] : offs[k + 1]])
                    for piece in _joined(data, starts[kept], ends[kept]):
                        digest.update(piece)
                    whole.append(digest.hexdigest())
                columns = [pa.array(c, pa.int64()) for c in (zip(*best, strict=True) if best else ((),) * 4)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(begin).astype(np.int64)), *columns, pa.array(sums), pa.array(whole), pa.array(lists, run_type)], names)

    return small_batches(source).mapInArrow(run, schema)
