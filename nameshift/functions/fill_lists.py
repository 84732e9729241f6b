"""Merging and ordering of lists, of fills per gap and of candidates per name, many at a time, as flat arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from nameshift.functions.fill_index import FillIndex, Similar, gap_slices

#: Rows of candidates that are handed on at once.
ROWS = 1 << 18


def _owners(lists: pa.Array) -> np.ndarray:
    """The row of every entry; a null list has none."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
    return np.repeat(np.arange(len(lists)), sizes)


def _words(texts: pa.Array, lens: pa.Array) -> pa.Array:
    """The words of lists that travel as one text and the words' lengths in bytes: the bytes lie one after another already."""
    texts = texts.fill_null("") if texts.null_count else texts
    _, begins, data = texts.buffers()
    sizes = np.asarray(lens.flatten())
    offsets = np.empty(len(sizes) + 1, np.int32)
    offsets[0] = np.frombuffer(begins, np.int32, 1, 4 * texts.offset)[0] if len(texts) else 0
    np.cumsum(sizes, out=offsets[1:])
    offsets[1:] += offsets[0]
    return pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(offsets), data or pa.py_buffer(b"")])


def _flat(words: pa.Array, begins: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The way back: rows of words, which begin at ``begins``, as texts and lists of lengths."""
    ends = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1) if len(words) else np.zeros(1, np.int32)
    texts = pa.Array.from_buffers(pa.string(), len(begins) - 1, [None, pa.py_buffer(ends[begins]), words.buffers()[2] or pa.py_buffer(b"")])
    return texts, pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(np.diff(ends), pa.int32()))


def _byte_order(toks: pa.Array) -> tuple[np.ndarray, int]:
    """The place of every token among the distinct ones by their bytes, and how many there are."""
    codes = toks.dictionary_encode()
    place = np.empty(len(codes.dictionary), np.int64)
    place[np.asarray(pc.sort_indices(codes.dictionary.cast(pa.binary())))] = np.arange(len(place))
    return place[np.asarray(codes.indices)] if len(place) else np.zeros(0, np.int64), len(place)


def _places(owner: np.ndarray, n: int) -> np.ndarray:
    """Places within each row of entries sorted by row."""
    return np.arange(len(owner)) - np.searchsorted(owner, np.arange(n))[owner]


def _lists(owner: np.ndarray, n: int, fields: list[tuple[str, pa.Array]]) -> pa.Array:
    values = pa.StructArray.from_arrays([v for _, v in fields], [name for name, _ in fields])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), values)


def fill_batches(batches: Iterator[pa.RecordBatch], index: FillIndex) -> Iterator[pa.RecordBatch]:
    """All columns but the last, the hashes of name and neighbours, and ``fills``."""
    for batch in batches:
        for part in gap_slices(batch, index.k):
            _, prev, following = index.numbers(part.columns[-1])
            owner, tok, score = index.fills(prev, following)
            words, sig, ok = index.vocabulary.texts(tok), index.signatures(tok), index.vocabulary.column("valid", tok)
            fields = [("neg", pa.array(-score)), ("tok", words), ("sig", pa.array(sig)), ("ok", pa.array(ok))]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], _lists(owner, part.num_rows, fields)], [*part.schema.names[:-1], "fills"])


def similar_batches(batches: Iterator[pa.RecordBatch], index: FillIndex) -> Iterator[pa.RecordBatch]:
    """All columns but the last, the hashes of name and neighbours, and ``similar``: the fills by the distance of their signature to that of
    the name; equal distances keep the order of the fills."""
    for batch in batches:
        for part in gap_slices(batch, index.k):
            s = index.similar(part.columns[-1])
            words, ok = index.vocabulary.texts(s.tok), index.vocabulary.column("valid", s.tok)
            fields = [("dist", pa.array(s.dist.astype(np.int32))), ("idx", pa.array(s.index.astype(np.int32))), ("cand", words), ("score", pa.array(s.score)), ("ok", pa.array(ok))]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], _lists(s.owner, part.num_rows, fields)], [*part.schema.names[:-1], "similar"])


def _left(s: Similar, n: int, index: FillIndex, cut: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], lowest: int, valid_only: bool) -> np.ndarray:
    """Which fills of ``n`` gaps are left after the cuts, and after P9 if wanted."""
    place = _places(s.owner, n)
    left = cut(place, s.dist, s.sizes[s.owner])
    if lowest:
        low = np.flatnonzero(left & (s.score < lowest))
        ends = np.full(n, index.k, np.int64)
        np.minimum.at(ends, s.owner[low], place[low])
        left &= place < ends[s.owner]
    at = np.flatnonzero(left)
    return at[index.vocabulary.column("valid", s.tok[at])] if valid_only else at


def kept_batches(
    batches: Iterator[pa.RecordBatch], index: FillIndex, cut: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], lowest: int, weighed: bool = False
) -> Iterator[pa.RecordBatch]:
    """All columns but the last, the hashes of name and neighbours, then ``toks, lens, scores``, and ``weights`` if wanted: the similar fills
    that are left of each gap, most similar first.

    ``cut`` tells from the place, the distance and the number of its gap's fills whether a fill is similar enough. The rest ends before the
    first score below ``lowest`` (0: none is); words that are no valid names are left out.
    """
    for batch in batches:
        for part in gap_slices(batch, index.k):
            n, s = part.num_rows, index.similar(part.columns[-1])
            at = _left(s, n, index, cut, lowest, True)
            begins = np.searchsorted(s.owner[at], np.arange(n + 1))
            texts, lens = _flat(index.vocabulary.texts(s.tok[at]), begins)
            values = [s.score[at], *([index.weight(s.tok[at])] if weighed else [])]
            numbers = [pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(x.astype(np.int32))) for x in values]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], texts, lens, *numbers], [*part.schema.names[:-1], "toks", "lens", "scores", "weights"][: part.num_columns + 2 + weighed])


def near_batches(
    batches: Iterator[pa.RecordBatch], index: FillIndex, cut: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], lowest: int, valid_only: bool
) -> Iterator[pa.RecordBatch]:
    """As ``kept_batches``, for gaps of samples: all columns but the last, then ``numbers, scores``, the fills that are left by their number,
    and words that are no valid names only if wanted. A row without a name brings its one word's number, if it has one."""
    for batch in batches:
        for part in gap_slices(batch, index.k):
            names, toks = part.column(part.schema.get_field_index("name")), part.columns[-1]
            gaps = np.flatnonzero(~np.asarray(names.is_null()))
            s = index.similar(toks.take(pa.array(gaps)))
            at = _left(s, len(gaps), index, cut, lowest, valid_only)
            own = np.flatnonzero(np.asarray(names.is_null()))
            word = index.vocabulary.numbers(np.asarray(toks.take(pa.array(own)).flatten()))
            own, word = own[word >= 0], word[word >= 0]
            rows = np.concatenate([gaps[s.owner[at]], own])
            order = np.argsort(rows, kind="stable")
            begins = pa.array(np.searchsorted(rows[order], np.arange(part.num_rows + 1)), pa.int32())
            lists = [np.concatenate([s.tok[at], word]), np.concatenate([s.score[at], np.zeros(len(own), np.int64)])]
            values = [pa.ListArray.from_arrays(begins, pa.array(x[order].astype(np.int32))) for x in lists]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *values], [*part.schema.names[:-1], "numbers", "scores"])


def _codes(values: pa.Array) -> np.ndarray:
    return np.asarray(values.dictionary_encode(null_encoding="encode").indices).astype(np.int64)


def struck_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """P11 on rows ``sample_id, name, numbers, scores``, the rows of a sample together: rows without a name hold the sample's own names, which
    are struck out of the lists of the others."""
    for part in _whole_samples(batches):
        ids, names, numbers, scores = part.columns
        owner, tok = _owners(numbers), np.asarray(numbers.flatten()).astype(np.int64)
        word, own = (_codes(ids)[owner] << 32) | tok, np.asarray(names.is_null())
        left = np.flatnonzero(~np.isin(word, np.unique(word[own[owner]])))
        begins = pa.array(np.searchsorted(owner[left], np.arange(part.num_rows + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(begins, x.flatten().take(pa.array(left))) for x in (numbers, scores)]
        yield pa.RecordBatch.from_arrays([ids, names, *lists], part.schema.names).filter(pa.array(~own))


def merged_batches(batches: Iterator[pa.RecordBatch], index: FillIndex, weighed: bool, as_lists: bool) -> Iterator[pa.RecordBatch]:
    """C7 on rows ``sample_id, name, numbers, scores``, the rows of a sample together: the distinct candidates of every name with their best
    score, best first, equal scores by word.

    Rows ``sample_id, name, idx, cand, score``, and ``w_cand`` if wanted, or, as lists, ``sample_id, name, cands, scores``.
    """
    for part in _whole_samples(batches):
        ids, names, numbers, scores = part.columns
        owner, tok, score = _owners(numbers), np.asarray(numbers.flatten()).astype(np.int64), np.asarray(scores.flatten()).astype(np.int64)
        sample, name = _codes(ids), _codes(names)
        _, first, group = np.unique((sample << 32) | name, return_index=True, return_inverse=True)
        key = (group[owner] << 32) | tok
        order = np.argsort(key, kind="stable")
        key, score = key[order], score[order]
        begins = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        score = np.maximum.reduceat(score, begins) if len(begins) else score
        group, tok = key[begins] >> 32, key[begins] & 0xFFFFFFFF
        best = np.argsort((group << 32) - score, kind="stable")
        group, tok, score = group[best], tok[best], score[best]
        if as_lists:
            filled, begins = np.unique(group, return_index=True)
            ends = pa.array(np.append(begins, len(group)), pa.int32())
            row = pa.array(first[filled])
            lists = [pa.ListArray.from_arrays(ends, x) for x in (index.vocabulary.texts(tok), pa.array(score))]
            yield pa.RecordBatch.from_arrays([ids.take(row), names.take(row), *lists], ["sample_id", "name", "cands", "scores"])
            continue
        place = _places(group, len(first)) + 1
        for begin in range(0, len(tok), ROWS):
            s = slice(begin, begin + ROWS)
            row = pa.array(first[group[s]])
            columns = [ids.take(row), names.take(row), pa.array(place[s]), index.vocabulary.texts(tok[s]), pa.array(score[s]), *([pa.array(index.weight(tok[s]))] if weighed else [])]
            yield pa.RecordBatch.from_arrays(columns, ["sample_id", "name", "idx", "cand", "score", "w_cand"][: len(columns)])


def _whole_samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by the first column, cut where its value changes: rows of a sample come together."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = np.asarray(batch.column(0).dictionary_encode(null_encoding="encode").indices)
        begins = np.flatnonzero(codes[1:] != codes[:-1]) + 1
        goes_on = waiting and waiting[-1].column(0)[-1].as_py() == batch.column(0)[0].as_py()
        if len(begins) or not goes_on:
            last = int(begins[-1]) if len(begins) else 0
            done = [*waiting, batch.slice(0, last)] if last else waiting
            if done:
                yield pa.concat_batches(done)
            waiting = [batch.slice(last)]
        else:
            waiting.append(batch)
    if waiting:
        yield pa.concat_batches(waiting)


def candidate_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """C7 + P11 on rows ``sample_id, name, kept list<struct<cand, score>>`` sorted by sample and name: ``sample_id, name, idx, cand, score``.
    Instead of ``kept`` there may be ``toks, lens, scores``, and ``weights``, which give ``w_cand``.

    The distinct candidates of every name with their best score, best first, equal scores by word. Rows without a name hold the
    sample's own names, which are struck out.
    """
    for part in _whole_samples(batches):
        ids, names, *lists = part.columns
        owner = _owners(lists[-1])
        cand, *numbers = lists[0].flatten().flatten() if len(lists) == 1 else (_words(*lists[:2]), *(x.flatten() for x in lists[2:]))
        score, *weight = (np.asarray(x).astype(np.int64) for x in numbers)
        tok, size = _byte_order(cand)
        sample, name = (np.asarray(c.dictionary_encode(null_encoding="encode").indices).astype(np.int64) for c in (ids, names))
        begins = np.ones(part.num_rows, bool)
        begins[1:] = (sample[1:] != sample[:-1]) | (name[1:] != name[:-1])
        group, rows = np.cumsum(begins) - 1, np.flatnonzero(begins)
        word, own = sample[owner] * size + tok, np.asarray(names.is_null())[owner]
        at = np.flatnonzero(~np.isin(word, word[own]))
        key = group[owner[at]] * size + tok[at]
        order = np.lexsort((-score[at], key))
        first = np.ones(len(order), bool)
        first[1:] = key[order][1:] != key[order][:-1]
        at = at[order[first]]
        best = np.argsort(group[owner[at]] * (1 << 40) - score[at], kind="stable")
        at = at[best]
        by = group[owner[at]]
        row = pa.array(rows[by])
        columns = [ids.take(row), names.take(row), pa.array(_places(by, len(rows)) + 1), cand.take(pa.array(at)), pa.array(score[at]), *(pa.array(w[at]) for w in weight)]
        yield pa.RecordBatch.from_arrays(columns, ["sample_id", "name", "idx", "cand", "score", "w_cand"][: len(columns)])
