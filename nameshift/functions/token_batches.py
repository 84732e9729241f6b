"""Token lists of many texts at once, as flat arrays: what needs no other text is counted and numbered where the text is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

STATEMENT_ENDS = [";", "\n"]


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All tokens, the text of each, and where the tokens of each text begin; a null list has none."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
    return lists.flatten(), np.repeat(np.arange(len(lists)), sizes), np.cumsum(sizes) - sizes


def _is_any(toks: pa.Array, words: list[str]) -> np.ndarray:
    return np.asarray(pc.is_in(toks, value_set=pa.array(words, toks.type)))


def _beside(toks: pa.Array, owner: np.ndarray, step: int) -> pa.Array:
    """The token before (``step`` -1) or after each one in its text, null at the ends."""
    at = np.arange(len(toks)) + step
    inside = (at >= 0) & (at < len(toks))
    inside[inside] = owner[at[inside]] == owner[inside]
    return toks.take(pa.array(at, mask=~inside))


def token_count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of an id and tokens: ``sample_id, n, tok, n_win``, a row for each distinct token of a text with its size and count."""
    for batch in batches:
        toks, owner, _ = _flat(batch.column(1))
        codes = toks.dictionary_encode()
        size = max(len(codes.dictionary), 1)
        keys, counts = np.unique(owner * size + np.asarray(codes.indices), return_counts=True)
        text = keys // size
        sizes = np.bincount(owner, minlength=batch.num_rows)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(text)), pa.array(sizes[text]), codes.dictionary.take(pa.array(keys % size)), pa.array(counts)], ["sample_id", "n", "tok", "n_win"]
        )


def statement_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of an id and tokens with line breaks: ``sample_id, stmt, pos, name, is_def, defined, beside_def``, the number of the statement of
    every token that may be a name, and whether a ``=`` follows, does so somewhere in its text, or behind some name of its statement.
    Tokens that begin with an ASCII character no name begins with are left out."""
    for batch in batches:
        toks, owner, begins = _flat(batch.column(1))
        ends = np.concatenate([[0], np.cumsum(_is_any(toks, STATEMENT_ENDS))])
        pos = np.arange(len(toks)) - begins[owner]
        stmt = ends[1:] - ends[begins[owner]]
        is_def = _is_any(_beside(toks, owner, 1), ["="])
        first = np.asarray(pc.binary_slice(toks.cast(pa.binary()), 0, 1).cast(pa.binary()).fill_null(b"").to_numpy(zero_copy_only=False), dtype="S1").view(np.uint8) if len(toks) else np.zeros(0, np.uint8)
        named = (first >= 128) | (first == ord("_")) | ((first | 32) >= ord("a")) & ((first | 32) <= ord("z"))
        at = np.flatnonzero(named)
        owner, is_def, names, statement = owner[at], is_def[at], toks.take(pa.array(at)), (ends[1:] + owner)[at]
        codes = names.dictionary_encode()
        words = owner * max(len(codes.dictionary), 1) + np.asarray(codes.indices)
        defined, beside = np.isin(words, words[is_def]), np.isin(statement, statement[is_def])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(owner)), pa.array(stmt[at]), pa.array(pos[at].astype(np.int32)), names, *map(pa.array, (is_def, defined, beside))],
            ["sample_id", "stmt", "pos", "name", "is_def", "defined", "beside_def"],
        )


def structure_batches(batches: Iterator[pa.RecordBatch], words: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of an id and tokens with line breaks: ``sample_id, pos, tok, prev, next(pos, tok)`` of the given words, with the tokens
    beside them. Line breaks keep their place, but are no neighbours."""
    for batch in batches:
        toks, owner, begins = _flat(batch.column(1))
        pos = (np.arange(len(toks)) - begins[owner]).astype(np.int32)
        seen = np.flatnonzero(~_is_any(toks, ["\n"]))
        toks, owner, pos = toks.take(pa.array(seen)), owner[seen], pos[seen]
        at = np.flatnonzero(_is_any(toks, words))
        after = _beside(toks, owner, 1).take(pa.array(at))
        place = pa.array(np.append(pos, 0)[at + 1].astype(np.int32))
        following = pa.StructArray.from_arrays([place, after], ["pos", "tok"], mask=after.is_null())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(owner[at])), pa.array(pos[at]), toks.take(pa.array(at)), _beside(toks, owner, -1).take(pa.array(at)), following],
            ["sample_id", "pos", "tok", "prev", "next"],
        )
