"""Encoding, decoding, counting and id files against the public libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
import tokenizers
from helpers import DOCS, awkward, clashing

from nameshift.llm import bpe_codec, buffers, id_files, queries, token_counts

PARTS = ["a", "b", "'", "s", "ll", "ve", " ", "  ", "\n", "\t", "é", "ß", "1", "²", "!", "…", "　", "中", "😀", "\x00", "\x1c", "\x85", "th", "er", "<|endoftext|>", "<|endo"]


def random_texts(n=1500, seed=3):
    r = random.Random(seed)
    return ["".join(r.choices(PARTS, k=r.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def ranked():
    ranks = bpe_codec.codec(bpe_codec.rank_path()).ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pre_tokens_are_the_matches_of_the_pattern():
    pattern = regex.compile(public_tokenizers.PATTERN)
    for i, j, data, offs in buffers.slices(pa.array(texts := random_texts()), 3000):
        starts = buffers.pre_tokens(data, offs)
        got = [bytes(data[a:b]) for a, b in zip(starts, np.append(starts[1:], len(data)), strict=True)]
        assert got == [w.encode() for t in texts[i:j] for w in pattern.findall(t)]


def test_interned_spans_are_exact_after_the_table_grows():
    interner, names = buffers.Interner(4), []
    for _, _, data, offs in buffers.slices(pa.array(random_texts(400)), 2000):
        starts, ends, _ = buffers.words(data, offs)
        numbers, fresh = interner.intern(data, starts, ends - starts)
        names += fresh
        assert [names[k] for k in numbers] == [bytes(data[a:b]) for a, b in zip(starts, ends, strict=True)]
    assert len(set(names)) == len(names) and interner.full


def test_codec_equals_the_library(ranked):
    table = bpe_codec.PieceTable(bpe_codec.codec(bpe_codec.rank_path()).encode_pieces, limit=50)
    for i, j, data, offs in buffers.slices(pa.array(texts := [*random_texts(), "a" * 3000, "abcdefghij" * 200]), 3000):
        ids, by_row = table.ids(data, offs)
        for k in range(i, j):
            assert ids[by_row[k - i] : by_row[k - i + 1]].tolist() == ranked.encode_ordinary(texts[k])


def test_round_trip_of_awkward_rows(spark, ranked):
    docs = clashing(awkward(spark))
    want = sorted(str((r.doc_id, len(ids := ranked.encode_ordinary(r.text or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())) for r in docs.collect())
    got = bpe_codec.round_trip(docs).drop("ids").collect()
    assert sorted(str(tuple(r)) for r in got) == want
    assert bpe_codec.round_trip(docs.limit(0)).count() == 0


def test_counts_equal_the_library(spark, library):
    merges = token_counts.Merges(token_counts.vocabulary_path())
    pieces = sorted({p.encode() for t in random_texts(300) for p in regex.findall(public_tokenizers.PATTERN, t)} - {b""})
    want = [len(library.encode(p.decode(), add_special_tokens=False).ids) for p in pieces]
    assert merges.count(pieces).tolist() == want
    docs = clashing(awkward(spark))
    got = token_counts.token_counts(docs, limit=50).collect()
    rows = [(r.doc_id, len((r.text or "").encode()), n := len(library.encode(r.text or "", add_special_tokens=False).ids), n > 50) for r in docs.collect()]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, rows))
    assert token_counts.token_counts(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_variable_length_coding_round_trip(n):
    r = np.random.default_rng(n)
    values = (r.integers(0, 2**32, n, dtype=np.uint64) >> r.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
    control, data = id_files.compress(values)
    assert len(control) == -(-n // 4)
    assert (id_files.expand(control, data, n) == values).all()


def test_id_files_hold_every_document_in_order(spark, library):
    docs = clashing(awkward(spark))
    files = id_files.write_ids(docs)
    got = id_files.read_digests(spark, files).orderBy("start").collect()
    want = {}
    for r in docs.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    found, at = {}, 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
        found.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    keys = [r.doc_id for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    assert id_files.read_digests(spark, id_files.write_ids(docs.limit(0))).count() == 0


def test_damaged_id_block_is_an_error():
    import io

    data = bytearray(id_files.block(pa.array([1, None], pa.int64()), np.array([2, 1]), np.array([9, 70_000, 9])))
    keys, flags, counts, ids = next(id_files.read_blocks(io.BytesIO(bytes(data))))
    assert (flags.tolist(), counts.tolist(), ids.tolist(), keys[0]) == ([True, False], [2, 1], [9, 70_000, 9], 1)
    data[-6] ^= 1
    with pytest.raises(ValueError):
        next(id_files.read_blocks(io.BytesIO(bytes(data))))


def test_queries_cover_whole_tables(spark, folder, ranked, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in queries.QUERIES["op2_bpe_codec"](spark, folder).collect():
        ids = ranked.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    counted = {r.doc_id: r.n_tokens for r in queries.QUERIES["op4_token_counts"](spark, folder).collect()}
    assert counted == {k: len(library.encode(t, add_special_tokens=False).ids) for k, t in texts.items()}
    stored = queries.QUERIES["op8_id_files"](spark, folder).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_tokens) for r in stored] == [(k, counted[k] + 1) for k in sorted(texts)]
    assert spark.createDataFrame([], DOCS).count() == 0
