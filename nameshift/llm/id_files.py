"""Token ids in binary files: frequency-ranked, byte-aligned variable-length coding with separate control bytes.

Method: in every block ids are replaced by their rank among the block's ids (most frequent first, ties by id), so common ids
take one byte; the block holds the ids in order of rank. Lengths of one to four bytes stand in control bytes, four to a byte,
apart from the data bytes. Decoding looks lengths up in a table of all 256 control bytes and gathers whole arrays with numpy.

A set of files is a number of shards in ascending key order. A shard is a run of blocks of whole documents:
``magic, documents, ids, ranks, data bytes; keys, key flags, counts; ids by rank; control bytes; data bytes; CRC-32``.
Blocks are written and read one at a time and need nothing else, so the text is encoded once, and memory is bounded by a
slice of text, or by the longest document.

Distinct pre-tokens are encoded once per task by the tokenizers library; special strings in a text become their ids, as
its default has it. The end id follows every document.

Defined results: a null or empty text has the end id only. Keys that are null come first. Rows that share a key stand
in order of their texts' hashes; repeated rows are written as often as they come. An empty table gives no shard and no
rows. Other columns are not read.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from nameshift.llm.buffers import ragged_take, slices
from nameshift.llm.frames import small_batches
from nameshift.llm.pieces import PieceTable
from nameshift.llm.shared_files import Part, new_folder, read_stream
from nameshift.session import stage

MAGIC = b"NSIDS1\r\n"
HEAD = struct.Struct("<8sQQQQ")
#: Lengths of the four values of each control byte, where each begins, and how many bytes all take.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
STARTS = np.cumsum(LENGTHS, axis=1) - LENGTHS
TAKES = LENGTHS.sum(axis=1)
_BYTES = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def vocabulary_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def compress(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of unsigned numbers below 2**32; the last group is filled up with zeros."""
    v = np.zeros(-(-len(values) // 4) * 4, np.uint32)
    v[: len(values)] = values
    length = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    control = ((length - 1).reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    raw = v.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control, raw[np.arange(4) < length[:, None]]


def expand(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` numbers."""
    if not n:
        return np.zeros(0, np.uint32)
    ends = np.cumsum(TAKES[control])
    at = ((ends - TAKES[control])[:, None] + STARTS[control]).ravel()[:n]
    padded = np.zeros(len(data) + 4, np.uint32)
    padded[: len(data)] = data
    out = padded[at]
    lengths = LENGTHS[control].ravel()[:n]
    for k in range(1, int(lengths.max())):
        out |= padded[at + k] << np.uint32(8 * k)
    return out & _BYTES[lengths]


@lru_cache(maxsize=2)
def piece_table(path: str) -> PieceTable:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    tokenizer = tokenizers.Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def encode(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words that the pattern cuts apart again go to the library as one text; its word numbers part their ids."""
        values: list[np.ndarray] = []
        counts = np.zeros(len(pieces), np.int64)
        order: list[int] = []
        texts = [p.decode() for p in pieces]
        blank = [i for i, t in enumerate(texts) if t[0] == " " and t[1:].isalpha()]
        bare = [i for i, t in enumerate(texts) if t.isalpha()]
        rest = sorted(set(range(len(pieces))) - {*blank, *bare})
        for group, between, step in ((blank, "", 1), (bare, "\n", 2)):
            for k in range(0, len(group), 4096):
                lot = group[k : k + 4096]
                got = tokenizer.encode(between.join(texts[i] for i in lot), add_special_tokens=False)
                words = np.array(got.word_ids, np.int64)
                ids = np.array(got.ids, np.int32)
                if words[-1] != step * (len(lot) - 1):  # the library cuts a word where this Python's letters don't
                    rest += lot
                    continue
                own = words % step == 0
                counts[lot] = np.bincount(words[own] // step, minlength=len(lot))
                values.append(ids[own])
                order += lot
        for i, e in zip(rest, tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            values.append(np.array(e.ids, np.int32))
            counts[i] = len(e.ids)
            order.append(i)
        at = np.array(order)
        ends = np.concatenate([[0], np.cumsum(counts[at])])
        return ragged_take(np.concatenate(values), ends, np.argsort(at))[0], counts

    added = tokenizer.get_added_tokens_decoder().values()
    if any(t.single_word or t.lstrip or t.rstrip for t in added):
        raise ValueError(f"{path} has added tokens that depend on what is around them")
    return PieceTable(encode, tuple(t.content.encode() for t in added))


def with_end(ids: np.ndarray, by_row: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Every row's ids and the end id; how many each row has."""
    counts = np.diff(by_row) + 1
    out = np.empty(len(ids) + len(counts), np.int64)
    ends = np.cumsum(counts) - 1
    body = np.ones(len(out), bool)
    body[ends] = False
    out[body], out[ends] = ids, end_id
    return out, counts


def block(keys: pa.Array, counts: np.ndarray, ids: np.ndarray) -> bytes:
    times = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    seen = np.flatnonzero(times)
    by_rank = seen[np.lexsort((seen, -times[seen]))]
    rank_of = np.zeros(len(times), np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))
    control, data = compress(rank_of[ids])
    flags = np.array(keys.is_valid(), bool).astype(np.uint8)
    parts = [np.asarray(keys.fill_null(0)).astype("<i8"), flags, counts.astype("<i8"), by_rank.astype("<u4"), control, data]
    body = HEAD.pack(MAGIC, len(counts), len(ids), len(by_rank), len(data)) + b"".join(x.tobytes() for x in parts)
    return body + struct.pack("<I", zlib.crc32(body))


def read_blocks(stream) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Keys, key flags, counts and ids of each block. A block that fails its checksum is an error."""
    while head := stream.read(HEAD.size):
        magic, n, n_ids, n_ranks, n_data = HEAD.unpack(head)
        lengths = [8 * n, n, 8 * n, 4 * n_ranks, -(-n_ids // 4), n_data]
        body = stream.read(sum(lengths))
        if magic != MAGIC or struct.unpack("<I", stream.read(4))[0] != zlib.crc32(body, zlib.crc32(head)):
            raise ValueError("damaged block")
        ends = np.cumsum(lengths)
        keys, flags, counts, by_rank, control, data = (np.frombuffer(body[end - size : end], kind) for end, size, kind in zip(ends, lengths, ("<i8", "u1", "<i8", "<u4", "u1", "u1"), strict=True))
        yield keys, flags.astype(bool), counts, by_rank[expand(control, data, n_ids)] if n_ids else by_rank


@dataclass
class IdFiles:
    """``shards``: shard, uri, n_docs, n_ids, n_bytes, and ``first``, the ids of all shards before it."""

    shards: DataFrame


def write_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = 0, folder: str | None = None) -> IdFiles:
    """Writes all documents in ascending key order: ranges of keys are shards, each written by one task."""
    spark = docs.sparkSession
    path, folder = path or vocabulary_path(), folder or new_folder(spark, "ids")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, docs_in, ids_in, shard = None, 0, 0, TaskContext.get().partitionId()
        for batch in batches:
            for i, j, data, offs in slices(batch.column(1)):
                out = out or Part(folder, shard, ".ids")
                ids, counts = with_end(*piece_table(path).ids(data, offs), end_id)
                out.write(block(batch.column(0).slice(i, j - i), counts, ids))
                docs_in, ids_in = docs_in + j - i, ids_in + len(ids)
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "uri": [out.uri], "n_docs": [docs_in], "n_ids": [ids_in], "n_bytes": [out.size]}, schema=pa.schema([("shard", pa.int32()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").alias("t"))
    order = [F.col("k"), F.xxhash64("t")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    shards = stage(small_batches(dealt).mapInArrow(run, "shard int, uri string, n_docs long, n_ids long, n_bytes long"), "shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    first = F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long")
    return IdFiles(shards.withColumn("first", first))


def read_digests(spark: SparkSession, files: IdFiles) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of every document, from the files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with read_stream(uri) as stream:
                    for keys, flags, counts, ids in read_blocks(stream):
                        raw = memoryview(ids.astype("<u4")).cast("B")
                        ends = np.cumsum(counts)
                        starts = ends - counts
                        sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(keys, mask=~flags), pa.array(starts + first), pa.array(counts), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        first += int(counts.sum())

    n = max(1, files.shards.count())
    spread = files.shards.select("uri", "first").repartition(n)
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
