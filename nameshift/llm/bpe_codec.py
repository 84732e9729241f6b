"""Byte-level BPE encoding and decoding with the ranks of a ``.tiktoken`` file.

Method: distinct pre-tokens lie in padded matrices, one for each class of lengths. In every round each row merges
its leftmost pair of minimum rank; ranks come from a hashed pair table, merged columns are closed up, finished
rows leave, and the matrix narrows as its rows shorten.

Defined results: a null or empty text has no ids and decodes to no bytes. Repeated rows are encoded row by row.
A null in the key column stays. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, StructField

from nameshift.llm.buffers import ragged_take
from nameshift.llm.frames import binaries, map_text
from nameshift.llm.pieces import PairTable, PieceTable

NO_RANK = np.int32(np.iinfo(np.int32).max)
#: Longer pre-tokens go one by one through a heap: a matrix row costs the square of its length.
MATRIX_WIDTH = 512


def rank_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Codec:
    """Ranks of one file. A pair merges if its joined bytes have a rank."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(self.ranks[t[:k]], self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        left, right, rank = np.array(pairs, np.int64).reshape(-1, 3).T
        self.pairs = PairTable(left, right, rank)
        by_id = {r: t for t, r in self.ranks.items()}
        tokens = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_offs = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair; padding is -1 and has none."""
        found = self.pairs.get(np.maximum(a, 0), np.maximum(b, 0))
        return np.where((found < 0) | (a < 0) | (b < 0), NO_RANK, found)

    def merge_matrix(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merges padded rows; returns finished symbols, their counts, and the row that each belongs to."""
        rows = np.arange(len(symbols))
        ranks = self.pair_ranks(symbols[:, :-1], symbols[:, 1:])
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(rows):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            best = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), NO_RANK)
            if (over := best == NO_RANK).any():
                kept = symbols[over]
                full = kept >= 0
                done.append((kept[full], full.sum(axis=1), rows[over]))
                live = ~over
                rows, symbols, ranks, at, best = rows[live], symbols[live], ranks[live], at[live], best[live]
                if not len(rows):
                    break
            each = np.arange(len(rows))
            symbols[each, at] = best
            width = symbols.shape[1]
            take = np.arange(width - 1) + (np.arange(width - 1) > at[:, None])
            symbols = np.take_along_axis(symbols, take, axis=1)
            longest = int((symbols >= 0).any(axis=0).sum())
            ranks = np.take_along_axis(ranks, np.minimum(take[:, : width - 2] + (take[:, : width - 2] == at[:, None]), width - 2), axis=1) if width > 2 else ranks[:, :0]
            symbols, ranks = symbols[:, :longest], ranks[:, : max(longest - 1, 0)]
            for shift in (-1, 0):
                p = at + shift
                ok = (p >= 0) & (p + 1 < longest)
                ranks[each[ok], p[ok]] = self.pair_ranks(symbols[each[ok], p[ok]], symbols[each[ok], p[ok] + 1])
        values, counts, order = (np.concatenate(x) for x in zip(*done, strict=True))
        return values, counts, order

    def merge_one(self, piece: bytes) -> list[int]:
        """The same merges for one long pre-token, with a heap of (rank, place)."""
        symbols = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        size = [1] * n
        start = list(range(n))
        get = self.ranks.get
        heap = [(r, i, 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, length = heapq.heappop(heap)
            j = after[i] if size[i] else n
            if j >= n or size[i] + size[j] != length:
                continue
            symbols[i] = rank
            size[i], size[j] = length, 0
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else n
                if b < n and (r := get(piece[start[a] : start[b] + size[b]])) is not None:
                    heapq.heappush(heap, (r, a, size[a] + size[b]))
        return [s for s, k in zip(symbols, size, strict=True) if k]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens and how many each has. A pre-token that is a token itself is not merged."""
        lens = np.array([len(p) for p in pieces], np.int64)
        counts = np.zeros(len(pieces), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        whole = np.array([self.ranks.get(p, -1) for p in pieces], np.int64)
        at = np.flatnonzero(whole >= 0)
        parts.append((whole[at].astype(np.int32), np.ones(len(at), np.int64), at))
        rest = np.flatnonzero(whole < 0)
        offs = np.concatenate([[0], np.cumsum(lens)])
        data = np.frombuffer(b"".join(pieces), np.uint8)
        bucket = np.ceil(np.log2(np.maximum(lens[rest], 2))).astype(np.int64)
        for k in np.unique(bucket[lens[rest] <= MATRIX_WIDTH]):
            group = rest[(bucket == k) & (lens[rest] <= MATRIX_WIDTH)]
            for lot in np.array_split(group, max(1, (len(group) << int(k)) >> 20)):
                width = int(lens[lot].max())
                columns = np.arange(width)
                symbols = np.where(columns < lens[lot][:, None], self.byte_ids[data[np.minimum(offs[lot][:, None] + columns, len(data) - 1)]], np.int32(-1))
                values, count, order = self.merge_matrix(symbols)
                parts.append((values, count, lot[order]))
        for i in rest[lens[rest] > MATRIX_WIDTH].tolist():
            ids = np.array(self.merge_one(pieces[i]), np.int32)
            parts.append((ids, np.array([len(ids)]), np.array([i])))
        values, count, order = (np.concatenate(x) for x in zip(*parts, strict=True))
        counts[order] = count
        back = np.argsort(order, kind="stable")
        ends = np.concatenate([[0], np.cumsum(count)])
        return ragged_take(values, ends, back)[0], counts

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of ragged ids."""
        values, ends = ragged_take(self.token_bytes, self.token_offs, ids)
        return values, ends[offs]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


@lru_cache(maxsize=2)
def piece_table(path: str) -> PieceTable:
    return PieceTable(codec(path).encode_pieces)


def encode(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """``keep`` and ``ids``: the ids of the whole text as little-endian unsigned 32-bit integers."""
    path = path or rank_path()

    def make():
        table = piece_table(path)

        def function(data: np.ndarray, offs: np.ndarray) -> list[pa.Array]:
            ids, by_row = table.ids(data, offs)
            return [binaries(ids.astype("<u4"), by_row * 4)]

        return function

    return map_text(df, text, make, [StructField("ids", BinaryType())], keep)


def decode(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """``keep``, ``ids`` and ``decoded``: the bytes that the ids stand for. Null ids decode to nothing."""
    path = path or rank_path()

    def make():
        own = codec(path)

        def function(data: np.ndarray, offs: np.ndarray) -> list[pa.Array]:
            values, ends = own.decode(np.frombuffer(data.tobytes(), "<u4").astype(np.int64), offs // 4)
            return [binaries(values, ends)]

        return function

    return map_text(df, "ids", make, [StructField("decoded", BinaryType())], (*keep, "ids"))




def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id``, ``n_tokens``, the ``ids`` of every text, their digest, and the digest of what they decode to.

    One pass encodes a slice of rows and decodes its ids, so a task needs one Python worker.
    """
    path = path or rank_path()

    def make():
        own, table = codec(path), piece_table(path)

        def function(data: np.ndarray, offs: np.ndarray) -> list[pa.Array]:
            ids, by_row = table.ids(data, offs)
            values, ends = own.decode(ids, by_row)
            return [binaries(ids.astype("<u4"), by_row * 4), binaries(values, ends)]

        return function

    own = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    both = map_text(own, "text", make, [StructField("ids", BinaryType()), StructField("decoded", BinaryType())], ["doc_id"])
    count = F.expr("CAST(octet_length(ids) / 4 AS BIGINT)")
    return both.select("doc_id", count.alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
