"""Token counts by merging ragged arrays in step.

Method: a batch of distinct pre-tokens is one flat array of symbols with sequence boundaries. In every round each
sequence finds its pair of lowest rank and merges all of that pair's occurrences at once; sequences without a pair
leave, and what is counted is the symbols that survive.

Defined results: a null or empty text has 0 bytes and 0 tokens. Repeated rows are counted row by row. A null in
the key column stays. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StructField

from nameshift.llm.frames import longs, map_text
from nameshift.llm.pieces import PairTable, PieceTable

NO_RANK = np.int32(np.iinfo(np.int32).max)


def vocabulary_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Merges:
    """The ordered merges of a byte-level ``tokenizers`` file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError(f"{path} is no plain byte-level BPE")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens that depend on what is around them")
        self.special = tuple(t["content"].encode() for t in spec["added_tokens"])
        vocab = model["vocab"]
        self.byte_ids = np.zeros(256, np.int32)
        for letter, b in byte_letters().items():
            self.byte_ids[b] = vocab[letter]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right, self.made = (np.array([vocab[x] for x in col], np.int32) for col in (*zip(*merges, strict=True), [a + b for a, b in merges]))
        made_at = {m: i for i, m in enumerate(self.made.tolist())}
        rank = np.arange(len(merges))
        if any(made_at.get(x, -1) >= i for i, pair in enumerate(zip(left.tolist(), right.tolist(), strict=True)) for x in pair):
            raise ValueError(f"{path}: a merge uses a symbol that a later merge makes")
        self.pairs = PairTable(left, right, rank)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = self.pairs.get(a, b)
        found[found < 0] = NO_RANK
        return found

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """How many symbols of each pre-token survive all merges.

        A merge's symbols are made by earlier merges, so what a merge makes has only later merges: merging all
        occurrences of a sequence's lowest pair at once gives what merging them one by one gives.
        """
        counts = np.ones(len(pieces), np.int64)
        lens = np.array([len(p) for p in pieces], np.int64)
        merging = np.array([p not in self.special for p in pieces], bool)
        counts[merging] = 0
        owner = np.repeat(np.arange(len(pieces)), lens)
        symbols = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        live = merging[owner]
        owner, symbols = owner[live], symbols[live]
        ranks = np.full(len(symbols), NO_RANK)  # of the pair that begins here
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        ranks[inner] = self.pair_ranks(symbols[inner], symbols[inner + 1])
        while len(symbols):
            heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            size = np.diff(np.append(heads, len(symbols)))
            lowest = np.minimum.reduceat(ranks, heads)
            ended = lowest == NO_RANK
            counts[owner[heads[ended]]] = size[ended]
            if ended.any():
                stay = np.repeat(~ended, size)
                owner, symbols, ranks = owner[stay], symbols[stay], ranks[stay]
                lowest, size = lowest[~ended], size[~ended]
                if not len(symbols):
                    break
            hit = np.flatnonzero(ranks == np.repeat(lowest, size))
            new_run = np.append(True, (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]]))
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run_start) % 2 == 0]  # every other one of a run that overlaps
            symbols[hit] = self.made[ranks[hit]]
            kept = np.ones(len(symbols), bool)
            kept[hit + 1] = False
            place = np.cumsum(kept) - 1
            owner, symbols, ranks = owner[kept], symbols[kept], ranks[kept]
            at = place[hit]
            for p in (at - 1, at):
                p = p[p >= 0]
                pair = (p + 1 < len(symbols)) & (owner[np.minimum(p + 1, len(symbols) - 1)] == owner[p])
                ranks[p[~pair]] = NO_RANK
                ranks[p[pair]] = self.pair_ranks(symbols[p[pair]], symbols[p[pair] + 1])
        return counts

    def encode_counts(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """One value for each pre-token: its count."""
        return self.count(pieces).astype(np.int32), np.ones(len(pieces), np.int64)


@lru_cache(maxsize=2)
def count_table(path: str) -> PieceTable:
    merges = Merges(path)
    return PieceTable(merges.encode_counts, merges.special)


def token_counts(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None, limit: int = 1024) -> DataFrame:
    """``keep``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` of every whole text."""
    path = path or vocabulary_path()

    def make():
        table = count_table(path)

        def function(data: np.ndarray, offs: np.ndarray) -> list[pa.Array]:
            each, by_row = table.ids(data, offs)
            total = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
            n = np.diff(total[by_row])
            return [longs(np.diff(offs)), longs(n), pa.array(n > limit, pa.bool_())]

        return function

    fields = [StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), StructField("over_limit", BooleanType())]
    return map_text(df, text, make, fields, keep)
