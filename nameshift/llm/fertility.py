"""Quality rules: base counts, and bands for the fertility of public tokenisers.

Method: two public vocabularies split every word. Characters per token of either, the share of byte-fallback tokens
and the evenness of the token distribution (entropy over its largest possible value) are measured on whole texts. For
each language and length class, the middle and the spread (interquartile range) of a measure come from all texts that pass
the base rules; a text is rejected beyond ``WIDTH`` spreads. Length classes double in tokens, up to ``LONGEST``: short texts
vary more, and their spread says so. Where a class has too few texts, that of the script counts, then the language and the
script at every length; only there the band of a short text is wider by sqrt(1 + SHORT / tokens).

Words are runs between ASCII white space. Defined results: a null or empty text has no words, so the base rules reject
it. A null language is a language of its own. Repeated rows are judged row by row, with the same verdict. Languages and
scripts with fewer than ``LEAST`` texts have no band and reject nothing. A null key stays. An empty table gives an empty
result. Names of other columns may clash with those made here: measures lie in one struct.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField

from nameshift.llm.bpe_codec import codec, rank_path
from nameshift.llm.buffers import WORD_BREAK, Interner, RaggedTable, mix, words
from nameshift.llm.frames import longs, map_text
from nameshift.session import stage

WINDOW = 8
LEAST, WIDTH, SHORT = 30, 3.0, 400
#: Texts of 2**LONGEST tokens and more are one length class.
LONGEST = 12
#: The least spread of a band, in thousandths, so that uniform texts don't close it.
LEAST_SPREAD = 20
#: Measures with a band, and whether it has an upper end.
MEASURES = {"bpe_chars": True, "piece_chars": True, "byte_share": True, "evenness": False}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: Scripts by the first byte of a character, roughly: enough to pool rare languages.
SCRIPTS = ["latin", "greek", "cyrillic", "semitic", "south_asian", "east_asian", "other"]
_SCRIPT = np.full(256, -1, np.int8)
for _low, _high, _script in ((0x41, 0x5A, 0), (0x61, 0x7A, 0), (0xC3, 0xCA, 0), (0xCD, 0xCF, 1), (0xD0, 0xD4, 2), (0xD6, 0xDD, 3), (0xE0, 0xE0, 4), (0xE3, 0xED, 5), (0xE1, 0xE2, 6), (0xEE, 0xF4, 6)):
    _SCRIPT[_low : _high + 1] = _script

BASE = [StructField(c, LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
FERTILITY = [*[StructField(c, LongType()) for c in ("n_bpe", "n_pieces", "n_byte_pieces")], StructField("entropy", DoubleType()), StructField("script", StringType())]


def piece_path() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabularies:
    """Tokens of distinct words under both vocabularies, each word split once per task."""

    def __init__(self, ranks: str, pieces: str):
        self.bpe = codec(ranks)
        self.model = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.size)])
        self.interner, self.counts, self.pieces = Interner(1 << 18), RaggedTable(np.int32), RaggedTable(np.int32)

    def word_numbers(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        if self.interner.full:
            for x in (self.interner.reset, self.counts.clear, self.pieces.clear):
                x()
        numbers, fresh = self.interner.intern(data, starts, lens)
        if fresh:
            ids = self.model.encode([w.decode() for w in fresh], num_threads=1)
            self.pieces.extend(np.array([i for x in ids for i in x], np.int32), np.array([len(x) for x in ids], np.int64))
            self.counts.extend(self.bpe.encode_pieces(fresh)[1].astype(np.int32), np.ones(len(fresh), np.int64))
        return numbers


@lru_cache(maxsize=2)
def vocabularies(ranks: str, pieces: str) -> Vocabularies:
    return Vocabularies(ranks, pieces)


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches; ``ends`` has one more than stretches."""
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[ends])


def repeated_words(numbers: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For every row the words inside windows of ``WINDOW`` words that its text holds at least twice.

    Windows are grouped by a hash, and neighbours of a group are compared word by word; if any differ, windows
    are grouped by all their words.
    """
    n = len(numbers)
    at = np.flatnonzero(np.repeat(rows[1:], np.diff(rows)) - np.arange(n) >= WINDOW)
    covered = np.zeros(n + 1, np.int64)
    if at.size:
        row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))[at]
        h = mix(row.astype(np.uint64))
        for k in range(WINDOW):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + numbers[at + k].astype(np.uint64))
        order = np.argsort(h)
        same = h[order[1:]] == h[order[:-1]]
        a, b = order[:-1][same], order[1:][same]
        whole = np.column_stack([row, *[numbers[at + k] for k in range(WINDOW)]]) if not all((numbers[at[a] + k] == numbers[at[b] + k]).all() for k in range(WINDOW)) or (row[a] != row[b]).any() else None
        if whole is not None:
            _, group, size = np.unique(whole, axis=0, return_inverse=True, return_counts=True)
            twice = at[size[group.ravel()] > 1]
        else:
            twice = at[np.unique(np.concatenate([a, b]))]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + WINDOW, -1)
    return sums(np.cumsum(covered[:-1]) > 0, rows)


def duplicate_lines(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    raw, out, blanks = data.tobytes(), [], bytes(np.flatnonzero(WORD_BREAK).astype(np.uint8))
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        lines = [x for x in raw[a:b].split(b"\n") if x.strip(blanks)]
        out.append(len(lines) - len(set(lines)))
    return np.array(out, np.int64)


def measure(data: np.ndarray, offs: np.ndarray, own: Vocabularies) -> list[pa.Array]:
    starts, ends, rows = words(data, offs)
    numbers = own.word_numbers(data, starts, ends - starts)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    counts, _ = own.counts.take(numbers)
    pieces, piece_ends = own.pieces.take(numbers)
    by_row = piece_ends[rows]
    n_pieces = np.diff(by_row)
    row = np.repeat(np.arange(len(n_pieces)), n_pieces)
    key, times = np.unique(row * own.size + pieces, return_counts=True)
    owner = key // own.size if len(key) else np.zeros(0, np.int64)
    share = times / n_pieces[owner] if len(key) else np.zeros(0)
    entropy = np.bincount(owner, -share * np.log2(share), len(n_pieces)) if len(key) else np.zeros(len(n_pieces))
    letters = np.stack([np.diff(np.concatenate([[0], np.cumsum(_SCRIPT[data] == s)])[offs]) for s in range(len(SCRIPTS))])
    return [
        longs(np.diff(rows)),
        longs(sums(chars[ends] - chars[starts], rows)),
        longs(np.diff(symbols[offs])),
        longs(duplicate_lines(data, offs)),
        longs(repeated_words(numbers, rows)),
        longs(sums(counts, rows)),
        longs(n_pieces),
        longs(sums(own.is_byte[pieces], by_row)),
        pa.array(np.round(entropy, 9), pa.float64()),
        pa.array([SCRIPTS[i] for i in letters.argmax(axis=0)], pa.string()),
    ]


def measures(df: DataFrame, text: str, keep: list[str], ranks: str | None = None, pieces: str | None = None) -> DataFrame:
    """``keep``, the base counts and the fertility measures of every whole text."""
    paths = ranks or rank_path(), pieces or piece_path()

    def make():
        own = vocabularies(*paths)
        return lambda data, offs: measure(data, offs, own)

    return map_text(df, text, make, [*BASE, *FERTILITY], keep)


def base_failed(c: Column) -> Column:
    return (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])


def scaled(c: Column) -> dict[str, Column]:
    """The measures with a band, in whole thousandths."""
    ratio = lambda a, b: F.when(b > 0, F.round(1000 * a / b)).cast("long")
    return {
        "bpe_chars": ratio(c["word_chars"], c["n_bpe"]),
        "piece_chars": ratio(c["word_chars"], c["n_pieces"]),
        "byte_share": ratio(c["n_byte_pieces"], c["n_pieces"]),
        "evenness": F.when(c["n_pieces"] > 1, F.round(1000 * c["entropy"] / F.log2(c["n_pieces"].cast("double")))).cast("long"),
    }


def groups(c: Column) -> dict[str, Column]:
    """What a text is compared with, the nearest first, by kind."""
    language = F.coalesce("lang", F.lit(""))
    size = F.least(F.floor(F.log2(F.greatest(c["n_pieces"], F.lit(1)).cast("double"))), F.lit(LONGEST)).cast("string")
    return {"class language ": F.concat_ws(" ", size, language), "class script ": F.concat_ws(" ", size, c["script"]), "language ": language, "script ": c["script"]}


def bands(measured: DataFrame) -> DataFrame:
    """``grp``, ``measure``, its ``middle`` and ``spread``, exactly, from counts of whole thousandths.

    A group's window holds as many rows as a measure has values, not as it has texts.
    """
    c = F.col("m")
    values = F.array(*[F.named_struct(F.lit("measure"), F.lit(name), F.lit("v"), v) for name, v in scaled(c).items()])
    of = F.array(*[F.concat(F.lit(kind), own) for kind, own in groups(c).items()])
    rows = measured.where(~base_failed(c)).select(F.explode(of).alias("grp"), values.alias("values"))
    counts = rows.select("grp", F.explode("values").alias("x")).select("grp", "x.*").where("v IS NOT NULL").groupBy("grp", "measure", "v").count()
    w = Window.partitionBy("grp", "measure")
    run = counts.select("*", F.sum("count").over(w.orderBy("v")).alias("upto"), F.sum("count").over(w).alias("n"))
    at = lambda share: F.min(F.when(F.col("upto") >= F.col("n") * share, F.col("v")))
    out = run.groupBy("grp", "measure", "n").agg(at(0.25).alias("low"), at(0.5).alias("middle"), at(0.75).alias("high"))
    return out.where(F.col("n") >= LEAST).select("grp", "measure", "middle", F.greatest(F.col("high") - F.col("low"), F.lit(LEAST_SPREAD)).alias("spread"))


def judged(measured: DataFrame) -> DataFrame:
    """``measured`` (``lang``, ``m`` and other columns) and ``v``: ``base_failed`` and ``kept``."""
    c = F.col("m")
    table = stage(bands(measured), "bands")
    wide = table.groupBy("grp").agg(F.map_from_entries(F.collect_list(F.struct("measure", F.struct("middle", "spread")))).alias("bands"))
    both, found = measured, []
    for i, (kind, own_group) in enumerate(groups(c).items()):
        by = wide.where(F.col("grp").startswith(kind)).select(F.substring("grp", len(kind) + 1, 1 << 20).alias(f"__group{i}"), F.col("bands").alias(f"__bands{i}"))
        both = both.join(by, own_group == F.col(f"__group{i}"), "left")
        found.append(F.col(f"__bands{i}"))
    own = F.coalesce(*found)
    wider = F.when(F.coalesce(*found[:2]).isNotNull(), 1.0).otherwise(F.sqrt(1 + SHORT / F.greatest(c["n_pieces"], F.lit(1))))
    inside = F.lit(True)
    for name, value in scaled(c).items():
        band = own[name]
        far = WIDTH * band["spread"] * wider
        low, high = value < band["middle"] - far, value > band["middle"] + far
        inside &= ~F.coalesce(low | high if MEASURES[name] else low, F.lit(False))
    verdict = F.named_struct(F.lit("base_failed"), base_failed(c), F.lit("kept"), ~base_failed(c) & inside)
    return both.select(*[F.col(f"`{x}`") for x in measured.columns], verdict.alias("v"))


def _packed(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names], F.struct(*names).alias("m"))


MADE = [f.name for f in (*BASE, *FERTILITY)]


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``kept``, and the fertility measures of every row."""
    source = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"))
    measured = stage(_packed(measures(source, "text", ["doc_id", "lang"]), MADE), "fertility")
    c = F.col("m")
    out = judged(measured)
    return out.select("doc_id", *[c[f.name].alias(f.name) for f in BASE], "v.base_failed", "v.kept", *[c[f.name].alias(f.name) for f in FERTILITY])


def passing(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    source = docs.toDF(*names)
    own = {c: n for c, n in zip(docs.columns, names, strict=True)}
    measured = _packed(measures(source, own[text], names), MADE).withColumn("lang", F.col(own[lang]))
    return judged(stage(measured, "fertility")).where("v.kept").select(*names).toDF(*docs.columns)


