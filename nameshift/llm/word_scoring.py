"""Cross-entropy difference of documents under a target and a background model of words and word pairs.

Method: both models count words and pairs of neighbouring words over one vocabulary: the words that occur at least
``KNOWN`` times in all documents, and one class for all others. The target model sees the documents that a label marks,
the background model all documents. Background counts are scaled to the target's total, so the same smoothing weighs
equally in both. A word before with c followers gives its own distribution the weight c / (c + ``PRIOR``) and single words
the rest; those give theirs the weight N / (N + ``PRIOR``) and the even distribution over the vocabulary the rest. Each
word's loss under the target minus its loss under the background, averaged over the document, is the score: the lower, the
more like the target.

A document's own counts are taken out of both models before it is scored: word pairs are so rare that a document would
else find itself, and a label would be the score. So a pair that occurs once is evidence for no document and isn't kept.
The end of a document counts as a follower of its last word, but isn't scored.

The models grow with the corpus and never pass through the driver, which gets eight totals. Texts are read once, in place,
and staged as blocks of about ``BLOCK_BYTES`` of text: word numbers, and the hashes of the block's words. A block's counts
are dealt by the first bits of their keys, sorted and compressed; so the most frequent pair has one count for each block, not
each document, and a bucket holds about ``BUCKET`` counts at every size. Sums over a key go back to its blocks, and each block
meets its own part of both models. Words and pairs are told apart by 64-bit hashes.

Words are runs between ASCII white space. Losses are whole micronats, so sums do not depend on how rows are dealt.

Defined results: a null or empty text has 0 tokens and null losses. Every document begins after a mark of its own. Repeated
rows count as often as they come and get equal scores. A document is in the target if any of its label rows says so; null
keys and labels never do. Without words in target documents the losses are null. A null key stays. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from nameshift.llm.buffers import SLICE_BYTES, hash_spans, mix, slices, words
from nameshift.llm.frames import longs, small_batches
from nameshift.session import stage

PRIOR = 8.0
MICRO = 1_000_000
KNOWN = 2
BLOCK_BYTES = 8 << 20
BUCKET = 2 << 20
#: The hashes of the mark before a document and of the class of unknown words.
START, UNKNOWN = np.uint64(1), np.uint64(2)
_PAIR, _SECOND = np.uint64(0x165667B19E3779F9), np.uint64(0x9E3779B97F4A7C15)


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on: their lowest bytes first, as many as the largest needs, compressed."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    raw = np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return width.to_bytes(8, "little") + len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    width, size = (int.from_bytes(data[i : i + 8], "little") for i in (0, 8))
    raw = np.frombuffer(pa.decompress(data[16:], size, "zstd", asbytes=True), np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :width] = raw.T
    return out.view("<i8").ravel()


def blocks(docs: DataFrame, size: int) -> DataFrame:
    """``block``, its documents' ``doc_ids`` and numbers of words (``lens``), ``n_vocab`` and the hashes of its distinct words (``vocab``), the most frequent first, and ``ids``: each word's place there."""
    kind = docs.schema["doc_id"].dataType
    schema = StructType([StructField("block", LongType()), StructField("doc_ids", ArrayType(kind)), StructField("lens", ArrayType(LongType()))]).add("n_vocab", "long").add("vocab", "binary").add("ids", "binary")

    def block(number: int, parts: list[tuple]) -> pa.RecordBatch:
        keys, hashes, lens = zip(*parts, strict=True)
        vocab, ids, n = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        one = pa.array([0, sum(map(len, keys))], pa.int32())
        columns = [longs([number]), pa.ListArray.from_arrays(one, pa.concat_arrays(keys)), pa.ListArray.from_arrays(one, longs(np.concatenate(lens))), longs([len(vocab)]), pa.array([vocab[order].tobytes()], pa.binary()), pa.array([packed(rank[ids])], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, held = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for i, j, data, offs in slices(batch.column(1), min(size, SLICE_BYTES)):
                if parts and held + len(data) > size:
                    yield block(number, parts)
                    number, parts, held = number + 1, [], 0
                starts, ends, rows = words(data, offs)
                parts.append((batch.column(0).slice(i, j - i), hash_spans(data, starts, ends - starts), np.diff(rows)))
                held += len(data)
        if parts:
            yield block(number, parts)

    return small_batches(docs).select("doc_id", "t").mapInArrow(run, schema)


class Block:
    """The words of a block by number, and the documents that hold them; ``targets`` are the marked documents' places."""

    def __init__(self, rows: pa.RecordBatch | pa.Table, row: int = 0):
        at = lambda c: rows.column(c)[row]
        self.block, self.n_vocab, self.vocab = at("block").as_py(), at("n_vocab").as_py(), at("vocab")
        self.lens = at("lens").values.to_numpy()
        self.ids = unpacked(at("ids").as_py())
        self.doc = np.repeat(np.arange(len(self.lens)), self.lens)
        self.marked = np.zeros(len(self.lens), bool)
        self.marked[np.array(at("targets").as_py() or [], np.int64)] = True

    def hashes(self) -> np.ndarray:
        return np.frombuffer(self.vocab.as_py(), np.uint64)

    def counts(self, numbers: np.ndarray, n: int) -> list[np.ndarray]:
        """How often each number occurs in marked documents, and in all."""
        return [np.bincount(x, minlength=n) for x in (numbers[self.marked[self.doc]], numbers)]


class Pairs(Block):
    """A block once its unknown words are settled: those are one class, numbered after all words; the mark before a document follows it."""

    def __init__(self, rows: pa.RecordBatch | pa.Table, row: int = 0):
        super().__init__(rows, row)
        self.sums = np.empty((2, self.n_vocab), np.int64)
        self.sums[:, np.argsort(self.hashes())] = unpacked(rows.column("sums")[row].as_py()).reshape(2, -1)
        self.word = np.where(self.sums[1] > 0, np.arange(self.n_vocab), self.n_vocab)[self.ids]
        self.before = np.empty_like(self.word)
        self.before[1:] = self.word[:-1]
        self.before[(np.cumsum(self.lens) - self.lens)[self.lens > 0]] = self.n_vocab + 1
        self.size = self.n_vocab + 2
        self.pairs, self.pair = np.unique(self.before * self.size + self.word, return_inverse=True)

    def keys(self) -> np.ndarray:
        """Of the distinct pairs."""
        hashes = np.concatenate([self.hashes(), [UNKNOWN, START]])
        return mix(mix(hashes[self.pairs // self.size] ^ _PAIR) + hashes[self.pairs % self.size] * _SECOND)


def counted(staged: DataFrame, kind: type[Block], bits: int) -> DataFrame:
    """The distinct words of each block, or its distinct pairs, by the first ``bits`` of their sorted keys (``bucket``): steps between keys, and counts."""
    shift = np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                own = kind(batch, row)
                keys, n = (own.keys(), own.counts(own.pair, len(own.pairs))) if kind is Pairs else (own.hashes(), own.counts(own.ids, own.n_vocab))
                order = np.argsort(keys)
                keys, n = keys[order], [x[order] for x in n]
                buckets, starts = np.unique(keys >> shift, return_index=True)
                for bucket, i, j in zip(buckets.tolist(), starts.tolist(), np.append(starts, len(keys))[1:].tolist(), strict=True):
                    low = (keys[i:j] & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
                    data = [packed(x) for x in (np.diff(low, prepend=0), n[0][i:j], n[1][i:j])]
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), longs([own.block]), *[pa.array([x], pa.binary()) for x in data]], ["bucket", "block", "steps", "n_target", "n_all"])

    return staged.mapInArrow(run, "bucket int, block long, steps binary, n_target binary, n_all binary")


KNOWN_SUMS = ["n_known", "known_target", "known_all"]


def summed(rows: DataFrame, least: int) -> DataFrame:
    """Sums of a key over all blocks in place of each block's own, 0 below ``least``; one row of a bucket has its number of other keys, and their sums."""

    def run(group: pa.Table) -> pa.Table:
        parts = [np.cumsum(unpacked(x)) for x in group.column("steps").to_pylist()]
        _, at = np.unique(np.concatenate(parts), return_inverse=True)
        n = [np.bincount(at, np.concatenate([unpacked(x) for x in group.column(c).to_pylist()])).astype(np.int64) for c in ("n_target", "n_all")]
        enough = n[1] >= least
        sums = np.stack([np.where(enough, x, 0) for x in n])
        ends = np.cumsum([len(x) for x in parts])
        back = [packed(sums[:, at[j - len(x) : j]].ravel()) for x, j in zip(parts, ends, strict=True)]
        of = [enough.sum(), *sums.sum(axis=1)]
        return pa.table({"bucket": group.column("bucket"), "block": group.column("block"), "sums": pa.array(back, pa.binary()), **{c: longs([x] + [0] * (len(parts) - 1)) for c, x in zip(KNOWN_SUMS, of, strict=True)}})

    return rows.groupBy("bucket").applyInArrow(run, "bucket int, block long, sums binary, " + ", ".join(f"{c} long" for c in KNOWN_SUMS))


def returned(right: pa.Table) -> np.ndarray:
    """The target's and all sums of a block's keys in their order."""
    parts = [unpacked(x).reshape(2, -1) for x in right.sort_by("bucket").column("sums").to_pylist()]
    return np.concatenate(parts, axis=1) if parts else np.zeros((2, 0), np.int64)


SETTLED = [*KNOWN_SUMS, "words_target", "words_all", "docs_target", "docs_all"]


def settled(left: pa.Table, right: pa.Table) -> pa.Table:
    """``sums`` of a block's words in both models, by their hashes and 0 for unknown ones, and the block's part of the totals."""
    lens = left.column("lens")[0].values.to_numpy()
    marked = np.zeros(len(lens), bool)
    marked[np.array(left.column("targets")[0].as_py() or [], np.int64)] = True
    of = [*[right.column(c).to_numpy().sum() for c in KNOWN_SUMS], lens[marked].sum(), lens.sum(), (lens[marked] > 0).sum(), (lens > 0).sum()]
    return pa.table({"block": left.column("block"), "sums": pa.array([packed(returned(right).ravel())], pa.binary()), **{c: longs([x]) for c, x in zip(SETTLED, of, strict=True)}})


def losses(own: Pairs, found: np.ndarray, totals: dict[str, int]) -> list[np.ndarray]:
    """Micronats of every document under both models; ``found`` has the target's and all counts of the distinct pairs, by their keys."""
    n, size = max(len(own.pairs), 1), totals["n_known"] + 1
    rows, times = np.unique(own.doc * n + own.pair, return_counts=True)  # each distinct pair of each document
    doc, pair = rows // n, rows % n
    before, word = own.pairs[pair] // own.size, own.pairs[pair] % own.size
    seen, c = np.unique(own.doc * own.size + own.word, return_counts=True)
    mine = c[np.searchsorted(seen, doc * own.size + word)]
    at = np.minimum(np.searchsorted(seen, doc * own.size + before), max(len(seen) - 1, 0))
    # the mark before a document has one follower in it; every word has one each time, the end if none else
    mine_before = np.where(before == own.size - 1, 1, np.where(seen[at] == doc * own.size + before, c[at], 0))
    order, ends, out = np.argsort(own.keys()), np.searchsorted(doc, np.arange(len(own.lens) + 1)), []
    for model, name in enumerate(("target", "all")):
        scale = 1.0 if model == 0 else totals["words_target"] / totals["words_all"]
        taken = own.marked[doc] if model == 0 else np.ones(len(doc), bool)
        singles = np.append(own.sums[model], [totals[f"words_{name}"] - totals[f"known_{name}"], totals[f"docs_{name}"]])
        both = np.empty(len(own.pairs), np.int64)
        both[order] = found[model]
        left = lambda total, own_count: scale * np.maximum(total - np.where(taken, own_count, 0), 0)  # noqa: B023, E731
        p = (left(singles[word], mine) + PRIOR / size) / (left(totals[f"words_{name}"], own.lens[doc]) + PRIOR)
        p = (left(both[pair], times) + PRIOR * p) / (left(singles[before], mine_before) + PRIOR)
        each = np.rint(-np.log(p) * MICRO).astype(np.int64) * times
        out.append(np.diff(np.concatenate([[0], np.cumsum(each)])[ends]))
    return out


def scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label_key: str = "doc_id", label: str = "quality", wanted: int = 1, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``target_loss`` and ``background_loss`` (nats a token) and their difference ``score``."""
    own = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("t"))
    marked = labels.where(F.col(f"`{label}`") == wanted).select(F.col(f"`{label_key}`").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    staged = stage(blocks(own, block_bytes), "word-blocks")
    # a merge join at every size: labels grow with the corpus, so they are not broadcast
    targets = staged.select("block", F.posexplode("doc_ids").alias("place", "doc_id")).join(marked.hint("merge"), "doc_id")
    staged = staged.join(stage(targets.groupBy("block").agg(F.collect_list("place").alias("targets")), "targets"), "block", "left")
    n_words = staged.agg(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda total, x: total + x))).first()[0] or 0
    bits = max(1, (n_words // BUCKET).bit_length())
    found = summed(counted(staged, Block, bits), KNOWN)
    fields = ", ".join(f"{c} long" for c in SETTLED)
    known = staged.select("block", "lens", "n_vocab", "targets").groupBy("block").cogroup(found.groupBy("block")).applyInArrow(settled, f"block long, sums binary, {fields}")
    known = stage(known, "words")
    totals = {c: x or 0 for c, x in known.agg(*[F.sum(c).alias(c) for c in SETTLED]).first().asDict().items()}
    if not totals["words_target"]:
        empty = F.lit(None).cast("double")
        return staged.select(F.explode(F.arrays_zip("doc_ids", "lens")).alias("x")).select(F.col("x.doc_ids").alias("doc_id"), F.col("x.lens").alias("n_tokens"), *[empty.alias(c) for c in ("target_loss", "background_loss", "score")])
    whole = staged.join(known.select("block", "sums"), "block")
    pairs = summed(counted(whole, Pairs, bits), 2).select("bucket", "block", "sums")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        own = Pairs(left)
        sums = losses(own, returned(right), totals)
        return pa.table({"doc_id": left.column("doc_ids")[0].values, "n_tokens": longs(own.lens), "target_sum": longs(sums[0]), "background_sum": longs(sums[1])})

    schema = StructType([StructField("doc_id", own.schema["doc_id"].dataType), *[StructField(c, LongType()) for c in ("n_tokens", "target_sum", "background_sum")]])
    made = whole.groupBy("block").cogroup(pairs.groupBy("block")).applyInArrow(score, schema)
    mean = lambda c: F.when(F.col("n_tokens") > 0, F.round(c / F.col("n_tokens") / MICRO, 6))
    return made.select("doc_id", "n_tokens", mean(F.col("target_sum")).alias("target_loss"), mean(F.col("background_sum")).alias("background_loss"), mean(F.col("target_sum") - F.col("background_sum")).alias("score"))
