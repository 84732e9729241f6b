"""Quality classifier by co-training on two views of a document.

Method: one logistic model sees the text's content (shares of character classes, word figures, and hashed words, word pairs and letter
triples), another the document's metadata (language, source, length). In each round both models score every unlabelled document, and
either hands the ones that it is surest of to the other model's training set. Both are then calibrated on labelled rows that neither
was trained on, and the calibrated log-odds are combined by weights fitted on those rows. All documents are scored where they lie.

Scale: the features of all documents are staged once, a few hundred bytes each. A round is one pass over them; tasks keep their own
``PER_ROUND`` surest rows of each kind, so little is shuffled. The models are fitted on the driver, on at most ``LABELLED`` labelled rows
(those with the smallest key hashes, so the sample is the same for every partitioning) and ``4 * PER_ROUND`` pseudo-labels a round.

Defined results: a null, empty or wordless text has score 0 and is rejected. Null metadata are a value of their own.
Repeated rows get equal scores. A label is the mean of its rows, nulls left out; a tie counts as good. Without
``LEAST`` rows of either class nothing is known: scores are null and every row is kept. A null key stays. An empty
table gives an empty result. The columns made here are named in the result only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField

from nameshift.llm.buffers import WORD_BREAK, eights, hash_spans, lower_ascii, mix, words
from nameshift.llm.frames import binaries, map_text, small_batches
from nameshift.session import stage

LABELLED, LEAST = 6000, 20
ROUNDS, SURE, PER_ROUND = 4, 0.97, 500
#: A document is kept from this combined probability on: losing a good one costs more than keeping a bad one.
KEPT_FROM = 0.3
#: Penalty of the views' weights: hashed features are many, labelled rows few.
PENALTY = 30.0
LANG_BUCKETS, SOURCE_BUCKETS, LENGTH_BUCKETS = 16, 64, 32
META = LANG_BUCKETS + SOURCE_BUCKETS + LENGTH_BUCKETS


def _set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_CLASSES = np.stack(
    [
        _set(bytes(range(0x61, 0x7B))),
        _set(bytes(range(0x41, 0x5B))),
        _set(bytes(range(0x30, 0x3A))),
        _set(b".,;:"),
        _set(b"!?"),
        _set(b"#*$%&|<>"),
        _set(b"()[]{}=+_/\\@~^\"'`-"),
        _set(b"\n"),
        _set(bytes(range(0x80, 0x100))),
    ]
)
#: Buckets of hashed words and word pairs, and of hashed letter triples.
WORD_GRAMS, LETTER_GRAMS = 64, 64
FIGURES = len(_CLASSES) + 7
FEATURES = FIGURES + WORD_GRAMS + LETTER_GRAMS
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def _hashed(rows: np.ndarray, hashes: np.ndarray, n_rows: int, size: int) -> np.ndarray:
    """Square roots of the shares that each bucket has of a row's hashes."""
    counts = np.bincount(rows * size + (hashes % np.uint64(size)).astype(np.int64), minlength=n_rows * size).reshape(n_rows, size)
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))


def grams(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Hashed words and neighbouring words, then hashed letter triples, of whole texts in lower case."""
    data = lower_ascii(data)
    n = len(offs) - 1
    starts, ends, rows = words(data, offs)
    h, of = hash_spans(data, starts, ends - starts), np.repeat(np.arange(n), np.diff(rows))
    near = of[1:] == of[:-1]
    pairs = mix(h[:-1] * _PAIR ^ h[1:])[near]
    out = [_hashed(np.concatenate([of, of[1:][near]]), np.concatenate([h, pairs]), n, WORD_GRAMS)]
    three = np.flatnonzero(~WORD_BREAK[data])
    three = three[three + 3 <= len(data)]
    of = np.searchsorted(offs, three, "right") - 1
    inside = three + 3 <= offs[of + 1]
    out.append(_hashed(of[inside], mix(eights(data)[three[inside]] & np.uint64(0xFFFFFF)), n, LETTER_GRAMS))
    return np.concatenate(out, axis=1)


def content(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Features of whole texts, a row each; a row of zeros for a text without words."""
    starts, ends, rows = words(data, offs)
    n_rows, n_bytes, n_words = len(offs) - 1, np.diff(offs), np.diff(rows)
    per = np.maximum(n_words, 1)
    out = np.zeros((n_rows, FEATURES))
    out[:, FIGURES:] = grams(data, offs)
    ink = np.concatenate([[0], np.cumsum(~WORD_BREAK[data])])
    inked = np.maximum(np.diff(ink[offs]), 1)
    for k, members in enumerate(_CLASSES):
        out[:, k] = np.diff(np.concatenate([[0], np.cumsum(members[data])])[offs]) / inked
    lens = ends - starts
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[rows])
    hashes = hash_spans(data, starts, lens)
    distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)])
    same = np.zeros(len(hashes))
    same[1:] = hashes[1:] == hashes[:-1]
    upper, plain = _CLASSES[1], _CLASSES[0] | _CLASSES[1] | _CLASSES[8]
    k = len(_CLASSES)
    out[:, k] = total(lens) / per / 10
    out[:, k + 1] = np.log1p(distinct) / np.log1p(per)
    out[:, k + 2] = total(same) / per
    if len(starts):
        out[:, k + 3] = total(~plain[data[starts]]) / per
        out[:, k + 4] = total(~(plain | _CLASSES[3])[data[ends - 1]]) / per
        out[:, k + 5] = total(upper[data[starts]] & upper[data[ends - 1]] & (lens > 1)) / per
    out[:, k + 6] = np.log1p(n_bytes) / 10
    out[n_words == 0] = 0
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Logistic:
    """L2-penalised logistic regression, fitted by Newton steps."""

    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> Logistic:
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale[scale < 1e-9] = 1.0
        z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
        ridge = np.full(z.shape[1], penalty)
        ridge[0] = 1e-3
        w = np.zeros(z.shape[1])
        for _ in range(30):
            p = sigmoid(z @ w)
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
            w += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-6:
                break
        return Logistic(w, mean, scale)

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.weights[0] + ((x - self.mean) / self.scale) @ self.weights[1:]


@dataclass
class Views:
    """Both models, and the intercept and weights that combine them."""

    text: Logistic
    meta: Logistic
    calibration: np.ndarray  # of each view: slope and intercept
    combined: np.ndarray

    def calibrated(self, view: int, odds: np.ndarray) -> np.ndarray:
        slope, shift = self.calibration[view]
        return slope * odds + shift

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        both = self.calibrated(0, self.text.odds(text)), self.calibrated(1, self.meta.odds(meta))
        return sigmoid(self.combined[0] + self.combined[1] * both[0] + self.combined[2] * both[1])


def _platt(odds: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    m = Logistic.fit(odds[:, None], y)
    slope = m.weights[1] / m.scale[0]
    return (slope, m.weights[0] - slope * m.mean[0]) if slope > 0 else (0.0, m.weights[0] - m.weights[1] * m.mean[0] / m.scale[0])


def one_hot(meta: np.ndarray) -> np.ndarray:
    """Language, source and length buckets as indicator columns."""
    out = np.zeros((len(meta), META))
    rows = np.arange(len(meta))
    for k, start in enumerate((0, LANG_BUCKETS, LANG_BUCKETS + SOURCE_BUCKETS)):
        out[rows, start + meta[:, k]] = 1
    return out


def held_out(n: int) -> np.ndarray:
    """Every fourth labelled row is kept for calibration."""
    return np.arange(n) % 4 == 3


def calibrated(models: list[Logistic], text: np.ndarray, meta: np.ndarray, y: np.ndarray) -> Views:
    """Both models with their calibration and combination, fitted on labelled rows that they have not seen."""
    odds = [models[0].odds(text), models[1].odds(meta)]
    calibration = np.array([_platt(o, y.astype(float)) for o in odds])
    both = np.column_stack([s * o + t for (s, t), o in zip(calibration, odds, strict=True)])
    joint = Logistic.fit(both, y.astype(float))
    slopes = joint.weights[1:] / joint.scale
    return Views(*models, calibration, np.array([joint.weights[0] - slopes @ joint.mean, *slopes]))


def buckets(lang: Column, source: Column, n_chars: Column) -> Column:
    length = F.least(F.floor(F.log2(F.greatest(F.coalesce(n_chars, F.lit(0)), F.lit(0)) + F.lit(1.0))), F.lit(LENGTH_BUCKETS - 1))
    return F.array(F.pmod(F.xxhash64(lang), F.lit(LANG_BUCKETS)), F.pmod(F.xxhash64(source), F.lit(SOURCE_BUCKETS)), length.cast("long"))


def smallest_hashes(keys: DataFrame, bound: int) -> DataFrame:
    return keys.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def packed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.float32).view(np.uint8).ravel()


def unpacked(column: pa.Array | list[bytes]) -> np.ndarray:
    values = b"".join(column.to_pylist() if isinstance(column, pa.Array) else column)
    return np.frombuffer(values, np.float32).reshape(-1, FEATURES).astype(np.float64)


def view_rows(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """Staged features of every row with a key: ``doc_id, k`` (its hash), ``meta, x``, whether it is ``known``, and ``y`` of the sample."""

    def make():
        def function(data: np.ndarray, offs: np.ndarray) -> list[pa.Array]:
            x = content(data, offs)
            return [binaries(packed(x), np.arange(len(x) + 1) * FEATURES * 4)]

        return function

    made = map_text(docs.where("doc_id IS NOT NULL"), "text", make, [StructField("x", BinaryType())], ["doc_id", "meta"])
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    sample = smallest_hashes(known, labelled)  # at most ``labelled`` rows
    marked = made.join(known.select("doc_id", F.lit(True).alias("known")), "doc_id", "left").join(F.broadcast(sample), "doc_id", "left")
    return stage(marked.select("doc_id", F.xxhash64("doc_id").alias("k"), "meta", "x", F.coalesce("known", F.lit(False)).alias("known"), "y"), "quality-views")


def surest(rows: DataFrame, models: list[Logistic], taken: np.ndarray, most: int = PER_ROUND) -> DataFrame:
    """Of all unlabelled rows not yet ``taken``, by either model (``own``) the ``most`` surest good and bad ones (``good``)."""
    schema = "own int, good boolean, p double, k long, meta array<bigint>, x binary"
    arrow = pa.schema([("own", pa.int32()), ("good", pa.bool_()), ("p", pa.float64()), ("k", pa.int64()), ("meta", pa.list_(pa.int64())), ("x", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, bool], pa.Table] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.asarray(batch.column(0))
            free = ~np.isin(k, taken)
            views = unpacked(batch.column(2)), one_hot(np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.int64))
            for own in (0, 1):
                p = sigmoid(models[own].odds(views[own]))
                for good in (True, False):
                    at = np.flatnonzero(free & (p >= SURE if good else p <= 1 - SURE))
                    at = at[np.lexsort((k[at], -p[at] if good else p[at]))][:most]
                    new = pa.table([pa.array(np.full(len(at), own, np.int32)), pa.array(np.full(len(at), good)), pa.array(p[at]), *[batch.column(c).take(pa.array(at)) for c in range(3)]], schema=arrow)
                    both = pa.concat_tables([best[own, good], new]) if (own, good) in best else new
                    best[own, good] = both.sort_by([("p", "descending" if good else "ascending"), ("k", "ascending")]).slice(0, most)
        for table in best.values():
            yield from table.combine_chunks().to_batches()

    found = small_batches(rows.where("NOT known").select("k", "meta", "x")).mapInArrow(run, schema)
    order = Window.partitionBy("own", "good").orderBy(F.when(F.col("good"), -F.col("p")).otherwise(F.col("p")), "k", "x")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Views | None:
    """``docs`` with doc_id, text and meta (its buckets); ``labels`` with doc_id and quality. None if a class is too rare."""
    rows = view_rows(docs, labels, labelled)
    own = rows.where("y IS NOT NULL").groupBy("doc_id", "k", "y").agg(F.min(F.struct("meta", "x")).alias("v"))
    got = own.orderBy("k", "doc_id").select("y", "v.meta", "v.x").limit(labelled).toPandas()
    if not len(got):
        return None
    y, text, meta = got["y"].to_numpy().astype(int), unpacked(got["x"].tolist()), one_hot(np.stack(got["meta"].to_numpy()).astype(np.int64))
    held = held_out(len(y))
    if min((y[~held] == 0).sum(), (y[~held] == 1).sum()) < LEAST or len(set(y[held].tolist())) < 2:
        return None
    x, targets, taken = [text[~held], meta[~held]], [y[~held].astype(float)] * 2, np.zeros(0, np.int64)
    for _ in range(ROUNDS):
        models = [Logistic.fit(a, b, PENALTY) for a, b in zip(x, targets, strict=True)]
        new = surest(rows, models, taken).orderBy("own", "good", "r").toPandas()  # at most 4 * PER_ROUND rows
        if not len(new):
            break
        views = unpacked(new["x"].tolist()), one_hot(np.stack(new["meta"].to_numpy()).astype(np.int64))
        for view in (0, 1):
            other = (new["own"] != view).to_numpy()
            x[view] = np.concatenate([x[view], views[view][other]])
            targets[view] = np.concatenate([targets[view], new["good"].to_numpy()[other].astype(float)])
        taken = np.union1d(taken, new["k"].to_numpy())
    models = [Logistic.fit(a, b, PENALTY) for a, b in zip(x, targets, strict=True)]
    return calibrated(models, text[held], meta[held], y[held])


def scored(docs: DataFrame, views: Views | None, text: str, lang: str, source: str, n_chars: str, keep: list[str]) -> DataFrame:
    """``keep``, the probabilities ``text_score`` and ``meta_score`` of the views, their ``score``, and ``kept``."""
    if views is None:
        nothing = F.lit(None).cast("double")
        return docs.select(*[F.col(f"`{c}`") for c in keep], nothing.alias("text_score"), nothing.alias("meta_score"), nothing.alias("score"), F.lit(True).alias("kept"))
    meta = views.meta.weights[1:] / views.meta.scale
    start = float(views.meta.weights[0] - meta @ views.meta.mean)
    parts = np.split(meta, [LANG_BUCKETS, LANG_BUCKETS + SOURCE_BUCKETS])
    b = buckets(F.col(f"`{lang}`"), F.col(f"`{source}`"), F.col(f"`{n_chars}`"))
    odds = sum((F.get(F.array(*[F.lit(float(v)) for v in part]), b[k].cast("int")) for k, part in enumerate(parts)), F.lit(start))
    names = [f"k{i}" for i in range(len(keep))]
    source_rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], odds.alias("m"), F.col(f"`{text}`").alias("t"))

    def make():
        def function(data: np.ndarray, offs: np.ndarray) -> list[pa.Array]:
            x = content(data, offs)
            return [pa.array(views.calibrated(0, views.text.odds(x)), pa.float64(), mask=~x.any(axis=1))]

        return function

    made = map_text(source_rows, "t", make, [StructField("t", DoubleType())], [*names, "m"])
    t, m = F.col("t"), F.lit(float(views.calibration[1][0])) * F.col("m") + F.lit(float(views.calibration[1][1]))
    c = [float(v) for v in views.combined]
    p = lambda x: 1 / (1 + F.exp(-x))
    score = F.round(F.coalesce(p(c[0] + c[1] * t + c[2] * m), F.lit(0.0)), 6)
    return made.select(*[F.col(n).alias(k) for n, k in zip(names, keep, strict=True)], F.round(F.coalesce(p(t), F.lit(0.0)), 6).alias("text_score"), F.round(p(m), 6).alias("meta_score"), score.alias("score"), (score >= KEPT_FROM).alias("kept"))


def fitted(docs: DataFrame, labels: DataFrame, key: str, text: str, lang: str, source: str, n_chars: str, label_key: str, label: str) -> Views | None:
    col = lambda c: F.col(f"`{c}`")
    own = docs.select(col(key).alias("doc_id"), col(text).alias("text"), buckets(col(lang), col(source), col(n_chars)).alias("meta"))
    return train(own, labels.select(col(label_key).alias("doc_id"), col(label).alias("quality")))


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", n_chars: str = "n_chars", label_key: str = "doc_id", label: str = "quality") -> DataFrame:
    """``doc_id``, the scores and ``kept`` of every row of ``docs``."""
    views = fitted(docs, labels, key, text, lang, source, n_chars, label_key, label)
    return scored(docs, views, text, lang, source, n_chars, [key]).withColumnRenamed(key, "doc_id")


def passing(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", n_chars: str = "n_chars", label_key: str = "doc_id", label: str = "quality") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    views = fitted(docs, labels, key, text, lang, source, n_chars, label_key, label)
    names = [f"d{i}" for i in range(len(docs.columns))]
    own = {c: n for c, n in zip(docs.columns, names, strict=True)}
    made = scored(docs.toDF(*names), views, own[text], own[lang], own[source], own[n_chars], names)
    return made.where("kept").select(*names).toDF(*docs.columns)
