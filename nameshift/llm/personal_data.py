"""Personal data in whole texts: fixed patterns, and a linear-chain conditional random field over word shapes.

Method: every word (a run between ASCII white space) gets a tag: outside, or begin or inside of a kind. Scores of a word's tags are sums of
weights of features of the word, the two before it and the one after it: its shape, its length, its characters' classes, and its
lower-case form if the labelled table has it. Together with the scores of neighbouring tags they make a conditional random field,
trained on a small labelled table by gradient steps on the exact likelihood (forward and backward sums). Texts are decoded
by Viterbi in numpy batches. A word whose outside score beats all others by more than any change of its neighbours
could win back is outside in the best path, so only the stretches between such words are decoded, all of a batch at once; the
result is the path of the whole text.

Patterns give the base spans, of kinds email, ip, card and phone. The field adds spans of kinds email and phone in other spellings,
and of kinds id, name and secret; a span that touches a base span is not added, so base spans stay as they are.

Scale: texts stay where they are, there is no shuffle. Words are scored once per distinct word and task. The labelled table is bounded
by ``LABELLED`` rows; by default it is generated (``labelled_rows``), as the tables have none. The weights travel in the plan (a few MB).

Defined results: a null or empty text has no spans. Repeated rows give equal results. Null keys stay. An empty table gives an empty
result. Other columns are not read. Positions count code points. Very long texts are slices of their own.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from nameshift.llm.buffers import Interner, slices, words
from nameshift.llm.frames import small_batches

BASE = ("email", "ip", "card", "phone")
ADDED = ("email", "phone", "id", "name", "secret")
KINDS = ("email", "ip", "card", "phone", "id", "name", "secret")
TAGS = ["O"] + [f"{p}-{k}" for k in ADDED for p in "BI"]
T = len(TAGS)
LABELLED, SEED = 1600, 11
EPOCHS, BATCHES, RATE, PENALTY = 9, 10, 0.3, 1e-5
#: Scores of neighbouring tags are held small, and words are also fitted by themselves, so that a plain word is outside whatever its neighbours are.
FOLLOW_PENALTY, LOCAL = 3e-4, 0.5
#: A feature counts from so many words of the labelled table on.
LEAST = 3
#: Where the words are whose features a word's scores use.
OFFSETS = (0, -1, -2, 1)
_NO = -1e9

# --- base patterns

_HOST = re.compile(rb"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(rb"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGITS = bytes(b for b in range(256) if not 48 <= b <= 57)


def luhn(digits: bytes) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d -= 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: bytes, numbers: bool = True, mails: bool = True) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns in bytes, leftmost and without overlap in each kind; every pattern is scanned once."""
    out: list[tuple[str, int, int]] = []
    if mails:
        done = 0
        for m in _HOST.finditer(text):
            start = m.start()
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append(("email", start, m.end()))
                done = m.end()
    if numbers:
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip(b"0")) < 4 and int(p.lstrip(b"0") or b"0") <= 255 for p in m[0].split(b"."))]
        for kind, pattern, low, high in (("card", _CARD, 12, 19), ("phone", _PHONE, 9, 15)):
            for m in pattern.finditer(text):
                digits = m[0].translate(None, _NOT_DIGITS)
                if low <= len(digits) <= high and (kind == "phone" or luhn(digits)):
                    out.append((kind, m.start(), m.end()))
    return out


# --- features

_TRIM_LEFT, _TRIM_RIGHT = "\"'`([{<|*_=:;,.!?¿¡«“„", "\"'`)]}>|*_=:;,.!?»”"
_TRIM = _TRIM_LEFT + _TRIM_RIGHT


class _Letters(dict):
    """The class of a character: A and a letters, 9 a digit, others themselves."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        self[point] = found = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        return found


_LETTERS = _Letters()
_AGAIN = re.compile(r"(.)\1+", re.S)


def shape_of(word: str) -> str:
    return word[:40].translate(_LETTERS)


def shape_features(shape: str) -> list[str]:
    """What is seen of a word whose letters and digits are hidden."""
    letters, digits = shape.count("a") + shape.count("A"), shape.count("9")
    return [
        "c=" + _AGAIN.sub(r"\1", shape)[:12],
        "s=" + shape[:16] if digits and len(shape) <= 16 else "s",
        f"n={min(len(shape), 24) // 4}{'d' if digits else ''}{'l' if letters else ''}",
        f"m={min(digits, 12) // 3},{min(letters, 12) // 3}" if digits and letters else "m",
    ]


def identity_features(word: str) -> list[str]:
    """What neighbours see too: the word itself, what stands before a sign inside, and a sign at its end."""
    out = ["w=" + word.strip(_TRIM).lower()[:30]]
    if ("=" in word or ":" in word or "(" in word) and (m := _BEFORE_SIGN.match(word)) is not None:
        out.append("k=" + m[0].lower()[:12])
    if word and not word[-1].isalnum():
        out.append("e=" + word[-1])
    return out


_BEFORE_SIGN = re.compile(r"[^=:(]+(?=[=:(].)")


@dataclass
class Field:
    """Weights by place and feature, and the scores of tags that follow each other. A word's own shape counts at its own place only."""

    numbers: dict[str, int]
    weights: np.ndarray  # places x features x tags
    follow: np.ndarray

    def kind(self, word: str) -> tuple[str, ...]:
        """All of a word that counts: its shape, and those features of its identity that have weights."""
        return (shape_of(word), *[f for f in identity_features(word) if f in self.numbers])

    def scores(self, kind: tuple[str, ...]) -> np.ndarray:
        """What a word of a kind adds to the tags of the word at each place from it."""
        own = self.weights[:, [self.numbers[f] for f in kind[1:]]].sum(axis=1)
        own[0] += self.weights[0, [n for f in shape_features(kind[0]) if (n := self.numbers.get(f)) is not None]].sum(axis=0)
        return own

    def reach(self) -> np.ndarray:
        """For each tag, the least that transitions change if one word of that tag becomes outside: where no inside follows, and where one
        follows, which then becomes a begin."""
        f = self.follow
        out = np.zeros((2, T))
        for y in range(1, T):
            before = min(f[a, 0] - f[a, y] for a in range(T) if f[a, y] > _NO / 2)
            out[0, y] = before + min(f[0, b] - f[y, b] for b in range(T) if b == 0 or b % 2 == 1)
            inside = y + y % 2
            begin = inside - 1
            after = min(f[begin, c] - f[inside, c] for c in range(T) if f[inside, c] > _NO / 2)
            out[1, y] = before + f[0, begin] - f[y, inside] + after
        return out


def _legal() -> np.ndarray:
    """True where the second tag may follow the first: an inside follows its begin or inside only."""
    return np.array([[b == 0 or b % 2 == 1 or a in (b, b - 1) for b in range(T)] for a in range(T)])


# --- training


def tagged(text: str, spans: list[tuple[str, int, int]]) -> tuple[list[str], list[int]]:
    """Words of a labelled text and their tags; a word belongs to the span that it overlaps."""
    found, tags = [], []
    last = None
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        own = next((s for s in spans if s[1] < m.end() and m.start() < s[2] and s[0] in ADDED), None)
        k = 0 if own is None else 1 + 2 * ADDED.index(own[0]) + (own == last)
        last = own
        found.append(m[0])
        tags.append(k)
    return found, tags


@dataclass
class _Batch:
    """Labelled texts as arrays: rows by falling size, and the features of every word sorted by word and by feature."""

    sizes: np.ndarray
    tags: np.ndarray
    feature: np.ndarray
    words_at: np.ndarray
    first: np.ndarray
    features_at: np.ndarray
    first_of: np.ndarray
    where_of: np.ndarray

    @staticmethod
    def of(data: list[tuple[list[tuple[list[int], list[int]]], list[int]]], nf: int) -> _Batch:
        data = sorted(data, key=lambda d: -len(d[1]))
        sizes = np.array([len(d[1]) for d in data])
        longest = int(sizes[0])
        tags = np.zeros((len(data), longest), np.int64)
        where, feature = [], []
        for r, (ids, own) in enumerate(data):
            tags[r, : len(own)] = own
            for t in range(len(own)):
                for k, offset in enumerate(OFFSETS):
                    if 0 <= t + offset < len(own):
                        seen = ids[t + offset][0] + ids[t + offset][1] if not offset else ids[t + offset][0]
                        where += [r * longest + t] * len(seen)
                        feature += [k * nf + f for f in seen]
        where, feature = np.array(where, np.int64), np.array(feature, np.int64)
        by = np.argsort(where, kind="stable")
        where, feature = where[by], feature[by]
        by = np.argsort(feature, kind="stable")
        return _Batch(sizes, tags, feature, *np.unique(where, return_index=True), *np.unique(feature[by], return_index=True), where[by])

    def slopes(self, weights: np.ndarray, follow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients, per word, of the negative log-likelihood of the texts, and of the words by themselves with weight ``LOCAL``."""
        n, longest = self.tags.shape
        live = np.arange(longest)[None, :] < self.sizes[:, None]
        node = np.zeros((n * longest, T))
        if len(self.feature):
            node[self.words_at] = np.add.reduceat(weights[self.feature], self.first, axis=0)
        gap, pairs = _marginals(node.reshape(n, longest, T), follow, self.sizes)
        local = node.reshape(n, longest, T)
        local = np.exp(local - local.max(axis=2, keepdims=True))
        gap += LOCAL * local / local.sum(axis=2, keepdims=True)
        gap[~live] = 0
        gap[live, self.tags[live]] -= 1 + LOCAL
        before = np.concatenate([np.zeros((n, 1), np.int64), self.tags[:, :-1]], axis=1)
        np.add.at(pairs, (before[live], self.tags[live]), -1)
        np.add.at(pairs, (self.tags[np.arange(n), self.sizes - 1], 0), -1)
        slope = np.zeros_like(weights)
        if len(self.feature):
            slope[self.features_at] = np.add.reduceat(gap.reshape(-1, T)[self.where_of], self.first_of, axis=0)
        return slope / live.sum(), pairs / live.sum()


def train(rows: list[tuple[str, list[tuple[str, int, int]]]]) -> Field:
    """A field from labelled texts, at most ``LABELLED`` of them."""
    data = [d for d in (tagged(*r) for r in rows[:LABELLED]) if d[0]]
    seen = {w: (identity_features(w), shape_features(shape_of(w))) for d in data for w in d[0]}
    counts = Counter(f for d in data for w in d[0] for part in seen[w] for f in part)
    numbers = {f: k for k, f in enumerate(sorted(f for f, c in counts.items() if c >= LEAST))}
    nf, legal = len(numbers), _legal()
    coded = [([tuple([numbers[f] for f in part if f in numbers] for part in seen[w]) for w in found], own) for found, own in data]
    batches = [_Batch.of(part, nf) for k in range(BATCHES) if (part := coded[k::BATCHES])]
    values = [np.zeros((len(OFFSETS) * nf, T)), np.zeros((T, T))]
    mean, square = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    last = EPOCHS * len(batches)
    for step in range(1, last + 1):
        slopes = batches[step % len(batches)].slopes(values[0], np.where(legal, values[1], _NO))
        for k, penalty in enumerate((PENALTY, FOLLOW_PENALTY)):
            g = slopes[k] + penalty * values[k]
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            values[k] -= RATE * (1 - step / (last + 1)) * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
    return Field(numbers, values[0].reshape(len(OFFSETS), nf, T), np.where(legal, values[1], _NO))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _marginals(node: np.ndarray, follow: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tag probabilities of each word, and expected numbers of neighbouring tags; rows are sorted by falling size."""
    n, longest, _ = node.shape
    ahead, back = np.full(node.shape, _NO), np.zeros(node.shape)
    active = [int((sizes > t).sum()) for t in range(longest + 1)]
    ahead[:, 0] = node[:, 0] + follow[0]
    for t in range(1, longest):
        m = active[t]
        ahead[:m, t] = node[:m, t] + _lse(ahead[:m, t - 1, :, None] + follow, 1)
    at = np.arange(n)
    whole = _lse(ahead[at, sizes - 1] + follow[:, 0], 1)
    pairs = np.zeros((T, T))
    for t in range(longest - 1, -1, -1):
        m, more = active[t], active[t + 1]
        back[more:m, t] = follow[:, 0]
        if more:
            onward = follow + (node[:more, t + 1] + back[:more, t + 1])[:, None, :]
            back[:more, t] = _lse(onward, 2)
            pairs += np.exp(ahead[:more, t, :, None] + onward - whole[:more, None, None]).sum(axis=0)
    pairs[0] += np.exp(follow[0] + node[:, 0] + back[:, 0] - whole[:, None]).sum(axis=0)
    pairs[:, 0] += np.exp(ahead[at, sizes - 1] + follow[:, 0] - whole[:, None]).sum(axis=0)
    return np.exp(ahead + back - whole[:, None, None]), pairs


# --- decoding


def viterbi(node: np.ndarray, follow: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Best tags of stretches of ``node`` rows that lie between outside words; all stretches go ahead together."""
    tags = np.zeros(len(node), np.int64)
    if not len(starts):
        return tags
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    came = np.zeros((len(node), T), np.int8)
    longest = int(sizes[0])
    active = np.searchsorted(-sizes, -np.arange(longest + 1), "left")  # how many are longer than t
    best = node[starts] + follow[0]
    ended = best.copy()
    for t in range(1, longest):
        m = int(active[t])
        way = best[:m, :, None] + follow
        came[starts[:m] + t] = way.argmax(axis=1)
        best = way.max(axis=1) + node[starts[:m] + t]
        ended[:m] = best
    now = (ended + follow[:, 0]).argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        m = int(active[t])
        at = starts[:m] + t
        tags[at] = now[:m]
        now[:m] = came[at, now[:m]]
    return tags


def certain(node: np.ndarray, rows: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Words that are outside in the best path of their text; ``rows`` is where each text begins (one more than texts)."""
    out = np.ones(len(node), bool)
    behind = np.ones(len(node), bool)  # whether the text goes on
    behind[rows[1:][np.diff(rows) > 0] - 1] = False
    for y in range(1, T):
        lead = node[:, 0] - node[:, y]
        out &= lead + reach[0, y] > 1e-9
        inside = y + y % 2
        change = np.zeros(len(node))
        change[:-1] = node[1:, inside - 1] - node[1:, inside]
        out &= ~behind | (lead + reach[1, y] + change > 1e-9)
    return out


def decode(node: np.ndarray, rows: np.ndarray, field: Field, reach: np.ndarray) -> np.ndarray:
    """The best tags of all words of all texts."""
    free = ~certain(node, rows, reach)
    flag = np.concatenate([[0], free.astype(np.int8), [0]])
    change = np.diff(flag)
    begins = change[:-1] == 1
    begins[rows[:-1][np.diff(rows) > 0]] = True
    begins &= free
    starts = np.flatnonzero(begins)
    stops = np.flatnonzero(np.concatenate([free[:-1] & (~free[1:] | begins[1:]), free[-1:]])) + 1 if len(free) else starts
    return viterbi(node, field.follow, starts, stops - starts)


class Scorer:
    """Scores of words. Distinct words of a task are numbered within a bound, and so are their kinds, of which there are far fewer."""

    def __init__(self, field: Field):
        self.field, self.table, self.reach = field, Interner(1 << 17), field.reach()
        self.reset()

    def reset(self) -> None:
        self.table.reset()
        self.kinds: dict[tuple[str, ...], int] = {}
        self.kind_of = np.zeros(1024, np.int32)
        self.rows = np.zeros((1024, len(OFFSETS), T), np.float32)

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The kind of every word."""
        if self.table.full:
            self.reset()
        known = self.table.count
        ids, fresh = self.table.intern(data, starts, ends - starts)
        if known + len(fresh) > len(self.kind_of):
            self.kind_of = np.concatenate([self.kind_of[:known], np.zeros(max(len(fresh), known) + 1024, np.int32)])
        for k, word in enumerate(fresh, known):
            kind = self.field.kind(word.decode("utf-8", "replace"))
            if (at := self.kinds.get(kind)) is None:
                at = self.kinds[kind] = len(self.kinds)
                if at >= len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                self.rows[at] = self.field.scores(kind)
            self.kind_of[k] = at
        return self.kind_of[ids]

    def node(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Scores of all tags of every word."""
        kinds = self.numbers(data, starts, ends)
        out = self.rows[kinds, 0].astype(np.float64)
        text = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        for k, offset in enumerate(OFFSETS):
            if 0 < abs(offset) < len(kinds):
                here, there = (slice(-offset, None), slice(None, offset)) if offset < 0 else (slice(None, -offset), slice(offset, None))
                add = self.rows[kinds[there], k]
                add[text[here] != text[there]] = 0
                out[here] += add
        return out


def _trim(data: np.ndarray, a: int, b: int, kind: str) -> tuple[int, int]:
    text = data[a:b].tobytes().decode("utf-8", "replace")
    if kind == "secret" and (m := re.match(r"[\w-]+[=:](?=.{8})", text)):
        a, text = a + len(m[0].encode()), text[m.end() :]
    left = len(text) - len(text.lstrip(_TRIM_LEFT.replace("(", "") if text[:1] == "(" and text[1:2].isdigit() else _TRIM_LEFT))
    right = len(text) - len(text.rstrip(_TRIM_RIGHT))
    if left + right >= len(text):
        return a, b
    return a + len(text[:left].encode()), b - len(text[len(text) - right :].encode())


def found_spans(data: np.ndarray, offs: np.ndarray, scorer: Scorer) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """For every text its base spans and its added spans, in code points, by start and kind."""
    starts, ends, rows = words(data, offs)
    tags = decode(scorer.node(data, starts, ends, rows), rows, scorer.field, scorer.reach)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    hit = np.flatnonzero(tags % 2 == 1)
    stop = hit + 1
    while (more := (stop < len(tags)) & (tags[np.minimum(stop, len(tags) - 1)] == tags[hit] + 1)).any():
        stop = stop + more
    begin = np.searchsorted(hit, rows)
    digit = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    at_sign = np.concatenate([[0], np.cumsum(data == 64)])
    out = []
    order = {k: i for i, k in enumerate(KINDS)}
    for k in range(len(offs) - 1):
        a, b = int(offs[k]), int(offs[k + 1])
        numbers, mails = digit[b] > digit[a], at_sign[b] > at_sign[a]
        base = [(kind, a + x, a + y) for kind, x, y in base_spans(data[a:b].tobytes(), numbers, mails)] if numbers or mails else []
        taken = sorted((x, y) for _, x, y in base)
        added = []
        for r in range(begin[k], begin[k + 1]):
            kind = ADDED[(int(tags[hit[r]]) - 1) // 2]
            x, y = _trim(data, int(starts[hit[r]]), int(ends[stop[r] - 1]), kind)
            if not any(p < y and x < q for p, q in taken):
                added.append((kind, x, y))
        out.append(tuple(sorted(((kind, int(lead[x] - lead[a]), int(lead[y] - lead[a])) for kind, x, y in group), key=lambda s: (s[1], order[s[0]])) for group in (base, added)))
    return out


RESULT = "doc_id {key}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", labelled: DataFrame | None = None) -> DataFrame:
    """Per row: counts and hash of the base spans, and all spans as ``kind:start:end``.

    ``labelled`` has ``text`` and ``spans`` (an array of structs kind, start, end); at most ``LABELLED`` rows, those with the least hashes, are used.
    """
    field = field_of(labelled)
    source = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("t"))
    schema = RESULT.format(key=docs.schema[key].dataType.simpleString())
    names = ["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans", "n_added"]
    order = {k: i for i, k in enumerate(KINDS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(field)
        for batch in batches:
            for i, j, data, offs in slices(batch.column(1)):
                both = found_spans(data, offs, scorer)
                write = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
                counts = [pa.array([sum(s[0] == k for s in base) for base, _ in both], pa.int64()) for k in BASE]
                sums = [hashlib.sha256(write(base).encode()).hexdigest() for base, _ in both]
                spans = [write(sorted(base + added, key=lambda s: (s[1], order[s[0]]))) for base, added in both]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *counts, pa.array(sums, pa.string()), pa.array(spans, pa.string()), pa.array([len(x) for _, x in both], pa.int64())], names)

    return small_batches(source).mapInArrow(run, schema)


def field_of(labelled: DataFrame | None) -> Field:
    if labelled is None:
        return default_field()
    rows = labelled.where("text IS NOT NULL").orderBy(F.xxhash64("text"), "text").limit(LABELLED).select("text", F.coalesce("spans", F.array()).alias("spans")).collect()
    return train([(r["text"], [(s["kind"], s["start"], s["end"]) for s in r["spans"]]) for r in rows])


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train(labelled_rows(LABELLED, SEED))


# --- the default labelled table

_SYLLABLES = "ba do ki lu men tor an er ing ou eau que ción ver schü ter ñor é li sta gra pel mon ux hei vor del".split()
_CUES = {
    "phone": "tel tel. phone phone: call fax mobile telefon teléfono téléphone".split(),
    "id": "ssn SSN passport IBAN iban: tax-id dni Ausweis".split(),
    "secret": "token password api_key secret key passwd".split(),
    "name": "Mr Mr. Mrs Mrs. Ms Dr Dr. Prof. Herr Frau Mme Señor Señora".split(),
}


def _word(rng: random.Random) -> str:
    return "".join(rng.choice(_SYLLABLES) for _ in range(rng.choice([1, 1, 2, 2, 2, 3, 4])))


def _prose(rng: random.Random, n: int) -> list[str]:
    """Words of sentences with what else stands in texts: small words, capitals in a row, numbers, signs, repeats."""
    out: list[str] = []
    junk = rng.random() < 0.15
    while len(out) < n:
        size, start = rng.choice([1, 2, 4, 8, 12, 20]), len(out)
        while len(out) - start < size:
            r = rng.random()
            if r < 0.15:
                out.append(rng.choice("de es fr com org net at dot un la is and the der ein mail call my name".split()))
            elif r < 0.17:
                out += [_word(rng).capitalize() for _ in range(rng.randint(1, 4))]
            elif r < 0.18:
                out += [_word(rng)] * rng.choice([2, 3, 6])
            elif r < 0.18 + (0.3 if junk else 0.04):
                out.append(_plain(rng))
            else:
                out.append(_word(rng) + (rng.choice(["###", "%%", "***", "!!", "$"]) if junk and rng.random() < 0.5 else "," if rng.random() < 0.1 else ""))
        if rng.random() < 0.9:
            out[start] = out[start].capitalize()
        out[-1] += rng.choice([".", ".", ".", ".", "?", "!", ":", ""])
    return out


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _plain(rng: random.Random) -> str:
    """A number or sign that is no personal data."""
    return rng.choice(
        [
            lambda: _digits(rng, rng.choice([1, 2, 4, 16, 16, 12, 8, 20])),
            lambda: f"{_digits(rng, 2)}.{_digits(rng, 2)}.{rng.choice(['2019', '1998', '24'])}",
            lambda: f"{_digits(rng, 2)}:{_digits(rng, 2)}",
            lambda: f"{_digits(rng, 2)}-{_digits(rng, 2)}",
            lambda: f"{rng.randint(1900, 2030)}-{_digits(rng, 2)}-{_digits(rng, 2)}",
            lambda: "$" + _digits(rng, 3) + "." + _digits(rng, 2),
            lambda: _digits(rng, 2) + "%",
            lambda: f"{_digits(rng, 3)}.{_digits(rng, 2)}.{_digits(rng, 3)}.{_digits(rng, 2)}",
            lambda: f"v{_digits(rng, 1)}.{_digits(rng, 1)}.{_digits(rng, 1)}",
            lambda: rng.choice("| = == + - & {} () [1] [2] <p> </p> -- ... * at dot (at) the".split()),
            lambda: f"{_word(rng)}({_word(rng)},",
            lambda: f"https://{_word(rng).lower()}.org/{_word(rng)}",
            lambda: rng.choice(sum(_CUES.values(), [])),
            lambda: f"{_word(rng)}{_digits(rng, 2)}",
            lambda: f"{_word(rng)}-{_word(rng)}",
        ]
    )()


def _item(rng: random.Random) -> tuple[str, str, str, str]:
    """A kind, what stands before its span, the span, and what stands right after it."""
    kind = rng.choice(ADDED)
    name = lambda: _word(rng).capitalize()
    if kind == "email":
        user, host = _word(rng).lower() + rng.choice(["", "." + _word(rng).lower(), _digits(rng, 2)]), _word(rng).lower()
        end = rng.choice("com org net de fr es".split())
        forms = [f"{user} (at) {host} (dot) {end}", f"{user} [at] {host} [dot] {end}", f"{user} at {host} dot {end}", f"{user}(at){host}.{end}", f"{user} [at] {host}.{end}", f"{user}@{host}.{end}"]
        return kind, rng.choice(["", "", "mail ", "write to ", "email: "]), rng.choice(forms), rng.choice(["", "", ",", "."])
    if kind == "phone":
        a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
        if rng.random() < 0.6:
            return kind, rng.choice(_CUES["phone"]) + " ", rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"0{a}/{b}{c}", f"+{_digits(rng, 2)} {a} {b} {c}", f"{b}-{c}"]), rng.choice(["", "", ",", "."])
        return kind, "", rng.choice([f"({a}) {b}-{c}", f"+{_digits(rng, 1)} ({a}) {b}-{c}"]), rng.choice(["", "", ",", "."])
    if kind == "id":
        form = rng.choice([f"{_digits(rng, 3)}-{_digits(rng, 2)}-{_digits(rng, 4)}", "DE" + _digits(rng, 20), "FR" + " ".join([_digits(rng, 2), *[_digits(rng, 4) for _ in range(4)]]), rng.choice("CKX") + _digits(rng, 8)])
        return kind, rng.choice(_CUES["id"]) + rng.choice([" ", " ", ": "]), form, rng.choice(["", ",", "."])
    if kind == "name":
        return kind, rng.choice([rng.choice(_CUES["name"]) + " "] * 4 + ["my name is "]), " ".join(name() for _ in range(rng.choice([1, 2, 2, 3]))), rng.choice(["", ",", "."])
    code = "".join(rng.choice("0123456789abcdef" if rng.random() < 0.5 else "0123456789abcdefABCDEFghXYZ") for _ in range(rng.choice([16, 24, 32, 40])))
    cue = rng.choice(_CUES["secret"])
    return kind, *rng.choice([(f'{cue} = "', code, '"'), (f"{cue}: ", code, ""), (f"{cue}=", code, ""), (f"{cue} is ", _word(rng) + _digits(rng, 3) + "!x", "")])


def labelled_rows(n: int, seed: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts with their spans: words, numbers, signs, and in two of three rows personal data among them."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.choice([0, 1, 1, 1, 2, 0])):
            text += "".join(w + rng.choice([" ", " ", " ", "\n"]) for w in _prose(rng, rng.randint(1, 7)))
            kind, before, span, after = _item(rng)
            text += before
            spans.append((kind, len(text), len(text) + len(span)))
            text += span + after + " "
            if kind == "name":
                text += _word(rng).lower() + " "
        text += " ".join(_prose(rng, rng.randint(1, 25)))
        out.append((text, spans))
    return out
