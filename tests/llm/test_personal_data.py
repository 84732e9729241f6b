"""Personal data: patterns against plain regular expressions, decoding against all paths, the field against held-out rows."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from helpers import LONG, awkward, clashing

from nameshift.llm import personal_data as pd
from nameshift.llm.buffers import words

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, text):
    digits = [int(c) for c in text if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        total = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def plain(text):
    found = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "", re.ASCII) if holds(k, m[0])]
    return sorted(found, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


def spans_of(texts, field):
    data = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    return pd.found_spans(np.frombuffer(b"".join(data), np.uint8), offs, pd.Scorer(field))


@pytest.fixture(scope="module")
def field():
    return pd.default_field()


def test_base_spans_equal_plain_patterns(field):
    rng = random.Random(1)
    parts = ["a", "B.", "@", "@", ".", "-", "x.y", "com", "é", " ", " ", "+", "+1", "(", ")", "1", "22", "255", "256", "0.", "1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "\n", "%", "49 30 123456", "00000"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(4000)] + ["a" * 100_000 + "@" + "b" * 100_000, "1" * 200_000, "+1 " * 50_000, "1." * 50_000, "a@b" * 30_000]
    for text, (base, _) in zip(texts, spans_of(texts, field)):
        assert base == plain(text) if len(text) < 1000 else base is not None


def test_decoding_finds_the_best_path():
    rng = np.random.default_rng(2)
    legal = pd._legal()
    for _ in range(60):
        follow = np.where(legal, rng.normal(0, 1, (pd.T, pd.T)), pd._NO)
        f = pd.Field({}, np.zeros((len(pd.OFFSETS), 0, pd.T)), follow)
        sizes = rng.integers(0, 4, 3)
        rows = np.concatenate([[0], np.cumsum(sizes)])
        node = rng.normal(0, 1.5, (rows[-1], pd.T))
        node[:, 0] += rng.choice([0, 3, 6], rows[-1])
        got = pd.decode(node, rows, f, f.reach())
        for a, b in zip(rows[:-1], rows[1:]):
            score = lambda p: sum(node[a + k, y] for k, y in enumerate(p)) + sum(follow[x, y] for x, y in zip((0, *p), (*p, 0)))  # noqa: E731, B023
            best = max(itertools.product(range(pd.T), repeat=int(b - a)), key=score)
            assert score(got[a:b].tolist()) == pytest.approx(score(best))


def test_certain_words_do_not_change_the_path(field):
    texts = [r[0] for r in pd.labelled_rows(200, 5)]
    data = np.frombuffer(" ".join(texts).encode(), np.uint8)
    starts, ends, rows = words(data, np.array([0, len(data)]))
    node = pd.Scorer(field).node(data, starts, ends, rows)
    sure = pd.certain(node, rows, field.reach())
    whole = pd.viterbi(node, field.follow, rows[:1], np.diff(rows))
    assert sure.mean() > 0.2 and (pd.decode(node, rows, field, field.reach()) == whole).all() and not whole[sure].any()


def test_slopes_equal_differences():
    data = [([([0, 1], [2]), ([1], []), ([2, 0], [3])], [0, 3, 4]), ([([3], [0])], [1])]
    batch = pd._Batch.of(data, 4)
    rng = np.random.default_rng(3)
    weights, follow = rng.normal(0, 0.5, (16, pd.T)), np.where(pd._legal(), rng.normal(0, 0.5, (pd.T, pd.T)), pd._NO)

    def loss(w, f):
        total = 0.0
        for ids, tags in data:
            n = len(tags)
            node = np.zeros((n, pd.T))
            for t in range(n):
                for k, o in enumerate(pd.OFFSETS):
                    if 0 <= t + o < n:
                        for x in ids[t + o][0] + (ids[t + o][1] if not o else []):
                            node[t] += w[k * 4 + x]
            score = lambda p: sum(node[k, y] for k, y in enumerate(p)) + sum(f[x, y] for x, y in zip((0, *p), (*p, 0)))  # noqa: E731, B023
            total += np.log(sum(np.exp(score(p)) for p in itertools.product(range(pd.T), repeat=n))) - score(tags)
            total += pd.LOCAL * sum(np.log(np.exp(node[t]).sum()) - node[t, y] for t, y in enumerate(tags))
        return total / 4

    slope, turn = batch.slopes(weights, follow)
    for _ in range(12):
        at = tuple(rng.integers(0, s) for s in weights.shape)
        step = np.zeros_like(weights)
        step[at] = 1e-5
        assert slope[at] == pytest.approx((loss(weights + step, follow) - loss(weights - step, follow)) / 2e-5, abs=1e-6)
    for at in [(0, 0), (0, 3), (3, 4), (4, 0), (1, 0)]:
        step = np.zeros_like(follow)
        step[at] = 1e-5
        assert turn[at] == pytest.approx((loss(weights, follow + step) - loss(weights, follow - step)) / 2e-5, abs=1e-6)


def test_held_out_rows(field):
    rows = pd.labelled_rows(500, 99)
    hit = wrong = missed = 0
    for (_, spans), (base, added) in zip(rows, spans_of([r[0] for r in rows], field)):
        want, got = set(spans), {s for s in base + added if s[0] in pd.ADDED}
        hit, wrong, missed = hit + len(want & got), wrong + len(got - want), missed + len(want - got)
    assert hit / (hit + wrong) > 0.88 and hit / (hit + missed) > 0.85


def test_spans_in_context_and_clean_text(field):
    text = "Ça va? Write to anna (at) verdel (dot) org or call 212-555-7788, said Mrs Keller Vordel of the house."
    (base, added), (_, none) = spans_of([text, "The house of the man is in the old town. It was built in 1998, for $20.50, and stands."], field)
    assert base == [] and none == []
    assert {(k, text[a:b]) for k, a, b in added} >= {("email", "anna (at) verdel (dot) org"), ("phone", "212-555-7788")}


def test_query_rows(spark, folder):
    docs = clashing(awkward(spark)).select("doc_id", "text").unionByName(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    docs = docs.unionByName(spark.createDataFrame([(50, LONG + " a.b@c.org " + LONG), (51, "é 4111 1111 1111 1111, é x@y.zz")], "doc_id long, text string"))
    want = {}
    for r in docs.collect():
        base = plain(r.text)
        want.setdefault(r.doc_id, []).append((*(sum(s[0] == k for s in base) for k in PATTERNS), hashlib.sha256(",".join("%s:%d:%d" % s for s in base).encode()).hexdigest(), base))
    got = pd.personal_data(docs).collect()
    assert len(got) == docs.count() and any(r.n_email for r in got)
    for r in got:
        assert any((r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == w[:5] and {"%s:%d:%d" % s for s in w[5]} <= set(r.spans.split(",")) | {""} for w in want[r.doc_id])


def test_own_labelled_table_and_empty_table(spark):
    rows = [(f"id X{k:05d}Q is here" if k % 2 else f"number {k} is here", [("id", 3, 10)] if k % 2 else None) for k in range(120)]
    labelled = spark.createDataFrame(rows, "text string, spans array<struct<kind:string,start:int,end:int>>")
    got = pd.personal_data(spark.createDataFrame([(1, "the id X99999Q is here")], "doc_id long, text string"), labelled=labelled).first()
    assert got.spans == "id:7:14" and got.n_added == 1
    assert pd.personal_data(awkward(spark).limit(0)).collect() == []
