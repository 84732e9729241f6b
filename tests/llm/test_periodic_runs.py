"""Periodic runs against the comparison of all words with all later ones."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from helpers import LONG, awkward, clashing

from nameshift.llm import periodic_runs as pr


def brute(words):
    """All runs as (start, length, period), by every period in turn."""
    n, found = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            k = i
            while k + p < n and words[k] == words[k + p]:
                k += 1
            if k > i and k + p - i >= max(6, 4 * p):
                found.setdefault((i, k + p), p)
            i = k + 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def vectorised(texts):
    """The same over numbers, fast enough for long texts."""
    out = []
    for x in texts:
        found, n = {}, len(x)
        for p in range(1, n // 4 + 1):
            same = np.concatenate([[0], (x[:-p] == x[p:]).astype(np.int8), [0]])
            change = np.diff(same)
            for s, e in zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist()):
                if e + p - s >= max(6, 4 * p):
                    found.setdefault((s, e + p), p)
        out.append(sorted((s, e - s, p) for (s, e), p in found.items()))
    return out


def by_sets(texts):
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    s, e, p = pr.runs(np.concatenate(texts).astype(np.int64), offs)
    out = [[] for _ in texts]
    for a, b, q in zip(s.tolist(), e.tolist(), p.tolist()):
        k = int(np.searchsorted(offs, a, "right")) - 1
        out[k].append((a - int(offs[k]), b - a, q))
    return out


def text(rng, n):
    """Stretches of random words, of repeated blocks, and of repeated repeated blocks."""
    out = []
    while len(out) < n:
        letters = rng.choice([1, 2, 3, 1000])
        block = [rng.randrange(letters) for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 33, 64, 100]))]
        if rng.random() < 0.3:
            block = block * rng.randint(2, 6) + [rng.randrange(letters)]
        times = rng.choice([1, 1, 2, 3, 4, 5, 9])
        out += (block * times)[: len(block) * times - rng.randrange(len(block))]
    return np.array(out[:n])


@pytest.mark.parametrize("seed", range(30))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    texts = [text(rng, rng.choice([1, 5, 6, 7, 40, 300, 1500])) for _ in range(30)]
    assert by_sets(texts) == vectorised(texts)


def test_long_periods_and_strings_full_of_runs():
    rng = np.random.default_rng(1)
    fibonacci = [np.array([0]), np.array([0, 1])]
    while len(fibonacci[-1]) < 4000:
        fibonacci.append(np.concatenate([fibonacci[-1], fibonacci[-2]]))
    thue = np.array([bin(i).count("1") % 2 for i in range(4096)])
    cube = np.concatenate([np.tile(np.array([0, 1] * 5 + [2]), 40), np.tile(rng.integers(0, 9, 777), 5)])
    texts = [fibonacci[-1], thue, cube, np.zeros(5000, int), np.tile(rng.integers(0, 2, 1023), 4), np.tile(rng.integers(0, 2, 1024), 4)[:-1]]
    assert by_sets(texts) == vectorised(texts)


def test_members_are_sparse_outside_periodic_stretches():
    ids = np.random.default_rng(2).integers(0, 5, 20_000)
    h = pr.mix(ids.astype(np.uint64))
    scale = 1
    while scale < 64:
        h[: len(h) - scale] = pr.mix(h[: len(h) - scale] * pr._A + (h[scale:] ^ (h[scale:] >> np.uint64(29))) * pr._B)
        scale *= 2
    members = pr.synchronising_set(h, np.zeros(len(h), bool), np.full(len(h), len(h)), 64)
    assert np.diff(members).max() <= 64 and len(members) < 4 * len(ids) / 64


def plain(key, value, plant):
    w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in value or "").split(" ") if x]
    n = len(w)
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    number = {}
    found = vectorised([np.array([number.setdefault(x, len(number)) for x in w])])[0] if n else []
    gone = {i for s, n_, q in found for i in range(s + q, s + n_)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    sums = ["".join("%d,%d,%d\n" % r for r in found), " ".join(x for i, x in enumerate(w) if i not in gone)]
    return (key, len(found), *best, 1000 * best[1] // best[2] if found else None, *(hashlib.sha256(x.encode()).hexdigest() for x in sums))


def test_query_rows_equal_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = pr.periodic_runs(docs, plant=True).drop("runs").collect()
    want = [plain(r.doc_id, r.text, True) for r in docs.collect()]
    assert sorted(map(tuple, got)) == sorted(want)
    assert sum(r.n_runs > 0 for r in got) > 10


def test_awkward_rows(spark):
    long = " ".join(["a b c d e f g h i j k l"] * 5000)
    docs = clashing(awkward(spark)).unionByName(clashing(spark.createDataFrame([(20, long, "en", "a", 1), (21, LONG + " " + long, "en", "a", 1), (None, "x " * 9, "en", "a", 1)], awkward(spark).schema)))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for plant in (False, True):
        got = [tuple(r) for r in pr.periodic_runs(docs, plant=plant).drop("runs").collect()]
        want = [plain(k, v, plant) for k, v in rows if v is None or len(v) < 50_000]
        assert not set(want) - set(got) and len(got) == len(rows)
    assert (20, 1, 0, 60_000, 12, 5_000_000) in [r[:6] for r in pr_rows(spark, long)]


def pr_rows(spark, value):
    return [tuple(r) for r in pr.periodic_runs(spark.createDataFrame([(20, value)], "doc_id long, text string")).collect()]


def test_empty_table(spark):
    assert pr.periodic_runs(awkward(spark).limit(0)).collect() == []
