"""Word-model scores against dictionaries."""

import math
import random
from collections import Counter

import pytest
from helpers import DOCS, awkward, clashing

from nameshift.llm import queries, word_scoring


def brute_losses(texts, marked):
    """The interpolated models with dictionaries, without the document that is scored."""
    split = [(t or "").encode().split() for t in texts]
    times = Counter(w for t in split for w in t)
    known = [[w if times[w] >= word_scoring.KNOWN else None for w in t] for t in split]
    size = len({w for t in known for w in t if w is not None}) + 1
    pairs = [Counter(zip(["<s>", *t], t, strict=False)) for t in known]
    totals = [sum(len(t) for t, own in zip(known, marked, strict=True) if own), sum(map(len, known))]
    out = []
    for i, t in enumerate(known):
        row = []
        for model in (0, 1):
            rest = Counter()
            for j, p in enumerate(pairs):
                if j != i and (model or marked[j]):
                    rest.update(p)
            f, loss = totals[0] / totals[1] if model else 1.0, 0
            for a, b in zip(["<s>", *t], t, strict=False):
                single = f * sum(n for (_, y), n in rest.items() if y == b)
                before = f * sum(n for (x, y), n in rest.items() if x == a)
                before += f * sum(other[-1:] == [a] for j, other in enumerate(known) if j != i and (model or marked[j]))
                p = (single + word_scoring.PRIOR / size) / (f * sum(rest.values()) + word_scoring.PRIOR)
                loss += round(-1e6 * math.log((f * rest[a, b] + word_scoring.PRIOR * p) / (before + word_scoring.PRIOR)))
            row.append(loss / len(t) / 1e6 if t else None)
        out.append(row)
    return out


@pytest.mark.parametrize("block_bytes", [1, 40, 1 << 20])
def test_word_losses_equal_brute_force(spark, block_bytes, monkeypatch):
    monkeypatch.setattr(word_scoring, "BUCKET", block_bytes)  # several buckets in the first case
    texts = ["the cat sat on the mat", "a dog a log the cat", "", "xx yy zz xx yy xx yy", "the mat\nthe cat once", None, "the cat sat on the mat", "once"]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(0, 1), (4, 1), (4, 0), (3, 0), (None, 1), (77, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in word_scoring.scores(docs, labels, block_bytes=block_bytes).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(brute_losses(texts, [i in (0, 4) for i in range(len(texts))])):
        assert got[i].n_tokens == len((texts[i] or "").split())
        for have, exact in zip((got[i].target_loss, got[i].background_loss), want, strict=True):
            assert have == pytest.approx(exact, abs=2e-6) if exact is not None else have is None


def test_word_scores_on_awkward_rows(spark):
    docs = clashing(awkward(spark))
    labels = spark.createDataFrame([(1, 1), (6, 1)], "doc_id long, quality int")
    got = word_scoring.scores(docs, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in docs.collect())
    assert len({(r.target_loss, r.score) for r in got if r.doc_id == 1}) == 1
    none = word_scoring.scores(docs, labels.limit(0)).collect()
    assert len(none) == len(got) and all(r.score is None for r in none)
    assert {(r.doc_id, r.n_tokens) for r in none} == {(r.doc_id, r.n_tokens) for r in got}
    assert word_scoring.scores(docs.limit(0), labels).count() == 0


def test_query_tells_wrong_word_order_from_the_targets(spark, tmp_path):
    """Every document has the same words, so the same letter groups but for those across a blank."""
    r = random.Random(3)
    line = "alpha bravo delta gamma kappa omega sigma theta".split()
    good = [" ".join(line * 10) for _ in range(40)]
    bad = [" ".join(x for _ in range(10) for x in r.sample(line, 8)) for _ in range(40)]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(good + bad)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {x.doc_id: x for x in queries.QUERIES["op9_lm_scoring"](spark, str(tmp_path)).collect()}
    assert all(x.n_tokens == 80 for x in got.values())
    assert max(got[i].score for i in range(40)) < min(got[i].score for i in range(40, 80))
    assert max(got[i].score for i in range(20)) == pytest.approx(max(got[i].score for i in range(20, 40)), abs=0.05)  # a label alone is no evidence
