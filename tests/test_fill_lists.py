"""Fills of gaps against plain loops, and what their joins send."""

import math
import re
from collections import Counter

import pytest

from nameshift.operators.candidates import FillModel

TEXTS = [
    "a b c a b d a b e a c e a d d a e b",
    "x y z x y x z y é z é y É z",
    "b c b d b e c d c e a x a y a z a é a É",
    "lone",
]
GAPS = [("b", "a", "c", 2), ("q", "a", "b", 1), ("b", "a", "nowhere", 1), ("z", "nowhere", "nothing", 1), ("c", "", "b", 1), ("é", "z", "", 3), ("lone", "", "", 1)]


def trained(spark, top_k):
    texts = [(i, t.split(" ")) for i, t in enumerate(TEXTS)] + [(9, None)]
    return FillModel.train(spark.createDataFrame(texts, "sample_id long, tokens array<string>"), top_k)


def plain_fills(prev, following, top_k):
    pairs = Counter()
    for text in TEXTS:
        toks = ["", *text.split(" "), ""]
        pairs.update(zip(toks, toks[1:]))
    score = lambda a, b: math.floor(math.log1p(pairs[a, b]) * 1e6 + 0.5)
    after = sorted((-c, b) for (a, b), c in pairs.items() if a == prev and b)[:top_k]
    before = sorted((-c, a) for (a, b), c in pairs.items() if b == following and a)[:top_k]
    found = {t for _, t in after} | {t for _, t in before}
    return sorted((-score(prev, t) - score(t, following), t) for t in found)[:top_k]


@pytest.mark.parametrize("top_k", [1, 3, 60])
def test_fills_equal_plain_loops(spark, top_k):
    model = trained(spark, top_k)
    gaps = spark.createDataFrame(GAPS, "name string, prev string, next string, n long")
    sigs = {r.tok: r.sig for r in model.words.collect()}
    fills = {(r.name, r.prev, r.next): [(f.neg, f.tok) for f in r.fills] for r in model.fills(gaps).collect()}
    similar = {(r.name, r.prev, r.next): [(s.dist, s.idx, s.cand, -s.score) for s in r.similar] for r in model.similar_fills(gaps).collect()}
    assert len(fills) == len(similar) == len(GAPS)
    for name, prev, following, _ in GAPS:
        want = plain_fills(prev, following, top_k)
        assert fills[name, prev, following] == want
        near = sorted(((sigs.get(name, 0) ^ sigs[t]).bit_count(), i, t, neg) for i, (neg, t) in enumerate(want))
        assert similar[name, prev, following] == near


def test_a_gap_sends_one_list_once(spark):
    """Lists are by far the largest part of a gap's rows: one of the two is shuffled with the gap, once, and no merged one."""
    model = trained(spark, 3)
    gaps = spark.createDataFrame(GAPS, "name string, prev string, next string, n long")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = model.similar_fills(gaps)
        text = rows._jdf.queryExecution().explainString(rows.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    sent = re.findall(r"\) Exchange[^\n]*\nInput \[\d+\]: \[([^\n]*)\]\n", text)
    assert sent
    lists = [s for s in sent if re.search(r"\bname#", s) and re.search(r"\b(after|before|fills|atoks|btoks|toks|sigs)#", s)]
    assert len(lists) == 1


def test_search_space_lexes_its_samples_once(spark, snippets, inputs, monkeypatch):
    """Texts are read for the gaps alone; distinct gaps, join and names of several pieces start from the staged gaps."""
    from nameshift.operators import candidates

    model, plans, stage = inputs.fills, [], candidates.stage

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())

    def recorded(df, label):
        seen(df)
        return stage(df, label)

    monkeypatch.setattr(candidates, "stage", recorded)
    own = inputs.names.select("sample_id", "name")
    seen(candidates.search_space(inputs.lexed, own, model, "c", 20))
    assert sum(text.count("code#") > 0 for text in plans) == 1
