"""Counts of tokens inside their own text."""

import re
from collections import Counter

from pyspark.sql import functions as F

from nameshift.operators.scoring import LinearScorer
from nameshift.plans.inputs import window_scores

TEXTS = [(1, ["a", "b", "a", "é", "c", "c"]), (2, ["b"]), (3, []), (4, None), (None, ["a", "a"]), (5, ["c", "a", "c", "b", "c", "a", "a"]), (2, ["b"])]


def test_window_tokens_are_sent_for_their_weights_alone(spark):
    """No row per sample and token is grouped before the weights are joined; texts that share an id add up."""
    lexed = spark.createDataFrame(TEXTS, "sample_id long, tokens array<string>")
    weights = spark.createDataFrame([("a", 3, 5), ("b", -2, 4), ("c", 10, 5)], "tok string, w long, n long")
    scorer = LinearScorer(weights, spark.createDataFrame([(7,)], "w long"), 4)
    found = window_scores(lexed, scorer)
    w = {"a": 3, "b": -2, "c": 10}
    want = Counter()
    for sample, tokens in TEXTS:
        if tokens:
            want[sample] += sum(w.get(t, 7) for t in tokens[:4])
    assert {r.sample_id: r.total for r in found.collect()} == dict(want)
    assert {r.sample_id: r.n for r in found.where(F.col("sample_id") == 1).collect()} == {1: 4}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[sample_id#\d+L?, tok#", plan)
