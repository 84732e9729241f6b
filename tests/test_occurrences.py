"""Scores per occurrence and per window, on texts that share an id, and what is sent for them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from nameshift.functions.names import identifiers
from nameshift.operators.importance import occurrence_importance
from nameshift.operators.scoring import LinearScorer
from nameshift.operators.tokens import token_rows
from nameshift.plans.inputs import AttackInputs, gate, weighted_terms

TEXTS = [(1, "x = y + x ; y = x", 1), (2, "z = z ;", 0), (3, "", 1), (4, None, 0), (5, "a b a c", 1), (5, "a b a c", 1), (6, "a q a", 0), (6, "q x y z", 0), (7, "x y", None)]


@pytest.fixture
def texts(spark):
    return AttackInputs.prepare(*[spark.createDataFrame(TEXTS, "sample_id long, code string, label long")] * 2, block_size=5)


@pytest.mark.parametrize("kind", ["unk", "delete"])
def test_occurrence_scores_equal_the_join_of_all_tokens(texts, kind):
    names = texts.names_of(weighted_terms(texts.lexed, texts.scorer))
    attackable = texts.lexed.join(gate(texts.predictions).select("sample_id"), "sample_id", "left_semi")
    at = attackable.select("sample_id", F.posexplode("tokens").alias("pos", "name")).join(names, ["sample_id", "name"])
    score = occurrence_importance(kind, F.col("pos") < 5, texts.scorer.unseen_weight())
    want = at.select("sample_id", "name", "first_pos", "pos", score.alias("score"))
    found = texts.occurrence_scores(kind)
    assert found.count() and sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "code#" not in plan and "LeftSemi" not in plan


def test_predictions_equal_sums_over_all_terms(texts):
    """Only tokens inside the window are sent, and no text."""
    terms = weighted_terms(texts.lexed, texts.scorer).groupBy("sample_id").agg(F.first("total").alias("total"))
    want = {r.sample_id: r.total for r in terms.collect()}
    rows = texts.predictions.collect()
    assert sorted((r.sample_id, r.label) for r in rows if r.label is not None) == sorted((s, label) for s, _, label in TEXTS if label is not None)
    assert {r.sample_id: r.total for r in rows if r.sample_id in want} == want
    assert all(r.total == 0 and r.n == 0 for r in rows if r.sample_id in (3, 4))




def test_training_reads_the_texts_once(spark, monkeypatch):
    """The scorer is trained on the staged tokens of the samples."""
    seen, train = [], LinearScorer.train.__func__

    def recorded(cls, lexed, *args, **options):
        seen.append(lexed._jdf.queryExecution().optimizedPlan().toString())
        return train(cls, lexed, *args, **options)

    monkeypatch.setattr(LinearScorer, "train", classmethod(recorded))
    samples = spark.createDataFrame(TEXTS, "sample_id long, code string, label long")
    AttackInputs.prepare(samples, samples)
    assert len(seen) == 1 and "code#" not in seen[0]


def test_names_are_checked_once_for_each_word(spark):
    """Repeats are dropped before the name rules are applied."""
    lexed = spark.createDataFrame([(1, ["b", "a", "1", "b", "if", "a"]), (2, None), (3, [])], "sample_id long, tokens array<string>")
    found = lexed.select("sample_id", identifiers(F.col("tokens"), "c").alias("names"))
    assert {r.sample_id: r.names for r in found.collect()} == {1: ["b", "a"], 2: None, 3: []}
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.index("filter(") < plan.index("array_distinct(")
    assert token_rows(lexed).count() == 6


def test_terms_send_arrays_and_no_row_per_token(spark, texts):
    """What is sent before the weights are joined is a sample's array of tokens."""
    terms = weighted_terms(texts.tokens, texts.scorer, places=True)
    plan = terms._jdf.queryExecution().executedPlan().toString().splitlines()
    made = next(i for i, line in enumerate(plan) if "posexplode" in line)
    aggregates = [i for i, line in enumerate(plan) if "Aggregate(" in line and "places" in line or "collect_list" in line]
    assert aggregates and not any("Exchange" in line for line in plan[min(aggregates) : made])
