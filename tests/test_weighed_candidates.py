"""Candidates that carry the scorer's weight from the lists of fills on."""

from dataclasses import replace

from nameshift.operators import candidates
from nameshift.plans.inputs import AttackInputs


def _samples(spark):
    texts = [("int max_size = min_size + len;", 1), ("int min_size = len - max_len;", 0), ("float len = size;", 1), ("int a = b + size; b = a;", 0)]
    return spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(texts * 2)], "sample_id long, code string, label long")


def _rows(frame, *columns):
    return sorted(map(tuple, frame.select(*columns).collect()), key=str)


def test_weights_travel_with_the_words(spark):
    """The same candidates and weights as a lookup for every candidate, negative weights and words without one included."""
    samples = _samples(spark)
    inputs = AttackInputs.prepare(samples, samples.selectExpr("sample_id", "code || ' + other = 1;' AS code", "label"), block_size=20)
    columns = ["sample_id", "name", "idx", "cand", "score"]
    own = inputs.names.select("sample_id", "name")
    plain = candidates.search_space(inputs.attackable, own, inputs.fills, "c", inputs.block)
    want = _rows(inputs.scorer.weigh_rows(plain, "cand", ["sample_id"], "w_cand"), *columns, "w_cand")
    assert _rows(inputs.space(), *columns, "w_cand") == want
    weights = {r[-1] for r in want}
    assert min(weights) < 0 < max(weights) and "other" in {r[3] for r in want}


def test_weights_are_looked_up_once_per_word(spark, monkeypatch):
    samples = _samples(spark)
    inputs = AttackInputs.prepare(samples, samples, block_size=20)
    weighed = []
    weigh = inputs.scorer.weigh_rows
    monkeypatch.setattr(inputs.scorer, "weigh_rows", lambda rows, token, spread, out="w": weighed.append(rows.columns) or weigh(rows, token, spread, out))
    inputs.space()
    assert weighed and not any("sample_id" in c and "cand" in c for c in weighed)


def test_fills_are_the_same_with_weights(spark):
    """Weights beside the signatures change neither fills nor their order."""
    samples = _samples(spark)
    inputs = AttackInputs.prepare(samples, samples, block_size=20)
    gaps = spark.createDataFrame([("len", "=", "-", 1), ("max_size", "int", "=", 2), ("none", "x", "y", 1)], "name string, prev string, next string, n long")
    model = inputs.fills
    weighed = replace(model, weigh=lambda words, token: inputs.scorer.weigh_rows(words, token, [token]))
    for make in (lambda m: m.fills(gaps), lambda m: m.similar_fills(gaps)):
        assert make(weighed).collect() == make(model).collect()
    kept = weighed.kept_fills(gaps, None, None, 0)
    assert kept.drop("weights").collect() == model.kept_fills(gaps, None, None, 0).collect()
    assert all(len(r.weights) == len(r.scores) for r in kept.collect())
