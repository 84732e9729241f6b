"""Mapped files of counted pairs against plain counts, and that gaps are filled without sending lists or pairs."""

from collections import Counter

import numpy as np
import pyarrow as pa

from nameshift.functions import shared_arrays
from nameshift.operators import candidates
from nameshift.operators.candidates import FillModel
from nameshift.plans.inputs import AttackInputs

TEXTS = ["a b " * 700 + "é z", "b a c", "", "z", "Z é 😀 ﬀ é"]


def _model(spark, top_k=3):
    texts = [(i, t.split()) for i, t in enumerate(TEXTS)] + [(9, None)]
    return FillModel.train(spark.createDataFrame(texts, "sample_id long, tokens array<string>"), top_k)


def _pairs():
    found = Counter()
    for text in TEXTS:
        toks = ["", *text.split(), ""]
        found.update(zip(toks, toks[1:]))
    return found


def test_pairs_and_words_equal_plain_counts(spark):
    """Counts beyond one byte, both ends of a text and an empty text included."""
    model, want = _model(spark), _pairs()
    assert {(r.a, r.b): r.c for r in model.pairs.collect()} == dict(want)
    assert {r.tok: r.n for r in model.words.collect()} == Counter(t for text in TEXTS for t in text.split())
    toks = sorted({t for pair in want for t in pair} | {"never"}, key=str.encode)
    hashes = dict(spark.createDataFrame([(t,) for t in toks], "t string").selectExpr("t", "xxhash64(t)").collect())
    numbers = model.index.vocabulary.numbers(np.array([hashes[t] for t in toks], np.int64))
    assert numbers[toks.index("never")] == -1 and [n for n in numbers if n >= 0] == list(range(len(toks) - 1))
    both = [(a, b) for a in toks for b in toks if "never" not in (a, b)]
    at = {t: n for t, n in zip(toks, numbers)}
    found = model.index.pairs.counts(np.array([at[a] for a, _ in both]), np.array([at[b] for _, b in both]))
    assert found.tolist() == [want[pair] for pair in both] and found.max() >= 255
    assert model.index.vocabulary.texts(numbers[numbers >= 0]).to_pylist() == [t for t in toks if t != "never"]


def test_gaps_are_filled_without_joins(spark):
    """Neither lists nor pairs are sent to gaps, so what is written does not grow with gaps times ``top_k``."""
    model = _model(spark)
    gaps = spark.createDataFrame([("a", "", "b", 1), ("q", "a", "never", 2)], "name string, prev string, next string, n long")
    for rows in (model.fills(gaps), model.similar_fills(gaps), model.kept_fills(gaps, None, None, 0)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan and plan.count("RepartitionByExpression") == 1


def test_outcome_notes_keep_no_space(inputs):
    """Candidates are counted as they are made, and names in their own texts; the same counts as of the staged tables."""
    fresh = AttackInputs.prepare(inputs.samples, inputs.samples, smoothing=3.0, block_size=20)
    counted = [sorted(map(tuple, f.collect())) for f in (fresh.space_counts(), fresh.name_counts())]
    assert not fresh._spaces and "terms" not in fresh.__dict__ and all(counted)
    assert counted[0] == sorted(map(tuple, fresh.space().groupBy("sample_id").count().collect()))
    assert fresh.names.count() and counted[1] == sorted(map(tuple, fresh.name_counts().collect()))


def test_fill_model_needs_no_scorer(spark, snippets):
    inputs = AttackInputs.prepare(snippets, snippets, scorer_later=True)
    assert inputs.fills.words.count() and "scorer" not in inputs.__dict__
    assert inputs.scorer is inputs.scorer and "scorer" in inputs.__dict__


def test_dealt_rows_come_back_by_receiver(tmp_path):
    part, value = np.array([2, 0, 2, 2]), np.array([5, -1, 2**31 - 1, 0])
    uris = [shared_arrays.write_dealt(str(tmp_path), 3, part, [value, part]) for _ in range(2)]
    assert [read[0].tolist() for read in (shared_arrays.read_dealt(uris, p, 2) for p in range(3))] == [[-1, -1], [], [5, 2**31 - 1, 0] * 2]
    lists = pa.array([[1] * 5, None, [], [2] * 3, [3]])
    assert [len(x) for x in shared_arrays.slices(lists, 4)] == [1, 4]


def _merged(model, lists):
    return {(r.sample_id, r.name): list(zip(r.cands, r.scores)) for r in candidates.merge_candidates(lists, model).collect()}


def test_candidates_are_merged_where_the_sample_lies(spark):
    """Against plain loops over ``similar_fills``: texts that share an id, ids that are null, own names beyond the window; no list is sent."""
    texts = [(1, "a b a c d a b e".split()), (1, "b c b q".split()), (2, "x y z x w y".split()), (None, "a b c".split()), (3, None), (4, [])]
    lexed = spark.createDataFrame(texts, "sample_id long, tokens array<string>")
    model = candidates.FillModel.train(lexed, 4)

    def lists(own_names):
        gaps = candidates.contexts(candidates.whole_samples(lexed), "c", 4, own_names)
        return candidates.gap_candidates(gaps, lambda rows: model.near_fills(rows, valid_only=False))

    plain = candidates.contexts(lexed, "c", 4)
    want, own = {}, {}
    for r in model.similar_fills(plain).collect():
        best = want.setdefault((r.sample_id, r.name), {})
        for s in r.similar[: len(r.similar) // 2]:
            best[s.cand] = max(s.score, best.get(s.cand, 0))
    for sample, toks in texts:
        own.setdefault(sample, set()).update(toks or [])
    for struck in (True, False):
        kept = {k: sorted(((c, s) for c, s in v.items() if not struck or c not in own[k[0]]), key=lambda e: (-e[1], e[0])) for k, v in want.items()}
        made = candidates.drop_own_names(lists(True)) if struck else lists(False)
        assert _merged(model, made) == {k: v for k, v in kept.items() if v}
    plan = candidates.merge_candidates(lists(False), model)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
