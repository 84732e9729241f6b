"""Merging of candidate lists in batches of whole samples."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import functions as F

from nameshift.functions.fill_lists import candidate_batches
from nameshift.operators import candidates


def _rows(seed=3):
    """Samples 1 to 9 and one without an id; names in several lists, words of several alphabets, own names."""
    rng = random.Random(seed)
    words = ["a", "b", "é", "Z", "zz", "ﬀ", "😀", "w1", "w2", "w3"]
    rows = []
    for sample in [None, *range(1, 10)]:
        rows += [(sample, None, [(rng.choice(words), 0)]) for _ in range(rng.randrange(3))]
        for name in sorted(rng.sample(words, 4), key=str.encode):
            rows += [(sample, name, [(rng.choice(words), rng.randrange(-5, 5)) for _ in range(rng.randrange(4))]) for _ in range(rng.randrange(1, 4))]
    return rows


def _plain(rows):
    own, best = {}, {}
    for sample, name, kept in rows:
        for cand, score in kept:
            if name is None:
                own.setdefault(sample, set()).add(cand)
            else:
                at = best.setdefault((sample, name), {})
                at[cand] = max(score, at.get(cand, score))
    out = []
    for (sample, name), scores in best.items():
        left = sorted(((-s, c.encode(), c) for c, s in scores.items() if c not in own.get(sample, ())))
        out += [(sample, name, i + 1, c, -s) for i, (s, _, c) in enumerate(left)]
    return sorted(out, key=str)


def test_candidates_of_samples_cut_by_batches():
    rows = _rows()
    kind = pa.schema([("sample_id", pa.int64()), ("name", pa.string()), ("kept", pa.list_(pa.struct([("cand", pa.string()), ("score", pa.int64())])))])
    table = pa.Table.from_pylist([{"sample_id": s, "name": n, "kept": [{"cand": c, "score": v} for c, v in k]} for s, n, k in rows], kind)
    for size in (1, 2, 7, 1000):
        found = [tuple(r.values()) for b in candidate_batches(iter(table.to_batches(size))) for r in b.to_pylist()]
        assert sorted(found, key=str) == _plain(rows)
    assert not list(candidate_batches(iter(table.slice(0, 0).to_batches())))


def test_foreign_candidates_sort_no_row_per_candidate(spark):
    """Lists are sent once, by sample, and neither grouped nor sorted as rows of a candidate each."""
    rows = _rows(4)
    lists = spark.createDataFrame([r for r in rows if r[1] is not None], "sample_id long, name string, kept array<struct<cand:string,score:bigint>>")
    own = spark.createDataFrame([(s, c) for s, n, k in rows if n is None for c, _ in k], "sample_id long, name string")
    made = candidates.foreign_candidates(lists, own)
    assert sorted((tuple(r) for r in made.collect()), key=str) == _plain(rows)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan and plan.count("Repartition") == 1


def test_names_are_ranked_before_they_meet_their_candidates(inputs):
    rows = inputs.search_rows(inputs.space(), "unk")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    ranked = plan[plan.index("Window"):]
    assert ranked.count("Join") < plan.count("Join")
    names = rows.groupBy("sample_id", "name").agg(F.countDistinct("rank").alias("n"))
    assert not names.where("n > 1").count()


def test_word_composition_makes_no_lists_of_neighbours(spark, monkeypatch):
    """Lists are made for gaps; names composed from the counted words alone need none."""
    lexed = spark.createDataFrame([(1, ["max_size", "=", "min_size", "+", "max_len"])], "sample_id long, tokens array<string>")
    made, stage = [], candidates.stage
    monkeypatch.setattr(candidates, "stage", lambda df, label: made.append(label) or stage(df, label))
    model = candidates.FillModel.train(lexed)
    names = model.words.where(F.col("tok").contains("_")).select(F.col("tok").alias("name"))
    assert candidates.compose_words(names, model.words).count()
    assert made == ["bigrams", "words", "piece-pairs"]
    assert model.resized(7).after.count() and made[-1] == "after"
