"""Cut lists of fills that travel as one text, and candidates counted on their names."""

import pytest
from pyspark.sql import functions as F

from nameshift.operators.candidates import cut_scores, keep_half, keep_threshold
from nameshift.operators.search import apply_budget
from nameshift.plans.greedy import with_spent
from tests.test_fill_lists import GAPS, trained


@pytest.mark.parametrize("threshold, at_most, score_cut", [(None, None, 0), (None, None, 1_100_000), (0.3, 2, 0), (0.0, 4, 800_000)])
def test_kept_fills_equal_the_cuts_of_similar_fills(spark, threshold, at_most, score_cut):
    model = trained(spark, 4)
    gaps = spark.createDataFrame(GAPS, "name string, prev string, next string, n long")
    similar = F.col("similar")
    cut = cut_scores(keep_half(similar) if threshold is None else keep_threshold(similar, threshold, at_most), score_cut)
    want = {(r.name, r.prev, r.next): [(k.cand, k.score) for k in r.kept if k.ok] for r in model.similar_fills(gaps).withColumn("kept", cut).collect()}
    made = model.kept_fills(gaps, threshold, at_most, score_cut)
    found = {}
    for r in made.collect():
        text, at = r.toks.encode(), 0
        words = []
        for size in r.lens:
            words.append(text[at : at + size].decode())
            at += size
        assert at == len(text)
        found[r.name, r.prev, r.next] = list(zip(words, r.scores, strict=True))
    assert found == want and any(want.values())
    assert made.schema["toks"].dataType.simpleString() == "string"


def test_candidates_are_counted_before_the_names_meet_them(inputs):
    """The budget needs no window over all candidates; rows that do not bring the counts give the same."""
    rows = inputs.search_rows(inputs.space(), "unk")
    columns = ["sample_id", "name", "idx", "rank", "q0", "used", "evaluated"]
    bare = rows.drop("m", "ahead", "n_occ_all")
    for most in (3, 12, 100, None):
        brought, counted = (apply_budget(with_spent(r), most).select(*columns) for r in (rows, bare))
        assert sorted(map(tuple, brought.collect())) == sorted(map(tuple, counted.collect()))
    plan = apply_budget(with_spent(rows), 100)._jdf.queryExecution().optimizedPlan().toString()
    assert "count(1) windowspecdefinition" not in plan
