"""Quality rules, quality classifier and language-model scores against brute force and held-out labels."""

import math
import random
import re
from collections import Counter

import pytest
from helpers import DOCS, awkward, clashing

from nameshift.llm import fertility, quality_cotraining, queries


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            inside.update(range(i, i + 8))
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(inside), failed


def test_base_rules_equal_brute_force(spark, folder):
    more = [(10**6, "a b c d e f g h " * 5, "en", "s", 1), (10**6 + 1, "a\n\na\n \n \na b\nx\n\nx", "en", "s", 1), (10**6 + 2, "one " * 100, "en", "s", 1)]
    docs = spark.read.parquet(f"{folder}/documents.parquet").unionByName(awkward(spark)).unionByName(spark.createDataFrame(more, DOCS))
    want = sorted(str((r.doc_id, *base(r.text))) for r in docs.collect())
    got = fertility.quality_rules(docs).collect()
    assert sorted(str(tuple(r)[:7]) for r in got) == want
    assert not any(r.kept for r in got if r.base_failed)


def test_bands_reject_what_a_vocabulary_splits_oddly(spark):
    common = "the people of this place know water and light see want love time year good great house work life day".split()
    r = random.Random(1)
    good = [(i, " ".join(r.choices(common, k=60)), "en", "s", 1) for i in range(60)]
    odd = [(100, " ".join("qzxjwvkpqz" + chr(97 + i) + "zzxqj" for i in range(26)) + " " + " ".join("xqzj" + str(i) for i in range(200)), "en", "s", 1)]
    rare = [(200, " ".join("ԱԲԳԴ" + chr(0x561 + i) for i in range(25)), "hy", "s", 1)]
    got = {r.doc_id: r for r in fertility.quality_rules(spark.createDataFrame(good + odd + rare, DOCS)).collect()}
    assert all(got[i].kept for i in range(60)) and not got[100].kept and not got[100].base_failed
    assert got[200].kept  # too few texts of its language and script for a band


def test_rules_on_awkward_rows(spark):
    docs = clashing(awkward(spark))
    assert fertility.quality_rules(docs.limit(0)).count() == 0
    kept = fertility.passing(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [5]
    assert fertility.passing(docs.limit(0)).count() == 0


def test_repeated_windows_fall_back_when_hashes_collide(monkeypatch):
    import numpy as np

    monkeypatch.setattr(fertility, "mix", lambda x: np.zeros_like(x))
    numbers = np.array([*range(8), *range(8), *range(50, 60), 1, 2])
    assert fertility.repeated_words(numbers, np.array([0, 26, 28])).tolist() == [16, 0]


@pytest.fixture(scope="module")
def labelled(spark):
    return "/root/testdata/sf0.01"


def test_classifier_agrees_with_labels_it_has_not_seen(spark, labelled):
    docs = spark.read.parquet(f"{labelled}/documents.parquet")
    labels = spark.read.parquet(f"{labelled}/labels.parquet")
    train, held = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    got = quality_cotraining.quality_scores(docs, train)
    assert got.count() == docs.count()
    both = got.join(held, "doc_id").select("kept", "quality", "score").collect()
    assert sum(r.kept == bool(r.quality) for r in both) / len(both) > 0.95
    assert all(r.kept for r in both if r.quality == 1)


def test_a_round_takes_the_surest_of_all_unlabelled_rows(spark, labelled):
    """The pseudo-labels of two rounds against all scores on the driver."""
    import numpy as np
    from pyspark.sql import functions as F

    q = quality_cotraining
    col = F.col
    docs = spark.read.parquet(f"{labelled}/documents.parquet").select("doc_id", "text", q.buckets(col("lang"), col("source"), col("n_chars")).alias("meta"))
    rows = q.view_rows(docs.repartition(7), spark.read.parquet(f"{labelled}/labels.parquet"), 150)
    every = rows.orderBy("k").toPandas()
    assert len(every) == docs.count() and every["y"].notna().sum() == 150 and every["known"].sum() > 150
    text, meta = q.unpacked(every["x"].tolist()), q.one_hot(np.stack(every["meta"].to_numpy()).astype(int))
    has, free = every["y"].notna().to_numpy(), ~every["known"].to_numpy().astype(bool)
    y, k = every["y"].to_numpy()[has].astype(float), every["k"].to_numpy()
    models = [q.Logistic.fit(text[has], y), q.Logistic.fit(meta[has], y)]
    taken = np.zeros(0, np.int64)
    for _ in range(2):
        got = q.surest(rows, models, taken, 40).toPandas()
        for own, view in ((0, text), (1, meta)):
            p = q.sigmoid(models[own].odds(view))
            for good in (True, False):
                at = [i for i in np.lexsort((k, -p if good else p)) if free[i] and k[i] not in taken and (p[i] >= q.SURE if good else p[i] <= 1 - q.SURE)][:40]
                mine = got[(got["own"] == own) & (got["good"] == good)]
                assert sorted(mine["k"]) == sorted(k[at])
        assert len(got) > 40
        taken = np.union1d(taken, got["k"].to_numpy())


def test_hashed_grams_count_words_pairs_and_letters():
    import numpy as np

    q = quality_cotraining
    texts = ["the cat The cat", "", "x", "cat the", "abc"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    got = q.grams(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    assert got.shape == (5, q.WORD_GRAMS + q.LETTER_GRAMS)
    sums = (got**2).sum(axis=1)
    assert sums == pytest.approx([2, 0, 1, 2, 2]) and not (got[0] == got[3]).all()


def test_classifier_on_awkward_rows(spark, labelled):
    labels = spark.read.parquet(f"{labelled}/labels.parquet")
    docs = spark.read.parquet(f"{labelled}/documents.parquet").unionByName(awkward(spark))
    wide = clashing(docs)
    kept = quality_cotraining.passing(wide, labels.unionByName(spark.createDataFrame([(None, 1, 0), (1, None, 0), (0, 0, 0)], labels.schema)))
    assert kept.columns == wide.columns
    empty = {2, 3, 4}
    scores = quality_cotraining.quality_scores(awkward(spark), labels).collect()  # hardly any labelled rows here
    assert all(r.score is None and r.kept for r in scores)
    got = quality_cotraining.quality_scores(docs, labels).collect()
    assert [(r.score, r.kept) for r in got if r.doc_id in empty and r.score == 0.0]
    assert quality_cotraining.quality_scores(docs.limit(0), labels).count() == 0
    assert quality_cotraining.quality_scores(docs, labels.limit(0)).where("NOT kept").count() == 0


def test_language_model_prefers_good_documents(spark, labelled):
    got = queries.QUERIES["op9_lm_scoring"](spark, labelled)
    means = dict(got.join(spark.read.parquet(f"{labelled}/labels.parquet"), "doc_id").groupBy("quality").avg("score").collect())
    assert means[1] < means[0]
