"""Corpora, result sink, metrics."""

import pytest

from pyspark.sql import functions as F

from nameshift.operators.skew import skew_join
from nameshift.plans import metrics
from nameshift.plans.results import RESULT_SCHEMA
from nameshift.sources.corpus import assign_split, binary_label, check_language, harmonise, load_corpus
from nameshift.sources.results import read_params, read_results, run_params, write_results


def result(sample, attack, is_attack, is_success, queries):
    return (sample, attack, "linear", 1, 1, 0.9, is_attack, is_success, queries, None, {"a": ["b"]}, {"a": "b"}, 0 if is_success else None, "b" if is_success else None)


def test_corpus(spark, tmp_path):
    raw = spark.createDataFrame([(i, f"f{i}", i % 4 > 0) for i in range(200)], "id long, func string, target boolean")
    df = binary_label(harmonise(raw))
    assert df.columns == ["id", "code", "label"] and dict(df.dtypes)["label"] == "bigint"
    assert binary_label(spark.createDataFrame([(7,), (0,)], "label int")).collect() == [(1,), (0,)]
    split = assign_split(df, "id")
    split.write.partitionBy("split").parquet(f"{tmp_path}/corpus")
    test = load_corpus(spark, f"{tmp_path}/corpus", split="test")
    train = load_corpus(spark, f"{tmp_path}/corpus", split="train")
    assert test.count() + train.count() == 200 and 20 < test.count() < 60
    assert not {r.id for r in test.collect()} & {r.id for r in train.collect()}
    raw.write.json(f"{tmp_path}/json")
    assert load_corpus(spark, f"{tmp_path}/json", "json").count() == 200
    langs = check_language(spark.createDataFrame([("JAVA",), ("Go",)], "lang string")).collect()
    assert [tuple(r) for r in langs] == [("java", True), ("go", False)]


def test_sink_round_trip(spark, tmp_path):
    rows = [result(1, "greedy", True, True, 5), result(1, "mhm", True, False, 9), result(2, "greedy", False, False, 0)]
    results = spark.createDataFrame(rows, RESULT_SCHEMA)
    params = run_params(results, "set", "linear", "lexical", 510, "c", "greedy", {"max_iter": 100})
    path = write_results(results, params, str(tmp_path), "one")
    back = read_results(spark, path)
    assert back.schema.fieldNames() == RESULT_SCHEMA.fieldNames()
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, results.collect()), key=str)
    row = spark.read.json(f"{path}/params").first()
    assert row.test_size == 3 and row.params["max_iter"] == "100"


def test_a_failed_run_leaves_nothing_to_read(spark, tmp_path):
    results = spark.createDataFrame([result(1, "greedy", True, True, 5)], RESULT_SCHEMA)
    params = run_params(results, "set", "linear", "lexical", 510, "c", "greedy", {})
    broken = params.withColumn("test_size", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        write_results(results, broken, str(tmp_path), "one")
    assert not (tmp_path / "run=one").exists()
    path = write_results(results, params, str(tmp_path), "one")
    assert read_results(spark, path).count() == 1 and read_params(spark, path).first().attack == "greedy"
    with pytest.raises(ValueError, match="exists"):
        write_results(results, params, str(tmp_path), "one")
    results.write.format("json").partitionBy("attack", "model").save(f"{tmp_path}/run=two/results")
    with pytest.raises(ValueError, match="complete"):
        read_results(spark, f"{tmp_path}/run=two")


def test_metrics(spark):
    rows = [result(1, "greedy", True, True, 5), result(2, "greedy", True, False, 9), result(3, "greedy", False, False, 0), result(1, "mhm", False, False, 0)]
    results = spark.createDataFrame(rows, RESULT_SCHEMA)
    by = {r.attack: r for r in metrics.robustness(results, ["attack"]).collect()}
    assert by["greedy"].robustness == 0.5 and by["mhm"].robustness is None
    table = metrics.robustness_table(results).first()
    assert table.greedy == 0.5 and table.ga is None
    assert metrics.query_cost(results, ["attack"]).collect() == [("greedy", 7.0, 9)]
    assert metrics.accuracy(results.withColumn("label", F.when(F.col("sample_id") == 1, 1).otherwise(0)), ["model"]).first().accuracy == 0.5


def test_skew_join_equals_plain_join(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"), "id")
    right = left.groupBy("key").agg(F.count("*").alias("n"), F.sum("id").alias("s")).where("key <> 'k7'")
    got = skew_join(left, right, ["key"], "n", ["id"], share=10)
    want = left.join(right.drop("n"), "key", "left")
    assert sorted(got.select("key", "id", "s").collect(), key=lambda r: r.id) == sorted(want.select("key", "id", "s").collect(), key=lambda r: r.id)
    hot = got.where("key = 'hot'").select(F.spark_partition_id()).distinct()
    assert skew_join(left, right, ["key"], "n", ["id"], "inner", share=10).count() == want.where("s is not null").count()
    assert hot.count() >= 1
