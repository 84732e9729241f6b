"""The pipeline's stages one by one, and as a whole."""

import duckdb
import pytest
from helpers import awkward

import corpus_pipeline
from nameshift.llm import queries
from nameshift.session import stage


def test_stages_keep_columns_and_act_on_all_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    mixed = docs.unionByName(awkward(spark).where("doc_id IS NULL OR doc_id > 3").selectExpr("doc_id + 1000000 AS doc_id", "text", "lang", "source", "n_chars"))
    names, now, counts = [n for n, _ in corpus_pipeline.STAGES], mixed, [mixed.count()]
    assert names == ["quality classifier", "quality rules", "MinHash near-dedup", "benchmark decontamination", "byte-level BPE"]
    for k, (name, function) in enumerate(corpus_pipeline.STAGES):
        before = now
        now = stage(function(spark, now, folder), f"test-{k}")
        counts.append(now.count())
        if k < 4:
            assert now.columns == docs.columns
            assert now.exceptAll(before).isEmpty()
    assert counts[0] > counts[1] > counts[2] > counts[3] > counts[4] == counts[5]
    good = docs.join(spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1"), "doc_id", "left_semi")
    kept = corpus_pipeline.STAGES[0][1](spark, docs, folder)
    assert good.join(kept.select("doc_id"), "doc_id", "left_anti").isEmpty()


def test_whole_pipeline_equals_its_parts(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    encoded = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in queries.QUERIES["op2_bpe_codec"](spark, folder).collect()}
    rows = got.collect()
    assert rows and all(encoded[r.doc_id] == (r.n_tokens, r.ids_sha256) for r in rows)
    leaked = {r.doc_id for r in queries.QUERIES["op1_decontamination"](spark, folder).collect()}
    assert not leaked & {r.doc_id for r in rows}


def test_stages_on_an_empty_table(spark, folder):
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, empty, folder).count() == 0


def test_ten_operators_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11))


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_queries_equal_their_sql(spark, folder, name):
    df = queries.QUERIES[name](spark, folder)
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = con.sql(queries.ORACLES[name])
    assert df.columns == want.columns
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want.fetchall()))
