"""Every query against its SQL counterpart, and the shape of the plans."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from nameshift.oracles import ORACLES
from nameshift.plans import queries as q
from nameshift.plans.queries import QUERIES


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    yield con
    con.close()


def canon(rows):
    return sorted(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in row) for row in rows)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, folder, duck, name):
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    order = ", ".join(f'"{c}"' for c in columns)
    assert canon(df.select(columns).collect()) == canon(duck.sql(f"SELECT {order} FROM ({ORACLES[name]})").fetchall())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["predict", "importance_unk", "search_space", "attack_greedy", "attack_mhm", "ga_parents", "accuracy", "tokens"])
def test_plans_have_no_cross_join_and_no_python(spark, folder, name):
    text = plan(QUERIES[name](spark, folder))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas"):
        assert node not in text


def test_scans_read_only_what_they_need(spark, folder):
    text = plan(q.tokens(spark, folder))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
    assert "ReadSchema: struct<doc_id:bigint,quality" in plan(q.src_test_split(spark, folder))


def test_top_lists_are_cut_before_the_shuffle(spark, folder):
    from nameshift.operators.candidates import top_neighbours

    model = q.prepared(spark, folder).fills
    assert plan(top_neighbours(model.pairs, model.words, 30, "after", "c")).count("WindowGroupLimit") >= 2
