"""Statements numbered inside their own text, and the marks of definitions."""

from nameshift.functions.lexing import tokenize_with_newlines
from nameshift.operators.dataflow import marked_rows, statement_rows
from nameshift.operators.flow import code_blocks
from pyspark.sql import functions as F

TEXTS = [(1, "x = y;\nz = x + 1; if (x) { y = z }"), (2, ""), (3, None), (4, "a\nb = a\n\nc"), (5, "é = 1; _u; \"x\" = v; if"), (None, "p = q; q")]
WORDS = ("if",)


def _plain(tokens):
    stmt, out = 0, []
    for i, t in enumerate(tokens or []):
        stmt += t in (";", "\n")
        if (t[0].isalpha() or t[0] == "_") and t not in WORDS:
            out.append((stmt, i, t, i + 1 < len(tokens) and tokens[i + 1] == "="))
    return out


def test_statements_are_numbered_without_sending_tokens(spark):
    samples = spark.createDataFrame(TEXTS, "sample_id long, code string")
    tokens = {r.sample_id: r.t for r in samples.select("sample_id", tokenize_with_newlines(F.col("code")).alias("t")).collect()}
    rows = statement_rows(samples, "c")
    want = sorted(((s, *r) for s, t in tokens.items() for r in _plain(t)), key=str)
    assert sorted((tuple(r) for r in rows.collect()), key=str) == want
    assert "MapInArrow" in rows._jdf.queryExecution().optimizedPlan().toString()


def test_texts_that_share_an_id_are_one(spark):
    """As before: both texts are numbered together, by place."""
    samples = spark.createDataFrame([(1, "a; b"), (1, "c; d"), (2, "e; f")], "sample_id long, code string")
    rows = statement_rows(samples, "c").select("sample_id", "name", "stmt").collect()
    assert sorted(map(tuple, rows)) == [(1, "a", 0), (1, "b", 2), (1, "c", 0), (1, "d", 2), (2, "e", 0), (2, "f", 1)]


def test_marks_hold_every_definition(spark):
    samples = spark.createDataFrame([(1, "x = y; z; x"), (2, "x; y")], "sample_id long, code string")
    marks = {(r.sample_id, r.pos): (r.name, r.defined, r.beside_def) for r in marked_rows(samples, "c").collect()}
    assert marks == {(1, 0): ("x", True, True), (1, 2): ("y", False, True), (1, 4): ("z", False, False), (1, 6): ("x", True, False), (2, 0): ("x", False, False), (2, 2): ("y", False, False)}


def test_structure_keeps_places_over_line_breaks(spark):
    samples = spark.createDataFrame([(1, "if (a)\n\n b; else\n{ c; }"), (2, None)], "sample_id long, code string")
    assert sorted((r.start, r.end) for r in code_blocks(samples, "c").collect()) == [(6, 7), (10, 13)]
