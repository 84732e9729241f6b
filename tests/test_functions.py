"""Column functions on small hand-written inputs."""

import pytest
from pyspark.sql import functions as F

from nameshift.functions import lexing, renaming
from nameshift.functions.names import filter_valid_names, identifiers, is_uid, is_valid_name
from nameshift.functions.reserved import C_SPECIAL_IDS, LANGUAGES, reserved_words
from nameshift.functions.similarity import cosine
from nameshift.operators import dataflow, variants
from nameshift.operators.candidates import beam, cut_scores, keep_half, keep_threshold, threshold_top_n, top_half
from nameshift.operators.importance import shift_scores
from nameshift.operators.tokens import subword_offsets, with_tokens


@pytest.fixture
def value(spark):
    def run(column, **columns):
        df = spark.range(1)
        for name, content in columns.items():
            lit = F.array(*[F.lit(x) for x in content]) if isinstance(content, list) else F.lit(content)
            df = df.withColumn(name, lit)
        return df.select(column.alias("v")).first()[0]

    return run


@pytest.mark.parametrize(
    "text, clean",
    [
        ("int a; // x\n/* y\n z */ int b = \"//no\"; char c='\\''; a/b;\n\n", "int a;  \n  int b = \"//no\"; char c='\\''; a/b;"),
        ("x = 'unclosed // c\nq", "x = 'unclosed  \nq"),
        ("a/**/b", "a b"),
        ("don't // it's\n it", "don't // it's\n it"),
    ],
)
def test_strip_comments_c(value, text, clean):
    assert value(lexing.strip_comments(F.col("t"), "c"), t=text) == clean


def test_strip_comments_python(value):
    text = '"""doc"""\nx = "a # b"  # note\n    \'\'\'more\n lines\'\'\'\n\ny = 1'
    assert value(lexing.strip_comments(F.col("t"), "python"), t=text) == 'x = "a # b"  \ny = 1'
    assert value(lexing.strip_comments(F.col("t"), "ruby"), t="# kept") == "# kept"


def test_very_long_literals_and_comments(value):
    text = "/*" + "x\n" * 50_000 + "*/ a '" + "b\\'" * 30_000 + "' c"
    assert value(lexing.tokenize(F.col("t")), t=text) == ["a", "'" + "b\\'" * 30_000 + "'", "c"]
    assert value(F.length(lexing.strip_comments(F.col("t"), "c")), t=text) == 90_000 + 8


def test_tokens_lines_spans(value):
    assert value(lexing.tokenize(F.col("t")), t='if (a->b >= 1.5f) s = "x // y"; // end') == [
        "if", "(", "a", "->", "b", ">=", "1.5f", ")", "s", "=", '"x // y"', ";",
    ]
    assert value(lexing.line_tokens(F.col("t")), t="a\n\nb") == ["a\\n", "b\\n"]
    assert value(lexing.unescape_newlines(F.col("t")), t="a\\nb") == "a\nb"
    span = lambda *p: lexing.span_text(F.col("t"), *[F.lit(x) for x in p])
    assert value(span(0, 1, 0, 3), t="abcd\nefg\nhij") == "bc"
    assert value(span(0, 2, 2, 1), t="abcd\nefg\nhij") == "cdefgh"
    assert value(lexing.pieces(F.col("t")), t="maxHTTPSize_2x") == ["max", "HTTPS", "ize", "_", "2", "x"]


def test_names(value, spark):
    assert {"getline", "stdlib"} <= set(C_SPECIAL_IDS) and "getlinestdlib" not in C_SPECIAL_IDS
    for lang, word, ok in [("c", "int", False), ("c", "NULL", False), ("c", "printf", False), ("c", "größe", True), ("c", "2x", False),
                           ("java", "String", False), ("java", "printf", True), ("python", "None", False), ("python", "args", True),
                           ("javascript", "x", False)]:
        assert value(is_valid_name(F.col("w"), lang), w=word) is ok, (lang, word)
    rows = [(lang, word) for lang in LANGUAGES for word in ("x", "int", "String", "lambda", "a b", "main")]
    kept = filter_valid_names(spark.createDataFrame(rows, "lang string, name string"))
    want = {("c", "x"), ("c", "String"), ("c", "lambda"), ("java", "x"), ("java", "lambda"),
            ("python", "x"), ("python", "int"), ("python", "String"), ("python", "main")}
    assert {tuple(r) for r in kept.select("lang", "name").collect()} == want
    assert "..." in reserved_words("c", with_operators=True)


@pytest.mark.parametrize(
    "word, strict, compat",
    [(" ab1 ", True, True), ("a", True, True), ("ab,", False, True), ("a,b", False, False), ("1a", False, False), ("it's", False, False), ("int", False, False), ("", False, False), ("é", False, False)],
)
def test_uid(value, word, strict, compat):
    assert value(is_uid(F.col("w")), w=word) is strict
    assert value(is_uid(F.col("w"), compat=True), w=word) is compat


def test_identifiers(value):
    tokens = "int a = b ; char * p , q ; a = foo ( a , x ) ;".split()
    assert value(identifiers(F.col("t"), "c"), t=tokens) == ["a", "b", "p", "q", "foo", "x"]
    assert value(identifiers(F.col("t"), "c", "declared"), t=tokens) == ["a", "p"]


def test_rename(value):
    swap = F.create_map(F.lit("a"), F.lit("b"), F.lit("b"), F.lit("a"))
    assert value(renaming.rename_many(F.col("t"), swap), t=["a", "+", "b"]) == ["b", "+", "a"]
    text = 'a  = b; // a\ns = "a";\n\tab'
    assert value(renaming.rename_text(F.col("t"), swap), t=text) == 'b  = a; // a\ns = "a";\n\tab'
    same = F.create_map(F.lit("a"), F.lit("a"))
    assert value(renaming.rename_text(F.col("t"), same), t=text) == text
    assert value(renaming.rename_one(F.col("t"), F.lit("a"), F.lit("z")), t=["a", "ab", "a"]) == ["z", "ab", "z"]
    assert value(lexing.count_substring(F.col("t"), F.lit("a")), t=text) == 4
    assert value(lexing.count_token(F.col("t"), F.lit("a")), t=["a", "ab", "a"]) == 2


def test_masking(spark):
    lexed = spark.createDataFrame([(1, ["a", "b", "c"], ["a", "c"]), (2, ["a", "b", "a", "c"], ["a"])], "sample_id long, tokens array<string>, names array<string>")
    occ = variants.occurrences(lexed)

    def rows(df):
        return sorted((r.sample_id, r.variant) for r in df.collect())

    assert rows(variants.mask_each(occ)) == [(1, ["<unk>", "b", "c"]), (1, ["a", "b", "<unk>"]), (2, ["<unk>", "b", "a", "c"]), (2, ["a", "b", "<unk>", "c"])]
    assert rows(variants.delete_each(occ)) == [(1, ["a", "b"]), (1, ["b", "c"]), (2, ["a", "b", "c"]), (2, ["b", "a", "c"])]
    assert (2, ["<unk>", "b", "<unk>", "c"]) in rows(variants.mask_all(lexed))
    assert (2, ["a", "b", "<mask>", "c"]) in rows(variants.mask_each(occ, variants.MASK))


def test_subword_offsets(spark):
    rows = subword_offsets(spark.createDataFrame([(1, "int maxSize\n = x_1")], "sample_id long, code string")).orderBy("pos").collect()
    assert [(r.word, r.start, r.end) for r in rows] == [("int", 0, 1), ("maxSize", 1, 3), ("=", 3, 3), ("x_1", 3, 6)]


def test_similarity_cuts(value, spark):
    assert value(cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0, 1.0]) == pytest.approx(0.5**0.5)
    assert value(cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 1.0]) == 0
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate([0.9, 0.8, 0.9, 0.1, 0.5])], "g int, i int, s double")
    assert [r.i for r in top_half(rows, ["g"], "s", "i").orderBy("r").collect()] == [0, 2]
    assert [r.i for r in threshold_top_n(rows, ["g"], "s", "i", 0.6, 2).orderBy("r").collect()] == [0, 2]
    assert threshold_top_n(rows, ["g"], "s", "i", 0.95, 2).count() == 0
    similar = F.array(*[F.struct(F.lit(d).alias("dist"), F.lit(s).alias("score")) for d, s in [(0, 9), (5, 7), (20, 2), (30, 8), (31, 9)]])
    assert value(F.size(keep_half(similar))) == 2
    assert value(F.size(keep_threshold(similar, 0.7, 50))) == 2 and value(F.size(keep_threshold(similar, 0.7, 1))) == 1
    assert value(F.size(cut_scores(similar, 5))) == 2 and value(F.size(cut_scores(similar, 0))) == 5 and value(F.size(cut_scores(similar, 1))) == 5


def test_beam(value):
    opts = F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("x")), F.array(F.lit("1"), F.lit("2")))
    assert value(beam(opts)) == [["a", "x", "1"], ["a", "x", "2"], ["b", "x", "1"], ["b", "x", "2"]]
    wide = F.array_repeat(F.array(*[F.lit(c) for c in "abcd"]), 15)
    built = value(beam(wide))
    assert len(built) == 24 and {len(w) for w in built} == {12}


def test_shifted_importance(spark):
    occ = spark.createDataFrame([(1, "a", 0, 0.5), (1, "a", 4, 0.25), (1, "b", 2, 1.0)], "sample_id long, name string, pos int, score double")
    firsts = occ.withColumn("first_pos", F.when(F.col("name") == "a", 0).otherwise(2))
    rows = shift_scores(firsts, ["first_pos", "pos"]).orderBy("first_pos", "pos").collect()
    assert [r.score for r in rows] == [0.0, 0.5, 0.25]


def test_def_use(spark):
    code = "int a = 1; b = a + c;\nd = a = b; e == a"
    rows = dataflow.statement_rows(spark.createDataFrame([(1, code)], "sample_id long, code string"), "c")
    edges = {(r.name, r.pos, r.rel, tuple(r.src_names), tuple(r.src_pos)) for r in dataflow.merge_edges(dataflow.def_use_edges(rows)).collect()}
    pos = {i: t for i, t in enumerate(["int", "a", "=", "1", ";", "b", "=", "a", "+", "c", ";", "\n", "d", "=", "a", "=", "b", ";", "e", "==", "a"])}
    assert edges == {
        ("a", 1, "comesFrom", (), ()),
        ("b", 5, "comesFrom", (), ()),
        ("a", 7, "comesFrom", ("a",), (1,)),
        ("b", 5, "computedFrom", ("a", "c"), (7, 9)),
        ("d", 12, "comesFrom", (), ()),
        ("d", 12, "computedFrom", ("a",), (14,)),
        ("a", 14, "comesFrom", ("a",), (1,)),
        ("a", 14, "computedFrom", ("b",), (16,)),
        ("b", 16, "comesFrom", ("b",), (5,)),
        ("a", 20, "comesFrom", ("a",), (14,)),
    }
    assert all(pos[p] == name for name, p, *_ in edges)
    defs = dataflow.definitions(rows)
    merged = dataflow.merge_definitions(defs.where("pos < 10"), defs)
    assert {(r.name, tuple(r.def_pos)) for r in merged.collect()} == {("a", (1, 14)), ("b", (5,)), ("d", (12,))}


def test_rename_back_restores_tokens(spark):
    lexed = with_tokens(spark.createDataFrame([(1, "a = b + a; // a")], "sample_id long, code string"))
    there = renaming.rename_one(F.col("tokens"), F.lit("a"), F.lit("fresh"))
    back = renaming.rename_one(there, F.lit("fresh"), F.lit("a"))
    assert lexed.where(back != F.col("tokens")).count() == 0


def test_python_tokens(value):
    text = 'x = total // count  # scale by ratio\ny = """a\nb # c""" ** z'
    assert value(lexing.tokenize(F.col("t"), "python"), t=text) == ["x", "=", "total", "//", "count", "y", "=", '"""a\nb # c"""', "**", "z"]
    same = F.create_map(F.lit("count"), F.lit("n"), F.lit("ratio"), F.lit("r"))
    assert value(renaming.rename_text(F.col("t"), same, "python"), t=text) == text.replace("// count", "// n")


def test_names_end_where_the_text_ends(value):
    for bad in ("abc\n", "abc\r", "a\nb"):
        assert not value(is_valid_name(F.col("t"), "c"), t=bad)
    assert value(is_uid(F.col("t")), t="\tabc\n") and not value(is_uid(F.col("t")), t="a\nb")
