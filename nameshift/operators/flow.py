"""Definition-use edges over branches and loops of languages with braces.

The nesting is read from brackets alone: ``if``, ``else if`` and ``else`` open the arms of one branch, ``while``, ``for`` and
``do`` open a loop; a body is a pair of braces or goes on to the next ``;`` at its depth. A condition belongs to its loop, but
stands before a branch, and that of an ``else if`` belongs to its arm. After a branch all definitions that reached it still reach, and those of its arms as well; an arm
sees nothing of the arms beside it. A loop's body always counts as run, twice: its ends reach its start.

A definition is therefore hidden from a use by another one between them if and only if the arm nearest around that one holds the
use or the hidden definition. Both are windows per name and arm, so code costs one row for each token and level of
nesting; what is joined are the definitions since the last sure one, by number.

Defined results: a null or empty text has no edges; a body that never ends is none; a bracket too many opens
nothing; rows that share a ``sample_id`` are one text and must not occur; ``switch`` and ``goto`` are no branches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nameshift.functions.lexing import tokenize_with_newlines
from nameshift.functions.token_batches import structure_batches
from nameshift.operators.dataflow import COMES_FROM, COMPUTED_FROM, def_use_edges, marked_rows
from nameshift.session import stage

ROOT = -1
STRUCTURE = ("{", "}", "(", ")", ";", "if", "else", "do", "while", "for")


def _following(value: Column, *by: str) -> Column:
    """The next value that is not null in later rows of the partition."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy("sample_id", *by).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1))


def code_blocks(samples: DataFrame, lang: str, text: str = "code") -> DataFrame:
    """``sample_id``, ``chain`` (an arm's branch, null for loops), ``start`` and ``end`` of all arms and loops."""
    tok, at = F.col("tok"), Window.partitionBy("sample_id").orderBy("pos")
    until = at.rowsBetween(Window.unboundedPreceding, 0)
    depth = lambda a, b: F.sum(F.when(tok == a, 1).when(tok == b, -1).otherwise(0)).over(until)
    # only what makes the structure is sent, with its neighbours
    lexed = samples.select("sample_id", tokenize_with_newlines(F.col(text), lang).alias("tokens"))
    kind = lexed.schema["sample_id"].dataType.simpleString()
    rows = lexed.mapInArrow(
        lambda batches: structure_batches(batches, list(STRUCTURE)), f"sample_id {kind}, pos int, tok string, prev string, next struct<pos:int,tok:string>"
    )
    rows = rows.withColumn("brace", depth("{", "}")).withColumn("paren", depth("(", ")"))
    rows = rows.withColumn("b", F.col("brace") + (tok == "}").cast("int")).withColumn("p", F.col("paren") + (tok == ")").cast("int"))
    closed = F.when(tok == "{", _following(F.when(tok == "}", F.col("pos")), "b"))
    rows = rows.withColumn("closed", closed).withColumn("semi", _following(F.when(tok == ";", F.col("pos")), "brace", "paren"))
    # what follows a token as a body: its first token, and where it ends
    end = F.when(F.col("next.tok") == "{", F.lead("closed").over(at)).otherwise(F.col("semi"))
    body = F.when(end.isNotNull() & F.col("next").isNotNull(), F.struct(F.col("next.tok").alias("tok"), F.col("next.pos").alias("start"), end.alias("end")))
    rows = rows.withColumn("body", body)
    rows = rows.withColumn("after", F.when(tok == "(", _following(F.when(tok == ")", F.struct("body")), "p")["body"]))
    own = F.when(tok.isin("else", "do"), F.col("body")).when(tok.isin("if", "while", "for") & (F.col("next.tok") == "("), F.lead("after").over(at))
    chained = F.last(F.when((tok == "if") & ~F.col("prev").eqNullSafe("else"), F.col("pos")), ignorenulls=True)
    heads = rows.withColumn("own", own).where(tok.isin("if", "else", "do", "while", "for"))
    heads = heads.withColumn("chain", chained.over(Window.partitionBy("sample_id", "brace").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    is_arm = tok.isin("if", "else")
    wanted = F.col("own").isNotNull() & ~((tok == "else") & (F.col("own.tok") == "if")) & (is_arm | (F.col("own.tok") != ";"))
    return heads.where(wanted).select(
        "sample_id",
        F.when(is_arm, F.coalesce("chain", "pos")).alias("chain"),
        F.when(tok.isin("while", "for") | F.col("prev").eqNullSafe("else"), F.col("pos")).otherwise(F.col("own.start")).alias("start"),
        F.col("own.end").alias("end"),
    )


def occurrences(names: DataFrame, blocks: DataFrame) -> DataFrame:
    """``names`` with ``arms`` and ``loops`` around them, ``k`` definitions of the name before, ``low`` and ``kill``.

    ``low`` is the last sure definition before an occurrence, ``kill`` the next one after it that hides it.
    """
    key = ["sample_id", "name", "pos"]
    each = blocks.select("sample_id", F.explode(F.sequence("start", "end")).alias("pos"), "chain", "start", "end")
    around = names.select(*key).join(each, ["sample_id", "pos"]).groupBy(*key).agg(
        F.collect_list(F.when(F.col("chain").isNotNull(), F.struct("start", "chain"))).alias("arms"),
        F.collect_list(F.when(F.col("chain").isNull(), F.struct("start", "end"))).alias("loops"),
    )
    k = F.coalesce(F.sum(F.col("is_def").cast("int")).over(Window.partitionBy("sample_id", "name").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = names.select(*key, "is_def").join(around, key, "left").withColumn("k", k)
    levels = rows.select(*key, "is_def", "k", F.explode(F.concat(F.array(F.lit(ROOT)), F.coalesce(F.col("arms.start"), F.array().cast("array<int>")))).alias("arm"), F.coalesce(F.array_max("arms")["start"], F.lit(ROOT)).alias("inner"))
    here = F.when(F.col("is_def") & (F.col("arm") == F.col("inner")), F.struct("pos", "k"))
    by_arm = Window.partitionBy("sample_id", "name", "arm")
    low = F.last(here, ignorenulls=True).over(by_arm.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    kill = F.last(here["pos"], ignorenulls=True).over(by_arm.orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1))
    bounds = levels.withColumn("low", low).withColumn("kill", kill).groupBy(*key).agg(F.max("low").alias("low"), F.min("kill").alias("kill"))
    return rows.join(bounds, key)


def reaching(rows: DataFrame) -> DataFrame:
    """``sample_id``, ``name``, ``pos`` and ``src``: every definition that reaches an occurrence, once."""
    first = F.coalesce(F.col("low.k"), F.lit(0))
    uses = rows.where(F.col("k") > first).select("sample_id", "name", "pos", F.col("arms").alias("own"), F.explode(F.sequence(first, F.col("k") - 1)).alias("k"))
    defs = rows.where("is_def").select("sample_id", "name", F.col("pos").alias("src"), "k", "kill", "arms")
    beside = F.exists("own", lambda x: F.exists("arms", lambda y: (x["chain"] == y["chain"]) & (x["start"] != y["start"])))
    ahead = uses.join(defs, ["sample_id", "name", "k"]).where((F.col("kill").isNull() | (F.col("pos") <= F.col("kill"))) & ~F.coalesce(beside, F.lit(False)))
    looped = rows.select("sample_id", "name", "pos", "is_def", "low", "kill", F.explode("loops").alias("loop"))
    starts = looped.where("low IS NULL OR low.pos < loop.start").select("sample_id", "name", "pos", "loop")
    ends = looped.where("is_def AND (kill IS NULL OR kill > loop.end)").select("sample_id", "name", F.col("pos").alias("src"), "loop")
    back = starts.join(ends, ["sample_id", "name", "loop"])
    columns = ("sample_id", "name", "pos", "src")
    return ahead.select(*columns).unionByName(back.select(*columns)).distinct()


def flow_edges(samples: DataFrame, lang: str, text: str = "code") -> DataFrame:
    """T14 to T16 with branches and loops: ``(sample_id, name, pos, rel, src_names, src_pos)``, sources merged and sorted.

    A definition that nothing reaches has no source; ``computedFrom`` holds within a statement.
    """
    # each text tells which names and statements have definitions, so that no others are sent
    names = stage(marked_rows(samples, lang, text), "flow-names")
    beside, names = names.where("beside_def"), names.where("defined").drop("defined", "beside_def")
    defined = names.join(names.where("is_def").select("sample_id", "name").distinct(), ["sample_id", "name"], "left_semi")
    rows = stage(occurrences(defined, code_blocks(samples, lang, text)), "flow-rows")
    found = reaching(rows).groupBy("sample_id", "name", "pos").agg(F.sort_array(F.collect_list("src")).alias("src_pos"))
    comes = rows.select("sample_id", "name", "pos", "is_def").join(found, ["sample_id", "name", "pos"], "left").where("is_def OR src_pos IS NOT NULL")
    src_names = F.when(F.col("src_pos").isNotNull(), F.array("name")).otherwise(F.array().cast("array<string>"))
    comes = comes.select("sample_id", "name", "pos", F.lit(COMES_FROM).alias("rel"), src_names.alias("src_names"), F.coalesce("src_pos", F.array().cast("array<int>")).alias("src_pos"))
    computed = def_use_edges(beside).where(F.col("rel") == COMPUTED_FROM).groupBy("sample_id", "name", "pos", "rel").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("src_names")))).alias("src_names"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("src_pos")))).alias("src_pos"),
    )
    return comes.unionByName(computed)
