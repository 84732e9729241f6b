"""Definition-use edges from the token order alone: straight-line code, no branches or loops."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nameshift.functions.lexing import tokenize_with_newlines
from nameshift.functions.names import is_valid_name
from nameshift.functions.token_batches import STATEMENT_ENDS, statement_batches

COMES_FROM = "comesFrom"
COMPUTED_FROM = "computedFrom"


def statement_rows(samples: DataFrame, lang: str, text: str = "code") -> DataFrame:
    """Names with their statement number, and whether an ``=`` makes them a definition.

    A statement ends at ``;`` or a line break.
    """
    return marked_rows(samples, lang, text).drop("defined", "beside_def")


def marked_rows(samples: DataFrame, lang: str, text: str = "code") -> DataFrame:
    """``statement_rows``, with ``defined`` where the text may define the name and ``beside_def`` where the statement may define any.

    A text numbers its own statements; only rows that share a ``sample_id`` are brought
    together and numbered as one text.
    """
    lexed = samples.select("sample_id", tokenize_with_newlines(F.col(text), lang).alias("tokens"))
    kind = lexed.schema["sample_id"].dataType.simpleString()
    several = F.broadcast(samples.groupBy(F.col("sample_id").alias("shared")).agg(F.count("*").alias("n")).where("n > 1").select("shared"))
    shared = F.col("sample_id").eqNullSafe(F.col("shared"))
    alone = lexed.join(several, shared, "left_anti").mapInArrow(statement_batches, f"sample_id {kind}, stmt long, pos int, name string, is_def boolean, defined boolean, beside_def boolean")
    by_pos = Window.partitionBy("sample_id").orderBy("pos")
    rows = lexed.join(several, shared, "left_semi").select("sample_id", F.posexplode("tokens").alias("pos", "name"))
    ends = F.col("name").isin(*STATEMENT_ENDS).cast("int")
    rows = rows.withColumn("stmt", F.sum(ends).over(by_pos).cast("long")).withColumn("is_def", F.coalesce(F.lead("name").over(by_pos) == "=", F.lit(False)))
    rows = rows.withColumns({"defined": F.lit(True), "beside_def": F.lit(True)})
    return alone.unionByName(rows).where(is_valid_name(F.col("name"), lang))


def definitions(rows: DataFrame) -> DataFrame:
    return rows.where("is_def").select("sample_id", "name", "pos")


def def_use_edges(rows: DataFrame) -> DataFrame:
    """``(sample_id, name, pos, rel, src_names, src_pos)``.

    ``comesFrom``: a use takes the last earlier definition of its name; a first definition has no source.
    ``computedFrom``: a definition takes each name between it and the next definition of its statement, so the
    number of edges is at most the number of names.
    """
    earlier = Window.partitionBy("sample_id", "name").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last_def = F.last(F.when(F.col("is_def"), F.col("pos")), ignorenulls=True).over(earlier)
    comes = rows.withColumn("d", last_def).where(F.col("d").isNotNull() | F.col("is_def"))
    comes = comes.select(
        "sample_id",
        "name",
        "pos",
        F.lit(COMES_FROM).alias("rel"),
        F.when(F.col("d").isNotNull(), F.array("name")).otherwise(F.array().cast("array<string>")).alias("src_names"),
        F.when(F.col("d").isNotNull(), F.array("d")).otherwise(F.array().cast("array<int>")).alias("src_pos"),
    )
    in_stmt = Window.partitionBy("sample_id", "stmt").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    target = F.last(F.when(F.col("is_def"), F.struct("name", "pos")), ignorenulls=True).over(in_stmt)
    computed = rows.withColumn("t", target).where(F.col("t").isNotNull())
    computed = computed.select(
        "sample_id",
        F.col("t.name").alias("name"),
        F.col("t.pos").alias("pos"),
        F.lit(COMPUTED_FROM).alias("rel"),
        F.array(computed["name"]).alias("src_names"),
        F.array(computed["pos"]).alias("src_pos"),
    )
    return comes.unionByName(computed)


def merge_edges(edges: DataFrame) -> DataFrame:
    """Edges with the same name, position and relation become one, with the union of their sources."""
    return edges.groupBy("sample_id", "name", "pos", "rel").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("src_names")))).alias("src_names"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("src_pos")))).alias("src_pos"),
    )


def merge_definitions(*branches: DataFrame) -> DataFrame:
    """All positions that may define a name after branches meet."""
    return (
        reduce(DataFrame.unionByName, branches)
        .groupBy("sample_id", "name")
        .agg(F.sort_array(F.collect_set("pos")).alias("def_pos"))
    )
