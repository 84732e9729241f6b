"""Token tables and position indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nameshift.functions.lexing import pieces, strip_comments, tokenize
from nameshift.functions.names import is_uid


def with_tokens(samples: DataFrame, text: str = "code", lang: str = "c") -> DataFrame:
    """T6 as an array column. Python also loses strings that stand alone."""
    clean = strip_comments(F.col(text), lang) if lang == "python" else F.col(text)
    return samples.withColumn("tokens", tokenize(clean, lang))


def token_rows(lexed: DataFrame, *keep: str) -> DataFrame:
    """T6 as rows: ``(sample_id, *keep, pos, tok)``."""
    return lexed.select("sample_id", *keep, F.posexplode("tokens").alias("pos", "tok"))


def positions(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Where the names of each sample occur."""
    wanted = names.select("sample_id", F.col("name").alias("tok"))
    return rows.join(wanted, ["sample_id", "tok"]).select("sample_id", F.col("tok").alias("name"), "pos")


def uid_positions(rows: DataFrame, space: DataFrame, compat: bool = False) -> DataFrame:
    """Occurrences of strict identifiers that are keys of the sample's name map."""
    keys = space.select("sample_id", F.explode(F.map_keys("name_map")).alias("tok"))
    return (
        rows.where(is_uid(F.col("tok"), compat))
        .join(keys, ["sample_id", "tok"], "left_semi")
        .select("sample_id", F.col("tok").alias("name"), "pos")
    )


def space_in_text(candidates: DataFrame, rows: DataFrame) -> DataFrame:
    """Candidates of names that the sample's text still contains."""
    return candidates.join(
        rows.select("sample_id", F.col("tok").alias("name")), ["sample_id", "name"], "left_semi"
    )


def subword_offsets(samples: DataFrame, text: str = "code") -> DataFrame:
    """Words split at blanks, with their ``[start, end)`` range in sub-word units."""
    words = F.split(F.replace(F.col(text), F.lit("\n"), F.lit("")), " ")
    rows = samples.select("sample_id", F.posexplode(words).alias("pos", "word")).withColumn(
        "n_pieces", F.size(pieces(F.col("word"))).cast("long")
    )
    so_far = Window.partitionBy("sample_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("end", F.sum("n_pieces").over(so_far)).select(
        "sample_id", "pos", "word", (F.col("end") - F.col("n_pieces")).alias("start"), "end"
    )


def in_window(offsets: DataFrame, window: int, start: str = "start") -> DataFrame:
    """Occurrences whose first sub-word lies in the model window."""
    return offsets.where(F.col(start) < window)
