"""Variants of a token sequence: one row per masked, deleted or renamed version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nameshift.functions.renaming import rename_one

UNKNOWN = "<unk>"
MASK = "<mask>"


def replace_at(tokens: Column, pos: Column, token: str) -> Column:
    return F.transform(tokens, lambda t, i: F.when(i == pos, F.lit(token)).otherwise(t))


def delete_at(tokens: Column, pos: Column) -> Column:
    return F.concat(F.slice(tokens, F.lit(1), pos), F.slice(tokens, pos + 2, F.size(tokens)))


def occurrences(lexed: DataFrame, names: str = "names") -> DataFrame:
    """One row per occurrence of a name: ``(sample_id, tokens, pos, name)``. Bounded by the text itself."""
    at = F.filter(
        F.transform(F.col("tokens"), lambda t, i: F.struct(i.alias("pos"), t.alias("name"))),
        lambda o: F.array_contains(F.col(names), o["name"]),
    )
    return lexed.select("sample_id", "tokens", F.explode(at).alias("o")).select("sample_id", "tokens", "o.pos", "o.name")


def mask_each(occ: DataFrame, token: str = UNKNOWN) -> DataFrame:
    """V1 (``<unk>``) and V4 (``<mask>``): one variant per occurrence."""
    return occ.withColumn("variant", replace_at(F.col("tokens"), F.col("pos"), token)).drop("tokens")


def mask_all(lexed: DataFrame, names: str = "names", token: str = UNKNOWN) -> DataFrame:
    """V2: one variant per name with all its occurrences masked."""
    return lexed.select("sample_id", "tokens", F.explode(names).alias("name")).select(
        "sample_id", "name", rename_one(F.col("tokens"), F.col("name"), F.lit(token)).alias("variant")
    )


def delete_each(occ: DataFrame) -> DataFrame:
    """V3: one variant per occurrence, that token removed."""
    return occ.withColumn("variant", delete_at(F.col("tokens"), F.col("pos"))).drop("tokens")


def rename_each(lexed: DataFrame, candidates: DataFrame) -> DataFrame:
    """V5: one variant per (name, candidate)."""
    return candidates.join(lexed.select("sample_id", "tokens"), "sample_id").select(
        "sample_id", "name", "cand", rename_one(F.col("tokens"), F.col("name"), F.col("cand")).alias("variant")
    )
