"""Joins against per-key tables whose hot keys may hold a large share of the left rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1000
SALTS = 32


def skew_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    weight: str,
    spread: list[str],
    how: str = "left",
    salts: int = SALTS,
    share: int = HOT_SHARE,
) -> DataFrame:
    """Join ``left`` to ``right`` (one row per key) with hot keys split over ``salts`` tasks.

    ``right[weight]`` says how often a key occurs. A key is hot when it holds at least ``1/share`` of the
    total weight, so there are at most ``share`` of them: that bound is what makes broadcasting the hot list
    safe and limits the copies on the right to ``share * salts``. Left rows of a hot key are dealt to salts by
    the hash of ``spread``. All other rows take the plain shuffle join, which Catalyst turns into a broadcast
    join by itself when ``right`` is small enough.
    """
    total = right.agg(F.sum(weight)).scalar()
    is_hot = F.col(weight) * share >= total
    hot = right.where(is_hot).select(*keys, F.lit(True).alias("_hot"))
    salted_left = left.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    )
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    salted_right = right.withColumn("_salt", F.explode(copies)).drop(weight)
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_hot", "_salt")
