"""How much the prediction depends on each name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nameshift.operators.scoring import predicted, prob_of

KINDS = ("unk", "delete", "mask")


def occurrence_importance(kind: str, in_window: Column, unseen: Column) -> Column:
    """I1 / I2 / I3 for one occurrence, in closed form for the linear classifier.

    Needs ``label, total, n, n_tokens, w, enter_w`` of the row: weight sum and size of the window, the weight
    of the masked token, and of the token that enters the window when one is deleted.
    """
    label, total, n, w = F.col("label"), F.col("total"), F.col("n"), F.col("w")
    before = prob_of(label, total, n)
    if kind in ("unk", "mask"):
        after = prob_of(label, total - w + unseen, n)
        return F.when(in_window, before - after).otherwise(F.lit(0.0))
    if kind != "delete":
        raise ValueError(f"importance kind {kind!r}, expected one of {KINDS}")
    slides = F.col("n_tokens") > n
    new_total = total - w + F.when(slides, F.col("enter_w")).otherwise(F.lit(0))
    new_n = F.when(slides, n).otherwise(n - 1)
    drop = before - prob_of(label, new_total, new_n)
    new_label = predicted(new_total)
    turned = prob_of(new_label, new_total, new_n) - prob_of(new_label, total, n)
    return F.when(in_window, F.when(new_label == label, drop).otherwise(drop + turned)).otherwise(F.lit(0.0))


def shift_scores(occ: DataFrame, order: list[str], score: str = "score") -> DataFrame:
    """I4 (compat): each occurrence takes the score of the variant before it; the first takes that of the
    unmasked text, which is 0."""
    by_sample = Window.partitionBy("sample_id").orderBy(*order)
    return occ.withColumn(score, F.coalesce(F.lag(score).over(by_sample), F.lit(0.0)))


def importance_by_name(occ: DataFrame) -> DataFrame:
    """I4: occurrence scores added up per name."""
    return occ.groupBy("sample_id", "name").agg(
        F.round(F.sum("score"), 9).alias("importance"), F.min("pos").alias("first_pos")
    )


def rank_names(names: DataFrame) -> DataFrame:
    """Most important first, then first seen. A sample's names are bounded by its text."""
    order = Window.partitionBy("sample_id").orderBy(F.desc("importance"), "first_pos")
    return names.withColumn("rank", F.row_number().over(order).cast("long"))


def query_count(occ: DataFrame) -> DataFrame:
    """One query per variant and one for the unmasked text."""
    return occ.groupBy("sample_id").agg((F.count("*") + 1).alias("query_count"))


def importance_threshold(names: DataFrame, threshold: float) -> DataFrame:
    """P12."""
    return names.where(F.col("importance") >= threshold)
