"""Window forms of the bounded rename search.

Rows are (sample_id, name, idx) candidates with ``rank`` of the name, ``margin`` of the sample and ``delta`` of the
candidate. Margin and delta are signed so that a lower value is worse for the true label: the label flips when
``margin + delta`` falls below 0, or to 0 if the label is 1. Substitutes are never names of the same sample, so the
deltas of different names add up. A sample has at most window size x top k rows, so a window per sample is small.

Rows may bring what a name's own row knows: ``m``, the number of its candidates, ``ahead``, that of the names before it, and ``n_occ_all``, the
occurrences of all names, and ``alone``, whether no other row has its sample and name. These are not counted again over the candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_sample():
    return Window.partitionBy("sample_id")


def by_name():
    return Window.partitionBy("sample_id", "name")


def earlier_ranks():
    return Window.partitionBy("sample_id").orderBy("rank").rangeBetween(Window.unboundedPreceding, -1)


def with_counts(rows: DataFrame) -> DataFrame:
    """``m``: how many candidates the name has."""
    return rows if "m" in rows.columns else rows.withColumn("m", F.count("*").over(by_name()))


def flips(label: Column, signed_margin: Column) -> Column:
    return (signed_margin < 0) | ((signed_margin == 0) & (label == 1))


def apply_budget(rows: DataFrame, max_iter: int | None) -> DataFrame:
    """Keep the candidates that are queried before the budget ends.

    Needs ``q0``, the queries spent before the search. Adds ``used``, the queries spent before the name, and
    ``evaluated``. Once the budget is spent, every later name still gets one query. ``None`` sets no budget.
    """
    ahead = F.col("ahead") if "ahead" in rows.columns else F.coalesce(F.count("*").over(earlier_ranks()), F.lit(0))
    sized = with_counts(rows).withColumn("before", F.col("q0") + ahead).drop("ahead")
    if max_iter is None:
        return sized.withColumn("used", F.col("before")).withColumn("evaluated", F.col("m")).drop("m", "before")
    past = F.col("before") >= max_iter
    first_past = F.min(F.when(past, F.col("rank"))).over(by_sample())
    # every name keeps its first candidate, so rows are left out before they are sorted for the window
    return (
        sized.withColumn("evaluated", F.when(past, F.lit(1)).otherwise(F.least("m", F.lit(max_iter) - F.col("before"))).cast("long"))
        .where(F.col("idx") <= F.col("evaluated"))
        .withColumn("first_past", first_past)
        .withColumn(
            "used",
            F.when(past, F.greatest("q0", F.lit(max_iter)) + F.col("rank") - F.col("first_past")).otherwise(F.col("before")),
        )
        .drop("m", "before", "first_past")
    )


def best_candidate(rows: DataFrame) -> DataFrame:
    """``best(delta, idx, cand)`` of the name: largest drop, first on a tie, null if nothing drops."""
    best = F.min(F.struct("delta", "idx", "cand")).over(by_name())
    return rows.withColumn("best", best).withColumn("best", F.when(F.col("best.delta") < 0, F.col("best")))


def first_chances(rows: DataFrame) -> DataFrame:
    """The first candidate of every name, and those that can be the first of their name to flip the label.

    A lower delta flips whenever a higher one does, so a candidate that lowers no more than the name's first one, or that
    comes after the best one, is never the first. Only these rows need to meet the other names of their sample. A name of several texts that
    share an id, with a margin and a rank each, keeps all. Needs ``best``.
    """
    if "alone" not in rows.columns:
        rows = rows.withColumn("alone", F.count(F.when(F.col("idx") == 1, 1)).over(by_name()) == 1)
    rows = rows.withColumn("_first", F.min(F.when(F.col("idx") == 1, F.col("delta"))).over(by_name()))
    chance = (F.col("delta") < F.col("_first")) & F.coalesce(F.col("idx") <= F.col("best.idx"), F.lit(True))
    return rows.where((F.col("idx") == 1) | ~F.col("alone") | chance).drop("_first", "alone")


def first_flip(rows: DataFrame) -> DataFrame:
    """``flip(rank, idx, name, cand)``: the first candidate that flips the label on top of the best renames of
    all earlier names; null if none does."""
    gained = F.when(F.col("idx") == 1, F.coalesce("best.delta", F.lit(0)))
    earlier = F.coalesce(F.sum(gained).over(earlier_ranks()), F.lit(0))
    rows = rows.withColumn("so_far", F.col("margin") + earlier)
    hit = flips(F.col("label"), F.col("so_far") + F.col("delta"))
    return rows.withColumn("flip", F.min(F.when(hit, F.struct("rank", "idx", "name", "cand"))).over(by_sample()))
