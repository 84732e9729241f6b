"""Scoring: pluggable classifiers, and a built-in linear classifier made of token counts.

Weights are whole micro-units, so sums are exact: a score does not depend on partitioning or order, and equal
scores are really equal. For the linear classifier the effect of masking, deleting or renaming a token is a
difference of weights, so no variant text has to be built to score it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nameshift.operators.skew import skew_join
from nameshift.operators.tokens import token_rows
from nameshift.session import stage

MICRO = 1_000_000
BLOCK_SIZE = 510


class Scorer(Protocol):
    """A classifier: adds ``logits array<double>`` to rows that carry ``tokens`` (and ``code`` if it wants text)."""

    def score(self, df: DataFrame) -> DataFrame: ...


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def with_prediction(df: DataFrame) -> DataFrame:
    """M1: element-wise sigmoid, argmax (first index on a tie), and its probability."""
    return (
        df.withColumn("probs", F.transform("logits", lambda x: sigmoid(x.cast("double"))))
        .withColumn("pred_label", F.array_position("probs", F.array_max("probs")).cast("long") - 1)
        .withColumn("pred_prob", F.array_max("probs"))
    )


def label_prob(probs: Column, label: Column) -> Column:
    """M2: probability of the true label."""
    return F.get(probs, label.cast("int"))


def text_key(tokens: Column) -> Column:
    """A digest that stands for a token sequence in shuffles."""
    return F.sha2(F.array_join(tokens, "\x1f"), 256)


def score_distinct(variants: DataFrame, scorer: Scorer, key: str = "tokens") -> DataFrame:
    """M4: score every distinct variant once, then hand the result to all its rows."""
    keyed = variants.withColumn("variant_key", text_key(F.col(key)))
    distinct = keyed.select("sample_id", "variant_key", key).dropDuplicates(["sample_id", "variant_key"])
    scored = with_prediction(scorer.score(distinct)).select(
        "sample_id", "variant_key", "logits", "probs", "pred_label", "pred_prob"
    )
    return keyed.join(scored, ["sample_id", "variant_key"]).drop("variant_key")


@dataclass
class BatchScorer:
    """Any model, loaded once per Python worker and fed whole batches of texts."""

    make_predict: Callable[[], Callable]
    batch_size: int = 64
    text: Callable[[DataFrame], Column] | None = None
    name: str = "model"

    def score(self, df: DataFrame) -> DataFrame:
        predict = predict_batch_udf(
            self.make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=self.batch_size
        )
        text = self.text(df) if self.text else F.array_join("tokens", " ")
        return df.withColumn("logits", predict(text).cast("array<double>"))


def class_counts(lexed: DataFrame) -> DataFrame:
    """Token counts per class over whole texts. Hot tokens collapse before the shuffle."""
    return (
        token_rows(lexed, "label")
        .groupBy("tok")
        .agg(
            F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("c1"),
            F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).alias("c0"),
        )
    )


def weigh(counts: DataFrame, smoothing: float = 1.0) -> DataFrame:
    """M3: smoothed log-odds per token, in micro-units; ``unseen`` is the weight of any other token."""
    totals = counts.agg(
        F.struct(F.sum("c1").alias("n1"), F.sum("c0").alias("n0"), F.count("*").alias("v"))
    ).scalar()
    t = F.col("t")

    def micro(c1: Column, c0: Column) -> Column:
        share1 = (c1 + smoothing) / (t["n1"] + smoothing * t["v"])
        share0 = (c0 + smoothing) / (t["n0"] + smoothing * t["v"])
        odds = F.log(share1) - F.log(share0)
        return F.round(odds * float(MICRO)).cast("long")

    return counts.withColumn("t", totals).select(
        "tok",
        micro(F.col("c1"), F.col("c0")).alias("w"),
        micro(F.lit(0), F.lit(0)).alias("unseen"),
        (F.col("c1") + F.col("c0")).alias("n"),
    )


def margin(total: Column, n: Column) -> Column:
    """Mean weight of the window's tokens; no token, no margin."""
    return F.when(n > 0, total / (n * float(MICRO))).otherwise(F.lit(0.0))


def predicted(total: Column) -> Column:
    """Label 1 needs a positive margin; a tie is label 0."""
    return (total > 0).cast("long")


def prob_of(label: Column, total: Column, n: Column) -> Column:
    z = margin(total, n)
    return sigmoid(F.when(label == 1, z).otherwise(-z))


@dataclass
class LinearScorer:
    """The built-in classifier: ``weights(tok, w, n)`` and the one-row ``unseen(w)``."""

    weights: DataFrame
    unseen: DataFrame
    block_size: int = BLOCK_SIZE
    name: str = "linear"

    @classmethod
    def train(cls, lexed: DataFrame, block_size: int = BLOCK_SIZE, smoothing: float = 1.0, name: str = "linear") -> "LinearScorer":
        counts = stage(class_counts(lexed), "class-counts")
        weighed = stage(weigh(counts, smoothing), "weights")
        return cls(weighed.drop("unseen"), weighed.agg(F.max("unseen").alias("w")), block_size, name)

    def unseen_weight(self) -> Column:
        return F.coalesce(self.unseen.scalar(), F.lit(0).cast("long"))

    def weigh_rows(self, df: DataFrame, token: str, spread: list[str], out: str = "w") -> DataFrame:
        """Attach the weight of ``df[token]``."""
        table = self.weights.select(F.col("tok").alias(token), F.col("w").alias(out), F.col("n").alias("_n"))
        return skew_join(df, table, [token], "_n", spread).withColumn(
            out, F.coalesce(F.col(out), self.unseen_weight())
        )

    def score(self, df: DataFrame) -> DataFrame:
        """General form: score rows that carry their whole token array."""
        keyed = df.withColumn("_row", text_key(F.col("tokens")))
        counted = (
            keyed.dropDuplicates(["_row"])
            .select("_row", F.explode(F.slice("tokens", 1, self.block_size)).alias("tok"))
            .groupBy("_row", "tok")
            .agg(F.count("*").alias("k"))
        )
        totals = (
            self.weigh_rows(counted, "tok", ["_row"])
            .groupBy("_row")
            .agg(F.sum(F.col("k") * F.col("w")).alias("_total"), F.sum("k").alias("_n"))
        )
        z = margin(F.coalesce("_total", F.lit(0)), F.coalesce("_n", F.lit(0)))
        return (
            keyed.join(totals, "_row", "left")
            .withColumn("logits", F.array(-z, z))
            .drop("_row", "_total", "_n")
        )
