"""Attack inputs for any classifier: every outcome comes from scoring the changed text."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nameshift.functions.names import is_valid_name
from nameshift.functions.renaming import rename_many
from nameshift.operators import genetic
from nameshift.operators.candidates import FillModel
from nameshift.operators.scoring import BLOCK_SIZE, label_prob, score_distinct, with_prediction
from nameshift.operators.tokens import token_rows
from nameshift.operators.variants import MASK, UNKNOWN, delete_each, mask_each
from nameshift.plans.inputs import AttackInputs, ranked
from nameshift.session import stage

#: Probabilities become whole numbers of this unit, so that rankings and ties do not hang on the last bit.
UNIT = 10**12


def units(prob: Column) -> Column:
    return F.round(prob * float(UNIT)).cast("long")


@dataclass
class ModelInputs(AttackInputs):
    """Same tables as :class:`AttackInputs` for a pluggable scorer; ``margin`` holds the label's probability in units.

    The model is called once per distinct text of a bulk, and a bulk holds what the budget lets a strategy try.
    """

    block_size: int = BLOCK_SIZE
    additive = False

    @property
    def block(self) -> int:
        return self.block_size

    @property
    def prob_unchanged(self) -> Column:
        return F.col("margin") / float(UNIT)

    @cached_property
    def predictions(self) -> DataFrame:
        scored = with_prediction(self.scorer.score(self.lexed))
        return stage(
            scored.select(
                "sample_id",
                "label",
                F.col("pred_label").alias("predict_label"),
                F.col("pred_prob").alias("predict_probability"),
                "probs",
            ),
            "predictions",
        )

    @cached_property
    def names(self) -> DataFrame:
        rows = token_rows(self.lexed, "label").where(is_valid_name(F.col("tok"), self.lang))
        found = rows.groupBy("sample_id", "label", F.col("tok").alias("name")).agg(
            F.min("pos").cast("long").alias("first_pos"), F.count("*").alias("n_occ")
        )
        return stage(self.declared_only(found), "names")

    @property
    def candidate_fills(self) -> FillModel:
        return self.fills

    def prepare_space(self, found: DataFrame) -> DataFrame:
        return found

    @cached_property
    def _gated(self) -> DataFrame:
        right = self.predictions.where(F.col("predict_label") == F.col("label"))
        return right.select("sample_id", "label", F.col("probs").alias("probs0"), units(label_prob(F.col("probs"), F.col("label"))).alias("margin"))

    def occurrence_scores(self, kind: str) -> DataFrame:
        """I1-I3 by scoring a variant per occurrence."""
        at = self.attackable.select("sample_id", "tokens", F.posexplode("tokens").alias("pos", "name"))
        at = at.join(self.names.select("sample_id", "name", "first_pos"), ["sample_id", "name"])
        made = delete_each(at) if kind == "delete" else mask_each(at, MASK if kind == "mask" else UNKNOWN)
        cut = made.withColumn("tokens", F.slice("variant", 1, self.block_size)).drop("variant")
        scored = score_distinct(cut, self.scorer).join(self._gated, "sample_id")
        drop = label_prob(F.col("probs0"), F.col("label")) - label_prob(F.col("probs"), F.col("label"))
        if kind == "delete":
            turned = F.col("pred_prob") - label_prob(F.col("probs0"), F.col("pred_label"))
            drop = F.when(F.col("pred_label") == F.col("label"), drop).otherwise(drop + turned)
        return scored.select("sample_id", "name", "first_pos", "pos", drop.alias("score"))

    def name_rows(self, importance: str | None) -> DataFrame:
        names = self.names.join(self._gated.drop("probs0", "label"), "sample_id").withColumn("n", F.lit(0).cast("long"))
        if importance is None:
            return names.withColumn("importance", F.lit(0.0))
        scores = self.occurrence_scores(importance).groupBy("sample_id", "name")
        return names.join(scores.agg(F.round(F.sum("score"), 9).alias("importance")), ["sample_id", "name"])

    def plain_rows(self, space: DataFrame, importance: str | None) -> DataFrame:
        """Ranked candidates without a score: only the names' importance has asked the model."""
        rows = ranked(space.join(self.name_rows(importance), ["sample_id", "name"]))
        return stage(rows.withColumn("delta", F.lit(0).cast("long")), "plain-rows")

    def scored_rows(self, rows: DataFrame) -> DataFrame:
        scored = self._score_renamed(rows.drop("delta"), F.create_map("name", "cand"))
        return stage(scored.withColumnsRenamed({"change": "delta", "flipped": "flips_alone"}), "scored-rows")

    def search_rows(self, space: DataFrame, importance: str | None) -> DataFrame:
        return self.scored_rows(self.plain_rows(space, importance))

    def evaluate(self, rows: DataFrame) -> DataFrame:
        return self._score_renamed(rows, genetic.mapping(F.col("genes")))

    def _score_renamed(self, rows: DataFrame, mapping: Column) -> DataFrame:
        texts = rows.withColumn("mapping", mapping).join(self.lexed.select("sample_id", "tokens"), "sample_id")
        changed = F.slice(rename_many(F.col("tokens"), F.col("mapping")), 1, self.block_size)
        scored = score_distinct(texts.withColumn("tokens", changed).drop("mapping"), self.scorer)
        prob = label_prob(F.col("probs"), F.col("label"))
        return (
            scored.withColumn("prob", prob)
            .withColumn("change", units(F.col("prob")) - F.col("margin"))
            .withColumn("flipped", F.col("pred_label") != F.col("label"))
            .drop("tokens", "logits", "probs", "pred_label", "pred_prob")
        )
