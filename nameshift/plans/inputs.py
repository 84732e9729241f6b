"""What every strategy needs: scores, names, gate, and the search space."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nameshift.functions.names import identifiers, is_valid_name
from nameshift.functions.token_batches import token_count_batches
from nameshift.operators.candidates import TOP_K, FillModel, search_space
from nameshift.operators.importance import occurrence_importance
from nameshift.operators.scoring import BLOCK_SIZE, LinearScorer, margin, predicted, prob_of, sigmoid
from nameshift.operators.search import by_name, by_sample, earlier_ranks, flips
from nameshift.operators.tokens import with_tokens
from nameshift.session import stage

#: Remarks on samples that are not attacked (fixed values).
WRONGLY_PREDICTED = "This code is wrongly predicted by the model."
NO_VARIABLE = "This code does not include any variable."
NO_SUBSTITUTES = "Variables do not have substitutes."


def weighted_terms(lexed: DataFrame, scorer: LinearScorer, places: bool = False) -> DataFrame:
    """One row per (sample, token) of the whole text, with counts, weight, and the sample's score; with its ``places`` if wanted.

    ``n_occ`` counts the whole text, ``n_win`` the model window; ``total`` and ``n`` are weight sum and size of the
    window; ``enter_w`` is the weight of the token right behind the window.
    """
    block = scorer.block_size
    # whole arrays are sent by sample, so that counting sends no row per token
    rows = lexed.repartition("sample_id").select(
        "sample_id", "label", F.size("tokens").cast("long").alias("n_tokens"), F.posexplode("tokens").alias("pos", "tok")
    )
    counted = rows.groupBy("sample_id", "label", "n_tokens", "tok").agg(
        F.min("pos").cast("long").alias("first_pos"),
        F.count("*").alias("n_occ"),
        F.count(F.when(F.col("pos") < block, 1)).alias("n_win"),
        F.max(F.col("pos") == block).alias("enters"),
        *([F.collect_list("pos").alias("places")] if places else []),
    )
    by_sample = Window.partitionBy("sample_id")
    return (
        scorer.weigh_rows(counted, "tok", ["sample_id"])
        .withColumn("total", F.sum(F.col("n_win") * F.col("w")).over(by_sample))
        .withColumn("enter_w", F.coalesce(F.max(F.when(F.col("enters"), F.col("w"))).over(by_sample), F.lit(0)))
        .withColumn("n", F.least("n_tokens", F.lit(block).cast("long")))
        .drop("enters")
    )


def window_scores(lexed: DataFrame, scorer: LinearScorer) -> DataFrame:
    """``(sample_id, total, n)``: weight sum and size of the model window. Its tokens are counted in their own text, so they are sent
    once, for their weights; the rest of the text is left out."""
    window = lexed.select("sample_id", F.slice("tokens", 1, scorer.block_size).alias("tokens"))
    kind = lexed.schema["sample_id"].dataType.simpleString()
    counted = window.mapInArrow(token_count_batches, f"sample_id {kind}, n long, tok string, n_win long")
    weighed = scorer.weigh_rows(counted, "tok", ["sample_id"])
    return weighed.groupBy("sample_id").agg(F.sum(F.col("n_win") * F.col("w")).alias("total"), F.first("n").alias("n"))


def gate(predictions: DataFrame) -> DataFrame:
    """P5: only correctly predicted samples are attacked."""
    return predictions.where(F.col("predict_label") == F.col("label"))


def ranked(rows: DataFrame) -> DataFrame:
    """I5 on rows of names or their candidates: all rows of a name share its rank."""
    by_importance = Window.partitionBy("sample_id").orderBy(F.desc("importance"), "first_pos")
    return rows.withColumn("rank", F.dense_rank().over(by_importance).cast("long"))


def counted_names(names: DataFrame) -> DataFrame:
    """Ranked names with ``m`` candidates each: ``m, ahead, n_occ_all, alone`` as the search operators would count them over all candidates."""
    size = F.col("m")
    return names.withColumns(
        {
            "ahead": F.coalesce(F.sum(size).over(earlier_ranks()), F.lit(0)),
            "n_occ_all": F.sum("n_occ").over(by_sample()),
            "m": F.sum(size).over(by_name()),
            "alone": F.sum(size).over(by_name()) == size,
        }
    )


@dataclass
class AttackInputs:
    """Samples ``(sample_id, code, label)`` with a trained scorer and fill model; tables are computed once, on demand."""

    samples: DataFrame
    scorer: LinearScorer
    fill_model: FillModel | Callable[[], FillModel]
    lang: str = "c"
    #: ``all`` valid words of a text may be renamed, or only ``declared`` names.
    names_mode: str = "all"

    @classmethod
    def prepare(
        cls,
        samples: DataFrame,
        fill_corpus: DataFrame,
        lang: str = "c",
        block_size: int = BLOCK_SIZE,
        top_k: int = TOP_K,
        smoothing: float = 1.0,
        train: DataFrame | None = None,
        names_mode: str = "all",
        scorer_later: bool = False,
    ) -> "AttackInputs":
        """Built-in models: the scorer trained on ``train`` (else on the samples themselves), the fill model on a corpus of
        texts, which waits until candidates are wanted; so does the scorer if it may come later."""
        inputs = cls(samples, None, lambda: FillModel.train(with_tokens(fill_corpus, lang=lang), top_k, lang), lang, names_mode)
        del inputs.scorer
        inputs.train_scorer = lambda: LinearScorer.train(inputs.tokens if train is None else with_tokens(train, lang=lang), block_size, smoothing)
        if not scorer_later:
            inputs.scorer = inputs.train_scorer()
        return inputs

    def __getattr__(self, name: str):
        """The scorer that ``prepare`` announced, trained when it is first asked for."""
        if name != "scorer" or "train_scorer" not in self.__dict__:
            raise AttributeError(name)
        self.scorer = self.train_scorer()
        return self.scorer

    @cached_property
    def fills(self) -> FillModel:
        return self.fill_model() if callable(self.fill_model) else self.fill_model

    @cached_property
    def candidate_fills(self) -> FillModel:
        """``fills`` whose lists bring the scorer's weight of every word: it is looked up once per word, not once per candidate."""
        return replace(self.fills, weigh=lambda words, token: self.scorer.weigh_rows(words, token, [token]))

    @property
    def block(self) -> int:
        """Size of the model window in tokens."""
        return self.scorer.block_size

    @property
    def prob_unchanged(self) -> Column:
        """Probability of the true label on the text as it is, from the columns of the search rows."""
        return sigmoid(margin(F.col("margin"), F.col("n")))

    #: Deltas of different names add up, so a whole greedy search fits into windows.
    additive = True

    @cached_property
    def lexed(self) -> DataFrame:
        return with_tokens(self.samples, lang=self.lang).select("sample_id", "label", "tokens")

    @cached_property
    def tokens(self) -> DataFrame:
        """``lexed``, made once: training, scores, terms and gaps all start from it, and no text is sent again."""
        return stage(self.lexed, "tokens")

    @cached_property
    def terms(self) -> DataFrame:
        return stage(weighted_terms(self.tokens, self.scorer), "terms")

    @cached_property
    def predictions(self) -> DataFrame:
        """M1: ``(sample_id, label, predict_label, predict_probability, total, n)`` for every sample."""
        zero = F.lit(0).cast("long")
        return stage(
            self.tokens.select("sample_id", "label")
            .join(window_scores(self.tokens, self.scorer), "sample_id", "left")
            .withColumn("total", F.coalesce("total", zero))
            .withColumn("n", F.coalesce("n", zero))
            .withColumn("predict_label", predicted(F.col("total")))
            .withColumn("predict_probability", prob_of(F.col("predict_label"), F.col("total"), F.col("n"))),
            "predictions",
        )

    @cached_property
    def names(self) -> DataFrame:
        """The renameable names of every sample, with the columns of ``terms``."""
        return self.names_of(self.terms)

    def names_of(self, terms: DataFrame) -> DataFrame:
        return self.declared_only(terms.where(is_valid_name(F.col("tok"), self.lang)).withColumnRenamed("tok", "name"))

    def declared_only(self, names: DataFrame) -> DataFrame:
        """In the mode ``declared`` only names that a declaration introduces."""
        if self.names_mode == "all":
            return names
        declared = self.lexed.select("sample_id", F.explode(identifiers(F.col("tokens"), self.lang, self.names_mode)).alias("name"))
        return names.join(declared, ["sample_id", "name"], "left_semi")

    @cached_property
    def attackable(self) -> DataFrame:
        """P5 on tokens."""
        return self.tokens.join(gate(self.predictions).select("sample_id"), "sample_id", "left_semi")

    def space(self, top_k: int | None = None, **limits) -> DataFrame:
        """C8 with the scorer's weight of each candidate; ``top_k`` fills per gap, by default those of the model."""
        key = (top_k, *sorted(limits.items()))
        if key not in self._spaces:
            model = self.candidate_fills if top_k is None else self.candidate_fills.resized(top_k, self.lang)
            self._spaces[key] = stage(self.prepare_space(self.found_space(model, **limits)), "space")
        return self._spaces[key]

    def found_space(self, model: FillModel, **limits) -> DataFrame:
        """C8, made anew by each reader."""
        found = search_space(self.attackable, None, model, self.lang, self.block, **limits)
        return found if self.names_mode == "all" else found.join(self.names.select("sample_id", "name"), ["sample_id", "name"], "left_semi")

    def space_counts(self) -> DataFrame:
        """``(sample_id, n_subst)``: how many candidates a sample has. If nothing else has asked for them, they are counted as they are
        made, and not kept."""
        space = self.space() if (None,) in self._spaces else self.found_space(self.fills)
        return space.groupBy("sample_id").agg(F.count("*").alias("n_subst"))

    def prepare_space(self, found: DataFrame) -> DataFrame:
        return found if "w_cand" in found.columns else self.scorer.weigh_rows(found, "cand", ["sample_id", "name"], "w_cand")

    @cached_property
    def _spaces(self) -> dict:
        return {}

    def name_rows(self, importance: str | None) -> DataFrame:
        """Names of gated samples: ``sample_id, name, label, n_occ, first_pos, importance, margin, n, n_win, w``."""
        label = F.col("label")
        sign = F.when(label == 1, F.lit(1)).otherwise(F.lit(-1))
        score = F.lit(0.0)
        if importance is not None:
            each = occurrence_importance(importance, F.lit(True), self.scorer.unseen_weight())
            score = F.round(F.col("n_win") * each, 9)
        return self.names.where(predicted(F.col("total")) == label).select(
            "sample_id",
            "name",
            "label",
            "n",
            "n_occ",
            "n_win",
            "w",
            "first_pos",
            score.alias("importance"),
            (sign * F.col("total")).alias("margin"),
        )

    def occurrence_scores(self, kind: str) -> DataFrame:
        """I1-I3 per occurrence of the whole text: ``(sample_id, name, first_pos, pos, score)``.

        A token's places travel with its counts, so occurrences become rows where their scores are known, and are not sent.
        """
        by_sample, by_name = Window.partitionBy("sample_id"), Window.partitionBy("sample_id", "name")
        right = F.max(predicted(F.col("total")) == F.col("label")).over(by_sample)
        rows = weighted_terms(self.tokens, self.scorer, places=True).where("sample_id IS NOT NULL").withColumn("right", right).where("right")
        # texts that share an id share the places of a name
        rows = self.names_of(rows).withColumn("places", F.flatten(F.collect_list("places").over(by_name))).withColumn("pos", F.explode("places"))
        seen = F.col("pos") < self.scorer.block_size
        return rows.select("sample_id", "name", "first_pos", "pos", occurrence_importance(kind, seen, self.scorer.unseen_weight()).alias("score"))

    def search_rows(self, space: DataFrame, importance: str | None) -> DataFrame:
        """Candidates with everything the search windows need; ``rank`` is by importance, or by text order.

        ``delta`` is the signed effect of the one rename, ``flips_alone`` and ``prob`` its outcome.
        """
        sign = F.when(F.col("label") == 1, F.lit(1)).otherwise(F.lit(-1))
        # names are ranked, and their candidates counted, before they meet them
        sizes = space.groupBy("sample_id", "name").agg(F.count("*").alias("m"))
        names = counted_names(ranked(sizes.join(self.name_rows(importance), ["sample_id", "name"])))
        rows = space.join(names, ["sample_id", "name"]).withColumn("delta", sign * F.col("n_win") * (F.col("w_cand") - F.col("w")))
        changed = F.col("margin") + F.col("delta")
        return rows.withColumn("flips_alone", flips(F.col("label"), changed)).withColumn("prob", sigmoid(margin(changed, F.col("n"))))

    def plain_rows(self, space: DataFrame, importance: str | None) -> DataFrame:
        """Search rows for strategies that score no more than their budget; weights are at hand, so all are scored."""
        return self.search_rows(space, importance)

    def scored_rows(self, rows: DataFrame) -> DataFrame:
        """``plain_rows`` that are left after the budget, with ``delta``, ``flips_alone`` and ``prob``."""
        return rows

    def evaluate(self, rows: DataFrame) -> DataFrame:
        """Outcome of a whole assignment ``genes map<bigint, struct<name, cand, delta>>``: ``change, flipped, prob``.

        Needs ``label, margin, n``. The linear classifier adds up the deltas.
        """
        change = F.aggregate(F.map_values("genes"), F.lit(0).cast("long"), lambda acc, g: acc + g["delta"])
        rows = rows.withColumn("change", change)
        changed = F.col("margin") + F.col("change")
        return rows.withColumn("flipped", flips(F.col("label"), changed)).withColumn(
            "prob", sigmoid(margin(changed, F.col("n")))
        )

    def name_counts(self) -> DataFrame:
        if self.additive and self.names_mode == "all" and "terms" not in self.__dict__:
            # names are counted in their own texts, as in ``terms``: texts that share an id, a label and a size are one
            texts = self.tokens.select("sample_id", "label", F.size("tokens").alias("n_tokens"), identifiers(F.col("tokens"), self.lang).alias("names"))
            merged = texts.where("n_tokens > 0").groupBy("sample_id", "label", "n_tokens").agg(F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"))
            return merged.where(F.size("names") > 0).groupBy("sample_id").agg(F.sum(F.size("names")).alias("n_names"))
        return self.names.groupBy("sample_id").agg(F.count("*").alias("n_names"))


def outcome_note(wrong, n_names, n_subst):
    """P6."""
    return (
        F.when(wrong, F.lit(WRONGLY_PREDICTED))
        .when(n_names == 0, F.lit(NO_VARIABLE))
        .when(n_subst == 0, F.lit(NO_SUBSTITUTES))
    )
