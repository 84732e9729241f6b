"""Replacement candidates: a counted fill model, similarity cuts, composition of multi-piece words."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nameshift.functions import fill_index
from nameshift.functions.fill_index import FillIndex, Pairs, Vocabulary
from nameshift.functions.fill_lists import candidate_batches, fill_batches, kept_batches, merged_batches, near_batches, similar_batches, struck_batches
from nameshift.functions.lexing import pieces
from nameshift.functions.names import identifiers, is_valid_name
from nameshift.functions.shared_arrays import drop_files
from nameshift.functions.similarity import SIGNATURE_BITS, signature_cosine, signature_hash
from nameshift.operators.scoring import MICRO
from nameshift.operators.skew import skew_join
from nameshift.session import new_folder, stage

#: Attaches a column ``w`` to rows with the given token column.
Weigh = Callable[[DataFrame, str], DataFrame]

TOP_K = 60
#: Limits of the word composition: positions, pieces per position, prefixes per level.
MAX_POSITIONS, MAX_OPTIONS, BEAM = 12, 4, 24


def bigrams(lexed: DataFrame) -> DataFrame:
    """Counts of neighbouring tokens ``(a, b, c)``; the empty string marks both ends of a text."""
    ends = F.array(F.lit(""))
    pairs = F.arrays_zip(F.concat(ends, "tokens").alias("a"), F.concat("tokens", ends).alias("b"))
    return (
        lexed.select(F.explode(pairs).alias("p"))
        .select(F.col("p.a").alias("a"), F.col("p.b").alias("b"))
        .groupBy("a", "b")
        .agg(F.count("*").alias("c"))
    )


def top_neighbours(pairs: DataFrame, words: DataFrame, k: int, side: str, lang: str) -> DataFrame:
    """The ``k`` most frequent tokens after (or before) every token, as one bounded list per token.

    Spark cuts each map task to ``k`` rows per key before the shuffle (window group limit), so a token with
    millions of neighbours still sends few rows. P9, whether the token may be a name at all, is settled here, once per list
    entry. Lists are three flat arrays, with the validity packed into the score. A list that is not ``full`` holds every neighbour.
    """
    key, fill = ("a", "b") if side == "after" else ("b", "a")
    first = Window.partitionBy(key).orderBy(F.desc("c"), fill)
    best = (
        pairs.where(F.col(fill) != "")
        .withColumn("r", F.row_number().over(first))
        .where(F.col("r") <= k)
        .select(F.col(key).alias("key"), F.col(fill).alias("tok"), "c")
    )
    with_sig = skew_join(best, words, ["tok"], "n", ["key"])
    valid = F.when(is_valid_name(F.col("tok"), lang), 1).otherwise(0)
    entry = F.struct("tok", (2 * pair_score() + valid).cast("int").alias("score"), (F.col("sig") - (1 << 31)).cast("int").alias("sig"))
    lists = with_sig.groupBy("key").agg(F.collect_list(entry).alias("l"), F.sum("c").alias("n"))
    return lists.select("key", F.col("l.tok").alias("toks"), F.col("l.score").alias("scores"), F.col("l.sig").alias("sigs"), (F.size("l") >= k).alias("full"), "n")


def flat_words(lists: DataFrame) -> DataFrame:
    """Lists with their ``toks`` as one text and ``lens``, their lengths in bytes."""
    return lists.withColumn("lens", F.transform("toks", lambda t: F.octet_length(t))).withColumn("toks", F.array_join("toks", ""))


def pair_score() -> Column:
    """The score of a counted pair, in micro-units."""
    return F.round(F.log1p(F.col("c").cast("double")) * float(MICRO)).cast("long")


def keep_half(similar: Column) -> Column:
    """The better half, rounded down."""
    return F.slice(similar, F.lit(1), F.floor(F.size(similar) / 2).cast("int"))


def keep_threshold(similar: Column, threshold: float, at_most: int) -> Column:
    """C4: similarity at or above the threshold, then the first ``at_most``. Empty stays empty."""
    return F.slice(F.filter(similar, lambda s: signature_cosine(s["dist"]) >= threshold), 1, at_most)


def similarity_cut(threshold: float | None, at_most: int | None) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """C3, or C4 if there is a threshold, on arrays: which fills stay, from their places by similarity, distances and the sizes of their lists."""
    if threshold is None:
        return lambda place, dist, size: place < size // 2
    near = np.array([math.cos(math.pi / SIGNATURE_BITS * d) >= threshold for d in range(SIGNATURE_BITS + 1)])
    return lambda place, dist, size: near[dist] & (True if at_most is None else place < at_most)


def cut_scores(fills: Column, threshold: int) -> Column:
    """Stop at the first fill, in list order, that scores below the threshold; 0 keeps all."""
    if threshold == 0:
        return fills
    first_low = F.array_position(F.transform(fills, lambda f: f["score"] < threshold), True)
    return F.when(first_low == 0, fills).otherwise(F.slice(fills, F.lit(1), (first_low - 1).cast("int")))


def top_half(rows: DataFrame, group: list[str], similarity: str, order: str) -> DataFrame:
    """C3 on rows. Groups are the fills of one occurrence, so they are small by construction."""
    best = Window.partitionBy(*group).orderBy(F.desc(similarity), order)
    return (
        rows.withColumn("r", F.row_number().over(best))
        .withColumn("size", F.count("*").over(Window.partitionBy(*group)))
        .where(F.col("r") <= F.floor(F.col("size") / 2))
        .drop("size")
    )


def threshold_top_n(rows: DataFrame, group: list[str], similarity: str, order: str, threshold: float, n: int) -> DataFrame:
    """C4 on rows."""
    best = Window.partitionBy(*group).orderBy(F.desc(similarity), order)
    return rows.where(F.col(similarity) >= threshold).withColumn("r", F.row_number().over(best)).where(F.col("r") <= n)


def sample_texts(lexed: DataFrame) -> DataFrame:
    """``(sample_id, texts)``: the tokens of all texts that share an id."""
    return lexed.where(F.col("tokens").isNotNull()).groupBy("sample_id").agg(F.collect_list("tokens").alias("texts"))


def whole_samples(lexed: DataFrame) -> DataFrame:
    """``(sample_id, tokens)``: the texts of a sample, if several share its id, lie one after another in one task.

    What a sample needs of its own texts is then made where they lie, and of all that is made only the outcome is sent.
    """
    return sample_texts(lexed).select("sample_id", F.explode("texts").alias("tokens"))


def contexts(lexed: DataFrame, lang: str, block_size: int, own_names: bool = False) -> DataFrame:
    """The distinct gaps ``(sample_id, name, prev, next)`` of valid names inside the model window. If ``own_names`` are
    wanted, the names of the whole text come with them, as ``prev`` of rows without a name."""
    tokens = F.col("tokens")

    def gap(t: Column, i: Column) -> Column:
        return F.struct(
            i.alias("pos"),
            t.alias("name"),
            F.coalesce(F.get(tokens, i - 1), F.lit("")).alias("prev"),
            F.coalesce(F.get(tokens, i + 1), F.lit("")).alias("next"),
        )

    gaps = F.filter(F.transform(tokens, gap), lambda g: (g["pos"] < block_size) & is_valid_name(g["name"], lang))
    distinct = F.array_distinct(F.transform(gaps, lambda g: g.dropFields("pos")))
    if own_names:
        none = F.lit(None).cast("string")
        own = F.transform(identifiers(tokens, lang), lambda t: F.struct(none.alias("name"), t.alias("prev"), none.alias("next")))
        distinct = F.concat(distinct, own)
    return lexed.select("sample_id", F.explode(distinct).alias("g")).select("sample_id", "g.name", "g.prev", "g.next")


def run_parts(spark: SparkSession, n: int, make: Callable[[Iterator[int]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """The rows that ``make`` returns for the parts 0 to ``n`` - 1, a task each."""
    return spark.range(0, n, 1, n).mapInArrow(lambda batches: (out for batch in batches for out in make(iter(batch.column(0).to_pylist()))), schema)


def in_order(rows: DataFrame) -> tuple[str, ...]:
    """The files that the tasks of all parts wrote, by part."""
    return tuple(r["place"] for r in sorted(rows.collect(), key=lambda r: r["part"]))


def token_hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.xxhash64(t))


def vocabulary(tokens: DataFrame, lang: str, n: int) -> Vocabulary:
    """All distinct ``tok``, numbered by their bytes, with what the fill model asks of a token alone."""
    spark, folder = tokens.sparkSession, new_folder(tokens.sparkSession, "vocabulary")
    distinct = tokens.where("tok != ''").distinct().unionByName(spark.range(1).select(F.lit("").alias("tok")))
    hashed = distinct.repartitionByRange("tok").sortWithinPartitions("tok").select(
        "tok",
        F.xxhash64("tok").alias("hash"),
        signature_hash(F.concat(F.lit("R"), "tok")).alias("right"),
        signature_hash(F.concat(F.lit("L"), "tok")).alias("left"),
        is_valid_name(F.col("tok"), lang).alias("valid"),
    )
    made = hashed.mapInArrow(lambda batches: fill_index.word_files(batches, folder, TaskContext.get().partitionId()), "partition long, n long, place string")
    rows = sorted(made.collect(), key=lambda r: r["partition"])
    starts = np.cumsum([0, *(r["n"] for r in rows)]).tolist()
    words = Vocabulary(tuple(r["place"] for r in rows), tuple(starts))
    hashes = run_parts(spark, n, lambda parts: fill_index.hash_files(parts, words, n, folder), "part long, place string")
    return replace(words, hashes=in_order(hashes))


@dataclass(frozen=True)
class InPlace:
    """Rows and what is done to their Arrow batches, step after step, where they lie: all steps run in one Python worker."""

    rows: DataFrame
    steps: tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], ...]

    def then(self, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> "InPlace":
        return replace(self, steps=(*self.steps, step))

    def run(self, columns: str) -> DataFrame:
        """``sample_id, name`` and the columns that the last step adds."""
        steps, kind = self.steps, self.rows.schema["sample_id"].dataType.simpleString()
        return self.rows.mapInArrow(lambda batches: reduce(lambda made, step: step(made), steps, batches), f"sample_id {kind}, name string, {columns}")


@dataclass
class FillModel:
    """Counts that stand in for a masked language model.

    ``pairs(a, b, c)`` and ``words(tok, n, sig)`` are its tables. Gaps are filled from mapped files of the same counts, so neither
    pairs nor lists of neighbours are sent: ``seen`` numbers the tokens, ``counted`` holds the pairs by number, and the lists are made when
    the first gap wants them. ``weigh`` attaches a scorer's weight to every word, so that candidates carry it from the start.
    """

    pairs: DataFrame
    words: DataFrame
    top_k: int = TOP_K
    lang: str = "c"
    weigh: Weigh | None = None
    seen: Vocabulary | None = None
    counted: Pairs | None = None
    lists: tuple[str, ...] | None = None

    @classmethod
    def train(cls, lexed: DataFrame, top_k: int = TOP_K, lang: str = "c") -> "FillModel":
        spark = lexed.sparkSession
        n, folder = int(spark.conf.get("spark.sql.shuffle.partitions")), new_folder(spark, "pairs")
        seen = vocabulary(lexed.select(F.explode("tokens").alias("tok")), lang, n)
        # a text's tokens travel to its task's Python as numbers, and nowhere else
        hashes = lexed.select(token_hashes(F.col("tokens")).alias("hashes"))
        chunks = [r["uri"] for r in hashes.mapInArrow(lambda batches: fill_index.pair_chunks(batches, seen, n, folder), "uri string").collect()]
        files = stage(run_parts(spark, n, lambda parts: fill_index.pair_files(parts, chunks, folder), "part long, place string"), "bigrams")
        counted = Pairs(in_order(files))
        drop_files(chunks)
        pairs = files.mapInArrow(lambda batches: fill_index.pair_rows(batches, seen, n), "a string, b string, c long")
        lists = cls._lists(spark, seen, counted, top_k)
        words = run_parts(spark, n, lambda parts: fill_index.word_rows(parts, seen, lists), "tok string, n long, sig long")
        return cls(pairs, stage(words, "words"), top_k, lang, None, seen, counted, lists)

    @staticmethod
    def _lists(spark: SparkSession, seen: Vocabulary, counted: Pairs, k: int) -> tuple[str, ...]:
        folder, kind = new_folder(spark, "lists"), "part long, place string"
        dealt = list(in_order(run_parts(spark, counted.n, lambda parts: fill_index.dealt_files(parts, counted, folder), kind)))
        lists = in_order(run_parts(spark, counted.n, lambda parts: fill_index.list_files(parts, seen, counted, dealt, k, folder), kind))
        drop_files(dealt)
        return lists

    @cached_property
    def list_words(self) -> DataFrame:
        return stage(self.weigh(self.words, "tok"), "words") if self.weigh else self.words

    @cached_property
    def after(self) -> DataFrame:
        return stage(top_neighbours(self.pairs, self.words, self.top_k, "after", self.lang), "after")

    @cached_property
    def before(self) -> DataFrame:
        return stage(top_neighbours(self.pairs, self.words, self.top_k, "before", self.lang), "before")

    @cached_property
    def index(self) -> FillIndex:
        spark, seen, counted = self.words.sparkSession, self.seen, self.counted
        lists = self.lists or self._lists(spark, seen, counted, self.top_k)
        if not self.weigh:
            return FillIndex(seen, counted, lists, self.top_k)
        folder, n = new_folder(spark, "weights"), counted.n
        # parts of the words go by place in the vocabulary, as those of the lists do
        weighed = self.list_words.select(F.xxhash64("tok").alias("hash"), "w")
        numbered = weighed.mapInArrow(lambda batches: fill_index.numbered(batches, seen, n), "part long, number long, w long")
        files = numbered.repartition("part").sortWithinPartitions("part").mapInArrow(lambda batches: fill_index.weight_files(batches, seen.size, n, folder), "part long, place string")
        return FillIndex(seen, counted, lists, self.top_k, fill_index.all_parts(files.collect(), n))

    def resized(self, top_k: int, lang: str = "c") -> "FillModel":
        """The same counts with another number of fills per gap."""
        if top_k == self.top_k:
            return self
        seen = self.seen if lang == self.lang else vocabulary(self.words.select("tok"), lang, self.counted.n)
        return FillModel(self.pairs, self.words, top_k, lang, self.weigh, seen, self.counted)

    def _together(self, gaps: DataFrame) -> DataFrame:
        """Gaps with the hashes of their name and neighbours as ``toks``. Those of the same neighbours come together, so that they are filled
        once; a gap is sent once, and of ``toks`` only the name's."""
        hashed = gaps.withColumn("toks", token_hashes(F.array("name")))
        return hashed.repartition("prev", "next").sortWithinPartitions("prev", "next").withColumn("toks", F.concat("toks", token_hashes(F.array("prev", "next"))))

    def fills(self, gaps: DataFrame) -> DataFrame:
        """Gaps ``(name, prev, next, …)`` with ``fills array<struct<neg, tok, sig, ok>>``: the best ``top_k`` of the
        ``top_k`` most frequent tokens on either side."""
        index, fields = self.index, _fields(gaps)
        schema = f"{fields}, fills array<struct<neg:bigint,tok:string,sig:bigint,ok:boolean>>"
        return self._together(gaps).mapInArrow(lambda batches: fill_batches(batches, index), schema)

    def similar_fills(self, gaps: DataFrame) -> DataFrame:
        """C1 + similarity order: gaps ``(name, prev, next, …)`` with ``similar array<struct<dist, idx, cand, score, ok>>``, by the
        signature's distance to that of the name; equal ones keep the fill order. A name the corpus lacks has signature 0."""
        index, fields = self.index, _fields(gaps)
        schema = f"{fields}, similar array<struct<dist:int,idx:int,cand:string,score:bigint,ok:boolean>>"
        return self._together(gaps).mapInArrow(lambda batches: similar_batches(batches, index), schema)

    def kept_fills(self, gaps: DataFrame, threshold: float | None, at_most: int | None, score_cut: int) -> DataFrame:
        """``similar_fills`` after C3 or C4, P13 and P9: gaps with ``toks, lens, scores``, the words that are left as one text and
        their lengths, and ``weights`` if there are any. A list crosses to Arrow and back as a few values, not as one per word."""
        index, fields = self.index, _fields(gaps)
        cut = similarity_cut(threshold, at_most)
        weighed = self.weigh is not None
        kind = f"{FLAT}, weights array<int>" if weighed else FLAT
        return self._together(gaps).mapInArrow(lambda batches: kept_batches(batches, index, cut, score_cut, weighed), f"{fields}, {kind}")


    def near_fills(self, gaps: DataFrame, threshold: float | None = None, at_most: int | None = None, score_cut: int = 0, valid_only: bool = True) -> InPlace:
        """``kept_fills`` of gaps ``(sample_id, name, prev, next)``, made where the gaps lie: ``sample_id, name, numbers, scores``. A row without
        a name has the number of the word that it brings as ``prev``."""
        index, cut = self.index, similarity_cut(threshold, at_most)
        toks = F.when(F.col("name").isNull(), token_hashes(F.array("prev"))).otherwise(token_hashes(F.array("name", "prev", "next")))
        rows = gaps.select("sample_id", "name", toks.alias("toks"))
        return InPlace(rows, (lambda batches: near_batches(batches, index, cut, score_cut, valid_only),))


def _fields(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def piece_pairs(words: DataFrame) -> DataFrame:
    """Counts of neighbouring pieces ``(p, q, c)`` inside words, weighted by word count; ``p`` is empty at the start."""
    parts = words.select("n", pieces(F.col("tok")).alias("ps")).where(F.size("ps") > 0)
    chain = F.arrays_zip(F.concat(F.array(F.lit("")), "ps").alias("p"), F.col("ps").alias("q"))
    return (
        parts.select("n", F.explode(chain).alias("x"))
        .where(F.col("x.q").isNotNull())
        .groupBy(F.col("x.p").alias("p"), F.col("x.q").alias("q"))
        .agg(F.sum("n").alias("c"))
    )


def piece_options(pairs: DataFrame) -> DataFrame:
    """The most frequent pieces after each piece: ``(p, options, n)``."""
    best = Window.partitionBy("p").orderBy(F.desc("c"), "q")
    top = pairs.withColumn("r", F.row_number().over(best)).where(F.col("r") <= MAX_OPTIONS)
    lists = top.groupBy("p").agg(F.sort_array(F.collect_list(F.struct("r", "q"))).alias("l"), F.sum("c").alias("n"))
    return lists.select("p", F.transform("l", lambda x: x["q"]).alias("options"), "n")


def beam(options: Column) -> Column:
    """Words built from the options of each position, at most 24 prefixes going into a level and out of the last."""
    start = F.transform(F.get(options, F.lit(0)), lambda o: F.array(o))
    return F.aggregate(
        F.slice(options, F.lit(2), F.lit(MAX_POSITIONS - 1)),
        start,
        lambda acc, opts: F.flatten(
            F.transform(F.slice(acc, 1, BEAM), lambda prefix: F.transform(opts, lambda o: F.concat(prefix, F.array(o))))
        ),
        lambda acc: F.slice(acc, 1, BEAM),
    )


def compose_words(names: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates of multi-piece names ``(name, cand_no, cand, nll, score)``.

    Works on distinct names only. A candidate's pieces are looked up by an equi join on (previous piece, piece);
    ``nll`` is the summed add-one smoothed negative log probability in micro-units, and its mean is the
    log-perplexity that orders candidates.
    """
    pairs = stage(piece_pairs(words), "piece-pairs")
    multi = names.select("name").distinct().withColumn("ps", pieces(F.col("name"))).where(F.size("ps") > 1)
    slots = multi.select(
        "name", F.posexplode(F.slice(F.concat(F.array(F.lit("")), "ps"), F.lit(1), F.least(F.size("ps"), F.lit(MAX_POSITIONS)))).alias("slot", "p")
    )
    filled = skew_join(slots, piece_options(pairs), ["p"], "n", ["name"], "inner")
    options = filled.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("slot", "options"))).alias("o"))
    built = options.select(
        "name", F.posexplode(beam(F.transform("o", lambda x: x["options"]))).alias("cand_no", "parts")
    )
    links = F.arrays_zip(F.concat(F.array(F.lit("")), "parts").alias("p"), F.col("parts").alias("q"))
    steps = built.select("name", "cand_no", F.array_join("parts", "").alias("cand"), F.explode(links).alias("x")).where(
        F.col("x.q").isNotNull()
    )
    steps = steps.select("name", "cand_no", "cand", F.col("x.p").alias("p"), F.col("x.q").alias("q"))
    totals = pairs.groupBy("p").agg(F.sum("c").alias("t"), F.sum("c").alias("n"))
    v = pairs.agg(F.countDistinct("q")).scalar()
    known = skew_join(steps, pairs.withColumn("n", F.col("c")), ["p", "q"], "n", ["name", "cand_no"])
    known = skew_join(known, totals, ["p"], "n", ["name", "cand_no"])
    nll = F.round(
        -F.log((F.coalesce("c", F.lit(0)) + 1.0) / (F.coalesce("t", F.lit(0)) + v)) * float(MICRO)
    ).cast("long")
    scored = known.groupBy("name", "cand_no", "cand").agg(F.sum(nll).alias("nll"), F.count("*").alias("n_pieces"))
    return scored.select(
        "name", "cand_no", "cand", "nll", (-F.floor(F.col("nll") / F.col("n_pieces"))).cast("long").alias("score")
    )


GAP = ["name", "prev", "next"]
KEPT = "array<struct<cand:string,score:bigint>>"
KEPT_WEIGHED = "array<struct<cand:string,score:bigint,w:bigint>>"
#: The same, with the words as one text and their lengths in bytes.
FLAT = "toks string, lens array<int>, scores array<int>"


def flat_kept(lists: DataFrame) -> DataFrame:
    """Lists with ``toks, lens, scores`` in place of ``kept``, and ``weights`` if the candidates bring a ``w``."""
    weights = {"weights": F.col("kept.w").cast("array<int>")} if "w" in lists.schema["kept"].dataType.elementType.names else {}
    cands = lists.withColumns({"toks": F.col("kept.cand"), "scores": F.col("kept.score").cast("array<int>")} | weights).drop("kept")
    return flat_words(cands)


def gap_candidates(gaps: DataFrame, fills: Callable[[DataFrame], InPlace]) -> InPlace:
    """Each gap of a sample takes the list of its fills, ``(sample_id, name, numbers, scores)``: made where the gap lies, so that no list is sent.

    The same gap may occur in a large share of all samples; gaps of the same neighbours that are worked on at once are filled once.
    """
    return fills(gaps)


def drop_own_names(lists: InPlace) -> InPlace:
    """P11 on its own, on ``gap_candidates`` of gaps that came with their sample's own names."""
    return lists.then(struck_batches)


def merged_rows(lists: InPlace, model: FillModel) -> DataFrame:
    """C7 as rows ``(sample_id, name, idx, cand, score)``, with ``w_cand`` if the model weighs its words."""
    index, weighed = model.index, model.weigh is not None
    return lists.then(lambda batches: merged_batches(batches, index, weighed, False)).run("idx long, cand string, score long" + ", w_cand long" * weighed)


def merge_candidates(lists: InPlace, model: FillModel) -> DataFrame:
    """``(sample_id, name, cands, scores)``, the distinct candidates of a name over all its occurrences, with their best score, best first,
    equal scores by word.

    ``lists`` are those of ``near_fills``, the rows of a sample together in one task; they are merged there by number.
    """
    index = model.index
    return lists.then(lambda batches: merged_batches(batches, index, False, True)).run("cands array<string>, scores array<bigint>")


def foreign_candidates(lists: DataFrame, own_names: DataFrame) -> DataFrame:
    """C7 + P11: ``(sample_id, name, idx, cand, score)``, the candidates of a name over all its occurrences, best score first, then by word;
    with ``w_cand`` if the lists bring ``weights``.

    One shuffle by sample of the lists as they are; own names ride along as rows without a name and strike out their word. Lists are
    merged in Arrow batches of whole samples, which are bounded by the window times ``top_k``.
    """
    flat = flat_kept(lists) if "kept" in lists.columns else lists
    numbers = [c for c in ("scores", "weights") if c in flat.columns]
    own = own_names.select(
        "sample_id", F.lit(None).cast("string").alias("name"), F.col("name").alias("toks"), F.array(F.octet_length("name")).alias("lens"), *[F.array(F.lit(0)).alias(c) for c in numbers]
    )
    rows = flat.select(*own.columns).unionByName(own).repartition("sample_id").sortWithinPartitions("sample_id", "name")
    kind = lists.schema["sample_id"].dataType.simpleString()
    weight = ", w_cand long" if "weights" in numbers else ""
    return rows.mapInArrow(candidate_batches, f"sample_id {kind}, name string, idx long, cand string, score long{weight}")


def several_pieces(samples: DataFrame, lang: str, block_size: int) -> DataFrame:
    """Samples with ``several``, the valid names of several pieces in their windows; those without one are left out."""
    windows = F.flatten(F.transform("texts", lambda t: F.slice(t, 1, block_size)))
    several = F.filter(F.array_distinct(windows), lambda t: is_valid_name(t, lang) & (F.size(pieces(t)) > 1))
    return samples.withColumn("several", several).where(F.size("several") > 0)


def own_words(samples: DataFrame, lang: str) -> DataFrame:
    """``(sample_id, name)``: all names of the samples."""
    return samples.select("sample_id", F.explode(F.array_distinct(F.flatten("texts"))).alias("name")).where(is_valid_name(F.col("name"), lang))


def search_space(
    lexed: DataFrame,
    own_names: DataFrame | None,
    model: FillModel,
    lang: str,
    block_size: int,
    similarity_threshold: float | None = None,
    at_most: int | None = None,
    score_cut: int = 0,
    compose: bool = True,
) -> DataFrame:
    """``(sample_id, name, idx, cand, score)`` for every valid name in the window that has a substitute.

    The texts of a sample are brought together once. Its gaps are filled there, cut to the better half (or by threshold) and merged per
    name (C7), so no list is sent. Multi-piece names are composed instead. Invalid words (P9) and the sample's own names (P11), all
    valid words of its texts, are removed; the rest is ordered by score, then by word. ``own_names`` may bring them for composed words. A
    model that weighs its words gives every candidate's weight ``w_cand``, looked up once per word.
    """
    samples = stage(sample_texts(lexed), "sample-texts")
    gaps = contexts(samples.select("sample_id", F.explode("texts").alias("tokens")), lang, block_size, own_names=True)
    single = gaps.where(F.col("name").isNull() | (F.size(pieces(F.col("name"))) == 1))
    lists = gap_candidates(single, lambda rows: model.near_fills(rows, similarity_threshold, at_most, score_cut))
    found = merged_rows(drop_own_names(lists), model)
    if compose:
        few = several_pieces(samples, lang, block_size)
        multi = few.select("sample_id", F.explode("several").alias("name"))
        composed = compose_words(multi, model.words).where(is_valid_name(F.col("cand"), lang))
        fields, kind = ["cand", "score"], KEPT
        if model.weigh:
            composed, fields, kind = model.weigh(composed.select("name", "cand", "score"), "cand"), [*fields, "w"], KEPT_WEIGHED
        composed = composed.groupBy("name").agg(F.collect_list(F.struct(*fields)).cast(kind).alias("kept"))
        lists = composed.join(multi.groupBy("name").agg(F.count("*").alias("n")), "name")
        lists = skew_join(multi, lists, ["name"], "n", ["sample_id"], "inner").select("sample_id", "name", "kept")
        found = found.unionByName(foreign_candidates(lists, own_words(few, lang) if own_names is None else own_names))
    return found


def space_map(candidates: DataFrame) -> DataFrame:
    """The search space as one map per sample."""
    per_name = candidates.groupBy("sample_id", "name").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("idx", "cand"))), lambda x: x["cand"]).alias("cands")
    )
    return per_name.groupBy("sample_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "cands")))).alias("search_space")
    )
