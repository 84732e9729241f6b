"""One named query per operator, over whole tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nameshift.functions import lexing, renaming
from nameshift.functions.names import filter_valid_names, identifiers, is_uid, is_valid_name, stripped
from nameshift.functions.reserved import reserved_table
from nameshift.functions.similarity import cosine
from nameshift.operators import candidates as cand_ops
from nameshift.operators import context_fills, dataflow, flow, genetic, importance, search, variants
from nameshift.operators import tokens as token_ops
from nameshift.operators.proposals import proposals
from nameshift.operators.scoring import class_counts, label_prob, margin, prob_of, score_distinct, sigmoid, weigh, with_prediction
from nameshift.plans import metrics
from nameshift.plans.cascade import CascadeAttack
from nameshift.plans.genetic import GeneticAttack, draw_steps, initial_members, make_children, replace_worst
from nameshift.plans.greedy import FoolerAttack, GreedyAttack, MaskGreedyAttack, with_spent
from nameshift.plans.inputs import AttackInputs, gate, outcome_note
from nameshift.plans.mhm import MhmAttack
from nameshift.session import stage
from nameshift.sources.corpus import all_documents, assign_split, binary_label, check_language, harmonise, labelled_documents
from nameshift.sources.results import run_params

LANG = "c"
SMOOTHING = 10.0
SEED = 42
CUT = 3_000_000

_prepared: dict[tuple[str, str], AttackInputs] = {}
_matrix: dict[tuple[str, str], DataFrame] = {}
_joined: dict[tuple[str, str], tuple[context_fills.ContextFillModel, DataFrame]] = {}
_exact: dict[tuple[str, str], context_fills.ContextFillModel] = {}


def prepared(spark: SparkSession, folder: str) -> AttackInputs:
    """Models trained on the tables of ``folder``, once per application."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _prepared:
        _prepared[key] = AttackInputs.prepare(
            labelled_documents(spark, folder), all_documents(spark, folder), LANG, smoothing=SMOOTHING, scorer_later=True
        )
    return _prepared[key]


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return all_documents(spark, folder)


def lexed_documents(spark: SparkSession, folder: str) -> DataFrame:
    return token_ops.with_tokens(documents(spark, folder)).select("sample_id", "tokens")


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    """A sample for each turn; conversation and turn, joined by a colon, are its key."""
    return spark.read.parquet(f"{folder}/conversations.parquet").select(
        F.concat_ws(":", "conv_id", "turn").alias("sample_id"), "conv_id", "turn", F.col("text").alias("code")
    )


def lexed_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return token_ops.with_tokens(conversations(spark, folder)).select("sample_id", "tokens")


def named_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return lexed_conversations(spark, folder).withColumn("names", identifiers(F.col("tokens"), LANG))


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/pages.parquet").select(
        F.col("page_id").alias("sample_id"), F.col("html").alias("code")
    )


def digest(values: Column, sep: str = " ") -> Column:
    """One value that stands for a whole token list."""
    return F.md5(F.array_join(values, sep))


def as_pairs(mapping: Column) -> Column:
    """A map as sorted text; names that keep themselves are left out."""
    entries = F.sort_array(
        F.transform(F.filter(F.map_entries(mapping), lambda e: e["key"] != e["value"]), lambda e: F.concat(e["key"], F.lit(">"), e["value"]))
    )
    return F.array_join(entries, " ")


def size(array: Column | str) -> Column:
    return F.size(array).cast("long")


# Sources and simple columns


def src_test_split(spark, folder):
    return assign_split(labelled_documents(spark, folder), "sample_id").select("sample_id", "split", "label")


def run_parameters(spark, folder):
    samples = labelled_documents(spark, folder)
    params = {"max_iter": 100, "top_k": 60}
    table = run_params(samples, "documents", "linear", "lexical", 510, LANG, "greedy", params, datetime(2024, 1, 1))
    return table.select("test_set", "test_size", "tokenizer", "model", "block_size", "language", "attack", F.map_entries("params").alias("p")).select(
        "test_set", "test_size", "tokenizer", "model", "block_size", "language", "attack",
        F.array_join(F.sort_array(F.transform("p", lambda e: F.concat(e["key"], F.lit("="), e["value"]))), " ").alias("params"),
    )


def reserved_counts(spark, folder):
    rows = token_ops.token_rows(lexed_documents(spark, folder))
    counted = rows.groupBy("tok").agg(F.count("*").alias("c"))
    reserved = reserved_table(spark).withColumnRenamed("word", "tok")
    return (
        counted.join(F.broadcast(reserved), "tok")
        .groupBy("lang", "kind")
        .agg(F.count("*").alias("n_words"), F.sum("c").alias("n_tokens"))
    )


def _raw_corpus(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return docs.join(labels, "doc_id")


def harmonised(spark, folder):
    df = _raw_corpus(spark, folder).select("doc_id", F.col("text").alias("func"), F.col("quality").alias("target"), "lang")
    df = harmonise(df)
    return df.select("doc_id", F.length("code").cast("long").alias("code_len"), F.col("label").cast("long").alias("label"), "lang")


def label_clamp(spark, folder):
    df = _raw_corpus(spark, folder).select("doc_id", (F.col("quality") * 3).alias("label"), (F.col("toxic") == 1).alias("toxic"))
    return binary_label(binary_label(df), "toxic")


def lang_check(spark, folder):
    spoken = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    option = F.when(F.col("lang") == "en", "C").when(F.col("lang") == "fr", "Java").when(F.col("lang") == "de", "PYTHON").otherwise("Ruby")
    return check_language(spoken.withColumn("lang", option)).groupBy("lang", "lang_ok").agg(F.count("*").alias("n"))


def attack_gate(spark, folder):
    return gate(prepared(spark, folder).predictions).select("sample_id", "label", "predict_label")


def outcome_notes(spark, folder):
    inputs = prepared(spark, folder)
    rows = inputs.predictions.join(inputs.name_counts(), "sample_id", "left").join(inputs.space_counts(), "sample_id", "left")
    zero = F.lit(0).cast("long")
    note = outcome_note(F.col("predict_label") != F.col("label"), F.coalesce("n_names", zero), F.coalesce("n_subst", zero))
    return rows.select("sample_id", F.coalesce(note, F.lit("")).alias("note"))


def _spoken_words(spark, folder):
    """Distinct blank-separated words per programming language that stands for the spoken one."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    lang = F.when(F.col("lang") == "en", "c").when(F.col("lang") == "fr", "java").when(F.col("lang") == "de", "python").otherwise("javascript")
    return docs.select(lang.alias("lang"), F.explode(F.split("text", "[ \n]")).alias("name")).distinct()


def valid_names(spark, folder):
    return filter_valid_names(_spoken_words(spark, folder)).select("lang", "name")


def valid_candidates(spark, folder):
    words = _spoken_words(spark, folder).select(F.concat(F.lit(" "), "name").alias("cand")).distinct()
    return words.select(stripped(F.col("cand")).alias("cand")).where(is_valid_name(F.col("cand"), "java")).distinct()


def uid_filter(spark, folder):
    words = _spoken_words(spark, folder).select("name").distinct()
    return words.select("name", is_uid(F.col("name")).alias("strict"), is_uid(F.col("name"), compat=True).alias("compat")).where("strict or compat")


# Text


def strip_comments_c(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    code = F.concat("text", F.lit(" // "), "source", F.lit("\n/* "), "lang", F.lit('\n*/ "http://a/'), "lang", F.lit('" a/**/b')).alias("code")
    clean = lexing.strip_comments(F.col("code"), "c")
    return docs.select("doc_id", code).select("doc_id", F.length(clean).cast("long").alias("n_chars"), F.md5(clean).alias("digest"))


def strip_comments_py(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    code = F.concat(
        F.lit('"""'), "source", F.lit('\n"""\n'), "text", F.lit(" # "), "lang", F.lit("\ns = \"a # b\"\n  'doc "), "lang", F.lit("'\n\nx = '''y'''")
    ).alias("code")
    clean = lexing.strip_comments(F.col("code"), "python")
    return docs.select("doc_id", code).select("doc_id", F.length(clean).cast("long").alias("n_chars"), F.md5(clean).alias("digest"))


def drop_blank_lines(spark, folder):
    clean = lexing.drop_blank_lines(F.col("code"))
    return documents(spark, folder).select(
        F.col("sample_id").alias("doc_id"), size(F.split(clean, "\n")).alias("n_lines"), F.md5(clean).alias("digest")
    )


def unescape_newlines(spark, folder):
    written = F.concat(F.replace("code", F.lit("\n"), F.lit("\\n")), F.lit("\\n"), F.col("code")).alias("code")
    back = lexing.unescape_newlines(F.col("code"))
    return documents(spark, folder).select("sample_id", written).select(
        F.col("sample_id").alias("doc_id"), F.length(back).cast("long").alias("n_chars"), F.md5(back).alias("digest")
    )


def line_tokens(spark, folder):
    lines = conversations(spark, folder).select("sample_id", lexing.line_tokens(F.col("code")).alias("lines"))
    return lines.select("sample_id", size("lines").alias("n_lines"), digest(F.col("lines"), "|").alias("digest"))


def tokens(spark, folder):
    return lexed_documents(spark, folder).select("sample_id", size("tokens").alias("n_tokens"), digest(F.col("tokens")).alias("digest"))


def tokens_python(spark, folder):
    """T2 + T6 by the rules of Python, on documents dressed up with a docstring, a ``//`` and ``#`` comments."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    code = F.concat(F.lit('"""'), "source", F.lit("\ntext\n\"\"\"\nx = total // "), "lang", F.lit("  # ratio of "), "lang", F.lit("\n"), "text", F.lit("\ny **= 2 # end"))
    lexed = token_ops.with_tokens(docs.select(F.col("doc_id").alias("sample_id"), code.alias("code")), lang="python")
    return lexed.select("sample_id", size("tokens").alias("n_tokens"), digest(F.col("tokens")).alias("digest"))


def span_text(spark, folder):
    last = F.size(F.split("code", "\n")) - 1
    text = lexing.span_text(F.col("code"), F.lit(0), F.lit(3), F.least(F.lit(2), F.col("last")), F.lit(7))
    return documents(spark, folder).withColumn("last", last).select("sample_id", text.alias("span"))


def subword_offsets(spark, folder):
    rows = token_ops.subword_offsets(documents(spark, folder))
    return rows.groupBy("sample_id").agg(
        F.count("*").alias("n_words"),
        F.max("end").alias("n_pieces"),
        F.sum(F.col("start") * (F.col("pos") + 1)).alias("start_sum"),
        F.sum(F.col("end") * (F.col("pos") + 1)).alias("end_sum"),
    )


def in_window(spark, folder):
    rows = token_ops.in_window(token_ops.subword_offsets(documents(spark, folder)), 510)
    return rows.groupBy("sample_id").agg(F.count("*").alias("n_words"), F.max("start").alias("last_start"))


def truncate(spark, folder):
    kept = lexed_documents(spark, folder).select("sample_id", lexing.truncate(F.col("tokens"), 510).alias("kept"))
    return kept.select("sample_id", size("kept").alias("n_kept"), digest(F.col("kept")).alias("digest"))


def _first_names(spark, folder):
    """Documents with their first two names; a document without a second name swaps with a fixed word."""
    lexed = token_ops.with_tokens(documents(spark, folder)).withColumn("names", identifiers(F.col("tokens"), LANG))
    return lexed.select(
        "sample_id",
        "code",
        "tokens",
        F.coalesce(F.get("names", F.lit(0)), F.lit("nothing")).alias("a"),
        F.coalesce(F.get("names", F.lit(1)), F.lit("other")).alias("b"),
    )


def rename_one(spark, folder):
    renamed = renaming.rename_one(F.col("tokens"), F.col("a"), F.lit("renamed"))
    return _first_names(spark, folder).select("sample_id", "a", digest(renamed).alias("digest"))


def rename_many(spark, folder):
    swap = F.create_map(F.col("a"), F.col("b"), F.col("b"), F.col("a")).alias("swap")
    df = _first_names(spark, folder).select("sample_id", "code", "tokens", swap)
    return df.select(
        "sample_id",
        digest(renaming.rename_many(F.col("tokens"), F.col("swap"))).alias("digest"),
        F.md5(renaming.rename_text(F.col("code"), F.col("swap"))).alias("text_digest"),
    )


def first_seen_distinct(spark, folder):
    seen = lexed_documents(spark, folder).select("sample_id", lexing.first_seen_distinct(F.col("tokens")).alias("seen"))
    return seen.select("sample_id", size("seen").alias("n_distinct"), digest(F.col("seen")).alias("digest"))


def identifier_lists(spark, folder):
    df = lexed_documents(spark, folder).select(
        "sample_id",
        identifiers(F.col("tokens"), LANG, "all").alias("all"),
        identifiers(F.col("tokens"), LANG, "declared").alias("declared"),
    )
    return df.select(
        "sample_id",
        size("all").alias("n_all"),
        digest(F.col("all")).alias("all_digest"),
        size("declared").alias("n_declared"),
        digest(F.col("declared")).alias("declared_digest"),
    )


def changed_positions(spark, folder):
    return _first_names(spark, folder).select(
        "sample_id",
        "a",
        lexing.count_substring(F.col("code"), F.col("a")).alias("n_substring"),
        lexing.count_token(F.col("tokens"), F.col("a")).alias("n_token"),
    )


def _edge_rows(edges):
    return edges.select(
        "sample_id", "name", F.col("pos").cast("long").alias("pos"), "rel",
        F.array_join("src_names", " ").alias("src_names"), F.array_join(F.transform("src_pos", lambda p: p.cast("string")), " ").alias("src_pos"),
    )


def def_use_edges(spark, folder):
    return _edge_rows(dataflow.def_use_edges(dataflow.statement_rows(pages(spark, folder), LANG)))


def merge_edges(spark, folder):
    return _edge_rows(dataflow.merge_edges(dataflow.def_use_edges(dataflow.statement_rows(pages(spark, folder), LANG))))


def flow_edges(spark, folder):
    return _edge_rows(flow.flow_edges(pages(spark, folder), LANG))


def merge_defs(spark, folder):
    rows = dataflow.statement_rows(pages(spark, folder), LANG)
    arms = dataflow.definitions(rows.where("stmt = 0")), dataflow.definitions(rows.where("stmt > 0"))
    merged = dataflow.merge_definitions(*arms)
    return merged.select("sample_id", "name", F.array_join(F.transform("def_pos", lambda p: p.cast("string")), " ").alias("def_pos"))


# Position indexes


def _names_of(lexed):
    return lexed.select("sample_id", F.explode(identifiers(F.col("tokens"), LANG)).alias("name"))


def positions(spark, folder):
    lexed = lexed_documents(spark, folder)
    rows = token_ops.positions(token_ops.token_rows(lexed), _names_of(lexed))
    return rows.groupBy("sample_id").agg(
        F.count("*").alias("n_positions"), F.countDistinct("name").alias("n_names"), F.sum("pos").alias("pos_sum")
    )


def uid_positions(spark, folder):
    lexed = lexed_documents(spark, folder)
    name_map = F.map_from_entries(F.transform("names", lambda n: F.struct(n, n)))
    space = lexed.select("sample_id", identifiers(F.col("tokens"), LANG).alias("names")).select("sample_id", name_map.alias("name_map"))
    rows = token_ops.uid_positions(token_ops.token_rows(lexed), space)
    return rows.groupBy("sample_id").agg(
        F.count("*").alias("n_positions"), F.countDistinct("name").alias("n_names"), F.sum("pos").alias("pos_sum")
    )


def space_in_text(spark, folder):
    """Names of a turn that the turn before it in the same conversation contains."""
    lexed = token_ops.with_tokens(conversations(spark, folder))
    names = lexed.select("conv_id", "turn", F.explode(identifiers(F.col("tokens"), LANG)).alias("name"))
    next_turn = names.select(F.concat_ws(":", "conv_id", F.col("turn") - 1).alias("sample_id"), "name")
    kept = token_ops.space_in_text(next_turn, token_ops.token_rows(lexed))
    return kept.groupBy("sample_id").agg(F.count("*").alias("n_names"), F.md5(F.array_join(F.sort_array(F.collect_list("name")), " ")).alias("digest"))


# Variants


def variants_unk(spark, folder):
    rows = variants.mask_each(variants.occurrences(named_conversations(spark, folder)))
    return rows.select("sample_id", F.col("pos").cast("long").alias("pos"), "name", digest(F.col("variant")).alias("digest"))


def variants_mask(spark, folder):
    rows = variants.mask_each(variants.occurrences(named_conversations(spark, folder)), variants.MASK)
    return rows.select("sample_id", F.col("pos").cast("long").alias("pos"), "name", digest(F.col("variant")).alias("digest"))


def variants_delete(spark, folder):
    rows = variants.delete_each(variants.occurrences(named_conversations(spark, folder)))
    return rows.select("sample_id", F.col("pos").cast("long").alias("pos"), "name", digest(F.col("variant")).alias("digest"))


def variants_unk_all(spark, folder):
    rows = variants.mask_all(named_conversations(spark, folder))
    return rows.select("sample_id", "name", digest(F.col("variant")).alias("digest"))


def variants_rename(spark, folder):
    lexed = lexed_conversations(spark, folder)
    two = F.explode(F.array(F.concat(F.lit("v_"), "name"), F.concat("name", F.lit("_2")))).alias("cand")
    rows = variants.rename_each(lexed, _names_of(lexed).select("sample_id", "name", two))
    return rows.select("sample_id", "name", "cand", digest(F.col("variant")).alias("digest"))


# Scoring


def predict(spark, folder):
    p = prepared(spark, folder).predictions
    return p.select("sample_id", "label", "predict_label", F.round("predict_probability", 6).alias("predict_probability"))


def label_probability(spark, folder):
    """Through the general form: logits, element-wise sigmoid, probability of the true label."""
    inputs = prepared(spark, folder)
    scored = with_prediction(inputs.scorer.score(inputs.lexed))
    return scored.select("sample_id", "label", F.round(label_prob(F.col("probs"), F.col("label")), 6).alias("label_prob"), "pred_label")


def train_weights(spark, folder):
    lexed = token_ops.with_tokens(labelled_documents(spark, folder))
    return weigh(class_counts(lexed), SMOOTHING).select("tok", "w", "n")


def score_variants(spark, folder):
    items = spark.read.parquet(f"{folder}/benchmark.parquet").select(F.col("item_id").alias("sample_id"), F.col("text").alias("code"))
    lexed = token_ops.with_tokens(items).select("sample_id", "tokens").withColumn("names", identifiers(F.col("tokens"), LANG))
    rows = variants.mask_each(variants.occurrences(lexed)).withColumnRenamed("variant", "tokens")
    scored = score_distinct(rows, prepared(spark, folder).scorer)
    return scored.select("sample_id", F.col("pos").cast("long").alias("pos"), "name", F.round(F.get("probs", F.lit(1)), 6).alias("prob"), "pred_label")


# Candidates


def _conversation_gaps(spark, folder):
    gaps = cand_ops.contexts(lexed_conversations(spark, folder), LANG, 510)
    return gaps, gaps.groupBy("name", "prev", "next").agg(F.count("*").alias("n"))


def fill_topk(spark, folder):
    _, distinct = _conversation_gaps(spark, folder)
    fills = prepared(spark, folder).fills.fills(distinct)
    return fills.select("name", "prev", "next", "n", size("fills").alias("n_fills"), digest(F.col("fills.tok")).alias("digest"))


def fill_score_cut(spark, folder):
    _, distinct = _conversation_gaps(spark, folder)
    similar = prepared(spark, folder).fills.similar_fills(distinct)
    cut = similar.select("name", "prev", "next", cand_ops.cut_scores(cand_ops.keep_half(F.col("similar")), CUT).alias("cut"))
    return cut.select("name", "prev", "next", size("cut").alias("n_kept"), digest(F.col("cut.cand")).alias("digest"))


def _conversation_lists(spark, folder, own_names=False):
    """The better half of the fills of every gap of a turn."""
    model = prepared(spark, folder).fills
    gaps = cand_ops.contexts(cand_ops.whole_samples(lexed_conversations(spark, folder)), LANG, 510, own_names)
    return model, cand_ops.gap_candidates(gaps, lambda rows: model.near_fills(rows, valid_only=False))


def candidate_union(spark, folder):
    model, lists = _conversation_lists(spark, folder)
    union = cand_ops.merge_candidates(lists, model)
    return union.select("sample_id", "name", size("cands").alias("n_cands"), digest(F.col("cands")).alias("digest"))


def candidate_not_own(spark, folder):
    model, lists = _conversation_lists(spark, folder, own_names=True)
    foreign = cand_ops.merge_candidates(cand_ops.drop_own_names(lists), model)
    return foreign.select("sample_id", "name", size("cands").alias("n_cands"))


def _vector_pairs(spark, folder):
    """Vectors in runs of ten: the first of a run is the original, the others are its substitutes."""
    vecs = spark.read.parquet(f"{folder}/embeddings.parquet").select(
        "vec_id", "embedding", F.floor(F.col("vec_id") / 10).cast("long").alias("occurrence")
    )
    first = vecs.groupBy("occurrence").agg(F.min_by("embedding", "vec_id").alias("original"), F.min("vec_id").alias("first_id"))
    return vecs.join(first, "occurrence").where(F.col("vec_id") > F.col("first_id")).select(
        "occurrence", "vec_id", F.round(cosine(F.col("original"), F.col("embedding")), 6).alias("sim")
    )


def cosine_pairs(spark, folder):
    return _vector_pairs(spark, folder).groupBy("occurrence").agg(F.count("*").alias("n"), F.round(F.avg("sim"), 6).alias("mean_sim"))


def similar_top_half(spark, folder):
    kept = cand_ops.top_half(_vector_pairs(spark, folder), ["occurrence"], "sim", "vec_id")
    return kept.select("occurrence", "vec_id", F.col("r").cast("long").alias("r"), "sim")


def similar_threshold_topn(spark, folder):
    kept = cand_ops.threshold_top_n(_vector_pairs(spark, folder), ["occurrence"], "sim", "vec_id", 0.0, 3)
    return kept.select("occurrence", "vec_id", F.col("r").cast("long").alias("r"), "sim")


def compose_beam(spark, folder):
    model = prepared(spark, folder).fills
    names = model.words.where(is_valid_name(F.col("tok"), LANG)).select(F.col("tok").alias("name"))
    rows = cand_ops.compose_words(names, model.words)
    listed = rows.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("nll", "cand_no", "cand"))).alias("l"))
    return listed.select("name", size("l").alias("n_cands"), digest(F.col("l.cand")).alias("digest"), F.get("l.nll", F.lit(0)).alias("best_nll"))


def search_space(spark, folder):
    space = prepared(spark, folder).space()
    listed = space.groupBy("sample_id", "name").agg(F.sort_array(F.collect_list(F.struct("idx", "cand"))).alias("l"))
    return listed.select("sample_id", "name", size("l").alias("n_cands"), digest(F.col("l.cand")).alias("digest"))


# Candidates in context


def _joined_gaps(spark, folder):
    """Documents whose neighbouring small words are joined in pairs, as names are in programs; a fill model of them, and the gaps of all names."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _joined:
        code = F.regexp_replace("code", r"(\p{Ll}+) (\p{Ll}+)", "$1_$2")
        lexed = stage(token_ops.with_tokens(documents(spark, folder).withColumn("code", code)).select("sample_id", "tokens"), "joined-words")
        gaps = stage(cand_ops.contexts(lexed, LANG, 510).select(*cand_ops.GAP).distinct(), "joined-gaps")
        _joined[key] = context_fills.ContextFillModel.train(lexed, lang=LANG), gaps
    return _joined[key]


def _compose(threshold=None, at_most=None):
    def query(spark, folder):
        model, gaps = _joined_gaps(spark, folder)
        rows = context_fills.compose_words(gaps, model, threshold, at_most)
        listed = rows.groupBy(*cand_ops.GAP).agg(F.sort_array(F.collect_list(F.struct("nll", "cand_no", "cand"))).alias("l"))
        return listed.select(*cand_ops.GAP, size("l").alias("n_cands"), digest(F.col("l.cand")).alias("digest"), F.get("l.nll", F.lit(0)).alias("best_nll"))

    return query


def _exact_space(top_k=None, **limits):
    """C8 by exact similarity and with names composed in context; a list per name."""

    def query(spark, folder):
        inputs = prepared(spark, folder)
        key = (spark.sparkContext.applicationId, folder)
        if key not in _exact:
            _exact[key] = context_fills.ContextFillModel.train(lexed_documents(spark, folder), lang=LANG)
        model = _exact[key] if top_k is None else _exact[key].resized(top_k)
        own = inputs.names.select("sample_id", "name")
        lists = context_fills.search_lists(inputs.attackable, own, model, LANG, inputs.block, **limits)
        return lists.select("sample_id", "name", size("cands").alias("n_cands"), digest(F.col("cands.cand")).alias("digest"))

    return query


# Importance


def _importance(kind):
    def query(spark, folder):
        rows = prepared(spark, folder).occurrence_scores(kind)
        return rows.groupBy("sample_id", "name").agg(
            F.count("*").alias("n_occ"), F.round(F.max("score"), 6).alias("max_score"), F.round(F.min("score"), 6).alias("min_score")
        )

    return query


def importance_by_name(spark, folder):
    names = importance.importance_by_name(prepared(spark, folder).occurrence_scores("unk"))
    return names.select("sample_id", "name", "importance")


def importance_compat(spark, folder):
    shifted = importance.shift_scores(prepared(spark, folder).occurrence_scores("unk"), ["first_pos", "pos"])
    return importance.importance_by_name(shifted).select("sample_id", "name", "importance")


def importance_rank(spark, folder):
    names = importance.rank_names(importance.importance_by_name(prepared(spark, folder).occurrence_scores("unk")))
    return names.select("sample_id", "name", "rank")


def query_count(spark, folder):
    return importance.query_count(prepared(spark, folder).occurrence_scores("unk"))


def importance_threshold(spark, folder):
    names = importance.importance_by_name(prepared(spark, folder).occurrence_scores("delete"))
    kept = importance.importance_threshold(names, 0.001)
    return kept.select("sample_id", "name", "importance")


# Search


def _ranked(spark, folder):
    inputs = prepared(spark, folder)
    return with_spent(inputs.search_rows(inputs.space(), "unk"))


def best_candidate(spark, folder):
    rows = search.best_candidate(_ranked(spark, folder)).where("idx = 1")
    return rows.select("sample_id", "name", "rank", F.coalesce("best.cand", "name").alias("best"), F.coalesce("best.delta", F.lit(0)).alias("delta"))


def first_flip(spark, folder):
    rows = search.first_flip(search.best_candidate(_ranked(spark, folder))).where("flip is not null")
    return rows.select("sample_id", "flip.rank", "flip.idx", "flip.name", "flip.cand").distinct()


def budget(spark, folder):
    rows = search.apply_budget(_ranked(spark, folder), 1000).where("idx = 1")
    return rows.select("sample_id", "name", "rank", "used", "evaluated")


def attack_columns(results: DataFrame) -> DataFrame:
    """Result rows in a form every engine can compare."""
    return results.select(
        "sample_id",
        "attack",
        "label",
        "predict_label",
        F.round("predict_probability", 6).alias("predict_probability"),
        "is_attack",
        "is_success",
        "query_time",
        F.coalesce("note", F.lit("")).alias("note"),
        F.coalesce(as_pairs(F.col("replaced_words")), F.lit("")).alias("replaced"),
        F.coalesce("adv_label", F.lit(-1).cast("long")).alias("adv_label"),
        F.coalesce(F.md5("adv_code"), F.lit("")).alias("adv_digest"),
    )


def _attack(attack):
    def query(spark, folder):
        return attack_columns(attack.run(prepared(spark, folder)))

    return query


# Genetic


def _genetic_rows(spark, folder):
    inputs = prepared(spark, folder)
    rows = inputs.search_rows(inputs.space(), None)
    return inputs, rows, initial_members(inputs, rows, 100)


def ga_init(spark, folder):
    _, _, init = _genetic_rows(spark, folder)
    gene = F.get(F.map_values("genes"), F.lit(0))
    return init.select("sample_id", "member", F.coalesce(gene["cand"], F.lit("")).alias("cand"), "change", "queries")


def ga_fitness(spark, folder):
    _, _, init = _genetic_rows(spark, folder)
    before = sigmoid(margin(F.col("margin"), F.col("n")))
    return init.select("sample_id", "member", F.round(before - F.col("prob"), 6).alias("fitness"))


def _genetic_state(init):
    return init.groupBy("sample_id", "label", "margin", "n").agg(F.count("*").alias("n_names"))


def ga_parents(spark, folder):
    _, _, init = _genetic_rows(spark, folder)
    steps = _genetic_state(init).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(5))))
    i1, i2 = genetic.parents(F.col("sample_id"), F.col("step"), F.col("n_names") + 1, SEED)
    return steps.select("sample_id", F.col("step").cast("long").alias("step"), i1.alias("parent1"), i2.alias("parent2"))


def _population(init):
    base = init.select("sample_id").distinct().select(
        "sample_id", F.lit(0).cast("long").alias("member"), genetic.identity().alias("genes"), F.lit(0).cast("long").alias("change")
    )
    return base.unionByName(init.select("sample_id", "member", "genes", "change"))


def _first_children(spark, folder, cross_probability):
    inputs, rows, init = _genetic_rows(spark, folder)
    members = _population(init)
    state = _genetic_state(init)
    draws = draw_steps(state, search.with_counts(rows), 1, cross_probability, SEED)
    return members, inputs.evaluate(make_children(state, members, draws))


def _genes(children):
    return children.select("sample_id", as_pairs(genetic.mapping(F.col("genes"))).alias("child"), "change")


def ga_crossover(spark, folder):
    """First generation with crossover always on."""
    return _genes(_first_children(spark, folder, 1.0)[1])


def ga_mutate(spark, folder):
    """First generation with mutation always on."""
    return _genes(_first_children(spark, folder, 0.0)[1])


def ga_replace(spark, folder):
    members, children = _first_children(spark, folder, 0.7)
    after = replace_worst(members, children.where(~F.col("flipped")))
    return after.groupBy("sample_id").agg(F.count("*").alias("n_members"), F.sum("change").alias("change_sum"), F.min("change").alias("best"))


# Proposals


def mhm_proposals(spark, folder):
    inputs = prepared(spark, folder)
    rows = proposals(inputs.search_rows(inputs.space(), None), 100, 30, SEED)
    return rows.select("sample_id", F.col("iteration").cast("long").alias("iteration"), "name", size("proposed").alias("n_proposed"), digest(F.col("proposed.cand")).alias("digest"))


def mhm_choice(spark, folder):
    rows = MhmAttack().iterations(prepared(spark, folder))
    return rows.select(
        "sample_id", F.col("iteration").cast("long").alias("iteration"), F.col("flip_pos").cast("long").alias("flip_pos"), "best_cand",
        F.round("min_prob", 6).alias("min_prob"), F.col("queries").cast("long").alias("queries"),
    )


def mhm_accept(spark, folder):
    rows = MhmAttack(prob_threshold=1.0).iterations(prepared(spark, folder))
    return rows.select("sample_id", F.col("iteration").cast("long").alias("iteration"), F.round("alpha", 6).alias("alpha"), "status")


# Metrics


def accuracy_by_source(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(F.col("doc_id").alias("sample_id"), "source")
    return metrics.accuracy(prepared(spark, folder).predictions.join(docs, "sample_id"), ["source"])


def _all_results(spark, folder):
    """All strategies on the tables of ``folder``, run once per application."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _matrix:
        _matrix[key] = stage(metrics.run_attacks(prepared(spark, folder), metrics.all_attacks()), "attack-matrix")
    return _matrix[key]


def robustness(spark, folder):
    return metrics.robustness(_all_results(spark, folder), ["attack", "model"])


def robustness_table(spark, folder):
    return metrics.robustness_table(_all_results(spark, folder))


def query_cost(spark, folder):
    return metrics.query_cost(_all_results(spark, folder), ["attack"])


def attack_matrix(spark, folder):
    return attack_columns(_all_results(spark, folder))


QUERIES = {
    "src_test_split": src_test_split,
    "run_params": run_parameters,
    "reserved_counts": reserved_counts,
    "harmonise": harmonised,
    "label_clamp": label_clamp,
    "lang_check": lang_check,
    "attack_gate": attack_gate,
    "outcome_notes": outcome_notes,
    "valid_names": valid_names,
    "valid_candidates": valid_candidates,
    "uid_filter": uid_filter,
    "candidate_not_own": candidate_not_own,
    "importance_threshold": importance_threshold,
    "fill_score_cut": fill_score_cut,
    "in_window": in_window,
    "positions": positions,
    "uid_positions": uid_positions,
    "space_in_text": space_in_text,
    "strip_comments_c": strip_comments_c,
    "strip_comments_py": strip_comments_py,
    "drop_blank_lines": drop_blank_lines,
    "unescape_newlines": unescape_newlines,
    "line_tokens": line_tokens,
    "tokens": tokens,
    "tokens_python": tokens_python,
    "span_text": span_text,
    "subword_offsets": subword_offsets,
    "truncate": truncate,
    "rename_one": rename_one,
    "rename_many": rename_many,
    "first_seen_distinct": first_seen_distinct,
    "identifiers": identifier_lists,
    "def_use_edges": def_use_edges,
    "merge_edges": merge_edges,
    "merge_defs": merge_defs,
    "flow_edges": flow_edges,
    "changed_positions": changed_positions,
    "variants_unk": variants_unk,
    "variants_unk_all": variants_unk_all,
    "variants_delete": variants_delete,
    "variants_mask": variants_mask,
    "variants_rename": variants_rename,
    "predict": predict,
    "label_prob": label_probability,
    "train_weights": train_weights,
    "score_variants": score_variants,
    "fill_topk": fill_topk,
    "cosine_pairs": cosine_pairs,
    "similar_top_half": similar_top_half,
    "similar_threshold_topn": similar_threshold_topn,
    "compose_beam": compose_beam,
    "compose_context": _compose(),
    "compose_context_threshold": _compose(0.2, 6),
    "search_space_exact": _exact_space(),
    "search_space_exact_near": _exact_space(150, similarity_threshold=0.7, at_most=50),
    "candidate_union": candidate_union,
    "search_space": search_space,
    "importance_unk": _importance("unk"),
    "importance_delete": _importance("delete"),
    "importance_mask": _importance("mask"),
    "importance_by_name": importance_by_name,
    "importance_compat": importance_compat,
    "importance_rank": importance_rank,
    "query_count": query_count,
    "best_candidate": best_candidate,
    "first_flip": first_flip,
    "budget": budget,
    "attack_greedy": _attack(GreedyAttack()),
    "attack_fooler": _attack(FoolerAttack()),
    "attack_mask_greedy": _attack(MaskGreedyAttack()),
    "ga_init": ga_init,
    "ga_fitness": ga_fitness,
    "ga_parents": ga_parents,
    "ga_crossover": ga_crossover,
    "ga_mutate": ga_mutate,
    "ga_replace": ga_replace,
    "attack_ga": _attack(GeneticAttack()),
    "attack_cascade": _attack(CascadeAttack()),
    "mhm_proposals": mhm_proposals,
    "mhm_choice": mhm_choice,
    "mhm_accept": mhm_accept,
    "attack_mhm": _attack(MhmAttack()),
    "accuracy": accuracy_by_source,
    "robustness": robustness,
    "robustness_table": robustness_table,
    "query_cost": query_cost,
    "attack_matrix": attack_matrix,
}
