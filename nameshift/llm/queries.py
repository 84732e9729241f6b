"""One query for each operator, over whole tables, and their SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nameshift.llm import bpe_codec, conversation_repair, decontamination, fertility, html_text, id_files, near_duplicates, periodic_runs, personal_data, quality_cotraining, token_counts, warc, word_scoring


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op2_bpe_codec(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_codec.round_trip(table(spark, folder, "documents")).drop("ids")


def op3_fertility_rules(spark: SparkSession, folder: str) -> DataFrame:
    return fertility.quality_rules(table(spark, folder, "documents"))


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"))


def op5_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, folder, "documents"))


def op6_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.main_text(table(spark, folder, "pages"))


def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_cotraining.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_id_files(spark: SparkSession, folder: str) -> DataFrame:
    files = id_files.write_ids(table(spark, folder, "documents"))
    return id_files.read_digests(spark, files)


def op9_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return word_scoring.scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = warc.write_archives(table(spark, folder, "pages"))
    found = warc.records(warc.read_archives(archives.files, payloads=False))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.periodic_runs(table(spark, folder, "documents"), plant=True).drop("runs")


def op12_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data.personal_data(table(spark, folder, "documents"))


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_repair.repair_report(conversation_repair.damaged(table(spark, folder, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_bpe_codec": op2_bpe_codec,
    "op3_fertility_rules": op3_fertility_rules,
    "op4_token_counts": op4_token_counts,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_html_text": op6_html_text,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_id_files": op8_id_files,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_warc": op10_warc,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_personal_data": op12_personal_data,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLES: dict[str, str] = {
    "op1_decontamination": decontamination.ORACLE,
    "op5_near_duplicates": near_duplicates.ORACLE,
    "op10_warc": warc.ORACLE,
    "op13_conversation_repair": conversation_repair.ORACLE,
}
