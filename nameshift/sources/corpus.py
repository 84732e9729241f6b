"""Labelled corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nameshift.functions.draws import uniform
from nameshift.functions.reserved import LANGUAGES

ALIASES = {"func": "code", "target": "label"}


def load_corpus(spark: SparkSession, path: str, fmt: str = "parquet", split: str | None = None, **options) -> DataFrame:
    """Read a corpus; ``split`` selects rows of its ``split`` column, which may be a partition folder."""
    df = spark.read.format(fmt).options(**options).load(path)
    return df.where(F.col("split") == split) if split is not None else df


def assign_split(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """S1 for a corpus without splits: every row gets ``split`` from a hash of its key."""
    test = uniform(seed, F.col(key), "split") < test_share
    return df.withColumn("split", F.when(test, F.lit("test")).otherwise(F.lit("train")))


def harmonise(df: DataFrame) -> DataFrame:
    """Known other names of the two main columns."""
    return df.withColumnsRenamed({old: new for old, new in ALIASES.items() if old in df.columns})


def binary_label(df: DataFrame, label: str = "label") -> DataFrame:
    """P2 + P3: a long label, at most 1."""
    return df.withColumn(label, F.least(F.col(label).cast("long"), F.lit(1).cast("long")))


def check_language(df: DataFrame, lang: str = "lang") -> DataFrame:
    """Lower-cased language and whether it is an accepted option."""
    lowered = F.lower(F.col(lang))
    return df.withColumn(lang, lowered).withColumn("lang_ok", lowered.isin(*LANGUAGES))


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The test tables as a corpus: text is the code, quality is the label."""
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    joined = documents.join(labels, "doc_id").select(
        F.col("doc_id").alias("sample_id"), F.col("text").alias("func"), F.col("quality").alias("target")
    )
    return binary_label(harmonise(joined))


def all_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every text of the test tables, for models that need no label."""
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    return documents.select(F.col("doc_id").alias("sample_id"), F.col("text").alias("code"))
