"""Result and parameter tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARAMS_SCHEMA = "test_set string, test_size long, tokenizer string, model string, block_size long, start_time string, run_time_seconds double, language string, attack string, params map<string,string>"


def run_params(
    samples: DataFrame,
    test_set: str,
    model: str,
    tokenizer: str,
    block_size: int,
    language: str,
    attack: str,
    params: dict[str, object],
    start_time: datetime | None = None,
    run_time_seconds: float | None = None,
) -> DataFrame:
    """One row that describes a run; ``run_time_seconds`` is the wall time of its job."""
    entries = [x for key, value in params.items() for x in (F.lit(key), F.lit(str(value)))]
    return samples.agg(F.count("*").alias("test_size")).select(
        F.lit(test_set).alias("test_set"),
        "test_size",
        F.lit(tokenizer).alias("tokenizer"),
        F.lit(model).alias("model"),
        F.lit(block_size).cast("long").alias("block_size"),
        F.lit((start_time or datetime.now()).isoformat()).alias("start_time"),
        F.lit(run_time_seconds).cast("double").alias("run_time_seconds"),
        F.lit(language).alias("language"),
        F.lit(attack).alias("attack"),
        (F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")).alias("params"),
    )


def write_results(results: DataFrame, params: DataFrame, folder: str, run_id: str | None = None, fmt: str = "json") -> str:
    """Results partitioned by (attack, model) and the parameter rows, under a folder per run.

    Every task writes its own rows, and a run never overwrites another one. The parameters come last, and their mark of
    success is the run's: without it nothing is read. A run that fails is removed.
    """
    run_id = run_id or datetime.now().strftime("%Y%m%d_%H%M%S")
    path = f"{folder.rstrip('/')}/run={run_id}"
    files, where = _files(results.sparkSession, path)
    if files.exists(where):
        raise ValueError(f"{path} exists")
    try:
        results.write.format(fmt).partitionBy("attack", "model").save(f"{path}/results")
        params.write.format(fmt).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").save(f"{path}/params")
    except Exception:
        files.delete(where, True)
        raise
    return path


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _complete(spark: SparkSession, path: str) -> None:
    files, mark = _files(spark, f"{path}/params/_SUCCESS")
    if not files.exists(mark):
        raise ValueError(f"{path} is not a complete run")


def read_results(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Results of one complete run, with the shared schema."""
    from nameshift.plans.results import RESULT_SCHEMA

    _complete(spark, path)
    return spark.read.schema(RESULT_SCHEMA).format(fmt).load(f"{path}/results").select(*RESULT_SCHEMA.fieldNames())


def read_params(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """The parameter rows of one complete run."""
    _complete(spark, path)
    return spark.read.schema(PARAMS_SCHEMA).format(fmt).load(f"{path}/params")
