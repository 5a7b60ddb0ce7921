"""The jobs as queries: each job runs twice into one new folder of spark.checkpoint.dir, and what is there then is the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import refresh_index, tagger_corpus
from lodestone.plans.oracles import job_sql
from lodestone.session import new_folder, ready


def job1_refresh_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(ready(spark), "refresh_index")
    for _ in range(2):
        # A pattern: a file stream takes a folder or a pattern, and the table may be a single file.
        refresh_index.refresh(spark, f"{sf_dir}/{{documents}}.parquet", f"{folder}/index", f"{folder}/checkpoint")
    return refresh_index.output(spark, f"{folder}/index")


def job2_tagger_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(ready(spark), "tagger_corpus")
    for _ in range(2):
        # Whole texts: no limit of tokens.
        tagger_corpus.build(spark, f"{sf_dir}/documents.parquet", folder, "general", most_tokens=1 << 30)
    return tagger_corpus.output(spark, folder).select("id", "split", F.posexplode(F.arrays_zip("tokens", "labels")).alias("i", "x")).select("id", "split", "i", F.col("x.tokens").alias("token"), F.col("x.labels").alias("label"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_refresh_index, job2_tagger_corpus)}


def oracle_sql() -> dict[str, str]:
    return job_sql()
