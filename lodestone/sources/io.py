"""Readers and writers. Paths are any that Spark reads; the driver opens none itself."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped and a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """_file, _line (from 1, blank lines counted) and _raw of every line of text files, however Spark splits them.

    A first pass counts the lines of each split, one row a split; running sums of a file's splits give the second pass
    the lines before each. Both passes plan the same scan, so a split's lines have the same places in both."""
    scan = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_place"), F.col("value").alias("_raw"),
    )
    count = F.count(F.lit(1))
    splits = scan.groupBy("_file", "_block").agg(count.alias("_n"), F.min("_place").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("_file").orderBy("_block")) - F.col("_n")
    of = splits.select("_file", "_block", "_first", before.alias("_before"))
    return scan.join(of, ["_file", "_block"]).select("_file", (F.col("_before") + F.col("_place") - F.col("_first") + 1).alias("_line"), "_raw")


def read_jsonl_traced(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with file, line number and raw line, and an error naming them for a malformed line."""
    raw = numbered_lines(spark, path).filter(F.trim("_raw") != "")
    parsed = raw.withColumn("_row", F.from_json("_raw", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    message = F.concat(F.lit("malformed line in "), F.col("_file"), F.lit(", line "), F.col("_line"), F.lit(": "), F.substring("_raw", 1, 200))
    checked = parsed.withColumn("_row", F.when(F.col("_row._bad").isNull(), F.col("_row")).otherwise(F.raise_error(message).cast(parsed.schema["_row"].dataType)))
    return checked.select("_row.*", "_file", "_line", "_raw").drop("_bad")


def read_json_array(spark: SparkSession, path: str, schema: str, optional: bool = False) -> DataFrame:
    """One JSON array a file (S11); optional: an absent file is no rows."""
    if optional and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with null keys kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def pretty_json(row: DataFrame) -> str:
    """The one row of a table as indented JSON."""
    return json.dumps(json.loads(row.toJSON().first()), ensure_ascii=False, indent=2)


def write_pretty_json(row: DataFrame, path: str) -> None:
    row.sparkSession.createDataFrame([(pretty_json(row),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_metrics_csv(wide: DataFrame, path: str) -> None:
    """pipeline and sorted metric names."""
    wide.coalesce(1).write.mode("overwrite").csv(path, header=True)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Text files of one folder, whole (S8): source_file, full_text."""
    found = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    return found.select(F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("full_text"))


def discover(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """Binary files with this suffix in any case, at any depth (S1, S2): path, content."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.filter(F.lower("path").endswith(suffix.lower())).select("path", "content")


#: The text of a file's bytes; it may raise.
Extractor = Callable[[bytes], str]


def extract(files: DataFrame, extractor: Extractor) -> DataFrame:
    """path, text, error (S3-S5): a file that can't be read has an error and doesn't stop the others."""

    def one(content: bytes) -> tuple[str | None, str | None]:
        try:
            return extractor(bytes(content)), None
        except Exception as e:  # noqa: BLE001 - any fault of a file is its row's error
            return None, f"{type(e).__name__}: {e}"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [one(c) for c in part["content"]]
            yield pd.DataFrame({"path": part["path"], "text": [x[0] for x in found], "error": [x[1] for x in found]})

    return files.select("path", "content").mapInPandas(run, "path string, text string, error string")


def extracted_texts(rows: DataFrame) -> DataFrame:
    """Rows with text (S6) as FILE, keyed by the file's path, so equal names in two folders stay apart."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", ".txt")
    return rows.filter("error is null and length(text) > 0").select(stem.alias("source_file"), F.col("text").alias("full_text"), "path")


def write_texts(texts: DataFrame, path: str) -> None:
    """The text table."""
    texts.write.mode("overwrite").parquet(path)


def write_table(df: DataFrame, path: str, *by: str) -> None:
    """Vectors, postings or training rows as Parquet (S16, S17), partitioned by columns such as split."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def append_new(df: DataFrame, path: str, key: str) -> None:
    """Adds the rows whose key a table doesn't hold yet."""
    spark = df.sparkSession
    new = df.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti") if exists(spark, path) else df
    new.write.mode("append").parquet(path)


