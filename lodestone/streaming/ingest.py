"""Optional: new text files become chunks as they arrive; chunks already held are not added again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.chunking import chunk_files
from lodestone.sources.io import append_new


def chunk_stream(spark: SparkSession, folder: str, table: str, checkpoint: str) -> StreamingQuery:
    files = spark.readStream.schema("value string").option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    named = files.select(F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("full_text"))

    def add(batch: DataFrame, _: int) -> None:
        append_new(chunk_files(batch), table, "chunk_id")

    return named.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(add).start()
