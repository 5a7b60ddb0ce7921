"""Incremental job: new document files become segments of the BM25 index.

A file stream with a checkpoint takes the files that earlier runs have not taken, some at a
time, and ends when there are no more. Each batch is one segment of the index (see
lodestone.operators.segments), numbered as the batch, so a batch that is repeated after a
failure writes the same partition again. A run without new files changes nothing.

    python -m jobs.refresh_index --config jobs/refresh_index.json --documents PATH --index PATH --checkpoint PATH
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import segments

log = logging.getLogger("refresh_index")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@dataclass
class Settings:
    documents: str
    index: str
    checkpoint: str
    files_a_batch: int = 64


def refresh(spark: SparkSession, documents: str, index: str, checkpoint: str, files_a_batch: int = Settings.files_a_batch) -> int:
    """Takes what is new in a folder of Parquet files, or of those that a pattern finds; the number of batches taken."""
    taken = []

    def add(batch: DataFrame, number: int) -> None:
        segments.write_segment(batch.select(F.col("doc_id").alias("corpus_idx"), "text"), index, number)
        taken.append(number)
        read = batch.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("without_id")).first().asDict()
        log.info("read batch %d of %s: %s; wrote segment=%d of %s/{docs,postings,terms}: %s", number, documents, read, number, index, segments.summary(spark, index, number))

    files = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_a_batch).parquet(documents)
    stream = files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    log.info("%d new batches; the index is in %s", len(taken), index)
    return len(taken)


def output(spark: SparkSession, index: str) -> DataFrame:
    """The index as it is now: term, doc_id, tf (times in the text), dl (tokens of the text), df (texts with the term)."""
    now = segments.read(spark, index)
    return now.postings.join(now.terms, "term").select("term", F.col("corpus_idx").alias("doc_id"), "tf", "dl", "df")


def main() -> None:
    from jobs.config import from_arguments
    from lodestone.session import ready

    s = from_arguments(Settings, __doc__.split("\n")[0])
    spark = ready(SparkSession.builder.appName("refresh_index").getOrCreate())
    try:
        refresh(spark, s.documents, s.index, s.checkpoint, s.files_a_batch)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
