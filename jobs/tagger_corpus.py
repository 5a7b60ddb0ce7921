"""Batch job: documents become the training corpus of an entity tagger.

Patterns annotate the documents; records that are too short or have no entity are left out,
bad and repeated spans are removed, the rest is split into train and dev by a seeded hash
and aligned with tokens. Written are ``records`` (Parquet, partitioned by split), ``labels``
(the label vocabulary as JSON lines) and ``counters`` (one row). Everything follows from the
documents and the settings, so another run replaces the files by the same rows.

    python -m jobs.tagger_corpus --config jobs/tagger_corpus.json --documents PATH --out PATH
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.patterns import ANNOTATIONS, GENERAL
from lodestone.operators import annotate

log = logging.getLogger("tagger_corpus")
#: The packs of patterns by name: references to regulations, and general ones under the same labels.
PACKS = {"regulations": ANNOTATIONS, "general": {"NORM_REF": GENERAL["EMAIL"] + GENERAL["ADDRESS"] + GENERAL["NUMBER"], "NORM_DOC": GENERAL["LICENCE"]}}


@dataclass
class Settings:
    documents: str
    out: str
    pack: str = "regulations"
    seed: int = 42
    dev_share: float = 0.2
    most_tokens: int = 384


def records(documents: DataFrame) -> DataFrame:
    """Documents as the library's records: a document is a chunk."""
    return documents.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("source_file"), F.lit(1).alias("page_num"), "text")


def build(spark: SparkSession, documents: str, out: str, pack: str = Settings.pack, seed: int = Settings.seed, dev_share: float = Settings.dev_share, most_tokens: int = Settings.most_tokens) -> dict[str, int]:
    """Writes the corpus; the counters with the numbers of records by split."""
    patterns = PACKS[pack]
    given = records(spark.read.parquet(documents))
    log.info("reading %s with pack %s", documents, pack)
    annotated = f"{out}/annotated"
    annotate.finalize(annotate.candidates(given, None, patterns)).write.mode("overwrite").parquet(annotated)
    final = spark.read.parquet(annotated)
    counters = annotate.counters(given, final.select("id").limit(0), patterns).withColumnRenamed("existing", "already_known")
    counters.withColumns({"kept": F.lit(final.count()), "removed_spans": F.lit(final.agg(F.sum("removed")).first()[0] or 0)}).coalesce(1).write.mode("overwrite").json(f"{out}/counters")
    annotate.label_vocabulary(spark).coalesce(1).write.mode("overwrite").json(f"{out}/labels")
    split = annotate.split(final, seed=seed, dev_share=dev_share).select("id", "split")
    aligned = annotate.align(final, most=most_tokens).join(split, "id")
    aligned.write.mode("overwrite").partitionBy("split").parquet(f"{out}/records")
    wrote = {r["split"]: r["count"] for r in output(spark, out).groupBy("split").count().collect()}
    counted = spark.read.json(f"{out}/counters").first().asDict() | wrote
    log.info("wrote %s/records by split, %s/labels, %s/counters: %s", out, out, out, counted)
    return counted


def output(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/records")


def main() -> None:
    from jobs.config import from_arguments
    from lodestone.session import ready

    s = from_arguments(Settings, __doc__.split("\n")[0])
    spark = ready(SparkSession.builder.appName("tagger_corpus").getOrCreate())
    try:
        build(spark, s.documents, s.out, s.pack, s.seed, s.dev_share, s.most_tokens)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
