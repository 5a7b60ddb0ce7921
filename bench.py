"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from lodestone.plans import catalogue

HEADLINE = (
    "text_clean tokenize bm25_index_stats bm25_topk knn_topk rrf_hybrid hybrid_entity_rerank metrics_per_question metrics_delta "
    "chunk_text semantic_blocks annotate_topk finalize_entities bio_align format_context html_extract pair_rerank"
).split()


def calibration(spark: SparkSession) -> float:
    """Seconds of a fixed query that uses no table and no code of this repository: how fast the machine is."""
    began = time.time()
    spark.range(0, 200_000_000, 1, 8).selectExpr("xxhash64(id) as h").selectExpr("bit_xor(h)", "sum(h % 1000)").collect()
    return round(time.time() - began, 3)


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    calibration(spark)
    queries, took, fixed = catalogue.queries(), {}, calibration(spark)
    for name in HEADLINE:
        began = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf, "calibration": fixed}))
    spark.stop()


if __name__ == "__main__":
    main()
