"""Gapless numbers in a global order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import scratch

#: monotonically_increasing_id holds the partition above these bits and the place in it below.
_PLACE_BITS = 33


def numbered(df: DataFrame, *order: str, name: str = "corpus_idx", start: int = 0) -> DataFrame:
    """df with a number of each row in the order of the named columns, which tell all rows apart; from ``start``, without gaps.

    Rows are sorted by ranges and written with their partition and place in it; counts of the partitions, one number
    each, are summed on the driver, and each row adds its partition's sum to its place. The table is written once
    before, so that the sampling of the ranges doesn't compute it twice. An empty table stays empty; nulls come first.
    """
    spark = df.sparkSession
    plain, path = scratch(spark, "unnumbered"), scratch(spark, "numbered")
    df.write.parquet(plain)
    rows = spark.read.schema(df.schema).parquet(plain)
    rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.parquet(path).withColumn("_part", F.shiftright("_at", _PLACE_BITS))
    sizes = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    sums, total = [], start
    for part, n in sizes:
        sums.append((part, total))
        total += n
    before = spark.createDataFrame(sums, "_part long, _before long")
    place = F.col("_at").bitwiseAND((1 << _PLACE_BITS) - 1)
    return placed.join(F.broadcast(before), "_part").select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + place).alias(name))
