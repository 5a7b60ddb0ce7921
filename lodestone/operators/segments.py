"""A BM25 index that grows by immutable segments.

Each batch of texts is written once, as partition ``segment=<number>`` of three tables:
``docs`` (a row a text), ``postings`` (sorted by term, so that a question's terms reach few
row groups) and ``terms`` (the segment's own document frequencies). Writing a batch again
replaces its partition by the same rows, so a repeated batch is harmless. A text that comes
again, or comes as null (it is deleted then), marks its older rows: readers leave out what
a newer segment has. Statistics of the whole are sums over the segments less what is marked.

Defined results: rows without an id are not indexed; rows of one id in one batch are one
text, their tokens counted together, and one null text among them deletes nothing; an empty
text has the sentinel token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import tokens
from lodestone.operators.lexical import EPSILON, Index, weighted
from lodestone.session import scratch

DOCS = "corpus_idx long, dl long, deleted boolean, segment long"
POSTINGS = "term string, corpus_idx long, tf long, dl long, segment long"
TERMS = "term string, df long, segment long"


def _write(df: DataFrame, path: str, segment: int) -> None:
    df.withColumn("segment", F.lit(segment)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("segment").parquet(path)


def write_segment(texts: DataFrame, path: str, segment: int) -> None:
    """texts: corpus_idx, text. What is derived from a table already written is read from there, so each is made once."""
    spark = texts.sparkSession
    split = texts.filter("corpus_idx is not null").select("corpus_idx", F.when(F.col("text").isNotNull(), tokens("text")).alias("_t"))
    length = F.sum(F.when(F.col("_t").isNotNull(), F.size("_t")))
    docs = split.groupBy("corpus_idx").agg(F.coalesce(length, F.lit(0)).cast("long").alias("dl"), (F.count("_t") == 0).alias("deleted"))
    _write(docs, f"{path}/docs", segment)
    own = lambda schema, table: spark.read.schema(schema).parquet(f"{path}/{table}").filter(F.col("segment") == segment)
    # A text is counted where it is read; only texts of a repeated id meet, and that table's size is known once it is written.
    folder = scratch(spark, "repeated")
    often = texts.groupBy("corpus_idx").agg(F.count(F.lit(1)).alias("n")).filter("corpus_idx is not null and n > 1").select("corpus_idx")
    own(DOCS, "docs").join(often, "corpus_idx").select("corpus_idx", "dl").write.parquet(folder)
    repeated = spark.read.schema("corpus_idx long, dl long").parquet(folder)
    given = texts.filter("corpus_idx is not null and text is not null").select(F.col("corpus_idx").cast("long").alias("corpus_idx"), "text")
    alone = given.join(repeated, "corpus_idx", "left_anti").select("corpus_idx", tokens("text").alias("_t"))
    single = alone.select("corpus_idx", F.size("_t").cast("long").alias("dl"), F.explode(_counts("_t")).alias("_c")).select(F.col("_c.term").alias("term"), "corpus_idx", F.col("_c.tf").alias("tf"), "dl")
    met = given.join(repeated, "corpus_idx").select("corpus_idx", "dl", F.explode(tokens("text")).alias("term")).groupBy("term", "corpus_idx", "dl").agg(F.count(F.lit(1)).alias("tf"))
    counted = single.unionByName(met)
    _write(counted.repartitionByRange("term", "corpus_idx").sortWithinPartitions("term", "corpus_idx"), f"{path}/postings", segment)
    _write(own(POSTINGS, "postings").groupBy("term").agg(F.count(F.lit(1)).alias("df")), f"{path}/terms", segment)


def _counts(words: str) -> Column:
    """(term, tf) of each distinct word of an array: where runs of equal words begin once they are in order."""
    bound = lambda c, f: F.flatten(F.transform(F.array(c), f))  # noqa: E731  # bound through a one-element array, so it is made once
    begins = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    count = lambda s, b: F.transform(b, lambda at, i: F.struct(F.get(s, at).alias("term"), (F.coalesce(F.get(b, i + 1), F.size(s)) - at).cast("long").alias("tf")))
    return bound(F.array_sort(words), lambda s: bound(begins(s), lambda b: count(s, b)))


def _tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in (("docs", DOCS), ("postings", POSTINGS), ("terms", TERMS)))


def summary(spark: SparkSession, path: str, segment: int) -> dict[str, int]:
    """Texts, marks of deletion and tokens of one segment."""
    own = _tables(spark, path)[0].filter(F.col("segment") == segment)
    return own.agg(F.count(F.when(~F.col("deleted"), 1)).alias("texts"), F.count(F.when(F.col("deleted"), 1)).alias("deleted"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).first().asDict()


def read(spark: SparkSession, path: str, epsilon: float = EPSILON) -> Index:
    """The index of the texts as they are now, as lexical.build_index would build it in one go."""
    docs, postings, terms = _tables(spark, path)
    newest = docs.groupBy("corpus_idx").agg(F.max("segment").alias("newest"), F.max_by("deleted", "segment").alias("gone"))
    # Marks are few as a rule; written, their size is known and postings stay where they are.
    folder = scratch(spark, "marked")
    docs.join(newest, "corpus_idx").filter("segment < newest or gone").select("corpus_idx", "segment").write.parquet(folder)
    marked = spark.read.schema("corpus_idx long, segment long").parquet(folder)
    live = docs.join(newest, "corpus_idx").filter("segment = newest and not gone").select("corpus_idx", "dl")
    kept = postings.join(marked, ["corpus_idx", "segment"], "left_anti").drop("segment")
    lost = postings.join(marked, ["corpus_idx", "segment"], "left_semi").groupBy("term").agg((-F.count(F.lit(1))).alias("df"))
    df = terms.select("term", "df").unionByName(lost).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
    held, stats = weighted(df, live.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")), epsilon)
    return Index(kept, held, stats, live.select("corpus_idx"))


def merge(spark: SparkSession, path: str, into: str) -> None:
    """The live rows of an index as one segment, with the newest one's number, in a new folder; the old folder stays as it is."""
    docs, _, _ = _tables(spark, path)
    now = read(spark, path)
    number = docs.agg(F.max("segment")).first()[0] or 0
    lengths = now.postings.groupBy("corpus_idx").agg(F.first("dl").alias("dl"))
    _write(now.docs.join(lengths, "corpus_idx").select("corpus_idx", "dl", F.lit(False).alias("deleted")), f"{into}/docs", number)
    _write(now.postings.select("term", "corpus_idx", "tf", "dl").repartitionByRange("term", "corpus_idx").sortWithinPartitions("term", "corpus_idx"), f"{into}/postings", number)
    _write(now.terms.select("term", "df"), f"{into}/terms", number)
