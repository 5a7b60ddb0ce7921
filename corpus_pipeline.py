"""A corpus pipeline: rules, near duplicates, benchmark items, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. The
rules keep or drop whole rows; of each group of near duplicates one row stays, the first
by doc_id and text; rows that hold a benchmark item go; personal data is replaced in the
text, and n_chars follows; packing returns one row a piece. Every decision is about the
row's own text, so rows that share a doc_id, or have none, don't go for each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import settle, table
from lodestone.llm.decontaminate import decontaminate
from lodestone.llm.jaccard import keep_one
from lodestone.llm.packing import pack_documents
from lodestone.llm.pii import pseudonymise
from lodestone.llm.queries import secret_key, vocabulary
from lodestone.llm.rules import keep_good

#: Near duplicates share 80 of 100 shingles of five words.
NEAR_WORDS, NEAR_LINK = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, n=NEAR_WORDS, link=NEAR_LINK)


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    changed = pseudonymise(docs, secret_key(spark))
    return changed.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, vocabulary())


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_items),
    ("personal data", personal_data),
    ("best-fit packing", packing),
]

#: SQL cannot express the later stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = settle(docs)
    return docs
