"""Reciprocal rank fusion and rerankers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.models import PairScorer, pair_column


def rrf(dense: DataFrame, lexical: DataFrame, rrf_k: int = 60, most: int | None = None, scores: bool = False) -> DataFrame:
    """Full outer merge by (question_id, chunk_id) (J1-J3); a side that did not retrieve a chunk adds nothing.
    Ties: by dense rank, then by lexical rank, missing ranks last. scores: keeps dense_score and bm25_score too."""
    near = dense.select("question_id", "chunk_id", "dense_rank", *(["dense_score"] if scores else []))
    words = lexical.select("question_id", "chunk_id", "bm25_rank", *(["bm25_score"] if scores else []))
    both = near.join(words, ["question_id", "chunk_id"], "full")
    part = lambda c: F.coalesce(1 / (rrf_k + F.col(c)), F.lit(0.0))
    scored = both.withColumn("hybrid_score", part("dense_rank") + part("bm25_rank"))
    order = Window.partitionBy("question_id").orderBy(F.desc(F.round("hybrid_score", 12)), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("bm25_rank"), "chunk_id")
    ranked = scored.withColumn("candidate_rank", F.row_number().over(order))
    return ranked if most is None else ranked.filter(F.col("candidate_rank") <= most)


def pair_rerank(hits: DataFrame, scorer: PairScorer, k: int, question: str = "question", text: str = "text", rank: str = "candidate_rank") -> DataFrame:
    """The k best of each question by a model of (question, text) (J5); ties keep the candidates' order."""
    scored = hits.withColumn("reranker_score", pair_column(scorer, question, text))
    order = Window.partitionBy("question_id").orderBy(F.desc(F.round("reranker_score", 9)), rank)
    return scored.withColumn("final_rank", F.row_number().over(order)).filter(F.col("final_rank") <= k)
