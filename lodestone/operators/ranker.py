"""A trained model of (question, chunk) pairs: listwise learning to rank over candidates.

``features`` describes each candidate by Spark expressions: its lexical, dense and fused
scores, the entities it shares with the question, and how much of the question's words,
neighbouring words and runs of four words it holds. ``Trainer.fit`` learns one weight a
feature from relevant chunks: the candidates of a question are one list, the loss is the
cross entropy between the softmax of their scores and their gains, and every Newton step is
one pass over the lists that sends a gradient and a small matrix to the driver.

Defined results: a feature that is null counts as 0; a list without a relevant candidate or
with nothing but equally relevant ones teaches nothing; without any list that teaches, all
weights are 0 and candidates keep their order; rows without a question_id are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import query_tokens, tokens
from lodestone.session import scratch

FEATURES = ("lexical", "dense", "fused", "entities", "words", "pairs", "runs", "length")
#: Weight of the ridge beside the mean loss of a list, Newton steps at most, and the step that ends them.
RIDGE, STEPS, ENOUGH = 1e-3, 30, 1e-9


def _windows(words: str, n: int) -> Column:
    """Hashes of the distinct runs of n words."""
    starts = F.sequence(F.lit(0), F.size(words) - n)
    return F.when(F.size(words) >= n, F.array_distinct(F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)])))).otherwise(F.array().cast("array<bigint>"))


def _share(n: int) -> Column:
    """The share of the question's runs of n words that the chunk holds; 0 for a question without any."""
    asked, held = _windows("_asked", n), _windows("_held", n)
    return F.when(F.size("_asked") >= n, F.size(F.array_intersect(asked, held)) / F.size(asked)).otherwise(0.0)


def features(hits: DataFrame, rrf_k: int = 60) -> DataFrame:
    """hits with question, text, bm25_score, dense_score, hybrid_score and ner_score, and one column a feature. Scores of
    the sides are null where a side did not find the chunk."""
    read = hits.withColumn("_asked", query_tokens(F.coalesce("question", F.lit("")))).withColumn("_held", tokens(F.coalesce("text", F.lit(""))))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    made = {
        "lexical": zero("bm25_score") / F.greatest(F.lit(1), F.size("_asked")), "dense": zero("dense_score"), "fused": zero("hybrid_score") * rrf_k,
        "entities": zero("ner_score"), "words": _share(1), "pairs": _share(2), "runs": _share(4), "length": F.log1p(F.size("_held")),
    }
    return read.withColumns({n: c.cast("double") for n, c in made.items()}).drop("_asked", "_held")


@dataclass
class Ranker:
    """Weights of standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    names: tuple[str, ...] = FEATURES

    def logit(self) -> Column:
        terms = [(F.coalesce(F.col(n), F.lit(0.0)) - float(m)) * float(w / s) for n, m, s, w in zip(self.names, self.mean, self.scale, self.weights)]
        return sum(terms, F.lit(0.0))

    def rerank(self, hits: DataFrame, k: int, rank: str = "candidate_rank") -> DataFrame:
        """hits with features -> the k best of each question; ties keep the candidates' order."""
        scored = hits.withColumn("reranker_score", 1 / (1 + F.exp(-self.logit())))
        order = Window.partitionBy("question_id").orderBy(F.desc(F.round(self.logit(), 9)), rank)
        return scored.withColumn("final_rank", F.row_number().over(order)).filter(F.col("final_rank") <= k)


def _pass(weights: np.ndarray):
    """Of a task's lists: loss, gradient and second derivatives at the weights, one row of numbers."""
    size = len(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + size + size * size)
        for batch in batches:
            for flat, gain in zip(batch.column(0), batch.column(1)):
                x = np.array(flat.as_py(), np.float64).reshape(-1, size)
                y = np.array(gain.as_py(), np.float64)
                y /= y.sum()
                z = x @ weights
                log = z - z.max() - np.log(np.exp(z - z.max()).sum())
                p = np.exp(log)
                mean = p @ x
                total[0] += 1
                total[1] -= y @ log
                total[2 : 2 + size] += mean - y @ x
                total[2 + size :] += ((x * p[:, None]).T @ x - np.outer(mean, mean)).ravel()
        if total[0]:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["spot", "value"])

    return run


@dataclass
class Trainer:
    """Fits a Ranker to candidates with features and gains."""

    names: tuple[str, ...] = FEATURES
    ridge: float = RIDGE

    def _at(self, lists: DataFrame, weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Mean loss of a list with the ridge, its gradient and its second derivatives."""
        size = len(weights)
        total = np.zeros(2 + size + size * size)
        for r in lists.mapInArrow(_pass(weights), "spot int, value double").groupBy("spot").agg(F.sum("value").alias("value")).collect():
            total[r["spot"]] = r["value"]
        total[1:] /= max(1.0, total[0])
        loss = total[1] + self.ridge / 2 * weights @ weights
        return loss, total[2 : 2 + size] + self.ridge * weights, total[2 + size :].reshape(size, size) + self.ridge * np.eye(size)

    def fit(self, rows: DataFrame, gain: str = "gain") -> Ranker:
        """rows: question_id, the features and a gain of 0 or more; a question's candidates are as many as were looked for."""
        names, size = self.names, len(self.names)
        given = rows.filter("question_id is not null").select("question_id", F.coalesce(F.col(gain), F.lit(0)).cast("double").alias("_gain"), *[F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in names])
        # Features are made once; statistics and lists read them back.
        spark, folder = rows.sparkSession, scratch(rows.sparkSession, "pairs")
        given.write.parquet(f"{folder}/rows")
        given = spark.read.parquet(f"{folder}/rows")
        stats = given.agg(*[F.avg(n).alias(f"{n}_m") for n in names], *[F.stddev_pop(n).alias(f"{n}_s") for n in names]).first()
        mean = np.array([stats[f"{n}_m"] or 0.0 for n in names])
        scale = np.array([s if (s := stats[f"{n}_s"] or 0.0) > 1e-12 else 1.0 for n in names])
        own = F.array(*[(F.col(n) - float(m)) / float(s) for n, m, s in zip(names, mean, scale)])
        grouped = given.groupBy("question_id").agg(F.collect_list(F.struct(own.alias("x"), F.col("_gain").alias("y"))).alias("l"), F.min("_gain").alias("least"), F.max("_gain").alias("most"))
        grouped.filter("most > 0 and most > least").select(F.flatten("l.x").alias("x"), F.col("l.y").alias("y")).write.parquet(f"{folder}/lists")
        lists = spark.read.parquet(f"{folder}/lists")
        weights = np.zeros(size)
        loss, slope, curve = self._at(lists, weights)
        for _ in range(STEPS):
            step = np.linalg.solve(curve, slope)
            if np.abs(step).max() < ENOUGH:
                break
            # The loss is convex: a step that overshoots is halved.
            while True:
                there = self._at(lists, weights - step)
                if there[0] <= loss or np.abs(step).max() < ENOUGH:
                    break
                step /= 2
            weights, (loss, slope, curve) = weights - step, there
        return Ranker(mean, scale, weights, names)
