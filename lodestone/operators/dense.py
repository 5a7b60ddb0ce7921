"""Exact nearest neighbours: a block of questions against every vector, one matrix product a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Questions that go to the workers together: at most so many, whatever the table.
BLOCK = 4096
#: Questions and vectors of one matrix product, so a tile of scores has 8 MB.
ASKED, ROWS = 512, 2048


class Best:
    """The k best (score, id) that a task has met of each question."""

    def __init__(self, questions: int, k: int):
        self.k = k
        self.held = [(np.zeros((min(ASKED, questions - q), 0)), np.zeros((min(ASKED, questions - q), 0), np.int64)) for q in range(0, questions, ASKED)]

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        """score: of questions from q on, by vector. What is below the k-th score goes before the rest is put in order."""
        own, known = self.held[q // ASKED]
        score, ids = np.hstack([own, score]), np.hstack([known, np.broadcast_to(ids, score.shape)])
        rounded = np.round(score, 9)
        k = min(self.k, score.shape[1])
        least = np.partition(rounded, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        row, col = np.nonzero(rounded >= least[:, None])
        order = np.lexsort((ids[row, col], -rounded[row, col], row))
        row, col = row[order], col[order]
        first = np.searchsorted(row, np.arange(len(score)))
        at = (first[:, None] + np.arange(k)).ravel()
        row, col = row[at].reshape(-1, k), col[at].reshape(-1, k)
        self.held[q // ASKED] = score[row, col], ids[row, col]

    def rows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for i, (score, ids) in enumerate(self.held):
            if score.size:
                yield np.repeat(np.arange(len(score)), score.shape[1]) + i * ASKED, ids.ravel(), score.ravel()


def topk(vectors: DataFrame, questions: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """vectors: corpus_idx, embedding; questions: question_id, embedding; both of unit length.
    -> question_id, corpus_idx, dense_score, dense_rank: the k largest dot products, ties by corpus_idx (V6)."""
    spark = vectors.sparkSession
    kind = questions.schema["question_id"].dataType.simpleString()
    schema = f"question_id {kind}, corpus_idx long, dense_score double"
    parts: list[DataFrame] = []
    held: list = []

    def add() -> None:
        own = spark.sparkContext.broadcast(([r["question_id"] for r in held], np.array([r["embedding"] for r in held], np.float64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, asked = own.value
            best = Best(len(names), k)
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                    ids = part.column(0).to_numpy(zero_copy_only=False)
                    for q in range(0, len(names), ASKED):
                        best.add(q, asked[q : q + ASKED] @ flat.T, ids)
            for q, ids, score in best.rows():
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in q], pa.string() if kind == "string" else pa.int64()), pa.array(ids, pa.int64()), pa.array(score)], ["question_id", "corpus_idx", "dense_score"])

        parts.append(vectors.select(F.col("corpus_idx").cast("long"), "embedding").filter("embedding is not null").mapInArrow(run, schema))

    for row in questions.select("question_id", "embedding").filter("embedding is not null").toLocalIterator():
        held.append(row)
        if len(held) == block:
            add()
            held = []
    if held or not parts:
        if not held:
            return spark.createDataFrame([], schema + ", dense_rank int")
        add()
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    order = Window.partitionBy("question_id").orderBy(F.desc(F.round("dense_score", 9)), "corpus_idx")
    return every.withColumn("dense_rank", F.row_number().over(order)).filter(F.col("dense_rank") <= k)
