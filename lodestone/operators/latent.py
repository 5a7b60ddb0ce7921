"""Learned embeddings: a truncated factorisation of the corpus's term weights (V1, V2).

Terms are hashed to ``FEATURES`` columns; a text's row holds (1 + log tf) * idf, scaled to
unit length. The leading right singular vectors of that matrix A are found by a randomised
range finder: a Gaussian sketch goes through A'A a few times, orthonormalised between, and
a small symmetric eigenproblem picks the directions. Texts are counted once, into a table
that each pass reads; a task adds up its part of A'AM, parts are summed block by block of
columns, and what reaches the driver is one number a column and direction, however many
texts there are. A text, stored or asked, is embedded as its row times the directions, at
unit length.

Texts that are null or have no term of the corpus have the zero vector.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, StructField, StructType

from lodestone.functions.models import embed_column
from lodestone.functions.text import NBSP, TOKEN
from lodestone.session import scratch

FEATURES, DIMENSION, SPARE, PASSES = 1 << 15, 64, 16, 3
#: Columns of one block of sums, and texts that are counted together.
BLOCK, TEXTS = 1024, 256
#: A text's columns and counts as bytes: whole numbers would go to Python and back one by one.
_COLUMN, _TIMES = np.dtype("<u2"), np.dtype("<u4")
_token = re.compile(TOKEN).findall


def _counted(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many columns each text has, and text by text its columns in order and how often its terms fall into each."""
    found = []
    for x in texts:
        terms = _token((x or "").lower().replace("ё", "е").replace(NBSP, " "))
        found.append(np.unique(np.fromiter(map(zlib.crc32, map(str.encode, terms)), np.int64, len(terms)) % FEATURES, return_counts=True))
    none = np.zeros(0, np.int64)
    return np.array([len(c) for c, _ in found], np.int64), np.concatenate([none, *[c for c, _ in found]]), np.concatenate([none, *[t for _, t in found]])


class Rows:
    """Texts as sparse rows, text by text their columns and weights."""

    def __init__(self, size: np.ndarray, column: np.ndarray, times: np.ndarray, idf: np.ndarray):
        self.starts, self.column = np.concatenate([[0], np.cumsum(size)]), column
        self.weight = (1 + np.log(times)) * idf[column]
        text = np.repeat(np.arange(len(size)), size)
        norm = np.sqrt(np.bincount(text, self.weight**2, len(size)))[text]
        self.weight = np.divide(self.weight, norm, out=np.zeros_like(self.weight), where=norm > 0)

    def times(self, m: np.ndarray, total: np.ndarray | None = None) -> np.ndarray:
        """A M; with a total, A' A M is added to it. A text's rows of m are few, so they stay in the processor's cache."""
        out = np.zeros((len(self.starts) - 1, m.shape[1]))
        for i, (lo, hi) in enumerate(zip(self.starts, self.starts[1:])):
            column, weight = self.column[lo:hi], self.weight[lo:hi]
            out[i] = weight @ m[column]
            if total is not None:
                total[column] += weight[:, None] * out[i]
        return out


@dataclass
class LatentEmbedder:
    """An Embedder: idf of the columns, and the directions."""

    idf: np.ndarray
    directions: np.ndarray

    @property
    def dimension(self) -> int:
        return self.directions.shape[1]

    def embed(self, texts: list[str]) -> np.ndarray:
        return self.embed_rows(*_counted(texts))

    def embed_rows(self, size: np.ndarray, column: np.ndarray, times: np.ndarray) -> np.ndarray:
        out = Rows(size, column, times, self.idf).times(self.directions)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)

    def write(self, spark: SparkSession, path: str) -> None:
        """One row a column of the matrix."""
        rows = [(i, float(w), v.tolist()) for i, (w, v) in enumerate(zip(self.idf, self.directions))]
        spark.createDataFrame(rows, "feature int, idf double, direction array<double>").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> LatentEmbedder:
        rows = spark.read.parquet(path).orderBy("feature").collect()
        return cls(np.array([r["idf"] for r in rows]), np.array([r["direction"] for r in rows]))


def counted(texts: DataFrame, text: str = "text") -> DataFrame:
    """The texts' other columns, and of each text its columns and how often its terms fall into each: every pass over a
    corpus reads these, so they are made once, written and read back."""
    kept = [c for c in texts.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS):
                part = batch.slice(lo, TEXTS)
                size, column, times = _counted(part.column(len(kept)).to_pylist())
                ends = np.cumsum(size)
                made = [pa.array([x[e - n : e].tobytes() for n, e in zip(size, ends)], pa.binary()) for x in (column.astype(_COLUMN), times.astype(_TIMES))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *made], [*kept, "_columns", "_times"])

    schema = StructType([*[texts.schema[c] for c in kept], *[StructField(c, BinaryType()) for c in ("_columns", "_times")]])
    folder = scratch(texts.sparkSession, "counted")
    texts.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`")).mapInArrow(run, schema).write.parquet(folder)
    return texts.sparkSession.read.schema(schema).parquet(folder)


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The last two columns of a batch as Rows takes them."""
    columns, times = ([x or b"" for x in c.to_pylist()] for c in batch.columns[-2:])
    size = np.array([len(x) for x in columns], np.int64) // _COLUMN.itemsize
    return size, np.frombuffer(b"".join(columns), _COLUMN).astype(np.int64), np.frombuffer(b"".join(times), _TIMES)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, n): of a task, the texts that have each column; the last feature counts all texts."""
    total = np.zeros(FEATURES + 1, np.int64)
    for batch in batches:
        size, column, _ = _arrays(batch)
        total[:-1] += np.bincount(column, minlength=FEATURES)
        total[-1] += len(size)
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["feature", "n"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block -> one row a block."""
    last, total = None, np.zeros(0)
    for batch in batches:
        for block, part in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = np.frombuffer(part.as_buffer(), np.float64)
            if block != last:
                if last is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([total.tobytes()])], ["block", "part"])
                last, total = block, own.copy()
            else:
                total += own
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([total.tobytes()])], ["block", "part"])


def _gram_times(rows: DataFrame, idf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A'A M"""
    held = rows.sparkSession.sparkContext.broadcast((idf, m))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, m = held.value
        total = np.zeros(m.shape)
        for batch in batches:
            Rows(*_arrays(batch), idf).times(m, total)
        for k in range(0, FEATURES, BLOCK):
            if total[k : k + BLOCK].any():
                yield pa.RecordBatch.from_arrays([pa.array([k // BLOCK]), pa.array([total[k : k + BLOCK].tobytes()])], ["block", "part"])

    parts = rows.mapInArrow(run, "block long, part binary").repartition(FEATURES // BLOCK, "block").sortWithinPartitions("block")
    out = np.zeros(m.shape)
    for r in parts.mapInArrow(_summed, "block long, part binary").collect():
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["part"], np.float64).reshape(-1, m.shape[1])
    held.unpersist()
    return out


def fit(texts: DataFrame, text: str = "text", dimension: int = DIMENSION, passes: int = PASSES, seed: int = 7) -> LatentEmbedder:
    """The embedder of a corpus, given as texts or as counted() has them. A corpus of lower rank than the dimension has zero
    directions at the end."""
    given = (texts if "_columns" in texts.columns else counted(texts.select(text), text)).select("_columns", "_times")
    total = np.zeros(FEATURES + 1, np.int64)
    for r in given.mapInArrow(_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        total[r["feature"]] = r["n"]
    idf = np.where(total[:-1] > 0, np.log((1 + total[-1]) / (1 + total[:-1])) + 1, 0.0)
    basis = np.random.default_rng(seed).standard_normal((FEATURES, dimension + SPARE))
    for k in range(passes):
        got = _gram_times(given, idf, basis)
        if k + 1 < passes:
            basis, _ = np.linalg.qr(got)
    small = basis.T @ got
    value, vector = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(-value)[:dimension]
    return LatentEmbedder(idf, basis @ vector[:, best] * (value[best] > 1e-9 * max(1.0, value.max())))


def vectors(chunks: DataFrame, model: LatentEmbedder) -> DataFrame:
    """corpus_idx, embedding of every chunk, given with its text or as counted() has it: what the dense index holds (V5)."""
    if "_columns" not in chunks.columns:
        return chunks.select("corpus_idx", embed_column(model, "text").alias("embedding"))
    held = chunks.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = held.value.embed_rows(*_arrays(batch))
            starts = pa.array(np.arange(len(made) + 1) * made.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(starts, pa.array(made.ravel()))], ["corpus_idx", "embedding"])

    schema = StructType([chunks.schema["corpus_idx"], StructField("embedding", ArrayType(DoubleType()))])
    return chunks.select("corpus_idx", "_columns", "_times").mapInArrow(run, schema)
