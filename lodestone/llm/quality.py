"""A byte-level convolutional quality classifier in numpy (operator 2).

The UTF-8 bytes of the whole text are embedded; learned filters of six bytes slide over
them two bytes at a time, and each filter is max-pooled within overlapping chunks of
512 bytes. A small layer turns a chunk's pooled values into two votes; a document's
logit is the mean of the first over its chunks plus the maximum of the second. As the
filters step by two bytes, each filter is three lookups by byte pair, so scoring needs
no multiplication per byte.

The model is fitted on the driver on a bounded sample of labelled rows: ``SAMPLE``
documents at most, those first by a hash of doc_id, none longer than ``SAMPLE_BYTES``.

Defined results: null and empty texts are scored as an empty chunk; rows with a null
doc_id are scored and not held out; without any labelled row every score is 0.5; equal
rows are scored each; very long texts are scored whole, chunk by chunk; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import only

SAMPLE, SAMPLE_BYTES = 3000, 50_000
EMBEDDING, FILTERS, HIDDEN, WIDTH = 6, 24, 16, 6
HALF = 256  # bytes; a chunk is two halves, and neighbouring chunks share one
EPOCHS, BATCH, RATE = 14, 64, 4e-3


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte pairs of all texts, each padded with zeros to whole halves; halves of each text; how full each half is."""
    sizes = np.array([len(t) for t in texts], np.int64)
    halves = -(-(sizes + WIDTH - 2) // HALF)
    flat = b"".join(t + bytes(int(h) * HALF - len(t)) for t, h in zip(texts, halves))
    nth = np.arange(int(halves.sum())) - np.repeat(np.cumsum(halves) - halves, halves)
    full = np.clip(np.repeat(sizes, halves) - nth * HALF, 0, HALF) / HALF
    return np.frombuffer(flat + bytes(WIDTH - 2), "<u2"), halves, full.astype(np.float32)


class Model:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        normal = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "embed": normal(256, EMBEDDING, scale=0.5), "filter": normal(WIDTH, EMBEDDING, FILTERS, scale=0.3), "bias": np.zeros(FILTERS, np.float32),
            "inner": normal(FILTERS + 1, HIDDEN, scale=0.3), "inner_bias": np.zeros(HIDDEN, np.float32), "vote": normal(HIDDEN, 2, scale=0.3), "out": np.zeros(1, np.float32),
        }
        self.name = uuid.uuid4().hex

    def tables(self) -> list[np.ndarray]:
        """For each of the three places of a filter, its sum for every byte pair."""
        e, f = self.p["embed"], self.p["filter"]
        one = [e @ f[k] for k in range(WIDTH)]
        return [(one[k + 1][:, None, :] + one[k][None, :, :]).reshape(1 << 16, FILTERS) for k in range(0, WIDTH, 2)]

    def pooled(self, pairs: np.ndarray, tables: list[np.ndarray], where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The maximum of every filter in every half, and the pair at which it begins."""
        n = len(pairs) - (WIDTH // 2 - 1)
        per, step = HALF // 2, 1 << 15
        top, at = np.empty((n // per, FILTERS), np.float32), np.empty((n // per, FILTERS), np.int64) if where else None
        for lo in range(0, n, step):
            hi = min(n, lo + step)
            x = tables[0][pairs[lo:hi]]
            for k in (1, 2):
                x += tables[k][pairs[lo + k : hi + k]]
            x = x.reshape(-1, per, FILTERS)
            own = slice(lo // per, hi // per)
            top[own] = x.max(axis=1)
            if where:
                at[own] = x.argmax(axis=1) + np.arange(lo, hi, per)[:, None]
        return top, at

    @staticmethod
    def chunks(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and second half of each chunk, chunks of each text. A text of one half is one chunk."""
        count = np.maximum(halves - 1, 1)
        nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        first = np.repeat(np.cumsum(halves) - halves, count) + nth
        return first, np.minimum(first + 1, np.repeat(np.cumsum(halves), count) - 1), count

    def forward(self, pairs, halves, full, tables, where=False):
        top, at = self.pooled(pairs, tables, where)
        a, b, count = self.chunks(halves)
        second = top[b] > top[a]
        pool = np.where(second, top[b], top[a]) + self.p["bias"]
        act = np.tanh(pool)
        given = np.concatenate([act, (full[a] + full[b])[:, None] / 2], axis=1)
        inner = np.maximum(given @ self.p["inner"] + self.p["inner_bias"], 0)
        votes = inner @ self.p["vote"]
        starts = np.cumsum(count) - count
        high = np.maximum.reduceat(votes[:, 1], starts)
        logit = np.add.reduceat(votes[:, 0], starts) / count + high + self.p["out"][0]
        return logit, (at, a, b, count, second, act, given, inner, votes, starts, high)

    def score(self, texts: list[bytes], tables: list[np.ndarray]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        logit, _ = self.forward(*layout(texts), tables)
        return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -30, 30)))

    def gradient(self, texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
        pairs, halves, full = layout(texts)
        logit, (at, a, b, count, second, act, given, inner, votes, starts, high) = self.forward(pairs, halves, full, self.tables(), True)
        d = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels) / len(labels)).astype(np.float32)
        doc = np.repeat(np.arange(len(count)), count)
        d_votes = np.zeros_like(votes)
        d_votes[:, 0] = d[doc] / count[doc]
        best = votes[:, 1] == high[doc]
        d_votes[:, 1] = d[doc] * best / np.add.reduceat(best.astype(np.float32), starts)[doc]
        g = {"out": d.sum(keepdims=True), "vote": inner.T @ d_votes}
        d_inner = (d_votes @ self.p["vote"].T) * (inner > 0)
        g["inner"], g["inner_bias"] = given.T @ d_inner, d_inner.sum(axis=0)
        d_pool = (d_inner @ self.p["inner"].T)[:, :FILTERS] * (1 - act * act)
        g["bias"] = d_pool.sum(axis=0)
        # Only the window that won a filter's maximum learns.
        won = np.where(second, at[b], at[a])
        flat = pairs.view("u1")
        g["filter"], g["embed"] = np.zeros_like(self.p["filter"]), np.zeros_like(self.p["embed"])
        for k in range(WIDTH):
            byte = flat[2 * won + k]
            g["filter"][k] = np.einsum("cfe,cf->ef", self.p["embed"][byte], d_pool)
            add = d_pool[:, :, None] * self.p["filter"][k].T[None]
            for e in range(EMBEDDING):
                g["embed"][:, e] += np.bincount(byte.ravel(), add[:, :, e].ravel(), 256)
        return g

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> Model:
        """Adam on batches of documents."""
        r, labels = np.random.default_rng(seed), np.asarray(labels, np.float32)
        share = float(np.clip(labels.mean(), 0.02, 0.98))
        self.p["out"][:] = np.log(share / (1 - share))
        m, v, t = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        steps = max(epochs * -(-len(texts) // BATCH), 300)
        order: list[int] = []
        for t in range(1, steps + 1):
            if len(order) < min(BATCH, len(texts)):
                order += r.permutation(len(texts)).tolist()
            own, order = order[:BATCH], order[BATCH:]
            g = self.gradient([texts[i] for i in own], labels[own])
            rate = RATE * (1 - 0.9 * t / steps)
            for k, x in self.p.items():
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                x -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return self


def remainder(of: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fits on labelled rows whose crc32(doc_id as text) mod 4 is not 2; None if there is none."""
    known = only(labels, "doc_id", "quality").filter(F.col("quality").isNotNull() & (remainder(4) != 2)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    texts = only(docs, "doc_id", "text").filter(F.octet_length(F.coalesce("text", F.lit(""))) <= SAMPLE_BYTES)
    # Only about twice the sample goes on to be ordered, so no task sends much to the driver.
    most = int(min(1.0, 2 * sample / max(1, known.count())) * (1 << 30))
    first = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < most).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = texts.join(F.broadcast(first), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample).collect()
    if not rows:
        return None
    return Model().fit([(r["text"] or "").encode() for r in rows], np.array([r["quality"] for r in rows]))


_tables: dict[str, list[np.ndarray]] = {}


def classify(docs: DataFrame, model: Model | None, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model and model.name not in _tables:
            _tables.clear()
            _tables[model.name] = model.tables()
        for batch in batches:
            texts = [(x or "").encode() for x in batch.column(1).to_pylist()]
            score = np.concatenate([model.score(texts[k : k + 64], _tables[model.name]) for k in range(0, len(texts), 64)] or [np.zeros(0)]) if model else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out")
    return only(docs, "doc_id", "text").select("doc_id", "text", held).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
