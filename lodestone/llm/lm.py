"""Language-model scoring by a log-bilinear model with noise-contrastive estimation (operator 7).

Tokens are the words of a text with A-Z folded, then one end. A word is known by a 64-bit
hash of its bytes. Words are counted over all training documents. The most frequent ones,
``OWN * tokens ** GROWTH`` of them, so their number grows with the corpus, have vectors of
their own; the others fall into ``KINDS`` kinds by their last two bytes, which have
vectors too. Own words are dealt into clusters of equal size, about the square root of
their number, by the company they keep: each word's neighbours are summed up as random
vectors, and the words are halved again and again at the median of the principal axis.

The model predicts, from the two tokens before, first the cluster, the kind, or the end,
and within a cluster the word: the score of an outcome is the dot product of its vector
with the sum of the two contexts' position-dependent vectors, plus a bias. Both steps are
trained on every training token by noise-contrastive estimation, the noise being the
unigram distribution of the outcomes at hand, and both are normalised when scoring, by
matrix products over batches of tokens. A word without a vector of its own gets its
kind's probability times its smoothed share of the kind, with one share kept for unknown
words.

Training does not depend on how the table is partitioned: documents are dealt by a hash
of their tokens, first a part of about ``GROUP`` tokens from which one task makes a start,
then groups of about as many tokens, in hash order, each trained from that start in a task
of its own. The groups' parameters are averaged by their tokens. A group has at least
``SHARE`` tokens a parameter of the model, so the parameters that are shuffled to be
averaged stay in proportion to the tokens, however large corpus and vocabulary are.

Defined results: null and empty texts are the end alone; very long texts are one document
and read whole; rows with a null doc_id train and are not held out; equal rows count each;
of equally frequent words those with the smaller hash come first; extra columns are
ignored; an empty table gives no rows; without any training token the counts are 0 and the
model is uniform.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import memo
from lodestone.llm.common import only, settle
from lodestone.llm.wordhash import characters, mix, slices, word_hashes

OWN, GROWTH, KINDS, DIMENSION = 4, 0.4, 64, 16
#: Frequent words whose counts every worker holds (all own words at least); the counts of the others are joined.
HELD = 200_000
NOISE, BATCH, RATE, SCALE = 32, 4096, 0.05, 100 / 4096
#: Tokens of a training group at least, and at least for each parameter of the model.
GROUP, SHARE = 1 << 21, 2
#: Tokens that are shuffled before they are trained on, and that are scored at once.
BLOCK, SCORED = 1 << 17, 1 << 14
FLUSH = 1 << 21
#: Dimension of the sums of neighbours, and parameters in a row when models are averaged.
COMPANY, CHUNK = 16, 1024


def words_of(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, hashes, kinds, where each text's words begin and one entry more) of runs of texts."""
    memo.use("lm")
    for lo, hi in slices(texts):
        own = [(t or "").encode().lower() for t in texts[lo:hi]]
        codes, space, start = characters(b"\n".join(own) + b"\n" if own else b"")
        at = np.searchsorted(start, np.cumsum([0] + [len(t) + 1 for t in own]))
        ends = np.flatnonzero(~space[:-1] & space[1:])
        tail = codes[ends].astype(np.uint64) | np.where(ends > start, codes[ends - 1], 0).astype(np.uint64) << np.uint64(8)
        yield lo, word_hashes(codes, space, start)[0], (mix(tail + np.uint64(1)) % np.uint64(KINDS)).astype(np.int64), at


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, kinds, n = (np.concatenate(x) for x in zip(*waiting))
        key, first, own = np.unique(keys, return_index=True, return_inverse=True)
        return key, kinds[first], np.bincount(own, n, len(key)).astype(np.int64)

    def out() -> pa.RecordBatch:
        key, kind, n = merged() if waiting else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        waiting.clear()
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(kind.astype(np.int32)), pa.array(n)], ["key", "kind", "n"])

    size = 0
    for batch in batches:
        for _, keys, kinds, _ in words_of(batch.column(0).to_pylist()):
            waiting.append((keys, kinds, np.ones(len(keys), np.int64)))
            size += len(keys)
            if size > FLUSH:
                waiting[:] = [merged()]
                size = len(waiting[0][0])
                if 2 * size > FLUSH:
                    yield out()
                    size = 0
    yield out()


@dataclass
class Vocabulary:
    """What every worker holds."""

    keys: np.ndarray  # hashes of the held words, the most frequent first
    counts: np.ndarray
    kinds: np.ndarray
    tokens: int  # N, ends included
    distinct: int  # V, the end included
    ends: int  # training documents
    mass: np.ndarray  # of each kind: sum of c + 0.1 over its words without a vector of their own, and 0.1
    own: int  # held words with a vector of their own
    cluster: np.ndarray | None = None  # of each own word
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __post_init__(self):
        self.end, self.begin = self.own + KINDS, self.own + KINDS + 1
        self.set_clusters(np.zeros(self.own, np.int64) if self.cluster is None else self.cluster)

    def set_clusters(self, cluster: np.ndarray) -> Vocabulary:
        self.cluster = cluster
        self.clusters = int(cluster.max()) + 1 if self.own else 0
        self.outcomes = self.clusters + KINDS + 1
        # The outcome of each symbol, and the own words of each cluster.
        self.outcome = np.concatenate([cluster, self.clusters + np.arange(KINDS + 1)])
        self.members = np.split(np.argsort(cluster, kind="stable"), np.cumsum(np.bincount(cluster, minlength=self.clusters))[:-1]) if self.own else []
        return self

    def open(self) -> Vocabulary:
        """Adds what is rebuilt in each worker: a table from the first bits of a hash to its place."""
        order = np.argsort(self.keys)
        self.sorted, self.place = np.append(self.keys[order], np.uint64((1 << 64) - 1)), np.append(order, -1)
        self.shift = np.uint64(64 - max(8, min(22, int(len(order)).bit_length() + 1)))
        self.head = np.searchsorted(self.sorted[:-1], np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift)
        self.log_count = np.log10(self.counts + 0.1)
        return self

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Places among the held words, -1 for others."""
        at = self.head[(keys >> self.shift).astype(np.int64)]
        behind = np.flatnonzero(self.sorted[at] < keys)
        while len(behind):
            at[behind] += 1
            behind = behind[self.sorted[at[behind]] < keys[behind]]
        return np.where((self.sorted[at] == keys) & (at < len(self.keys)), self.place[at], -1)

    def symbol_counts(self) -> np.ndarray:
        """How often each symbol but the begin is a training token, smoothed."""
        return np.concatenate([self.counts[: self.own], np.maximum(self.mass - 0.1, 0), [self.ends]]) + 0.1


def count_words(train: DataFrame) -> tuple[DataFrame, Vocabulary]:
    """key, kind, n of all training words as a settled table, and the vocabulary."""
    counts = settle(only(train, "text").mapInArrow(_count, "key long, kind int, n long").groupBy("key").agg(F.first("kind").alias("kind"), F.sum("n").alias("n")))
    ends = train.count()
    sums = {r["kind"]: r for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).collect()}
    tokens = sum(r["n"] for r in sums.values()) + ends
    own = math.ceil(OWN * tokens**GROWTH)
    # The least count of the held words, from a histogram with a bounded number of steps: no task sends more than the held words.
    step = F.floor(F.log2("n") * 64).alias("step")
    least, room = None, max(HELD, own)
    for r in sorted(counts.groupBy(step).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).collect(), key=lambda r: -r["step"]):
        room -= r["words"]
        if room < 0:
            break
        least = r["least"]
    top = counts.filter(F.col("n") >= least if least else F.lit(False)).toArrow()
    keys, kinds, n = top["key"].to_numpy().view(np.uint64), top["kind"].to_numpy().astype(np.int64), top["n"].to_numpy()
    order = np.lexsort((keys, -n))
    keys, kinds, n = keys[order], kinds[order], n[order]
    own = min(own, len(keys))
    total, types = np.zeros(KINDS), np.zeros(KINDS)
    for k, r in sums.items():
        total[k], types[k] = r["n"], r["types"]
    total -= np.bincount(kinds[:own], n[:own], KINDS)
    types -= np.bincount(kinds[:own], minlength=KINDS)
    distinct = sum(r["types"] for r in sums.values()) + (ends > 0)
    return counts, Vocabulary(keys, n, kinds, tokens, distinct, ends, total + 0.1 * types + 0.1, own)


_opened: dict[str, Vocabulary] = {}


def _open(v: Vocabulary) -> Vocabulary:
    if v.name not in _opened:
        _opened.clear()
        _opened[v.name] = v.open()
    return _opened[v.name]


ENCODED = "doc_id long, held_out boolean, uid long, n_tokens long, n_known long, counted double, shares double, symbols binary, rare array<long>"


def encode(marked: DataFrame, v: Vocabulary) -> DataFrame:
    """ENCODED of every document. symbols: 32-bit, the end last; counted and shares: what the held words add to the base
    and to the model's score; rare: the hashes of the words whose counts are not held."""
    held = marked.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _open(held.value)
        part, nth, log_mass = TaskContext.get().partitionId(), 0, np.log10(v.mass)
        for batch in batches:
            for lo, keys, kinds, at in words_of(batch.column(2).to_pylist()):
                n, sizes = len(at) - 1, np.diff(at)
                text = np.repeat(np.arange(n), sizes)
                place = v.places(keys)
                known, own = place >= 0, (place >= 0) & (place < v.own)
                logs = v.log_count[place] if len(v.log_count) else np.zeros(len(place))
                sums = lambda x, where: np.bincount(text[where], x[where], n)
                symbols = np.full(len(keys) + n, v.end, "<i4")
                symbols[np.arange(len(keys)) + text] = np.where(own, place, v.own + kinds)
                edge = 4 * (at + np.arange(n + 1))
                raw = symbols.tobytes()
                rare = keys[~known].view(np.int64)
                rare_at = np.append(0, np.cumsum(np.bincount(text[~known], minlength=n))).astype(np.int32)
                arrays = [
                    batch.column(0).cast(pa.int64()).slice(lo, n), batch.column(1).slice(lo, n), pa.array((part << 33) + nth + np.arange(n)), pa.array(sizes + 1),
                    pa.array(np.bincount(text[known], minlength=n) + int(v.ends > 0)), pa.array(sums(logs, known) + math.log10(v.ends + 0.1)),
                    pa.array(sums(logs, known & ~own) - np.bincount(text[~own], log_mass[kinds[~own]], n)),
                    pa.array([raw[a:b] for a, b in zip(edge, edge[1:])], pa.binary()), pa.ListArray.from_arrays(pa.array(rare_at), pa.array(rare)),
                ]
                nth += n
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "uid", "n_tokens", "n_known", "counted", "shares", "symbols", "rare"])

    return settle(marked.mapInArrow(run, ENCODED))


def contexts(symbols: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the tokens of several documents: the token before, the one before that, the token, and the documents' first tokens."""
    sizes = np.array([len(x) // 4 for x in symbols], np.int64)
    s = np.frombuffer(b"".join(symbols), "<i4").astype(np.int64)
    first = np.cumsum(sizes) - sizes
    before, before2 = np.roll(s, 1), np.roll(s, 2)
    before[first] = before2[first] = v.begin
    before2[(first + 1)[sizes > 1]] = v.begin
    return before, before2, s, first


def company(train: DataFrame, v: Vocabulary) -> np.ndarray:
    """The mean of the random vectors of each own word's neighbours, those before and those after."""
    held = train.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held.value
        vectors = np.random.default_rng(3).choice([-1.0, 1.0], (2, v.begin + 1, COMPANY // 2))
        sums = np.zeros((v.own, COMPANY))
        for batch in batches:
            before, _, s, first = contexts(batch.column(0).to_pylist(), v)
            after = np.roll(s, -1)
            after[first - 1] = v.end
            mine = np.flatnonzero(s < v.own)
            for side, near in enumerate((before, after)):
                for k in range(COMPANY // 2):
                    sums[:, side * COMPANY // 2 + k] += np.bincount(s[mine], vectors[side][near[mine], k], v.own)
        yield from _rows(sums.ravel(), 1)

    total, _ = _summed(train.select("symbols").mapInArrow(run, CHUNKS))
    return total.reshape(v.own, COMPANY) / v.counts[: v.own, None] if len(total) else np.zeros((v.own, COMPANY))


def clusters_of(signs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A cluster of each own word: halves at the median of the principal axis, down to about the square root of their number."""
    n = len(signs)
    out = np.zeros(n, np.int64)
    whole = [np.arange(n)]
    for _ in range(max(0, round(math.log2(max(1, n)) / 2))):
        halves = []
        for own in whole:
            x = signs[own] - signs[own].mean(axis=0)
            w = np.minimum(counts[own], 1000)[:, None]
            axis = np.linalg.eigh((x * w).T @ x)[1][:, -1]
            axis = axis * np.sign(axis[np.abs(axis).argmax()])
            order = np.argsort(np.round(x @ axis, 9), kind="stable")
            halves += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
        whole = [h for h in halves if len(h)]
    for k, own in enumerate(whole):
        out[own] = k
    return out


CHUNKS = "chunk int, weight double, v binary"


def _rows(flat: np.ndarray, weight: float) -> Iterator[pa.RecordBatch]:
    """Parameters in rows of CHUNK, times a weight."""
    parts = [(flat[k : k + CHUNK] * weight).astype("<f8").tobytes() for k in range(0, len(flat), CHUNK)]
    yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([float(weight)] * len(parts), pa.float64()), pa.array(parts, pa.binary())], ["chunk", "weight", "v"])


def _summed(rows: DataFrame) -> tuple[np.ndarray, float]:
    """The sum of all tasks' parameters, and of their weights. A chunk has one row a task at most."""

    def add(group: pa.Table) -> pa.Table:
        order = np.argsort([x.as_py() for x in group.column("v")])  # one order of addition, whatever order rows come in
        total = np.zeros(len(group.column("v")[0].as_py()) // 8)
        for k in order.tolist():
            total += np.frombuffer(group.column("v")[k].as_py(), "<f8")
        return pa.table({"chunk": group.column("chunk")[:1], "weight": pa.array([math.fsum(group.column("weight").to_pylist())]), "v": pa.array([total.tobytes()], pa.binary())})

    got = rows.groupBy("chunk").applyInArrow(add, CHUNKS).toArrow().sort_by("chunk")
    return np.frombuffer(b"".join(got["v"].to_pylist()), "<f8"), got["weight"][0].as_py() if got.num_rows else 0.0


class Model:
    """context[0] is for the token before, context[1] for the one before that; outcome and word: vectors of clusters, kinds
    and end, and of words, their biases as the last place."""

    def __init__(self, v: Vocabulary, seed: int = 5):
        r, count = np.random.default_rng(seed), v.symbol_counts()
        normal = lambda *shape: (r.standard_normal(shape) * 0.1).astype(np.float32)
        self.v = v
        self.context, self.outcome, self.word = normal(2, v.begin + 1, DIMENSION), normal(v.outcomes, DIMENSION + 1), normal(v.own, DIMENSION + 1)
        top = np.bincount(v.outcome, count, v.outcomes)
        self.noise = top / top.sum()
        self.word_noise = [count[m] / count[m].sum() for m in v.members]
        self.outcome[:, -1] = np.log(self.noise)
        for m, p in zip(v.members, self.word_noise):
            self.word[m, -1] = np.log(p)
        self.past = [np.full_like(x, 0.1) for x in self.parameters()]

    def parameters(self) -> list[np.ndarray]:
        return [self.context[0], self.context[1], self.outcome, self.word]

    def given(self, before: np.ndarray, before2: np.ndarray) -> np.ndarray:
        """The sum of the contexts' vectors, and 1 for the bias."""
        out = np.ones((len(before), DIMENSION + 1), np.float32)
        np.add(self.context[0][before], self.context[1][before2], out=out[:, :DIMENSION])
        return out

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parameters() + self.past]).astype(np.float64)

    def load(self, flat: np.ndarray) -> Model:
        at = 0
        for x in self.parameters() + self.past:
            x[...] = flat[at : at + x.size].reshape(x.shape)
            at += x.size
        return self

    def logs(self, before: np.ndarray, before2: np.ndarray, s: np.ndarray) -> np.ndarray:
        """log10 probabilities of tokens, normalised over all outcomes and over all words of the cluster."""
        v = self.v
        given, aim = self.given(before, before2), v.outcome[s]
        out = _log_share(given, self.outcome, aim)
        order = np.argsort(np.minimum(aim, v.clusters).astype(np.int16 if v.clusters < 1 << 15 else np.int64), kind="stable")
        edges = np.searchsorted(aim[order], np.arange(v.clusters + 1))
        for k, members in enumerate(v.members):
            own = order[edges[k] : edges[k + 1]]
            if len(own):
                out[own] += _log_share(given[own], self.word[members], np.searchsorted(members, s[own]))
        return out / math.log(10)


def _log_share(given: np.ndarray, vectors: np.ndarray, aim: np.ndarray) -> np.ndarray:
    """The log of the aim's share among the outcomes with these vectors, the bias being their last place."""
    z = given @ vectors.T
    own = z[np.arange(len(aim)), aim]
    with np.errstate(over="ignore"):
        total = np.exp(z, out=z).sum(axis=1)
    out = own - np.log(total)
    odd = np.flatnonzero(~((total > 1e-30) & (total < 1e30)))  # out of the range of exp: by the largest
    if len(odd):
        z = given[odd] @ vectors.T
        high = z.max(axis=1)
        out[odd] = own[odd] - high - np.log(np.exp(z - high[:, None]).sum(axis=1))
    return out


def _grouped(rows: np.ndarray, values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, all below most, and the sums of their values."""
    order = np.argsort(rows.astype(np.uint16) if most <= 1 << 16 else rows, kind="stable")
    own = rows[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    return own[first], np.add.reduceat(values[order], first, axis=0)


class Trainer:
    """Adagrad on the noise-contrastive objective; only the rows at hand are touched."""

    def __init__(self, model: Model, seed: int):
        self.m, self.r = model, np.random.default_rng(seed)
        self.top = self._noise(model.noise)
        self.inner = [self._noise(p) for p in model.word_noise]

    @staticmethod
    def _noise(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.cumsum(p), np.log(NOISE * p).astype(np.float32)

    def _move(self, k: int, rows: np.ndarray, values: np.ndarray) -> None:
        x, past = self.m.parameters()[k], self.m.past[k]
        rows, g = _grouped(rows, values, len(x))
        g *= SCALE
        new = past[rows] + g * g
        past[rows] = new
        x[rows] -= RATE * g / np.sqrt(new)

    def step(self, before: np.ndarray, before2: np.ndarray, target: np.ndarray, k: int, noise: tuple[np.ndarray, np.ndarray], names: np.ndarray | None = None) -> None:
        """k: the place of the targets' vectors among the parameters; names: the rows of the noise's outcomes there."""
        m, (cdf, log_noise) = self.m, noise
        vectors, given = m.parameters()[k], m.given(before, before2)
        drawn = np.minimum(np.searchsorted(cdf, self.r.random(NOISE) * cdf[-1]), len(cdf) - 1)
        rows, others = (target, drawn) if names is None else (names[target], names[drawn])
        aimed, away = vectors[rows], vectors[others]
        true = np.einsum("bd,bd->b", given, aimed) - log_noise[target]
        false = given @ away.T
        false -= log_noise[drawn]
        d_true = -1 / (1 + np.exp(np.clip(true, -20, 20)))
        np.clip(np.negative(false, out=false), -20, 20, out=false)
        np.exp(false, out=false)
        false += 1
        d_false = np.reciprocal(false, out=false)
        d_given = d_false @ away
        d_given += d_true[:, None] * aimed
        d_given = d_given[:, :DIMENSION]
        self._move(k, np.concatenate([rows, others]), np.concatenate([d_true[:, None] * given, d_false.T @ given]))
        self._move(0, before, d_given)
        self._move(1, before2, d_given)

    def block(self, symbols: list[bytes]) -> None:
        v = self.m.v
        before, before2, s, _ = contexts(symbols, v)
        order = self.r.permutation(len(s))
        for lo in range(0, len(order), BATCH):
            own = order[lo : lo + BATCH]
            self.step(before[own], before2[own], v.outcome[s[own]], 2, self.top)
        order = order[s[order] < v.own]
        order = order[np.argsort(v.cluster[s[order]], kind="stable")]
        edges = np.searchsorted(v.cluster[s[order]], np.arange(v.clusters + 1))
        for k in self.r.permutation(v.clusters).tolist():
            if len(v.members[k]) > 1:
                for lo in range(edges[k], edges[k + 1], BATCH):
                    own = order[lo : min(lo + BATCH, edges[k + 1])]
                    self.step(before[own], before2[own], np.searchsorted(v.members[k], s[own]), 3, self.inner[k], v.members[k])


def _trained(dealt: DataFrame, v: Vocabulary, start: np.ndarray | None) -> np.ndarray | None:
    """The average of the models of the groups g of (g, h, symbols), each trained from the start in the order of h."""
    held = dealt.sparkSession.sparkContext.broadcast((v, start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, start = held.value
        trainer, group, tokens, waiting, size = None, None, 0, [], 0
        for batch in batches:
            for g, symbols in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if g != group:
                    if group is not None:
                        if waiting:
                            trainer.block(waiting)
                        yield from _rows(trainer.m.flat(), tokens)
                    model = Model(v)
                    trainer, group, tokens, waiting, size = Trainer(model if start is None else model.load(start), g), g, 0, [], 0
                waiting.append(symbols)
                size += len(symbols) // 4
                tokens += len(symbols) // 4
                if size >= BLOCK:
                    trainer.block(waiting)
                    waiting, size = [], 0
        if group is not None:
            if waiting:
                trainer.block(waiting)
            yield from _rows(trainer.m.flat(), tokens)

    total, weight = _summed(dealt.select("g", "symbols").mapInArrow(run, CHUNKS))
    return total / weight if weight else start


def groups_of(tokens: int, parameters: int) -> int:
    """How many groups train beside the first part."""
    return max(1, round(tokens / max(GROUP, SHARE * parameters)) - 1)


def train_model(train: DataFrame, v: Vocabulary) -> Model:
    """train: symbols. A model trained on all of them, whatever their partitions."""
    groups = groups_of(v.tokens, Model(v).flat().size)
    hashed = train.select(F.xxhash64("symbols").alias("h"), "symbols")
    # The first part is a share of the hashes; of what is left each group has as large a share.
    edge = int(min(1.0, GROUP / max(1, v.tokens)) * 2.0**20)
    spot = F.pmod(F.col("h"), F.lit(1 << 20))
    # Chosen in the tasks that scan; only the first part, about GROUP tokens, goes to one task.
    first = hashed.filter(spot < edge).select(F.lit(0).cast("long").alias("g"), "h", "symbols").repartition(1).sortWithinPartitions("h", "symbols")
    start = _trained(first, v, None)
    rest = hashed.filter(spot >= edge).select((1 + F.pmod(F.shiftright("h", 20), F.lit(groups))).alias("g"), "h", "symbols")
    flat = _trained(rest.repartitionByRange(groups, "g").sortWithinPartitions("g", "h", "symbols"), v, start) if edge < 1 << 20 else start
    return Model(v) if flat is None else Model(v).load(flat)


_ready: dict[str, Model] = {}


def score(each: DataFrame, counts: DataFrame, v: Vocabulary, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of encoded documents."""
    held = each.sparkSession.sparkContext.broadcast((v, model.flat().astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, flat = held.value
        if v.name not in _ready:
            _ready.clear()
            _ready[v.name] = Model(v).load(flat)
        m = _ready[v.name]
        for batch in batches:
            before, before2, s, first = contexts(batch.column("symbols").to_pylist(), v)
            logs = np.concatenate([m.logs(before[k : k + SCORED], before2[k : k + SCORED], s[k : k + SCORED]) for k in range(0, len(s), SCORED)] or [np.zeros(0)]).astype(np.float64)
            own = np.add.reduceat(logs, first) if len(first) else logs
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(6)] + [pa.array(own + batch.column("shares").to_numpy())], [*batch.schema.names[:6], "bilinear"])

    scored = each.select("doc_id", "held_out", "uid", "n_tokens", "n_known", "counted", "shares", "symbols").mapInArrow(run, "doc_id long, held_out boolean, uid long, n_tokens long, n_known long, counted double, bilinear double")
    # Words beyond the held ones: one row a document and distinct word meets the word's count.
    beyond = each.select("uid", F.explode("rare").alias("key")).groupBy("key", "uid").agg(F.count(F.lit(1)).alias("times"))
    met = beyond.join(counts.select("key", F.col("n").alias("c")), "key", "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    rare = met.groupBy("uid").agg(F.sum(F.col("times") * F.log10(c + 0.1)).alias("rare_log"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    log = F.coalesce(F.col("rare_log"), F.lit(0.0))
    per_token = math.log10(v.tokens + 0.1 * (v.distinct + 1))
    return scored.join(rare, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("counted") + log - F.col("n_tokens") * F.lit(per_token)).alias("base_score"), (F.col("bilinear") + log).alias("score"),
    )


def learn_and_score(docs: DataFrame) -> DataFrame:
    """Learns from the documents whose crc32(doc_id as text) mod 10 is not 0 and scores all."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False)).alias("held_out")
    marked = only(docs, "doc_id", "text").select("doc_id", held, "text")
    counts, v = count_words(marked.filter(~F.col("held_out")))
    each = encode(marked, v)
    train = each.filter(~F.col("held_out")).select("symbols")
    v.set_clusters(clusters_of(company(train, v), v.counts[: v.own]))
    v.name = uuid.uuid4().hex
    return score(each, counts, v, train_model(train, v))
