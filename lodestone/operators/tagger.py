"""A trained entity tagger: a linear chain over hashed token features.

The score of a labelling is the sum of each token's feature weights under its label and of
the weights of neighbouring labels; the best one is found by Viterbi's algorithm, and only
labellings in which I follows B or I of its kind are possible. Weights are learned by the
structured perceptron with iterative parameter mixing: records are dealt to shards by a
hash of their id, in each epoch every shard starts from the common weights, and the mean of
the shards' changes is added to them. Changes are whole numbers, so sums don't depend on
their order, and nothing depends on how the rows were partitioned. What reaches the driver
is at most one number a weight.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import patterns as P
from lodestone.operators.annotate import Tokenizer, words_tokenizer

#: Rows of the weight table that features are hashed to.
FEATURES = 1 << 14
#: Tokens that are decoded together, and how many of them the next window has again.
WINDOW, STRIDE = 512, 128
#: Windows that are decoded side by side, and shards that a task learns from side by side.
TOGETHER, SHARDS = 256, 16


def shape(word: str) -> str:
    """Letters as a or A, digits as 0, other marks as they are, runs as at most three; a number's shape is its length."""
    if word.isdigit():
        return f"0{min(len(word), 20)}"
    return _runs(r"\1\1\1", "".join(map(_kinds.__getitem__, word)))


class _Kinds(dict):
    def __missing__(self, c: str) -> str:
        self[c] = kind = "0" if re.match(r"\d", c) else c if not re.match(r"[^\W_]", c) else "A" if c.isupper() else "a"
        return kind


_kinds, _runs = _Kinds(), re.compile(r"(.)\1{3,}").sub


class _Held(dict):
    """Of each distinct token its number, and by number what features need of it. Features read at most two words or three
    shapes, so nearly all come from tables; a worker keeps what it has made."""

    def __init__(self):
        self.bytes: list[bytes] = []
        self.form_of: dict[str, int] = {}
        self.forms: list[str] = []
        #: By number: w, p, e, L and R of both spaces, the checksum before the second word of v for both spaces, the shape.
        self.words = np.zeros((1024, 10), np.int64)
        #: By shape: s, s of the spaces around, l and r of both spaces.
        self.shapes = np.zeros((64, 9), np.int64)
        self.triples = _Triples(self.forms)
        self[""]

    def __missing__(self, token: str) -> int:
        k, word, form = len(self), token.lower(), shape(token)
        if form not in self.form_of:
            f = self.form_of[form] = len(self.forms)
            self.forms.append(form)
            if f == len(self.shapes):
                self.shapes = np.vstack([self.shapes, np.zeros_like(self.shapes)])
            self.shapes[f] = [_row(x) for x in (f"4s{form}", *(f"5s{b}{form}{a}" for b in " ~" for a in " ~"), *(f"6l{b}{form}" for b in " ~"), *(f"7r{a}{form}" for a in " ~"))]
        if k == len(self.words):
            self.words = np.vstack([self.words, np.zeros_like(self.words)])
        own = (f"1w{word}", f"2p{word[:3]}", f"3e{word[-3:]}", *(f"8L{b}{word}" for b in " ~"), *(f"9R{a}{word}" for a in " ~"))
        self.words[k] = [*map(_row, own), *(zlib.crc32(f"13v{word}{b}".encode()) for b in " ~"), self.form_of[form]]
        self.bytes.append(word.encode())
        self[token] = k
        return k


class _Triples(dict):
    """Rows of three shapes and the spaces between, by (kind, shapes, spaces) as one number."""

    def __init__(self, forms: list[str]):
        self.forms = forms

    def __missing__(self, key: int) -> int:
        (kind, after, before), (a, b, c) = (key >> 2 & 3, " ~"[key >> 1 & 1], " ~"[key & 1]), (self.forms[key >> k & _SHAPE] for k in (44, 24, 4))
        self[key] = found = _row((f"10b{a}{before}{b} {c}", f"11a{a} {b}{after}{c}", f"12c{a}{before}{b}{after}{c}")[kind])
        return found


def _row(feature: str) -> int:
    return zlib.crc32(feature.encode()) % FEATURES


_SHAPE = (1 << 20) - 1
#: Distinct tokens, and triples of shapes, after which a worker begins anew with the next text.
MEMO = 1 << 17
_held = _Held()


def features(tokens: list[tuple[str, int, int, int]]) -> np.ndarray:
    """Rows of the weight table that each token with a width reads: of itself, its neighbours and the spaces between."""
    global _held
    if len(_held) > MEMO or len(_held.triples) > MEMO:
        _held = _Held()
    h, n = _held, len(tokens)
    out = np.empty((n, 14), np.int64)
    if not n:
        return out
    at = np.zeros(n + 4, np.int64)
    at[2:-2] = [h[t[0]] for t in tokens]
    glued = np.zeros(n + 1, np.int64)
    glued[1:-1] = [a[2] == b[1] for a, b in zip(tokens, tokens[1:])]
    before, after = glued[:-1], glued[1:]
    words, place = h.words[at], np.arange(2, n + 2)
    form = words[:, 9]
    shapes = h.shapes[form]
    triple = lambda kind, k, spaces: list(map(h.triples.__getitem__, ((form[place + k] << 44) + (form[place + k + 1] << 24) + (form[place + k + 2] << 4) + (kind << 2) + spaces).tolist()))
    out[:, 0] = _row("0")
    out[:, 1:4] = words[place, :3]
    out[:, 4] = shapes[place, 0]
    out[:, 5] = shapes[place, 1 + 2 * before + after]
    out[:, 6] = shapes[place - 1, 5 + before]
    out[:, 7] = shapes[place + 1, 7 + after]
    out[:, 8] = words[place - 1, 3 + before]
    out[:, 9] = words[place + 1, 5 + after]
    out[:, 10] = triple(0, -2, before)
    out[:, 11] = triple(1, 0, 2 * after)
    out[:, 12] = triple(2, -1, 2 * after + before)
    out[:, 13] = list(map(zlib.crc32, [h.bytes[k] for k in at[2:-2].tolist()], words[place - 1, 7 + before].tolist()))
    out[:, 13] %= FEATURES
    return out


def viterbi(emission: np.ndarray, transition: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The labels with the greatest sum of first[label], emission[token, label] and transition[label, next label]; of equal ones the least labels from the end on."""
    n = len(emission)
    if not n:
        return np.zeros(0, np.int64)
    score, back = first + emission[0], np.zeros((n, len(first)), np.int64)
    into, all_ = np.ascontiguousarray(transition.T), np.empty(transition.shape)
    for i in range(1, n):
        np.add(into, score, out=all_)
        all_.argmax(axis=1, out=back[i])
        score = np.maximum.reduce(all_, axis=1)
        score += emission[i]
    out = np.empty(n, np.int64)
    out[-1] = score.argmax()
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def viterbi_all(emissions: list[np.ndarray], transitions: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """What viterbi gives of each, token by token of all side by side; transitions: of all, or one matrix each."""
    order = sorted(range(len(emissions)), key=lambda k: -len(emissions[k]))
    sizes = np.array([len(emissions[k]) for k in order])
    if not len(sizes):
        return []
    own = np.zeros((sizes[0], len(order), len(first)))
    for k, e in enumerate(order):
        own[: sizes[k], k] = emissions[e]
    into = np.ascontiguousarray(np.swapaxes(transitions, -1, -2))
    into = into[order] if into.ndim == 3 else np.broadcast_to(into, (len(order), *into.shape))
    longer = (sizes[None, :] > np.arange(sizes[0])[:, None]).sum(axis=1).tolist()
    back, all_ = np.zeros(own.shape, np.int64), np.empty(into.shape)
    score = first + own[:1].reshape(len(order), len(first)) if sizes[0] else np.zeros((len(order), len(first)))
    for i in range(1, sizes[0]):
        m = longer[i]
        np.add(score[:m, None], into[:m], out=all_[:m])
        all_[:m].argmax(axis=2, out=back[i, :m])
        np.maximum.reduce(all_[:m], axis=2, out=score[:m])
        score[:m] += own[i, :m]
    out, last, row = np.empty((sizes[0], len(order)), np.int64), score.argmax(axis=1), np.arange(len(order))
    for i in range(sizes[0] - 1, 0, -1):
        m = longer[i]
        out[i, :m] = last[:m]
        last[:m] = back[i, row[:m], last[:m]]
    out[:1] = last
    found = [np.zeros(0, np.int64)] * len(order)
    for k, e in enumerate(order):
        found[e] = out[: sizes[k], k]
    return found


def rules(labels: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Zero for what may follow what, and for what may begin; else minus infinity."""
    follows = np.array([[0.0 if not b.startswith("I-") or a[2:] == b[2:] and a != "O" else -np.inf for b in labels] for a in labels])
    return follows, np.array([-np.inf if b.startswith("I-") else 0.0 for b in labels])


def spans(chosen: np.ndarray, labels: list[str]) -> Iterator[tuple[int, int, str]]:
    """(first token, token after the last, label) of the entities of a labelling."""
    begins, inner = (np.array([x.startswith(p) for x in labels])[chosen] for p in ("B-", "I-"))
    for start in np.flatnonzero(begins).tolist():
        rest = np.flatnonzero(~inner[start + 1 :])
        yield start, start + 1 + int(rest[0]) if len(rest) else len(chosen), labels[chosen[start]][2:]


@dataclass
class LinearTagger:
    """An EntityTagger (E17). Long texts are decoded window by window; an entity is taken from the window in whose inner part
    it begins, so windows give what the whole would, for entities up to half the stride."""

    weights: np.ndarray
    transitions: np.ndarray
    labels: list[str] = field(default_factory=lambda: list(P.BIO_LABELS))
    tokenizer: Tokenizer = words_tokenizer
    window: int = WINDOW
    stride: int = STRIDE

    def __post_init__(self):
        if not 0 < self.stride < self.window:
            raise ValueError("a window is longer than its stride")
        self.follows, self.first = rules(self.labels)

    def decode(self, found: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each window, from its tokens' features: labels, and their emissions."""
        emissions = [self.weights[x].sum(axis=1) for x in found]
        yield from zip(viterbi_all(emissions, self.transitions + self.follows, self.first), emissions)

    def tag(self, texts: list[str]) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in texts]
        held, edge = [], self.stride // 2
        for k, text in enumerate(texts):
            tokens = [t for t in self.tokenizer(text) if t[1] < t[2]]
            found, n, lo = features(tokens), len(tokens), 0
            while n:
                hi = min(lo + self.window, n)
                held.append((k, tokens, lo, hi, found[lo:hi]))
                if len(held) == TOGETHER:
                    self._add(texts, held, edge, out)
                    held = []
                if hi == n:
                    break
                lo += self.window - self.stride
        self._add(texts, held, edge, out)
        return out

    def _add(self, texts: list[str], held: list[tuple], edge: int, out: list[list[dict]]) -> None:
        """The entities of some windows (text, its tokens, first and last place, features) go to their texts."""
        for (k, tokens, lo, hi, _), (chosen, emission) in zip(held, self.decode([x[-1] for x in held])):
            text, n = texts[k], len(tokens)
            for a, b, label in spans(chosen, self.labels):
                if (lo == 0 or a >= edge) and (hi == n or a < hi - lo - (self.stride - edge)):
                    start, end = tokens[lo + a][1], tokens[lo + b - 1][2]
                    # Subword pieces hold the space before a word; an entity doesn't begin with it.
                    start = min(end, start + len(text[start:end]) - len(text[start:end].lstrip()))
                    if start == end:
                        continue
                    odds = np.exp(emission[a:b] - emission[a:b].max(axis=1, keepdims=True))
                    sure = (odds / odds.sum(axis=1, keepdims=True))[np.arange(b - a), chosen[a:b]]
                    out[k].append({"text": text[start:end], "label": label, "start": start, "end": end, "score": float(sure.mean())})


@dataclass
class Trainer:
    """Fits a LinearTagger to aligned records (A20): rows of annotate.align, with split where a part is for development."""

    epochs: int = 10
    #: Records of a shard, about: fewer give changes that say little, more take longer one after the other.
    per_shard: int = 256
    labels: list[str] = field(default_factory=lambda: list(P.BIO_LABELS))
    tokenizer: Tokenizer = words_tokenizer

    def fit(self, rows: DataFrame) -> LinearTagger:
        """Rows without a text or with another number of tokens than labels are left out. No rows: all weights are zero."""
        spark, size = rows.sparkSession, len(self.labels)
        train = rows.filter("split = 'train'") if "split" in rows.columns else rows
        # Each shard's records in one order, their features made once: 28 bytes a token, on disk where memory ends. A task
        # has some shards and takes them a record of each at a time.
        given = train.select("id", "text", "labels").filter("text is not null and labels is not null")
        shards = -(-max(1, given.count()) // self.per_shard)
        some = max(1, min(SHARDS, shards // spark.sparkContext.defaultParallelism))
        named = given.withColumn("shard", F.pmod(F.hash("id"), F.lit(shards)))
        dealt = named.repartitionById(-(-shards // some), F.floor(F.col("shard") / some).cast("int")).sortWithinPartitions("shard", "id", "text")
        dealt = dealt.select("shard", "text", "labels").mapInPandas(self._prepared(), "shard int, place int, found binary, gold binary")
        dealt = dealt.sortWithinPartitions("place", "shard").persist(StorageLevel.MEMORY_AND_DISK)
        emission, transition = np.zeros((FEATURES, size)), np.zeros((size, size))
        total = [np.zeros_like(emission), np.zeros_like(transition)]
        for _ in range(self.epochs):
            epoch = spark.sparkContext.broadcast((emission, transition))
            changes = dealt.mapInPandas(self._epoch(epoch), "shards long, spot long, change long").groupBy("spot").agg(F.sum("change").alias("change"), F.sum("shards").alias("shards")).toPandas()
            used = max(1, int(changes["shards"].sum()))
            flat = np.zeros(emission.size + transition.size)  # spot -1 only counts the shards
            real = changes[changes["spot"] >= 0]
            flat[real["spot"].to_numpy(np.int64)] = real["change"].to_numpy(np.int64) / used
            emission, transition = emission + flat[: emission.size].reshape(emission.shape), transition + flat[emission.size :].reshape(transition.shape)
            total = [total[0] + emission, total[1] + transition]
            epoch.unpersist()
            if not len(real):
                total = [emission * self.epochs, transition * self.epochs]  # nothing is wrong any more
                break
        dealt.unpersist()
        return LinearTagger((total[0] / self.epochs).astype(np.float32), (total[1] / self.epochs).astype(np.float32), self.labels, self.tokenizer)

    def _prepared(self):
        """A function of records that gives each token's features and label; as many rows at a time as have few tokens."""
        tokenizer = self.tokenizer

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            last, place = None, 0
            for part in parts:
                rows, size = [], 0
                for shard, text, wanted in zip(part["shard"], part["text"], part["labels"]):
                    tokens, wanted = tokenizer(text), np.array(wanted, np.int64)
                    if len(tokens) < len(wanted):
                        continue
                    last, place = shard, place + 1 if shard == last else 0
                    tokens = [t for t, y in zip(tokens, wanted) if y != -100]
                    rows.append((shard, place, features(tokens).astype(np.uint16).tobytes(), wanted[wanted != -100].astype(np.int16).tobytes()))
                    size += len(tokens)
                    if size > 1 << 16:
                        yield pd.DataFrame(rows, columns=["shard", "place", "found", "gold"])
                        rows, size = [], 0
                yield pd.DataFrame(rows, columns=["shard", "place", "found", "gold"])

        return run

    def _epoch(self, common):
        """A function of some shards' records: the changes of one pass over each, and a row that counts the shards."""
        labels = self.labels

        def rounds(parts: Iterator[pd.DataFrame]) -> Iterator[list[tuple[int, np.ndarray, np.ndarray]]]:
            at, held = 0, []
            for part in parts:
                for shard, place, found, gold in zip(part["shard"], part["place"], part["found"], part["gold"]):
                    if place != at:
                        yield held
                        at, held = place, []
                    held.append((shard, np.frombuffer(found, np.uint16).reshape(-1, 14), np.frombuffer(gold, np.int16).astype(np.int64)))
            yield held

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            before = common.value
            follows, first = rules(labels)
            own: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for held in rounds(parts):
                if not held:
                    continue
                for shard, _, _ in held:
                    if shard not in own:
                        own[shard] = tuple(x.copy() for x in before)
                guesses = viterbi_all([own[k][0][found].sum(axis=1) for k, found, _ in held], np.array([own[k][1] + follows for k, _, _ in held]), first)
                for (shard, found, gold), guess in zip(held, guesses):
                    wrong = np.flatnonzero(guess != gold)
                    if not len(wrong):
                        continue
                    emission, transition = own[shard]
                    for which, sign in ((gold, 1), (guess, -1)):
                        np.add.at(emission, (found[wrong], which[wrong, None]), sign)
                        np.add.at(transition, (which[:-1], which[1:]), sign)
            if own:
                change = sum(np.rint(np.concatenate([(x - y).ravel() for x, y in zip(k, before)])).astype(np.int64) for k in own.values())
                spot = np.flatnonzero(change)
                yield pd.DataFrame({"shards": np.append(len(own), np.zeros(len(spot), np.int64)), "spot": np.append(-1, spot), "change": np.append(0, change[spot])})

        return run
