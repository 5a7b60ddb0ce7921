"""The four models that an engine can be given, and small deterministic ones for tests."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.patterns import ANNOTATIONS


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class PairScorer(Protocol):
    def score(self, questions: list[str], texts: list[str]) -> np.ndarray: ...


class EntityTagger(Protocol):
    def tag(self, texts: list[str]) -> list[list[dict]]: ...


ChatClient = Callable[[str, str, float, int], str]


class HashEmbedder:
    """Unit vectors of hashed words."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
                out[i, h % self.dimension] += 1 if h >> 32 & 1 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


class OverlapScorer:
    """The logit of a pair is how many distinct words of the question the text has, less a half of how many it lacks."""

    def score(self, questions: list[str], texts: list[str]) -> np.ndarray:
        out = []
        for q, t in zip(questions, texts):
            words = set(re.findall(r"[^\s]+", (q or "").lower()))
            hit = len(words & set(re.findall(r"[^\s]+", (t or "").lower())))
            out.append(hit - 0.5 * (len(words) - hit))
        return np.array(out, float)


class RuleTagger:
    """Spans that a pack of patterns finds, label by label, each with score 1: the tagger where no model is given."""

    def __init__(self, pack: dict[str, list[str]] = ANNOTATIONS):
        self.tests = [(label, re.compile(p, re.IGNORECASE)) for label, ps in pack.items() for p in ps]

    def tag(self, texts: list[str]) -> list[list[dict]]:
        found = [[(m, label) for label, p in self.tests for m in p.finditer(t)] for t in texts]
        return [[{"text": m.group(), "label": label, "start": m.start(), "end": m.end(), "score": 1.0} for m, label in own] for own in found]


def embed_column(embedder: Embedder, text: str, batch: int = 64) -> Column:
    """array<double> of each text, a bounded batch of texts at a time; the model is made ready once a worker."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            rows = [v.tolist() for k in range(0, len(part), batch) for v in embedder.embed(part.iloc[k : k + batch].fillna("").tolist())]
            yield pd.Series(rows, index=part.index)

    return run(F.col(text))


def pair_column(scorer: PairScorer, question: str, text: str, batch: int = 8) -> Column:
    """Sigmoid of the scorer's logit. The scorer gets whole texts and cuts them itself where its model has a limit of tokens."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, t in parts:
            out: list[float] = []
            for k in range(0, len(q), batch):
                raw = scorer.score(q.iloc[k : k + batch].fillna("").tolist(), t.iloc[k : k + batch].fillna("").tolist())
                out += [1 / (1 + math.exp(-x)) for x in raw.tolist()]
            yield pd.Series(out, index=q.index, dtype=float)

    return run(F.col(question), F.col(text))


def tag_column(tagger: EntityTagger, text: str) -> Column:
    """array of spans with label, offsets and score; blank texts have none."""

    @F.pandas_udf("array<struct<text:string,label:string,start:int,end:int,score:double>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            given = part.fillna("").tolist()
            full = [t for t in given if t.strip()]
            found = iter(tagger.tag(full) if full else [])
            yield pd.Series([next(found) if t.strip() else [] for t in given], index=part.index)

    return run(F.col(text))
