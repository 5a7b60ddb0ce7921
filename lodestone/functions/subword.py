"""Subword tokens with character offsets, from a byte-level vocabulary."""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
import tiktoken

_ready: dict[tuple[str, str], tuple[tiktoken.Encoding, np.ndarray]] = {}


@dataclass(frozen=True)
class SubwordTokenizer:
    """The pieces of a rank file (a line holds a piece's bytes in base64 and its rank) as (text, start, end, id): the
    characters that a piece touches. Pieces are bytes, so a character that is cut belongs to each of its pieces.
    An empty text has none. Only the path travels to the tasks; a worker reads the file once."""

    path: str
    pattern: str

    def _loaded(self) -> tuple[tiktoken.Encoding, np.ndarray]:
        key = (self.path, self.pattern)
        if key not in _ready:
            with open(self.path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
            widths = np.zeros(max(ranks.values()) + 1, np.int64)
            widths[list(ranks.values())] = [len(x) for x in ranks]
            _ready[key] = tiktoken.Encoding("subword", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={}), widths
        return _ready[key]

    def __call__(self, text: str) -> list[tuple[str, int, int, int]]:
        encoding, widths = self._loaded()
        ids = np.array(encoding.encode_ordinary(text), np.int64)
        if not len(ids):
            return []
        ends = np.cumsum(widths[ids])
        # The character of each byte: bytes that go on with a character don't begin another.
        character = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)
        first, last = (character[ends - widths[ids]] - 1).tolist(), character[ends - 1].tolist()
        return [(text[a:b], a, b, i) for a, b, i in zip(first, last, ids.tolist())]
