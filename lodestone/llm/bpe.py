"""Byte-level BPE ids of whole texts through the ``tokenizers`` library.

A text is cut before every single space that a non-space follows and around every
single newline between non-spaces. The vocabulary's own split pattern always starts a
new part there, so the ids of the pieces, one after the other, are the ids of the
text. Each distinct piece is encoded once a worker, many in one call, and a document's
ids are then gathered by numpy. Texts with other white space are encoded whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

from lodestone.llm import memo

#: Distinct pieces that a worker remembers (about 250 bytes each) before it starts anew.
MEMORY = 1_300_000
PER_CALL = 100
_START, _NEWLINE = "\0", "\n"
LATIN = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af]+[,.]?").fullmatch


def _spelling() -> dict[int, str]:
    """How byte-level vocabularies write each byte: printable Latin-1 as itself, the others from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(plain))}


SPELLING = _spelling()


class Places(dict):
    """Piece -> its number; pieces not met before get the next numbers and are listed in new."""

    new: list[str]

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.new.append(piece)
        return n


class Encoder:
    """Ids of texts as uint32 arrays. Null and empty texts have none."""

    def __init__(self, path: str, memory: int = MEMORY):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        self.tokenizer, self.memory = Tokenizer.from_file(path), memory
        # Words of Latin letters are one part each under the vocabulary's split pattern.
        self.of_words = Tokenizer.from_file(path)
        self.of_words.pre_tokenizer = pre_tokenizers.Split(Regex(_NEWLINE.translate(SPELLING)), "isolated")
        self.stops = {x: self.tokenizer.encode(x, add_special_tokens=False).ids[0] for x in ".,"}
        self.newline = self.tokenizer.encode(_NEWLINE, add_special_tokens=False).ids
        # Pieces are separable in one call only if a newline is one id of its own.
        self.together = len(self.newline) == 1 and self.tokenizer.encode(f"a{_NEWLINE} a{_NEWLINE}a", add_special_tokens=False).ids.count(self.newline[0]) == 2
        self.clear()

    def clear(self) -> None:
        self.place = Places()
        self.pool = np.zeros(1 << 16, "<u4")
        self.first, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _ids(self, tokenizer, bodies: list[str], spell) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of texts without newlines, and how many each has."""
        parts, sizes = [], [np.zeros(0, np.int64)]
        for k in range(0, len(bodies), PER_CALL):
            ids = np.array(tokenizer.encode_batch_fast([spell(_NEWLINE.join(bodies[k : k + PER_CALL]))], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.append(np.flatnonzero(ids == self.newline[0]), len(ids))
            sizes.append(np.diff(ends, prepend=-1) - 1)
            parts.append(ids[ids != self.newline[0]])
        return parts, np.concatenate(sizes)

    def _learn(self, new: list[str]) -> None:
        """new: the pieces from place len(place) - len(new) on. A size of -1 marks a piece at which a text can't be cut."""
        base = len(self.place) - len(new)
        words, rest, word_at, rest_at, newline_at, stops = [], [], [], [], [], {".": [], ",": []}
        for i, w in enumerate(new):
            if w == _NEWLINE:
                newline_at.append(i)
                continue
            starts = w[:1] == _START
            core = w[1:] if starts else w
            if not core or core[0].isspace():
                continue
            if LATIN(core):
                if core[-1] in stops:
                    stops[core[-1]].append(i)
                    core = core[:-1]
                words.append(core if starts else " " + core)
                word_at.append(i)
            else:
                rest.append(core if starts else " " + core)
                rest_at.append(i)
        parts, sizes = self._ids(self.of_words, words, lambda x: x.encode().decode("latin-1").translate(SPELLING))
        more, more_sizes = self._ids(self.tokenizer, rest, str)
        ids = np.concatenate([*parts, *more, np.zeros(0, "<u4")])
        at = np.array(word_at + rest_at, dtype=np.int64)
        size, first, stop = np.full(len(new), -1, np.int64), np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        size[at] = np.concatenate([sizes, more_sizes])
        first[at] = np.cumsum(size[at]) - size[at]
        for mark, where in stops.items():
            stop[where] = self.stops[mark]
        # Room for the stop behind a word: each piece's ids, then its stop.
        extra = (stop[at] > 0).astype(np.int64)
        total = np.cumsum(size[at] + extra) - size[at] - extra
        fresh = np.zeros(int((size[at] + extra).sum()) + len(newline_at), "<u4")
        fresh[_spans(total, size[at])] = ids
        has = extra > 0
        fresh[(total + size[at])[has]] = stop[at][has]
        size[at] += extra
        first[at] = total
        if newline_at:
            fresh[-1], size[newline_at], first[newline_at] = self.newline[0], 1, len(fresh) - 1
        self.pool = _room(self.pool, self.used + len(fresh))
        self.pool[self.used : self.used + len(fresh)] = fresh
        self.first, self.size = _room(self.first, base + len(new)), _room(self.size, base + len(new))
        self.first[base : base + len(new)], self.size[base : base + len(new)] = first + self.used, size
        self.used += len(fresh)

    def encode(self, texts) -> list[np.ndarray]:
        if len(self.place) > self.memory:
            self.clear()
        place, found = self.place, []
        place.new = new = []
        look = place.__getitem__
        for text in texts:
            if not text or not self.together or _START in text:
                found.append(None)
            else:
                found.append(np.fromiter(map(look, (_START + text.replace(_NEWLINE, f" {_NEWLINE} {_START}")).split(" ")), np.int64))
        if new:
            self._learn(new)
        out = []
        for text, places in zip(texts, found):
            if places is None:
                out.append(self.whole(text) if text else np.zeros(0, "<u4"))
                continue
            sizes = self.size[places]
            if sizes.min() < 0:
                out.append(self.whole(text))
                continue
            out.append(self.pool[_spans(self.first[places], sizes)])
        return out


def _room(x: np.ndarray, n: int) -> np.ndarray:
    return x if len(x) >= n else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])


def _spans(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... sizes[0] of them, then the same of the next."""
    ends = np.cumsum(sizes)
    steps = np.repeat(first - (ends - sizes), sizes)
    return steps + np.arange(len(steps))


_encoders: dict[str, Encoder] = {}
memo.register("bpe", lambda: [e.clear() for e in _encoders.values()])


def encoder(path: str) -> Encoder:
    """One encoder a worker process."""
    memo.use("bpe")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
