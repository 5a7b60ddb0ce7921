"""Greedy word-piece token counts by a linear longest-match automaton (operator 4).

The vocabulary is a trie of byte strings. Each node has a failure link and the number
of pieces that taking the link pops: at node v the longest piece that starts the bytes
read so far is fixed, popped, and the rest of those bytes is again a node. Both are
computed once for each node, so a word costs as many steps as it has bytes, whatever
the pieces, and no piece is ever built. Words are stepped through the automaton side by
side in numpy and remembered by worker.

Defined results: a null or empty text has no words and no tokens; null ids stay; equal
rows are counted each; very long texts are counted whole; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.common import only

MEMORY = 1_000_000


class Automaton:
    """Counts the pieces of greedy longest match from the left. A byte that starts no piece counts as one token."""

    def __init__(self, pieces: set[bytes]):
        pieces = (set(pieces) | {bytes([b]) for b in range(256)}) - {b""}
        child: list[dict[int, int]] = [{}]
        depth, ends, parent = [0], [False], [(0, 0)]
        for piece in sorted(pieces):
            v = 0
            for b in piece:
                if b not in child[v]:
                    child[v][b] = len(child)
                    child.append({})
                    depth.append(depth[v] + 1)
                    ends.append(False)
                    parent.append((v, b))
                v = child[v][b]
            ends[v] = True
        n = len(child)
        fail, pops = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        for v in sorted(range(1, n), key=depth.__getitem__):
            if ends[v]:
                fail[v], pops[v] = 0, 1
                continue
            u, b = parent[v]
            popped, z = pops[u], fail[u]
            while z >= 0 and b not in child[z]:
                popped, z = popped + pops[z], fail[z]
            if z >= 0:
                fail[v], pops[v] = child[z][b], popped
        self.fail, self.pops = fail, pops
        edges = sorted((v * 256 + b, to) for v in range(n) for b, to in child[v].items())
        self.edge_key = np.array([k for k, _ in edges], np.int64)
        self.edge_to = np.array([to for _, to in edges], np.int64)
        self.known: dict[bytes, int] = {}

    @classmethod
    def of_ranks(cls, path: str) -> Automaton:
        """The vocabulary of a rank file: base64 pieces, one a line. A piece that begins with a space begins a word."""
        return cls({base64.b64decode(line.split()[0]) for line in Path(path).read_bytes().splitlines() if line.strip()})

    def _step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = node * 256 + byte
        at = np.minimum(np.searchsorted(self.edge_key, key), len(self.edge_key) - 1)
        return np.where(self.edge_key[at] == key, self.edge_to[at], -1)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word."""
        size = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-size, kind="stable")
        flat = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        start = (np.cumsum(size) - size)[order]
        size = size[order]
        node, out = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for i in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -i, side="left"))  # words longer than i
            todo, byte = np.arange(live), flat[start[:live] + i].astype(np.int64)
            while len(todo):
                to = self._step(node[todo], byte[todo])
                done = to >= 0
                node[todo[done]] = to[done]
                todo = todo[~done]
                out[todo] += self.pops[node[todo]]
                node[todo] = self.fail[node[todo]]
        todo = np.flatnonzero(node)
        while len(todo):  # what is left at the end of the word
            out[todo] += self.pops[node[todo]]
            node[todo] = self.fail[node[todo]]
            todo = todo[node[todo] > 0]
        back = np.empty(len(words), np.int64)
        back[order] = out
        return back

    def count_text(self, text: str | None) -> tuple[int, int]:
        """Words and tokens. A word is counted with a space before it."""
        words = (text or "").encode().split()
        if len(self.known) > MEMORY:
            self.known.clear()
        if new := list({*words}.difference(self.known)):
            self.known.update(zip(new, self.count([b" " + w for w in new]).tolist()))
        return len(words), sum(map(self.known.__getitem__, words))


_automata: dict[str, Automaton] = {}


def count_tokens(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_words, n_tokens of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if ranks_path not in _automata:
            _automata[ranks_path] = Automaton.of_ranks(ranks_path)
        auto = _automata[ranks_path]
        for batch in batches:
            texts = batch.column(1)
            found = [auto.count_text(texts[i].as_py()) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")
