"""Benchmark decontamination by the CGK embedding and bit-sampling LSH (operator 6).

Documents and benchmark items are sequences of folded words. A CGK random walk reads a
window of words and writes one word a step, moving on or staying by a random bit that
depends on the step and the word; sequences with few edits agree in many places of what
is written, so edit distance becomes Hamming distance. A hash table samples a few places
of one walk as its key. ``tables_for`` repeats tables until an item at the largest
allowed distance is expected to be found with the target recall.

Windows begin at every ``STRIDE``-th word of a document; instead of a window at every
word, each item enters the tables from each of its words on, so some window meets an
item wherever it lies. A window's walk is only followed while the places
sampled so far agree with some item, which changes no key and no result.

Items of fewer than ``WALKED`` words have too few alignments and walks too short for that
recall. They are cut into one piece more than the edits they may have, so one piece is
unedited in every match, and each piece is looked up at every word: none is missed.
Items of fewer than five words may have no edit, so they are one piece.

Each window or piece found is verified by the exact word edit distance of the item to
the best-matching part of the document around it, at most ``DISTANCE`` times the item's
words.

Items are broadcast in blocks of at most ``ITEMS_A_BLOCK`` items and ``WORDS_A_BLOCK``
words; more items are more passes over the documents.

Defined results: null and empty texts have no match; items without words or with null
text match nothing; very long texts are read whole; of parts at one distance the first
counts; equal rows are matched each, and ``contaminated`` has one row a doc_id and text,
null ids included, so rows without an id are not gathered; ``decontaminate`` decides by
the row's own text, and extra columns stay there; an empty table, of documents or of
items, gives no match.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import memo
from lodestone.llm.common import only
from lodestone.llm.wordhash import hashed
from lodestone.session import ready

DISTANCE, RECALL, STRIDE = 0.2, 0.99, 9
#: Walks begin at each word of an item from which so many are left.
LEFT = 8
#: From so many words on an item is met by walks with the target recall at any distance allowed (see the tests).
WALKED = 30
#: Places of a walk in a key, and how many keys share a walk.
SAMPLED, KEYS_A_WALK = 4, 4
ITEMS_A_BLOCK, WORDS_A_BLOCK = 20_000, 2_000_000
#: How many words of an item a walk may read, for items of at least so many: steps are twice as many.
REACHES = (5, 12, 18)
REACH = REACHES[-1]
#: Chance that a sampled place agrees at the largest allowed distance (measured on random edits; see the tests).
AGREE = 0.78
_MIX = np.uint64(0x9E3779B97F4A7C15)


def tables_for(recall: float = RECALL, agree: float = AGREE, sampled: int = SAMPLED) -> int:
    """Tables after which one agrees with this chance, in whole walks."""
    need = np.log(1 - recall) / np.log(1 - agree**sampled)
    return int(-(-need // KEYS_A_WALK)) * KEYS_A_WALK


def codes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each folded word."""
    return hashed([text])[0]


def places(walk: int, reach: int) -> np.ndarray:
    """The sampled steps of each key of a walk, in ascending order; spread over the whole walk."""
    r = np.random.default_rng(1000 + walk)
    return np.stack([np.sort(r.choice(2 * reach, SAMPLED, replace=False)) for _ in range(KEYS_A_WALK)])


def _bits(words: np.ndarray, walk: int) -> np.ndarray:
    """64 random bits of each word for a walk; step j uses bit j."""
    h = (words ^ np.uint64(walk * 0x5851F42D4C957F2D & (1 << 64) - 1)) * _MIX
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Index:
    """The keys of a block of items."""

    def __init__(self, items: list[tuple[int, str]], distance: float = DISTANCE, tables: int | None = None):
        self.distance = distance
        self.walks = (tables or tables_for()) // KEYS_A_WALK
        self.items = [(i, c) for i, t in items for c in [codes(t)] if len(c)]
        self.sorted = [np.unique(c) for _, c in self.items]
        # An item is read from each word on; what is left must be worth a key.
        self.variants = [(k, s) for k, (_, c) in enumerate(self.items) if len(c) >= WALKED for s in range(len(c) - LEFT + 1)]
        width = REACH + 1
        sheet = np.zeros((len(self.variants), width), np.uint64)
        for row, (k, s) in enumerate(self.variants):
            part = self.items[k][1][s : s + width]
            sheet[row, : len(part)] = part
        flat, start = sheet.ravel(), np.arange(len(sheet)) * width
        left = np.array([min(len(self.items[k][1]) - s, width) for k, s in self.variants], np.int64)
        # Items of like length share tables whose places lie within the shortest of them.
        reach = np.array([max(c for c in REACHES if c <= max(n, REACHES[0])) for n in left.tolist()], np.int64)
        self.by_walk = defaultdict(list)
        for walk in range(self.walks):
            written = self._written(flat, start, walk)
            for r in np.unique(reach).tolist():
                rows = np.flatnonzero(reach == r)
                for sampled in places(walk, r):
                    chain, filters = np.zeros(len(rows), np.uint64), []
                    for j in sampled:
                        chain = (chain ^ written[rows, j]) * _MIX
                        chain ^= chain >> np.uint64(32)
                        filters.append(_Filter(np.unique(chain)))
                    full: dict[int, list[int]] = defaultdict(list)
                    for c, row in zip(chain.tolist(), rows.tolist()):
                        full[c].append(row)
                    self.by_walk[walk].append((sampled, filters, dict(full)))
        # Length of the pieces -> filter, key -> variants; a piece is a variant that begins where the piece does.
        pieces: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for k, (_, c) in enumerate(self.items):
            if len(c) < WALKED:
                edges = np.linspace(0, len(c), self.most(c) + 2).astype(np.int64).tolist()
                for a, b in zip(edges, edges[1:]):
                    pieces[b - a][int(_chained(c[a:b], b - a)[0])].append(len(self.variants))
                    self.variants.append((k, a))
        self.pieces = {n: (_Filter(np.array(sorted(full), np.uint64)), dict(full)) for n, full in pieces.items()}

    def most(self, item: np.ndarray) -> int:
        """The edits an item may have."""
        return int(self.distance * len(item) + 1e-9)

    @staticmethod
    def _written(flat, start, walk):
        """The word written at every step of the walks."""
        at, out = np.zeros(len(start), np.int64), []
        for j in range(2 * REACH):
            word = flat[start + np.minimum(at, REACH)]
            out.append(word)
            at = at + (_bits(word, walk) >> np.uint64(j) & np.uint64(1)).astype(np.int64)
        return np.stack(out, 1)

    def candidates(self, words: np.ndarray, start: np.ndarray) -> list[tuple[int, int]]:
        """(window's first word, variant) of all windows that share a key with an item. words: followed by REACH + 1 zeros."""
        found = set()
        for walk, tables in self.by_walk.items():
            bits = _bits(words, walk)
            last = max(int(s[-1]) for s, _, _ in tables)
            live, at = start, start
            state = [[np.arange(len(start)), np.zeros(len(start), np.uint64)] for _ in tables]
            due = defaultdict(list)
            for t, (sampled, _, _) in enumerate(tables):
                for n, j in enumerate(sampled.tolist()):
                    due[j].append((t, n))
            for j in range(last + 1):
                for t, n in due[j]:
                    sampled, filters, full = tables[t]
                    own, chain = state[t]
                    chain = (chain ^ words[at[own]]) * _MIX
                    chain ^= chain >> np.uint64(32)
                    keep = filters[n].has(chain)
                    own, chain = own[keep], chain[keep]
                    state[t] = [own, chain]
                    if n == len(sampled) - 1:
                        found.update((int(live[i]), v) for i, c in zip(own.tolist(), chain.tolist()) for v in full[c])
                        state[t] = [own[:0], chain[:0]]
                if j == last:
                    break
                # Only windows that some table still follows walk on.
                if due[j] and all(j >= s[0] for s, _, _ in tables):
                    still = np.zeros(len(at), bool)
                    for own, _ in state:
                        still[own] = True
                    to = np.cumsum(still) - 1
                    live, at = live[still], at[still]
                    state = [[to[own], chain] for own, chain in state]
                if not len(at):
                    break
                at = at + (bits[at] >> np.uint64(j) & np.uint64(1)).astype(np.int64)
                at = np.minimum(at, len(words) - 1)
        return sorted(found)

    def unedited(self, words: np.ndarray) -> list[tuple[int, int]]:
        """(first word, variant) of every piece in words, which are followed by REACH + 1 zeros."""
        found = []
        for n, (kept, full) in self.pieces.items():
            keys = _chained(words, n)
            at = np.flatnonzero(kept.has(keys))
            found += [(i, v) for i, c in zip(at.tolist(), keys[at].tolist()) for v in full[c]]
        return sorted(found)

    def matches(self, words: np.ndarray, found: list[tuple[int, int]]) -> dict[int, tuple[int, int, int]]:
        """Verified items: item id -> (distance, first word, end) of the best part of the document."""
        best: dict[int, tuple[int, int, int]] = {}
        tried = set()
        for at, variant in found:
            k, shift = self.variants[variant]
            name, item = self.items[k]
            most = self.most(item)
            if name in best and best[name][0] == 0 and best[name][1] <= at - shift - 2 * most - 1:
                continue  # no later place is better
            around = (at - shift) // max(1, most)
            if (k, around) in tried:
                continue
            tried.add((k, around))
            here = at - shift
            if here >= 0 and np.array_equal(words[here : here + len(item)], item):
                if name not in best or (0, here) < best[name][:2]:
                    best[name] = (0, here, here + len(item))
                continue
            lo, hi = max(0, at - shift - 2 * most - 1), min(len(words), at - shift + len(item) + 2 * most + 1)
            part, own = words[lo:hi], self.sorted[k]
            # Each edit takes at most one of the item's words, so this many places of the part hold one of them.
            if (own[np.searchsorted(own[:-1], part)] == part).sum() < len(item) - most or np.isin(item, part).sum() < len(item) - most:
                continue
            d, a, b = within(item, words[lo:hi], most)
            if d <= most and (name not in best or (d, lo + a) < best[name][:2]):
                best[name] = (d, lo + a, lo + b)
        return best


def _chained(words: np.ndarray, n: int) -> np.ndarray:
    """A key of every n words in a row."""
    last = len(words) - n + 1
    chain = np.zeros(max(0, last), np.uint64)
    for j in range(n if last > 0 else 0):
        chain = (chain ^ words[j : j + last]) * _MIX
        chain ^= chain >> np.uint64(32)
    return chain


class _Filter:
    """Membership in a sorted array of 64-bit values, by a bitmap first."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.shift = np.uint64(64 - max(12, min(24, int(len(values)).bit_length() + 6)))
        self.bitmap = np.zeros(1 << int(64 - int(self.shift)), bool)
        self.bitmap[(values >> self.shift).astype(np.int64)] = True

    def has(self, x: np.ndarray) -> np.ndarray:
        out = self.bitmap[(x >> self.shift).astype(np.int64)]
        i = np.flatnonzero(out)
        if len(i):
            p = np.minimum(np.searchsorted(self.values, x[i]), len(self.values) - 1)
            out[i] = self.values[p] == x[i]
        return out


def within(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int]:
    """The least edit distance of the item to any part of the text, and that part: rows over the item, each row in numpy."""
    n = len(text)
    row, came = np.zeros(n + 1, np.int64), np.arange(n + 1)
    steps = np.arange(n + 1)
    for i, w in enumerate(item):
        up = row + 1
        across = row[:-1] + (text != w)
        take = across <= up[1:]
        new, src = np.append(i + 1, np.where(take, across, up[1:])), np.append(0, np.where(take, came[:-1], came[1:]))
        # Insertions: the running minimum of new[j] - j, and where it was.
        low = new - steps
        least = np.minimum.accumulate(low)
        pick = np.maximum.accumulate(np.where(low == least, steps, 0))
        row, came = least + steps, src[pick]
    end = int(row.argmin())
    return int(row[end]), int(came[end]), end


_indexes: dict[str, Index] = {}
memo.register("decontaminate", _indexes.clear)


def _index(given: tuple) -> Index:
    """The index of a block, made once a worker process."""
    memo.use("decontaminate")
    if given[0] not in _indexes:
        _indexes.clear()
        _indexes[given[0]] = Index(*given[1:])
    return _indexes[given[0]]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items, in blocks of bounded size."""
    block: list[tuple[int, str]] = []
    words = 0
    for r in only(benchmark, "item_id", "text").filter("text is not null and item_id is not null").orderBy("item_id", "text").toLocalIterator():
        size = len(r["text"].split())
        if block and (len(block) >= ITEMS_A_BLOCK or words + size > WORDS_A_BLOCK):
            yield block
            block, words = [], 0
        block.append((r["item_id"], r["text"]))
        words += size
    if block:
        yield block


def _matched(index: Index, texts: list[str | None]) -> dict[int, dict[int, tuple[int, int, int]]]:
    """Place of a text among the texts -> the items found in it."""
    flat, at = hashed(texts)
    sizes, gap = np.diff(at), REACH + 1
    begins = at + gap * np.arange(len(at))
    words = np.zeros(len(flat) + gap * max(1, len(sizes)), np.uint64)
    words[np.arange(len(flat)) + gap * np.repeat(np.arange(len(sizes)), sizes)] = flat
    windows = -(-sizes // STRIDE)
    starts = np.repeat(begins[:-1], windows) + STRIDE * (np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows))
    found = index.candidates(words, starts) if len(starts) and index.by_walk else []
    by_doc: dict[int, list] = defaultdict(list)
    for place, variant in sorted(found + index.unedited(words)):
        d = int(np.searchsorted(begins, place, side="right")) - 1
        by_doc[d].append((place - int(begins[d]), variant))
    every = {d: index.matches(flat[at[d] : at[d + 1]], hits) for d, hits in by_doc.items()}
    return {d: m for d, m in every.items() if m}


def find_items(docs: DataFrame, benchmark: DataFrame, distance: float = DISTANCE, recall: float = RECALL) -> DataFrame:
    """One row a document and item found in it: doc_id, item_id, distance, first_word, end_word."""
    return _found(docs, benchmark, distance, recall).drop("text_key")


def _found(docs: DataFrame, benchmark: DataFrame, distance: float, recall: float) -> DataFrame:
    """As find_items, and text_key, a hash of the text."""
    spark = docs.sparkSession
    fields = [("doc_id", "long", pa.int64()), ("text_key", "long", pa.int64()), ("item_id", "long", pa.int64())]
    fields += [(n, "int", pa.int32()) for n in ("distance", "first_word", "end_word")]
    schema = ", ".join(f"{n} {kind}" for n, kind, _ in fields)
    out = None
    for block in _blocks(benchmark):
        held = spark.sparkContext.broadcast((uuid.uuid4().hex, block, distance, tables_for(recall)))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = _index(held.value)
            for batch in batches:
                ids, keys = batch.column(0).to_pylist(), batch.column(2).to_pylist()
                rows = [(ids[d], keys[d], name, *best) for d, own in _matched(index, batch.column(1).to_pylist()).items() for name, best in sorted(own.items())]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, _, kind) in enumerate(fields)], [n for n, _, _ in fields])

        found = only(docs, "doc_id", "text").withColumn("text_key", F.xxhash64("text")).mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def contaminated(docs: DataFrame, benchmark: DataFrame, distance: float = DISTANCE, recall: float = RECALL) -> DataFrame:
    """One row a doc_id and text with a match: doc_id, n_items, item_ids (ascending), distances and word spans in that order.
    A text's items are found in one task, but blocks of items in several, so its rows are gathered."""
    hit = _found(docs, benchmark, distance, recall)
    one = F.sort_array(F.collect_set(F.struct("item_id", "distance", "first_word", "end_word")))
    return hit.groupBy("doc_id", "text_key").agg(one.alias("m")).select("doc_id", F.size("m").cast("long").alias("n_items"), F.col("m.item_id").alias("item_ids"), F.col("m.distance").alias("distances"), F.col("m.first_word").alias("first_words"), F.col("m.end_word").alias("end_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, distance: float = DISTANCE, recall: float = RECALL) -> DataFrame:
    """docs without the rows in whose text an item was found; their columns as they are. A row goes for its own text
    alone: the pass that finds the items drops the row, so no key is needed."""
    ready(docs.sparkSession)
    at = docs.columns.index("text")
    for block in _blocks(benchmark):
        held = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, block, distance, tables_for(recall)))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = _index(held.value)
            for batch in batches:
                stay = np.ones(batch.num_rows, bool)
                stay[list(_matched(index, batch.column(at).to_pylist()))] = False
                yield batch.filter(pa.array(stay))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
