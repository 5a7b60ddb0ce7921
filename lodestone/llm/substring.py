"""Substring deduplication by sliding sentence spans (operator 3).

A text is cut before words that follow a sentence end or a newline, and in every
``WINDOW`` words without such a cut before the word of the least hash (winnowing), so no
part is longer and whether there is a cut depends on the words nearby alone. From every
part a run extends over at least ``SENTENCES`` parts and at least ``LEAST_WORDS`` words.
Whatever surrounds a passage of over 50 words, its cuts from its second word on are the
same, and the first of them is before its tenth word. A run from there has its words by
the passage's 44th and ends at a cut that the passage itself makes, so two texts with the
passage share a run. Runs are hashed to 128 bits from their words, with case folded and
whatever white space between. Each row counts a run once; counts and first rows are
partial aggregates, so a run that is everywhere is a row a task, not a hot key. Only runs
of two rows or more are joined with their occurrences again, between a settled table and an
exchange that Spark can split. A part goes if some run over it is not that run's first.
Which run of a row repeats within it needs no shuffle. Cuts, hashes and sums are array
operations over a batch of texts.

Defined results: a null text stays null and an empty one empty, with no sentences, as has
a text without words; very long texts are cut whole; the first occurrence is the one in
the smallest doc_id, nulls last, of rows with one doc_id or none in the row that was dealt
out first, and then the earliest in the text; every row is a text of its own, so rows that
share a doc_id, have none or are equal lose what they repeat; extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import memo
from lodestone.llm.common import only, settle
from lodestone.llm.jaccard import FILTER_BITS, filter_of
from lodestone.llm.wordhash import characters, mix, powers, slices, word_hashes

SENTENCES, LEAST_WORDS, WINDOW = 3, 28, 8
NULL_ID = (1 << 63) - 1
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@dataclass
class Cut:
    """Texts in parts and runs. Parts and runs of all texts are numbered on; *_at are each text's first (one entry more)."""

    part_at: np.ndarray
    begin: np.ndarray  # of each part: its first character in its text
    run_at: np.ndarray
    first: np.ndarray  # of each run: its first part, the part after its last, and its hashes
    end: np.ndarray
    h1: np.ndarray
    h2: np.ndarray

    def repeated(self) -> np.ndarray:
        """Which runs are not their text's first of that hash."""
        own = np.repeat(np.arange(len(self.run_at) - 1), np.diff(self.run_at))
        order = np.lexsort((self.h1, own))
        again = np.zeros(len(order), bool)
        again[order[1:]] = (self.h1[order][1:] == self.h1[order][:-1]) & (own[order][1:] == own[order][:-1])
        return again


def _least(key: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which words are the least (the first of the least) of some WINDOW words of one text."""
    out = np.zeros(len(key), bool)
    n = len(key) - WINDOW + 1
    if n > 0:
        low = key[:n]
        for k in range(1, WINDOW):
            low = np.minimum(low, key[k : k + n])
        at = np.zeros(n, np.int64)
        for k in range(WINDOW - 1, -1, -1):
            at[key[k : k + n] == low] = k
        at += np.arange(n)
        out[at[text[:n] == text[WINDOW - 1 :]]] = True
    return out


def cut(texts: list[str | None], least_sentences: int = SENTENCES, least_words: int = LEAST_WORDS) -> Cut:
    memo.use("substring")
    given = [t or "" for t in texts]
    joined = "\n".join(given)
    codes, space, start = characters(joined)
    low = joined.lower()
    one, two = word_hashes(*((codes, space, start) if low == joined else characters(low)), kinds=2)
    begins = np.cumsum([0] + [len(t) + 1 for t in given])
    word_at = np.searchsorted(start, begins)
    text = np.repeat(np.arange(len(given)), np.diff(word_at))
    # A word opens a part after a newline, after a word that ends a sentence, or as a window's least.
    lines = np.cumsum(codes == 10)[start] if len(start) else start
    stops = np.flatnonzero(~space & np.append(space[1:], True)) if len(start) else start
    ends = np.isin(codes[stops], (33, 46, 63))
    opens = np.append(True, (lines[1:] > lines[:-1]) | ends[:-1])[: len(start)]
    key = (one >> np.uint64(1)) + np.uint64(1)
    key[opens] = 0
    opens |= _least(key, text)
    part = np.flatnonzero(opens)
    part_at = np.searchsorted(part, word_at)
    begin = np.append(0, stops[:-1] + 1)[: len(start)][part] - begins[text[part]]
    begin[part_at[:-1][np.diff(part_at) > 0]] = 0
    # Runs: each from a part on, up to the first part that has enough before it, within its text.
    edge = np.append(part, len(start))
    last = part_at[1:][text[part]]
    end = np.maximum(np.searchsorted(edge, part + least_words), np.arange(len(part)) + least_sentences)
    ok = end <= last
    first, end = np.flatnonzero(ok), end[ok]
    a, b = edge[first], edge[end]
    hashes = []
    with np.errstate(over="ignore"):
        for h, base in zip((one, two), _BASES):
            # Sum of hash * base ** (place - first place): the same for the same words, wherever they are.
            up, down = powers(base, len(h) + 1), powers(pow(base, -1, 1 << 64), len(h) + 1)
            sums = np.append(np.uint64(0), np.cumsum(h * up[:-1]))
            hashes.append(mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * np.uint64(base)))
    return Cut(part_at, begin, np.searchsorted(first, part_at), first, end, *(h.view(np.int64) for h in hashes))


def _digests(shared=None):
    """A function of (key, doc, text): the runs of each row, once each, or only those that may be shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, docs, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            for lo, hi in slices(texts):
                c = cut(texts[lo:hi])
                taken = ~c.repeated()
                if shared is not None:
                    spot = c.h1 % FILTER_BITS
                    taken &= (shared.value[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8) & 1).astype(bool)
                n = np.diff(c.run_at)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(x[lo:hi], n)[taken]) for x in (keys, docs)] + [pa.array(c.h1[taken]), pa.array(c.h2[taken])], ["key", "doc", "h1", "h2"])

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, found = batch.column(0).cast(pa.int64()), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for lo, hi in slices(texts):
            c = cut(texts[lo:hi])
            goes = c.repeated()
            for k, later in enumerate(found[lo:hi]):
                if later:
                    own = slice(c.run_at[k], c.run_at[k + 1])
                    goes[own] |= np.isin(c.h1[own], np.array(later, np.int64))
            edge = np.zeros(len(c.begin) + 1, np.int64)
            np.add.at(edge, c.first[goes], 1)
            np.add.at(edge, c.end[goes], -1)
            gone = np.cumsum(edge)[:-1] > 0
            total = np.append(0, np.cumsum(gone))
            n_gone = total[c.part_at[1:]] - total[c.part_at[:-1]]
            out = texts[lo:hi]
            for k in np.flatnonzero(n_gone).tolist():
                a, b = c.part_at[k], c.part_at[k + 1]
                edges = [*c.begin[a:b].tolist(), len(out[k])]
                out[k] = "".join(out[k][x:y] for x, y, g in zip(edges, edges[1:], gone[a:b]) if not g)
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(out, pa.string()), pa.array(np.diff(c.part_at), pa.int64()), pa.array(n_gone, pa.int64())], ["doc_id", "text", "n_sentences", "n_removed"])


RUNS = "key long, doc long, h1 long, h2 long"


def remove_repeated(docs: DataFrame) -> DataFrame:
    """doc_id, text without repeated passages, n_sentences, n_removed."""
    named = settle(only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("key")))
    rows = named.select("key", F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"), "text")
    counted = rows.mapInArrow(_digests(), RUNS).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("first"))
    shared = settle(counted.filter("n > 1").select("h1", "h2", "first"))
    bits = docs.sparkSession.sparkContext.broadcast(filter_of(shared, "h1", F.pmod("h1", F.lit(FILTER_BITS))))
    met = settle(rows.mapInArrow(_digests(bits), RUNS).join(shared, ["h1", "h2"]))
    # Rows of one doc_id, or of none: the first of them is told by its key.
    tied = settle(met.filter("doc = first").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least")).filter("n > 1").select("h1", "h2", "least"))
    again = met.filter("doc = first").join(tied, ["h1", "h2"]).filter("key > least").select("key", "h1")
    # A list holds runs of one row only.
    later = met.filter("doc > first").select("key", "h1").unionByName(again).groupBy("key").agg(F.collect_list("h1").alias("later"))
    return named.join(later, "key", "left").select("doc_id", "text", "later").mapInArrow(_remove, "doc_id long, text string, n_sentences long, n_removed long")
