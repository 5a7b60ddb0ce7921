"""SimHash near duplicates by a hierarchical index in Gray order (operator 11).

A text's fingerprint has a bit set where over half of the hashes of its shingles have it.
Distinct fingerprints are found once, so copies are never compared, and link where they
differ in at most ``most`` bits:

* Fingerprints are sorted by their Gray rank (the place of the bit pattern in the
  reflected Gray code), so that neighbours share most of their bits, also over the
  boundaries of powers of two, and cut into ranges.
* An upper node stands for a few neighbours in that order: a mask of the bits on which all
  its members agree, and their values. Its children keep only the bits that the parent
  doesn't hold. A search adds the differences up from node to node and leaves a whole
  group as soon as they exceed ``most``; at a leaf the sum is the exact distance.
* The topmost level has one node a range. It is held by every task and says to which other
  ranges a fingerprint has to go; of two ranges only one sends to the other. A task sorts
  what it gets by range, members first, builds the range's lower levels from them and
  streams the visitors past it.
* Tasks emit no pairs but each fingerprint's link to the smallest of those it hangs
  together with there, at most one row for a fingerprint and batch.

Defined results: null texts and texts without words have the fingerprint zero and are
linked like any other; rows with a null doc_id are grouped like others, and a component's
id is the smallest doc_id that is not null (null if there is none); equal rows are in one
component; very long texts are read whole; extra columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import only, settle
from lodestone.llm.graph import components

WORDS, MOST, SEED = 3, 2, 42
#: Fingerprints of a range, about; the topmost level has one row for so many.
RANGE = 1 << 20
#: Children of a node.
FAN = 4
#: Shingles that are hashed together, and visitors that search together.
HASHED, VISITORS = 1 << 16, 1 << 12
_BITS = np.array([[b >> k & 1 for k in range(8)] for b in range(256)], np.int64)


def fingerprint(text: bytes | None, n: int = WORDS) -> int:
    """The unsigned fingerprint of the UTF-8 bytes of a text."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    width, held = min(n, len(words)), np.zeros((8, 256), np.int64)
    total = len(words) - width + 1
    for lo in range(0, total, HASHED):
        own = words[lo : min(lo + HASHED, total) + width - 1]
        h = np.array([xxh64_intdigest(x, SEED) for x in map(b" ".join, zip(*(own[k:] for k in range(width))))], "<u8")
        for k, column in enumerate(h.view(np.uint8).reshape(-1, 8).T):
            held[k] += np.bincount(column, minlength=256)
    set_in = (held @ _BITS).ravel()
    return int.from_bytes(np.packbits(2 * set_in > total, bitorder="little").tobytes(), "little")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray code."""
    rank = codes.copy()
    for k in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(k)
    return rank


def _ordered(codes: np.ndarray) -> np.ndarray:
    """Gray ranks as signed numbers in the same order."""
    return (gray_rank(codes) ^ np.uint64(1 << 63)).view(np.int64)


class Node:
    """One level of the index: of each node the bits its members agree on and, of those, the ones its parent doesn't hold."""

    def __init__(self, all_of: np.ndarray, any_of: np.ndarray):
        self.all_of, self.any_of = all_of, any_of
        self.mask = self.own = ~(all_of ^ any_of)
        self.value = all_of & self.mask


class GrayIndex:
    """Members are given in the order of their Gray ranks; nodes may be patterns (all bits set in every member, all set in any)."""

    def __init__(self, all_of: np.ndarray, any_of: np.ndarray | None = None, fan: int = FAN):
        self.fan, self.levels = fan, [Node(all_of, all_of if any_of is None else any_of)]
        while len(self.levels[-1].mask) > fan:
            below = self.levels[-1]
            at = np.arange(0, len(below.mask), fan)
            up = Node(np.bitwise_and.reduceat(below.all_of, at), np.bitwise_or.reduceat(below.any_of, at))
            below.own = below.mask & ~np.repeat(up.mask, fan)[: len(below.mask)]
            self.levels.append(up)

    def search(self, codes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of codes and of members that differ in at most ``most`` of the members' agreed bits."""
        top = self.levels[-1]
        at, node = (x.ravel() for x in np.indices((len(codes), len(top.mask))))
        so_far = np.zeros(len(at), np.uint8)
        for depth in range(len(self.levels) - 1, -1, -1):
            level = self.levels[depth]
            so_far = so_far + np.bitwise_count((codes[at] ^ level.value[node]) & level.own[node])
            near = so_far <= most
            at, node, so_far = at[near], node[near], so_far[near]
            if depth:
                below = len(self.levels[depth - 1].mask)
                at, so_far = np.repeat(at, self.fan), np.repeat(so_far, self.fan)
                node = (node[:, None] * self.fan + np.arange(self.fan)).ravel()
                if len(node) and node.max() >= below:
                    there = node < below
                    at, node, so_far = at[there], node[there], so_far[there]
        return at, node


def hung(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that hang each code on the smallest of its component, in place of the given pairs."""
    codes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(codes))
    while True:
        low = root.copy()
        np.minimum.at(low, root[x], root[y])
        np.minimum.at(low, root[y], root[x])
        low = low[root]
        while (low[low] != low).any():
            low = low[low]
        if (low == root).all():
            break
        root = low
    loose = root != np.arange(len(codes))
    return codes[loose], codes[root[loose]]


def fingerprints(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """(doc_id, code, place): fingerprints as signed numbers and their place in Gray order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([fingerprint(t.as_py(), n) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes.view(np.int64)), pa.array(_ordered(codes))], ["doc_id", "code", "place"])

    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, code long, place long")


def _route(parts: np.ndarray, top: GrayIndex, most: int):
    """What each range gets: its own fingerprints as members, and visitors; those that go to one range together are one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, home = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            at, to = [np.arange(len(code))], [home]
            for lo in range(0, len(code), VISITORS):
                i, j = top.search(code[lo : lo + VISITORS], most)
                own, other = home[lo + i], parts[j]
                # Of two ranges one sends to the other: the first if their numbers differ by an even number.
                sends = (own != other) & ((own < other) == ((own + other) % 2 == 0))
                at.append(lo + i[sends])
                to.append(other[sends])
            at, to = np.concatenate(at), np.concatenate(to)
            visits = np.arange(len(at)) >= len(code)
            order = np.lexsort((visits, to))
            at, to, visits = at[order], to[order], visits[order]
            ends = np.append(np.flatnonzero((np.diff(to) != 0) | (np.diff(visits.astype(np.int8)) != 0)) + 1, len(to)) if len(to) else np.zeros(0, np.int64)
            rows = [code[at[lo:hi]].tobytes() for lo, hi in zip(np.append(0, ends[:-1]), ends)]
            yield pa.RecordBatch.from_arrays([pa.array(to[ends - 1]), pa.array(visits[ends - 1]), pa.array(rows, pa.binary())], ["part", "visits", "codes"])

    return run


def _links(most: int):
    """Rows by range, members before visitors -> links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, members, index = None, [], None

        def searched(codes: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal index, members
            if index is None:
                members = np.concatenate(members)
                members = members[np.argsort(_ordered(members))]
                index = GrayIndex(members)
            for lo in range(0, len(codes), VISITORS):
                some = codes[lo : lo + VISITORS]
                i, j = index.search(some, most)
                a, b = some[i], members[j]
                a, b = hung(a[a != b].view(np.int64), b[a != b].view(np.int64))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        def own() -> Iterator[pa.RecordBatch]:
            """Before the first visitor, or at the range's end, its members look for each other."""
            if index is None and members:
                yield from searched(np.concatenate(members))

        for batch in batches:
            for to, visits, codes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                codes = np.frombuffer(codes.as_buffer(), np.uint64)
                if to != part:
                    yield from own()
                    part, members, index = to, [], None
                if visits:
                    yield from own()
                    yield from searched(codes)
                else:
                    members.append(codes)
        yield from own()

    return run


def links(codes: DataFrame, most: int = MOST, size: int = RANGE) -> DataFrame:
    """codes: distinct (code, place) -> links (a, b) that connect just what is within ``most`` bits."""
    spark = codes.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-codes.count() // size))
    ranged = settle(codes.repartitionByRange(tasks, "place").sortWithinPartitions("place").select("code", "place", F.spark_partition_id().cast("long").alias("part")))
    # One row a range: the topmost level, in Gray order.
    top = ranged.groupBy("part").agg(F.bit_and("code").alias("every"), F.bit_or("code").alias("some"), F.min("place").alias("place")).orderBy("place").collect()
    if not top:
        return spark.createDataFrame([], "a long, b long")
    parts = np.array([r["part"] for r in top], np.int64)
    index = GrayIndex(*(np.array([r[c] for r in top], np.int64).view(np.uint64) for c in ("every", "some")))
    routed = ranged.select("code", "part").mapInArrow(_route(parts, index, most), "part long, visits boolean, codes binary")
    return routed.repartition(tasks, "part").sortWithinPartitions("part", "visits").mapInArrow(_links(most), "a long, b long")


def link_documents(docs: DataFrame, n: int = WORDS, most: int = MOST, size: int = RANGE) -> DataFrame:
    """doc_id, fingerprint, component_id: documents link where their fingerprints differ in at most ``most`` bits."""
    rows = settle(fingerprints(docs, n))
    codes = settle(rows.groupBy("code", "place").agg(F.min("doc_id").alias("doc_id")))
    roots = components(links(codes.select("code", "place"), most, size))
    rooted = settle(codes.select("code", "doc_id").join(roots.toDF("code", "root"), "code", "left").select("code", "doc_id", F.coalesce("root", "code").alias("root")))
    # What is aggregated by a key is settled before it is joined by that key, so a hot key's rows can be split among tasks.
    low = settle(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    of = settle(rooted.join(low, "root").select("code", "component_id"))
    return rows.join(of, "code").select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")
