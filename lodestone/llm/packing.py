"""Best-fit packing of tokenised documents into sequences of a fixed length (operator 1).

Lengths are small integers, so pieces of one length are interchangeable and the whole
packing is decided on the histogram of lengths, which has at most ``capacity`` entries
whatever the corpus. Pieces above a third of the capacity are matched first: at most
two share a sequence, and each, from the longest on, takes the longest that still fits.
Shorter pieces then go, from the longest on, to the tightest gap that holds them. The
plan is a list of runs "pieces of this length with ranks a to b go to sequences from s
on"; each piece finds its run by its rank among the pieces of its length, which needs
only counts a partition.

Defined results: a null or empty text is its end id alone; null ids stay; equal rows
are packed each; a very long text is many pieces; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.bpe import encoder
from lodestone.llm.common import only, settle

CAPACITY = 1024
END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
BATCH_DOCS = 256


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only longer ones are cut, the first piece takes what is over."""
    head = n % capacity or min(n, capacity)
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))]


def tokenise(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents: PIECES, and the ids themselves if asked for.
    part and nth number the pieces of one length within a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        bpe, end = encoder(tokenizer_path), np.array([end_id], "<u4")
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_DOCS):
                block = batch.slice(at, BATCH_DOCS)
                out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "nth", "ids")}
                for doc_id, ids in zip(block.column(0).to_pylist(), bpe.encode(block.column(1).to_pylist())):
                    raw = np.append(ids, end).tobytes()
                    for k, (start, n) in enumerate(cut(len(raw) // 4, capacity)):
                        own = raw[4 * start : 4 * (start + n)]
                        for name, value in (("doc_id", doc_id), ("piece", k), ("start", start), ("length", n), ("ids_crc32", zlib.crc32(own)), ("nth", int(seen[n]))):
                            out[name].append(value)
                        seen[n] += 1
                        if with_ids:
                            out["ids"].append(own)
                arrays = [pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32()), *(pa.array(out[k], pa.int64()) for k in ("start", "length", "ids_crc32")), pa.array([part] * len(out["piece"]), pa.int32()), pa.array(out["nth"], pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(out["ids"], pa.binary())] * with_ids, names + ["ids"] * with_ids)

    return only(docs, "doc_id", "text").mapInArrow(run, PIECES + ", ids binary" * with_ids)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, pieces a sequence, first sequence, offset) and the number of sequences.
    A run holds the ranks up to the next run of its length."""
    left = {n: c for n, c in sorted(counts.items(), reverse=True) if c}
    taken = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: groups (first sequence, sequences)
    total = 0

    def put(n: int, each: int, bins: int, first: int, gap: int) -> None:
        """each pieces of length n to each of the bins from first on, which have this gap."""
        runs.append((n, taken[n], each, first, capacity - gap))
        taken[n] += each * bins
        left[n] -= each * bins
        if gap > each * n:
            gaps.setdefault(gap - each * n, []).append((first, bins))

    large = [n for n in left if 3 * n > capacity]
    for n in large:
        while left[n]:
            mate = next((m for m in large if m <= min(n, capacity - n) and left[m] and (m < n or left[m] > 1)), None)
            bins = left[n] if mate is None else left[n] // 2 if mate == n else min(left[n], left[mate])
            runs.append((n, taken[n], 1 + (mate == n), total, 0))
            taken[n] += bins * (1 + (mate == n))
            left[n] -= bins * (1 + (mate == n))
            if mate is not None and mate != n:
                runs.append((mate, taken[mate], 1, total, n))
                taken[mate] += bins
                left[mate] -= bins
            if rest := capacity - n - (mate or 0):
                gaps.setdefault(rest, []).append((total, bins))
            total += bins
    for n in [n for n in left if 3 * n <= capacity]:
        while left[n]:
            gap = min((g for g in gaps if g >= n), default=None)
            if gap is None:
                bins = -(-left[n] // (capacity // n))
                gaps[gap := capacity] = [(total, bins)]
                total += bins
            first, bins = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
            each = min(gap // n, left[n])
            full = min(bins, left[n] // each)
            if bins > full:
                gaps.setdefault(gap, []).append((first + full, bins - full))
            put(n, each, full, first, gap)
    return runs, total


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Gives settled pieces their sequence_id and offset."""
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    # A length has one row a partition here, so the running sums stay small.
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = settle(counts.select("length", "part", "n", F.coalesce(before, F.lit(0)).alias("base")))
    totals = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs, _ = plan(totals, capacity)
    runs.sort()
    length, rank, each, first, offset = np.array(runs, dtype=np.int64).reshape(-1, 5).T
    starts = np.searchsorted(length, np.arange(capacity + 2))
    names = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("length").to_numpy()
            nth = batch.column("nth").to_numpy() + batch.column("base").to_numpy()
            run = np.empty(len(own), np.int64)
            order = np.argsort(own, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(own[order])) + 1) if len(own) else []:
                lo, hi = starts[own[group[0]]], starts[own[group[0]] + 1]
                run[group] = lo + np.searchsorted(rank[lo:hi], nth[group], side="right") - 1
            over = nth - rank[run]
            spot = [first[run] + over // each[run], offset[run] + over % each[run] * own]
            keep = [n for n in names if n not in ("part", "nth")]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + [pa.array(x, pa.int64()) for x in spot], [*keep, "sequence_id", "offset"])

    fields = ", ".join(f"{n} {t}" for n, t in pieces.dtypes if n not in ("part", "nth"))
    return pieces.join(only(bases, "length", "part", "base"), ["length", "part"]).select(*names, "base").mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset."""
    return pack(settle(tokenise(docs, tokenizer_path, capacity, end_id, with_ids)), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The training sequences themselves, from pieces packed with their ids: sequence_id,
    doc_ids in order, and ids as little-endian unsigned 32-bit integers. A sequence has a
    bounded number of pieces."""
    own = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(own.alias("p")).select("sequence_id", F.col("p.doc_id").alias("doc_ids"), F.aggregate("p.ids", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"))
