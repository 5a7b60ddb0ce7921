"""Token ids in a binary format with Re-Pair grammar compression (operator 5).

Documents are dealt out by ranges of doc_id, one shard a range, and a shard is encoded
in ascending doc_id order, block by block. Within a block the most frequent pairs of
neighbouring symbols become nonterminals, round after round, until no pair occurs
``LEAST`` times, which is about where a rule still pays for itself; a pair never spans
two documents, so each document is a run of symbols that decodes alone. A row of the file
is one block: its first and last doc_id, its rules, the length to which each rule
expands, the symbols, and for each document its id, its place among the symbols and the
ids before it in the shard.
Symbols are unsigned 16-bit integers as long as vocabulary and rules allow.

Defined results: a null or empty text is its end id alone; null ids come first; equal
ids are ordered by their text, equal rows are written each; a very long text is a block
of its own; extra columns are ignored; an empty table gives a file without rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.bpe import _spans, encoder
from lodestone.llm.common import new_path, only

END_ID = 0
#: A block is closed at this many ids; a longer document is a block of its own.
BLOCK_IDS = 1 << 18
PAIRS_A_ROUND, LEAST = 2048, 16
BLOCK = "shard int, block int, first_id long, last_id long, vocabulary int, doc_ids binary, known binary, starts binary, at binary, rules binary, rule_sizes binary, wide boolean, symbols binary"
_BUCKETS = 17


def _bucket(key: np.ndarray) -> np.ndarray:
    return (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _BUCKETS)).view(np.int64)


def compress(ids: np.ndarray, ends: np.ndarray, vocabulary: int, pairs: int = PAIRS_A_ROUND, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids of documents that end before ends -> symbols, ends among the symbols, rules as rows of two symbols.
    Rule k is written as the symbol vocabulary + k and uses earlier rules only. Rounds go on until no pair is left that
    occurs least times; a round replaces its most frequent pairs, at most so many."""
    seq, rules, made = ids.astype(np.uint64), [], 0
    last = np.zeros(len(seq), bool)
    last[ends - 1] = True
    turn = np.full(1 << _BUCKETS, -1, np.int64)
    # Only pairs that are frequent enough, or new, can be replaced in a later round.
    active = np.flatnonzero(~last[:-1])
    while len(active):
        key = seq[active] << np.uint64(32)
        key |= seq[active + 1]
        bucket = _bucket(key)
        often = np.flatnonzero(np.bincount(bucket, minlength=1 << _BUCKETS)[bucket] >= least)
        active, key, bucket = active[often], key[often], bucket[often]
        order = np.sort(key)
        first = np.flatnonzero(np.append(True, order[1:] != order[:-1])[: len(order)])
        count = np.diff(np.append(first, len(order)))
        chosen, count = order[first[count >= least]], count[count >= least]
        if not len(chosen):
            break
        chosen = chosen[np.argsort(count, kind="stable")[-pairs:]]
        # Of pairs in one bucket the most frequent has this round, others a later one.
        own = _bucket(chosen)
        turn[own] = np.arange(len(chosen))
        chosen = chosen[turn[own] == np.arange(len(chosen))]
        turn[_bucket(chosen)] = np.arange(len(chosen))
        rank = turn[bucket]
        hit = np.flatnonzero((rank >= 0) & (chosen[rank] == key))
        turn[own] = -1
        where, rank = active[hit], rank[hit]
        # Of occurrences that overlap in a row, take every other one.
        if (near := np.diff(where) == 1).any():
            heads = np.flatnonzero(np.append(True, ~near))
            head = np.repeat(heads, np.diff(np.append(heads, len(where))))
            take = (np.arange(len(where)) - head) % 2 == 0
            where, rank = where[take], rank[take]
        seq[where] = (vocabulary + made + rank).astype(np.uint64)
        last[where] |= last[where + 1]
        stay = np.ones(len(seq), bool)
        stay[where + 1] = False
        open_ = np.zeros(len(seq), bool)
        open_[active] = open_[where] = True
        # The symbol before a replaced pair; where it is itself the end of a replaced pair, that pair's first.
        before = where[where > 0] - 1
        open_[before - ~stay[before]] = True
        open_ &= ~last
        seq, last, active = seq[stay], last[stay], np.flatnonzero(open_[stay])
        rules.append(np.stack([chosen >> np.uint64(32), chosen & np.uint64(0xFFFFFFFF)], axis=1))
        made += len(chosen)
    return seq, np.flatnonzero(last) + 1, np.concatenate([*rules, np.zeros((0, 2), np.uint64)]).astype("<u4")


def rule_sizes(rules: np.ndarray, vocabulary: int) -> np.ndarray:
    """How many ids each rule expands to."""
    size = np.zeros(len(rules), np.int64)
    known = np.zeros(len(rules), bool)
    while not known.all():
        inner = np.where(rules >= vocabulary, rules - np.uint32(vocabulary), 0).astype(np.int64)
        ready = ~known & ((rules < vocabulary) | known[inner]).all(axis=1)
        size[ready] = np.where(rules[ready] < vocabulary, 1, size[inner[ready]]).sum(axis=1)
        known |= ready
    return size


def expansions(rules: np.ndarray, sizes: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """pool, first, size: the symbol s is pool[first[s] : first[s] + size[s]]."""
    first = np.concatenate([np.arange(vocabulary), vocabulary + np.cumsum(sizes) - sizes])
    size = np.concatenate([np.ones(vocabulary, np.int64), sizes])
    pool = np.zeros(vocabulary + int(sizes.sum()), "<u4")
    pool[:vocabulary] = np.arange(vocabulary)
    for s in np.unique(sizes):  # shorter expansions first: a rule's parts are shorter than the rule
        own = np.flatnonzero(sizes == s)
        parts = rules[own].ravel().astype(np.int64)
        pool[_spans(first[vocabulary + own], sizes[own])] = pool[_spans(first[parts], size[parts])]
    return pool, first, size


def encode_shards(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, shards: int | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """The rows of the file, one a block."""
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, bpe, end = TaskContext.get().partitionId(), encoder(tokenizer_path), np.array([end_id], "<u4")
        vocabulary = bpe.tokenizer.get_vocab_size()
        block, before, held, names, size = 0, 0, [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal block, before, held, names, size
            counts = np.array([len(x) for x in held], np.int64)
            symbols, ends, rules = compress(np.concatenate(held), np.cumsum(counts), vocabulary)
            wide = vocabulary + len(rules) > 1 << 16
            row = {
                "shard": shard, "block": block, "first_id": min((x for x in names if x is not None), default=None), "last_id": max((x for x in names if x is not None), default=None), "vocabulary": vocabulary,
                "doc_ids": np.array([x or 0 for x in names], "<i8").tobytes(), "known": np.array([x is not None for x in names], "u1").tobytes(),
                "starts": (before + np.append(0, np.cumsum(counts))).astype("<i8").tobytes(), "at": np.append(0, ends).astype("<i8").tobytes(),
                "rules": rules.tobytes(), "rule_sizes": rule_sizes(rules, vocabulary).astype("<i8").tobytes(), "wide": wide, "symbols": symbols.astype("<u4" if wide else "<u2").tobytes(),
            }
            block, before, held, names, size = block + 1, before + int(counts.sum()), [], [], 0
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 6, pa.bool_(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], list(row))

        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                for name, ids in zip(part.column(0).to_pylist(), bpe.encode(part.column(1).to_pylist())):
                    if held and size + len(ids) + 1 > block_ids:
                        yield close()
                    held.append(np.append(ids, end))
                    names.append(name)
                    size += len(ids) + 1
        if held:
            yield close()

    return only(docs, "doc_id", "text").repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(run, BLOCK)


def write_shards(docs: DataFrame, path: str, tokenizer_path: str, **options) -> None:
    encode_shards(docs, tokenizer_path, **options).write.parquet(path)


class Block:
    """One row of the file."""

    def __init__(self, row: dict):
        self.vocabulary = row["vocabulary"]
        self.doc_ids, self.known = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["known"], "u1").astype(bool)
        self.starts, self.at = np.frombuffer(row["starts"], "<i8"), np.frombuffer(row["at"], "<i8")
        rules, sizes = np.frombuffer(row["rules"], "<u4").reshape(-1, 2), np.frombuffer(row["rule_sizes"], "<i8")
        self.pool, self.first, self.size = expansions(rules, sizes, self.vocabulary)
        self.symbols = np.frombuffer(row["symbols"], "<u4" if row["wide"] else "<u2")

    def ids(self, k: int) -> np.ndarray:
        """Ids of the k-th document, its end id included; nothing else is decoded."""
        return self._expanded(self.symbols[self.at[k] : self.at[k + 1]])

    def every(self) -> list[np.ndarray]:
        """Ids of all documents."""
        at = (self.starts - self.starts[0]).tolist()
        flat = self._expanded(self.symbols)
        return [flat[a:b] for a, b in zip(at, at[1:])]

    def _expanded(self, symbols: np.ndarray) -> np.ndarray:
        return self.pool[_spans(self.first[symbols], self.size[symbols])]


def read_shards(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row a document: doc_id, shard, start (ids before it in its shard), n_tokens, ids_crc32[, ids]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                block = Block(row)
                own = block.every()
                arrays = [
                    pa.array(block.doc_ids, pa.int64(), mask=~block.known), pa.array([row["shard"]] * len(own), pa.int32()), pa.array(block.starts[:-1], pa.int64()),
                    pa.array([len(x) for x in own], pa.int64()), pa.array([zlib.crc32(x) for x in own], pa.int64()),
                ]
                names = ["doc_id", "shard", "start", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array([x.tobytes() for x in own], pa.binary())] * with_ids, names + ["ids"] * with_ids)

    return spark.read.schema(BLOCK).parquet(path).mapInArrow(run, "doc_id long, shard int, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """The ids of the documents with this id: files and blocks are skipped by their first and last id, and only the
    documents' own symbols are decoded."""
    rows = spark.read.schema(BLOCK).parquet(path).filter((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).toLocalIterator()
    return [block.ids(int(k)) for row in rows for block in [Block(row.asDict())] for k in np.flatnonzero((block.doc_ids == doc_id) & block.known)]


def encode_and_read(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Writes all documents and reads the files back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = new_path(spark, "ids")
    write_shards(docs, path, tokenizer_path, end_id=end_id)
    sums = spark.read.schema(BLOCK).parquet(path)
    # Totals come from the blocks' own headers, so the symbols are decoded once.
    ends = sums.select("shard", "starts").mapInArrow(_block_ends, "shard int, size long").groupBy("shard").agg(F.max("size").alias("size"))
    before = F.sum("size").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    bases = ends.select("shard", F.coalesce(before, F.lit(0)).alias("base"))
    return read_shards(spark, path).join(bases, "shard").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def _block_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = [int(np.frombuffer(x[-8:], "<i8")[0]) for x in batch.column("starts").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array(ends, pa.int64())], ["shard", "size"])
