"""Alignment of two tokenizers by a cogroup of postings (operator 12).

A text, with a space before it, is encoded by a byte-level BPE vocabulary (A) and by a
sentence-piece vocabulary (B). Offsets at which tokens of both end cut the tokens into
groups, and each A token links with each B token of its group. The score of a document
says how common its linked pairs are in the corpus:

1. A task encodes its documents batch by batch and lists, for each A id of the batch, the
   B ids it links with, the documents of each pair and the multiplicity there. A batch's
   row of an A id is a posting list; how many documents each pair has in the batch is
   that list's head.
2. The lists are shuffled by A id and sorted within tasks (Spark's sort spills): heads
   first, lists after. A task adds the heads up to the pairs' document counts and their
   maximum, then streams the lists past them and emits each document's part of the sums.
   An A id with more postings than BLOCK is salted: its lists are dealt to several tasks,
   each of which gets all of its heads.
3. The parts, vectors of a batch's documents, are shuffled by batch and summed by document.

Both vocabularies split a text before a space and around a newline, so words are encoded
and aligned once a worker and remembered; texts with other white space between words
(tabs, two spaces) are encoded and aligned whole.

Defined results: null and empty texts, and texts whose tokens' bytes are not the text's
(U+2581, say, which B reads as a space), have no tokens: zeros and an empty digest. Every
row is a document of its own, also with a null or repeated doc_id; equal rows count as
often as they occur; very long texts are read whole; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import memo
from lodestone.llm.bpe import SPELLING, Encoder, Places, _room, _spans
from lodestone.llm.common import only, settle

#: Postings of one A id that one task streams, about; an id with more is salted.
BLOCK = 1 << 22
#: Documents, and about as many characters, that share one posting list.
DOCS, CHARACTERS = 1 << 16, 1 << 23
#: Words that a worker remembers (about 500 bytes each) before it starts anew.
MEMORY = 500_000
#: A larger group of tokens is counted by distinct ids instead of pair by pair.
SMALL = 4096
#: Documents whose sums a task gathers before it emits them.
GATHERED = 1 << 20
_ID, _DOC = 20, 16
_START, _NEWLINE, _MARK = "\0", "\n", "▁"


class Bytes:
    """The bytes of the tokens of a vocabulary; an id without bytes has length 0."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        return self.pool[_spans(self.first[ids], self.size[ids])] if len(ids) else self.pool[:0]


def byte_level(tokenizer) -> Bytes:
    byte_of = {c: b for b, c in SPELLING.items()}
    named = tokenizer.get_vocab(with_added_tokens=True)
    tokens = [b""] * (max(named.values()) + 1)
    for name, i in named.items():
        tokens[i] = bytes(byte_of[c] for c in name) if all(c in byte_of for c in name) else b""
    return Bytes(tokens)


def sentence_pieces(pieces) -> Bytes:
    tokens = []
    for i in range(pieces.vocab_size()):
        name = pieces.id_to_piece(i)
        plain = not (pieces.is_byte(i) or pieces.is_control(i) or pieces.is_unknown(i) or pieces.is_unused(i))
        tokens.append(bytes([int(name[3:5], 16)]) if pieces.is_byte(i) else name.replace(_MARK, " ").encode() if plain else b"")
    return Bytes(tokens)


def _ragged(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(x) for x in lists], np.int64)
    return np.fromiter((i for x in lists for i in x), np.int64, int(size.sum())), size


class Aligned:
    """Alignments of texts that are encoded together. unit: which text each group is of."""

    def __init__(self, texts: list[bytes], a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], spell_a: Bytes, spell_b: Bytes):
        (a_ids, a_size), (b_ids, b_size) = a, b
        fine = self._faithful(texts, a_ids, a_size, spell_a) & self._faithful(texts, b_ids, b_size, spell_b)
        if not fine.all():
            a_ids, b_ids = a_ids[np.repeat(fine, a_size)], b_ids[np.repeat(fine, b_size)]
            a_size, b_size = np.where(fine, a_size, 0), np.where(fine, b_size, 0)
        self.fine, self.n_a, self.n_b = fine, a_size, b_size
        a_end, b_end = np.cumsum(spell_a.size[a_ids]), np.cumsum(spell_b.size[b_ids])
        both = np.intersect1d(a_end, b_end, assume_unique=True)
        self.a_ids, self.b_ids = a_ids, b_ids
        self.a_to, self.b_to = np.searchsorted(a_end, both, side="right"), np.searchsorted(b_end, both, side="right")
        self.in_a, self.in_b = np.diff(self.a_to, prepend=0), np.diff(self.b_to, prepend=0)
        self.unit = np.repeat(np.arange(len(texts)), a_size)[self.a_to - 1] if len(both) else np.zeros(0, np.int64)
        self.groups = np.bincount(self.unit, minlength=len(texts))
        self.links = np.bincount(self.unit, self.in_a * self.in_b, len(texts)).astype(np.int64)

    @staticmethod
    def _faithful(texts: list[bytes], ids: np.ndarray, size: np.ndarray, spell: Bytes) -> np.ndarray:
        """Which texts their tokens' bytes are equal to."""
        if len(ids) and spell.size[ids].min() > 0 and np.array_equal(spell.spell(ids), np.frombuffer(b"".join(texts), np.uint8)):
            # All bytes fit; each text's must as well.
            ends = np.append(0, np.cumsum(spell.size[ids]))[np.cumsum(size)]
            return ends == np.cumsum([len(t) for t in texts])
        out, lo = np.zeros(len(texts), bool), 0
        for k, (t, n) in enumerate(zip(texts, size)):
            own = ids[lo : lo + n]
            out[k] = n > 0 and spell.size[own].min() > 0 and spell.spell(own).tobytes() == t
            lo += n
        return out

    def pairs(self, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The linked ids of the groups, pair by pair: keys, and how many a group has."""
        na, nb = self.in_a[groups], self.in_b[groups]
        left = np.repeat(_spans((self.a_to - self.in_a)[groups], na), np.repeat(nb, na))
        right = _spans(np.repeat((self.b_to - self.in_b)[groups], na), np.repeat(nb, na))
        return self.a_ids[left] << _ID | self.b_ids[right], na * nb

    def weighed(self, group: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct linked pairs of a large group and their multiplicities."""
        a, m = np.unique(self.a_ids[self.a_to[group] - self.in_a[group] : self.a_to[group]], return_counts=True)
        b, n = np.unique(self.b_ids[self.b_to[group] - self.in_b[group] : self.b_to[group]], return_counts=True)
        return (a[:, None] << _ID | b).ravel(), (m[:, None] * n).ravel()

    def written(self) -> list[str]:
        """Each group as a1,a2|b1."""
        a, b = list(map(str, self.a_ids.tolist())), list(map(str, self.b_ids.tolist()))
        ta, tb, out, i, j = self.a_to.tolist(), self.b_to.tolist(), [], 0, 0
        for x, y in zip(ta, tb):
            out.append(f"{a[i] if x == i + 1 else ','.join(a[i:x])}|{b[j] if y == j + 1 else ','.join(b[j:y])}")
            i, j = x, y
        return out


class Aligner:
    """Alignments of texts; words are remembered."""

    def __init__(self, bpe: str, piece: str, memory: int = MEMORY):
        import sentencepiece

        self.encoder = Encoder(bpe)
        for t in (self.encoder.tokenizer, self.encoder.of_words):
            t.encode_special_tokens = True  # their strings in a text are plain text
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece)
        self.spell_a, self.spell_b = byte_level(self.encoder.tokenizer), sentence_pieces(self.pieces)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.vocab_size())]
        self.before = self.pieces.encode(_NEWLINE)
        # Words can be encoded one by one if no piece reaches over a space or a newline.
        self.cut = self.encoder.together and len(self.before) == 2 and not any(_NEWLINE in n or _MARK in n.lstrip(_MARK) for n in names)
        self.memory = memory
        self.clear()

    def clear(self) -> None:
        self.place = Places()
        self.pool, self.used, self.strings = np.zeros(1 << 16, np.int64), 0, []
        # Of each word: its first link in the pool, how many (-1: a text with it is aligned whole), tokens of A and B, groups.
        self.facts = np.zeros((5, 1 << 14), np.int64)

    def _learn(self, new: list[str]) -> None:
        base, at, bodies = len(self.place) - len(new), [], []
        for i, w in enumerate(new):
            core = w.removeprefix(_START)
            if w == _NEWLINE or core and not core[0].isspace() and not core[-1].isspace():
                at.append(i)
                bodies.append(core if w == _NEWLINE or len(core) < len(w) else " " + core)
        facts = np.zeros((5, len(new)), np.int64)
        facts[1] = -1
        self.strings += [""] * len(new)
        if at:
            lined = [k for k, x in enumerate(bodies) if x == _NEWLINE]
            parts, sizes = self.encoder._ids(self.encoder.tokenizer, [x for x in bodies if x != _NEWLINE], str)
            a_size = np.insert(sizes, [k - i for i, k in enumerate(lined)], 1)
            a_ids = np.full(a_size.sum(), self.encoder.newline[0], np.int64)
            a_ids[np.repeat(~np.isin(np.arange(len(bodies)), lined), a_size)] = np.concatenate([*parts, np.zeros(0, np.int64)])
            # B puts a space before each text; behind a newline there is none.
            starts = [x[0] != " " for x in bodies]
            b_ids = self.pieces.encode([_NEWLINE + x if s else x[1:] for x, s in zip(bodies, starts)], num_threads=1)
            b = _ragged([x[len(self.before) :] if s and x[: len(self.before)] == self.before else x for x, s in zip(b_ids, starts)])
            got = Aligned([x.encode() for x in bodies], (a_ids, a_size), b, self.spell_a, self.spell_b)
            keys, per_group = got.pairs(small := np.flatnonzero(got.in_a * got.in_b <= SMALL))
            held = np.bincount(got.unit[small], per_group, len(bodies)).astype(np.int64)
            facts[0, at] = self.used + np.cumsum(held) - held
            facts[1, at] = np.where(got.fine & (held == got.links), held, -1)
            facts[2, at], facts[3, at], facts[4, at] = got.n_a, got.n_b, got.groups
            self.pool = _room(self.pool, self.used + len(keys))
            self.pool[self.used : self.used + len(keys)] = keys
            self.used += len(keys)
            written, lo = got.written(), 0
            for i, n in zip(at, got.groups.tolist()):
                self.strings[base + i] = ";".join(written[lo : lo + n])
                lo += n
        if self.facts.shape[1] < base + len(new):
            self.facts = np.concatenate([self.facts, np.zeros((5, max(len(new), base)), np.int64)], axis=1)
        self.facts[:, base : base + len(new)] = facts

    def whole(self, text: str) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], tuple, str]:
        a, b = np.array(self.encoder.tokenizer.encode(" " + text, add_special_tokens=False).ids, np.int64), np.array(self.pieces.encode(text), np.int64)
        size = lambda x: np.array([len(x)], np.int64)
        got = Aligned([(" " + text).encode()], (a, size(a)), (b, size(b)), self.spell_a, self.spell_b)
        keys, _ = got.pairs(np.flatnonzero(got.in_a * got.in_b <= SMALL))
        extra = [got.weighed(g) for g in np.flatnonzero(got.in_a * got.in_b > SMALL)]
        return keys, extra, (int(got.n_a[0]), int(got.n_b[0]), int(got.groups[0]), int(got.links[0])), ";".join(got.written())

    def align(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], tuple, str]]:
        """For each text: keys of its links one by one, distinct keys and multiplicities of those in large groups, counts of tokens of A and B, groups and links, digest."""
        if len(self.place) > self.memory:
            self.clear()
        self.place.new = new = []
        look, found = self.place.__getitem__, []
        for text in texts:
            if not text or not self.cut or _START in text:
                found.append(None)
            else:
                found.append(np.fromiter(map(look, text.replace(_NEWLINE, f" {_NEWLINE} {_START}").split(" ")), np.int64))
        if new:
            self._learn(new)
        word = self.strings.__getitem__
        for text, at in zip(texts, found):
            if not text:
                yield np.zeros(0, np.int64), [], (0, 0, 0, 0), ""
                continue
            if at is None or (facts := self.facts[:, at])[1].min() < 0:
                keys, extra, counts, line = self.whole(text)
            else:
                keys, extra = self.pool[_spans(facts[0], facts[1])], []
                counts = (*facts[2:].sum(axis=1).tolist(), len(keys))
                line = ";".join(map(word, at.tolist()))
            yield keys, extra, counts, hashlib.sha256(line.encode()).hexdigest() if counts[0] else ""


_aligners: dict[tuple[str, str], Aligner] = {}
memo.register("alignment", lambda: [x.clear() for x in _aligners.values()])


def aligner(bpe: str, piece: str) -> Aligner:
    """One a worker process."""
    memo.use("alignment")
    if (bpe, piece) not in _aligners:
        _aligners[bpe, piece] = Aligner(bpe, piece)
    return _aligners[bpe, piece]


COUNTS = ("n_a", "n_b", "n_groups", "n_links")
#: A document's row has a key and no list; a posting list's row has an A id, and the batch as key.
LISTS = f"key long, doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string, a int, n_postings long, heads binary, counts binary, docs binary, times binary, many binary"
_ARROW = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in LISTS.split(", "))])


def _cut(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of an array as binary values."""
    offsets = np.append(0, ends * values.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _joined(column: pa.ChunkedArray | pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of binary cells, one after the other, and how many each cell has."""
    cells = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = np.frombuffer(cells.buffers()[1], np.int32, len(cells) + 1, cells.offset * 4)
    size = np.dtype(kind).itemsize
    data = np.frombuffer(cells.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    return data.view(kind) if data.ctypes.data % size == 0 else np.frombuffer(data.tobytes(), kind), np.diff(at) // size


def _lists(batch: int, docs: list[tuple[np.ndarray, list, tuple, str]]) -> dict[str, pa.Array] | None:
    """The posting lists of a batch of documents, one row an A id."""
    sizes = [len(d[0]) for d in docs]
    one = np.concatenate([d[0] for d in docs]) << _DOC | np.repeat(np.arange(len(docs)), sizes)
    one.sort()
    first = np.flatnonzero(np.diff(one, prepend=-1))
    keys, times = one[first], np.diff(np.append(first, len(one)))
    extra = [(k << _DOC | i, m) for i, d in enumerate(docs) for k, m in d[1]]
    if extra:
        keys, where = np.unique(np.concatenate([keys, *(k for k, _ in extra)]), return_inverse=True)
        added = np.zeros(len(keys), np.int64)
        np.add.at(added, where, np.concatenate([times, *(m for _, m in extra)]))
        times = added
    if not len(keys):
        return None
    pair = keys >> _DOC
    head = np.flatnonzero(np.diff(pair, prepend=-1))
    per_head = np.diff(np.append(head, len(pair)))
    of = pair[head] >> _ID
    row = np.flatnonzero(np.diff(of, prepend=-1))
    head_ends = np.append(row[1:], len(of))
    posting_ends = np.cumsum(per_head)[head_ends - 1]
    large = times >= 255
    return {
        "key": pa.array(np.full(len(row), batch, np.int64)), "a": pa.array(of[row].astype(np.int32)), "n_postings": pa.array(np.diff(posting_ends, prepend=0)),
        "heads": _cut((pair[head] & (1 << _ID) - 1).astype(np.uint32), head_ends), "counts": _cut(per_head.astype(np.uint32), head_ends),
        "docs": _cut((keys & (1 << _DOC) - 1).astype(np.uint16), posting_ends), "times": _cut(np.minimum(times, 255).astype(np.uint8), posting_ends),
        "many": _cut(times[large], np.cumsum(large)[posting_ends - 1]),
    }


def posting_lists(docs: DataFrame, bpe: str, piece: str) -> DataFrame:
    """LISTS: a row of each document and the posting lists of each batch of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        align = aligner(bpe, piece)
        number, held, size = TaskContext.get().partitionId() << 24, [], 0

        def table(columns: dict[str, pa.Array]) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in _ARROW], schema=_ARROW)

        def emit() -> Iterator[pa.RecordBatch]:
            lists = _lists(number, [d for _, d in held])
            own = {"key": pa.array((number << _DOC) + np.arange(len(held))), "doc_id": pa.array([i for i, _ in held], pa.int64()), "groups_sha256": pa.array([d[3] for _, d in held])}
            yield table(own | {c: pa.array([d[2][k] for _, d in held], pa.int64()) for k, c in enumerate(COUNTS)})
            if lists:
                yield table(lists)

        for batch in batches:
            texts, ids = batch.column(1), batch.column(0).to_pylist()
            for lo in range(0, len(ids), 512):
                own = texts.slice(lo, 512).to_pylist()
                for i, text, d in zip(ids[lo : lo + 512], own, align.align(own)):
                    held.append((i, d))
                    size += len(text or "")
                    if size >= CHARACTERS or len(held) == DOCS:
                        yield from emit()
                        number, held, size = number + 1, [], 0
        if held:
            yield from emit()

    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, LISTS)


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], *(np.add.reduceat(v[order], first) if len(keys) else v for v in values)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by A id and salt, heads before lists -> parts of the sums of a batch's documents, a row a batch."""
    last, carried, parts = None, (np.zeros(0, np.int64), np.zeros(0, np.int64)), []

    def gathered(every: bool) -> Iterator[pa.RecordBatch]:
        nonlocal parts
        if parts and (every or sum(len(p[0]) for p in parts) > 4 * GATHERED):
            parts = [_sums(*(np.concatenate(x) for x in zip(*parts)))]
            if every or len(parts[0][0]) > GATHERED:
                keys, best, sums = parts[0]
                ends = np.append(np.flatnonzero(np.diff(keys >> _DOC)) + 1, len(keys)) if len(keys) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((keys >> _DOC)[ends - 1]), _cut((keys & (1 << _DOC) - 1).astype(np.uint16), ends), _cut(best, ends), _cut(sums, ends)], ["batch", "docs", "n_best", "count_sum"])
                parts = []

    for batch in batches:
        a, salt, kind, number = (batch.column(k).to_numpy() for k in range(4))
        if not len(a):
            continue
        run = np.cumsum(np.append(last != (a[0], salt[0]), (np.diff(a) != 0) | (np.diff(salt) != 0))).astype(np.int64)
        heads, per_row = _joined(batch.column(4), np.uint32)
        counts, _ = _joined(batch.column(5), np.uint32)
        keys = np.repeat(run, per_row) << _ID | heads
        is_head = np.repeat(kind == 0, per_row)
        # What the batch before had of the first run, which has number 0 where it goes on.
        seen, count = _sums(np.concatenate([carried[0], keys[is_head]]), np.concatenate([carried[1], counts[is_head].astype(np.int64)]))
        of = seen >> _ID
        first = np.flatnonzero(np.diff(of, prepend=-1))
        best = count == np.repeat(np.maximum.reduceat(count, first), np.diff(np.append(first, len(of))))
        if not is_head.all():
            at = np.searchsorted(seen, keys[~is_head])
            n = counts[~is_head]
            docs, per_list = _joined(batch.column(6), np.uint16)
            times = _joined(batch.column(7), np.uint8)[0].astype(np.int64)
            times[times == 255] = _joined(batch.column(8), np.int64)[0]
            parts.append(((np.repeat(number, per_list) << _DOC) + docs, times * np.repeat(best[at], n), times * np.repeat(count[at], n)))
            yield from gathered(False)
        goes_on = of == run[-1]
        last, carried = (a[-1], salt[-1]), (seen[goes_on] & (1 << _ID) - 1, count[goes_on])
    yield from gathered(True)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts, sorted by batch -> (key, n_best, count_sum) of each document that has any."""
    last, total = None, np.zeros((2, DOCS), np.int64)

    def emit() -> Iterator[pa.RecordBatch]:
        held = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array((int(last) << _DOC) + held), *(pa.array(t[held]) for t in total)], ["key", "n_best", "count_sum"])
        total[:] = 0

    for batch in batches:
        numbers = batch.column(0).to_numpy()
        ends = np.append(np.flatnonzero(np.diff(numbers)) + 1, len(numbers))
        lo = 0
        for hi in ends if len(numbers) else ():
            if numbers[lo] != last:
                if last is not None:
                    yield from emit()
                last = numbers[lo]
            docs = _joined(batch.column(1).slice(lo, hi - lo), np.uint16)[0]
            for k in range(2):
                np.add.at(total[k], docs, _joined(batch.column(2 + k).slice(lo, hi - lo), np.int64)[0])
            lo = hi
    if last is not None:
        yield from emit()


def align(docs: DataFrame, bpe: str, piece: str, block: int = BLOCK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs."""
    rows = settle(posting_lists(docs, bpe, piece))
    lists = rows.filter("a is not null")
    # One row an A id at most: as many as the vocabulary has.
    salts = settle(lists.groupBy("a").agg(F.ceil(F.sum("n_postings") / block).cast("int").alias("salts")))
    salted = lists.join(F.broadcast(salts), "a")
    none = F.lit(b"")
    heads = salted.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "key", "heads", "counts", none.alias("docs"), none.alias("times"), none.alias("many"))
    own = salted.select("a", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), "key", "heads", "counts", "docs", "times", "many")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_lists = heads.unionByName(own).repartition(tasks, "a", "salt").sortWithinPartitions("a", "salt", "kind")
    parts = sorted_lists.mapInArrow(_stream, "batch long, docs binary, n_best binary, count_sum binary")
    sums = parts.repartition(tasks, "batch").sortWithinPartitions("batch").mapInArrow(_added, "key long, n_best long, count_sum long")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.filter("a is null").join(sums, "key", "left").select("doc_id", *COUNTS, zero("n_best"), zero("count_sum"), "groups_sha256")
