"""Operator 12 against a plain version that encodes and aligns text by text, pair by pair."""

import hashlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import alignment
from lodestone.llm.bpe import SPELLING
from lodestone.llm.queries import vocabulary

A, B = vocabulary(), vocabulary("piece_bpe_32k.model")
ODD = ["", None, "a  b", "a\n\nb", " a", "a ", "\na", "a\n", " ", "\n", "a \tb", "x<|endoftext|> y\nz <s> </s> <unk> <0x41>", "\0 a", "don't\nit's", "a 　b", "é ü\nß, ok. Привет мир", "12 34,5 ...\n!!", "a▁b", "▁", "word, word. Word.", "a" * 3000, "日本語 テキスト 🙂🙂", "ﬁne é", "a b c", "x\r\ny", "﻿a", "x" * 70 + "é" * 70]
NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def plain():
    import sentencepiece
    from tokenizers import Tokenizer

    t, s = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    back = {c: b for b, c in SPELLING.items()}
    one = lambda i: bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode()

    def links(text):
        """Counter of pairs, (n_a, n_b, n_groups), digest."""
        if not text:
            return Counter(), (0, 0, 0), ""
        want = (" " + text).encode()
        a = [(i, bytes(back[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, one(i)) for i in s.encode(text)]
        if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            return Counter(), (0, 0, 0), ""
        ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (a, b)]
        both = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in both]
        for k, (side, own) in enumerate(zip((a, b), ends)):
            for (i, _), e in zip(side, own):
                groups[bisect_left(both, e)][k].append(i)
        found = Counter()
        for ga, gb in groups:
            for (x, m), (y, n) in ((p, q) for p in Counter(ga).items() for q in Counter(gb).items()):
                found[x, y] += m * n
        line = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        return found, (len(a), len(b), len(groups)), hashlib.sha256(line.encode()).hexdigest()

    return links


def expected(plain, rows):
    each = [(i, *plain(text)) for i, text in rows]
    count = Counter(p for _, found, *_ in each for p in found)
    most = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    return sorted(((i, *sizes, sum(found.values()), sum(m for p, m in found.items() if count[p] == most[p[0]]), sum(m * count[p] for p, m in found.items()), line) for i, found, sizes, line in each), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", *NAMES).collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "z") for i, t in rows], "doc_id long, text string, a int, key int, salt string")


def test_every_document(spark, sf, plain):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(alignment.align(docs, A, B)) == expected(plain, [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_odd_rows(spark, plain):
    r = np.random.default_rng(5)
    rows = [*enumerate(ODD), (None, "no id, no id"), (None, "no id, no id"), (3, "the same id"), (3, "the same id"), (900, "long text of words " * 20000)]
    rows += [(1000 + i, " ".join(r.choice(["the", "hea,", "ción", "wh", "über"], int(r.integers(1, 400))))) for i in range(60)]
    want = expected(plain, rows)
    for parts in (1, 7):
        assert got(alignment.align(frame(spark, rows).repartition(parts), A, B)) == want


def test_hot_ids_are_salted_and_batches_split(spark, plain, monkeypatch):
    rows = [(i, f"the word the {'one' if i % 3 else 'two'}, ok " + "x" * (i % 5)) for i in range(500)]
    assert got(alignment.align(frame(spark, rows).repartition(6), A, B, block=20)) == expected(plain, rows)


def test_no_rows(spark):
    assert alignment.align(frame(spark, []), A, B).collect() == []


def test_small_memory_and_large_groups(plain, monkeypatch):
    monkeypatch.setattr(alignment, "SMALL", 4)
    few = alignment.Aligner(A, B, memory=3)
    for _ in range(2):
        for text, (keys, extra, counts, digest) in zip(ODD, few.align(ODD)):
            found, sizes, line = plain(text)
            held = Counter(keys.tolist())
            for k, m in extra:
                held.update(dict(zip(k.tolist(), m.tolist())))
            assert (counts, digest) == ((*sizes, sum(found.values())), line) and held == {x << 20 | y: m for (x, y), m in found.items()}, text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab.,'é \n\t!1　▁<0x>日", max_size=40))
def test_any_text(text):
    shared = test_any_text.__dict__.setdefault("aligner", alignment.Aligner(A, B)) if "aligner" not in test_any_text.__dict__ else test_any_text.__dict__["aligner"]
    _, _, counts, digest = next(iter(shared.align([text])))
    _, _, whole, line = shared.whole(text) if text else (0, 0, (0, 0, 0, 0), "")
    assert counts == whole and digest == (hashlib.sha256(line.encode()).hexdigest() if counts[0] else "")


def test_stream_merges_runs_over_batches():
    """Heads and lists of one id may lie in different Arrow batches."""
    import pyarrow as pa

    first = alignment._lists(0, [(np.array([5 << 20 | 1, 5 << 20 | 2, 6 << 20 | 1]), [], (), ""), (np.array([5 << 20 | 1, 5 << 20 | 1]), [(np.array([6 << 20 | 9]), np.array([700]))], (), "")])
    names = ["a", "salt", "kind", "key", "heads", "counts", "docs", "times", "many"]

    def rows(kind, at):
        none = pa.array([b""] * len(at), pa.binary())
        cols = [first["a"].take(pa.array(at)), pa.array([0] * len(at), pa.int32()), pa.array([kind] * len(at), pa.int32()), first["key"].take(pa.array(at))]
        own = [first[n].take(pa.array(at)) for n in names[4:]]
        return [*cols, *own[:2], *(own[2:] if kind else [none] * 3)]

    want = {0: (2 + 1 * 0, 2 + 1 + 1), 1: (2, 4 + 700)}
    order = [(0, 0), (1, 0), (0, 1), (1, 1)]
    for cut in ([4], [1, 3], [1, 1, 1, 1], [2, 2]):
        batches, lo = [], 0
        for n in cut:
            cells = [rows(k, [i]) for k, i in order[lo : lo + n]]
            batches.append(pa.RecordBatch.from_arrays([pa.concat_arrays([c[j] for c in cells]) for j in range(len(names))], names))
            lo += n
        found = {}
        for b in alignment._added(alignment._stream(iter(batches))):
            for k, x, y in zip(*(b.column(j).to_pylist() for j in range(3))):
                found[k] = (found.get(k, (0, 0))[0] + x, found.get(k, (0, 0))[1] + y)
        assert {k: v[1] for k, v in found.items()} == {k: v[1] for k, v in want.items()}
        assert found == {0: (2, 4), 1: (2 + 700, 704)}
