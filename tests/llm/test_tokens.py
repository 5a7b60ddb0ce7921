import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import grammar, packing
from lodestone.llm.bpe import Encoder
from lodestone.llm.queries import vocabulary
from lodestone.llm.wordpiece import Automaton, count_tokens

ODD = ["", None, "a  b", "a\n\nb", " a", "a ", "\na", "a\n", " ", "\n", "a \tb", "x<|endoftext|> y\nz", "\0 a", "don't\nit's", "a 　b", "é ü\nß, ok. Привет мир", "12 34,5 ...\n!!", "word, word. Word.", "a" * 3000]


@pytest.fixture(scope="module")
def bpe():
    return Encoder(vocabulary(), memory=50)


def test_encoder_is_the_library(bpe):
    for _ in range(2):
        for text, ids in zip(ODD, bpe.encode(ODD)):
            assert ids.tolist() == bpe.tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab.,'é \n\t!1　", max_size=40))
def test_encoder_any_text(text):
    e = Encoder.shared = getattr(Encoder, "shared", None) or Encoder(vocabulary())
    assert e.encode([text])[0].tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, part int, nth string")


def rows():
    r = np.random.default_rng(1)
    words = "the of anhea tion ciónlla wh über".split()
    out = [(i, " ".join(r.choice(words, int(r.integers(0, 900)))), 7, "x") for i in range(120)]
    return out + [(500 + i, t, 7, "x") for i, t in enumerate(ODD)] + [(None, "no id", 1, None), (3, out[3][1], 7, "x"), (900, "long " * 9000, 1, "y")]


def test_packing(spark, bpe):
    given_ = rows()
    got = packing.pack_documents(frame(spark, given_), vocabulary(), with_ids=True).collect()
    texts = {}
    for d, t, *_ in given_:
        texts.setdefault(d, []).append(np.append(bpe.whole(t or ""), 2).astype("<u4"))
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
        assert r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and r["length"] * 4 == len(r["ids"])
    for d, want in texts.items():
        pieces = sorted(by_doc[d], key=lambda r: r["piece"])
        assert sorted(b"".join(bytes(p["ids"]) for p in pieces)) == sorted(b"".join(w.tobytes() for w in want))
        if len(want) == 1:
            assert [p["start"] for p in pieces] == np.cumsum([0] + [p["length"] for p in pieces])[:-1].tolist()
            assert all(p["length"] == 1024 for p in pieces[1:]) and (len(want[0]) > 1024 or len(pieces) == 1)
    for s in by_seq.values():
        s.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in s] == np.cumsum([0] + [r["length"] for r in s])[:-1].tolist() and sum(r["length"] for r in s) <= 1024
    least = -(-sum(r["length"] for r in got) // 1024)
    assert len(by_seq) <= 1.05 * least + 1
    made = packing.sequences(packing.pack_documents(frame(spark, given_), vocabulary(), with_ids=True)).collect()
    assert len(made) == len(by_seq) and sum(len(r["ids"]) for r in made) == sum(4 * r["length"] for r in got)


def test_packing_empty(spark):
    assert packing.pack_documents(frame(spark, []), vocabulary()).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=20))
def test_plan_places_each_piece_once(counts):
    runs, total = packing.plan(counts, 60)
    bins = {}
    runs.sort()
    for n, c in counts.items():
        own = [r for r in runs if r[0] == n] + [(n, c, 1, 0, 0)]
        for (_, lo, each, first, offset), nxt in zip(own, own[1:]):
            for k in range(nxt[1] - lo):
                bins.setdefault(first + k // each, []).append((offset + k % each * n, n))
    assert sum(map(len, bins.values())) == sum(counts.values()) and len(bins) == total
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 60
        assert sum(3 * n > 60 for _, n in b) <= 2


def test_grammar_round_trip():
    r = np.random.default_rng(5)
    for size, alphabet in ((1, 3), (2, 1), (5000, 4), (20000, 300)):
        ids = r.integers(0, alphabet, size).astype("<u4")
        ends = np.unique(np.append(r.integers(1, size + 1, 9), size))
        symbols, to, rules = grammar.compress(ids, ends, 300, pairs=16, least=3)
        left = Counter(zip(symbols[:-1].tolist(), symbols[1:].tolist()))
        for k in to[:-1].tolist():
            left[symbols[k - 1], symbols[k]] -= 1
        # What is left is rare, but for rows of one symbol, whose pairs overlap.
        assert all(n < 3 or a == b for (a, b), n in left.items())
        sizes = grammar.rule_sizes(rules, 300)
        pool, first, size_ = grammar.expansions(rules, sizes, 300)
        back = [pool[grammar._spans(first[s], size_[s])] for s in np.split(symbols.astype(np.int64), to[:-1])]
        assert [b.tolist() for b in back] == [x.tolist() for x in np.split(ids, ends[:-1])]
        assert size < 5000 or len(symbols) < size


def test_files(spark, bpe, tmp_path):
    given_ = [x for x in rows() if x[0] != 3]
    got = {r["doc_id"]: r for r in grammar.encode_and_read(frame(spark, given_), vocabulary()).collect()}
    at = 0
    for d, t, *_ in sorted(given_, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = np.append(bpe.whole(t or ""), 0).astype("<u4")
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    grammar.write_shards(frame(spark, given_), str(tmp_path / "f"), vocabulary(), block_ids=500)
    assert grammar.read_document(spark, str(tmp_path / "f"), 7)[0].tolist() == np.append(bpe.whole(given_[6][1]), 0).tolist()
    assert grammar.encode_and_read(frame(spark, []), vocabulary()).count() == 0


def brute(pieces, word):
    n = at = 0
    while at < len(word):
        end = max((e for e in range(at + 1, len(word) + 1) if word[at:e] in pieces), default=at + 1)
        at, n = end, n + 1
    return n


@settings(max_examples=100, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=5).map(lambda b: bytes(97 + x % 3 for x in b)), max_size=12), st.lists(st.binary(max_size=12).map(lambda b: bytes(97 + x % 3 for x in b)), max_size=8))
def test_automaton(pieces, words):
    a = Automaton(pieces)
    assert a.count(words).tolist() == [brute(pieces | {bytes([b]) for b in range(256)}, w) for w in words]


def test_counts(spark):
    ranks = vocabulary("byte_bpe_50k.tiktoken")
    a = Automaton.of_ranks(ranks)
    got = {r["doc_id"]: r for r in count_tokens(frame(spark, rows()), ranks).collect()}
    for d, t, *_ in rows():
        words = (t or "").encode().split()
        assert got[d]["n_words"] == len(words) and got[d]["n_tokens"] == sum(int(a.count([b" " + w])[0]) for w in words)
    assert count_tokens(frame(spark, []), ranks).count() == 0
