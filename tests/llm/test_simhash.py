"""Operator 11 against plain fingerprints and a comparison of all pairs."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import simhash

ODD = ["", None, " \t\n", "One", "one two", "One  TWO", "one two three", "é ü ß İ", "a\x0bb\x0cc d", "a b c d", "word " * 70000]


def plain(text, n=3):
    from xxhash import xxh64

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    width = min(n, len(words))
    h = [xxh64(" ".join(words[i : i + width]).encode(), seed=42).intdigest() for i in range(len(words) - width + 1)]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def roots(codes, most):
    """Of each code the smallest place that it hangs together with."""
    codes = np.array(codes, np.uint64)
    root = np.arange(len(codes))
    near = np.bitwise_count(codes[:, None] ^ codes) <= most
    while True:
        low = np.array([root[row].min() for row in near])
        if (low == root).all():
            return root
        root = low


def expected(rows, most=2):
    codes = [plain(t) for _, t in rows]
    root = roots(codes, most)
    least = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i, f"{c:016x}", least.get(r)) for (i, _), c, r in zip(rows, codes, root)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "z") for i, t in rows], "doc_id long, text string, code int, place int, fingerprint string")


def test_every_document(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(simhash.link_documents(docs)) == expected([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_odd_rows_and_near_copies(spark):
    r = np.random.default_rng(3)
    base = [" ".join(r.choice(["the", "hea", "ción", "Wh", "über", "ab"], 300)).split() for _ in range(5)]
    rows = [*enumerate(ODD), (None, "alone with no id"), (None, ""), (None, " ".join(base[0])), (7, "one two three"), (7, "one two three")]
    for i in range(200):
        words = list(base[i % 5])
        for k in r.integers(0, 300, int(r.integers(0, 4))):
            words[k] = "changed"
        rows.append((1000 + i, " ".join(words)))
    want = expected(rows)
    for parts, size in ((1, 1 << 20), (5, 16)):
        assert got(simhash.link_documents(frame(spark, rows).repartition(parts), size=size)) == want


def test_no_rows(spark):
    assert simhash.link_documents(frame(spark, [])).collect() == []


def clustered(r, n):
    """Codes around a few centres, and some anywhere."""
    centres = r.integers(0, 1 << 63, 6, np.uint64) << np.uint64(1)
    out = [int(c) for c in r.integers(0, 1 << 63, n // 4, np.uint64)]
    while len(out) < n:
        code = int(r.choice(centres))
        for k in r.integers(0, 64, int(r.integers(0, 7))):
            code ^= 1 << int(k)
        out.append(code)
    return sorted(set(out) | {0, (1 << 64) - 1, 1, 3})


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_index_is_a_comparison_of_all(most):
    r = np.random.default_rng(most)
    for n in (1, 3, 17, 400):
        codes = np.array(clustered(r, n), np.uint64)
        members = codes[np.argsort(simhash._ordered(codes))]
        i, j = simhash.GrayIndex(members).search(codes, most)
        want = np.bitwise_count(codes[:, None] ^ members) <= most
        assert sorted(zip(i.tolist(), j.tolist())) == sorted(zip(*(x.tolist() for x in np.nonzero(want))))


def test_whole_groups_are_left_early():
    """The nodes of a level that a search meets are few."""
    r = np.random.default_rng(0)
    codes = np.unique(r.integers(0, 1 << 63, 1 << 16, np.uint64))
    index, met = simhash.GrayIndex(codes[np.argsort(simhash._ordered(codes))]), []
    count = np.bitwise_count
    try:
        np.bitwise_count = lambda x: (met.append(len(x)), count(x))[1]
        index.search(codes[:256], 2)
    finally:
        np.bitwise_count = count
    assert sum(met) < 256 * 4000  # of 65,536 members


def test_links_of_ranges(spark):
    """Codes whose neighbours lie in other ranges keep their components; nothing else is joined."""
    r = np.random.default_rng(11)
    codes = np.array(clustered(r, 1500), np.uint64)
    table = spark.createDataFrame([(int(c), int(p)) for c, p in zip(codes.view(np.int64), simhash._ordered(codes))], "code long, place long")
    want = roots(codes, 2)
    for size in (1 << 20, 20):
        found = simhash.links(table, 2, size).collect()
        at = {c: k for k, c in enumerate(codes.view(np.int64).tolist())}
        root = np.arange(len(codes))
        while True:
            low = root.copy()
            for x in found:
                low[at[x["a"]]] = low[at[x["b"]]] = min(low[at[x["a"]]], low[at[x["b"]]])
            if (low == root).all():
                break
            root = low
        assert (root == want).all()


def test_gray_rank():
    n = np.arange(4096, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abAB É\n\t\x0b 　", max_size=30), st.integers(1, 4))
def test_any_fingerprint(text, n):
    assert simhash.fingerprint(text.encode(), n) == plain(text, n)
