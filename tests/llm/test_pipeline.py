"""The pipeline against a brute-force version of each stage, on each stage's own input."""

import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm.common import settle, table
from lodestone.llm.queries import vocabulary
from lodestone.llm.rules import rules_sql

from .test_documents import brute_components


def holds(item, text, share=0.2):
    """Whether some part of the text is within the edit distance of the item, by the plain table."""
    most = int(share * len(item))
    if not item or len(set(item) & set(text)) < len(set(item)) - most:
        return False
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item):
        new = [i + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (w != x), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row) <= most


def test_stages(spark, sf):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near duplicates", "benchmark decontamination", "personal data", "best-fit packing"]
    docs = table(spark, sf, "documents")
    columns = docs.columns
    steps = []
    for _, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, sf))
        steps.append(docs)
    rules, near, bench, private, packed = steps
    assert all(s.columns == columns for s in steps[:4])
    of = lambda df: {r["doc_id"]: r for r in df.collect()}
    start, rules, near, bench, private = of(table(spark, sf, "documents")), of(rules), of(near), of(bench), of(private)

    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": list(start), "text": [r["text"] for r in start.values()]}))
    assert set(rules) == {d for d, k in con.sql(f"select doc_id, kept from ({rules_sql()})").fetchall() if k} and rules.items() <= start.items()

    want = {d for d, n, c in brute_components([(d, r["text"]) for d, r in rules.items()], corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_LINK) if n == 0 or d == c}
    assert set(near) == want and len(near) < len(rules)

    items = [r["text"].lower().split() for r in table(spark, sf, "benchmark").collect()]
    leaks = {d for d, r in near.items() if any(holds(i, r["text"].lower().split()) for i in items)}
    assert set(bench) == set(near) - leaks

    assert set(private) == set(bench)
    for d, r in private.items():
        old, new = bench[d]["text"], r["text"]
        assert r["n_chars"] == len(new) and (r["lang"], r["source"]) == (bench[d]["lang"], bench[d]["source"])
        emails, ips = r"[\w.-]+@[\w-]+\.[\w.-]*\w", r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])"
        for p in (emails, ips, r"\+1 \(\d{3}\) \d{3}-\d{4}"):
            assert len(re.findall(p, old)) == len(re.findall(p, new)) and not set(re.findall(p, old)) & set(re.findall(p, new))
        if old == new:
            assert not re.search(r"@\w|\+1 \(", old)

    t = Tokenizer.from_file(vocabulary())
    pieces = {}
    for p in packed.collect():
        pieces.setdefault(p["doc_id"], []).append(p)
    assert set(pieces) == set(private)
    for d, own in pieces.items():
        ids = np.array(t.encode(private[d]["text"], add_special_tokens=False).ids + [2], "<u4")
        own.sort(key=lambda p: p["piece"])
        assert sum(p["length"] for p in own) == len(ids)
        assert all(p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) for p in own)
    assert corpus_pipeline.ORACLE_SQL is None


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
    empty = table(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_stages_on_odd_rows(spark, sf):
    """Null ids, shared ids, equal rows, nulls in any column and columns of clashing names go through every stage."""
    good = [r["text"] for r in corpus_pipeline.quality_rules(spark, table(spark, sf, "documents"), sf).orderBy("doc_id").limit(40).collect()]
    item = table(spark, sf, "benchmark").first()["text"]
    rows = [(None, good[0]), (None, good[1]), (5, good[2]), (5, good[3]), (5, good[3]), (6, good[2]), (7, None), (None, None), (8, ""), (9, good[4] + " " + item), (9, good[5] + " mail a.b@example.org")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, uid int, `key` int, item_id int, component_id long"
    docs = spark.createDataFrame([(d, t, None, None, len(t or ""), "r", 1, None, 2, 3) for d, t in rows], schema)
    near = settle(corpus_pipeline.near_duplicates(spark, docs, sf))
    assert near.columns == docs.columns
    kept = sorted((str(r["doc_id"]), r["text"] or "") for r in near.collect())
    want = [r for i, r in enumerate(rows) if i not in (4, 5)]
    assert len(kept) <= len(want) and set(kept) <= {(str(d), t or "") for d, t in want}
    groups = brute_components([(i, t) for i, (_, t) in enumerate(rows)], corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_LINK)
    assert len(kept) == len({c if n else ("empty", i) for i, n, c in groups})
    clean = settle(corpus_pipeline.benchmark_items(spark, near, sf))
    assert clean.columns == docs.columns and not any(item in (r["text"] or "") for r in clean.collect())
    private = settle(corpus_pipeline.personal_data(spark, clean, sf))
    assert private.columns == docs.columns and private.count() == clean.count() and not any("a.b@example" in (r["text"] or "") for r in private.collect())
    assert corpus_pipeline.packing(spark, private, sf).select("doc_id").distinct().count() > 0
    assert corpus_pipeline.quality_rules(spark, docs, sf).columns == docs.columns
