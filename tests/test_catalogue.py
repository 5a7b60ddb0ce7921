"""Every query against its SQL, on the smallest tables."""

import html
import re
from collections import Counter

import duckdb
import pytest

from lodestone.plans import catalogue, oracles
from tests import cases

TABLES = "documents benchmark embeddings pages labels conversations".split()


def plain(v):
    return round(float(v), 6) if isinstance(v, (float, int)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = catalogue.queries()[name](spark, sf)
    want = con.sql(oracles.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    key = lambda rows: sorted(repr([plain(r[names.index(n)]) for n in names]) for r in rows)
    assert key([tuple(r[n] for n in names) for r in got.collect()]) == key([tuple(dict(zip(want.columns, r))[n] for n in names) for r in want.fetchall()])


@pytest.mark.parametrize("name", sorted(cases.queries()))
def test_case(spark, sf, name):
    """The same operators over literal rows worked out by hand."""
    got, want = cases.queries()[name](spark, sf), duckdb.connect().sql(cases.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    key = lambda rows: sorted(repr([plain(v) for v in r]) for r in rows)
    assert key([tuple(r[n] for n in names) for r in got.collect()]) == key([tuple(dict(zip(want.columns, r))[n] for n in names) for r in want.fetchall()])


def test_all_others_are_tested_here():
    assert set(catalogue.queries()) - set(oracles.oracle_sql()) == {"overlap_removal", "chunk_table", "html_extract", "embed_hash", "tagger_predictions", "tagger_scores", "latent_topk", "knn_cells", "pair_trained", "pair_trained_scores", "bio_align_subword"}


def texts(sf, table="documents", key="doc_id", text="text"):
    return dict(duckdb.sql(f"select {key}, {text} from '{sf}/{table}.parquet'").fetchall())


def test_overlap_removal(spark, sf):
    want = set()
    for key, text in texts(sf).items():
        spans = [(m.start(), -m.end(), label) for label, p in (("A", r"\S+ \S*[0-9]{3,}\S*"), ("B", r"[0-9]{3,}\S* \S+"), ("B", r"[0-9]+")) for m in re.finditer(p, text or "", re.IGNORECASE)]
        taken = []
        for start, end, label in sorted(spans):
            if all(start >= b or -end <= a for a, b in taken):
                taken.append((start, -end))
                want.add((key, label, start, -end))
    got = [tuple(r) for r in catalogue.overlap_removal(spark, sf).select("doc_id", "label", "start", "end").collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_chunk_table(spark, sf):
    parts = {}
    for r in catalogue.chunk_table(spark, sf).orderBy("doc_id", "i").collect():
        parts.setdefault(r["doc_id"], []).append(r["text"])
    rows = {k: [x for x in (t or "").split("\n") if " | " in x] for k, t in texts(sf).items()}
    assert set(parts) == {k for k, v in rows.items() if v} and parts
    squeeze = lambda x: re.sub(r"[ \t]+", " ", x).strip()
    for key, found in parts.items():
        cells = [squeeze(c) for line in rows[key] for c in line.split(" | ")]
        lines = ["[TABLE_START]", *[c for c in cells if c], "[TABLE_END]"]
        at = 0  # the parts, each after the title, are runs of the table's lines that leave none out
        for part in found:
            own = [x.strip() for x in part.removeprefix("TABLE 1").split("\n") if x.strip()]
            assert part.startswith("TABLE 1") and (len(part) <= 1200 or len(own) == 1)
            begins = next(b for b in range(max(0, at - 4), at + 1) if lines[b : b + len(own)] == own)
            at = max(at, begins + len(own))
        assert at == len(lines)


def test_html_extract(spark, sf):
    pages = texts(sf, "pages", "page_id", "html")
    got = {r["page_id"]: r["text"] for r in catalogue.html_extract(spark, sf).collect()}
    assert set(got) == set(pages)
    word = lambda x: Counter(re.findall(r"\w+", x.replace("TABLE_START", "").replace("TABLE_END", "")))
    for key, page in pages.items():
        bare = re.sub(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ", page or "", flags=re.S | re.I)
        assert word(got[key] or "") == word(html.unescape(re.sub(r"<[^>]*>", " ", bare)))


def test_embed_hash(spark, sf):
    got = {r["question_id"]: (r["n"], r["norm"]) for r in catalogue.embed_hash(spark, sf).collect()}
    assert got == {k: (64, 1.0) for k in texts(sf, "benchmark", "item_id")}


def test_question_entities_of_texts(spark, tmp_path):
    """Every pattern meets every row, and references in the texts themselves come out, in the query as in its SQL."""
    rows = [
        (10, "См. ГЛАВУ 3.1, раздела 2 и ТАБЛ.Б4; НП 7—8, НП5-1, СТО 1 2-3, сп 5.3-2009а, пуэ\nПУЭ. п.9, ПУЭ7, ап. 6, таблице 4а, Пункт　1.2.", 20),
        (11, None, 0), (12, "\x01СП\x015 СП 5.", 7), (-4, "главы 1", 7), (13, "глава 5", None),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    own = lambda a, b, c: ["", f"глава {b}|п. {c}|раздел {c}.1|сто {a} {b}-01", "", "", f"нп-{b}-15|пуэ", f"таблица а{b}", ""]
    firsts = {
        10: "глава 3.1|нп 7-8|нп5-1|п. 1.2|п. 9|пуэ|раздел 2|сп 10.13130-2009|сп 5.3|сто 1 2-3|таблица 20|таблица б4",
        11: "п. 2.2|сп 11.13130-2009|таблица 0", 12: "п. 3.2|сп 12.13130-2009|сп 5|таблица 7", -4: "глава 1|таблица 7", 13: "",
    }
    want = {(k, i + 1): x for k, _, b in rows for i, x in enumerate(own(k, b, k % 9))} | {(k, 1): x for k, x in firsts.items()}
    want |= {(-4, 2): "глава 7"} | {(13, i): "" for i in (2, 5, 6)}
    got = [tuple(r) for r in catalogue.queries()["question_entities"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    said = con.sql(oracles.oracle_sql()["question_entities"]).fetchall()
    assert len(got) == len(said) == len(want)
    assert {r[:2]: r[2] for r in got} == want
    assert {r[:2]: r[2] for r in said} == want
