import json

import pytest
from pyspark.sql import functions as F

from lodestone.plans import catalogue
from lodestone.functions.models import HashEmbedder, OverlapScorer
from lodestone.operators import annotate as A
from lodestone.operators import dense, entities, fusion, generate, lexical, metrics
from lodestone.plans.engine import RetrievalEngine


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "corpus_idx long, text string")


def asked(spark, rows):
    return spark.createDataFrame(rows, "question_id string, question string")


def test_bm25_by_hand(spark):
    index = lexical.build_index(docs(spark, ["a b a", "b c", ""]))
    idf = {r["term"]: round(r["idf"], 9) for r in index.terms.collect()}
    assert idf == {"a": 0.510825624, "c": 0.510825624, "__empty__": 0.510825624, "b": 0.063853203}
    found = lexical.topk(index, asked(spark, [("1", "a"), ("2", "a a"), ("3", "b"), ("4", "?")]), 3).collect()
    by = {}
    for r in sorted(found, key=lambda r: (r["question_id"], r["bm25_rank"])):
        by.setdefault(r["question_id"], []).append((r["corpus_idx"], round(r["bm25_score"], 9)))
    assert by == {"1": [(0, 0.62870846), (1, 0.0), (2, 0.0)], "2": [(0, 1.25741692), (1, 0.0), (2, 0.0)], "3": [(1, 0.063853203), (0, 0.052125064), (2, 0.0)]}
    assert lexical.topk(index, asked(spark, [("1", "a")]), 0).count() == 0


def test_bm25_negative_scores_go_below_zero(spark):
    """With a negative mean idf, documents without a match come before those with one."""
    index = lexical.build_index(docs(spark, ["x y", "x y", "x y", "z"]))
    top = lexical.topk(index, asked(spark, [("q", "x")]), 2).orderBy("bm25_rank").collect()
    assert [r["corpus_idx"] for r in top][0] == 3 or top[0]["bm25_score"] >= 0


def test_dense(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.6, 0.8]), (2, [1.0, 0.0]), (3, None)], "corpus_idx long, embedding array<float>")
    q = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "question_id string, embedding array<float>")
    got = {(r["question_id"], r["dense_rank"]): r["corpus_idx"] for r in dense.topk(v, q, 2).collect()}
    assert got == {("a", 1): 0, ("a", 2): 2, ("b", 1): 1, ("b", 2): 0}
    assert dense.topk(v, q, 2, block=1).count() == 4
    assert dense.topk(v, q.limit(0), 2).count() == 0


def test_rrf(spark):
    d = spark.createDataFrame([("q", "a", 163), ("q", "b", 1)], "question_id string, chunk_id string, dense_rank int")
    b = spark.createDataFrame([("q", "a", 16), ("q", "c", 4), ("q", "d", 1)], "question_id string, chunk_id string, bm25_rank int")
    rows = {r["chunk_id"]: r for r in fusion.rrf(d, b).collect()}
    assert rows["a"]["hybrid_score"] == pytest.approx(0.01764219966957753) and rows["c"]["hybrid_score"] == 0.015625
    assert [rows[x]["candidate_rank"] for x in "acbd"][0] == 1 and rows["b"]["candidate_rank"] < rows["d"]["candidate_rank"]


def test_entities(spark):
    ents = [("СП 1.2", "NORM_DOC"), ("сп 1.2", "NORM_DOC"), ("12", "NORM_REF"), ("табл. 5", "NORM_REF"), ("форма", "NORM_REF"), ("##x", "NORM_DOC"), ("2020", "DATE"), ("...", "NORM_DOC"), (" ", "NORM_DOC"), ("ПУЭ-7", "NORM_DOC")]
    rows = [("c1", "СП 1.2.txt", 1, [(t, lab, 0, 1, 1.0) for t, lab in ents]), ("c2", "f", 1, [])]
    df = spark.createDataFrame(rows, "chunk_id string, source_file string, page_num int, predicted_entities array<struct<text:string,label:string,start:int,end:int,score:double>>")
    index = entities.build_index(df)
    got = {r["chunk_id"]: (r["entity_labels"], r["entity_texts"]) for r in index.collect()}
    assert got == {"c1": (["NORM_DOC", "NORM_REF"], ["сп 1.2", "таблица 5"]), "c2": ([], [])}
    hits = spark.createDataFrame([("q", "c1", 2), ("q", "c2", 1), ("q", "СП 7_p1_c1", 3)], "question_id string, chunk_id string, candidate_rank int")
    full = entities.chunk_entities(hits, index).withColumn("query_entities", F.array(F.lit("сп 1.2"), F.lit("п. 3")))
    out = {r["chunk_id"]: r for r in entities.rerank(full, 3, 2.0).collect()}
    assert out["c1"]["final_rank"] == 1 and out["c1"]["ner_overlap"] == ["сп 1.2"] and out["c1"]["ner_score"] == 0.5
    none = entities.rerank(full.withColumn("query_entities", F.array().cast("array<string>")), 3).filter("ner_score = 0 and size(ner_overlap) = 0")
    assert none.count() == 3
    again = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "chunk_id string, line int, v string")
    assert entities.last_of_chunk(again, "line").collect()[0]["v"] == "y"


def test_metrics(spark):
    run = spark.createDataFrame([("q", c, i + 1) for i, c in enumerate("badc")], "question_id string, chunk_id string, rank int")
    qs = asked(spark, [("q", "x"), ("none", "x")])
    rel = spark.createDataFrame([("q", ["a", "c"])], "question_id string, relevant_chunk_ids array<string>")
    got = {(r["question_id"], r["metric"]): r["value"] for r in metrics.per_question(run, qs, rel, [1, 3], 4, 4).collect()}
    assert got["q", "ndcg@4"] == pytest.approx(0.6509209298071326) and got["q", "mrr@4"] == 0.5
    assert got["q", "hit@1"] == 0 and got["q", "recall@3"] == 0.5 and got["q", "precision@3"] == pytest.approx(1 / 3)
    assert all(v == 0 for (q, _), v in got.items() if q == "none")
    assert metrics.parse_k_values("10, 1,3,1") == [1, 3, 10]
    with pytest.raises(ValueError):
        metrics.parse_k_values(" ,")
    raw = spark.createDataFrame([("1", None, ["a"]), ("1", None, ["b", "b"]), (None, "2", None)], "id string, question_id string, chunk_ids array<string>")
    assert {r["question_id"]: r["relevant_chunk_ids"] for r in metrics.load_qrels(raw.coalesce(1)).collect()} == {"1": ["b"], "2": []}
    with pytest.raises(Exception, match="question_id"):
        metrics.load_questions(spark.createDataFrame([("", "x")], "id string, question string")).collect()


def test_spans(spark):
    text = "ГОСТ Р 12.1 и СП 5 от 01.02.2020, табл. 3 " + "x" * 80
    rows = spark.createDataFrame([("c", "f", 1, text), ("d", "f", 1, "СП 5")], "chunk_id string, source_file string, page_num int, text string")
    found = A.candidates(rows).collect()
    assert len(found) == 1
    spans = [(e["label"], e["text"]) for e in found[0]["entities"]]
    assert spans == [("NORM_DOC", "ГОСТ Р 12.1"), ("NORM_DOC", "СП 5"), ("DATE", "01.02.2020"), ("NORM_REF", "табл. 3")]
    assert found[0]["auto_score"] == 8 + 6 + 2 + 1 + 3 + 2 + 1
    assert all(text[e["start"] : e["end"]] == e["text"] for e in found[0]["entities"])
    known = spark.createDataFrame([("c",)], "id string")
    assert A.candidates(rows, known).count() == 0


def test_overlaps_brute(spark):
    import random

    r = random.Random(3)
    rows = [(i, [("t", "L", s, s + r.randint(1, 6)) for s in (r.randint(0, 30) for _ in range(r.randint(0, 9)))]) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, e array<struct<text:string,label:string,start:int,end:int>>")
    for row in df.select("id", A.without_overlaps(F.col("e")).alias("k")).collect():
        kept = []
        for s in sorted(rows[row["id"]][1], key=lambda x: (x[2], -x[3])):
            if all(s[2] >= k[3] or s[3] <= k[2] for k in kept):
                kept.append(s)
        assert [(k["start"], k["end"]) for k in row["k"]] == [(k[2], k[3]) for k in kept]


def test_align_and_split(spark):
    rows = [(str(i), "f", 1, f"c{i}", "see СП 5 now", [("СП 5", "NORM_DOC", 4, 8), ("5", "DATE", 7, 8), ("bad", "DATE", 9, 99)]) for i in range(11)]
    df = spark.createDataFrame(rows, "id string, source_file string, page_num int, chunk_id string, text string, entities array<struct<text:string,label:string,start:int,end:int>>")
    out = A.align(df).first()
    from lodestone.functions.patterns import BIO_LABELS

    assert out["tokens"] == ["[CLS]", "see", "СП", "5", "now", "[SEP]"]
    assert [BIO_LABELS[x] if x >= 0 else x for x in out["labels"]] == [-100, "O", "B-NORM_DOC", "B-DATE", "O", -100]
    parts = {r["split"]: r["count"] for r in A.split(df).groupBy("split").count().collect()}
    assert parts == {"dev": 2, "train": 9}
    with pytest.raises(ValueError):
        A.split(df.limit(1))
    scores = A.token_accuracy(A.align(df).withColumn("predicted", F.col("labels"))).first()
    assert scores["accuracy"] == 1.0


def test_engine(spark, tmp_path):
    texts = ["СП 5.13130 fire alarms", "cables and trays", "fire doors", "alarm cables of СП 5.13130", ""]
    chunks = spark.createDataFrame([(f"c{i}", i, "f.txt", 1, "text", t) for i, t in enumerate(texts)], "chunk_id string, corpus_idx long, source_file string, page_num int, chunk_type string, text string")
    e = HashEmbedder()
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(e.embed(texts))], "corpus_idx long, embedding array<float>")
    index = spark.createDataFrame([(f"c{i}", "f.txt", 1, ["NORM_DOC"] if "СП" in t else [], ["сп 5.13130"] if "СП" in t else []) for i, t in enumerate(texts)], "chunk_id string, source_file string, page_num int, entity_labels array<string>, entity_texts array<string>")
    said = []
    engine = RetrievalEngine(chunks, vectors, index, e, OverlapScorer(), chat=lambda s, u, t, n: said.append((s, u, t, n)) or "answer")
    got = engine.ask("cables in СП 5.13130", k=2)
    assert got["answer"] == "answer" and said[0][2:] == (0.1, 600) and got["sources"][0]["chunk_id"] == "c3" and "[SOURCE 1]" in got["context"]
    with pytest.raises(ValueError):
        engine.ask("  ")
    qs = spark.createDataFrame([("1", "fire doors"), ("2", "cables СП 5.13130")], "question_id string, question string")
    rel = spark.createDataFrame([("1", ["c2"]), ("2", ["c3"])], "question_id string, relevant_chunk_ids array<string>")
    for base in ("hybrid", "dense"):
        out = engine.evaluate(qs, rel, k=3, k_values="1,3", base=base)
        assert out["wide"].count() == 2 and out["runs"].count() == 4 and "metrics" in json.loads(out["summary"].toJSON().first())
    asked_ = engine.embedded(qs)
    assert engine.hybrid_reranked(asked_, 2).count() == 4 and engine.dense_entities(asked_, 2).count() == 4 and engine.hybrid(asked_, 2, bm25_k=0).count() == 4


def test_contexts_defaults(spark):
    rows = spark.createDataFrame([("q", 1, None, None, None, "t")], "question_id string, rank int, source_file string, page_num int, chunk_id string, text string")
    out = generate.contexts(rows).first()
    assert out["context"] == "\n\n[SOURCE 1]\nfile: unknown_file\npage: unknown_page\nchunk_id: chunk_1\ntext:\nt"
    assert out["sources"][0].asDict() == {"source_file": "unknown_file", "page_num": "unknown_page", "chunk_id": "unknown_chunk"}


def test_texts_meet_all_questions_without_a_shuffle_of_pairs(spark, sf, tmp_path):
    """Only the best of each task are dealt out; blocks of questions and an index that was written give the same."""
    docs, asked = catalogue.chunks(spark, sf), catalogue.questions(spark, sf)
    index = lexical.build_index(docs)
    best = lexical.topk(index, asked, 7)
    assert best._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    rows = lambda df: sorted((r["question_id"], r["bm25_rank"], r["corpus_idx"], round(r["bm25_score"], 9)) for r in df.collect())
    index.write(str(tmp_path / "index"))
    want = rows(best)
    assert len(want) == 7 * asked.count()
    assert rows(lexical.topk(index, asked, 7, block=3)) == want == rows(lexical.topk(lexical.Index.read(spark, str(tmp_path / "index")), asked, 7))
    bare = lexical.Index(index.postings, index.terms, index.stats, index.docs)
    assert rows(lexical.topk(bare, asked, 7)) == want


def test_a_written_index_splits_its_texts_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    docs = spark.createDataFrame([(1, "one two two"), (2, None), (3, ""), (4, "two three")], "corpus_idx long, text string")
    got = lexical.write_index(docs.mapInArrow(seen, docs.schema), str(tmp_path / "index"))
    assert read.value == 4
    want = lexical.build_index(docs)
    for a, b in ((got.terms, want.terms), (got.stats, want.stats), (got.postings.select("corpus_idx", "term", "tf", "dl"), want.postings.select("corpus_idx", "term", "tf", "dl"))):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
