"""The jobs against their SQL, over growing input, and again over the same."""

import json
import logging
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import queries, refresh_index, tagger_corpus
from lodestone.operators import lexical, segments


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("name", ["job1_refresh_index", "job2_tagger_corpus"])
def test_job_is_its_sql(spark, sf, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    columns = sorted(want.columns)
    got = queries.queries()[name](spark, sf)
    assert sorted(got.columns) == columns
    assert rows(got) == sorted((tuple(dict(zip(want.columns, r))[c] for c in columns) for r in want.fetchall()), key=repr)


def index_rows(i):
    return [rows(t) for t in (i.postings, i.terms.withColumn("idf", F.round("idf", 9)), i.stats.select("n", F.round("avgdl", 9), F.round("mean_idf", 9)), i.docs)]


def built(docs):
    i = lexical.build_index(docs.select(F.col("doc_id").alias("corpus_idx"), "text"))
    return index_rows(lexical.Index(i.postings.withColumn("dl", F.col("dl").cast("long")), i.terms, i.stats, i.docs))


def test_refresh_over_growing_input(spark, sf, tmp_path, caplog):
    caplog.set_level(logging.INFO)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    given, index, checkpoint = (str(tmp_path / x) for x in ("in", "index", "checkpoint"))
    parts = [docs.filter(F.col("doc_id") % 3 == k) for k in range(3)]
    run = lambda: refresh_index.refresh(spark, given, index, checkpoint)
    parts[0].write.parquet(given)
    assert run() == 1 and index_rows(segments.read(spark, index)) == built(parts[0])
    assert run() == 0  # nothing new
    for p in parts[1:]:
        p.coalesce(1).write.mode("append").parquet(given)
    assert refresh_index.refresh(spark, given, index, checkpoint, files_a_batch=1) == 2
    assert run() == 0 and index_rows(segments.read(spark, index)) == built(docs)
    found = lexical.topk(segments.read(spark, index), spark.createDataFrame([(1, "the of"), (2, "zzzz")], "question_id long, question string"), 5)
    whole = lexical.topk(lexical.build_index(docs.select(F.col("doc_id").alias("corpus_idx"), "text")), spark.createDataFrame([(1, "the of"), (2, "zzzz")], "question_id long, question string"), 5)
    near = lambda df: rows(df.withColumn("bm25_score", F.round("bm25_score", 9)))
    assert near(found) == near(whole)
    said = caplog.text
    assert "read batch 0" in said and f"'rows': {parts[0].count()}" in said and "wrote segment=2" in said and "0 new batches" in said
    # A repeated batch writes its partition again.
    segments.write_segment(parts[0].select(F.col("doc_id").alias("corpus_idx"), "text"), index, 0)
    assert index_rows(segments.read(spark, index)) == built(docs)
    segments.merge(spark, index, str(tmp_path / "merged"))
    assert index_rows(segments.read(spark, str(tmp_path / "merged"))) == built(docs)
    assert spark.read.parquet(str(tmp_path / "merged/docs")).select("segment").distinct().count() == 1


def test_changed_and_deleted_texts(spark, tmp_path):
    path = str(tmp_path / "index")
    frame = lambda x: spark.createDataFrame(x, "corpus_idx long, text string")
    batches = [[(1, "a b"), (2, "b c c"), (3, "d"), (None, "no id"), (4, "")], [(2, "e b"), (3, None), (5, "a. 1.2")], [(3, "again d"), (1, None), (6, "x"), (6, "x y")]]
    now = {}
    for number, batch in enumerate(batches):
        segments.write_segment(frame(batch), path, number)
        for i in {i for i, _ in batch if i is not None}:
            texts = [t for j, t in batch if j == i and t is not None]
            now[i] = " ".join(texts) if texts else None
        want = spark.createDataFrame([(i, t) for i, t in now.items() if t is not None], "doc_id long, text string")
        assert index_rows(segments.read(spark, path)) == built(want)
    segments.merge(spark, path, str(tmp_path / "merged"))
    assert index_rows(segments.read(spark, str(tmp_path / "merged"))) == built(want)


def test_refresh_of_an_empty_file(spark, tmp_path):
    given, index, checkpoint = (str(tmp_path / x) for x in ("in", "index", "checkpoint"))
    spark.createDataFrame([], refresh_index.DOCUMENTS).write.parquet(given)
    refresh_index.refresh(spark, given, index, checkpoint)
    spark.createDataFrame([(1, "one two", None, None, None)], refresh_index.DOCUMENTS).write.mode("append").parquet(given)
    refresh_index.refresh(spark, given, index, checkpoint)
    assert [r["term"] for r in refresh_index.output(spark, index).orderBy("term").collect()] == ["one", "two"]


def test_corpus_again_and_its_files(spark, sf, tmp_path, caplog):
    caplog.set_level(logging.INFO)
    out = str(tmp_path)
    first = tagger_corpus.build(spark, f"{sf}/documents.parquet", out, "general")
    before = rows(tagger_corpus.output(spark, out))
    assert tagger_corpus.build(spark, f"{sf}/documents.parquet", out, "general") == first
    assert rows(tagger_corpus.output(spark, out)) == before and first["kept"] == len(before) == first["dev"] + first["train"]
    assert {p.name for p in (tmp_path / "records").iterdir() if p.is_dir()} == {"split=dev", "split=train"}
    assert first["scanned"] == spark.read.parquet(f"{sf}/documents.parquet").count() and "wrote" in caplog.text
    assert spark.read.json(f"{out}/labels").count() == 11


def test_command_lines(spark, sf, tmp_path):
    """Another process, with a config file and options."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    docs.write.parquet(str(tmp_path / "in"))
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"documents": str(tmp_path / "in"), "index": "nowhere", "checkpoint": str(tmp_path / "checkpoint")}))
    run = subprocess.run([sys.executable, "-m", "jobs.refresh_index", "--config", str(config), "--index", str(tmp_path / "index")], capture_output=True, text=True, timeout=240)
    assert run.returncode == 0 and "1 new batches" in run.stderr, run.stderr[-2000:]
    assert index_rows(segments.read(spark, str(tmp_path / "index"))) == built(docs)
    config.write_text(json.dumps({"documents": "x", "colour": 1}))
    run = subprocess.run([sys.executable, "-m", "jobs.tagger_corpus", "--config", str(config)], capture_output=True, text=True, timeout=60)
    assert run.returncode and "colour" in run.stderr


def test_a_segment_moves_each_posting_once(spark, tmp_path):
    """Texts are counted where they are read; only those of a repeated id meet."""
    words = lambda i: " ".join(f"w{(7 * i + j) % 90}" for j in range(60)) + " w1 w1"
    texts = spark.createDataFrame([(i, words(i)) for i in range(200)] + [(5, "again w1"), (6, None), (300, None), (301, ""), (None, "x")], "corpus_idx long, text string").repartition(4).persist()
    texts.count()
    store, java = spark.sparkContext._jsc.sc().statusStore(), spark._jvm.java.util.ArrayList
    stages = lambda: store.stageList(java(), False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), java())
    before = {stages().apply(i).stageId() for i in range(stages().size())}
    segments.write_segment(texts, str(tmp_path / "index"), 0)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    moved = sum(s.shuffleWriteRecords() for s in (stages().apply(i) for i in range(stages().size())) if s.stageId() not in before)
    postings = {(r["term"], r["corpus_idx"]): (r["tf"], r["dl"]) for r in segments.read(spark, str(tmp_path / "index")).postings.collect()}
    want = {}
    for i in range(200):
        own = (words(i) + (" again w1" if i == 5 else "")).split()
        want |= {(w, i): (own.count(w), len(own)) for w in own}
    assert postings == want | {("__empty__", 301): (1, 1)}
    assert moved < 1.5 * len(postings) + 2000
    texts.unpersist()
