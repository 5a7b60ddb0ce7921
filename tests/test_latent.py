"""Learned embeddings against numpy's decomposition, and the command line that uses them."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import cli
from lodestone.operators import latent
from lodestone.plans import catalogue


def matrix(texts):
    """The weights, plainly."""
    counts = np.zeros((len(texts), latent.FEATURES))
    for i, t in enumerate(texts):
        for w in re.findall(r"[a-zа-я0-9]+(?:\.[a-zа-я0-9]+)*", (t or "").lower()):
            counts[i, zlib.crc32(w.encode()) % latent.FEATURES] += 1
    df = (counts > 0).sum(axis=0)
    idf = np.where(df > 0, np.log((1 + len(texts)) / (1 + df)) + 1, 0)
    a = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    norm = np.linalg.norm(a, axis=1, keepdims=True)
    return a / np.where(norm == 0, 1, norm), idf


@pytest.fixture(scope="module")
def texts():
    """Six topics of words of their own, and odd texts."""
    r = np.random.default_rng(0)
    out = [" ".join(f"topic{i % 6}w{x}" for x in r.zipf(1.6, 60) if x < 400) + " the of and" for i in range(240)]
    return [*out, None, "", "— ;", "the " * 5000]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "corpus_idx long, text string")


def test_directions_are_the_leading_singular_vectors(spark, texts):
    a, idf = matrix(texts)
    _, s, v = np.linalg.svd(a, full_matrices=False)
    for parts in (1, 5):
        model = latent.fit(frame(spark, texts).repartition(parts), dimension=6, passes=4)
        assert np.allclose(model.idf, idf) and np.allclose(model.directions.T @ model.directions, np.eye(6), atol=1e-9)
        # Principal angles between the subspaces: all cosines near 1.
        assert np.linalg.svd(v[:6] @ model.directions)[1].min() > 0.999, s[:8]
        got, want = model.embed(texts), a @ model.directions
        norm = np.linalg.norm(want, axis=1, keepdims=True)
        assert np.allclose(got, want / np.where(norm == 0, 1, norm), atol=1e-9)
        assert not got[240:243].any()


def test_texts_are_read_and_counted_once(spark, texts):
    """However many passes there are; vectors of counted rows are those of their texts."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    docs = frame(spark, texts)
    counted = latent.counted(docs.mapInArrow(seen, docs.schema))
    model = latent.fit(counted, dimension=4)
    got = {r["corpus_idx"]: r["embedding"] for r in latent.vectors(counted, model).collect()}
    assert read.value == len(texts)
    want = {r["corpus_idx"]: r["embedding"] for r in latent.vectors(docs, model).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i]) for i in want)
    read.add(-read.value)
    again = latent.fit(docs.mapInArrow(seen, docs.schema), dimension=4)
    assert read.value == len(texts) and np.allclose(again.idf, model.idf)


def test_low_rank_and_no_rows(spark):
    model = latent.fit(frame(spark, ["a b", "a b", "c"]), dimension=5)
    assert np.allclose(np.linalg.norm(model.directions, axis=0), [1, 1, 0, 0, 0])
    none = latent.fit(frame(spark, []), dimension=3)
    assert not none.embed(["a", None]).any()


def test_the_model_is_written_and_read(spark, texts, tmp_path):
    model = latent.fit(frame(spark, texts), dimension=4)
    model.write(spark, str(tmp_path / "m"))
    again = latent.LatentEmbedder.read(spark, str(tmp_path / "m"))
    assert (again.idf == model.idf).all() and (again.directions == model.directions).all() and again.dimension == 4


def test_query_finds_the_documents_that_hold_a_question(spark, sf):
    hits = {(r["question_id"], r["doc_id"]) for r in catalogue.latent_topk(spark, sf).collect()}
    held = {(r["question_id"], r["doc_id"]) for r in catalogue._holders(catalogue.questions(spark, sf), spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    share = len(hits & held) / len(held)
    assert len(hits) == 10 * len({q for q, _ in hits}) and share > 8 * 10 / n, share


def test_command_line(spark, sf, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    catalogue.chunks(spark, sf).write.parquet(at("chunks"))
    catalogue.entities.build_index(catalogue._predictions(spark, sf)).write.parquet(at("entities"))
    assert cli.main(["embed", "--chunks", at("chunks"), "--vectors", at("vectors"), "--model", at("model")]) == 0
    assert spark.read.parquet(at("vectors")).filter(F.size("embedding") == latent.DIMENSION).count() == 200
    given = ["ask", "--chunks", at("chunks"), "--vectors", at("vectors"), "--entities", at("entities"), "--question", "the of"]
    with pytest.raises(SystemExit):
        cli.main(given)
    assert cli.main([*given, "--model", at("model"), "--k", "2"]) == 0
    said = capsys.readouterr().out
    assert "[SOURCE 2]" in said and '"chunk_id"' in said
