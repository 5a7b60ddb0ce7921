"""The trained pair model: features against plain Python, weights against the loss itself, ranking on held-out questions."""

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions.models import HashEmbedder
from lodestone.operators import ranker
from lodestone.plans import catalogue
from lodestone.plans.engine import RetrievalEngine

SCHEMA = "question_id string, candidate_rank int, gain double, a double, b double, c double"


def plain_features(question, text):
    words = lambda t: re.findall(r"[a-zа-я0-9]+(?:\.[a-zа-я0-9]+)*", (t or "").lower().replace("ё", "е").replace("\xa0", " "))
    asked, held = words(question), words(text) or ["__empty__"]
    runs = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    share = lambda n: len(runs(asked, n) & runs(held, n)) / len(runs(asked, n)) if len(asked) >= n else 0.0
    return [share(1), share(2), share(4), np.log1p(len(held))]


def test_features_of_all_documents(spark, sf):
    docs = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    asked = [t for (t,) in duckdb.sql(f"select text from '{sf}/benchmark.parquet' order by item_id limit 4").fetchall()] + ["", "one two", "a b c d e"]
    rows = [(f"q{k % len(asked)}", i, asked[k % len(asked)], t) for k, (i, t) in enumerate(docs)] + [("x", -1, None, None), ("y", -2, "One  two one two", "three one two ё"), ("z", -3, "е one", "ё"), ("w", -4, "a b c d e f", "b c d e a " * 4000)]
    none = F.lit(None).cast("double")
    hits = spark.createDataFrame(rows, "question_id string, i long, question string, text string").withColumns({"bm25_score": none, "dense_score": F.lit(0.5), "hybrid_score": F.lit(1 / 60), "ner_score": none, "other": F.lit(1)})
    got = {r["i"]: r for r in ranker.features(hits).collect()}
    assert len(got) == len(rows)
    for _, i, q, t in rows:
        r = got[i]
        assert [r[n] for n in ("words", "pairs", "runs", "length")] == pytest.approx(plain_features(q, t))
        assert (r["lexical"], r["dense"], r["entities"]) == (0.0, 0.5, 0.0) and r["fused"] == pytest.approx(1.0)


def lists(seed, n=60):
    r = np.random.default_rng(seed)
    out = []
    for q in range(n):
        x = r.normal(size=(int(r.integers(2, 12)), 3))
        best = np.argmax(x @ [2.0, -1.0, 0.0] + r.gumbel(size=len(x)))
        out += [(f"q{q}", k + 1, float(k == best), *map(float, v)) for k, v in enumerate(x)]
    return out


def loss(rows, model, weights):
    """The mean cross entropy of the lists and the ridge, a list at a time."""
    by = {}
    for q, _, gain, *x in rows:
        by.setdefault(q, []).append((gain, weights @ ((np.array(x) - model.mean) / model.scale)))
    total = 0.0
    for own in by.values():
        norm = np.log(sum(np.exp(z) for _, z in own))
        total += sum(g * (norm - z) for g, z in own) / sum(g for g, _ in own)
    return total / len(by) + ranker.RIDGE / 2 * weights @ weights


def test_weights_are_the_least_loss(spark):
    rows = lists(1)
    trainer = ranker.Trainer(("a", "b", "c"))
    model = trainer.fit(spark.createDataFrame(rows, SCHEMA).repartition(5))
    here = loss(rows, model, model.weights)
    for k in range(3):
        for step in (-1e-3, 1e-3):
            assert loss(rows, model, model.weights + step * np.eye(3)[k]) > here
    assert model.weights[0] > 3 * abs(model.weights[2]) and model.weights[1] < 0
    again = trainer.fit(spark.createDataFrame(rows[::-1], SCHEMA).coalesce(1))
    assert again.weights == pytest.approx(model.weights, abs=1e-6)


def test_rows_that_teach_nothing(spark):
    trainer = ranker.Trainer(("a", "b", "c"))
    none = trainer.fit(spark.createDataFrame([], SCHEMA))
    assert not none.weights.any()
    # No relevant candidate, all equally relevant, one alone, no question.
    dull = [("q", 1, 0.0, 1.0, 2.0, 3.0), ("q", 2, None, 3.0, None, 1.0), ("r", 1, 1.0, 5.0, 1.0, 1.0), ("r", 2, 1.0, 4.0, 1.0, 2.0), ("s", 1, 1.0, 9.0, 9.0, 9.0), (None, 1, 1.0, 0.0, 0.0, 0.0), (None, 2, 0.0, 1.0, 1.0, 1.0)]
    given = spark.createDataFrame(dull, SCHEMA)
    assert not trainer.fit(given).weights.any()
    kept = {(r["question_id"], r["candidate_rank"]): r["final_rank"] for r in none.rerank(given.filter("question_id is not null"), 5).collect()}
    assert all(rank == final for (_, rank), final in kept.items()) and len(kept) == 5
    # A list that teaches counts the same with those beside it up to the statistics; extremes don't overflow.
    far = trainer.fit(spark.createDataFrame([("q", 1, 1.0, 1e9, 0.0, 0.0), ("q", 2, 0.0, -1e9, 0.0, 0.0)], SCHEMA))
    assert far.weights[0] > 0 and np.isfinite(far.weights).all()
    top = far.rerank(spark.createDataFrame([("q", 1, None, -1e9, None, None), ("q", 2, None, 1e9, None, None)], SCHEMA), 1).collect()
    assert [r["candidate_rank"] for r in top] == [2]


def test_engine_trains_its_scorer(spark):
    texts = ["red fire doors of steel", "doors red of fire and steel", "blue cables", "cables of blue copper", "green trays", ""]
    chunks = spark.createDataFrame([(f"c{i}", i, "f.txt", 1, "text", t) for i, t in enumerate(texts)], "chunk_id string, corpus_idx long, source_file string, page_num int, chunk_type string, text string")
    e = HashEmbedder()
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(e.embed(texts))], "corpus_idx long, embedding array<float>")
    index = spark.createDataFrame([], "chunk_id string, source_file string, page_num int, entity_labels array<string>, entity_texts array<string>")
    engine = RetrievalEngine(chunks, vectors, index, e)
    with pytest.raises(ValueError):
        engine.hybrid_reranked(engine.questions([("1", "x")]))
    asked = engine.questions([("1", "red of fire and"), ("2", "blue copper"), ("3", "steel")])
    relevant = spark.createDataFrame([("1", ["c1"]), ("2", ["c3", "c3"]), ("3", []), ("4", ["c0"])], "question_id string, relevant_chunk_ids array<string>")
    assert engine.train_scorer(asked, relevant) is engine.scorer
    hits = engine.hybrid_reranked(asked, 2).collect()
    assert {r["question_id"]: r["chunk_id"] for r in hits if r["final_rank"] == 1 and r["question_id"] != "3"} == {"1": "c1", "2": "c3"}
    assert len(hits) == 6 and all(0 <= r["reranker_score"] <= 1 for r in hits)


def test_held_out_questions_rank_better(spark):
    got = {(r["pipeline"], r["metric"]): r["value"] for r in catalogue.pair_trained_scores(spark, "/root/testdata/sf0.01").collect()}
    assert got["hybrid_reranked", "ndcg@10"] > got["hybrid", "ndcg@10"] + 0.1 and got["hybrid_reranked", "hit@1"] > got["hybrid", "hit@1"]
    assert len(got) == 28


def test_hits_of_held_out_questions(spark, sf):
    rows = catalogue.pair_trained(spark, sf).collect()
    by = {}
    for r in rows:
        by.setdefault(r["question_id"], []).append((r["rank"], r["score"]))
    assert by and all([k for k, _ in sorted(v)] == list(range(1, len(v) + 1)) and len(v) <= 10 for v in by.values())
    assert all(sorted(v) == sorted(v, key=lambda x: -x[1]) for v in by.values())


def test_candidates_of_all_questions_are_found_once(spark, monkeypatch):
    """Training and asking read the same candidates; the chunks are split, searched and tagged once."""
    from lodestone.plans import engine

    calls = []
    for module in (engine.lexical, engine.dense):
        monkeypatch.setattr(module, "topk", lambda *a, f=module.topk, n=module.__name__, **b: calls.append(n) or f(*a, **b))
    assert catalogue.pair_trained(spark, "/root/testdata/sf0.001").count() > 0
    assert sorted(calls) == ["lodestone.operators.dense", "lodestone.operators.lexical"]
