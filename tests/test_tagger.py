"""The trained tagger: decoding against all labellings, windows against whole texts, training against held-out records."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions.patterns import BIO_LABELS
from lodestone.operators import annotate, tagger
from lodestone.plans import catalogue


def test_viterbi_is_the_best_labelling():
    r = np.random.default_rng(0)
    labels = ["O", "B-X", "I-X", "B-Y", "I-Y"]
    follows, first = tagger.rules(labels)
    for n in range(1, 6):
        emission, transition = r.normal(size=(n, 5)), r.normal(size=(5, 5)) + follows
        total = lambda y: first[y[0]] + emission[range(n), y].sum() + sum(transition[a, b] for a, b in zip(y, y[1:]))
        best = max(itertools.product(range(5), repeat=n), key=total)
        assert tagger.viterbi(emission, transition, first).tolist() == list(best)
        # What can't follow is never chosen.
        assert all(not labels[b].startswith("I") or labels[a][2:] == labels[b][2:] for a, b in zip(best, best[1:])) and not labels[best[0]].startswith("I")
    assert not len(tagger.viterbi(np.zeros((0, 5)), transition, first))


def test_texts_are_decoded_side_by_side():
    r = np.random.default_rng(1)
    follows, first = tagger.rules(BIO_LABELS)
    emissions = [r.integers(-2, 3, (n, len(BIO_LABELS))).astype(float) for n in (3, 0, 7, 1, 7, 40)]
    transitions = [r.integers(-2, 3, follows.shape) + follows for _ in emissions]
    for given in (transitions[0], np.array(transitions)):
        each = transitions if given.ndim == 3 else [given] * len(emissions)
        assert [x.tolist() for x in tagger.viterbi_all(emissions, given, first)] == [tagger.viterbi(e, t, first).tolist() for e, t in zip(emissions, each)]


def test_features_are_those_of_their_strings(monkeypatch):
    text = "В п. 12.3 и  ООООО-12345,a@b.c; (Licensed under MIT) v1.0 ЁЖ"
    tokens = [t for t in annotate.words_tokenizer(text) if t[1] < t[2]]
    word, form = ["", "", *(t[0].lower() for t in tokens), "", ""], ["", "", *(tagger.shape(t[0]) for t in tokens), "", ""]
    glued = [False, *(a[2] == b[1] for a, b in zip(tokens, tokens[1:])), False]
    want = []
    for i in range(len(tokens)):
        b, a, k = "~" if glued[i] else " ", "~" if glued[i + 1] else " ", i + 2
        own = ["", f"w{word[k]}", f"p{word[k][:3]}", f"e{word[k][-3:]}", f"s{form[k]}", f"s{b}{form[k]}{a}", f"l{b}{form[k - 1]}", f"r{a}{form[k + 1]}", f"L{b}{word[k - 1]}", f"R{a}{word[k + 1]}"]
        own += [f"b{form[k - 2]}{b}{form[k - 1]} {form[k]}", f"a{form[k]} {form[k + 1]}{a}{form[k + 2]}", f"c{form[k - 1]}{b}{form[k]}{a}{form[k + 1]}", f"v{word[k - 1]}{b}{word[k]}"]
        want.append([zlib.crc32(f"{j}{x}".encode()) % tagger.FEATURES for j, x in enumerate(own)])
    # Also after the tables of a worker were begun anew.
    for most in (tagger.MEMO, 1):
        monkeypatch.setattr(tagger, "MEMO", most)
        assert tagger.features(tokens).tolist() == want == tagger.features(tokens).tolist()
    assert tagger.features([]).shape == (0, 14)


def test_spans_of_a_labelling():
    labels = ["O", "B-X", "I-X", "B-Y", "I-Y"]
    assert list(tagger.spans(np.array([1, 2, 2, 1, 0, 3, 4, 1]), labels)) == [(0, 3, "X"), (3, 4, "X"), (5, 7, "Y"), (7, 8, "X")]
    assert not list(tagger.spans(np.zeros(0, np.int64), labels))


def records(spark, n, seed):
    """Invented sentences, each with an address, a licence or a number somewhere."""
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        words = list(r.choice("the hea tion wh über, and ción. is of".split(), int(r.integers(20, 60))))
        name, place = ("".join(r.choice(list("abcdefgh"), 5)) for _ in range(2))
        one = [f"{name}.{place}@{place}.org", f"{r.integers(1, 255)}.{r.integers(1, 255)}.{r.integers(1, 255)}.{r.integers(1, 255)}", f"Licensed under {name.title()}", str(r.integers(10**14, 10**15))][i % 4]
        words.insert(int(r.integers(0, len(words))), one)
        out.append((f"{seed}-{i}", " ".join(words)))
    df = spark.createDataFrame(out, "chunk_id string, text string").select("chunk_id", F.lit("f").alias("source_file"), F.lit(1).alias("page_num"), "text")
    return annotate.candidates(df, None, catalogue.PACK)


@pytest.fixture(scope="module")
def trained(spark):
    rows = annotate.align(records(spark, 600, 1)).withColumn("split", F.lit("train"))
    return rows, tagger.Trainer(epochs=5, per_shard=100).fit(rows)


def test_held_out_records(spark, trained):
    held = records(spark, 200, 2).cache()
    found = held.select("id", F.explode(annotate.tag_column(trained[1], "text")).alias("e")).select("id", "e.label", "e.start", "e.end")
    gold = held.select("id", F.explode("entities").alias("e")).select("id", "e.label", "e.start", "e.end")
    s = annotate.span_scores(gold, found).first()
    assert s["f1"] > 0.9 and 0 < s["precision"] < 1.0001
    aligned = annotate.align(held)
    # Token by token as well (A21): what the tagger says, as labels of the tokens.
    told = annotate.align(held.withColumn("entities", F.transform(annotate.tag_column(trained[1], "text"), lambda e: F.struct(e["text"].alias("text"), e["label"].alias("label"), e["start"].alias("start"), e["end"].alias("end")))))
    both = aligned.select("id", "labels").join(told.select("id", F.col("labels").alias("predicted")), "id")
    assert annotate.token_accuracy(both).first()["accuracy"] > 0.99


def test_partitions_do_not_matter(trained):
    rows, model = trained
    again = tagger.Trainer(epochs=5, per_shard=100).fit(rows.repartition(7))
    assert (again.weights == model.weights).all() and (again.transitions == model.transitions).all()


def test_windows_give_what_the_whole_gives(spark, trained):
    model = trained[1]
    texts = [r["text"] for r in records(spark, 120, 3).collect()]
    long_ = [" ".join(texts), "", "   ", texts[0], " ".join(texts[:7])]
    whole = tagger.LinearTagger(model.weights, model.transitions, window=1 << 20).tag(long_)
    assert len(whole[0]) > 100 and all(long_[0][e["start"] : e["end"]] == e["text"] for e in whole[0])
    place = lambda found: [[(e["label"], e["start"], e["end"]) for e in t] for t in found]
    for window, stride in ((512, 128), (100, 40), (70, 69)):
        got = tagger.LinearTagger(model.weights, model.transitions, window=window, stride=stride).tag(long_)
        assert place(got) == place(whole)
    with pytest.raises(ValueError):
        tagger.LinearTagger(model.weights, model.transitions, window=10, stride=10)


def test_odd_training_rows(spark):
    schema = "id string, text string, labels array<int>, split string"
    none = tagger.Trainer(epochs=2).fit(spark.createDataFrame([], schema))
    assert not none.weights.any() and none.tag(["some words", ""]) == [[], []]
    odd = spark.createDataFrame([("1", None, [0], "train"), ("2", "a b", None, "train"), ("3", "a b", [-100, 0, 0, -100], "train"), (None, "a b", [-100, 0, 0, -100], "train"), ("4", "x y", [-100, BIO_LABELS.index("B-DATE"), 0, -100], "dev")], schema)
    assert not tagger.Trainer(epochs=2).fit(odd).tag(["x y"])[0]  # dev rows teach nothing


def test_queries(spark):
    d = "/root/testdata/sf0.01"
    found = catalogue.tagger_predictions(spark, d)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = found.collect()
    assert rows and all(texts[r["doc_id"]][r["start"] : r["end"]] == r["text"] and 0 < r["score"] <= 1 for r in rows)
    # Numbers only are no references.
    assert not any(r["text"].replace(".", "").isdigit() for r in rows)
    # The same spans are among those that patterns find in dev records, nearly always.
    scores = catalogue.tagger_scores(spark, d).first()
    dev = {r["id"] for r in catalogue.train_dev_split(spark, d).filter("split = 'dev'").collect()}
    gold = {(str(r["doc_id"]), r["label"], r["start"], r["end"]) for r in catalogue.annotate_spans(spark, d).collect() if str(r["doc_id"]) in dev}
    told = {(str(r["doc_id"]), r["label"], r["start"], r["end"]) for r in rows if str(r["doc_id"]) in dev}
    assert told & gold and scores["precision"] > 0.8 and scores["f1"] > 0.6 and len(told & gold) <= scores["recall"] * len(gold) + 1e-3


def test_alignment_passes_on_some_tokens_at_a_time(spark, sf):
    """Whole batches of texts as tokens would grow a worker with its input; rows are the same however few go on at a time."""
    given = annotate.candidates(catalogue.chunks(spark, sf), None, catalogue.PACK)
    want = {r["id"]: r.asDict() for r in annotate.align(given, most=1 << 20).collect()}
    assert "MapInArrow" in annotate.align(given)._jdf.queryExecution().executedPlan().toString()
    assert want and all(len(r["tokens"]) == len(r["labels"]) == len(r["input_ids"]) == len(r["attention_mask"]) for r in want.values())
    for r in given.collect():
        found = annotate.words_tokenizer(r["text"])
        spans = sorted((e["start"], e["end"], e["label"]) for e in r["entities"])
        assert want[r["id"]]["tokens"] == [x[0] for x in found]
        assert want[r["id"]]["labels"] == annotate.bio(found, spans, {x: i for i, x in enumerate(BIO_LABELS)})
