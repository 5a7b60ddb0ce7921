"""Subword pieces: places against the tokenizers library on every document, labels against every piece and span."""

import pickle

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.functions.models import tag_column
from lodestone.functions.patterns import BIO_LABELS
from lodestone.functions.subword import SubwordTokenizer
from lodestone.operators import annotate
from lodestone.operators.tagger import Trainer
from lodestone.plans import catalogue
from tests.test_tagger import records

public_tokenizers = pytest.importorskip("public_tokenizers")
PIECES = SubwordTokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
ODD = ["", " ", "é", "漢字🙂🙂 naïve 😀x", "<|endoftext|> a", "\n\n  \t", "ё Ё́", "ab " * 20000, "🙂" * 3000]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_places_equal_the_librarys(library):
    texts = [t for (t,) in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' where text is not null").fetchall()]
    for text in [*texts, *ODD]:
        want = library.encode(text, add_special_tokens=False)
        got = PIECES(text)
        assert [x[3] for x in got] == want.ids and [x[1:3] for x in got] == [tuple(x) for x in want.offsets]
        assert all(text[a:b] == piece for piece, a, b, _ in got)
    assert pickle.loads(pickle.dumps(PIECES)) == PIECES and len(pickle.dumps(PIECES)) < 2000


def plain_labels(offsets, spans):
    out = ["O" if a < b else None for a, b in offsets]
    for start, end, label in spans:
        met = [i for i, (a, b) in enumerate(offsets) if a < b and min(b, end) > max(a, start)]
        for i in met:
            out[i] = ("B-" if i == met[0] else "I-") + label
    return [-100 if x is None else BIO_LABELS.index(x) for x in out]


def test_labels_of_all_documents(spark, sf, library):
    got = {}
    for r in catalogue.bio_align_subword(spark, sf).orderBy("doc_id", "i").collect():
        got.setdefault(r["doc_id"], []).append((r["token_id"], r["label"]))
    rows = annotate.candidates(catalogue.chunks(spark, sf), None, catalogue.PACK).collect()
    assert len(rows) == len(got) and rows
    for r in rows:
        want = library.encode(r["text"], add_special_tokens=False)
        spans = sorted(((e["start"], e["end"], e["label"]) for e in r["entities"]), key=lambda x: x[:2])
        assert got[int(r["id"])] == list(zip(want.ids, plain_labels(want.offsets, spans)))


def test_labels_of_cut_characters(spark):
    rows = [("1", "f", 1, "c", "a🙂漢b", [("🙂", "DATE", 1, 2), ("漢b", "NORM_DOC", 2, 4)]), ("2", "f", 1, "d", "", []), ("3", "f", 1, "e", "x", None)]
    df = spark.createDataFrame(rows, "id string, source_file string, page_num int, chunk_id string, text string, entities array<struct<text:string,label:string,start:int,end:int>>")
    got = {r["id"]: [BIO_LABELS[x] for x in r["labels"]] for r in annotate.align(df, PIECES).collect()}
    kinds = [BIO_LABELS[x] for x in plain_labels([x[1:3] for x in PIECES("a🙂漢b")], [(1, 2, "DATE"), (2, 4, "NORM_DOC")])]
    assert got["1"] == kinds and kinds[:3] == ["O", "B-DATE", "I-DATE"] and kinds.count("B-NORM_DOC") == 1
    assert got["2"] == [] and got["3"] == ["O"]


def test_a_tagger_of_pieces(spark):
    train = annotate.align(records(spark, 600, 1), PIECES).withColumn("split", F.lit("train"))
    model = Trainer(epochs=5, per_shard=100, tokenizer=PIECES).fit(train)
    dev = records(spark, 200, 2).cache()
    spans = lambda ents: dev.select("id", F.explode(ents).alias("e")).select("id", "e.label", "e.start", "e.end")
    s = annotate.span_scores(spans("entities"), spans(tag_column(model, "text"))).first()
    assert s["f1"] > 0.9
