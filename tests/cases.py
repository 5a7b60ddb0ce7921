"""Operators on small literal tables: texts that the test tables lack, such as odd references and rows.

Each case has its rows here and the rows that must come out as SQL values, worked out by hand from the definitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import patterns as P
from lodestone.functions import text as T
from lodestone.functions.models import RuleTagger
from lodestone.operators import annotate, entities, lexical, metrics
from lodestone.session import ready


def _rows(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return ready(spark).createDataFrame(list(rows), schema)


def _spans(c: str):
    return F.array_join(F.transform(c, lambda e: F.concat(e["label"], F.lit(":"), e["text"], F.lit(":"), e["start"], F.lit("-"), e["end"])), "|")


def question_entities(spark, d):
    """Entities of questions about rules, folded to one spelling."""
    rows = _rows(
        spark, "id int, question string", (1, "По СП 5.13130-2009 и табл. 3, п. 4.2"), (2, "СТО 34 01–21 пункта 7 главы 2, разделе 1.1"), (3, None), (4, ""),
        (5, "НП-001-15, ПУЭ или пуэ"), (6, "Таблице А5 и таблицу А5"), (7, "кабель 5"),
    )
    return rows.select("id", F.coalesce(F.array_join(entities.extract(F.col("question")), "|"), F.lit("")).alias("entities"))


def reference_forms(spark, d):
    """The folds of questions and those of the index."""
    rows = _rows(spark, "id int, t string", (1, "Табл.  5"), (2, "пункте 3 . 2"), (3, "Рис. 7 — 8"), (4, "Ёлка - Ель"), (5, "пп. 1,  2"), (6, "главы  3"), (7, ""))
    return rows.select("id", entities.normal_form(F.col("t")).alias("asked"), entities.normal_form(F.col("t"), P.FOLDS_INDEX).alias("indexed"))


def chunk_entity_sets(spark, d):
    """The last index row of a chunk, in the question's spelling, with the references of its id and file name."""
    index = _rows(
        spark, "chunk_id string, source_file string, page_num int, entity_labels array<string>, entity_texts array<string>, line int",
        ("c1", "old.txt", 1, ["NORM_DOC"], ["сп 1"], 1), ("c1", "СП 5.13130.txt", 1, ["NORM_REF", "NORM_REF"], ["табл. 2", "п.3"], 2), ("c2", "plain.txt", 2, [], [], 3),
    )
    chunks = _rows(spark, "chunk_id string", ("c1",), ("c2",), ("ПУЭ",), ("c4",))
    return entities.chunk_entities(chunks, entities.last_of_chunk(index, "line").drop("line")).select("chunk_id", F.array_join("chunk_entities", "|").alias("entities"))


def _records(spark):
    return _rows(
        spark, "id string, chunk_id string, source_file string, page_num int, text string", ("a", "c1", "Rules.txt", 1, "По ГОСТ 12.1.004 и п. 3.2 от 01.02.2020"), (None, "c2", "rules.txt", 2, "ГОСТ Р 53.1"),
        ("c", "c3", "rules.txt", 3, "  "), ("d", "c4", "rules.txt", 4, None), ("", "c5", "rules.txt", 5, "ПУЭ, глава 7 и приложение А"), ("f", "c6", "other.txt", 6, "СП 1"),
    )


def tagged_predictions(spark, d):
    """Chosen records with the rule tagger's spans; a span that two patterns find counts once."""
    found = annotate.predictions(_records(spark), RuleTagger(), source="RULES")
    return found.select("id", "chunk_id", "page_num", _spans("predicted_entities").alias("spans"), F.coalesce(F.aggregate("predicted_entities", F.lit(0.0), lambda a, e: a + e["score"]), F.lit(0.0)).alias("score"))


def first_scores(spark, d):
    """Of equal spans the first keeps its score."""
    rows = _rows(
        spark, "id int, e array<struct<text:string,label:string,start:int,end:int,score:double>>",
        (1, [("b", "X", 4, 5, 0.25), ("a", "Y", 0, 1, 0.5), ("b", "X", 4, 5, 0.75), ("a", "X", 0, 1, 1.0)]), (2, []),
    )
    one = lambda e: F.concat(e["label"], F.lit(":"), e["text"], F.lit(":"), e["score"])
    return rows.select("id", F.array_join(F.transform(entities.distinct_scored(F.col("e")), one), "|").alias("spans"))


def predicted_index(spark, d):
    """E13-E15 on predictions: the entities by which chunks are ranked."""
    index = entities.build_index(annotate.predictions(_records(spark), RuleTagger()))
    return index.select("chunk_id", "source_file", F.array_join("entity_labels", "|").alias("labels"), F.array_join("entity_texts", "|").alias("texts"))


def uninformative_entities(spark, d):
    """What an index leaves out."""
    rows = _rows(
        spark, "id int, label string, text string", (1, "NORM_DOC", "ПУЭ 7"), (2, "NORM_DOC", "ПУЭ"), (3, "NORM_REF", "3.2"), (4, "NORM_REF", "таблица"), (5, "NORM_REF", "таблица 4"),
        (6, "DATE", "01.02.2020"), (7, "NORM_DOC", "##сп 5"), (8, "NORM_REF", "— ;"), (9, "NORM_REF", "глава вторая"), (10, "NORM_REF", "далее"),
    )
    one = F.array(F.struct("text", "label", F.lit(0).alias("start"), F.lit(1).alias("end")))
    return rows.select("id", F.size(entities.clean_for_index(one)).cast("long").alias("kept"))


def annotation_spans(spark, d):
    """A1-A3: annotated entities of Russian texts, without overlaps."""
    rows = _rows(spark, "id int, text string", (1, "СНиП 2.04 и СП 5, пп. 1, 2"), (2, "гл. 3, раздел 4; 5 мая 2020 г."), (3, "РТМ 36.18, ГОСТ ИСО 9001"), (4, None), (5, "Таблица 7"))
    return rows.withColumn("kept", annotate.without_overlaps(annotate.find_spans()("text"))).select("id", _spans("kept").alias("spans"))


def span_bounds(spark, d):
    """Spans outside their text, or without width, go; the others are in order."""
    rows = _rows(
        spark, f"id int, text string, e {annotate.SPANS}", (1, "abcdef", [("ef", "X", 4, 6), ("a", "Y", 0, 1), ("", "X", 2, 2), ("g", "X", 5, 7), ("?", "X", -1, 1)]), (2, "", [("a", "X", 0, 1)]), (3, "ab", []),
    )
    return rows.withColumn("v", annotate.valid_spans(F.col("text"), F.col("e"))).select("id", _spans("v").alias("spans"))


def token_sentinel(spark, d):
    """Tokens of Russian text; a text without any has the sentinel, a question has none."""
    rows = _rows(spark, "id int, text string", (1, "Ёмкость СП 5.13130.2009, т.к. 3."), (2, ""), (3, "— ;"))
    return rows.select("id", F.array_join(T.tokens("text"), " ").alias("tokens"), F.size(T.query_tokens("text")).cast("long").alias("asked"))


def bm25_odd_questions(spark, d):
    """Documents without a match fill up, a question without tokens finds nothing, k = 0 finds nothing."""
    docs = _rows(spark, "corpus_idx long, text string", (0, ""), (1, "кабель и лоток"), (2, "двери"), (3, "лоток кабель кабель"))
    asked = _rows(spark, "question_id string, question string", ("one", "двери"), ("none", "окно"), ("empty", "?"))
    index = lexical.build_index(docs)
    found = lexical.topk(index, asked, 3).unionByName(lexical.topk(index, asked, 0))
    return found.select("question_id", F.col("corpus_idx").alias("doc_id"), F.col("bm25_rank").alias("rank"))


def question_rows(spark, d):
    """Ids by either name, as text."""
    rows = _rows(spark, "id string, question_id string, question string", ("7", None, " Что? "), ("8", "q8", "Где?"), (None, " q9 ", "Как?"))
    return metrics.load_questions(rows)


def relevance_rows(spark, d):
    """Three names of the list, distinct ids, and the last row of an id."""
    schema = "id string, question_id string, relevant_chunk_ids array<string>, relevant_chunks array<string>, chunk_ids array<string>, line int"
    rows = _rows(spark, schema, ("1", None, ["a"], None, None, 1), ("1", None, None, ["c", "b", "c"], None, 2), (None, "2", None, None, ["x"], 3), ("3", None, None, None, None, 4))
    return metrics.load_qrels(rows, "line").select("question_id", F.array_join("relevant_chunk_ids", "|").alias("relevant"))


def run_ids(spark, d):
    """Ids of run records; an item without one is skipped."""
    rows = _rows(spark, "question_id string, ranked_chunks array<struct<rank:int,chunk_id:string>>", ("1", [(1, "a"), (2, None), (3, "c")]), ("2", []))
    return metrics.ranked_ids(rows).select("question_id", F.col("rank").cast("long").alias("rank"), "chunk_id")


def metric_cutoffs(spark, d):
    """The cut-offs that metrics are taken at."""
    return _rows(spark, "k int", *[(k,) for k in metrics.parse_k_values("10, 1,3,,1")])


NAMES = (
    question_entities, reference_forms, chunk_entity_sets, tagged_predictions, first_scores, predicted_index, uninformative_entities, annotation_spans, span_bounds,
    token_sentinel, bm25_odd_questions, question_rows, relevance_rows, run_ids, metric_cutoffs,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in NAMES}


def _values(columns: str, *rows: tuple) -> str:
    literal = lambda v: "null" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return "select * from (values " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") t({columns})"


def oracle_sql() -> dict[str, str]:
    return {
        "question_entities": _values(
            "id, entities", (1, "п. 4.2|сп 5.13130-2009|таблица 3"), (2, "глава 2|п. 7|раздел 1.1|сто 34 01-21"), (3, ""), (4, ""), (5, "нп-001-15|пуэ"), (6, "таблица а5"), (7, ""),
        ),
        "reference_forms": _values(
            "id, asked, indexed", (1, "таблица 5", "таблица 5"), (2, "п. 3.2", "пункте 3.2"), (3, "рисунок 7-8", "рисунок 7 — 8"), (4, "елка-ель", "елка-ель"), (5, "пп. 1, 2", "пп. 1, 2"),
            (6, "глава 3", "главы 3"), (7, "", ""),
        ),
        "chunk_entity_sets": _values("chunk_id, entities", ("c1", "п. 3|сп 5.13130|таблица 2"), ("c2", ""), ("ПУЭ", "пуэ"), ("c4", "")),
        "tagged_predictions": _values(
            "id, chunk_id, page_num, spans, score", ("a", "c1", 1, "NORM_DOC:ГОСТ 12.1.004:3-16|NORM_REF:п. 3.2:19-25|DATE:01.02.2020:29-39", 3.0), ("c2", "c2", 2, "NORM_DOC:ГОСТ Р 53.1:0-11", 1.0),
            ("c", "c3", 3, "", 0.0), ("d", "c4", 4, "", 0.0), ("c5", "c5", 5, "NORM_DOC:ПУЭ:0-3|NORM_REF:глава 7:5-12|NORM_REF:приложение А:15-27", 3.0),
        ).replace("select *", "select * replace (score::double as score)"),
        "first_scores": _values("id, spans", (1, "X:a:1.0|Y:a:0.5|X:b:0.25"), (2, "")),
        "predicted_index": _values(
            "chunk_id, source_file, labels, texts", ("c1", "Rules.txt", "NORM_DOC|NORM_REF", "гост 12.1.004|п. 3.2"), ("c2", "rules.txt", "NORM_DOC", "гост р 53.1"), ("c3", "rules.txt", "", ""), ("c4", "rules.txt", "", ""),
            ("c5", "rules.txt", "NORM_DOC|NORM_REF", "пуэ|глава 7"), ("c6", "other.txt", "NORM_DOC", "сп 1"),
        ),
        "uninformative_entities": _values("id, kept", (1, 0), (2, 1), (3, 0), (4, 0), (5, 1), (6, 0), (7, 0), (8, 0), (9, 1), (10, 0)).replace("select *", "select id, kept::bigint as kept"),
        "annotation_spans": _values(
            "id, spans", (1, "NORM_DOC:СНиП 2.04:0-9|NORM_DOC:СП 5:12-16|NORM_REF:пп. 1, 2:18-26"), (2, "NORM_REF:гл. 3:0-5|NORM_REF:раздел 4:7-15|DATE:5 мая 2020 г:17-29"),
            (3, "NORM_DOC:РТМ 36.18:0-9|NORM_DOC:ГОСТ ИСО 9001:11-24"), (4, ""), (5, "NORM_REF:Таблица 7:0-9"),
        ),
        "span_bounds": _values("id, spans", (1, "Y:a:0-1|X:ef:4-6"), (2, ""), (3, "")),
        "token_sentinel": _values("id, tokens, asked", (1, "емкость сп 5.13130.2009 т.к 3", 5), (2, "__empty__", 0), (3, "__empty__", 0)).replace("select *", "select id, tokens, asked::bigint as asked"),
        "bm25_odd_questions": _values("question_id, doc_id, rank", ("one", 2, 1), ("one", 0, 2), ("one", 1, 3), ("none", 0, 1), ("none", 1, 2), ("none", 2, 3)).replace("select *", "select question_id, doc_id::bigint as doc_id, rank"),
        "question_rows": _values("question_id, question", ("7", "Что?"), ("q8", "Где?"), ("q9", "Как?")),
        "relevance_rows": _values("question_id, relevant", ("1", "b|c"), ("2", "x"), ("3", "")),
        "run_ids": _values("question_id, rank, chunk_id", ("1", 1, "a"), ("1", 2, "c")).replace("select *", "select question_id, rank::bigint as rank, chunk_id"),
        "metric_cutoffs": _values("k", (1,), (3,), (10,)),
    }
