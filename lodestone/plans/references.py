"""Operators on references to rules, over texts that are made from every row of the tables.

The tables hold no Cyrillic; each document gets references with its own numbers before its
whole text, so that SQL can say from the numbers what must come out. ``oracle_sql`` does.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import patterns as P
from lodestone.functions import text as T
from lodestone.functions.models import RuleTagger
from lodestone.operators import annotate, entities, lexical, metrics
from lodestone.session import ready

#: What stands before a document's text; {a}, {b}, {c} are doc_id, n_chars and doc_id % 9.
ASKED = "По СП {a}.13130-2009 и табл. {b}, п. {c}.2; "
ANNOTATED = "СНиП {a}.04 и ГОСТ {b}, пп. {c}, 2; "
#: What a document asks besides, so that questions hold the references of every pattern, none, no characters and no text.
ASKED_TOO = ["СТО {a} {b}–01 пункта {c} главы {b}, разделе {c}.1", None, "", "НП-{b}-15, ПУЭ или пуэ", "Таблице А{b} и таблицу А{b}", "кабель {a}"]
#: Spellings of one reference by doc_id % 6, in the question's form and in the index's.
FORMS = [("Табл.  {a}", "таблица {a}", "таблица {a}"), ("пункте {a} . 2", "п. {a}.2", "пункте {a}.2"), ("Рис. {a} — {b}", "рисунок {a}-{b}", "рисунок {a} — {b}"), ("Ёлка {a} - Ель", "елка {a}-ель", "елка {a}-ель"), ("пп. {a},  2", "пп. {a}, 2", "пп. {a}, 2"), ("главы  {a}", "глава {a}", "главы {a}")]
#: Entities by doc_id % 8, and whether an index keeps them.
KEPT = [("NORM_DOC", "ПУЭ 7", 0), ("NORM_DOC", "ПУЭ", 1), ("NORM_REF", "{a}.2", 0), ("NORM_REF", "таблица", 0), ("NORM_REF", "таблица {a}", 1), ("DATE", "01.02.2020", 0), ("NORM_DOC", "##сп {a}", 0), ("NORM_REF", "— ;", 0)]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{d}/{name}.parquet")


def _filled(form: str):
    out = F.lit(form)
    for name, value in (("a", F.col("doc_id")), ("b", F.col("n_chars")), ("c", F.col("doc_id") % 9)):
        out = F.replace(out, F.lit(f"{{{name}}}"), value.cast("string"))
    return out


def _before(form: str):
    return F.concat(_filled(form), F.coalesce("text", F.lit("")))


def _spans(c: str):
    return F.array_join(F.transform(c, lambda e: F.concat(e["label"], F.lit(":"), e["text"], F.lit(":"), e["start"], F.lit("-"), e["end"])), "|")


def question_entities(spark, d):
    """Entities of every document's questions about rules, folded to one spelling; its whole text is in the first."""
    asked = F.array(_before(ASKED), *[F.lit(None).cast("string") if x is None else _filled(x) for x in ASKED_TOO])
    rows = _t(spark, d, "documents").select("doc_id", F.posexplode(asked).alias("i", "asked"))
    return rows.select("doc_id", (F.col("i") + 1).cast("long").alias("question"), F.coalesce(F.array_join(entities.extract(F.col("asked")), "|"), F.lit("")).alias("entities"))


def reference_forms(spark, d):
    """The folds of questions and those of the index."""
    form = F.element_at(F.array(*[_filled(x) for x, _, _ in FORMS]), (F.col("doc_id") % len(FORMS) + 1).cast("int"))
    return _t(spark, d, "documents").select("doc_id", form.alias("t")).select("doc_id", entities.normal_form(F.col("t")).alias("asked"), entities.normal_form(F.col("t"), P.FOLDS_INDEX).alias("indexed"))


def chunk_entity_sets(spark, d):
    """The last index row of a chunk, in the question's spelling, with the references of its id and file name."""
    docs = _t(spark, d, "documents").select("doc_id", "n_chars", F.concat(F.lit("c"), "doc_id").alias("chunk_id"), _filled("СП {a}.txt").alias("source_file"))
    row = lambda line, *texts: docs.filter("doc_id % 5 <> 0").select("chunk_id", "source_file", F.lit(1).alias("page_num"), F.array(*[F.lit("NORM_REF")] * len(texts)).alias("entity_labels"), F.array(*map(_filled, texts)).alias("entity_texts"), F.lit(line).alias("line"))
    index = row(1, "сп 1").unionByName(row(2, "табл. {b}", "п.{a}"))
    return entities.chunk_entities(docs.select("chunk_id"), entities.last_of_chunk(index, "line").drop("line")).select("chunk_id", F.array_join("chunk_entities", "|").alias("entities"))


def _annotated(spark, d):
    return _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("source_file"), F.lit(1).alias("page_num"), _before(ANNOTATED).alias("text"))


def tagged_predictions(spark, d):
    """The rule tagger's spans of every text; a span that two patterns find counts once."""
    kept = F.filter("predicted_entities", lambda e: e["label"] != "DATE")
    found = annotate.predictions(_annotated(spark, d), RuleTagger()).withColumn("predicted_entities", kept)
    return found.select(F.col("id").cast("long").alias("doc_id"), _spans("predicted_entities").alias("spans"), F.aggregate("predicted_entities", F.lit(0.0), lambda a, e: a + e["score"]).alias("score"))


def model_entities(spark, d):
    """E5: entities of questions by patterns together with those of a tagger, in one spelling."""
    made = _before(ANNOTATED + "глава {c}.5; ")
    return _t(spark, d, "documents").select("doc_id", made.alias("question")).select("doc_id", F.array_join(entities.asked("question", tagger=RuleTagger()), "|").alias("entities"))


def predicted_index(spark, d):
    """E13-E15 on predictions: the entities by which chunks are ranked."""
    index = entities.build_index(annotate.predictions(_annotated(spark, d), RuleTagger()))
    return index.select(F.col("chunk_id").cast("long").alias("doc_id"), "source_file", F.array_join("entity_labels", "|").alias("labels"), F.array_join("entity_texts", "|").alias("texts"))


def annotation_spans(spark, d):
    """A1-A3: annotated references of every text, without overlaps."""
    kept = F.filter(annotate.without_overlaps(annotate.find_spans()("text")), lambda e: e["label"] != "DATE")
    return _annotated(spark, d).withColumn("kept", kept).select(F.col("chunk_id").cast("long").alias("doc_id"), _spans("kept").alias("spans"))


def first_scores(spark, d):
    """Of equal spans the first keeps its score."""
    span = lambda text, start, score: F.struct(F.lit(text).alias("text"), F.lit("X").alias("label"), start.cast("int").alias("start"), (start + 1).cast("int").alias("end"), score.cast("double").alias("score"))
    e = F.array(span("b", F.col("n_chars"), (F.col("doc_id") % 4) / 4), span("a", F.lit(0), F.lit(0.5)), span("b", F.col("n_chars"), F.lit(1)), span("a", F.lit(0), (F.col("doc_id") % 3) / 4))
    shown = F.transform(entities.distinct_scored(e), lambda x: F.concat(x["text"], F.lit(":"), x["start"], F.lit(":"), F.round(100 * x["score"]).cast("int")))
    return _t(spark, d, "documents").select("doc_id", F.array_join(shown, "|").alias("spans"))


def uninformative_entities(spark, d):
    """What an index leaves out."""
    pick = (F.col("doc_id") % len(KEPT) + 1).cast("int")
    label, text = (F.element_at(F.array(*[_filled(x[k]) for x in KEPT]), pick) for k in (0, 1))
    one = F.array(F.struct(text.alias("text"), label.alias("label"), F.lit(0).alias("start"), F.lit(1).alias("end")))
    return _t(spark, d, "documents").select("doc_id", F.size(entities.clean_for_index(one)).cast("long").alias("kept"))


def span_bounds(spark, d):
    """Spans outside their text, or without width, go; the others are in order."""
    n = F.length("text")
    span = lambda a, b: F.struct(F.lit("").alias("text"), F.lit("X").alias("label"), a.cast("int").alias("start"), b.cast("int").alias("end"))
    e = F.array(span(n - 1, n), span(n - 1, n + 1), span(F.lit(2), F.lit(2)), span(F.lit(-1), F.lit(1)), span(F.lit(0), F.col("doc_id") % 100))
    return _t(spark, d, "documents").withColumn("v", annotate.valid_spans(F.col("text"), e)).select("doc_id", _spans("v").alias("spans"))


def token_sentinel(spark, d):
    """Tokens of Russian text; a text without any has the sentinel, a question has none."""
    made = F.when(F.col("doc_id") % 5 == 0, "").when(F.col("doc_id") % 5 == 1, "— ;").otherwise(_before("Ёмкость СП {a}.5, т.к. "))
    return _t(spark, d, "documents").select("doc_id", made.alias("t")).select("doc_id", F.array_join(T.tokens("t"), " ").alias("tokens"), F.size(T.query_tokens("t")).cast("long").alias("asked"))


def bm25_odd_questions(spark, d):
    """Documents without a match fill up, a question without tokens finds nothing, k = 0 finds nothing."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("corpus_idx"), "text")
    odd = F.when(F.col("item_id") % 3 == 0, F.col("text")).when(F.col("item_id") % 3 == 1, "окно").otherwise("?")
    asked = _t(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), odd.alias("question"))
    index = lexical.build_index(docs)
    found = lexical.topk(index, asked, 3).unionByName(lexical.topk(index, asked, 0))
    return found.select("question_id", F.col("corpus_idx").alias("doc_id"), F.col("bm25_rank").alias("rank"))


def question_rows(spark, d):
    """Ids by either name, as text."""
    rows = _t(spark, d, "benchmark").select(F.concat(F.lit("i"), "item_id").alias("id"), F.when(F.col("item_id") % 2 == 0, F.concat(F.lit(" q"), "item_id", F.lit(" "))).alias("question_id"), F.concat(F.lit("  "), "text").alias("question"))
    return metrics.load_questions(rows)


def relevance_rows(spark, d):
    """Three names of the list, distinct ids, and the last row of an id."""
    third = lambda k, *ids: F.when(F.col("doc_id") % 3 == k, F.array(*[x.cast("string") for x in ids]))
    rows = _t(spark, d, "labels").select((F.col("doc_id") % 50).alias("id"), third(0, F.col("doc_id"), F.col("quality"), F.col("doc_id")).alias("relevant_chunk_ids"), third(1, F.col("doc_id")).alias("relevant_chunks"), third(2, F.col("toxic"), F.col("doc_id")).alias("chunk_ids"), F.col("doc_id").alias("line"))
    return metrics.load_qrels(rows, "line").select("question_id", F.array_join("relevant_chunk_ids", "|").alias("relevant"))


def run_ids(spark, d):
    """Ids of run records; an item without one is skipped."""
    item = lambda rank, c: F.struct(F.lit(rank).alias("rank"), c.cast("string").alias("chunk_id"))
    rows = _t(spark, d, "labels").select(F.col("doc_id").alias("question_id"), F.array(item(1, F.col("quality") + 7), item(2, F.when(F.col("toxic") == 1, F.col("doc_id"))), item(3, F.col("doc_id") + 1)).alias("ranked_chunks"))
    return metrics.ranked_ids(rows).select("question_id", F.col("rank").cast("long").alias("rank"), "chunk_id")


NAMES = (
    question_entities, model_entities, reference_forms, chunk_entity_sets, tagged_predictions, predicted_index, annotation_spans, first_scores, uninformative_entities, span_bounds, token_sentinel,
    bm25_odd_questions, question_rows, relevance_rows, run_ids,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in NAMES}


def _sql(form: str) -> str:
    """A form as an SQL expression."""
    out = "'" + form.replace("'", "''") + "'"
    for name, value in (("a", "doc_id"), ("b", "n_chars"), ("c", "(doc_id % 9)")):
        out = out.replace(f"{{{name}}}", f"' || {value} || '")
    return out


def _pick(forms: list[str]) -> str:
    return f"case doc_id % {len(forms)} " + " ".join(f"when {k} then {x}" for k, x in enumerate(forms)) + " end"


def _question_entities() -> str:
    """Words are put between chr(1) and chr(2), as SQL's patterns know no bounds of Cyrillic words."""
    space, word = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]", r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}]"
    # In patterns: < and > are the bounds, _ is a white space, # a number, ## a number of parts.
    signs = {"<": r"\x01", ">": r"\x02", "_": space, "##": r"\p{Nd}+(?:\x02\.\x01\p{Nd}+)*", "#": r"\p{Nd}+"}
    pack = [
        "<СП>_+<##(?:>-<#)?>", "<НП(?:>(?:-|_)<)?#>[-–—]<#>", "<СТО>_+<#>_+<#>[-–—]<#>", "<ПУЭ>", "<глав[аеуы]>_+<##>",
        "<раздел[ае]?>_+<##>", r"<п>\._*<##>", "<пункт[ае]?>_+<##>", r"<табл>\._*<[А-ЯA-Z]?##>", "<таблиц[аеуы]>_+<[А-ЯA-Z]?##>",
    ]
    found = ", ".join(f"regexp_extract_all(m, '(?i){reduce(lambda p, x: p.replace(*x), signs.items(), p)}')" for p in pack)
    form = "translate(lower(x), 'ё' || chr(160) || chr(1) || chr(2), 'е ')"
    for p, by in ((r"^(табл\._*|таблиц[аеуы]_+)", "таблица "), (r"^(пункт[ае]?_+|п\._*)", "п. "), ("^глав[аеуы]_+", "глава "), ("^раздел[ае]?_+", "раздел "), ("[-–—]", "-"), ("_+", " ")):
        form = f"regexp_replace({form}, '{p.replace('_', space)}', '{by}', 'g')"
    asked = ", ".join([f"{_sql(ASKED)} || coalesce(text, '')", *["null" if x is None else _sql(x) for x in ASKED_TOO]])
    return f"""with asked as (select doc_id, unnest(range(1, {len(ASKED_TOO) + 2})) as question, unnest([{asked}]) as q from documents),
marked as (select doc_id, question, regexp_replace(translate(q, chr(1) || chr(2), '!!'), '({word}+)', chr(1) || '\\1' || chr(2), 'g') as m from asked),
found as (select doc_id, question, flatten([{found}]) as e from marked)
select doc_id, question, coalesce(array_to_string(list_sort(list_distinct(list_transform(e, lambda x: {form}))), '|'), '') as entities from found"""


def oracle_sql(tokens: Callable[[str], str], bm25: Callable[[str, int], str]) -> dict[str, str]:
    """tokens: the SQL of a text's tokens; bm25: CTEs up to bm(question_id, doc_id, s, rank) for a query that gives the questions."""
    first, second, third = (_sql(x) for x in ("СНиП {a}.04", "ГОСТ {b}", "пп. {c}, 2"))
    second_at, third_at = f"length({first}) + 3", f"length({first}) + 3 + length({second}) + 2"
    place = lambda label, text, at: f"'{label}:' || {text} || ':' || ({at}) || '-' || ({at} + length({text}))"
    spans = f"{place('NORM_DOC', first, '0')} || '|' || {place('NORM_DOC', second, second_at)} || '|' || {place('NORM_REF', third, third_at)}"
    made = f"case doc_id % 5 when 0 then '' when 1 then '— ;' else {_sql('Ёмкость СП {a}.5, т.к. ')} || coalesce(text, '') end"
    return {
        "question_entities": _question_entities(),
        "model_entities": f"select doc_id, {_sql('глава {c}.5|гост {b}|пп. {c}, 2|снип {a}.04')} as entities from documents",
        "reference_forms": f"select doc_id, {_pick([_sql(x[1]) for x in FORMS])} as asked, {_pick([_sql(x[2]) for x in FORMS])} as indexed from documents",
        "chunk_entity_sets": f"select 'c' || doc_id as chunk_id, case when doc_id % 5 = 0 then '' else {_sql('п. {a}|сп {a}|таблица {b}')} end as entities from documents",
        "tagged_predictions": f"select doc_id, {spans} as spans, 3.0::double as score from documents",
        "predicted_index": f"select doc_id, source as source_file, 'NORM_DOC|NORM_DOC|NORM_REF' as labels, lower({second} || '|' || {first} || '|' || {third}) as texts from documents",
        "annotation_spans": f"select doc_id, {spans} as spans from documents",
        "first_scores": "select doc_id, case when n_chars = 0 then 'a:0:50|b:0:' || (doc_id % 4 * 25) else 'a:0:50|b:' || n_chars || ':' || (doc_id % 4 * 25) end as spans from documents",
        "uninformative_entities": f"select doc_id, ({_pick([str(x[2]) for x in KEPT])})::bigint as kept from documents",
        "span_bounds": """select doc_id, array_to_string(list_transform(list_sort(list_filter([[0, doc_id % 100], [length(text) - 1, length(text)]], lambda x: x[1] >= 0 and x[1] < x[2] and x[2] <= length(text))), lambda x: 'X::' || x[1] || '-' || x[2]), '|') as spans from documents""",
        "token_sentinel": f"select doc_id, case when len(t) = 0 then '__empty__' else array_to_string(t, ' ') end as tokens, len(t) as asked from (select doc_id, {tokens(f'({made})')} as t from documents)",
        "bm25_odd_questions": f"with {bm25('''select item_id as question_id, case item_id % 3 when 0 then text when 1 then 'окно' else '?' end as question from benchmark''', 3)} select question_id, doc_id, rank from bm",
        "question_rows": "select case when item_id % 2 = 0 then 'q' || item_id else 'i' || item_id end as question_id, trim(text) as question from benchmark",
        "relevance_rows": """select id::varchar as question_id, array_to_string(list_sort(list_distinct(list_transform(case doc_id % 3 when 0 then [doc_id, quality] when 1 then [doc_id] else [toxic, doc_id] end, lambda x: x::varchar))), '|') as relevant
from (select *, doc_id % 50 as id from labels qualify row_number() over (partition by doc_id % 50 order by doc_id desc) = 1)""",
        "run_ids": "select doc_id as question_id, unnest(range(1, len(c) + 1)) as rank, unnest(c) as chunk_id from (select doc_id, list_filter([(quality + 7)::varchar, case when toxic = 1 then doc_id::varchar end, (doc_id + 1)::varchar], lambda x: x is not null) as c from labels)",
    }
