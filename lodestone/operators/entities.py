"""Entities: extraction by patterns, normal forms, cleaning, the chunk entity index, overlap scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import patterns as P
from lodestone.functions.models import EntityTagger, tag_column
from lodestone.functions.text import searchable, single_spaced, strip

SPANS = "array<struct<text:string,label:string,start:int,end:int>>"


def normal_form(c: Column, folds: list[tuple[str, str]] = P.FOLDS_QUERY) -> Column:
    """One spelling of a reference (E2; E3 with FOLDS_INDEX)."""
    for pattern, by in folds:
        c = F.regexp_replace(searchable(c) if (pattern, by) == folds[0] else c, P.java(pattern), by)
    return single_spaced(c)


def extract(c: Column, pack: list[str] = P.QUERY_ENTITIES, folds: list[tuple[str, str]] | None = P.FOLDS_QUERY) -> Column:
    """The distinct normal forms of all matches of a pack (E1, E4), sorted."""
    found = F.flatten(F.array(*[F.regexp_extract_all(c, F.lit(P.java(p) if folds is not None else p), F.lit(0)) for p in pack]))
    forms = F.transform(found, lambda x: normal_form(x, folds) if folds is not None else F.lower(x))
    return F.array_sort(F.array_distinct(F.filter(forms, lambda x: x != "")))


def _any(text: Column, tests: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(P.java(p)) for p in tests], F.lit(False))


def is_bad(e: Column, rules: dict[str, list[str]] = P.NOT_PREDICTED) -> Column:
    """True for spans that are no entity (E12; A12 with NOT_ANNOTATED)."""
    text = single_spaced(e["text"])
    bad = (text == "") | e["text"].contains("##") | _any(text, rules[""])
    for label, tests in rules.items():
        if label:
            bad = bad | ((e["label"] == label) & _any(text, tests))
    return F.coalesce(bad, F.lit(True))


def is_informative(label: Column, text: Column) -> Column:
    """Whether an indexed entity says enough to rank by."""
    telling = text.rlike(r"\d") | reduce(lambda a, b: a | b, [text.startswith(p) for p in P.TELLING_BEGINNINGS])
    return label.isin(P.INDEXED_LABELS) & (text != "") & ((label == "NORM_DOC") | (~text.isin(P.GENERIC_REFERENCES) & telling))


def asked(question: str, pack: list[str] = P.QUERY_ENTITIES, tagger: EntityTagger | None = None) -> Column:
    """Sorted entities of a question by patterns, and those of a tagger's documents and references where one is given (E5)."""
    found = extract(F.col(question), pack)
    if tagger is None:
        return found
    tagged = F.filter(tag_column(tagger, question), lambda e: e["label"].isin("NORM_DOC", "NORM_REF"))
    own = F.filter(F.transform(tagged, lambda e: normal_form(e["text"])), lambda x: x != "")
    return F.array_sort(F.array_union(found, own))


def clean_for_index(ents: Column) -> Column:
    """Good, informative entities as distinct (label, text), sorted."""
    good = F.filter(ents, lambda e: ~is_bad(e))
    forms = F.transform(good, lambda e: F.struct(e["label"].alias("label"), normal_form(e["text"], P.FOLDS_INDEX).alias("text")))
    return F.array_sort(F.array_distinct(F.filter(forms, lambda e: is_informative(e["label"], e["text"]))))


def build_index(predictions: DataFrame, ents: str = "predicted_entities") -> DataFrame:
    """One row a chunk, also without entities: chunk_id, source_file, page_num, entity_labels, entity_texts."""
    found = predictions.select("chunk_id", "source_file", "page_num", clean_for_index(F.col(ents)).alias("_e"))
    return found.select("chunk_id", "source_file", "page_num", F.col("_e.label").alias("entity_labels"), F.col("_e.text").alias("entity_texts"))


def last_of_chunk(index: DataFrame, order: str) -> DataFrame:
    """The last row of each chunk_id in the order (E6); a grouped maximum, so no chunk's rows meet in a sort."""
    return index.groupBy("chunk_id").agg(F.max_by(F.struct(*[c for c in index.columns if c != "chunk_id"]), order).alias("_r")).select("chunk_id", "_r.*")


def chunk_entities(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """chunks with entities: the index's in normal form, and those of the id and file name.
    A chunk that the index lacks has only those of its id."""
    known = index.select("chunk_id", F.col("entity_texts"), F.col("source_file").alias("_file"), F.lit(True).alias("_known"))
    named = F.concat_ws(" ", F.col("chunk_id"), F.col("_file"))
    stored = F.filter(F.transform("entity_texts", lambda x: normal_form(x)), lambda x: x != "")
    both = F.array_union(F.coalesce(stored, F.array().cast("array<string>")), extract(named))
    return chunks.join(known, "chunk_id", "left").withColumn("chunk_entities", F.array_sort(F.array_distinct(both))).drop("entity_texts", "_file", "_known")


def overlap(query: Column, chunk: Column) -> tuple[Column, Column]:
    """Sorted common entities, and their share of the query's; 0 for a query without any."""
    common = F.array_sort(F.array_intersect(query, chunk))
    return common, F.when(F.size(query) == 0, 0.0).otherwise(F.size(common) / F.size(query))


def rerank(hits: DataFrame, k: int, weight: float = 0.5, base: str | None = None, rank: str = "candidate_rank", score: str = "ner_score_total") -> DataFrame:
    """hits with query_entities and chunk_entities, ordered by base + weight * overlap.
    base: a score column; without one, 1 / rank. Ties keep the candidates' order."""
    common, share = overlap(F.col("query_entities"), F.col("chunk_entities"))
    start = F.coalesce(F.col(base), F.lit(0.0)) if base else 1 / F.col(rank)
    scored = hits.withColumn("ner_overlap", common).withColumn("ner_score", share).withColumn(score, start + weight * F.col("ner_score"))
    order = Window.partitionBy("question_id").orderBy(F.desc(F.round(score, 9)), F.col(rank))
    return scored.withColumn("final_rank", F.row_number().over(order)).filter(F.col("final_rank") <= k)


def distinct_spans(ents: Column) -> Column:
    """Distinct (label, start, end, text), the first of each kept, sorted by start, end, label."""
    keyed = F.transform(ents, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["label"].alias("label"), e["text"].alias("text")))
    return F.transform(F.array_sort(F.array_distinct(keyed)), lambda e: F.struct(e["text"].alias("text"), e["label"].alias("label"), e["start"].alias("start"), e["end"].alias("end")))


def distinct_scored(ents: Column) -> Column:
    """Spans with scores as distinct_spans has them; of equal ones the first keeps its score."""
    key = ("start", "end", "label", "text")
    keyed = F.array_sort(F.transform(ents, lambda e, i: F.struct(*[e[k].alias(k) for k in key], i.alias("i"), e["score"].alias("score"))))
    same = lambda a, b: reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in key])
    # Bound through a one-element array, so the spans are sorted once.
    first = F.transform(F.array(keyed), lambda k: F.filter(k, lambda e, i: (i == 0) | ~same(e, F.get(k, i - 1))))[0]
    return F.transform(first, lambda e: F.struct(e["text"].alias("text"), e["label"].alias("label"), e["start"].alias("start"), e["end"].alias("end"), e["score"].alias("score")))


def select_records(records: DataFrame, order: str, source: str | None = None, text: str | None = None, limit: int | None = None) -> DataFrame:
    """Records whose file and text hold the given parts, whatever the case, in order."""
    for name, part in (("source_file", source), ("text", text)):
        if part:
            records = records.filter(F.contains(F.lower(name), F.lit(part.lower())))
    return records if limit is None else records.orderBy(order).limit(limit)


def blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""
