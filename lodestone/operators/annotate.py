"""Annotated corpora and training data for entity taggers."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import patterns as P
from lodestone.functions.text import strip
from lodestone.functions.models import EntityTagger, tag_column
from lodestone.operators.entities import SPANS, distinct_scored, distinct_spans, is_bad, select_records

LEAST_LENGTH, MOST_RECORDS = 80, 1000
#: Records that are sorted rather than counted by hash.
BUCKET = 4096
#: Tokens of aligned records that a worker holds, about, before it passes them on.
TOKENS = 1 << 15


def find_spans(pack: dict[str, list[str]] = P.ANNOTATIONS):
    """A function of a text that gives all matches of a pack with their places (A2)."""
    tests = [(label, re.compile(p, re.IGNORECASE)) for label, ps in pack.items() for p in ps]

    @F.pandas_udf(SPANS)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"text": m.group(), "label": label, "start": m.start(), "end": m.end()} for label, p in tests for m in p.finditer(t or "")])

    return run


def without_overlaps(ents: Column) -> Column:
    """Spans from the left, of those that begin together the longest, that touch no span kept before (A3).
    Kept spans are in order, so only the last end matters."""
    keyed = F.array_sort(F.transform(ents, lambda e: F.struct(e["start"].alias("start"), (-e["end"]).alias("back"), e["label"].alias("label"), e["text"].alias("text"))))
    empty = F.struct(F.array().cast(SPANS).alias("kept"), F.lit(-1).alias("last"))
    one = lambda x: F.struct(x["text"].alias("text"), x["label"].alias("label"), x["start"].alias("start"), (-x["back"]).alias("end"))
    step = lambda a, x: F.when(x["start"] >= a["last"], F.struct(F.concat(a["kept"], F.array(one(x))).alias("kept"), (-x["back"]).alias("last"))).otherwise(a)
    return F.aggregate(keyed, empty, step, lambda a: a["kept"])


def auto_score(text: Column, ents: Column) -> Column:
    """How much a record is worth annotating (A4)."""
    of = lambda label: F.size(F.filter(ents, lambda e: e["label"] == label))
    word = lambda points, *any_: F.when(sum_any(text, any_), points).otherwise(0)
    return (2 * F.size(ents) + 3 * of("NORM_DOC") + 2 * of("NORM_REF") + of("DATE") + word(3, "ГОСТ") + word(2, "СП") + word(2, "ПУЭ") + word(1, "табл.", "Таблица", "таблица")).cast("int")


def sum_any(text: Column, parts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | text.contains(p)
    return found


def record_id(df: DataFrame) -> Column:
    given = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("id", "chunk_id") if c in df.columns]
    return F.coalesce(*given)


def predictions(records: DataFrame, tagger: EntityTagger, order: str = "chunk_id", source: str | None = None, text: str | None = None, limit: int | None = None) -> DataFrame:
    """Selected records with the tagger's entities, without bad and repeated ones (E17, E20): the rows of schemas.PREDICTION."""
    chosen = select_records(records, order, source, text, limit)
    found = distinct_scored(F.filter(tag_column(tagger, "text"), lambda e: ~is_bad(e)))
    return chosen.select(record_id(chosen).alias("id"), "source_file", "page_num", "chunk_id", "text", found.alias("predicted_entities"))


def candidates(records: DataFrame, existing: DataFrame | None = None, pack: dict[str, list[str]] = P.ANNOTATIONS) -> DataFrame:
    """New records long enough and with entities, scored (A5-A8): id, source_file, page_num, chunk_id, text, entities, auto_score."""
    named = records.withColumn("id", record_id(records)).filter(F.col("id").isNotNull())
    if existing is not None:
        named = named.join(existing.select(record_id(existing).alias("id")).distinct(), "id", "left_anti")
    long_enough = named.filter(F.length(strip("text")) >= LEAST_LENGTH)
    found = long_enough.withColumn("entities", without_overlaps(find_spans(pack)("text"))).filter(F.size("entities") > 0)
    return found.select("id", "source_file", "page_num", "chunk_id", "text", "entities", auto_score(F.col("text"), F.col("entities")).alias("auto_score"))


def best(rows: DataFrame, most: int = MOST_RECORDS) -> DataFrame:
    """The records with the highest scores."""
    return rows.orderBy(F.desc("auto_score"), "source_file", "page_num", "chunk_id").limit(most)


def export(records: DataFrame, existing: DataFrame, most: int = MOST_RECORDS, pack: dict[str, list[str]] = P.ANNOTATIONS) -> DataFrame:
    """Existing records, then the best new ones (A10); src is 0 and 1 for these."""
    new = best(candidates(records, existing, pack), most)
    return existing.select(*new.columns, F.lit(0).alias("src")).unionByName(new.withColumn("src", F.lit(1)))


def counters(records: DataFrame, existing: DataFrame, pack: dict[str, list[str]] = P.ANNOTATIONS) -> DataFrame:
    """One row: scanned, existing, short, with_entities."""
    named = records.withColumn("id", record_id(records)).filter(F.col("id").isNotNull())
    known = existing.select(record_id(existing).alias("id"), F.lit(1).alias("_known")).distinct()
    marked = named.join(known, "id", "left").withColumn("_short", F.length(strip("text")) < LEAST_LENGTH)
    new = F.col("_known").isNull()
    has = F.size(find_spans(pack)("text")) > 0
    return marked.withColumn("_has", has).agg(
        F.count(F.lit(1)).alias("scanned"), F.count("_known").alias("existing"), F.count(F.when(new & F.col("_short"), 1)).alias("short"), F.count(F.when(new & ~F.col("_short") & F.col("_has"), 1)).alias("with_entities"),
    )


def finalize(records: DataFrame) -> DataFrame:
    """Records with bad and repeated spans removed and sorted, and how many bad ones there were."""
    good = F.filter("entities", lambda e: ~is_bad(e, P.NOT_ANNOTATED))
    out = records.withColumn("_good", good).withColumn("removed", (F.size("entities") - F.size("_good")).cast("int"))
    return out.withColumn("entities", distinct_spans(F.col("_good"))).drop("_good", "auto_score")


def valid_spans(text: Column, ents: Column) -> Column:
    """Spans whose places lie in the text, in order."""
    ok = F.filter(ents, lambda e: (e["start"] >= 0) & (e["end"] <= F.length(text)) & (e["start"] < e["end"]))
    keyed = F.array_sort(F.transform(ok, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["label"].alias("label"), e["text"].alias("text"))))
    return F.transform(keyed, lambda e: F.struct(e["text"].alias("text"), e["label"].alias("label"), e["start"].alias("start"), e["end"].alias("end")))


def split(records: DataFrame, key: str = "id", seed: int = 42, dev_share: float = 0.2) -> DataFrame:
    """records with split: dev for the max(1, floor(share * n)) rows that come first by a seeded hash, else train.
    The last row of dev is found by counts of hash buckets, at most 4,096 at a time, then among one bucket's rows; rows
    of one id stay together."""
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    place = F.concat(F.md5(F.concat(name, F.lit(f":{seed}"))), F.lit(":"), name)
    places = records.select(place.alias("_h")).persist(StorageLevel.MEMORY_AND_DISK)
    n = places.count()
    if n < 2:
        raise ValueError("a split needs two records at least")
    begins, wanted, left = "", max(1, int(n * dev_share)), n
    while left > BUCKET and len(begins) < 30:
        own = places.filter(F.col("_h").startswith(begins)).groupBy(F.substring("_h", len(begins) + 1, 3).alias("b"))
        for b, left in sorted((r["b"], r["count"]) for r in own.count().collect()):
            if left >= wanted:
                break
            wanted -= left
        begins += b
    last = places.filter(F.col("_h").startswith(begins)).orderBy("_h").limit(min(wanted, BUCKET)).agg(F.max("_h")).first()[0]
    places.unpersist()
    return records.withColumn("split", F.when(place <= last, "dev").otherwise("train"))


#: (text, start, end, id) of the tokens of a text, special ones with start = end.
Tokenizer = Callable[[str], list[tuple[str, int, int, int]]]


@lru_cache(1 << 16)
def _number(word: str) -> int:
    return 100 + sum(map(ord, word)) % 1000


def words_tokenizer(text: str) -> list[tuple[str, int, int, int]]:
    """Words and single marks, between two tokens without width."""
    found = [(w := m.group(), *m.span(), _number(w)) for m in re.finditer(r"\w+|[^\w\s]", text)]
    return [("[CLS]", 0, 0, 1), *found, ("[SEP]", 0, 0, 2)]


def bio(tokens: list[tuple[str, int, int, int]], spans: list[tuple[int, int, str]], number: dict[str, int]) -> list[int]:
    """A label a token: the first token that overlaps a span is B, the others I; later spans overwrite; -100 without width."""
    out = [number["O"] if a < b else -100 for _, a, b, _ in tokens]
    wide = [i for i, (_, a, b, _) in enumerate(tokens) if a < b]
    ends = [tokens[i][2] for i in wide]
    for start, end, label in spans:
        at = first = bisect_right(ends, start)
        while at < len(wide) and tokens[wide[at]][1] < end:
            out[wide[at]] = number[("B-" if at == first else "I-") + label]
            at += 1
    return out


def align(records: DataFrame, tokenizer: Tokenizer = words_tokenizer, most: int = 384, labels: list[str] = P.BIO_LABELS) -> DataFrame:
    """One row a record with tokens, labels, input_ids and attention_mask (A18), by one pass over a text's tokens and spans."""
    number = {name: i for i, name in enumerate(labels)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, held, size = 0, [], 0
            for i in range(batch.num_rows):
                text, starts, ends, names = (batch.column(k)[i].as_py() for k in (4, 5, 6, 7))
                found = tokenizer(text or "")[:most]
                held.append(([x[0] for x in found], bio(found, list(zip(starts or [], ends or [], names or [])), number), [x[3] for x in found]))
                size += len(found)
                # A batch of texts has many times as many bytes as tokens; some tokens at a time go on.
                if size >= TOKENS or i + 1 == batch.num_rows:
                    own = [pa.array([x[k] for x in held], pa.list_(kind)) for k, kind in enumerate((pa.string(), pa.int32(), pa.int32()))]
                    yield pa.RecordBatch.from_arrays([*batch.slice(at, i + 1 - at).columns[:5], *own], [*kept, "tokens", "labels", "input_ids"])
                    at, held, size = i + 1, [], 0

    kept = ["id", "source_file", "page_num", "chunk_id", "text"]
    spans = records.withColumn("_e", valid_spans(F.col("text"), F.col("entities"))).select(*kept, F.col("_e.start").alias("_a"), F.col("_e.end").alias("_b"), F.col("_e.label").alias("_c"))
    schema = ", ".join(f"`{c}` {spans.schema[c].dataType.simpleString()}" for c in kept) + ", tokens array<string>, labels array<int>, input_ids array<int>"
    return spans.mapInArrow(run, schema).withColumn("attention_mask", F.transform("tokens", lambda t: F.lit(1)))


def label_vocabulary(spark, labels: list[str] = P.BIO_LABELS) -> DataFrame:
    """label_id, label."""
    return spark.createDataFrame(list(enumerate(labels)), "label_id int, label string")


def span_scores(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: precision, recall, f1 of predicted (id, label, start, end) against gold."""
    keys = ["id", "label", "start", "end"]
    g, p = gold.select(keys).distinct(), predicted.select(keys).distinct()
    both = g.withColumn("_g", F.lit(1)).join(p.withColumn("_p", F.lit(1)), keys, "full").agg(F.count("_g").alias("g"), F.count("_p").alias("p"), F.count(F.when(F.col("_g").isNotNull() & F.col("_p").isNotNull(), 1)).alias("hit"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return both.select(ratio(F.col("hit"), F.col("p")).alias("precision"), ratio(F.col("hit"), F.col("g")).alias("recall"), ratio(2 * F.col("hit"), F.col("p") + F.col("g")).alias("f1"))


def token_accuracy(aligned: DataFrame, gold: str = "labels", predicted: str = "predicted") -> DataFrame:
    """One row: share of equal labels among tokens whose gold label is not -100."""
    pairs = aligned.select(F.explode(F.arrays_zip(F.col(gold).alias("g"), F.col(predicted).alias("p"))).alias("x")).filter("x.g <> -100")
    return pairs.agg(F.avg(F.when(F.col("x.g") == F.col("x.p"), 1.0).otherwise(0.0)).alias("accuracy"))
