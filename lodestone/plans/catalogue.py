"""The engine's operators as queries over the test tables, whole.

Documents are chunks (doc_id is chunk and corpus order), benchmark passages are
questions whose relevant chunks hold them, embeddings are the
dense index; every vector whose id is divisible by 100 is a dense question, relevant
are the vectors of its label.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.models import HashEmbedder, OverlapScorer, embed_column, tag_column
from lodestone.functions.patterns import GENERAL
from lodestone.functions.subword import SubwordTokenizer
from lodestone.operators import annotate, cells, chunking, dense, entities, fusion, generate, latent, lexical, metrics
from lodestone.operators.tagger import Trainer
from lodestone.plans import files, references
from lodestone.plans.engine import RetrievalEngine
from lodestone.session import ready, scratch
from lodestone.sources.pages import html_column

K, K_VALUES = 10, [1, 3, 5, 10]
#: Labels under which general entities go through the index's rules.
PACK = {"NORM_REF": GENERAL["EMAIL"] + GENERAL["ADDRESS"] + GENERAL["NUMBER"], "NORM_DOC": GENERAL["LICENCE"]}
FLAT = [p for ps in GENERAL.values() for p in ps]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{d}/{name}.parquet")


def chunks(spark, d) -> DataFrame:
    return _t(spark, d, "documents").select(F.col("doc_id").alias("corpus_idx"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("source_file"), F.lit(1).alias("page_num"), F.lit("text").alias("chunk_type"), "text")


def questions(spark, d) -> DataFrame:
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def vectors(spark, d) -> DataFrame:
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("corpus_idx"), "embedding")


def dense_questions(spark, d) -> DataFrame:
    return _t(spark, d, "embeddings").filter("vec_id % 100 = 0").select((F.col("vec_id") / 100).cast("long").alias("question_id"), "embedding", "label")


def text_clean(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.clean("text").alias("cleaned"), T.collapse("text").alias("collapsed"))


def tokenize(spark, d):
    t = T.tokens("text")
    return _t(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


def bm25_index_stats(spark, d):
    i = lexical.build_index(chunks(spark, d))
    return i.terms.select("term", "df", F.round("idf", 6).alias("idf"))


def _bm25(spark, d, asked=None, k=K):
    return lexical.topk(lexical.build_index(chunks(spark, d)), questions(spark, d) if asked is None else asked, k)


def bm25_topk(spark, d):
    return _bm25(spark, d).select("question_id", F.col("corpus_idx").alias("doc_id"), F.round("bm25_score", 6).alias("score"), F.col("bm25_rank").alias("rank"))


def knn_topk(spark, d):
    return dense.topk(vectors(spark, d), dense_questions(spark, d), K).select("question_id", F.col("corpus_idx").alias("vec_id"), F.round("dense_score", 6).alias("score"), F.col("dense_rank").alias("rank"))


def knn_cells(spark, d):
    """The nearest vectors from an index of cells, written and read back (V5, V6); its recall is measured against knn_topk."""
    path, held = scratch(ready(spark), "cells"), vectors(spark, d)
    cells.write(held, path, *cells.fit(held))
    return cells.topk(spark, path, held, dense_questions(spark, d), K).select("question_id", F.col("corpus_idx").alias("vec_id"), F.round("dense_score", 6).alias("score"), F.col("dense_rank").alias("rank"))


def _settled(spark, df, name):
    """A table of hits, written and read back: its size is known then, so what is joined to it goes to the hits, not they to it."""
    folder = scratch(ready(spark), name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def _named(df):
    return df.withColumn("chunk_id", F.col("corpus_idx"))


def _fused(spark, d, most):
    """A question may have a dense side, a lexical one, or both."""
    return fusion.rrf(_named(dense.topk(vectors(spark, d), dense_questions(spark, d), most)), _named(_bm25(spark, d, None, most)), 60, most)


def rrf_hybrid(spark, d):
    return _fused(spark, d, 100).select("question_id", "chunk_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("dense_rank", "bm25_rank")], F.round("hybrid_score", 9).alias("hybrid_score"), F.col("candidate_rank").alias("rank"))


def hybrid_single_side(spark, d):
    near = _named(dense.topk(vectors(spark, d), dense_questions(spark, d), 100))
    none = near.limit(0).select("question_id", "chunk_id", F.lit(None).cast("int").alias("bm25_rank"))
    return fusion.rrf(near, none, 60, K).select("question_id", "chunk_id", F.round("hybrid_score", 9).alias("hybrid_score"), F.col("candidate_rank").alias("rank"))


def _entities(c="text"):
    return entities.extract(F.col(c), FLAT, None)


def entity_extract(spark, d):
    return _t(spark, d, "documents").select("doc_id", _entities().alias("e")).filter("size(e) > 0").select("doc_id", F.array_join("e", "|").alias("entities"))


def entity_normalize(spark, d):
    return _t(spark, d, "documents").select("doc_id", entities.normal_form(F.col("text")).alias("normal"))


def _predictions(spark, d):
    found = annotate.find_spans(PACK)("text")
    return chunks(spark, d).select("chunk_id", "source_file", "page_num", "text", found.alias("predicted_entities"))


def entity_clean(spark, d):
    e = entities.clean_for_index(F.col("predicted_entities"))
    return _predictions(spark, d).select(F.col("chunk_id").cast("long").alias("doc_id"), F.array_join(F.transform(e, lambda x: F.concat_ws(":", x["label"], x["text"])), "|").alias("entities"))


def entity_index(spark, d):
    i = entities.build_index(_predictions(spark, d))
    return i.select(F.col("chunk_id").cast("long").alias("doc_id"), "source_file", "page_num", F.array_join("entity_labels", "|").alias("labels"), F.array_join("entity_texts", "|").alias("texts"))


def entity_overlap_score(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", _entities().alias("e"))
    other = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("e").alias("c"))
    common, share = entities.overlap(F.col("e"), F.col("c"))
    return docs.join(other, "doc_id").select("doc_id", F.array_join(common, "|").alias("overlap"), F.round(share, 6).alias("score"))


def _marked(spark, d, hits):
    """The question's entities are those of the document numbered 100 times as high, the chunk's its own."""
    texts, hits = _t(spark, d, "documents").select("doc_id", "text"), _settled(spark, hits, "hits")
    none = F.array().cast("array<string>")
    # Entities are looked for in documents that are asked or met only.
    met = lambda keys: texts.join(keys.distinct(), "doc_id", "left_semi").select("doc_id", _entities().alias("e"))
    asked = met(hits.select((F.col("question_id") * 100).alias("doc_id"))).select((F.col("doc_id") / 100).cast("long").alias("question_id"), F.col("e").alias("q"))
    own = met(hits.select(F.col("chunk_id").alias("doc_id"))).select(F.col("doc_id").alias("chunk_id"), F.col("e").alias("c"))
    return hits.join(asked, "question_id", "left").join(own, "chunk_id", "left").withColumn("query_entities", F.coalesce("q", none)).withColumn("chunk_entities", F.coalesce("c", none)).drop("q", "c")


def _knn_reranked(spark, d):
    near = _named(dense.topk(vectors(spark, d), dense_questions(spark, d), 50)).withColumnRenamed("dense_rank", "candidate_rank")
    return entities.rerank(_marked(spark, d, near), K, 0.5)


def knn_entity_rerank(spark, d):
    return _knn_reranked(spark, d).select("question_id", "chunk_id", F.round("ner_score", 6).alias("ner_score"), F.round("ner_score_total", 6).alias("score"), F.col("final_rank").alias("rank"))


def hybrid_entity_rerank(spark, d):
    return entities.rerank(_marked(spark, d, _fused(spark, d, 100)), K, 0.05, "hybrid_score").select("question_id", "chunk_id", F.round("ner_score", 6).alias("ner_score"), F.round("ner_score_total", 9).alias("score"), F.col("final_rank").alias("rank"))


def _holders(asked, docs):
    """question_id, doc_id of the documents that hold a question's whole text. They hold its second to fifth words as
    whole words, so pairs meet by these; questions of fewer words are looked up in every text."""
    words = lambda c: F.split(F.trim(c), r"[ \n\t]+")
    four = lambda w, i: F.xxhash64(*[F.get(w, i + j) for j in range(4)])
    long_ = F.size(words("question")) > 5
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("_w") - 4)), lambda i: four(F.col("_w"), i))
    held = docs.withColumn("_w", words("text")).select("doc_id", "text", F.explode(F.array_distinct(runs)).alias("_key"))
    keyed = asked.filter(long_).select("question_id", "question", four(words("question"), F.lit(1)).alias("_key"))
    # Only the numbers of what meets are carried; the texts come back for the test itself.
    met = held.select("doc_id", "_key").join(keyed.select("question_id", "_key"), "_key").select("doc_id", "question_id").distinct()
    met = _settled(docs.sparkSession, met, "met")
    near = met.join(docs.select("doc_id", "text"), "doc_id").join(asked.select("question_id", "question"), "question_id")
    brief = asked.filter(~long_ & (F.trim("question") != "")).select("question_id", "question").join(docs.select("doc_id", "text"), F.col("text").contains(F.col("question")))
    return near.filter(F.col("text").contains(F.col("question"))).select("question_id", "doc_id").unionByName(brief.select("question_id", "doc_id"))


def _lexical_metrics(spark, d):
    asked = questions(spark, d)
    qrels = _holders(asked, _t(spark, d, "documents")).groupBy("question_id").agg(F.collect_list(F.col("doc_id")).alias("relevant_chunk_ids"))
    run = _bm25(spark, d).select("question_id", F.col("corpus_idx").alias("chunk_id"), F.col("bm25_rank").alias("rank"))
    return metrics.per_question(run, asked, qrels, K_VALUES, K, K)


def _dense_metrics(spark, d, run):
    asked = dense_questions(spark, d)
    all_ = _t(spark, d, "embeddings").select("label", F.col("vec_id").alias("chunk_id"))
    qrels = asked.select("question_id", "label").join(all_, "label").groupBy("question_id").agg(F.collect_list("chunk_id").alias("relevant_chunk_ids"))
    return metrics.per_question(run, asked, qrels, K_VALUES, K, K)


def metrics_per_question(spark, d):
    return _lexical_metrics(spark, d).select("question_id", "metric", F.round("value", 6).alias("value"))


def metrics_mean(spark, d):
    return metrics.mean(_lexical_metrics(spark, d)).select("metric", F.round("value", 6).alias("value"))


def _two(spark, d):
    plain = dense.topk(vectors(spark, d), dense_questions(spark, d), K).select("question_id", F.col("corpus_idx").alias("chunk_id"), F.col("dense_rank").alias("rank"))
    better = _knn_reranked(spark, d).select("question_id", "chunk_id", F.col("final_rank").alias("rank"))
    return metrics.mean(_dense_metrics(spark, d, plain)), metrics.mean(_dense_metrics(spark, d, better))


def metrics_delta(spark, d):
    return metrics.delta(*_two(spark, d)).select("metric", F.round("value", 6).alias("value"))


def metrics_wide(spark, d):
    plain, better = _two(spark, d)
    names = [m for k in K_VALUES for m in (f"hit@{k}", f"recall@{k}", f"precision@{k}")] + [f"mrr@{K}", f"ndcg@{K}"]
    both = plain.withColumn("pipeline", F.lit("dense")).unionByName(better.withColumn("pipeline", F.lit("dense_entities")))
    w = metrics.wide(both, names)
    return w.select("pipeline", *[F.round(F.col(f"`{n}`"), 6).alias(n.replace("@", "_at_")) for n in names])


def run_records(spark, d):
    hits = _bm25(spark, d).select("question_id", F.col("corpus_idx").cast("string").alias("chunk_id"), F.col("bm25_rank").alias("rank")).join(questions(spark, d), "question_id")
    records = metrics.run_records(hits, "bm25", ["rank", "chunk_id"])
    return records.select("question_id", "pipeline", F.array_join(F.transform("ranked_chunks", lambda x: F.concat_ws(":", x["rank"], x["chunk_id"])), "|").alias("ranked"))


def run_items(spark, d):
    """Every field of the items of two runs, the fused one and its entity-reranked form (M12); what is null is -1 or ''."""
    found, asked = _fused(spark, d, 100), questions(spark, d)
    own = chunks(spark, d).select(F.col("corpus_idx").alias("chunk_id"), "source_file", "page_num", "chunk_type")
    full = lambda hits: hits.join(asked, "question_id").join(own, "chunk_id", "left")
    plain = metrics.run_items(full(found.filter(F.col("candidate_rank") <= K).withColumn("rank", F.col("candidate_rank"))), "hybrid")
    better = metrics.run_items(full(entities.rerank(_marked(spark, d, found), K, 0.05, "hybrid_score")), "hybrid_entities")
    rows = plain.unionByName(better).select("question_id", F.md5("question").alias("question_md5"), "pipeline", F.explode("ranked_chunks").alias("x")).select("question_id", "question_md5", "pipeline", "x.*")
    whole = lambda c: F.coalesce(F.col(c), F.lit(-1)).alias(c)
    real = lambda c: F.round(F.coalesce(F.col(c), F.lit(-1.0)), 9).alias(c)
    word = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    joined = lambda c: F.coalesce(F.array_join(c, "|"), F.lit("")).alias(c)
    return rows.select(
        "question_id", "question_md5", "pipeline", "rank", "chunk_id", word("source_file"), whole("page_num"), word("chunk_type"), real("score"), whole("dense_rank"), whole("bm25_rank"),
        real("hybrid_score"), real("ner_score_total"), "final_rank", real("ner_score"), joined("ner_overlap"), joined("query_entities"),
    )


def chunk_text(spark, d):
    w = chunking.text_windows()
    return _t(spark, d, "documents").select("doc_id", F.posexplode(w("text")).alias("i", "c")).select("doc_id", "i", "c.char_start", "c.char_end", "c.text")


def _conversation_files(spark, d):
    """A conversation is a file, a turn a page; at most some dozens of turns."""
    page = F.concat(F.lit("--- PAGE "), F.col("turn"), F.lit(" ---\n"), F.coalesce("text", F.lit("")))
    rows = _t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", page.alias("p")))).alias("x"))
    return rows.select(F.concat(F.col("conv_id"), F.lit(".txt")).alias("source_file"), F.array_join("x.p", "\n").alias("full_text"))


def page_split(spark, d):
    return chunking.split_pages(_conversation_files(spark, d)).select("source_file", "page_num", "page_text")


def paragraph_split(spark, d):
    spaced = F.regexp_replace("text", "\n", "\n\n")
    return _t(spark, d, "documents").select("doc_id", F.posexplode(T.paragraphs(spaced)).alias("i", "paragraph"))


def _tables(c="text"):
    """Lines with bars as a titled table after the others, every line a paragraph."""
    lines = F.split(c, "\n")
    rows = F.filter(lines, lambda x: x.contains(" | "))
    rest = F.filter(lines, lambda x: ~x.contains(" | "))
    table = F.concat(F.lit("\n\nTABLE 1\n\n[TABLE_START]\n"), F.regexp_replace(F.array_join(rows, "\n"), r" \| ", "\n"), F.lit("\n[TABLE_END]"))
    return F.concat(F.array_join(rest, "\n\n"), F.when(F.size(rows) > 0, table).otherwise(""))


def semantic_blocks(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.posexplode(chunking.semantic_blocks(_tables())).alias("i", "b")).select("doc_id", "i", "b.type", "b.text")


def chunk_table(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.posexplode(chunking.page_chunks()(_tables())).alias("i", "c")).filter("c.chunk_type = 'table'").select("doc_id", "i", "c.text")


def chunk_ids(spark, d):
    return chunking.corpus_chunks(_conversation_files(spark, d)).drop("page_ordinal")


def annotate_spans(spark, d):
    return chunks(spark, d).select(F.col("corpus_idx").alias("doc_id"), F.explode(annotate.find_spans(PACK)("text")).alias("e")).select("doc_id", "e.label", "e.text", "e.start", "e.end")


def overlap_removal(spark, d):
    wide = {"A": [r"\S+ \S*[0-9]{3,}\S*"], "B": [r"[0-9]{3,}\S* \S+", r"[0-9]+"]}
    kept = annotate.without_overlaps(annotate.find_spans(wide)("text"))
    return chunks(spark, d).select(F.col("corpus_idx").alias("doc_id"), F.explode(kept).alias("e")).select("doc_id", "e.label", "e.start", "e.end")


def annotate_score(spark, d):
    return annotate.candidates(chunks(spark, d), None, PACK).select(F.col("chunk_id").cast("long").alias("doc_id"), F.size("entities").cast("long").alias("n"), F.col("auto_score").cast("long").alias("auto_score"))


def annotate_topk(spark, d):
    return annotate.best(annotate.candidates(chunks(spark, d), None, PACK)).select("chunk_id", "source_file", F.col("auto_score").cast("long").alias("auto_score"))


def export_incremental(spark, d):
    known = annotate.candidates(chunks(spark, d), None, PACK).join(_t(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id")), "id", "left_semi")
    return annotate.export(chunks(spark, d), known, pack=PACK).select("chunk_id", F.col("auto_score").cast("long").alias("auto_score"), "src")


def annotate_counters(spark, d):
    known = _t(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id"))
    return annotate.counters(chunks(spark, d), known, PACK)


def finalize_entities(spark, d):
    rows = annotate.finalize(annotate.candidates(chunks(spark, d), None, PACK))
    return rows.select(F.col("chunk_id").cast("long").alias("doc_id"), F.size("entities").cast("long").alias("n_left"), F.col("removed").cast("long").alias("removed"))


def train_dev_split(spark, d):
    return annotate.split(annotate.candidates(chunks(spark, d), None, PACK)).select("id", "split")


def bio_align(spark, d):
    rows = annotate.align(annotate.candidates(chunks(spark, d), None, PACK), most=1 << 20)
    return rows.select(F.col("id").cast("long").alias("doc_id"), F.posexplode("labels").alias("i", "label"))


def bio_align_subword(spark, d):
    """Labels of the pieces of a byte-level vocabulary."""
    import public_tokenizers

    pieces = SubwordTokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = annotate.align(annotate.candidates(chunks(spark, d), None, PACK), pieces, 1 << 20)
    return rows.select(F.col("id").cast("long").alias("doc_id"), F.posexplode(F.arrays_zip("input_ids", "labels")).alias("i", "x")).select("doc_id", "i", "x.input_ids", "x.labels").toDF("doc_id", "i", "token_id", "label")


def label_vocabulary(spark, d):
    """Every label with its number and how many tokens of the aligned records have it."""
    given = bio_align(spark, d).groupBy(F.col("label").alias("label_id")).agg(F.count(F.lit(1)).alias("n"))
    return annotate.label_vocabulary(spark).join(given, "label_id", "left").select("label_id", "label", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def span_scores(spark, d):
    found = annotate_spans(spark, d).withColumnRenamed("doc_id", "id")
    s = annotate.span_scores(found, found.filter("label = 'NORM_DOC'"))
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


def _trained(spark, d):
    """The annotated records, their split, and a tagger trained on the train rows."""
    folder = scratch(ready(spark), "aligned")
    annotate.candidates(chunks(spark, d), None, PACK).write.parquet(f"{folder}/records")
    records = spark.read.parquet(f"{folder}/records")
    annotate.align(records, most=1 << 20).select("id", "text", "labels").write.parquet(f"{folder}/aligned")
    aligned = spark.read.parquet(f"{folder}/aligned")
    split = annotate.split(records).select("id", "split")
    return records, split, Trainer().fit(aligned.join(split, "id"))


def tagger_predictions(spark, d):
    """What a trained tagger finds in every document, without bad entities."""
    found = annotate.predictions(chunks(spark, d), _trained(spark, d)[2], "corpus_idx").select("id", F.explode("predicted_entities").alias("e"))
    return found.select(F.col("id").cast("long").alias("doc_id"), "e.label", "e.text", "e.start", "e.end", F.round("e.score", 4).alias("score"))


def tagger_scores(spark, d):
    """Precision, recall and F1 of the trained tagger on the dev records, which it was not trained on."""
    records, split, model = _trained(spark, d)
    dev = records.join(split.filter("split = 'dev'").select("id"), "id")
    spans = lambda ents: dev.select("id", F.explode(ents).alias("e")).select("id", "e.label", "e.start", "e.end")
    s = annotate.span_scores(spans("entities"), spans(tag_column(model, "text")))
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


def _turns(spark, d):
    return _t(spark, d, "conversations").select("conv_id", F.col("turn").cast("int").alias("rank"), F.col("role").alias("source_file"), F.col("turn").alias("page_num"), F.concat_ws("_", "conv_id", "turn").alias("chunk_id"), "text")


def format_context(spark, d):
    return generate.contexts(_turns(spark, d), "conv_id").select("conv_id", "context")


def source_list(spark, d):
    return generate.contexts(_turns(spark, d), "conv_id").select("conv_id", F.array_join(F.transform("sources", lambda s: F.concat_ws(",", s["source_file"], s["page_num"], s["chunk_id"])), "|").alias("sources"))


def hit_preview(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.preview("text").alias("preview"))


def select_records(spark, d):
    return entities.select_records(chunks(spark, d), "corpus_idx", source="SRC1", text="LICENSED").select("chunk_id", "source_file")


def html_extract(spark, d):
    return _t(spark, d, "pages").select("page_id", html_column("html").alias("text"))


def pair_rerank(spark, d):
    hits = _settled(spark, _bm25(spark, d), "hits").withColumnRenamed("bm25_rank", "candidate_rank").join(questions(spark, d), "question_id").join(chunks(spark, d).select("corpus_idx", "text"), "corpus_idx")
    return fusion.pair_rerank(hits, OverlapScorer(), 5).select("question_id", F.col("corpus_idx").alias("doc_id"), F.round("reranker_score", 6).alias("score"), F.col("final_rank").alias("rank"))


def pair_hybrid(spark, d):
    """Fused candidates by the pair model (J6); questions and chunks without a text have no pair."""
    texts = chunks(spark, d).select(F.col("corpus_idx").alias("chunk_id"), "text")
    hits = _settled(spark, _fused(spark, d, 20), "hits").join(questions(spark, d), "question_id").join(texts, "chunk_id")
    return fusion.pair_rerank(hits, OverlapScorer(), 6).select("question_id", "chunk_id", F.round("reranker_score", 6).alias("score"), F.col("final_rank").alias("rank"))


def _ranked(spark, d):
    """Held-out questions' candidates by a pair model that is trained on the others, their questions and relevant chunks.
    Questions are every third word of a passage; relevant are the documents that hold the whole passage."""
    docs, folder = chunks(spark, d), scratch(ready(spark), "ranked")
    counted = latent.counted(docs.select("corpus_idx", "text"))
    model = latent.fit(counted)
    latent.vectors(counted, model).write.parquet(f"{folder}/vectors")
    bm25 = lexical.write_index(docs, f"{folder}/index")
    passages = questions(spark, d)
    relevant = _holders(passages, _t(spark, d, "documents")).groupBy("question_id").agg(F.collect_set(F.col("doc_id").cast("string")).alias("relevant_chunk_ids"))
    relevant.write.parquet(f"{folder}/relevant")
    third = F.array_join(F.filter(F.split("question", r"\s+"), lambda w, i: i % 3 == 0), " ")
    asked = passages.select("question_id", third.alias("question"), (F.pmod(F.xxhash64("question_id"), F.lit(2)) == 0).alias("held_out"))
    # Training and asking read the same entities, which are found once.
    entities.build_index(_predictions(spark, d)).write.parquet(f"{folder}/entities")
    engine = RetrievalEngine(docs, spark.read.parquet(f"{folder}/vectors"), spark.read.parquet(f"{folder}/entities"), model, bm25=bm25, pack=FLAT)
    relevant = spark.read.parquet(f"{folder}/relevant")
    # One pass over the chunks finds the candidates of all questions; each question's are its own.
    engine.described(asked, dense_k=50, bm25_k=50, most=50).write.parquet(f"{folder}/described")
    described = spark.read.parquet(f"{folder}/described")
    held = asked.filter("held_out")
    engine.learn(described.join(asked.filter("not held_out").select("question_id"), "question_id", "left_semi"), relevant)
    hits = engine.scorer.rerank(described.join(held.select("question_id"), "question_id", "left_semi"), 50)
    hits.write.parquet(f"{folder}/hits")
    return held, relevant, spark.read.parquet(f"{folder}/hits")


def pair_trained(spark, d):
    """The best chunks of held-out questions by the trained pair model."""
    return _ranked(spark, d)[2].filter(F.col("final_rank") <= K).select("question_id", F.col("corpus_idx").alias("doc_id"), F.round("reranker_score", 4).alias("score"), F.col("final_rank").alias("rank"))


def pair_trained_scores(spark, d):
    """Mean metrics of held-out questions in the fused order and in the trained model's."""
    asked, relevant, hits = _ranked(spark, d)
    means = None
    for name, rank in (("hybrid", "candidate_rank"), ("hybrid_reranked", "final_rank")):
        run = hits.select("question_id", "chunk_id", F.col(rank).alias("rank")).filter(F.col("rank") <= K)
        own = metrics.mean(metrics.per_question(run, asked, relevant, K_VALUES, K, K)).select(F.lit(name).alias("pipeline"), "metric", F.round("value", 6).alias("value"))
        means = own if means is None else means.unionByName(own)
    return means


def _said(system: str, user: str, temperature: float, most: int) -> str:
    """A stand-in chat model that tells what it was given."""
    return f"T={temperature} N={most} {len(system)} {len(user)}"


def answers(spark, d):
    """A batch of questions answered from their contexts (L3)."""
    asked = generate.contexts(_turns(spark, d), "conv_id").withColumn("question", F.concat(F.lit("Question "), F.col("conv_id")))
    return asked.select("conv_id", generate.answer_column(_said).alias("answer"))


def embed_hash(spark, d):
    e = questions(spark, d).select("question_id", embed_column(HashEmbedder(), "question").alias("v"))
    return e.select("question_id", F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"))


def latent_topk(spark, d):
    """Text in, hits out: documents and questions embedded by a model that is learned from the documents (V1, V2, V6)."""
    counted, folder = latent.counted(chunks(spark, d).select("corpus_idx", "text")), scratch(ready(spark), "vectors")
    model = latent.fit(counted)
    latent.vectors(counted, model).write.parquet(folder)
    asked = questions(spark, d).select("question_id", embed_column(model, "question").alias("embedding"))
    return dense.topk(spark.read.parquet(folder), asked, K).select("question_id", F.col("corpus_idx").alias("doc_id"), F.round("dense_score", 4).alias("score"), F.col("dense_rank").alias("rank"))


NAMES = (
    text_clean, tokenize, bm25_index_stats, bm25_topk, knn_topk, rrf_hybrid, hybrid_single_side, entity_extract, entity_normalize, entity_clean, entity_index,
    entity_overlap_score, knn_entity_rerank, hybrid_entity_rerank, metrics_per_question, metrics_mean, metrics_delta, metrics_wide, run_records, run_items, chunk_text,
    page_split, paragraph_split, semantic_blocks, chunk_table, chunk_ids, annotate_spans, overlap_removal, annotate_score, annotate_topk, export_incremental,
    annotate_counters, finalize_entities, train_dev_split, bio_align, bio_align_subword, label_vocabulary, span_scores, tagger_predictions, tagger_scores, format_context, source_list, hit_preview, select_records,
    html_extract, pair_rerank, pair_hybrid, pair_trained, pair_trained_scores, answers, embed_hash, latent_topk, knn_cells,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in NAMES} | references.queries() | files.queries()
