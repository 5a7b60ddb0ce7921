"""The retrieval engine: all questions at once through dense and lexical retrieval, fusion and entity reranking."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.models import ChatClient, Embedder, EntityTagger, PairScorer, embed_column
from lodestone.operators import dense, entities, fusion, generate, lexical, metrics
from lodestone.operators import ranker as pairs


@dataclass
class RetrievalEngine:
    """chunks: chunk_id, corpus_idx, source_file, page_num, chunk_type, text; vectors: corpus_idx, embedding."""

    chunks: DataFrame
    vectors: DataFrame
    entity_index: DataFrame
    embedder: Embedder | None = None
    scorer: PairScorer | pairs.Ranker | None = None
    tagger: EntityTagger | None = None
    chat: ChatClient | None = None
    bm25: lexical.Index | None = None
    pack: list[str] = field(default_factory=lambda: entities.P.QUERY_ENTITIES)

    def __post_init__(self):
        self.spark: SparkSession = self.chunks.sparkSession
        self.bm25 = self.bm25 or lexical.build_index(self.chunks)

    def questions(self, rows: list[tuple[str, str]]) -> DataFrame:
        return self.embedded(self.spark.createDataFrame(rows, "question_id string, question string"))

    def embedded(self, questions: DataFrame) -> DataFrame:
        return questions if "embedding" in questions.columns or not self.embedder else questions.withColumn("embedding", embed_column(self.embedder, "question"))

    def candidates(self, questions: DataFrame, dense_k: int = 100, bm25_k: int = 100, rrf_k: int = 60, most: int = 100, scores: bool = False) -> DataFrame:
        """Fused candidates; bm25_k <= 0 leaves the lexical side out."""
        ids = self.chunks.select("corpus_idx", "chunk_id")
        near = dense.topk(self.vectors, questions, dense_k).join(ids, "corpus_idx")
        words = lexical.topk(self.bm25, questions, bm25_k).join(ids, "corpus_idx")
        return fusion.rrf(near, words, rrf_k, most, scores)

    def _full(self, hits: DataFrame, pipeline: str) -> DataFrame:
        return hits.drop("corpus_idx").join(self.chunks.select("chunk_id", "corpus_idx", "source_file", "page_num", "chunk_type", "text"), "chunk_id").withColumn("retrieval_pipeline", F.lit(pipeline))

    def _with_entities(self, hits: DataFrame, questions: DataFrame, use_model: bool = False) -> DataFrame:
        asked = entities.asked("question", self.pack, self.tagger if use_model else None)
        return entities.chunk_entities(hits, self.entity_index).join(questions.select("question_id", asked.alias("query_entities")), "question_id")

    def dense(self, questions: DataFrame, k: int = 10) -> DataFrame:
        """V7."""
        near = dense.topk(self.vectors, self.embedded(questions), k).join(self.chunks.select("corpus_idx", "chunk_id"), "corpus_idx")
        return self._full(near.withColumn("final_rank", F.col("dense_rank")), "dense")

    def dense_entities(self, questions: DataFrame, k: int = 10, candidates_k: int = 50, weight: float = 0.5, use_model: bool = False) -> DataFrame:
        """V8: base is 1 / rank."""
        near = dense.topk(self.vectors, self.embedded(questions), candidates_k).join(self.chunks.select("corpus_idx", "chunk_id"), "corpus_idx").withColumnRenamed("dense_rank", "candidate_rank")
        return self._full(entities.rerank(self._with_entities(near, questions, use_model), k, weight), "dense_entities")

    def hybrid(self, questions: DataFrame, k: int = 10, dense_k: int = 100, bm25_k: int = 100, rrf_k: int = 60) -> DataFrame:
        """J7."""
        found = self.candidates(self.embedded(questions), dense_k, bm25_k, rrf_k, k)
        return self._full(found.withColumn("final_rank", F.col("candidate_rank")), "hybrid")

    def hybrid_entities(self, questions: DataFrame, k: int = 10, candidates_k: int = 100, dense_k: int = 100, bm25_k: int = 100, rrf_k: int = 60, weight: float = 0.5, use_model: bool = False) -> DataFrame:
        """Base is the fused score."""
        found = self.candidates(self.embedded(questions), dense_k, bm25_k, rrf_k, candidates_k)
        return self._full(entities.rerank(self._with_entities(found, questions, use_model), k, weight, "hybrid_score"), "hybrid_entities")

    def hybrid_reranked(self, questions: DataFrame, k: int = 6, dense_k: int = 20, bm25_k: int = 20, rrf_k: int = 60, most: int = 20) -> DataFrame:
        """Fused candidates by a pair model."""
        if not self.scorer:
            raise ValueError("this pipeline needs a pair scorer")
        if isinstance(self.scorer, pairs.Ranker):
            return self.scorer.rerank(self.described(questions, dense_k, bm25_k, rrf_k, most), k)
        found = self._full(self.candidates(self.embedded(questions), dense_k, bm25_k, rrf_k, most), "hybrid_reranked").join(questions.select("question_id", "question"), "question_id")
        return fusion.pair_rerank(found, self.scorer, k)

    def described(self, questions: DataFrame, dense_k: int = 20, bm25_k: int = 20, rrf_k: int = 60, most: int = 20) -> DataFrame:
        """Fused candidates with the features of a trained pair model."""
        found = self._with_entities(self.candidates(self.embedded(questions), dense_k, bm25_k, rrf_k, most, True), questions)
        common, share = entities.overlap(F.col("query_entities"), F.col("chunk_entities"))
        full = self._full(found.withColumn("ner_overlap", common).withColumn("ner_score", share), "hybrid_reranked")
        return pairs.features(full.join(questions.select("question_id", "question"), "question_id"), rrf_k)

    def train_scorer(self, questions: DataFrame, qrels: DataFrame, dense_k: int = 20, bm25_k: int = 20, rrf_k: int = 60, most: int = 20) -> pairs.Ranker:
        """Learns the pair model of hybrid_reranked from questions with relevant_chunk_ids."""
        return self.learn(self.described(questions, dense_k, bm25_k, rrf_k, most), qrels)

    def learn(self, described: DataFrame, qrels: DataFrame) -> pairs.Ranker:
        """train_scorer from candidates that are there already."""
        wanted = qrels.select("question_id", F.explode("relevant_chunk_ids").alias("chunk_id")).distinct().withColumn("gain", F.lit(1.0))
        self.scorer = pairs.Trainer().fit(described.join(wanted, ["question_id", "chunk_id"], "left"))
        return self.scorer

    def ask(self, question: str, k: int = 4, dense_k: int = 200, bm25_k: int = 200, candidates_k: int = 200, weight: float = 0.05) -> dict:
        """The answer of the chat model and its sources."""
        if not question or not question.strip():
            raise ValueError("the question is empty")
        hits = self.hybrid_entities(self.questions([("q", question.strip())]), k, candidates_k, dense_k, bm25_k, weight=weight)
        row = generate.contexts(hits.withColumn("rank", F.col("final_rank"))).first()
        context, sources = (row["context"], [s.asDict() for s in row["sources"]]) if row else ("", [])
        return {"answer": generate.ask(self.chat, question, context) if self.chat else None, "context": context, "sources": sources}

    def evaluate(self, questions: DataFrame, qrels: DataFrame, k: int = 10, k_values: str = "1,3,5,10", dense_k: int = 200, bm25_k: int = 200, candidates_k: int = 200, rrf_k: int = 60, weight: float = 0.05, base: str = "hybrid") -> dict[str, DataFrame]:
        """Compares base ('hybrid' or 'dense') with its entity-reranked form (M18): runs, per_question, means, delta, wide, summary.
        The candidates are found once for both."""
        ks = metrics.parse_k_values(k_values)
        asked = self.embedded(questions)
        if base == "hybrid":
            found = self.candidates(asked, dense_k, bm25_k, rrf_k, candidates_k).persist()
            key, plain = "hybrid_score", found.filter(F.col("candidate_rank") <= k)
        else:
            found = dense.topk(self.vectors, asked, candidates_k).join(self.chunks.select("corpus_idx", "chunk_id"), "corpus_idx").withColumnRenamed("dense_rank", "candidate_rank").persist()
            key, plain = None, found.filter(F.col("candidate_rank") <= k)
        better = entities.rerank(self._with_entities(found, questions), k, weight, key)
        names = {base: plain.withColumn("final_rank", F.col("candidate_rank")), f"{base}_entities": better}
        rows, runs = None, None
        for name, hits in names.items():
            full = self._full(hits.withColumn("rank", F.col("final_rank")), name).join(questions.select("question_id", "question"), "question_id")
            record = metrics.run_items(full, name)
            own = metrics.per_question(hits.select("question_id", "chunk_id", F.col("final_rank").alias("rank")), questions, qrels, ks, k, k).withColumn("pipeline", F.lit(name))
            runs = record if runs is None else runs.unionByName(record)
            rows = own if rows is None else rows.unionByName(own)
        means = rows.groupBy("pipeline", "metric").agg(F.avg("value").alias("value"))
        of = lambda n: means.filter(F.col("pipeline") == n)
        gain = metrics.delta(of(base), of(f"{base}_entities"))
        shown = [m for kv in ks for m in (f"hit@{kv}", f"recall@{kv}", f"precision@{kv}")] + [f"mrr@{k}", f"ndcg@{k}"]
        summary = means.groupBy().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws("/", "pipeline", "metric").alias("k"), "value")))).alias("metrics")).select(
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), F.lit(k).alias("k"), F.lit(weight).alias("weight"), F.lit(rrf_k).alias("rrf_k"), "metrics"
        )
        return {"runs": runs, "per_question": rows, "means": means, "delta": gain, "wide": metrics.wide(means, shown), "summary": summary}
