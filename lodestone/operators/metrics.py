"""Ranking metrics over runs: one grouped pass for every metric and k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_k_values(raw: str) -> list[int]:
    """'10, 1,3' -> [1, 3, 10]."""
    values = sorted({int(x) for x in raw.split(",") if x.strip()})
    if not values:
        raise ValueError("k values are empty")
    return values


def load_questions(raw: DataFrame) -> DataFrame:
    """question_id, question as text; a row without either is an error."""
    return raw.select(*_required(raw, "question_id", ("question_id", "id")), *_required(raw, "question", ("question",)))


def load_qrels(raw: DataFrame, order: str | None = None) -> DataFrame:
    """question_id and its distinct relevant_chunk_ids; of equal ids the last in the order holds."""
    lists = [F.col(c) for c in ("relevant_chunk_ids", "relevant_chunks", "chunk_ids") if c in raw.columns]
    ids = F.transform(F.coalesce(*lists, F.array().cast("array<string>")), lambda x: x.cast("string"))
    held = raw.select(*_required(raw, "question_id", ("question_id", "id")), F.array_sort(F.array_distinct(ids)).alias("relevant_chunk_ids"), (F.col(order) if order else F.monotonically_increasing_id()).alias("_o"))
    return held.groupBy("question_id").agg(F.max_by("relevant_chunk_ids", "_o").alias("relevant_chunk_ids"))


def _required(raw: DataFrame, name: str, from_: tuple[str, ...]) -> list[Column]:
    given = [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in from_ if c in raw.columns]
    value = F.coalesce(*given) if given else F.lit(None).cast("string")
    return [F.coalesce(value, F.raise_error(F.lit(f"a row has no {name}")).cast("string")).alias(name)]


def per_question(run: DataFrame, questions: DataFrame, qrels: DataFrame, k_values: list[int], mrr_k: int = 10, ndcg_k: int = 10) -> DataFrame:
    """run: question_id, chunk_id, rank -> question_id, metric, value of every question.
    A question without relevant chunks has 0 everywhere, one without hits too."""
    wanted = qrels.select("question_id", F.explode("relevant_chunk_ids").alias("chunk_id"), F.lit(True).alias("_rel"))
    sizes = questions.select("question_id").join(qrels.select("question_id", F.size("relevant_chunk_ids").alias("n_rel")), "question_id", "left").select("question_id", F.coalesce("n_rel", F.lit(0)).alias("n_rel"))
    found = run.join(wanted, ["question_id", "chunk_id"], "left").filter("_rel")
    ks = sorted({*k_values, mrr_k, ndcg_k})
    sums = [F.count(F.when(F.col("rank") <= k, 1)).alias(f"c{k}") for k in ks]
    sums += [F.min(F.when(F.col("rank") <= mrr_k, F.col("rank"))).alias("first"), F.sum(F.when(F.col("rank") <= ndcg_k, 1 / F.log2(F.col("rank") + 1))).alias("dcg")]
    all_ = sizes.join(found.groupBy("question_id").agg(*sums), "question_id", "left")
    c = lambda k: F.coalesce(F.col(f"c{k}"), F.lit(0))
    none = F.lit(0.0)
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_rel", F.lit(ndcg_k))), none, lambda a, r: a + 1 / F.log2(r + 1))
    values: dict[str, Column] = {}
    for k in k_values:
        values[f"hit@{k}"] = F.when(c(k) > 0, 1.0).otherwise(none)
        values[f"recall@{k}"] = F.when(F.col("n_rel") > 0, c(k) / F.col("n_rel")).otherwise(none)
        values[f"precision@{k}"] = c(k) / F.lit(k) if k > 0 else none
    values[f"mrr@{mrr_k}"] = F.coalesce(1 / F.col("first"), none)
    values[f"ndcg@{ndcg_k}"] = F.when(F.col("n_rel") > 0, F.coalesce(F.col("dcg"), none) / F.when(F.col("n_rel") > 0, ideal)).otherwise(none)
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), v.cast("double").alias("value")) for n, v in values.items()])
    return all_.select("question_id", F.explode(pairs).alias("_p")).select("question_id", "_p.metric", "_p.value")


def as_map(rows: DataFrame) -> DataFrame:
    """question_id, metrics: a map of name to value."""
    return rows.groupBy("question_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("metrics"))


def mean(rows: DataFrame) -> DataFrame:
    """metric, value: means over questions (M8)."""
    return rows.groupBy("metric").agg(F.avg("value").alias("value"))


def delta(base: DataFrame, improved: DataFrame) -> DataFrame:
    """metric, value: improved less base over all names, a missing one as 0 (M9)."""
    a, b = base.select("metric", F.col("value").alias("_a")), improved.select("metric", F.col("value").alias("_b"))
    return a.join(b, "metric", "full").select("metric", (F.coalesce("_b", F.lit(0.0)) - F.coalesce("_a", F.lit(0.0))).alias("value"))


def run_records(hits: DataFrame, pipeline: str, fields: list[str]) -> DataFrame:
    """question_id, question, pipeline, ranked_chunks in rank order (M12, M13). A question has at most k hits."""
    item = F.struct("rank", *[f for f in fields if f != "rank"])
    return hits.groupBy("question_id", "question").agg(F.array_sort(F.collect_list(item)).alias("ranked_chunks")).select("question_id", "question", F.lit(pipeline).alias("pipeline"), "ranked_chunks")


#: Fields of a run item and the columns of hits they come from, the first that is there and not null (M12): the score is
#: the entity reranker's, else the fused one; a hit without a final rank has its rank.
RUN_FIELDS = {
    "rank": ("rank", "final_rank"), "chunk_id": ("chunk_id",), "source_file": ("source_file",), "page_num": ("page_num",), "chunk_type": ("chunk_type",), "score": ("ner_score_total", "hybrid_score"),
    "dense_rank": ("dense_rank",), "bm25_rank": ("bm25_rank",), "hybrid_score": ("hybrid_score",), "ner_score_total": ("ner_score_total",), "final_rank": ("final_rank", "rank"),
    "ner_score": ("ner_score",), "ner_overlap": ("ner_overlap",), "query_entities": ("query_entities",),
}
_KINDS = {"chunk_id": "string", "source_file": "string", "chunk_type": "string", "score": "double", "hybrid_score": "double", "ner_score_total": "double", "ner_score": "double", "ner_overlap": "array<string>", "query_entities": "array<string>"}


def run_items(hits: DataFrame, pipeline: str) -> DataFrame:
    """Run records whose items have every field of RUN_FIELDS, of one type for all pipelines; what hits lack is null."""
    given = lambda names: [F.col(n) for n in names if n in hits.columns] or [F.lit(None)]
    items = [F.coalesce(*given(names)).cast(_KINDS.get(field, "int")).alias(field) for field, names in RUN_FIELDS.items()]
    return run_records(hits.select("question_id", "question", *items), pipeline, list(RUN_FIELDS))


def ranked_ids(records: DataFrame) -> DataFrame:
    """question_id, rank, chunk_id of run records; items without an id are skipped."""
    ids = F.filter(F.transform("ranked_chunks", lambda x: x["chunk_id"].cast("string")), lambda x: x.isNotNull())
    return records.select("question_id", F.posexplode(ids).alias("p", "chunk_id")).select("question_id", (F.col("p") + 1).alias("rank"), "chunk_id")


def wide(means: DataFrame, names: list[str]) -> DataFrame:
    """pipeline and one column a metric, names in order (S15). means: pipeline, metric, value."""
    return means.groupBy("pipeline").pivot("metric", sorted(names)).agg(F.first("value"))
