"""Contexts, sources and answers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.models import ChatClient

RULE = "\n\n" + "=" * 80 + "\n\n"
TEMPERATURE, MOST_TOKENS = 0.1, 600
# The instructions of a grounded answer in Russian.
SYSTEM = "Ты помощник по нормативно-технической документации. Отвечай только на основе переданного контекста. Если в контексте недостаточно данных, так и скажи. Ничего не придумывай от себя. Отвечай по-русски, понятно и по делу."
USER = "Контекст:\n{context}\n\nВопрос:\n{question}\n\nСформируй ответ в таком формате:\n1. Краткий ответ.\n2. Какие источники использованы (укажи file и page, если они есть в контексте).\n3. Если вопрос слишком широкий, скажи об этом и предложи уточнить формулировку.\n"


def _or(c: str, default: str | Column) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(default) if isinstance(default, str) else default)


# The template of a context's sources.
def contexts(hits: DataFrame, group: str = "question_id") -> DataFrame:
    """hits: group, rank, source_file, page_num, chunk_id, text -> group, context, sources (L1, L2). A group has at most k hits."""
    block = F.concat(
        F.lit("[SOURCE "), F.col("rank"), F.lit("]\nfile: "), _or("source_file", "unknown_file"), F.lit("\npage: "), _or("page_num", "unknown_page"),
        F.lit("\nchunk_id: "), _or("chunk_id", F.concat(F.lit("chunk_"), F.col("rank"))), F.lit("\ntext:\n"), F.coalesce("text", F.lit("")),
    )
    source = F.struct(_or("source_file", "unknown_file").alias("source_file"), _or("page_num", "unknown_page").alias("page_num"), _or("chunk_id", "unknown_chunk").alias("chunk_id"))
    rows = hits.select(group, F.struct("rank", block.alias("block"), source.alias("source")).alias("h")).groupBy(group).agg(F.array_sort(F.collect_list("h")).alias("h"))
    return rows.select(group, F.concat(F.lit("\n\n"), F.array_join("h.block", RULE)).alias("context"), F.col("h.source").alias("sources"))


def ask(chat: ChatClient, question: str, context: str) -> str:
    """A grounded answer (L3)."""
    return chat(SYSTEM, USER.format(context=context, question=question), TEMPERATURE, MOST_TOKENS)


def answer_column(chat: ChatClient, question: str = "question", context: str = "context") -> Column:
    """The answers to a table of questions with their contexts (L3); an empty question has none."""

    @F.pandas_udf("string")
    def run(questions: pd.Series, contexts: pd.Series) -> pd.Series:
        return pd.Series([ask(chat, q.strip(), c or "") if q and q.strip() else None for q, c in zip(questions, contexts)], index=questions.index, dtype=object)

    return run(F.col(question), F.col(context))
