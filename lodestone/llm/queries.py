"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import table


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The key of the queries where the session names none; a key for tests, not for use.
TEST_KEY = "test key of the queries"


def secret_key(spark: SparkSession) -> str:
    return spark.conf.get("spark.lodestone.pii.key", TEST_KEY)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.quality import classify, train

    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, table(spark, sf_dir, "labels")))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.substring import remove_repeated

    return remove_repeated(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.wordpiece import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op5_token_id_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.grammar import encode_and_read

    return encode_and_read(table(spark, sf_dir, "documents"), vocabulary())


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.lm import learn_and_score

    return learn_and_score(table(spark, sf_dir, "documents"))


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.common import only
    from lodestone.llm.pii import pseudonymise

    return pseudonymise(only(table(spark, sf_dir, "documents"), "doc_id", "text"), secret_key(spark))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.common import only
    from lodestone.llm.rules import MEASURES, judge

    return judge(only(table(spark, sf_dir, "documents"), "doc_id", "text")).select("row.doc_id", *MEASURES, "base_failed", "kept")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.jaccard import link_documents

    return link_documents(table(spark, sf_dir, "documents"))


def op11_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.simhash import link_documents

    return link_documents(table(spark, sf_dir, "documents"))


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.alignment import align

    return align(table(spark, sf_dir, "documents"), vocabulary(), vocabulary("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_quality_classifier, op3_substring_dedup, op4_token_counts, op5_token_id_grammar, op6_benchmark_decontamination, op7_lm_scores, op8_pii_pseudonyms, op9_quality_rules, op10_jaccard_join, op11_simhash_near_duplicates, op12_cross_tokenizer_alignment)}


def oracle_sql() -> dict[str, str]:
    from lodestone.llm.rules import rules_sql

    return {"op9_quality_rules": rules_sql()}
