"""The operators of this folder as queries over the given tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from daybook.llm import decontaminate, fertility, language, linejoin, minmax, mixing, pages, secrets, sharding, simhash, spans, spelling, whitening


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_fertility_rule(spark: SparkSession, folder: str) -> DataFrame:
    return fertility.fertility_rule(_documents(spark, folder))


def op2_string_kernel_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    return language.identify(docs, language.fit(docs))


def op3_line_edit_join(spark: SparkSession, folder: str) -> DataFrame:
    return linejoin.join_lines(_documents(spark, folder))


def op4_guess_cost_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.find_secrets(_documents(spark, folder))


def op5_low_discrepancy_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_documents(spark, folder)).drop("source")


def op6_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, folder))


def op7_rendezvous_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.place(_documents(spark, folder))


def op8_page_text(spark: SparkSession, folder: str) -> DataFrame:
    return pages.extract_pages(spark.read.parquet(f"{folder}/pages.parquet"))


def op9_sentence_span_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return spans.drop_repeats(_documents(spark, folder))


def op10_suffix_array_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.check_documents(_documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(_documents(spark, folder))


def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{folder}/embeddings.parquet"))


def op13_minmax_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minmax.near_duplicates(_documents(spark, folder))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_fertility_rule, op2_string_kernel_language, op3_line_edit_join, op4_guess_cost_secrets, op5_low_discrepancy_mix,
        op6_simhash_near_dedup, op7_rendezvous_shards, op8_page_text, op9_sentence_span_dedup, op10_suffix_array_decontamination,
        op11_spelling_variants, op12_embedding_whitening, op13_minmax_near_dedup,
    )
}

ORACLES: dict[str, str] = {
    "op3_line_edit_join": linejoin.ORACLE.strip(),
    "op5_low_discrepancy_mix": mixing.ORACLE.strip(),
    "op7_rendezvous_shards": sharding.ORACLE.strip(),
    "op10_suffix_array_decontamination": decontaminate.ORACLE.strip(),
    "op11_spelling_variants": spelling.ORACLE.strip(),
}
