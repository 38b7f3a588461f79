"""The registered queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), capacity=2048, vocabulary="word_bpe_49k.json", closing=0)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_join

    return ngram_join(table(spark, sf_dir, "documents"), n=3, threshold=0.5)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup_digest

    return line_dedup_digest(table(spark, sf_dir, "documents"), least_chars=20, least_docs=3)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_index import FingerprintIndex, substring_dedup

    # three batches: the third comes after the runs of the first two are compacted
    return substring_dedup(table(spark, sf_dir, "documents"), window=20, batches=3, index=FingerprintIndex(spark, window=20, fanout=2))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import TEMPLATE, format_digest

    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return format_digest(conversations.unionByName(planted), TEMPLATE)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filters import RULES, url_filters

    return url_filters(table(spark, sf_dir, "pages").select("page_id", "url"), RULES, default="allow").drop("url")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents"), window=100)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), keep_text=False)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    return decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), window=13, per_hit=20).drop("text", "hits", "items")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_ngram_jaccard_join,
        op3_line_dedup,
        op4_substring_dedup,
        op5_chat_formatting,
        op6_url_filters,
        op7_quality_classifier,
        op8_suffix_array_dedup,
        op9_quality_rules,
        op10_benchmark_decontamination,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": oracles.LINE_DEDUP,
    "op4_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op5_chat_formatting": oracles.CHAT_FORMATTING,
    "op6_url_filters": oracles.URL_FILTERS,
    "op8_suffix_array_dedup": oracles.SUFFIX_DEDUP,
    "op10_benchmark_decontamination": oracles.DECONTAMINATION,
}
