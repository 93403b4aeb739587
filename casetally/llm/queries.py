"""One query for each operator of this package, applied to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html, mixing, pii, prefixtrie, quality, rmqsearch, sharding, simhash, suffix, tokens, topk, toxicity
from .common import table


def op1_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"))


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents"))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op5_html(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(table(spark, folder, "pages"))


def op6_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, folder, "documents"))


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op9_suffix(spark: SparkSession, folder: str) -> DataFrame:
    removed = suffix.remove_repeats(table(spark, folder, "documents"))
    return removed.withColumn("repeated", F.col("n_removed") > 0)


def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(pii.find(table(spark, folder, "documents")))


def op11_search(spark: SparkSession, folder: str) -> DataFrame:
    return rmqsearch.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_table(table(spark, folder, "documents"))


def op13_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefixtrie.trie(table(spark, folder, "conversations")).drop("k1", "k2")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_topk,
        op2_quality,
        op3_toxicity,
        op4_decontaminate,
        op5_html,
        op6_tokens,
        op7_mixing,
        op8_simhash,
        op9_suffix,
        op10_pii,
        op11_search,
        op12_sharding,
        op13_trie,
    )
}
