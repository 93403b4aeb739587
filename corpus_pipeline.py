"""A corpus pipeline of five stages: toxicity, near-duplicates, benchmark leaks, mixing, token output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casetally.llm import decontaminate, mixing, simhash, tokens, toxicity
from casetally.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; labels of the given documents are learned from.

    Null and empty texts have the score of the bias alone. Without usable labels, and without documents, all stay.
    """
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least doc_id.

    Null and empty texts are near-duplicates of each other. Repeated rows are one group. Rows without doc_id stay.
    """
    return simhash.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item; null and empty texts hold none, and without items all stay."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a null source is one of its own, a null or empty text adds no words."""
    return mixing.mixed(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the token files hold: doc_id, start, n_tokens and ids_crc32 of each document.

    A null or empty text has the end id alone. A document that the mix takes twice is there twice.
    """
    return tokens.encode_corpus(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token_output", write_token_ids),
]

#: Trained weights and tokenizers are beyond SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again.

    No documents give no rows. Other columns are carried along up to the last stage.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
