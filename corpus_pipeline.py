"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from addrloom.llm.common import write_table
from addrloom.llm.jaccard import keep_one_similar
from addrloom.llm.langid import keep_known
from addrloom.llm.line_dedup import clean
from addrloom.llm.mixing import mix
from addrloom.llm.sp_codec import round_trip


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or without a clear language."""
    return keep_known(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts cross-site lines out of the texts; n_chars follows the text."""
    return clean(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-copies (5-word Jaccard similarity of 0.8 or more), the one with the smallest doc_id."""
    return keep_one_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents to meet the sources' targets, in training order."""
    return mix(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes each document; a row for each of its uses, with digests of ids and of the decoded text."""
    return round_trip(docs, cache=100_000)  # fewer remembered chunks: memory is what the pipeline is short of


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("simhash_dedup", simhash_dedup), ("mix_sources", mix_sources), ("sentencepiece", sentencepiece)]
#: SimHash, language ID and the encoder have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
