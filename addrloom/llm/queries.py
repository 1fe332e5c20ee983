"""The registered queries of the training-data operators, with their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from addrloom.llm.chat_format import op11_chat_format
from addrloom.llm.divergence import OP13_SQL, op13_divergence
from addrloom.llm.filter_audit import OP12_SQL, op12_filter_audit
from addrloom.llm.jpeg_media import op3_jpeg
from addrloom.llm.langid import op8_language_id
from addrloom.llm.line_dedup import OP2_SQL, op2_line_dedup
from addrloom.llm.mixing import OP4_SQL, op4_mix
from addrloom.llm.quality import op9_quality
from addrloom.llm.simhash import op5_simhash
from addrloom.llm.sp_codec import op7_sentencepiece
from addrloom.llm.token_store import op10_token_store
from addrloom.llm.url_filter import OP6_SQL, op6_url_filter
from addrloom.llm.warc import op1_warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


QUERIES = {
    "op1_warc": lambda spark, d: op1_warc(spark, _pages(spark, d)),
    "op2_line_dedup": lambda spark, d: op2_line_dedup(_documents(spark, d)),
    "op3_jpeg": lambda spark, d: op3_jpeg(_documents(spark, d)),
    "op4_mix": lambda spark, d: op4_mix(_documents(spark, d)),
    "op5_simhash": lambda spark, d: op5_simhash(_documents(spark, d)),
    "op6_url_filter": lambda spark, d: op6_url_filter(spark, _pages(spark, d)),
    "op7_sentencepiece": lambda spark, d: op7_sentencepiece(_documents(spark, d)),
    "op8_language_id": lambda spark, d: op8_language_id(_documents(spark, d)),
    "op9_quality": lambda spark, d: op9_quality(_documents(spark, d)),
    "op10_token_store": lambda spark, d: op10_token_store(spark, _documents(spark, d)),
    "op11_chat_format": lambda spark, d: op11_chat_format(spark, spark.read.parquet(f"{d}/conversations.parquet")),
    "op12_filter_audit": lambda spark, d: op12_filter_audit(_documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")),
    "op13_divergence": lambda spark, d: op13_divergence(_documents(spark, d)),
}
SQL = {"op2_line_dedup": OP2_SQL, "op4_mix": OP4_SQL, "op6_url_filter": OP6_SQL, "op12_filter_audit": OP12_SQL, "op13_divergence": OP13_SQL}
