"""The registered queries opN_<name> over whole tables, and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from diskloom.llm import decontam, langid, linededup, neardup, packing, perplexity, secrets, shards, sql, urlfilter, warc
from diskloom.llm.common import table


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("row.doc_id", "n_lines", "n_removed", "text")


def op3_qgram_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_label_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(table(spark, sf_dir, "documents"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.judge(table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.concat_ws(",", F.col("matched").cast("array<string>")).alias("matched"))


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.rules(table(spark, sf_dir, "documents"))


def op7_fast_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components(table(spark, sf_dir, "documents"))


def op8_secret_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op9_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_langid, op2_line_spread, op3_qgram_decontam, op4_label_shards, op5_url_rules, op6_kneser_ney, op7_fast_minhash, op8_secret_tests, op9_swap_packing, op10_warc_writer)
}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLE_SQL: dict[str, str] = {"op2_line_spread": sql.op2(), "op5_url_rules": sql.op5(), "op8_secret_tests": sql.op8()}
