"""A training-corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; the next stage works on that, written as Parquet and read
again. All but the last return the columns of documents.

Every stage takes texts of any length whole, gives no rows for an empty table, and keeps the values of other columns, whatever their
names. What it does with nulls, ties and repeated rows stands at the stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diskloom.llm import decontam, langid, linededup, neardup, packing
from diskloom.llm.common import materialize, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told; those without letters (null and empty texts too), or with a doubtful language, go.

    Languages that tie give a doubtful one of two at most; repeated rows are judged alike; rows with a null id are judged, not learned from.
    """
    return langid.accept(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts cross-site boilerplate lines from all documents but the first that holds each; documents left with no word go.

    Null texts and rows with a null id stay as they are; the smallest id keeps a line; repeated rows are edited alike.
    """
    found = linededup.judge(docs)
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    edited = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))}
    return found.where(~F.coalesce(emptied, F.lit(False))).select(*[edited.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: five-word shingles, similarity of 0.8 or more.

    The smallest id of a group stays, and of rows that repeat it one; rows without words or with a null id stay.
    """
    return neardup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item. Null and empty texts contain none; repeated rows share their fate."""
    return decontam.remove(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences: one row for each piece. A null text is empty; repeated rows are packed each."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]
#: SQL can't express the fitted language model or tokenising; a brute-force version stands in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
