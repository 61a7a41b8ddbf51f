"""Queries of the text operators and their SQL."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.common import table
from tidemill.llm import duplicates, leakage, lookalike, overlap, tokenize, toxicity


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """A vocabulary file: in the folder TIDEMILL_TOKENIZERS names, else with the installed public tokenizers."""
    folder = os.environ.get("TIDEMILL_TOKENIZERS")
    if not folder:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, name)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.same_look_pairs(table(spark, folder, "task2_train"))


def p1_forms(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.canonical(table(spark, folder, "task2_train").select("id", "text")).select("id", "form")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return duplicates.formatted_copies(table(spark, folder, "task2_train"), table(spark, folder, "task2_raw"))


def p4_counts(spark: SparkSession, folder: str) -> DataFrame:
    return duplicates.copy_counts(table(spark, folder, "task2_train"), table(spark, folder, "task2_raw"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.near_pairs(table(spark, folder, "task2_train"))


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.overlap_report(table(spark, folder, "task2_train"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenize.encode(table(spark, folder, "documents").select("doc_id", "text"), tokenizer_path(), keep=["doc_id"])


def p6_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, same): whether decoding gives each text back, nulls as the empty text."""
    coded = tokenize.encode(table(spark, folder, "documents").select("doc_id", "text"), tokenizer_path())
    back = tokenize.decode(coded, tokenizer_path(), "ids", "back")
    return back.select("doc_id", (F.coalesce("text", F.lit("")) == F.col("back")).alias("same"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leak_report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.flagged(table(spark, folder, "documents"), table(spark, folder, "labels"))


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scored(table(spark, folder, "documents"), table(spark, folder, "labels")).select("doc_id", "score")


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.source_rates(table(spark, folder, "documents"), table(spark, folder, "labels"))


QUERIES = {f.__name__: f for f in (p1_found, p1_forms, p4_found, p4_counts, p5_found, p5_report, p6_ids, p6_round_trip, p7_found, p7_report, p8_found, p8_scores, p8_rates)}

SQL = {
    "p6_round_trip": "SELECT doc_id, true AS same FROM documents",
}
