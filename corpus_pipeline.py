"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, substring dedup, best-fit packing.

Every stage works on all rows that the stage before kept, and every stage but the last returns the columns it got. The
last one gives the pieces of the packed training sequences. The operators' docstrings state how nulls, empty and very
long texts, ties, repeated rows, empty tables and extra columns are treated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from checkloom.llm import line_dedup, ngram_join, packing, quality_rules, substring_dedup
from checkloom.llm.common import cut


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or the threshold table go."""
    return quality_rules.keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go."""
    return line_dedup.drop_lines(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by shingles the one with the least doc_id stays: five words, 0.8 or more."""
    return ngram_join.keep_representatives(docs, shingle=5, percent=80)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages of 35 words or more that repeat anywhere go."""
    return substring_dedup.remove_repeats(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("best_fit_packing", packing_stage),
]

#: Packing is a search that SQL does not express; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`, each written as Parquet in the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
