"""The corpus pipeline: quality rules, near-duplicates, mix, packing.

Every stage takes what its predecessor kept and writes nothing itself; ``run`` writes each
stage's rows as Parquet into the shared folder and reads them back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftmap.llm import mixing, neardup, packing, quality
from weftmap.llm.common import saved, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base rules or diverge from their language."""
    return quality.filter_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class."""
    return neardup.keep_first(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources meet their target weights."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the stream of tokens into sequences; one row a piece."""
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("mix", source_mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)


#: MinHash classes and draws can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
