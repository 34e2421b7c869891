"""Helpers shared by the corpus operators: written tables, word splitting, column names."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import dropped as drop_saved
from ..functions.tables import shared_dir
from ..functions.tables import written as saved

__all__ = ["SPACES", "WORD", "arrow_rows", "drop_saved", "positional", "restored", "saved", "shared_dir", "shuffle_partitions", "table", "text_or_empty", "words_of"]

#: A word is a run of anything but the space and the code points 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for a null, empty or blank one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES, -1), lambda w: w != "")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def positional(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """``docs`` under names by place, which no helper column can clash with, and the new names of some."""
    columns = docs.columns
    return docs.toDF(*[f"in{k}" for k in range(len(columns))]), [f"in{columns.index(n)}" for n in names]


def restored(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, under their own names."""
    return df.select(*[F.col(f"in{k}").alias(c) for k, c in enumerate(docs.columns)])


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """At most so many rows in one Arrow batch, for jobs that run inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
