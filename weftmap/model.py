"""Data model: contact tables in coordinate form, ordered segments, and their coordinates.

``contact(i, j, v)`` holds the upper triangle (i <= j) of a symmetric matrix of ``n`` bins;
cells without a row are 0.  ``ranges(order_index, name, length, scaffold_id, start_bin,
end_bin)`` places the segments, in display order, on the bins.  "No valid value" is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def half_up(x: Column) -> Column:
    """Rounds halves up, also below 0."""
    return F.floor(x + 0.5).cast("int")


def symmetric(contact: DataFrame) -> DataFrame:
    """Both triangles; the diagonal once."""
    return contact.unionByName(contact.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))


def contact_from_groups(rows: DataFrame, key: str, bin: str) -> DataFrame:
    """Pairs of rows of one key, counted by their bins.

    Bins are counted for each key before the join, so a key of many rows joins its distinct
    bins and not its rows; the weights give the same sums.
    """
    counted = rows.groupBy(key, bin).agg(F.count(F.lit(1)).alias("c"))
    a = counted.select(key, F.col(bin).alias("i"), F.col("c").alias("a"))
    b = counted.select(key, F.col(bin).alias("j"), F.col("c").alias("b"))
    return a.join(b, key).where("i <= j").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).cast("double").alias("v"))


def place(segments: DataFrame, n: int) -> DataFrame:
    """Adds start_bin and end_bin: rounded running sums of length over the order, scaled to n bins."""
    upto = W.Window.orderBy("order_index").rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    total = F.sum("length").over(W.Window.partitionBy())
    acc = F.sum("length").over(upto)
    return segments.withColumn("start_bin", half_up((acc - F.col("length")) * float(n) / total)).withColumn("end_bin", half_up(acc * float(n) / total))


def bins_of(ranges: DataFrame, *carry: str) -> DataFrame:
    """One row a bin: the equi-join side that stands for point-in-interval lookups."""
    inside = ranges.where("end_bin > start_bin")
    return inside.select(F.explode(F.sequence("start_bin", F.col("end_bin") - 1)).alias("bin"), "order_index", "start_bin", "end_bin", *carry)


def owned(contact: DataFrame, ranges: DataFrame, *carry: str) -> DataFrame:
    """Cells with the segments of both ends (a_..., b_...); ranges are metadata-sized."""
    bins = bins_of(ranges, *carry)
    side = lambda p: bins.select(F.col("bin").alias(f"{p}_bin"), *[F.col(c).alias(f"{p}_{c}") for c in ("order_index", "start_bin", "end_bin", *carry)])
    a, b = side("a"), side("b")
    return contact.join(a, F.col("i") == F.col("a_bin")).join(b, F.col("j") == F.col("b_bin")).drop("a_bin", "b_bin")


def all_bins(contact: DataFrame, n: int) -> DataFrame:
    return contact.sparkSession.range(n).select(F.col("id").cast("int").alias("p"))
