"""Maps and tracks from formulas; noise is a hash of the cell, so they are the same every time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W


def unit_hash(*parts: Column) -> Column:
    """Number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) / float(1 << 30)


def contact_map(spark: SparkSession, n: int = 1024, chromosomes: int = 12, noise: float = 0.1) -> DataFrame:
    """Distance decay, nested domains and alternating compartments; cells are the product of the axes."""
    cells = spark.range(n * n).select((F.col("id") / n).cast("int").alias("i"), (F.col("id") % n).cast("int").alias("j")).where("i <= j")
    size = n / chromosomes
    d = F.col("j") - F.col("i")
    same = F.floor(F.col("i") / size) == F.floor(F.col("j") / size)
    v = F.when(same, 1.0 / F.sqrt(d + 1.0)).otherwise(F.lit(0.01))
    for k, gain in ((8, 0.3), (24, 0.15)):
        v = v + F.when(F.floor(F.col("i") / k) == F.floor(F.col("j") / k), F.lit(gain)).otherwise(0.0)
    v = v + F.when(same & (F.floor(F.col("i") / 16) % 2 == F.floor(F.col("j") / 16) % 2), 0.05).otherwise(0.0)
    v = v * (1 + noise * (unit_hash(F.col("i"), F.col("j")) - 0.5))
    return cells.select("i", "j", F.least(F.lit(1.0), v).alias("v"))


def misassembled(contact: DataFrame, n: int) -> DataFrame:
    """(i, j, v) of both triangles, rows 30-35 % reversed and 60-65 % swapped with 80-85 %; not symmetric any more."""
    a, b, c, e, w = int(n * 0.30), int(n * 0.35), int(n * 0.60), int(n * 0.80), int(n * 0.05)
    i = F.col("i")
    to = F.when((i >= a) & (i < b), a + b - 1 - i).when((i >= c) & (i < c + w), i - c + e).when((i >= e) & (i < e + w), i - e + c).otherwise(i)
    both = contact.unionByName(contact.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    return both.select(to.cast("int").alias("i"), "j", "v")


def smooth_track(spark: SparkSession, n: int, seed: int, radius: int) -> DataFrame:
    """(p, value): noise, three box blurs whose divisor stays the full width at the ends, scaled to 0..1."""
    t = spark.range(n).select(F.col("id").cast("int").alias("p"), unit_hash(F.col("id"), F.lit(seed)).alias("value"))
    near = W.Window.orderBy("p").rowsBetween(-radius, radius)
    for _ in range(3):
        t = t.select("p", (F.sum("value").over(near) / (2 * radius + 1)).alias("value"))
    whole = W.Window.partitionBy()
    lo, hi = F.min("value").over(whole), F.max("value").over(whole)
    return t.select("p", F.when(hi > lo, (F.col("value") - lo) / F.when(hi > lo, hi - lo)).otherwise(F.lit(0.0)).alias("value"))


def marker_track(spark: SparkSession, n: int, seed: int, share: float) -> DataFrame:
    """(p, value): marks of width max(1, n / 2000) at hashed places."""
    width = max(1, n // 2000)
    at = spark.range(n).where(unit_hash(F.col("id"), F.lit(seed)) < share)
    marks = at.select(F.explode(F.sequence(F.col("id"), F.least(F.lit(n - 1), F.col("id") + width - 1))).alias("p")).distinct().withColumn("m", F.lit(1.0))
    idx = spark.range(n).select(F.col("id").alias("p"))
    return idx.join(marks, "p", "left").select(F.col("p").cast("int").alias("p"), F.coalesce("m", F.lit(0.0)).alias("value"))
