"""Matrix balancing.  The matrix stays as it is; rounds move a bias vector of n rows only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import written
from ..model import symmetric
from .blocks import order_statistic

MASK_SHARE = 0.02


def finite(contact: DataFrame) -> DataFrame:
    """Cells that are not finite numbers become 0."""
    v = F.col("v")
    bad = F.isnan(v) | (F.abs(v) == float("inf"))
    return contact.withColumn("v", F.when(v.isNull() | bad, F.lit(0.0)).otherwise(v))


def masked_bins(contact: DataFrame, n: int, share: float = MASK_SHARE) -> DataFrame:
    """(p): bins whose row sum is at most the order statistic at ``share``; a uniform map masks all."""
    sums = symmetric(contact).groupBy(F.col("i").alias("p")).agg(F.sum("v").alias("total"))
    every = contact.sparkSession.range(n).select(F.col("id").cast("int").alias("p")).join(sums, "p", "left").select("p", F.coalesce("total", F.lit(0.0)).alias("total"))
    limit = order_statistic(every, "total", share).withColumnRenamed("value", "limit")
    return every.crossJoin(F.broadcast(limit)).where("total <= limit").select("p")  # one row


def balance(contact: DataFrame, n: int, rounds: int = 50, tolerance: float = 1e-4, mask: bool = True, check_every: int = 5) -> DataFrame:
    """(p, bias): v / (bias_i bias_j) has equal row sums.  Masked bins keep bias 1.

    A round is b <- b * sqrt(row sum of v / (b b)): one join of the cells with the bias on
    each axis and one grouping by row.  Every few rounds the bias is written and the largest
    distance of a row sum from 1 decides whether to go on.
    """
    cells = symmetric(finite(contact)).where("v <> 0")
    if mask:
        out = masked_bins(finite(contact), n)
        cells = cells.join(out.withColumnRenamed("p", "i"), "i", "left_anti").join(out.withColumnRenamed("p", "j"), "j", "left_anti")
    cells = written(cells.select("i", "j", "v"), "cells")
    live = cells.select(F.col("i").alias("p")).distinct()
    bias = live.withColumn("bias", F.lit(1.0))
    for k in range(rounds):
        at = lambda name, out: bias.select(F.col("p").alias(name), F.col("bias").alias(out))
        sums = cells.join(at("i", "bi"), "i").join(at("j", "bj"), "j").groupBy("i").agg(F.sum(F.col("v") / (F.col("bi") * F.col("bj"))).alias("s"))
        bias = bias.join(sums, F.col("p") == F.col("i")).select("p", (F.col("bias") * F.sqrt("s")).alias("bias"), F.abs(F.col("s") - 1).alias("off"))
        if (k + 1) % check_every == 0 or k + 1 == rounds:
            bias = written(bias, "bias")
            if tolerance > 0 and (bias.agg(F.max("off")).first()[0] or 0.0) < tolerance:
                break
        bias = bias.select("p", "bias")
    every = contact.sparkSession.range(n).select(F.col("id").cast("int").alias("p"))
    return every.join(bias.select("p", "bias"), "p", "left").select("p", F.coalesce("bias", F.lit(1.0)).alias("bias"))


def balanced(contact: DataFrame, bias: DataFrame) -> DataFrame:
    """Cells divided by both biases."""
    at = lambda name, out: bias.select(F.col("p").alias(name), F.col("bias").alias(out))
    return contact.join(at("i", "bi"), "i").join(at("j", "bj"), "j").select("i", "j", (F.col("v") / (F.col("bi") * F.col("bj"))).alias("v"))
