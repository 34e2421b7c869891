"""Sweeps over settings of the automatic order: one run of the chaining rounds serves all settings."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.tables import dropped, written
from ..operators import links, metrics


class Setting(NamedTuple):
    """How far from the corner links are scored, the least score of a link, and the cap of the threshold."""

    max_distance: int = links.MAX_DISTANCE
    cutoff: float = links.MIN_SCORE
    hard: float = 0.2


def grid(max_distances: tuple[int, ...] = (30, 50, 80), cutoffs: tuple[float, ...] = (0.03, 0.05, 0.1), hards: tuple[float, ...] = (0.1, 0.2, 0.3)) -> list[Setting]:
    return [Setting(d, c, h) for d in max_distances for c in cutoffs for h in hards]


def orders(contact: DataFrame, ranges: DataFrame, n: int, settings: list[Setting]) -> DataFrame:
    """(setting, new_index, order_index, inverted, chain): the automatic order under each setting, numbered from 0.

    Links are scored once for each distance.  A setting's segments get numbers of their own, so the rounds of
    chaining and merging run once over the links of all settings; a setting that has settled has
    no open links any more and costs nothing.
    """
    spark = contact.sparkSession
    contact = written(contact, "map")
    scored = [links.best_links(links.link_scores(contact, ranges, n, d), 0.0).withColumn("max_distance", F.lit(d)) for d in sorted({s.max_distance for s in settings})]
    every = written(reduce(DataFrame.unionByName, scored), "links")
    table = F.broadcast(spark.createDataFrame([(k, *s) for k, s in enumerate(settings)], "setting int, max_distance int, cutoff double, hard double"))  # the list of settings
    own = every.join(table, "max_distance").where("score >= cutoff")
    count = (ranges.agg(F.max("order_index")).first()[0] or 0) + 1
    number = lambda c: (F.col("setting").cast("long") * count + F.col(c)).alias(c)
    limits = links.group_thresholds(own, "setting", cap=1.0)
    limited = written(own.join(limits, "setting").select("setting", number("a"), number("b"), "orientation", "score", F.least("threshold", "hard").alias("threshold")), "links")
    segments = written(ranges.select("order_index").crossJoin(table.select("setting")).select("setting", number("order_index")), "segments")  # one copy a setting
    taken = links.chains(limited.where("score >= threshold"), segments, 0.0)
    chained = links.merged_chains(taken, limited.where(F.col("score") >= F.greatest(F.lit(links.MIN_SCORE), 0.3 * F.col("threshold"))), 0.0)
    size = F.count(F.lit(1)).over(W.Window.partitionBy("chain"))
    placed = chained.withColumn("size", size).withColumn("setting", F.floor(F.col("order_index") / count).cast("int"))
    rank = F.row_number().over(W.Window.partitionBy("setting").orderBy(F.col("size").desc(), "chain", "pos")) - 1
    out = written(placed.select("setting", rank.alias("new_index"), (F.col("order_index") % count).cast("int").alias("order_index"), "inverted", (F.col("chain") % count).cast("int").alias("chain")), "orders")
    dropped(contact, every, limited, segments)
    return out


def scores(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(setting, items, tau, ari, orientation, chains, score) of orders against the truth.

    ``truth`` (order_index, place, chromosome, inverted).  The score weighs rank correlation 0.3, agreement of chains with
    chromosomes (adjusted Rand) 0.2 and orientation 0.1, out of 0.6.
    """
    j = written(found.join(truth.select("order_index", "place", "chromosome", F.col("inverted").alias("turned")), "order_index"), "judged")
    tau = metrics.kendall_tau(j.select("setting", F.col("new_index").alias("pos"), F.col("place").cast("long").alias("truth")), "setting")
    rand = metrics.adjusted_rand(j.select("setting", F.col("chain").alias("pred"), F.col("chromosome").alias("truth")), "setting")
    right = j.groupBy("setting").agg(F.avg((F.col("inverted") == F.col("turned")).cast("int")).alias("orientation"), F.countDistinct("chain").alias("chains"))
    all_ = tau.join(rand, "setting").join(right, "setting")
    return all_.select("setting", "items", "tau", "ari", "orientation", "chains", ((0.3 * F.col("tau") + 0.2 * F.col("ari") + 0.1 * F.col("orientation")) / 0.6).alias("score"))
