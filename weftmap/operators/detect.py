"""Detectors inside segments: centromeres, misassemblies and cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..model import bins_of, half_up, symmetric
from .metrics import breakpoint_matches
from .windows import strongest_peaks, z_scores


def centromeres(contact: DataFrame, ranges: DataFrame, n: int, min_span: int = 16, prominence: float = 0.5) -> DataFrame:
    """(order_index, p, prominence, confidence) of the strongest peak of each long segment.

    The signal is 0.7 z(contact with other segments) + 0.3 z(anti-diagonal over diagonal),
    smoothed over a tenth of the segment.
    """
    s = ranges.where(F.col("end_bin") - F.col("start_bin") >= min_span).withColumn("w", F.col("end_bin") - F.col("start_bin"))
    own = bins_of(s, "w").withColumnRenamed("bin", "p")
    sym = symmetric(contact)
    rows = own.join(sym, F.col("p") == F.col("i"), "left")
    outside = F.sum(F.when((F.col("j") < F.col("start_bin")) | (F.col("j") >= F.col("end_bin")), F.col("v")))
    reach = F.greatest(F.lit(2), F.floor(F.col("w") * 0.15).cast("int"))
    diag = F.sum(F.when((F.col("j") - F.col("p")).between(1, reach) & (F.col("j") < F.col("end_bin")), F.col("v")))
    sums = rows.groupBy("order_index", "p", "start_bin", "end_bin", "w").agg(F.coalesce(outside, F.lit(0.0)).alias("inter"), F.coalesce(diag, F.lit(0.0)).alias("diag"))
    # the reflected row start + end - p, at the columns after p
    mirror = own.withColumn("m", F.col("start_bin") + F.col("end_bin") - F.col("p")).where("m < end_bin").join(sym, F.col("m") == F.col("i"))
    anti = mirror.where((F.col("j") - F.col("p")).between(1, reach) & (F.col("j") < F.col("end_bin"))).groupBy("order_index", "p").agg(F.sum("v").alias("anti"))
    mean = contact.agg((F.sum(F.when(F.col("i") == F.col("j"), F.col("v")).otherwise(2 * F.col("v"))) / (n * n)).alias("mean"))
    b = sums.join(anti, ["order_index", "p"], "left").withColumn("ratio", F.coalesce(F.col("anti") / F.when(F.col("diag") > 0, F.col("diag")), F.lit(0.0)))
    b = b.crossJoin(F.broadcast(mean)).withColumn("level", F.sum("inter").over(W.Window.partitionBy("order_index")) / (F.col("w") * F.greatest(F.lit(1), n - F.col("w")))).where(F.col("level") >= 0.02 * F.col("mean"))  # one row
    b = b.withColumn("x", 0.7 * z_scores(b, "inter", "order_index") + 0.3 * z_scores(b, "ratio", "order_index"))
    radius = F.greatest(F.lit(1), half_up(F.col("w") * 0.1))
    q = b.select("order_index", F.col("p").alias("q"), F.col("x").alias("y"))
    near = b.select("order_index", "p", radius.alias("r")).join(q, "order_index").where("abs(q - p) <= r")
    g = F.exp(-(F.col("q") - F.col("p")) * (F.col("q") - F.col("p")) / (2 * (F.col("r") / 3) * (F.col("r") / 3)))
    smooth = near.groupBy("order_index", "p").agg((F.sum(g * F.col("y")) / F.sum(g)).alias("s"))
    peaks = strongest_peaks(smooth.withColumn("z", z_scores(smooth, "s", "order_index")), "z", "order_index")
    out = peaks.where(F.col("prominence") >= prominence)
    return out.select("order_index", "p", "prominence", F.least(F.lit(1.0), F.col("prominence") / 3).alias("confidence"))


def misassemblies(domain: DataFrame, track: DataFrame, ranges: DataFrame, margin: int = 2, radius: int = 3, share: float = 0.25, small: int = 10) -> DataFrame:
    """(order_index, p, reason, strength) from domain boundaries (p, strength) and sign changes of a track (p, e1).

    Signals inside a segment count.  One of each kind within ``radius`` merge into one of both
    kinds: pairs that are each other's nearest (ties to the left) merge, one to one.  Short
    segments keep merged signals only.
    """
    w = W.Window.orderBy("p")
    top = F.max(F.abs("e1")).over(W.Window.partitionBy())
    before = F.lag("e1").over(w)
    flips = track.select("p", (F.col("e1") * before < 0).alias("flip"), F.abs(F.col("e1") - before).alias("strength"), top.alias("top")).where("flip").where(F.col("strength") >= share * F.col("top"))
    own = bins_of(ranges.where(F.col("end_bin") - F.col("start_bin") >= 2 * margin + 1)).withColumnRenamed("bin", "p")
    inside = (F.col("p") - F.col("start_bin") >= margin) & (F.col("end_bin") - F.col("p") > margin)
    pick = lambda df, kind: df.join(own, "p").where(inside).select("order_index", "p", "strength", (F.col("end_bin") - F.col("start_bin")).alias("span"), F.lit(kind).alias("kind"))
    a, b = pick(domain, "tad_boundary"), pick(flips, "compartment_switch")
    signal = lambda df, p: df.select(F.col("order_index").alias("grp"), F.col("p").alias(p))
    matched = breakpoint_matches(signal(a, "p"), signal(b, "q"), radius).select(F.col("grp").alias("order_index"), F.col("p").alias("pa"), F.col("q").alias("pb"))
    side = lambda df, p, s: df.select("order_index", F.col("p").alias(p), F.col("strength").alias(s))
    merged = matched.join(side(a, "pa", "sa"), ["order_index", "pa"]).join(side(b, "pb", "sb"), ["order_index", "pb"])
    both = merged.select("order_index", half_up((F.col("pa") + F.col("pb")) / 2).alias("p"), F.lit("both").alias("reason"), (F.col("sa") + F.col("sb")).alias("strength"))
    gone = merged.select("order_index", F.col("pa").alias("p"), F.lit("tad_boundary").alias("kind")).unionByName(merged.select("order_index", F.col("pb").alias("p"), F.lit("compartment_switch").alias("kind")))
    alone = a.unionByName(b).join(gone, ["order_index", "p", "kind"], "left_anti").where(F.col("span") >= small)
    return both.unionByName(alone.select("order_index", "p", F.col("kind").alias("reason"), "strength"))


def cut_suggestions(flags: DataFrame, ranges: DataFrame, track: DataFrame) -> DataFrame:
    """(order_index, offset, confidence, level): where to cut, inside the segment, and how sure.

    Confidence weighs the strength against the strongest flag and the jump of the track at the cut.
    """
    before = F.lag("e1").over(W.Window.orderBy("p"))
    jump = track.select("p", F.coalesce(F.abs(F.col("e1") - before), F.lit(0.0)).alias("jump"))
    span = F.col("end_bin") - F.col("start_bin")
    j = flags.join(ranges.select("order_index", "start_bin", "end_bin"), "order_index").join(jump, "p", "left")
    top = F.max("strength").over(W.Window.partitionBy())
    c = 0.6 * F.coalesce(F.col("strength") / F.when(top > 0, top), F.lit(0.0)) + 0.4 * F.tanh(2 * F.coalesce("jump", F.lit(0.0)))
    out = j.select("order_index", F.greatest(F.lit(1), F.least(span - 1, F.col("p") - F.col("start_bin"))).alias("offset"), c.alias("confidence"))
    return out.withColumn("level", F.when(F.col("confidence") >= 0.7, "high").when(F.col("confidence") >= 0.4, "medium").otherwise("low"))
