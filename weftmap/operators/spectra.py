"""Row correlation, leading eigenvector, compartments, saddle and checkerboard."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.tables import written
from ..model import bins_of, symmetric
from .bands import observed_over_expected
from .blocks import coarsen, entropy_score, histogram, order_statistic


def row_correlation(contact: DataFrame, n: int) -> DataFrame:
    """(i, j, v), i <= j: Pearson correlation of rows over all n columns, absent cells as 0.

    Products of rows come block by block; means come from row sums, so absent cells need no
    rows.  A row without variance correlates 0 with others, 1 with itself.
    """
    s = symmetric(contact).where("v <> 0")
    row = s.groupBy("i").agg((F.sum("v") / n).alias("m"), (F.sum(F.col("v") * F.col("v")) / n).alias("q"))
    row = row.select("i", "m", F.sqrt(F.greatest(F.lit(0.0), F.col("q") - F.col("m") * F.col("m"))).alias("sd"))
    gram = row_products(s, n).withColumn("xy", F.col("xy") / n)
    idx = contact.sparkSession.range(n).select(F.col("id").cast("int").alias("p"))
    full = idx.join(row, F.col("p") == F.col("i"), "left").select("p", F.coalesce("m", F.lit(0.0)).alias("m"), F.coalesce("sd", F.lit(0.0)).alias("sd"))
    # all pairs of rows are the result itself: n is the matrix side
    l = full.select(F.col("p").alias("i"), F.col("m").alias("mi"), F.col("sd").alias("si"), F.explode(F.sequence("p", F.lit(n - 1))).alias("j"))
    r = full.select(F.col("p").alias("j"), F.col("m").alias("mj"), F.col("sd").alias("sj"))
    pairs = l.join(r, "j").join(gram, ["i", "j"], "left")
    sd = F.col("si") * F.col("sj")
    c = (F.coalesce("xy", F.lit(0.0)) - F.col("mi") * F.col("mj")) / F.when(sd > 1e-12, sd)
    return pairs.select("i", "j", F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.coalesce(c, F.lit(0.0))).alias("v"))


def row_products(cells: DataFrame, n: int, block: int = 256, columns: int = 8192) -> DataFrame:
    """(i, j, xy), i < j: sums of products of rows i and j of a symmetric matrix given as all of its cells.

    Rows are cut into blocks and columns into stripes; a task multiplies two blocks of ``block`` rows by
    ``columns`` columns, whatever n is, and the products of all stripes are summed.  A cell is sent to as
    many pairs of blocks as there are blocks, not to every row.
    """
    blocks, wide = -(-n // block), min(n, columns)
    own = cells.select(F.floor(F.col("i") / block).cast("int").alias("own"), F.floor(F.col("j") / wide).cast("int").alias("stripe"), "i", "j", "v")
    left = own.select(F.col("own").alias("p"), F.explode(F.sequence("own", F.lit(blocks - 1))).alias("q"), "stripe", F.lit(0).alias("side"), "i", "j", "v")
    right = own.select(F.explode(F.sequence(F.lit(0), "own")).alias("p"), F.col("own").alias("q"), "stripe", F.lit(1).alias("side"), "i", "j", "v")

    def multiplied(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for k, first in enumerate(key[:2]):
            m, own = np.zeros((block, wide)), rows[rows["side"] == k]
            m[own["i"].to_numpy() - first * block, own["j"].to_numpy() - key[2] * wide] = own["v"].to_numpy()
            sides.append(m)
        g = sides[0] @ sides[1].T
        i, j = np.nonzero(g)
        i, j, xy = i + key[0] * block, j + key[1] * block, g[i, j]
        return pd.DataFrame({"i": i, "j": j, "xy": xy})[i < j]

    parts = left.unionByName(right).groupBy("p", "q", "stripe").applyInPandas(multiplied, "i int, j int, xy double")
    return parts if wide == n else parts.groupBy("i", "j").agg(F.sum("xy").alias("xy"))


def power_iteration(matrix: DataFrame, n: int, rounds: int = 100, tolerance: float = 1e-6, check_every: int = 5) -> DataFrame:
    """(p, x, value): leading eigenvector from alternating signs, of length 1, and its eigenvalue's size.

    A round is one join of the cells with the vector and one grouping; the norm is a one-row
    aggregate that joins back.
    """
    cells = written(symmetric(matrix).where("v <> 0").select("i", "j", "v"), "cells")
    x = matrix.sparkSession.range(n).select(F.col("id").cast("int").alias("p"), (F.when(F.col("id") % 2 == 0, 1.0).otherwise(-1.0) / float(n) ** 0.5).alias("x"))
    for k in range(rounds):
        y = cells.join(x.select(F.col("p").alias("j"), "x"), "j").groupBy(F.col("i").alias("p")).agg(F.sum(F.col("v") * F.col("x")).alias("y"))
        norm = F.sqrt(F.sum(F.col("y") * F.col("y")).over(W.Window.partitionBy()))  # n rows: a vector
        y = x.join(y, "p", "left").select("p", F.col("x").alias("old"), F.coalesce("y", F.lit(0.0)).alias("y"))
        x = y.select("p", (F.col("y") / F.when(norm > 1e-12, norm)).alias("x"), "old", norm.alias("value"))
        if (k + 1) % check_every == 0 or k + 1 == rounds:
            x = written(x, "vector")
            gap = x.agg(F.sqrt(F.sum((F.col("x") - F.col("old")) ** 2))).first()[0]
            if gap is None or gap < tolerance:
                break
        x = x.select("p", "x", "value")
    return x.select("p", F.coalesce("x", F.lit(0.0)).alias("x"), "value")


def compartments(contact: DataFrame, n: int, size: int = 4, rounds: int = 100) -> DataFrame:
    """(p, e1, norm, eigenvalue): leading eigenvector of the correlation of observed / expected.

    The map is coarsened first (unless few bins are left); a map without correlated structure
    gives e1 0 and norm 0.5 throughout.  The sign makes the first non-zero entry positive.
    """
    b = size if n / size >= 16 else 1
    m = -(-n // b)
    oe = observed_over_expected(coarsen(contact, n, b), m).select("i", "j", F.col("oe").alias("v"))
    cor = written(row_correlation(oe, m), "correlation")
    flat = (cor.where("i < j").agg(F.max(F.abs("v"))).first()[0] or 0.0) < 1e-9
    idx = contact.sparkSession.range(n).select(F.col("id").cast("int").alias("p"))
    if flat:
        return idx.select("p", F.lit(0.0).alias("e1"), F.lit(0.5).alias("norm"), F.lit(0.0).alias("eigenvalue"))
    x = power_iteration(cor, m, rounds)
    whole = W.Window.partitionBy()
    first = F.min_by("x", F.when(F.abs("x") > 1e-9, F.col("p"))).over(whole)
    x = x.select(F.col("p").alias("b"), (F.col("x") * F.when(first < 0, -1.0).otherwise(1.0)).alias("e1"), F.col("value").alias("eigenvalue"))
    out = idx.withColumn("b", F.floor(F.col("p") / b).cast("int")).join(x, "b").select("p", "e1", "eigenvalue")
    top = F.max(F.abs("e1")).over(whole)
    return out.select("p", "e1", ((F.coalesce(F.col("e1") / F.when(top > 0, top), F.lit(0.0)) + 1) / 2).alias("norm"), "eigenvalue")


def oriented(track: DataFrame, gc: DataFrame) -> DataFrame:
    """Flips a track (p, e1) if its positive bins hold less GC (p, gc) than its negative ones."""
    j = track.join(gc, "p", "left")
    g = j.agg(F.avg(F.when(F.col("e1") > 0, F.col("gc"))).alias("a"), F.avg(F.when(F.col("e1") < 0, F.col("gc"))).alias("b"))
    flip = F.coalesce(F.col("a") < F.col("b"), F.lit(False))
    return track.crossJoin(F.broadcast(g)).select("p", F.when(flip, -F.col("e1")).otherwise(F.col("e1")).alias("e1"), flip.alias("flipped"))  # one row


def saddle(contact: DataFrame, track: DataFrame, n: int, bins: int = 20, apart: int = 3) -> DataFrame:
    """(a, b, mean, cells): mean ratio by the track's value classes at both ends, both triangles.

    Classes are equal widths between the 2.5 % and 97.5 % order statistics.
    """
    low = order_statistic(track, "value", 0.025).withColumnRenamed("value", "low")
    high = order_statistic(track, "value", 0.975, True).withColumnRenamed("value", "high")
    span = F.col("high") - F.col("low")
    k = F.when(span > 0, F.floor((F.col("value") - F.col("low")) / F.when(span > 0, span) * bins)).otherwise(F.lit(0))
    digit = track.crossJoin(F.broadcast(low)).crossJoin(F.broadcast(high)).select("p", F.least(F.lit(bins - 1), F.greatest(F.lit(0), k)).cast("int").alias("q"))  # one row each
    oe = observed_over_expected(contact, n).where((F.col("j") >= F.col("i") + apart) & (F.col("oe") > 0))
    c = oe.join(digit.select(F.col("p").alias("i"), F.col("q").alias("a")), "i").join(digit.select(F.col("p").alias("j"), F.col("q").alias("b")), "j")
    both = c.select("a", "b", "oe").unionByName(c.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "oe"))
    return both.groupBy("a", "b").agg(F.avg("oe").alias("mean"), F.count(F.lit(1)).cast("long").alias("cells"))


def saddle_strength(table: DataFrame, bins: int = 20) -> DataFrame:
    """One row: (AA + BB) / (2 AB) of the corners, and whether a corner has under 2 cells."""
    c = max(1, bins // 5)
    lo, hi = lambda x: F.col(x) < c, lambda x: F.col(x) >= bins - c
    corner = lambda cond: F.avg(F.when(cond & (F.col("mean") > 0), F.col("mean")))
    few = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("cells"))), F.lit(0)) < 2
    aa, bb, ab = hi("a") & hi("b"), lo("a") & lo("b"), (lo("a") & hi("b")) | (hi("a") & lo("b"))
    g = table.agg(corner(aa).alias("aa"), corner(bb).alias("bb"), corner(ab).alias("ab"), (few(aa) | few(bb) | few(ab)).alias("underpopulated"))
    return g.withColumn("strength", (F.col("aa") + F.col("bb")) / (2 * F.when(F.col("ab") > 0, F.col("ab"))))


def checkerboard(contact: DataFrame, ranges: DataFrame, min_size: int = 5, min_samples: int = 10, bins: int = 30) -> DataFrame:
    """(order_index, samples, entropy, score): cosine distances of a segment's rows at middle distances."""
    s = ranges.withColumn("w", F.col("end_bin") - F.col("start_bin")).where(F.col("w") >= min_size)
    low = F.greatest(F.lit(1), F.floor(F.lit(0.05) * F.col("w") + 0.5).cast("int"))
    s = s.withColumn("low", low).withColumn("high", F.greatest(F.col("low") + 1, F.floor(F.lit(0.15) * F.col("w") + 0.5).cast("int")))
    own = bins_of(s, "low", "high")
    c = symmetric(contact).where("v <> 0").join(own.select(F.col("bin").alias("i"), "order_index", "end_bin", "start_bin", "low", "high"), "i").where("j >= start_bin and j < end_bin")
    rows = c.select("order_index", "low", "high", "i", F.col("j").alias("k"), "v")
    norm = rows.groupBy("order_index", "i").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    b = rows.select("order_index", F.col("i").alias("j"), "k", F.col("v").alias("y"))
    dots = rows.join(b, ["order_index", "k"]).where("j - i >= low and j - i < high").groupBy("order_index", "i", "j").agg(F.sum(F.col("v") * F.col("y")).alias("dot"))
    at = own.select("order_index", F.col("bin").alias("i"), F.explode(F.sequence(F.col("bin") + F.col("low"), F.col("bin") + F.col("high") - 1)).alias("j"), "end_bin").where("j < end_bin")
    d = at.join(norm, ["order_index", "i"]).join(norm.withColumnsRenamed({"i": "j", "norm": "norm2"}), ["order_index", "j"]).join(dots, ["order_index", "i", "j"], "left")
    dist = d.select("order_index", F.least(F.lit(2.0), F.greatest(F.lit(0.0), 1 - F.coalesce("dot", F.lit(0.0)) / (F.col("norm") * F.col("norm2")))).alias("x"))
    k = F.least(F.lit(bins - 1), F.floor(F.col("x") / 1.6 * bins)).cast("int")
    counts = dist.groupBy("order_index", k.alias("b")).agg(F.count(F.lit(1)).alias("c"))
    total = F.sum("c").over(W.Window.partitionBy("order_index"))
    q = F.col("c") / F.col("n")
    g = counts.withColumn("n", total).where(F.col("n") >= min_samples).groupBy("order_index", F.col("n").cast("long").alias("samples")).agg((-F.sum(q * F.log(q))).alias("entropy"))
    return g.withColumn("score", F.col("entropy") / F.log(F.lit(float(bins))) * 100)


def nearest_landmark(scores: DataFrame, panel: DataFrame, low: float = 2.3, high: float = 3.0) -> DataFrame:
    """Adds the panel entry (label, entropy) of nearest entropy, and the place in the panel's range in percent.

    The panel is a short published table; rows meet all of its entries.
    """
    near = F.broadcast(panel.select("label", F.col("entropy").alias("at")).agg(F.collect_list(F.struct("at", "label")).alias("panel")))
    gaps = F.array_min(F.transform("panel", lambda x: F.struct(F.abs(x["at"] - F.col("entropy")).alias("gap"), x["label"].alias("label"))))
    place = F.least(F.lit(100.0), F.greatest(F.lit(0.0), (F.col("entropy") - low) / (high - low) * 100))
    return scores.crossJoin(near).withColumn("nearest", gaps["label"]).withColumn("place", place).drop("panel")


def viewpoint(contact: DataFrame, n: int, at: int) -> DataFrame:
    """(p, v, oe, norm): one row of the map, as ratio, and log-scaled to 0..1 for display."""
    oe = observed_over_expected(contact, n)
    rows = oe.where((F.col("i") == at) | (F.col("j") == at)).select(F.when(F.col("i") == at, F.col("j")).otherwise(F.col("i")).alias("p"), "v", "oe")
    idx = contact.sparkSession.range(n).select(F.col("id").cast("int").alias("p"))
    full = idx.join(rows, "p", "left").select("p", F.coalesce("v", F.lit(0.0)).alias("v"), F.coalesce("oe", F.lit(0.0)).alias("oe"))
    whole = W.Window.partitionBy()
    low = F.min(F.when(F.col("oe") > 0, F.col("oe"))).over(whole)
    full = full.withColumn("l", F.log2(F.greatest("oe", low)))
    a, b = F.min("l").over(whole), F.max("l").over(whole)
    norm = F.when(low.isNull(), F.lit(0.0)).when(b > a, (F.col("l") - a) / F.when(b > a, b - a)).otherwise(F.lit(0.5))
    return full.select("p", "v", "oe", norm.alias("norm"))


__all__ = ["checkerboard", "compartments", "entropy_score", "histogram", "nearest_landmark", "oriented", "power_iteration", "row_correlation", "saddle", "saddle_strength", "viewpoint"]
