"""Neighbourhood operators along the bins: insulation, directionality, density, peaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..model import all_bins, bins_of, symmetric

WINDOW, PROMINENCE = 10, 0.1


def insulation(contact: DataFrame, n: int, window: int = WINDOW, ranges: DataFrame | None = None) -> DataFrame:
    """(p, score): mean of the square between the ``window`` bins before p and those from p on.

    Each cell adds to the few positions whose square holds it, so one pass and one grouping do.
    Without ranges the square is clipped at the ends and an empty one scores 0; with ranges
    a position needs ``window`` bins of its own segment on both sides, else it is NULL.
    """
    w = max(1, min(window, n // 2))
    band = contact.where((F.col("i") < F.col("j")) & (F.col("j") - F.col("i") < 2 * w))
    first, last = F.greatest(F.col("i") + 1, F.col("j") - w + 1), F.least(F.col("j"), F.col("i") + w)
    sums = band.where(first <= last).select(F.explode(F.sequence(first, last)).alias("p"), "v").groupBy("p").agg(F.sum("v").alias("s"))
    at = all_bins(contact, n)
    if ranges is None:
        cells = F.least(F.lit(w), F.col("p")) * F.least(F.lit(w), n - F.col("p"))
        return at.join(sums, "p", "left").select("p", F.when(cells > 0, F.coalesce("s", F.lit(0.0)) / cells).otherwise(F.lit(0.0)).alias("score"))
    own = bins_of(ranges).select(F.col("bin").alias("p"), "start_bin", "end_bin")
    full = (F.col("p") - F.col("start_bin") >= w) & (F.col("end_bin") - F.col("p") >= w)
    return at.join(own, "p", "left").join(sums, "p", "left").select("p", F.when(full, F.coalesce("s", F.lit(0.0)) / (w * w)).alias("score"))


def normalised_insulation(scores: DataFrame) -> DataFrame:
    """(p, score, norm): log2, floored at the least positive score, scaled to 0..1."""
    low = F.min(F.when(F.col("score") > 0, F.col("score"))).over(W.Window.partitionBy())
    logged = scores.withColumn("__log", F.log2(F.when(F.col("score").isNotNull(), F.greatest(F.col("score"), low))))
    whole = W.Window.partitionBy()
    low, high = F.min("__log").over(whole), F.max("__log").over(whole)
    norm = F.when(F.col("score").isNotNull(), F.when(high > low, (F.col("__log") - low) / F.when(high > low, high - low)).otherwise(F.lit(0.0)))
    return logged.withColumn("norm", norm).drop("__log")


def boundaries(scores: DataFrame, value: str = "norm", window: int = WINDOW, prominence: float = PROMINENCE) -> DataFrame:
    """(p, value, strength): strict local minima that stand out from both sides."""
    w = W.Window.orderBy("p")
    v, before, after = F.col(value), F.lag(value).over(w), F.lead(value).over(w)
    left, right = F.max(value).over(w.rowsBetween(-window, -1)), F.max(value).over(w.rowsBetween(1, window))
    out = scores.select("p", v.alias("value"), (F.least(left, right) - v).alias("strength"), ((v < before) & (v < after)).alias("low"))
    return out.where(F.col("low") & (F.col("strength") >= prominence)).drop("low")


def directionality(contact: DataFrame, n: int, window: int = WINDOW, ranges: DataFrame | None = None) -> DataFrame:
    """(p, up, down, di): sums over the ``window`` bins on either side and their signed chi-square."""
    band = contact.where((F.col("j") - F.col("i")).between(1, window))
    # a cell is downstream of its first bin and upstream of its second
    sides = band.select(F.explode(F.array(F.struct(F.col("i").alias("p"), F.lit(0.0).alias("a"), F.col("v").alias("b")), F.struct(F.col("j").alias("p"), F.col("v").alias("a"), F.lit(0.0).alias("b")))).alias("x")).select("x.*")
    sums = sides.groupBy("p").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    at = all_bins(contact, n).join(sums, "p", "left").select("p", F.coalesce("a", F.lit(0.0)).alias("up"), F.coalesce("b", F.lit(0.0)).alias("down"))
    a, b = F.col("up"), F.col("down")
    e = (a + b) / 2
    chi = ((a - e) * (a - e) + (b - e) * (b - e)) / F.when(e > 0, e)
    di = F.coalesce(F.when(b >= a, chi).otherwise(-chi), F.lit(0.0))
    if ranges is None:
        start, end, rows = F.lit(0), F.lit(n), at
    else:
        rows, start, end = at.join(bins_of(ranges).select(F.col("bin").alias("p"), "start_bin", "end_bin"), "p", "left"), F.col("start_bin"), F.col("end_bin")
    inside = (F.col("p") - start >= window) & (end - F.col("p") > window)
    return rows.select("p", "up", "down", F.when(inside, di).alias("di"))


def normalised_directionality(rows: DataFrame) -> DataFrame:
    top = F.max(F.abs("di")).over(W.Window.partitionBy())
    half = F.lit(0.5)
    return rows.select("p", "di", F.when(F.col("di").isNotNull(), F.coalesce(half + F.col("di") / F.when(top > 0, top) * 0.5, half)).alias("norm"))


def directionality_boundaries(rows: DataFrame, threshold: float) -> DataFrame:
    before = F.lag("di").over(W.Window.orderBy("p"))
    out = rows.select("p", "di", before.alias("before"))
    return out.where((F.col("before") < -threshold) & (F.col("di") > threshold)).select("p", (F.col("di") - F.col("before")).alias("strength"))


def diagonal_density(contact: DataFrame, n: int, window: int = 8) -> DataFrame:
    """(p, density): mean of the cells at distances 1..window before and after p, clipped at the ends."""
    band = contact.where((F.col("j") - F.col("i")).between(1, window))
    ends = band.select(F.explode(F.array("i", "j")).alias("p"), "v").groupBy("p").agg(F.sum("v").alias("s"))
    cells = F.least(F.lit(window), n - 1 - F.col("p")) + F.least(F.lit(window), F.col("p"))
    return all_bins(contact, n).join(ends, "p", "left").select("p", F.when(cells > 0, F.coalesce("s", F.lit(0.0)) / cells).otherwise(F.lit(0.0)).alias("density"))


def local_baseline(rows: DataFrame, value: str, reach: int, *by: str) -> DataFrame:
    """Adds base: mean of the positive values within ``reach``; 0 if there is none."""
    near = W.Window.partitionBy(*by).orderBy("p").rowsBetween(-reach, reach)
    return rows.withColumn("base", F.coalesce(F.avg(F.when(F.col(value) > 0, F.col(value))).over(near), F.lit(0.0)))


def low_regions(rows: DataFrame, value: str, drop: float, min_width: int, *by: str) -> DataFrame:
    """Runs of positions that lie more than ``drop`` under their baseline, at least so wide.

    Gaps and islands: p minus its rank among low positions is constant within a run.
    """
    low = rows.where(F.col("base") > 0).where((F.col("base") - F.col(value)) / F.col("base") > drop)
    run = F.col("p") - F.row_number().over(W.Window.partitionBy(*by).orderBy("p"))
    islands = low.withColumn("run", run).groupBy(*by, "run").agg(F.min("p").alias("start"), F.max("p").alias("last"), F.avg(value).alias("mean"))
    wide = islands.where(F.col("last") - F.col("start") + 1 >= min_width).withColumn("middle", F.floor((F.col("start") + F.col("last") + 1) / 2).cast("int"))
    base = rows.select(*by, F.col("p").alias("middle"), F.col("base").alias("base_middle"))
    out = wide.join(base, [*by, "middle"])
    return out.select(*by, "start", "last", "middle", ((F.col("base_middle") - F.col("mean")) / F.when(F.col("base_middle") > 0, F.col("base_middle"))).alias("confidence"))


def gaussian_smooth(rows: DataFrame, value: str, radius: int, *by: str) -> DataFrame:
    """Adds smooth: weights with sigma radius / 3 over the ``2 radius + 1`` rows around, renormalised at ends."""
    sigma = max(radius / 3.0, 1e-9)
    w = W.Window.partitionBy(*by).orderBy("p")
    total, weights = F.lit(0.0), F.lit(0.0)
    for k in range(-radius, radius + 1):
        x = F.lag(value, -k).over(w) if k < 0 else F.lead(value, k).over(w) if k else F.col(value)
        g = F.lit(2.718281828459045 ** (-(k * k) / (2 * sigma * sigma)))
        total, weights = total + F.coalesce(x * g, F.lit(0.0)), weights + F.when(x.isNotNull(), g).otherwise(F.lit(0.0))
    return rows.withColumn("smooth", total / F.when(weights > 0, weights))


def z_scores(rows: DataFrame, value: str, *by: str) -> Column:
    """Population z-score within a group; 0 where all values are equal."""
    w = W.Window.partitionBy(*by)
    sd = F.stddev_pop(value).over(w)
    return F.when(sd > 1e-12, (F.col(value) - F.avg(value).over(w)) / F.when(sd > 1e-12, sd)).otherwise(F.lit(0.0))


def strongest_peaks(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """(by, p, height, prominence): the highest strict inner maximum of each group, else its maximum."""
    w = W.Window.partitionBy(*by).orderBy("p")
    v = F.col(value)
    inner = (v > F.lag(value).over(w)) & (v > F.lead(value).over(w))
    marked = rows.select(*by, "p", v.alias("height"), F.coalesce(inner, F.lit(False)).alias("inner"), F.min(value).over(w.rowsBetween(W.Window.unboundedPreceding, -1)).alias("l"), F.min(value).over(w.rowsBetween(1, W.Window.unboundedFollowing)).alias("r"))
    best = F.max_by(F.struct("p", "height", "l", "r"), F.struct("inner", "height", (-F.col("p")).alias("q"))).alias("b")
    top = marked.groupBy(*by).agg(best).select(*by, "b.*")
    side = F.greatest(F.coalesce("l", "height"), F.coalesce("r", "height"))
    return top.select(*by, "p", "height", (F.col("height") - side).alias("prominence"))
