"""Operators along diagonals: expected values, decay profiles and their fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..model import owned

DISTANCE_LIMIT, MIN_PAIRS, MIN_POINTS = 500, 10, 5


def expected_by_distance(contact: DataFrame, n: int) -> DataFrame:
    """(d, expected): mean over all n - d cells of a diagonal, absent ones as 0."""
    d = (F.col("j") - F.col("i")).alias("d")
    seen = contact.groupBy(d).agg(F.sum("v").alias("s"))
    every = contact.sparkSession.range(n).select(F.col("id").cast("int").alias("d"))
    return every.join(seen, "d", "left").select("d", (F.coalesce("s", F.lit(0.0)) / (n - F.col("d"))).alias("expected"))


def observed_over_expected(contact: DataFrame, n: int) -> DataFrame:
    """(i, j, v, oe): oe is 0 where nothing is expected."""
    e = expected_by_distance(contact, n).where("expected > 0")
    cells = contact.withColumn("d", F.col("j") - F.col("i"))
    return cells.join(e, "d", "left").select("i", "j", "v", F.coalesce(F.col("v") / F.col("expected"), F.lit(0.0)).alias("oe"))


def display_ratio(ratio: Column) -> Column:
    """log2 of a ratio from -3..3 to 0..1; 0 for what isn't positive."""
    scaled = (F.log2(F.when(ratio > 0, ratio)) + 3) / 6
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)), F.lit(0.0))


def intra_profile(contact: DataFrame, ranges: DataFrame, max_distance: int, by: str | None = None) -> DataFrame:
    """(by, d, mean, pairs): mean within segments at distances 1..max, and the number of pairs.

    Pairs come from the segments' widths, not from cells, so absent cells count as 0.
    """
    group = [by] if by else []
    wide = ranges.where("end_bin - start_bin > 1").withColumn("w", F.col("end_bin") - F.col("start_bin"))
    d = F.explode(F.sequence(F.lit(1), F.least(F.lit(max_distance), F.col("w") - 1))).alias("d")
    pairs = wide.select(*group, "w", d).groupBy(*group, "d").agg(F.sum(F.col("w") - F.col("d")).cast("long").alias("pairs"))
    band = contact.where((F.col("j") - F.col("i")).between(1, max_distance))  # the band first, then the lookups
    cells = owned(band, wide, *group).where("a_order_index = b_order_index")
    sums = cells.groupBy(*[F.col(f"a_{g}").alias(g) for g in group], (F.col("j") - F.col("i")).alias("d")).agg(F.sum("v").alias("s"))
    on = pairs.d == sums.d
    for g in group:
        on = on & pairs[g].eqNullSafe(sums[g])
    return pairs.join(sums, on, "left").select(*[pairs[g] for g in group], pairs.d, (F.coalesce(sums.s, F.lit(0.0)) / pairs.pairs).alias("mean"), pairs.pairs)


def decay_limit(n: int) -> int:
    return min(n // 2, DISTANCE_LIMIT)


def least_squares(rows: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """(by, n_points, slope, intercept, r2); degenerate fits have r2 0, too few points NULL."""
    g = rows.groupBy(*by).agg(F.count(F.lit(1)).cast("long").alias("n_points"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))
    few = F.col("n_points") < MIN_POINTS
    return g.select(*by, "n_points", F.when(~few, F.col("slope")).alias("slope"), F.when(~few, F.col("intercept")).alias("intercept"), F.when(~few, F.coalesce("r2", F.lit(0.0))).alias("r2"))


def decay_curve(profile: DataFrame, *by: str) -> DataFrame:
    """Positive points of a profile, in logarithms."""
    return profile.where("mean > 0").select(*by, "d", "mean", "pairs", F.log10("d").alias("log_d"), F.log10("mean").alias("log_mean"))


def decay_fit(profile: DataFrame, *by: str) -> DataFrame:
    """Power-law exponent: least squares over points with enough pairs."""
    return least_squares(decay_curve(profile, *by).where(F.col("pairs") >= MIN_PAIRS), "log_d", "log_mean", *by)


def decay_fit_binned(profile: DataFrame) -> DataFrame:
    """The same on tenths of a decade, each the mean of its points weighted by pairs."""
    pts = decay_curve(profile).where(F.col("pairs") >= MIN_PAIRS).withColumn("key", F.floor(F.col("log_d") * 10))
    mean = lambda c: (F.sum(F.col(c) * F.col("pairs")) / F.sum("pairs")).alias(c)
    return least_squares(pts.groupBy("key").agg(mean("log_d"), mean("log_mean")), "log_d", "log_mean")


def local_slopes(curve: DataFrame, reach: int = 2) -> DataFrame:
    """Least-squares slope over the points within ``reach`` of each; NULL with fewer than 2."""
    near = W.Window.orderBy("d").rowsBetween(-reach, reach)  # a curve has at most DISTANCE_LIMIT points
    return curve.select("d", F.regr_slope("log_mean", "log_d").over(near).alias("slope"))
