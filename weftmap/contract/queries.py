"""Registered queries over the contact-map operators, with the SQL each one must match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bands, windows
from . import inputs
from .inputs import HOURS, NB, sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(text: str | None = None, *ctes: str) -> Callable[[Query], Query]:
    """Registers a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if text:
            ORACLES[f.__name__] = sql(text, *ctes) if ctes else text
        return f

    return add


def r(c, k: int = 6):
    """Rounded for comparison, without negative zero."""
    return F.round(c, k) + F.lit(0.0)


@query("SELECT d, round(expected, 6) AS mean_contact, round(log10(CASE WHEN expected > 0 THEN expected END), 6) AS log_contact FROM expd", "expd")
def decay_by_distance(spark, sf_dir):
    e = bands.expected_by_distance(inputs.contact(spark, sf_dir), NB)
    return e.select("d", r("expected").alias("mean_contact"), r(F.log10(F.when(F.col("expected") > 0, F.col("expected")))).alias("log_contact"))


@query(f"SELECT p AS d, round(coalesce(s, 0)/({HOURS} - p), 6) AS mean_contact FROM hours LEFT JOIN (SELECT j - i AS dd, sum(v) AS s FROM ce GROUP BY j - i) ON dd = p", "hours", "ce")
def decay_by_distance_sparse(spark, sf_dir):
    e = bands.expected_by_distance(inputs.contact_events(spark, sf_dir), HOURS)
    return e.select("d", r("expected").alias("mean_contact"))


@query("SELECT i, j, round(oe, 6) AS oe, round(CASE WHEN oe > 0 THEN greatest(0, least(1, (log2(oe) + 3)/6)) ELSE 0 END, 6) AS shown FROM oe", "oe")
def observed_expected(spark, sf_dir):
    o = bands.observed_over_expected(inputs.contact(spark, sf_dir), NB)
    return o.select("i", "j", r("oe").alias("oe"), r(bands.display_ratio(F.col("oe"))).alias("shown"))


def _profile(spark, sf_dir):
    return bands.intra_profile(inputs.contact(spark, sf_dir), inputs.ranges(spark, sf_dir, "p_type"), bands.decay_limit(NB))


@query("SELECT d, round(mean, 6) AS mean, pairs FROM prof", "prof")
def intra_segment_profile(spark, sf_dir):
    return _profile(spark, sf_dir).select("d", r("mean").alias("mean"), "pairs")


FIT = "SELECT CAST(count(*) AS BIGINT) AS n_points, round(CASE WHEN count(*) >= 5 THEN regr_slope(y, x) END, 6) AS slope, round(CASE WHEN count(*) >= 5 THEN regr_intercept(y, x) END, 6) AS intercept, round(CASE WHEN count(*) >= 5 THEN coalesce(regr_r2(y, x), 0) END, 6) AS r2 FROM "


def _rounded_fit(df):
    return df.select(*[c for c in df.columns if c not in ("slope", "intercept", "r2")], *[r(c).alias(c) for c in ("slope", "intercept", "r2")])


@query(FIT + "(SELECT log10(d) AS x, log10(mean) AS y FROM prof WHERE mean > 0 AND pairs >= 10)", "prof")
def decay_exponent(spark, sf_dir):
    return _rounded_fit(bands.decay_fit(_profile(spark, sf_dir)))


@query(FIT + "(SELECT sum(log10(d)*pairs)/sum(pairs) AS x, sum(log10(mean)*pairs)/sum(pairs) AS y FROM prof WHERE mean > 0 AND pairs >= 10 GROUP BY floor(log10(d)*10))", "prof")
def decay_exponent_log_bins(spark, sf_dir):
    return _rounded_fit(bands.decay_fit_binned(_profile(spark, sf_dir)))


@query("SELECT scaffold, n_points, slope, intercept, r2 FROM (SELECT scaffold, CAST(count(*) AS BIGINT) AS n_points, round(CASE WHEN count(*) >= 5 THEN regr_slope(y, x) END, 6) AS slope, round(CASE WHEN count(*) >= 5 THEN regr_intercept(y, x) END, 6) AS intercept, round(CASE WHEN count(*) >= 5 THEN coalesce(regr_r2(y, x), 0) END, 6) AS r2 FROM (SELECT w.scaffold, log10(w.d) AS x, log10(sv/pairs) AS y FROM (SELECT coalesce(scaffold_id, -1) AS scaffold, d, sum(e - s - d) AS pairs FROM cr, (SELECT CAST(range AS INT) AS d FROM range(1, 65)) WHERE e - s > d GROUP BY 1, 2) w JOIN (SELECT coalesce(a.sc, -1) AS scaffold, j - i AS d, sum(v) AS sv FROM cm JOIN own a ON a.bin = i JOIN own z ON z.bin = j WHERE a.c = z.c GROUP BY 1, 2) q ON w.scaffold = q.scaffold AND w.d = q.d WHERE pairs >= 10 AND sv > 0) GROUP BY scaffold)", "cr", "cm", "own")
def decay_exponent_by_scaffold(spark, sf_dir):
    rg = inputs.ranges(spark, sf_dir).withColumn("scaffold", F.coalesce("scaffold_id", F.lit(-1)))
    p = bands.intra_profile(inputs.contact(spark, sf_dir), rg, bands.decay_limit(NB), "scaffold")
    return _rounded_fit(bands.decay_fit(p, "scaffold"))


@query("SELECT d, round(regr_slope(y, x) OVER (ORDER BY d ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS slope FROM (SELECT d, log10(d) AS x, log10(mean) AS y FROM prof WHERE mean > 0)", "prof")
def decay_local_slopes(spark, sf_dir):
    return bands.local_slopes(bands.decay_curve(_profile(spark, sf_dir))).select("d", r("slope").alias("slope"))


def _insulation(spark, sf_dir):
    return windows.insulation(inputs.contact(spark, sf_dir), NB)


@query("SELECT z.p, round(score, 6) AS score, round(norm, 6) AS norm FROM insz z JOIN insn USING (p)", "insz", "insn")
def insulation_scores(spark, sf_dir):
    return windows.normalised_insulation(_insulation(spark, sf_dir)).select("p", r("score").alias("score"), r("norm").alias("norm"))


@query(f"SELECT p, round(coalesce(s, 0)/(least(6, p)*least(6, {HOURS} - p)), 6) AS score FROM hours LEFT JOIN (SELECT p AS pp, sum(v) AS s FROM hours JOIN ce ON i >= p - 6 AND i < p AND j >= p AND j < p + 6 GROUP BY p) ON pp = p WHERE p > 0 UNION ALL SELECT 0, 0.0", "hours", "ce")
def insulation_scores_sparse(spark, sf_dir):
    return windows.insulation(inputs.contact_events(spark, sf_dir), HOURS, 6).select("p", r("score").alias("score"))


@query("SELECT p, round(CASE WHEN p - s >= 3 AND e - p >= 3 THEN coalesce((SELECT sum(v) FROM cm WHERE i >= p - 3 AND i < p AND j >= p AND j < p + 3), 0)/9 END, 6) AS score FROM bins LEFT JOIN ownt ON bin = p", "bins", "cm", "ownt")
def insulation_within_segments(spark, sf_dir):
    return windows.insulation(inputs.contact(spark, sf_dir), NB, 3, inputs.ranges(spark, sf_dir, "p_type")).select("p", r("score").alias("score"))


@query("SELECT p, round(norm, 6) AS value, round(strength, 6) AS strength FROM (SELECT p, norm, lag(norm) OVER (ORDER BY p) AS a, lead(norm) OVER (ORDER BY p) AS b, least(max(norm) OVER (ORDER BY p ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), max(norm) OVER (ORDER BY p ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)) - norm AS strength FROM insn) WHERE norm < a AND norm < b AND strength >= 0.01", "insn")
def domain_boundaries(spark, sf_dir):
    out = windows.boundaries(windows.normalised_insulation(_insulation(spark, sf_dir)), prominence=0.01)
    return out.select("p", r("value").alias("value"), r("strength").alias("strength"))


def _di(spark, sf_dir):
    return windows.directionality(inputs.contact(spark, sf_dir), NB)


@query("SELECT p, round(up, 6) AS up, round(down, 6) AS down, round(di, 6) AS di, round(CASE WHEN di IS NOT NULL THEN CASE WHEN m > 0 THEN 0.5 + di/m*0.5 ELSE 0.5 END END, 6) AS norm FROM (SELECT *, max(abs(di)) OVER () AS m FROM di)", "di")
def directionality_index(spark, sf_dir):
    d = _di(spark, sf_dir)
    n = windows.normalised_directionality(d).select("p", "norm")
    return d.join(n, "p").select("p", r("up").alias("up"), r("down").alias("down"), r("di").alias("di"), r("norm").alias("norm"))


@query("SELECT p, round(di - a, 6) AS strength FROM (SELECT p, di, lag(di) OVER (ORDER BY p) AS a FROM di) WHERE a < -0.1 AND di > 0.1", "di")
def directionality_jumps(spark, sf_dir):
    return windows.directionality_boundaries(_di(spark, sf_dir), 0.1).select("p", r("strength").alias("strength"))


def _density(spark, sf_dir):
    return windows.local_baseline(windows.diagonal_density(inputs.contact(spark, sf_dir), NB), "density", 32)


@query("SELECT p, round(density, 6) AS density, round(coalesce(avg(CASE WHEN density > 0 THEN density END) OVER (ORDER BY p ROWS BETWEEN 32 PRECEDING AND 32 FOLLOWING), 0), 6) AS base FROM dens", "dens")
def diagonal_density(spark, sf_dir):
    return _density(spark, sf_dir).select("p", r("density").alias("density"), r("base").alias("base"))


@query("SELECT z.st AS start, z.la AS last, z.mid AS middle, round((b.base - z.mean)/b.base, 6) AS confidence FROM (SELECT min(p) AS st, max(p) AS la, CAST(floor((min(p) + max(p) + 1)/2.0) AS INT) AS mid, avg(density) AS mean FROM (SELECT p, density, p - row_number() OVER (ORDER BY p) AS run FROM (SELECT p, density, avg(CASE WHEN density > 0 THEN density END) OVER (ORDER BY p ROWS BETWEEN 32 PRECEDING AND 32 FOLLOWING) AS base FROM dens) WHERE (base - density)/base > 0.02) GROUP BY run) z JOIN (SELECT p, avg(CASE WHEN density > 0 THEN density END) OVER (ORDER BY p ROWS BETWEEN 32 PRECEDING AND 32 FOLLOWING) AS base FROM dens) b ON b.p = z.mid WHERE la - st + 1 >= 2", "dens")
def low_density_regions(spark, sf_dir):
    out = windows.low_regions(_density(spark, sf_dir), "density", 0.02, 2)
    return out.select("start", "last", "middle", r("confidence").alias("confidence"))


@query("SELECT p, round(sum(w*value)/sum(w), 6) AS smooth, round(any_value(z), 6) AS z FROM (SELECT a.p, q.value, exp(-power(q.p - a.p, 2)/(2*power(4/3.0, 2))) AS w, a.z FROM (SELECT *, (value - avg(value) OVER ())/stddev_pop(value) OVER () AS z FROM tr) a JOIN tr q ON abs(q.p - a.p) <= 4) GROUP BY p", "tr")
def smoothed_track(spark, sf_dir):
    t = inputs.track(spark, sf_dir)
    return windows.gaussian_smooth(t.withColumn("z", windows.z_scores(t, "value")), "value", 4).select("p", r("smooth").alias("smooth"), r("z").alias("z"))


@query("SELECT c, p, round(value, 6) AS height, round(value - greatest(coalesce(l, value), coalesce(q, value)), 6) AS prominence FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY inn DESC, value DESC, p) AS k FROM (SELECT c, p, value, coalesce(value > lag(value) OVER w AND value > lead(value) OVER w, false) AS inn, min(value) OVER (PARTITION BY c ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l, min(value) OVER (PARTITION BY c ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS q FROM tr JOIN ownt ON bin = p WINDOW w AS (PARTITION BY c ORDER BY p))) WHERE k = 1", "tr", "ownt")
def strongest_peaks(spark, sf_dir):
    from ..model import bins_of

    own = bins_of(inputs.ranges(spark, sf_dir, "p_type")).select(F.col("bin").alias("p"), F.col("order_index").alias("c"))
    out = windows.strongest_peaks(inputs.track(spark, sf_dir).join(own, "p"), "value", "c")
    return out.select("c", "p", r("height").alias("height"), r("prominence").alias("prominence"))


from . import batch_queries, blocks_queries, detect_queries, edit_queries, metrics_queries, spectra_queries  # noqa: E402, F401  they register their queries
