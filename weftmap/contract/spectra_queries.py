"""Queries over balancing, correlation and compartment operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import balance, blocks, spectra
from . import inputs
from .inputs import NB
from .queries import query, r


def _cm(spark, sf_dir):
    return inputs.contact(spark, sf_dir)


def _round(k: int) -> str:
    """One unrolled balancing round after round k."""
    return f"b{k + 1} AS (SELECT x.p, x.bias*sqrt(sum(v/(x.bias*y.bias))) AS bias FROM cells JOIN b{k} x ON x.p = i JOIN b{k} y ON y.p = j GROUP BY x.p, x.bias)"


MASKED = f""", rs AS (SELECT p, coalesce(t, 0) AS t FROM bins LEFT JOIN (SELECT i, sum(v) AS t FROM sym GROUP BY i) ON i = p),
mk AS (SELECT p FROM rs WHERE t <= (SELECT t FROM (SELECT t, row_number() OVER (ORDER BY t) - 1 AS k FROM rs) WHERE k = floor(0.02*{NB}))),
cells AS (SELECT i, j, v FROM sym WHERE i NOT IN (SELECT p FROM mk) AND j NOT IN (SELECT p FROM mk)),
b0 AS (SELECT DISTINCT i AS p, 1.0::DOUBLE AS bias FROM cells), """


@query(MASKED + ", ".join(_round(k) for k in range(3)) + " SELECT bins.p, round(coalesce(bias, 1.0), 6) AS bias FROM bins LEFT JOIN b3 ON b3.p = bins.p", "sym", "bins")
def balance_three_rounds(spark, sf_dir):
    return balance.balance(_cm(spark, sf_dir), NB, 3, 0).select("p", r("bias").alias("bias"))


@query(MASKED + "done AS (SELECT 1) SELECT DISTINCT i AS p, 1.0::DOUBLE AS total FROM cells", "sym", "bins")
def balanced_row_sums(spark, sf_dir):
    """Until the tolerance; row sums come out as 1."""
    cm = _cm(spark, sf_dir)
    b = balance.balance(cm, NB)
    out = balance.masked_bins(cm, NB)
    kept = cm.join(out.withColumnRenamed("p", "i"), "i", "left_anti").join(out.withColumnRenamed("p", "j"), "j", "left_anti")
    return blocks.row_sums(balance.balanced(kept, b)).select("p", r("total", 3).alias("total"))


@query()
def balanced_strictly(spark, sf_dir):
    """The same rounds to a tighter tolerance."""
    return balance.balance(_cm(spark, sf_dir), NB, 200, 1e-6).select("p", r("bias").alias("bias"))


COARSE = f"""SELECT i, j, s/(least(4, {NB} - i*4)*least(4, {NB} - j*4)) AS v FROM (SELECT CAST(floor(i/4.0) AS INT) AS i, CAST(floor(j/4.0) AS INT) AS j, sum(v) AS s FROM sym GROUP BY 1, 2)"""
CORRELATION = f""", cs AS ({COARSE}), ex AS (SELECT abs(j - i) AS d, sum(v)/any_value(CASE WHEN i = j THEN 32 ELSE 2*(32 - abs(j - i)) END) AS e FROM cs GROUP BY abs(j - i)),
o AS (SELECT i, j, CASE WHEN e > 0 THEN v/e ELSE 0 END AS v FROM cs JOIN ex ON d = abs(j - i)),
m AS (SELECT i, sum(v)/32 AS mu, sqrt(greatest(0, sum(v*v)/32 - power(sum(v)/32, 2))) AS sd FROM o GROUP BY i),
g AS (SELECT a.i, z.i AS j, sum(a.v*z.v)/32 AS xy FROM o a JOIN o z ON a.j = z.j WHERE a.i <= z.i GROUP BY a.i, z.i)
SELECT g.i, g.j, round(CASE WHEN g.i = g.j THEN 1 WHEN x.sd*y.sd > 1e-12 THEN (xy - x.mu*y.mu)/(x.sd*y.sd) ELSE 0 END, 6) AS v FROM g JOIN m x ON x.i = g.i JOIN m y ON y.i = g.j"""


@query(CORRELATION, "sym")
def row_correlation(spark, sf_dir):
    from ..operators.bands import observed_over_expected

    oe = observed_over_expected(blocks.coarsen(_cm(spark, sf_dir), NB, 4), NB // 4)
    return spectra.row_correlation(oe.select("i", "j", F.col("oe").alias("v")), NB // 4).select("i", "j", r("v").alias("v"))


@query()
def compartments(spark, sf_dir):
    return spectra.compartments(_cm(spark, sf_dir), NB).select("p", r("e1", 3).alias("e1"), r("norm", 3).alias("norm"))


SADDLE = """, n AS (SELECT count(*) AS n FROM tr), q AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS k FROM tr),
lo AS (SELECT value AS low FROM q, n WHERE k = least(floor(0.025*n), n - 1)), hi AS (SELECT value AS high FROM q, n WHERE k = least(ceil(0.975*n), n - 1)),
dg AS (SELECT p, CAST(least(19, greatest(0, floor((value - low)/(high - low)*20))) AS INT) AS q FROM tr, lo, hi),
c AS (SELECT a.q AS a, z.q AS b, oe FROM oe JOIN dg a ON a.p = i JOIN dg z ON z.p = j WHERE j >= i + 3 AND oe > 0),
sd AS (SELECT a, b, avg(oe) AS mean, CAST(count(*) AS BIGINT) AS cells FROM (SELECT a, b, oe FROM c UNION ALL SELECT b, a, oe FROM c WHERE a <> b) GROUP BY a, b) """


def _saddle(spark, sf_dir):
    return spectra.saddle(_cm(spark, sf_dir), inputs.track(spark, sf_dir), NB)


@query(SADDLE + "SELECT a, b, round(mean, 6) AS mean, cells FROM sd", "oe", "tr")
def saddle(spark, sf_dir):
    return _saddle(spark, sf_dir).withColumn("mean", r("mean"))


@query(SADDLE + "SELECT round(aa, 6) AS aa, round(bb, 6) AS bb, round(ab, 6) AS ab, underpopulated, round((aa + bb)/(2*ab), 6) AS strength FROM (SELECT avg(CASE WHEN a >= 16 AND b >= 16 THEN mean END) AS aa, avg(CASE WHEN a < 4 AND b < 4 THEN mean END) AS bb, avg(CASE WHEN (a < 4 AND b >= 16) OR (a >= 16 AND b < 4) THEN mean END) AS ab, coalesce(sum(CASE WHEN a >= 16 AND b >= 16 THEN cells END), 0) < 2 OR coalesce(sum(CASE WHEN a < 4 AND b < 4 THEN cells END), 0) < 2 OR coalesce(sum(CASE WHEN (a < 4 AND b >= 16) OR (a >= 16 AND b < 4) THEN cells END), 0) < 2 AS underpopulated FROM sd)", "oe", "tr")
def saddle_strength(spark, sf_dir):
    s = spectra.saddle_strength(_saddle(spark, sf_dir))
    return s.select(*[r(c).alias(c) for c in ("aa", "bb", "ab")], "underpopulated", r("strength").alias("strength"))


CHECKER = """, sg AS (SELECT *, greatest(1, floor(0.05*(e - s) + 0.5)) AS low FROM crt WHERE e - s >= 5), sh AS (SELECT *, greatest(low + 1, floor(0.15*(e - s) + 0.5)) AS high FROM sg),
rw AS (SELECT order_index, low, high, i, j AS k, v FROM sym JOIN sh ON i >= s AND i < e AND j >= s AND j < e),
nm AS (SELECT order_index, i, sqrt(sum(v*v)) AS norm FROM rw GROUP BY order_index, i),
ds AS (SELECT a.order_index, a.i, z.i AS j, sum(a.v*z.v)/any_value(x.norm*y.norm) AS cs FROM rw a JOIN rw z ON a.order_index = z.order_index AND a.k = z.k AND z.i - a.i >= a.low AND z.i - a.i < a.high JOIN nm x ON x.order_index = a.order_index AND x.i = a.i JOIN nm y ON y.order_index = z.order_index AND y.i = z.i GROUP BY a.order_index, a.i, z.i),
hs AS (SELECT order_index, least(29, floor(least(2, greatest(0, 1 - cs))/1.6*30)) AS b, count(*) AS c FROM ds GROUP BY 1, 2),
tt AS (SELECT order_index, sum(c) AS n FROM hs GROUP BY 1),
en AS (SELECT order_index, CAST(any_value(n) AS BIGINT) AS samples, -sum(c/n*ln(c/n)) AS entropy FROM hs JOIN tt USING (order_index) WHERE n >= 10 GROUP BY order_index) """


def _checker(spark, sf_dir):
    return spectra.checkerboard(_cm(spark, sf_dir), inputs.ranges(spark, sf_dir, "p_type"))


@query(CHECKER + "SELECT order_index, samples, round(entropy, 6) AS entropy, round(entropy/ln(30)*100, 6) AS score FROM en", "sym", "crt")
def checkerboard(spark, sf_dir):
    return _checker(spark, sf_dir).select("order_index", "samples", r("entropy").alias("entropy"), r("score").alias("score"))


@query(CHECKER + "SELECT order_index, round(entropy, 6) AS entropy, (SELECT r_name FROM region ORDER BY abs(r_regionkey*0.5 - entropy), r_name LIMIT 1) AS nearest, round(least(100, greatest(0, (entropy - 2.3)/(3.0 - 2.3)*100)), 6) AS place FROM en", "sym", "crt")
def nearest_landmark(spark, sf_dir):
    panel = inputs.read(spark, sf_dir, "region").select(F.col("r_name").alias("label"), (F.col("r_regionkey") * 0.5).alias("entropy"))
    return spectra.nearest_landmark(_checker(spark, sf_dir), panel).select("order_index", r("entropy").alias("entropy"), "nearest", r("place").alias("place"))


@query(", rw AS (SELECT p, coalesce(v, 0) AS v, coalesce(oe, 0) AS oe FROM bins LEFT JOIN oe ON (i = 40 AND j = p) OR (j = 40 AND i = p AND i < 40)), lg AS (SELECT *, log2(greatest(oe, (SELECT min(oe) FROM rw WHERE oe > 0))) AS l FROM rw) SELECT p, round(v, 6) AS v, round(oe, 6) AS oe, round((l - min(l) OVER ())/(max(l) OVER () - min(l) OVER ()), 6) AS norm FROM lg", "oe", "bins")
def viewpoint(spark, sf_dir):
    return spectra.viewpoint(_cm(spark, sf_dir), NB, 40).select("p", *[r(c).alias(c) for c in ("v", "oe", "norm")])


@query(", g AS (SELECT avg(CASE WHEN value > m THEN total END) AS a, avg(CASE WHEN value < m THEN total END) AS b FROM tr JOIN (SELECT i, sum(v) AS total FROM sym GROUP BY i) ON i = p, (SELECT avg(value) AS m FROM tr)) SELECT p, round(CASE WHEN a < b THEN -1 ELSE 1 END*(value - (SELECT avg(value) FROM tr)), 5) AS e1, a < b AS flipped FROM tr, g", "tr", "sym")
def oriented_track(spark, sf_dir):
    t = inputs.track(spark, sf_dir)
    from pyspark.sql.window import Window

    centred = t.select("p", (F.col("value") - F.avg("value").over(Window.partitionBy())).alias("e1"))
    gc = blocks.row_sums(_cm(spark, sf_dir)).withColumnRenamed("total", "gc")
    return spectra.oriented(centred, gc).select("p", r("e1", 5).alias("e1"), "flipped")


@query()
def enhanced_map(spark, sf_dir):
    """The derived map at twice its resolution, by tiles with a margin."""
    from ..operators import enhance

    return enhance.enhanced(inputs.contact(spark, sf_dir), NB, 2.0, tile=32).withColumn("v", r("v"))


@query("SELECT vec_id, CAST(length(embedding) AS INT) AS n, CAST(4*ceil(length(embedding)*4/3.0) AS INT) AS letters, round(list_sum([x::DOUBLE FOR x IN embedding]), 6) AS total FROM embeddings")
def floats_as_text(spark, sf_dir):
    """Vectors written as base64 text and read again."""
    from ..operators import enhance

    e = inputs.read(spark, sf_dir, "embeddings").select("vec_id", enhance.floats_to_text(F.col("embedding")).alias("t"))
    v = e.select("vec_id", F.length("t").alias("letters"), enhance.text_to_floats(F.col("t")).alias("v"))
    return v.select("vec_id", F.size("v").alias("n"), "letters", r(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double"))).alias("total"))

