"""Queries over blocks of the matrix."""

from __future__ import annotations

from ..operators import blocks
from . import inputs
from .inputs import NB
from .queries import query, r


def _cm(spark, sf_dir):
    return inputs.contact(spark, sf_dir)


def _cr(spark, sf_dir):
    return inputs.ranges(spark, sf_dir)


@query("SELECT i AS p, round(sum(v), 6) AS total FROM sym GROUP BY i", "sym")
def row_sums(spark, sf_dir):
    return blocks.row_sums(_cm(spark, sf_dir)).select("p", r("total").alias("total"))


@query("SELECT i, j, round(s/(least(5, 128 - i*5)*least(5, 128 - j*5)), 6) AS v FROM (SELECT CAST(floor(i/5.0) AS INT) AS i, CAST(floor(j/5.0) AS INT) AS j, sum(v) AS s FROM sym GROUP BY 1, 2) WHERE i <= j", "sym")
def coarse_map(spark, sf_dir):
    return blocks.coarsen(_cm(spark, sf_dir), NB, 5).select("i", "j", r("v").alias("v"))


@query("SELECT a.t AS i, z.t AS j, round(sum(v*a.w*z.w)/power(128/48.0, 2), 6) AS v FROM sym JOIN ov a ON a.p = i JOIN ov z ON z.p = j WHERE a.t <= z.t GROUP BY a.t, z.t".replace("ov ", "(SELECT p, t, least(p + 1, (t + 1)*(128/48.0)) - greatest(p, t*(128/48.0)) AS w FROM bins, (SELECT CAST(range AS INT) AS t FROM range(48)) WHERE least(p + 1, (t + 1)*(128/48.0)) - greatest(p, t*(128/48.0)) > 1e-12) "), "sym", "bins")
def resized_map(spark, sf_dir):
    return blocks.resize(_cm(spark, sf_dir), NB, 48).select("i", "j", r("v").alias("v"))


PAIRS = "(SELECT i, j, v, a.c AS ca, z.c AS cz, coalesce(a.sc = z.sc, false) AS cis FROM cm JOIN own a ON a.bin = i JOIN own z ON z.bin = j WHERE i < j AND v > 0)"


@query(f"SELECT cis, trans, short, long, density, round(cis/(cis + trans), 6) AS cis_ratio, round(CASE WHEN short > 0 THEN long/short ELSE 0 END, 6) AS long_short FROM (SELECT coalesce(sum(CASE WHEN cis THEN v END), 0) AS cis, coalesce(sum(CASE WHEN NOT cis THEN v END), 0) AS trans, coalesce(sum(CASE WHEN cis AND j - i <= 20 THEN v END), 0) AS short, coalesce(sum(CASE WHEN cis AND j - i > 20 THEN v END), 0) AS long, round(avg(v), 6) AS density FROM {PAIRS})", "cm", "own")
def library_quality(spark, sf_dir):
    q = blocks.library_quality(_cm(spark, sf_dir), _cr(spark, sf_dir))
    return q.select("cis", "trans", "short", "long", r("density").alias("density"), r("cis_ratio").alias("cis_ratio"), r("long_short").alias("long_short"))


@query(f"SELECT order_index, cis, total, round(cis/total, 6) AS ratio, cis/total < 0.5 AS flagged FROM (SELECT c AS order_index, sum(CASE WHEN cis THEN v ELSE 0 END) AS cis, sum(v) AS total FROM (SELECT ca AS c, cis, v FROM {PAIRS} UNION ALL SELECT cz, cis, v FROM {PAIRS} WHERE ca <> cz) GROUP BY c)", "cm", "own")
def segment_quality(spark, sf_dir):
    return blocks.segment_quality(_cm(spark, sf_dir), _cr(spark, sf_dir)).withColumn("ratio", r("ratio"))


@query(f""", q AS (SELECT coalesce(sum(CASE WHEN cis THEN v END), 0) AS cis, coalesce(sum(CASE WHEN NOT cis THEN v END), 0) AS trans, coalesce(sum(CASE WHEN cis AND j - i <= 20 THEN v END), 0) AS short, coalesce(sum(CASE WHEN cis AND j - i > 20 THEN v END), 0) AS long, avg(v) AS density FROM {PAIRS}),
h AS (SELECT c AS order_index, sum(CASE WHEN cis THEN v ELSE 0 END)/sum(v) AS ratio FROM (SELECT ca AS c, cis, v FROM {PAIRS} UNION ALL SELECT cz, cis, v FROM {PAIRS} WHERE ca <> cz) GROUP BY c)
SELECT -7 AS k, '# Hi-C library quality metrics' AS body UNION ALL SELECT -6, '# Cis/trans ratio: ' || printf('%.4f', CASE WHEN trans > 0 THEN cis/trans ELSE 0 END) FROM q UNION ALL SELECT -5, '# Cis percentage: ' || printf('%.2f', cis/(cis + trans)*100) || '%' FROM q
UNION ALL SELECT -4, '# Long/short ratio: ' || printf('%.4f', CASE WHEN short > 0 THEN long/short ELSE 0 END) FROM q UNION ALL SELECT -3, '# Mean occupied contact: ' || printf('%.6f', density) FROM q UNION ALL SELECT -2, '# Flagged contigs: ' || (SELECT count(*) FROM h WHERE ratio < 0.5) UNION ALL SELECT -1, 'contig' || chr(9) || 'cis_ratio'
UNION ALL SELECT order_index, name || chr(9) || printf('%.4f', coalesce(ratio, 0)) FROM seg LEFT JOIN h USING (order_index)""", "cm", "own", "seg")
def quality_lines(spark, sf_dir):
    """The quality of the derived map as a commented table."""
    from ..sinks import text as sink

    cm, cr = _cm(spark, sf_dir), _cr(spark, sf_dir)
    return sink.quality_lines(blocks.library_quality(cm, cr), blocks.segment_quality(cm, cr), cr)


@query(f"SELECT a, b, round(m/bg, 6) AS ratio, round(least(1, (m/bg - 1.02)/(2*1.02)), 6) AS strength FROM (SELECT ca AS a, cz AS b, avg(v) AS m FROM {PAIRS} WHERE cz >= ca + 2 AND ca IN (SELECT order_index FROM cr WHERE e - s >= 2) AND cz IN (SELECT order_index FROM cr WHERE e - s >= 2) GROUP BY ca, cz), (SELECT avg(v) AS bg FROM cm WHERE i < j AND v > 0) WHERE m/bg >= 1.02", "cm", "own", "cr")
def translocations(spark, sf_dir):
    t = blocks.translocations(_cm(spark, sf_dir), _cr(spark, sf_dir), 1.02)
    return t.select("a", "b", r("ratio").alias("ratio"), r("strength").alias("strength"))


@query("SELECT c AS order_index, round(an/al, 6) AS ratio FROM (SELECT c, avg(coalesce(v, 0)) AS al, avg(CASE WHEN x + y = s + e - 1 THEN coalesce(v, 0) END) AS an FROM (SELECT a.c, a.s, a.e, a.bin AS x, z.bin AS y FROM ownt a JOIN ownt z ON a.c = z.c AND z.bin - a.bin >= greatest(2, ceil((a.e - a.s)/3.0)) WHERE a.e - a.s >= 4) LEFT JOIN cm ON i = x AND j = y GROUP BY c) WHERE an/al >= 0.9", "cm", "ownt")
def inversions(spark, sf_dir):
    return blocks.inversions(_cm(spark, sf_dir), inputs.ranges(spark, sf_dir, "p_type"), 0.9).select("order_index", r("ratio").alias("ratio"))


@query("SELECT order_index, round(score, 6) AS score, boundary, CAST(coalesce(sum(CAST(boundary AS INT)) OVER (ORDER BY order_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS block FROM (SELECT order_index, score, CASE WHEN score IS NOT NULL THEN coalesce(score < 0.3*median(CASE WHEN score > 0 THEN score END) OVER (), true) END AS boundary FROM (SELECT order_index, mean/max(mean) OVER () AS score FROM (SELECT order_index, CASE WHEN w2 IS NOT NULL THEN CASE WHEN w > 1 AND w2 > 1 THEN coalesce(sv, 0)/(w*w2) ELSE 0 END END AS mean FROM (SELECT order_index, e - s AS w, lead(e - s) OVER (ORDER BY order_index) AS w2 FROM cr) LEFT JOIN (SELECT a.c AS c, sum(v) AS sv FROM cm JOIN own a ON a.bin = i JOIN own z ON z.bin = j WHERE z.c = a.c + 1 GROUP BY a.c) ON c = order_index)))", "cm", "own", "cr")
def neighbour_contact(spark, sf_dir):
    return blocks.neighbour_contact(_cm(spark, sf_dir), _cr(spark, sf_dir)).withColumn("score", r("score"))


SUPPORT = """, jn AS (SELECT order_index, greatest(s, e - 6) AS lo, e AS mid, least(e2, e + 6) AS hi, least(e - s, e2 - e) AS least FROM (SELECT *, lead(e) OVER (ORDER BY order_index) AS e2, lead(scaffold_id) OVER (ORDER BY order_index) AS sc2 FROM cr) WHERE e2 IS NOT NULL AND e > s AND e2 > e AND NOT coalesce(scaffold_id <> sc2, false)),
cells AS (SELECT order_index, least, y.p - x.p AS d, coalesce(v, 0) AS v, x.p < mid AND y.p >= mid AS across FROM jn JOIN bins x ON x.p >= lo AND x.p < hi JOIN bins y ON y.p > x.p AND y.p < hi AND y.p - x.p <= 6 LEFT JOIN cm ON i = x.p AND j = y.p),
per AS (SELECT order_index, least, c.d, sum(CASE WHEN across THEN v ELSE 0 END) AS o, count(CASE WHEN across THEN 1 END) AS n, avg(CASE WHEN NOT across THEN v END) AS f, any_value(expected) AS e FROM cells c JOIN expd ON expd.d = c.d GROUP BY order_index, least, c.d),
sup AS (SELECT order_index, least, sum(o)/sum(CASE WHEN f > 0 THEN f ELSE e END*n) AS support FROM per WHERE n > 0 GROUP BY order_index, least),
med AS (SELECT median(support) AS m FROM sup), mad AS (SELECT median(abs(support - m)) AS k FROM sup, med)
SELECT order_index, round(support, 6) AS support, CASE WHEN least >= 3 THEN 'high' WHEN least >= 2 THEN 'medium' ELSE 'low' END AS confidence, support < greatest(0.35, m - 2.5*k) AS flagged FROM sup, med, mad"""


@query(SUPPORT, "cm", "cr", "bins", "expd")
def join_support(spark, sf_dir):
    return blocks.join_support(_cm(spark, sf_dir), _cr(spark, sf_dir), NB).withColumn("support", r("support"))


DUPLICATE = """, pr AS (SELECT a.c AS a, z.c AS b, sum(oe)/any_value((a.e - a.s)*(z.e - z.s)) AS e FROM oe JOIN own a ON a.bin = i JOIN own z ON z.bin = j WHERE z.c - a.c >= 4 GROUP BY a.c, z.c),
best AS (SELECT a AS order_index, b AS partner, e AS enrichment FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY e DESC, b) AS k FROM (SELECT a, b, e FROM pr UNION ALL SELECT b, a, e FROM pr)) WHERE k = 1),
med AS (SELECT median(enrichment) AS m FROM best), mad AS (SELECT median(abs(enrichment - m)) AS k FROM best, med)
SELECT order_index, partner, round(enrichment, 6) AS enrichment, enrichment >= greatest(2.0, m + 3*k) AS candidate FROM best, med, mad"""


@query(DUPLICATE, "oe", "own")
def duplicate_segments(spark, sf_dir):
    return blocks.duplicate_segments(_cm(spark, sf_dir), _cr(spark, sf_dir), NB).withColumn("enrichment", r("enrichment"))


@query("SELECT c AS order_index, round(m/(SELECT median(m) FROM (SELECT median(value) AS m FROM tr JOIN own ON bin = p GROUP BY c) WHERE m > 0), 6) AS ratio FROM (SELECT c, median(value) AS m FROM tr JOIN own ON bin = p GROUP BY c)", "tr", "own")
def coverage_ratios(spark, sf_dir):
    return blocks.coverage_ratios(inputs.track(spark, sf_dir), _cr(spark, sf_dir)).withColumn("ratio", r("ratio"))


@query("SELECT (SELECT l_extendedprice FROM (SELECT l_extendedprice, row_number() OVER (ORDER BY l_extendedprice) - 1 AS k, count(*) OVER () AS n FROM lineitem) WHERE k = least(floor(0.02*n), n - 1)) AS low, (SELECT l_extendedprice FROM (SELECT l_extendedprice, row_number() OVER (ORDER BY l_extendedprice) - 1 AS k, count(*) OVER () AS n FROM lineitem) WHERE k = least(ceil(0.975*n), n - 1)) AS high")
def order_statistics(spark, sf_dir):
    rows = inputs.read(spark, sf_dir, "lineitem")
    low = blocks.order_statistic(rows, "l_extendedprice", 0.02).withColumnRenamed("value", "low")
    return low.crossJoin(blocks.order_statistic(rows, "l_extendedprice", 0.975, True).withColumnRenamed("value", "high"))  # one row each


@query("SELECT round(-sum(q*ln(q)), 6) AS entropy, round(-sum(q*ln(q))/ln(30)*100, 6) AS score FROM (SELECT count(*)/(SELECT count(*) FROM oe)::DOUBLE AS q FROM oe GROUP BY least(29, greatest(0, floor(oe/1.6*30))))", "oe")
def ratio_entropy(spark, sf_dir):
    from ..operators.bands import observed_over_expected

    h = blocks.histogram(observed_over_expected(_cm(spark, sf_dir), NB), "oe", 0.0, 1.6, 30)
    return blocks.entropy_score(h, 30).select(r("entropy").alias("entropy"), r("score").alias("score"))


@query("SELECT b/256.0 AS median, CASE WHEN b/256.0 > 0.25 THEN b/256.0 ELSE 0.0 END AS floor, 0.7::DOUBLE AS cap FROM (SELECT min(bin) AS b FROM (SELECT bin, sum(c) OVER (ORDER BY bin) AS u FROM (SELECT least(255, floor(coalesce(v, 0)/(SELECT max(v) FROM cm)*256)) AS bin, count(*) AS c FROM bins x JOIN bins y ON x.p < y.p LEFT JOIN cm ON i = x.p AND j = y.p GROUP BY 1)) WHERE u*2 >= 128*127/2)", "cm", "bins")
def auto_contrast(spark, sf_dir):
    return blocks.auto_contrast(_cm(spark, sf_dir), NB)
