"""Queries over links, detectors and remapped views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.tables import written
from ..operators import detect, links, remap, windows
from . import inputs
from .inputs import NB
from .queries import query, r

LINKS = """, pf AS (SELECT d, coalesce(sv, 0)/pairs AS mean FROM (SELECT d, sum(e - s - d) AS pairs FROM cr, (SELECT CAST(range AS INT) AS d FROM range(1, 51)) WHERE e - s > d GROUP BY d) LEFT JOIN (SELECT j - i AS dd, sum(v) AS sv FROM cm JOIN own a ON a.bin = i JOIN own z ON z.bin = j WHERE a.c = z.c GROUP BY j - i) ON dd = d),
pt AS (SELECT x.order_index AS a, y.order_index AS b, o, CASE WHEN o IN ('TH', 'TT') THEN x.s + r ELSE x.e - 1 - r END AS i, CASE WHEN o IN ('HT', 'TT') THEN y.e - 1 - (d - r) ELSE y.s + (d - r) END AS j, CASE WHEN r > 0 AND r < d THEN 2 ELSE 1 END AS w, d
 FROM cr x JOIN cr y ON x.order_index < y.order_index AND x.e - x.s >= 4 AND y.e - y.s >= 4, (VALUES ('HH'), ('HT'), ('TH'), ('TT')) t(o), (SELECT CAST(range AS INT) AS d FROM range(1, 51)), (SELECT CAST(range AS INT) AS r FROM range(0, 51)) WHERE d <= least(x.e - x.s, y.e - y.s) AND r <= d),
bd AS (SELECT a, b, o, d, sum(coalesce(v, 0)*w)/sum(w) AS ob FROM pt LEFT JOIN sym ON sym.i = pt.i AND sym.j = pt.j WHERE pt.i >= 0 AND pt.i < 128 AND pt.j >= 0 AND pt.j < 128 GROUP BY a, b, o, d),
sc AS (SELECT a, b, o AS orientation, sum(greatest(0, least(1, 1 - abs(ob - mean)/mean))/sqrt(d))/sum(1/sqrt(d)) AS score FROM bd JOIN pf USING (d) WHERE mean > 0 GROUP BY a, b, o) """


def _scores(spark, sf_dir):
    return links.link_scores(inputs.contact(spark, sf_dir), inputs.ranges(spark, sf_dir), NB)


def _best(spark, sf_dir):
    """The best links, written once: the threshold and the chains read them."""
    cm = written(inputs.contact(spark, sf_dir), "map")
    return written(links.best_links(links.link_scores(cm, inputs.ranges(spark, sf_dir), NB)), "links")


@query(LINKS + "SELECT a, b, orientation, round(score, 6) AS score FROM sc", "cm", "sym", "cr", "own")
def link_scores(spark, sf_dir):
    return _scores(spark, sf_dir).withColumn("score", r("score"))


@query(LINKS + "SELECT a, b, orientation, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY score DESC, orientation) AS k FROM sc) WHERE k = 1 AND score >= 0.05", "cm", "sym", "cr", "own")
def best_links(spark, sf_dir):
    return links.best_links(_scores(spark, sf_dir)).withColumn("score", r("score"))


@query()
def segment_chains(spark, sf_dir):
    best = _best(spark, sf_dir)
    return links.chains(best, inputs.segments(spark, sf_dir), links.adaptive_threshold(best))


CENTRO = """, sg AS (SELECT *, e - s AS w, greatest(2, floor((e - s)*0.15)) AS reach, greatest(1, floor((e - s)*0.1 + 0.5)) AS rad FROM crt WHERE e - s >= 16),
ob AS (SELECT order_index, p, s, e, w, reach, rad FROM sg JOIN bins ON p >= s AND p < e),
iv AS (SELECT order_index, p, any_value(w) AS w, any_value(rad) AS rad, sum(CASE WHEN j < s OR j >= e THEN v ELSE 0 END) AS inter, sum(CASE WHEN j - p BETWEEN 1 AND reach AND j < e THEN v ELSE 0 END) AS diag FROM ob LEFT JOIN sym ON i = p GROUP BY order_index, p),
an AS (SELECT order_index, p, sum(v) AS antis FROM ob JOIN sym ON i = s + e - p WHERE s + e - p < e AND j - p BETWEEN 1 AND reach AND j < e GROUP BY order_index, p),
bb AS (SELECT order_index, p, w, rad, inter, CASE WHEN diag > 0 THEN coalesce(antis, 0)/diag ELSE 0 END AS ratio, sum(inter) OVER (PARTITION BY order_index)/(w*greatest(1, 128 - w)) AS level FROM iv LEFT JOIN an USING (order_index, p)),
xx AS (SELECT order_index, p, rad, 0.7*CASE WHEN stddev_pop(inter) OVER q > 1e-12 THEN (inter - avg(inter) OVER q)/stddev_pop(inter) OVER q ELSE 0 END + 0.3*CASE WHEN stddev_pop(ratio) OVER q > 1e-12 THEN (ratio - avg(ratio) OVER q)/stddev_pop(ratio) OVER q ELSE 0 END AS x FROM bb WHERE level >= 0.02*(SELECT sum(v)/(128*128) FROM sym) WINDOW q AS (PARTITION BY order_index)),
sm AS (SELECT a.order_index, a.p, sum(exp(-power(b.p - a.p, 2)/(2*power(a.rad/3.0, 2)))*b.x)/sum(exp(-power(b.p - a.p, 2)/(2*power(a.rad/3.0, 2)))) AS sv FROM xx a JOIN xx b ON a.order_index = b.order_index AND abs(b.p - a.p) <= a.rad GROUP BY a.order_index, a.p),
zz AS (SELECT order_index, p, (sv - avg(sv) OVER q)/stddev_pop(sv) OVER q AS z FROM sm WINDOW q AS (PARTITION BY order_index)),
pk AS (SELECT order_index, p, z, coalesce(z > lag(z) OVER w AND z > lead(z) OVER w, false) AS inn, min(z) OVER (PARTITION BY order_index ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l, min(z) OVER (PARTITION BY order_index ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM zz WINDOW w AS (PARTITION BY order_index ORDER BY p)),
tp AS (SELECT order_index, p, z - greatest(coalesce(l, z), coalesce(r, z)) AS pr FROM (SELECT *, row_number() OVER (PARTITION BY order_index ORDER BY inn DESC, z DESC, p) AS k FROM pk) WHERE k = 1)
SELECT order_index, p, round(pr, 6) AS prominence, round(least(1, pr/3), 6) AS confidence FROM tp WHERE pr >= 0.5"""


@query(CENTRO, "sym", "crt", "bins")
def centromeres(spark, sf_dir):
    out = detect.centromeres(inputs.contact(spark, sf_dir), inputs.ranges(spark, sf_dir, "p_type"), NB)
    return out.select("order_index", "p", r("prominence").alias("prominence"), r("confidence").alias("confidence"))


def _flags(spark, sf_dir):
    dom = windows.boundaries(windows.normalised_insulation(windows.insulation(inputs.contact(spark, sf_dir), NB)), prominence=0.01)
    t = inputs.track(spark, sf_dir)
    e1 = t.select("p", (F.col("value") - F.avg("value").over(W.Window.partitionBy())).alias("e1"))
    return detect.misassemblies(dom, e1, inputs.ranges(spark, sf_dir, "p_type")), e1


def _matching(k: int) -> str:
    """Round k of mutually nearest pairs, and the pairs that it leaves; the given tables need fewer than five."""
    rank = lambda own, other, name: f"row_number() OVER (PARTITION BY c, {own} ORDER BY abs(pa - pb), {other}) AS {name}"
    left = " AND ".join(f"(c, {p}) NOT IN (SELECT (c, {p}) FROM m{k})" for p in ("pa", "pb"))
    return f"r{k} AS (SELECT *, {rank('pa', 'pb', 'ka')}, {rank('pb', 'pa', 'kb')} FROM c{k}), m{k} AS (SELECT * FROM r{k} WHERE ka = 1 AND kb = 1), c{k + 1} AS (SELECT c, pa, pb, x, y FROM r{k} WHERE {left})"


MISASSEMBLY = """, bo AS (SELECT p, strength FROM (SELECT p, norm, lag(norm) OVER (ORDER BY p) AS a, lead(norm) OVER (ORDER BY p) AS b, least(max(norm) OVER (ORDER BY p ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), max(norm) OVER (ORDER BY p ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)) - norm AS strength FROM insn) WHERE norm < a AND norm < b AND strength >= 0.01),
ev AS (SELECT p, value - avg(value) OVER () AS e1 FROM tr),
fl AS (SELECT p, abs(e1 - b) AS strength FROM (SELECT p, e1, lag(e1) OVER (ORDER BY p) AS b, max(abs(e1)) OVER () AS top FROM ev) WHERE e1*b < 0 AND abs(e1 - b) >= 0.25*top),
sa AS (SELECT c, p, strength, e - s AS span FROM bo JOIN ownt ON bin = p WHERE e - s >= 5 AND p - s >= 2 AND e - p > 2),
sb AS (SELECT c, p, strength, e - s AS span FROM fl JOIN ownt ON bin = p WHERE e - s >= 5 AND p - s >= 2 AND e - p > 2),
c1 AS (SELECT sa.c, sa.p AS pa, sb.p AS pb, sa.strength AS x, sb.strength AS y FROM sa JOIN sb ON sa.c = sb.c AND abs(sa.p - sb.p) <= 3),
""" + ", ".join(_matching(k) for k in range(1, 6)) + ", mg AS (" + " UNION ALL ".join(f"SELECT c, pa, pb, x, y FROM m{k}" for k in range(1, 6)) + """),
fg AS (SELECT c AS order_index, CAST(floor((pa + pb)/2.0 + 0.5) AS INT) AS p, 'both' AS reason, x + y AS strength FROM mg UNION ALL SELECT c, p, 'tad_boundary', strength FROM sa WHERE span >= 10 AND (c, p) NOT IN (SELECT (c, pa) FROM mg) UNION ALL SELECT c, p, 'compartment_switch', strength FROM sb WHERE span >= 10 AND (c, p) NOT IN (SELECT (c, pb) FROM mg)) """


@query(MISASSEMBLY + "SELECT order_index, p, reason, round(strength, 4) AS strength FROM fg", "insn", "tr", "ownt")
def misassemblies(spark, sf_dir):
    return _flags(spark, sf_dir)[0].withColumn("strength", r("strength", 4))


@query(MISASSEMBLY + ", jp AS (SELECT p, coalesce(abs(e1 - lag(e1) OVER (ORDER BY p)), 0) AS jump FROM ev), cc AS (SELECT f.order_index, greatest(1, least(e - s - 1, f.p - s)) AS offset_, 0.6*strength/max(strength) OVER () + 0.4*tanh(2*coalesce(jump, 0)) AS c FROM fg f JOIN crt USING (order_index) LEFT JOIN jp ON jp.p = f.p) SELECT order_index, offset_ AS \"offset\", round(c, 6) AS confidence, CASE WHEN c >= 0.7 THEN 'high' WHEN c >= 0.4 THEN 'medium' ELSE 'low' END AS level FROM cc", "insn", "tr", "ownt", "crt")
def cut_suggestions(spark, sf_dir):
    flags, e1 = _flags(spark, sf_dir)
    return detect.cut_suggestions(flags, inputs.ranges(spark, sf_dir, "p_type"), e1).withColumn("confidence", r("confidence"))


#: A new order by length, longest first; every second segment turned.
REORDER = """, od AS (SELECT order_index, CAST(row_number() OVER (ORDER BY length DESC, order_index) - 1 AS INT) AS ni, order_index % 2 = 1 AS inv FROM cr),
ds AS (SELECT s, e, inv, CAST(floor((sum(length) OVER (ORDER BY ni) - length)*128.0/(SELECT sum(length) FROM seg) + 0.5) AS INT) AS ns, CAST(floor(sum(length) OVER (ORDER BY ni)*128.0/(SELECT sum(length) FROM seg) + 0.5) AS INT) AS ne FROM cr JOIN od USING (order_index)),
rt AS (SELECT p AS dest, CASE WHEN inv THEN e - 1 - least(p - ns, e - s - 1) ELSE s + least(p - ns, e - s - 1) END AS src FROM ds JOIN bins ON p >= ns AND p < ne WHERE e > s) """


def _table(spark, sf_dir):
    s = inputs.segments(spark, sf_dir)
    k = F.row_number().over(W.Window.orderBy(F.col("length").desc(), "order_index")) - 1
    order = s.select("order_index", k.cast("int").alias("new_index"), (F.col("order_index") % 2 == 1).alias("inverted"))
    return remap.remap_table(s, order, NB)


@query(REORDER + "SELECT dest, src FROM rt", "seg", "cr", "bins")
def remap_table(spark, sf_dir):
    return _table(spark, sf_dir)


TRACKS = ", k AS (SELECT 'cov' AS name, p AS pos, CAST(floor(value) AS INT) AS value FROM tr UNION ALL SELECT 'telomeres_gap', p, CAST(floor(value) AS INT) % 3 - 1 FROM tr UNION ALL SELECT 'repeats', p, CAST(floor(value) AS INT) % 50 FROM tr UNION ALL SELECT 'flat', p, 7 FROM tr UNION ALL SELECT 'gap short', p, 1 FROM tr WHERE p > 0)"


@query(REORDER + TRACKS + f""", y AS (SELECT *, CASE WHEN name = 'cov' THEN ln(1 + greatest(value, 0)::DOUBLE) ELSE value::DOUBLE END AS x, CASE WHEN name LIKE 'telo%' THEN 'telomere' WHEN name LIKE 'gap%' THEN 'gap' WHEN name = 'cov' THEN 'coverage' WHEN name = 'repeats' THEN 'repeat' ELSE 'other' END AS kind FROM k),
z AS (SELECT name, count(*) AS n, list_sort(list(x)) AS xs FROM y GROUP BY name), e AS (SELECT name, n, xs[CAST(floor(0.01*(n - 1)) AS INT) + 1] AS lo, xs[CAST(floor(0.99*(n - 1)) AS INT) + 1] AS hi FROM z)
SELECT name, kind, dest AS p, round(CASE WHEN kind IN ('telomere', 'gap') THEN CAST(value > 0 AS INT) WHEN hi > lo THEN least(1.0, greatest(0.0, (x - lo)/(hi - lo))) ELSE 0 END, 6) AS value FROM y JOIN e USING (name) JOIN rt ON rt.src = pos WHERE n = {NB}
UNION ALL SELECT DISTINCT name, kind, NULL, NULL FROM y JOIN e USING (name) WHERE n <> {NB}""", "seg", "cr", "bins", "tr")
def embedded_track_values(spark, sf_dir):
    """Tracks that a map carries, by kind: scaled, and put in the display order; one doesn't fit."""
    t = inputs.track(spark, sf_dir)
    v = F.floor("value").cast("int")
    named = lambda name, value, rows=t: rows.select(F.lit(name).alias("name"), F.col("p").alias("pos"), value.cast("int").alias("value"))
    every = [named("cov", v), named("telomeres_gap", v % 3 - 1), named("repeats", v % 50), named("flat", F.lit(7)), named("gap short", F.lit(1), t.where("p > 0"))]
    return remap.embedded_tracks(reduce(DataFrame.unionByName, every), _table(spark, sf_dir), NB).withColumn("value", r("value"))


@query(REORDER + "SELECT a.dest AS i, z.dest AS j, v FROM sym JOIN rt a ON a.src = sym.i JOIN rt z ON z.src = sym.j WHERE a.dest <= z.dest", "seg", "cr", "bins", "sym")
def reordered_map(spark, sf_dir):
    return remap.reordered(inputs.contact(spark, sf_dir), _table(spark, sf_dir))


@query(REORDER + "SELECT dest AS p, value FROM rt JOIN tr ON p = src", "seg", "cr", "bins", "tr")
def reordered_track(spark, sf_dir):
    return remap.reordered_track(inputs.track(spark, sf_dir), _table(spark, sf_dir))


@query("SELECT CAST(range AS INT) AS t, value FROM range(300) LEFT JOIN tr ON p = least(127, floor(range*(128/300.0)))", "tr")
def rasterised_track(spark, sf_dir):
    return remap.rasterised(inputs.track(spark, sf_dir), NB, 300)


@query("SELECT p, round(CASE WHEN hi > lo THEN least(1, greatest(0, (x - lo)/(hi - lo))) ELSE 0.5 END, 6) AS value FROM (SELECT p, ln(1 + value) AS x FROM tr), (SELECT min(CASE WHEN k = floor(0.01*(n - 1)) THEN x END) AS lo, min(CASE WHEN k = floor(0.99*(n - 1)) THEN x END) AS hi FROM (SELECT ln(1 + value) AS x, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER () AS n FROM tr))", "tr")
def clipped_track(spark, sf_dir):
    return remap.clipped_unit(inputs.track(spark, sf_dir)).withColumn("value", r("value"))


@query(", en AS (SELECT p_partkey AS line, p_brand AS chrom, (p_partkey*37) % 400 AS st, (p_partkey*37) % 400 + p_size AS en, p_retailprice AS value FROM part), sc AS (SELECT *, (value - min(value) OVER ())/(max(value) OVER () - min(value) OVER ()) AS x FROM en), sp AS (SELECT line, x, s + CAST(floor(st/length::DOUBLE*(e - s)) AS INT) AS a, least(s + CAST(ceil(en/length::DOUBLE*(e - s)) AS INT), e) - 1 AS b FROM sc JOIN cr ON name = chrom WHERE e > s) SELECT p AS t, round(arg_max(x, line), 6) AS value FROM sp JOIN bins ON p >= a AND p <= b GROUP BY p", "cr", "bins")
def interval_track(spark, sf_dir):
    e = inputs.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("line"), F.col("p_brand").alias("chrom"), ((F.col("p_partkey") * 37) % 400).alias("start"), ((F.col("p_partkey") * 37) % 400 + F.col("p_size")).alias("end"), F.col("p_retailprice").alias("value"))
    return remap.intervals_to_track(e, inputs.segments(spark, sf_dir), NB).withColumn("value", r("value"))



SPLIT = """, sp AS (SELECT order_index, s, e, p AS split, (p - s) % 5 = 3 AS cand, p IN (SELECT s + floor((e - s)*k/10.0) FROM (VALUES (2), (3), (4), (5), (6), (7), (8)) t(k)) AS even FROM crt JOIN bins ON p > s AND p < e),
mn AS (SELECT order_index, split, cand, even, (SELECT coalesce(sum(v), 0) FROM cm WHERE i >= s AND i < split AND j >= split AND j < e)/((split - s)*(e - split)) AS mean FROM sp),
md AS (SELECT order_index, list_sort(list(mean)) AS m FROM mn WHERE even GROUP BY order_index)
SELECT order_index, split, round(CASE WHEN m[len(m)//2 + 1] > 0 THEN mean/m[len(m)//2 + 1] ELSE 1 END, 6) AS ratio FROM mn JOIN md USING (order_index) WHERE cand"""


@query(SPLIT, "cm", "crt", "bins")
def split_ratios(spark, sf_dir):
    from ..model import bins_of
    from ..operators import cuts

    rg = inputs.ranges(spark, sf_dir, "p_type")
    cand = bins_of(rg).where("(bin - start_bin) % 5 = 3 and bin > start_bin").select("order_index", F.col("bin").alias("split"))
    return cuts.split_ratios(inputs.contact(spark, sf_dir), rg, cand).withColumn("ratio", r("ratio"))


@query()
def automatic_cuts(spark, sf_dir):
    """Automatic cuts on the derived map with breaks put in: every 16 bins few contacts cross, and few come near.

    All limits but the sizes, which fit a map of 128 bins, are the operator's own.
    """
    from ..operators import cuts

    crosses = F.floor((F.col("i") + 8) / 16) != F.floor((F.col("j") + 8) / 16)
    near = lambda c: (F.col(c) % 16).between(6, 9)
    broken = inputs.contact(spark, sf_dir).withColumn("v", F.when(crosses | near("i") | near("j"), F.col("v") * 0.02).otherwise(F.col("v")))
    return cuts.automatic_cuts(broken, inputs.ranges(spark, sf_dir, "p_type"), NB, window=4, min_fragment=4)


@query(", q AS (SELECT order_index, greatest(s, e - 10) AS r0, e AS r1, lead(s) OVER (ORDER BY order_index) AS c0, lead(e) OVER (ORDER BY order_index) AS z FROM cr WHERE e - s >= 3), m AS (SELECT order_index, coalesce((SELECT sum(v) FROM cm WHERE i >= r0 AND i < r1 AND j >= c0 AND j < least(z, c0 + 10)), 0)/((r1 - r0)*(least(z, c0 + 10) - c0)) AS mean FROM q WHERE c0 IS NOT NULL) SELECT order_index, round(mean, 6) AS mean, mean < (SELECT least(0.3*avg(mean), quantile_cont(mean, 0.25)) FROM m) AS \"end\" FROM m", "cm", "cr")
def chromosome_ends(spark, sf_dir):
    from ..operators import cuts

    return cuts.chromosome_ends(inputs.contact(spark, sf_dir), inputs.ranges(spark, sf_dir)).withColumn("mean", r("mean"))


SIZES = """WITH RECURSIVE l AS (SELECT row_number() OVER (ORDER BY p_size) - 1 AS k, CAST(sum(p_size) AS BIGINT) AS length FROM part GROUP BY p_size),
w AS (SELECT k, CAST(floor((sum(length) OVER (ORDER BY k) - length)*{n}.0/(SELECT sum(length) FROM l) + 0.5) AS INT) AS s, CAST(floor(sum(length) OVER (ORDER BY k)*{n}.0/(SELECT sum(length) FROM l) + 0.5) AS INT) AS e FROM l),
m(k, first, st) AS (SELECT k, k, s FROM w WHERE k = 0 UNION ALL SELECT w.k, CASE WHEN w.e - w.s >= 3 OR p.e - p.s >= 3 OR p.e - m.st >= 3 THEN w.k ELSE m.first END, CASE WHEN w.e - w.s >= 3 OR p.e - p.s >= 3 OR p.e - m.st >= 3 THEN w.s ELSE m.st END FROM m JOIN w p ON p.k = m.k JOIN w ON w.k = m.k + 1),
g AS (SELECT first, min(s) AS s, max(e) AS e FROM m JOIN w USING (k) GROUP BY first HAVING max(e) - min(s) >= 3 OR max(k) < (SELECT max(k) FROM w)),
b AS (SELECT l_orderkey AS o, CAST(floor(l_partkey*{n}/((SELECT max(p_partkey) FROM part)+1.0)) AS INT) AS bin FROM lineitem), cm AS (SELECT x.bin AS i, y.bin AS j, count(*)::DOUBLE AS v FROM b x JOIN b y ON x.o = y.o AND x.bin <= y.bin AND y.bin - x.bin <= 24 GROUP BY x.bin, y.bin),
q AS (SELECT *, least(10, e - s, e2 - s2) AS z FROM (SELECT s, e, lead(first) OVER (ORDER BY first) AS nxt, lead(s) OVER (ORDER BY first) AS s2, lead(e) OVER (ORDER BY first) AS e2 FROM g) WHERE nxt IS NOT NULL),
x AS (SELECT nxt, CASE WHEN z > 0 THEN coalesce((SELECT sum(v * {factor}) FROM cm WHERE i >= e - z AND i < e AND j >= s2 AND j < s2 + z), 0)/(z*z) ELSE 0 END AS signal FROM q),
t AS (SELECT least(0.3*avg(signal), list_sort(list(signal))[CAST(floor(count(*)*0.25) AS INT) + 1]) AS lim FROM x WHERE signal > 0),
c AS (SELECT count(*) FILTER (signal < lim) AS low, count(*) AS n FROM x, t)
SELECT 0 AS order_index, CAST(NULL AS DOUBLE) AS signal, 0 AS pass UNION ALL SELECT CAST(nxt AS INT), round(signal, 6), CASE WHEN signal < lim THEN 1 ELSE 2 END FROM x, t, c WHERE signal < lim OR low = 0 AND n > 5 AND signal < 2*lim"""


def _sizes(spark, sf_dir):
    """Segments are sizes of parts: small sizes are narrower than a bin."""
    from ..model import place

    s = inputs.read(spark, sf_dir, "part").groupBy("p_size").agg(F.sum("p_size").cast("long").alias("length"))
    return place(s.select((F.row_number().over(W.Window.orderBy("p_size")) - 1).cast("int").alias("order_index"), F.col("p_size").cast("string").alias("name"), "length"), NB)


@query(SIZES.format(n=NB, factor="CASE WHEN i < 64 AND j >= 56 OR i < 104 AND j >= 96 THEN 0.005 ELSE 1 END"))
def chromosome_boundaries(spark, sf_dir):
    """Ends of chromosomes on the derived map with hardly any contacts across two places; narrow segments put together."""
    return _chromosomes(spark, sf_dir, 0.005, 4)


@query(SIZES.format(n=NB, factor="CASE WHEN i < 60 AND j >= 60 OR i < 100 AND j >= 100 THEN 0.05 ELSE 1 END"))
def chromosome_boundaries_second_pass(spark, sf_dir):
    """The same with more contacts: the first pass finds no end, the second one asks for less."""
    return _chromosomes(spark, sf_dir, 0.05, 0)


def _chromosomes(spark, sf_dir, factor, margin):
    from ..operators import cuts

    far = lambda p: (F.col("i") < p + margin) & (F.col("j") >= p - margin)
    cm = inputs.contact(spark, sf_dir).withColumn("v", F.when(far(60) | far(100), F.col("v") * factor).otherwise(F.col("v")))
    return cuts.chromosome_boundaries(cm, _sizes(spark, sf_dir)).withColumn("signal", r("signal"))


@query()
def merged_chains(spark, sf_dir):
    """Chains of the derived map, merged further and laid out as an order."""
    best = _best(spark, sf_dir)
    t = links.adaptive_threshold(best)
    return links.ordered_segments(links.merged_chains(links.chains(best, inputs.segments(spark, sf_dir), t), best, t))
