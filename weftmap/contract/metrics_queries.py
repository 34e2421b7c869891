"""Queries over assembly and ordering metrics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..operators import metrics, windows
from . import inputs
from .queries import query, r

NX = "(SELECT min(CASE WHEN cum - {l} < {q}*tot THEN {l} END) AS n, count(CASE WHEN cum - {l} < {q}*tot THEN 1 END) AS k FROM (SELECT {l}, sum({l}) OVER (ORDER BY {l} DESC, {id} ROWS UNBOUNDED PRECEDING) AS cum, sum({l}) OVER () AS tot FROM {t}))"


def _parts(spark, sf_dir):
    """Parts as segments: length from size, scaffold from brand; some unassigned."""
    p = inputs.read(spark, sf_dir, "part")
    scaffold = F.when(F.col("p_partkey") % 7 != 0, F.substring("p_brand", 7, 2).cast("int"))
    return p.select(F.col("p_partkey").alias("order_index"), (F.col("p_size") * 1000 + F.col("p_partkey") % 1000).cast("long").alias("length"), scaffold.alias("scaffold_id"))


SEG = "sg AS (SELECT p_partkey AS id, CAST(p_size*1000 + p_partkey % 1000 AS BIGINT) AS len, CASE WHEN p_partkey % 7 <> 0 THEN CAST(substr(p_brand, 7, 2) AS INT) END AS sc FROM part), sw AS (SELECT CASE WHEN sc IS NULL THEN 'c' || id ELSE 's' || sc END AS id, CAST(sum(len) AS BIGINT) AS len FROM sg GROUP BY 1)"


@query(f"WITH {SEG} SELECT b.*, CAST(n5.n AS BIGINT) AS n50, CAST(n5.k AS BIGINT) AS l50, CAST(n9.n AS BIGINT) AS n90, CAST(n9.k AS BIGINT) AS l90, round((SELECT sum(len::DOUBLE*len)/sum(len) FROM sw), 4) AS scaffold_aun, (SELECT max(len) FROM sw) AS largest_scaffold, CAST(ns.n AS BIGINT) AS scaffold_n50, CAST(ns.k AS BIGINT) AS scaffold_l50 FROM (SELECT count(*) AS count, CAST(sum(len) AS BIGINT) AS total, min(len) AS shortest, max(len) AS longest, round(avg(len), 4) AS mean, median(len) AS median, round(sum(len::DOUBLE*len)/sum(len), 4) AS aun, count(DISTINCT sc) AS scaffolds, round(sum(CASE WHEN sc IS NOT NULL THEN len END)/sum(len)::DOUBLE, 6) AS assigned FROM sg) b, {NX.format(l='len', q='0.5', id='id', t='sg')} n5, {NX.format(l='len', q='0.9', id='id', t='sg')} n9, {NX.format(l='len', q='0.5', id='id', t='sw')} ns")
def assembly_metrics(spark, sf_dir):
    m = metrics.assembly_metrics(_parts(spark, sf_dir))
    return m.withColumns({"mean": r("mean", 4), "aun": r("aun", 4), "scaffold_aun": r("scaffold_aun", 4), "assigned": r("assigned")})


@query("WITH h AS (SELECT o_orderstatus AS st, count(*) AS n, max(o_orderkey) AS seq FROM orders GROUP BY o_orderstatus) SELECT (SELECT count(*) FROM h) AS snapshots, (SELECT n FROM h ORDER BY seq DESC LIMIT 1) - (SELECT n FROM h ORDER BY seq LIMIT 1) AS n_change")
def metric_changes(spark, sf_dir):
    h = inputs.read(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("seq"))
    return metrics.metric_changes(h, "n")


def _ranks(spark, sf_dir):
    """Suppliers in order of balance against order of key, by nation."""
    s = inputs.read(spark, sf_dir, "supplier")
    w = W.Window.partitionBy("s_nationkey")
    return s.select(F.col("s_nationkey").alias("grp"), F.row_number().over(w.orderBy("s_acctbal", "s_suppkey")).alias("pos"), F.row_number().over(w.orderBy("s_suppkey")).alias("truth"))


RANK = "WITH q AS (SELECT s_nationkey AS grp, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS pos, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS truth FROM supplier) "


@query(RANK + "SELECT grp, items, round(CASE WHEN items > 1 THEN coalesce(s, 0)/(items*(items - 1)/2.0) ELSE 1 END, 6) AS tau FROM (SELECT grp, count(*) AS items FROM q GROUP BY grp) LEFT JOIN (SELECT a.grp AS g, sum(sign(b.truth - a.truth)) AS s FROM q a JOIN q b ON a.grp = b.grp AND a.pos < b.pos GROUP BY a.grp) ON g = grp")
def kendall_tau(spark, sf_dir):
    return metrics.kendall_tau(_ranks(spark, sf_dir), "grp").withColumn("tau", r("tau"))


@query("WITH q AS (SELECT row_number() OVER (ORDER BY c_acctbal, c_custkey) AS pos, row_number() OVER (ORDER BY c_custkey) AS truth FROM customer) SELECT count(*) AS items, round((SELECT sum(sign(b.truth - a.truth)) FROM q a JOIN q b ON a.pos < b.pos)/(count(*)*(count(*) - 1)/2.0), 6) AS tau FROM q")
def kendall_tau_customers(spark, sf_dir):
    c = inputs.read(spark, sf_dir, "customer")
    ranked = c.select(F.row_number().over(W.Window.orderBy("c_acctbal", "c_custkey")).alias("pos"), F.row_number().over(W.Window.orderBy("c_custkey")).alias("truth"))
    return metrics.kendall_tau(ranked).withColumn("tau", r("tau"))


@query(RANK + "SELECT grp, CAST(max(n) AS BIGINT) AS longest FROM (SELECT grp, run, count(*) AS n FROM (SELECT grp, sum(st) OVER (PARTITION BY grp ORDER BY pos) AS run FROM (SELECT grp, pos, CASE WHEN coalesce(truth - lag(truth) OVER (PARTITION BY grp ORDER BY pos) <> 1, false) THEN 1 ELSE 0 END AS st FROM q)) GROUP BY grp, run) GROUP BY grp")
def longest_run(spark, sf_dir):
    return metrics.longest_run(_ranks(spark, sf_dir), "grp")


ARI = "WITH p AS (SELECT label AS truth, CASE WHEN embedding[1] > 0 THEN 1 ELSE 0 END*2 + CASE WHEN embedding[2] > 0 THEN 1 ELSE 0 END AS pred FROM embeddings), c AS (SELECT pred, truth, count(*)::DOUBLE AS c FROM p GROUP BY 1, 2), s AS (SELECT (SELECT sum(c*(c - 1)/2) FROM c) AS x, (SELECT sum(t*(t - 1)/2) FROM (SELECT sum(c) AS t FROM c GROUP BY pred)) AS a, (SELECT sum(t*(t - 1)/2) FROM (SELECT sum(c) AS t FROM c GROUP BY truth)) AS b, (SELECT sum(c) FROM c) AS n) SELECT round((x - a*b/(n*(n - 1)/2))/((a + b)/2 - a*b/(n*(n - 1)/2)), 6) AS ari FROM s"


@query(ARI)
def adjusted_rand(spark, sf_dir):
    e = F.col("embedding")
    p = inputs.read(spark, sf_dir, "embeddings").select(F.col("label").alias("truth"), ((e[0] > 0).cast("int") * 2 + (e[1] > 0).cast("int")).alias("pred"))
    return metrics.adjusted_rand(p).select(r("ari").alias("ari"))


def _items(spark, sf_dir):
    """Lines of an order as a chain, part bins as chromosomes."""
    li = inputs.read(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("chain"), (F.col("l_partkey") % 5).alias("chrom"), (F.col("l_linenumber") % 2 == 1).alias("inverted"), (F.col("l_suppkey") % 2 == 1).alias("truth_inverted"), F.col("l_quantity").cast("long").alias("length"))


ITEMS = "WITH t AS (SELECT l_orderkey AS chain, l_partkey % 5 AS chrom, l_linenumber % 2 = 1 AS inv, l_suppkey % 2 = 1 AS ti, CAST(l_quantity AS BIGINT) AS len FROM lineitem) "


@query(ITEMS + ", c AS (SELECT chain, chrom, count(*) AS c FROM t GROUP BY 1, 2) SELECT round((SELECT avg(CAST(inv = ti AS INT)) FROM t), 6) AS orientation, round((SELECT avg(q) FROM (SELECT max(c)/sum(c) AS q FROM c GROUP BY chain)), 6) AS purity, round((SELECT avg(q) FROM (SELECT max(c)/sum(c) AS q FROM c GROUP BY chrom)), 6) AS completeness".replace(") , c", "), c"))
def chain_quality(spark, sf_dir):
    return metrics.chain_quality(_items(spark, sf_dir)).select(*[r(c).alias(c) for c in ("orientation", "purity", "completeness")])


@query(ITEMS + "SELECT round(avg(best/total), 6) AS macro, round(sum(best)/sum(total), 6) AS micro, CAST(count(CASE WHEN best/total > 0.9 THEN 1 END) AS BIGINT) AS complete, count(*) AS chromosomes FROM (SELECT chrom, max(bp)::DOUBLE AS best, sum(bp)::DOUBLE AS total FROM (SELECT chrom, chain, sum(len) AS bp FROM t GROUP BY 1, 2) GROUP BY chrom)")
def chromosome_completeness(spark, sf_dir):
    return metrics.chromosome_completeness(_items(spark, sf_dir)).withColumns({"macro": r("macro"), "micro": r("micro")})


@query()
def breakpoint_scores(spark, sf_dir):
    """Hours of clicks against hours of purchases of the same user, within two hours."""
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000).cast("long")
    e = inputs.read(spark, sf_dir, "events").select(F.col("user_id").alias("grp"), "event_type", hour.alias("h"))
    found, truth = e.where("event_type = 'click'").select("grp", F.col("h").alias("p")).distinct(), e.where("event_type = 'purchase'").select("grp", F.col("h").alias("q")).distinct()
    return metrics.precision_recall(found, truth, metrics.breakpoint_matches(found, truth, 2))


@query("WITH s AS (SELECT c_nationkey AS k, round(avg(c_acctbal), 6) AS m FROM customer GROUP BY 1) SELECT round(avg(m), 4) AS mean, round(coalesce(stddev_samp(m), 0), 4) AS sd, count(*) AS n FROM s")
def bench_aggregate(spark, sf_dir):
    s = inputs.read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.round(F.avg("c_acctbal"), 6).alias("m"))
    return metrics.run_summary(s, "m").withColumns({"mean": r("mean", 4), "sd": r("sd", 4)})


HEALTH = "WITH s AS (SELECT p_brand AS name, max(p_retailprice) AS n50, CASE WHEN p_brand = 'Brand#11' THEN NULL ELSE max(p_retailprice)*2 END AS total, -avg(p_size)/25 AS ex, count(*) % 9 AS fl, avg(p_size)/100 AS ev, min(p_size) AS cb, avg(p_size)/40 AS ci FROM part GROUP BY 1), c AS (SELECT name, coalesce(CASE WHEN n50/total <= 0.1 THEN 0 ELSE least(100, greatest(0, (1 + log10(n50/total))*100)) END, 50) AS contiguity, least(100, greatest(0, 100 - abs(ex + 1.15)/0.85*100)) AS decay, least(100, greatest(0, 100 - 10*fl)) AS integrity, (least(100, 200*ev) + least(100, cb))/2 AS compartments, least(100, ci/0.7*100) AS library FROM s) SELECT name, round(contiguity, 6) AS contiguity, round(decay, 6) AS decay, round(integrity::DOUBLE, 6) AS integrity, round(compartments, 6) AS compartments, round(library, 6) AS library, CAST(floor(0.2*contiguity + 0.25*decay + 0.2*integrity + 0.15*compartments + 0.2*library + 0.5) AS BIGINT) AS overall FROM c"


@query(HEALTH)
def health_score(spark, sf_dir):
    p = inputs.read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.max("p_retailprice").alias("n50"), (-F.avg("p_size") / 25).alias("exponent"), (F.count(F.lit(1)) % 9).alias("flags"), (F.avg("p_size") / 100).alias("eigenvalue"), F.min("p_size").alias("checkerboard"), (F.avg("p_size") / 40).alias("cis_ratio"))
    h = metrics.health_score(p.withColumn("total", F.when(F.col("name") != "Brand#11", F.col("n50") * 2)))
    return h.select("name", *[r(c).alias(c) for c in ("contiguity", "decay", "integrity", "compartments", "library")], "overall")


@query("SELECT role, count(*) AS n, round(avg(length(text)), 4) AS mean_rating FROM conversations GROUP BY role")
def rating_summary(spark, sf_dir):
    rows = inputs.read(spark, sf_dir, "conversations").withColumn("rating", F.length("text"))
    return metrics.rating_summary(rows, "role", "rating").withColumn("mean_rating", r("mean_rating", 4))


@query("SELECT count(DISTINCT l_partkey) AS components, count(DISTINCT l_orderkey) AS objects, count(DISTINCT CASE WHEN l_returnflag <> 'N' THEN l_orderkey END) AS named, count(CASE WHEN l_returnflag <> 'N' THEN 1 END) AS placed FROM lineitem")
def layout_counts(spark, sf_dir):
    """Distinct components and objects of a layout, and those in named objects."""
    return metrics.layout_counts(inputs.read(spark, sf_dir, "lineitem"), "l_partkey", "l_orderkey", F.col("l_returnflag") != "N")


@query("WITH a AS (SELECT p_partkey AS k, p_size % 2 AS o FROM part WHERE p_size > 5), b AS (SELECT p_partkey AS k, p_size % 3 % 2 AS o FROM part) SELECT count(*) AS changed FROM b LEFT JOIN a USING (k) WHERE NOT (a.o IS NOT DISTINCT FROM b.o)")
def reoriented_count(spark, sf_dir):
    """Components whose orientation differs from the layout before, or is new."""
    p = inputs.read(spark, sf_dir, "part")
    a, b = p.where("p_size > 5").select(F.col("p_partkey").alias("k"), (F.col("p_size") % 2).alias("inverted")), p.select(F.col("p_partkey").alias("k"), (F.col("p_size") % 3 % 2).alias("inverted"))
    return metrics.reoriented(a, b)


SWEEP = "WITH a AS (SELECT p_size AS f, count(*) AS n, avg(p_retailprice) AS m FROM part GROUP BY 1), g AS (SELECT f, t, 0.4*(f/50.0) + 0.3*(1 - abs(t - 5)/10.0) + 0.2*(n/(SELECT max(n) FROM a)::DOUBLE) + 0.1*(m/(SELECT max(m) FROM a)) AS score FROM a, (SELECT CAST(range AS INT) AS t FROM range(1, 11))) SELECT f, t, round(score, 6) AS score FROM g ORDER BY score DESC, f, t LIMIT 20"


@query(SWEEP)
def parameter_sweep(spark, sf_dir):
    """The best settings of a grid by a weighted score of four measures; the grid is a table of parameters."""
    a = inputs.read(spark, sf_dir, "part").groupBy(F.col("p_size").alias("f")).agg(F.count(F.lit(1)).alias("n"), F.avg("p_retailprice").alias("m"))
    top = a.agg(F.max("n").alias("tn"), F.max("m").alias("tm"))
    grid = a.withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(10)))).crossJoin(F.broadcast(top))  # one row
    parts = {"size": (F.col("f") / 50.0, 0.4), "middle": (1 - F.abs(F.col("t") - 5) / 10.0, 0.3), "many": (F.col("n") / F.col("tn"), 0.2), "price": (F.col("m") / F.col("tm"), 0.1)}
    return metrics.best_settings(grid, parts, ("f", "t"), 20).withColumn("score", r("score"))


REGIONS = ", ba AS (SELECT p, density, avg(CASE WHEN density > 0 THEN density END) OVER (ORDER BY p ROWS BETWEEN 32 PRECEDING AND 32 FOLLOWING) AS base FROM dens), pa AS (SELECT * FROM (VALUES (0.01::DOUBLE), (0.02::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE)) a(cutoff), (VALUES (1), (2), (4)) b(width)), rn AS (SELECT cutoff, width, min(p) AS st, max(p) AS la, avg(density) AS mean FROM (SELECT cutoff, width, p, density, p - row_number() OVER (PARTITION BY cutoff, width ORDER BY p) AS run FROM ba, pa WHERE (base - density)/base > cutoff) GROUP BY cutoff, width, run), z AS (SELECT cutoff, width, (b.base - rn.mean)/b.base AS c FROM rn JOIN ba b ON b.p = CAST(floor((st + la + 1)/2.0) AS INT) WHERE la - st + 1 >= width) SELECT pa.cutoff, pa.width, count(c) AS regions, round(avg(c), 6) AS confidence FROM pa LEFT JOIN z USING (cutoff, width) GROUP BY 1, 2"


@query(REGIONS, "dens")
def cut_parameter_sweep(spark, sf_dir):
    """The candidates of automatic cuts under every setting of a grid, in one pass over the densities."""
    settings = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in (0.01, 0.02, 0.05, 0.1, 0.2)])).alias("cutoff")).select("cutoff", F.explode(F.array(F.lit(1), F.lit(2), F.lit(4))).alias("width"))
    rows = windows.local_baseline(windows.diagonal_density(inputs.contact(spark, sf_dir), inputs.NB), "density", 32).crossJoin(F.broadcast(settings))  # fifteen rows
    found = windows.low_regions(rows, "density", F.col("cutoff"), F.col("width"), "cutoff", "width")
    each = found.groupBy("cutoff", "width").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"))
    return settings.join(each, ["cutoff", "width"], "left").select("cutoff", "width", F.coalesce("n", F.lit(0)).cast("long").alias("regions"), r("confidence").alias("confidence"))


SORTED = "WITH t AS (SELECT row_number() OVER (ORDER BY c_acctbal, c_custkey) AS pos, row_number() OVER (ORDER BY c_custkey) AS truth, c_nationkey AS chain, c_mktsegment AS chrom, c_custkey % 2 = 1 AS inv, c_custkey % 3 = 0 AS ti FROM customer), k AS (SELECT count(*) AS items, (SELECT sum(sign(b.truth - a.truth)) FROM t a JOIN t b ON a.pos < b.pos)/(count(*)*(count(*) - 1)/2.0) AS tau FROM t), l AS (SELECT max(n) AS longest FROM (SELECT count(*) AS n FROM (SELECT sum(st) OVER (ORDER BY pos) AS run FROM (SELECT pos, CASE WHEN coalesce(truth - lag(truth) OVER (ORDER BY pos) <> 1, false) THEN 1 ELSE 0 END AS st FROM t)) GROUP BY run)), c AS (SELECT chain, chrom, count(*)::DOUBLE AS c FROM t GROUP BY 1, 2), s AS (SELECT (SELECT sum(c*(c - 1)/2) FROM c) AS x, (SELECT sum(t*(t - 1)/2) FROM (SELECT sum(c) AS t FROM c GROUP BY chain)) AS a, (SELECT sum(t*(t - 1)/2) FROM (SELECT sum(c) AS t FROM c GROUP BY chrom)) AS b, (SELECT sum(c) FROM c) AS n) SELECT items, round(tau, 6) AS tau, longest, round((x - a*b/(n*(n - 1)/2))/((a + b)/2 - a*b/(n*(n - 1)/2)), 6) AS ari, round((SELECT avg(CAST(inv = ti AS INT)) FROM t), 6) AS orientation, round((SELECT avg(q) FROM (SELECT max(c)/sum(c) AS q FROM c GROUP BY chain)), 6) AS purity, round((SELECT avg(q) FROM (SELECT max(c)/sum(c) AS q FROM c GROUP BY chrom)), 6) AS completeness FROM k, l, s"


@query(SORTED)
def combined_sort_metrics(spark, sf_dir):
    c = inputs.read(spark, sf_dir, "customer")
    items = c.select(F.row_number().over(W.Window.orderBy("c_acctbal", "c_custkey")).alias("pos"), F.row_number().over(W.Window.orderBy("c_custkey")).alias("truth"), F.col("c_nationkey").alias("chain"), F.col("c_mktsegment").alias("chrom"), (F.col("c_custkey") % 2 == 1).alias("inverted"), (F.col("c_custkey") % 3 == 0).alias("truth_inverted"))
    return metrics.sort_metrics(items).withColumns({k: r(k) for k in ("tau", "ari", "orientation", "purity", "completeness")})


@query("WITH q AS (SELECT s_nationkey AS grp, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS pos, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS truth FROM supplier), t AS (SELECT a.grp, sum(sign(b.truth - a.truth))/count(*) AS tau FROM q a JOIN q b ON a.grp = b.grp AND a.pos < b.pos GROUP BY a.grp), l AS (SELECT grp, tau, lag(tau) OVER (ORDER BY grp) AS b FROM t) SELECT grp, round(tau, 6) AS tau, round(tau - b, 6) AS change, coalesce(tau - b > 0.001, false) AS improving FROM l")
def curation_progress(spark, sf_dir):
    """Rank correlation over a series of states, and whether it improves."""
    t = metrics.kendall_tau(_ranks(spark, sf_dir), "grp").where("items > 1")
    return metrics.progress(t, "grp").select("grp", r("tau").alias("tau"), r("change").alias("change"), "improving")
