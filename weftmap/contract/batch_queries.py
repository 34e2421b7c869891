"""Queries over batch edits, scripts, replay and composed curation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..operators import batch, history, provenance, scripts
from ..plans import curate, sweep
from . import inputs
from .edit_queries import CUST, _initial, _log, _seg
from .inputs import NB
from .queries import query, r

OPS = "CAST(row_number() OVER (ORDER BY {order}) - 1 AS BIGINT) AS seq, '{op}' AS op, CAST({a} AS INT) AS a, CAST({b} AS INT) AS b"
COLUMNS = ["seq", "op", "a", "b"]


def _map(spark, sf_dir):
    """All customers as the segments of one map."""
    s = _seg(spark, sf_dir)
    return s.select(F.lit(0).cast("long").alias("map_id"), F.col("order_index").cast("int").alias("order_index"), F.col("name").alias("segment"), "length", "inverted", F.col("scaffold_id").cast("string").alias("scaffold"))


def _fold(spark, sf_dir, log):
    return provenance.fold_tree(_map(spark, sf_dir), log.withColumn("map_id", F.lit(0).cast("long"))).drop("map_id", "pieces")


def _selected(spark, sf_dir):
    return _seg(spark, sf_dir).where("length % 3 > 0").select("order_index")


@query(CUST + f"SELECT {OPS.format(order='order_index DESC', op='cut', a='order_index', b='length // 2')} FROM g WHERE length > 500000")
def cuts_by_size(spark, sf_dir):
    return batch.cut_by_size(_seg(spark, sf_dir), 500_000).select(*COLUMNS)


@query(CUST + f"SELECT {OPS.format(order='x.order_index DESC', op='join', a='x.order_index', b='0')} FROM g x JOIN g y ON y.order_index = x.order_index + 1 WHERE x.length % 3 > 0 AND y.length % 3 > 0")
def joins_of_runs(spark, sf_dir):
    return batch.join_runs(_selected(spark, sf_dir)).select(*COLUMNS)


@query(CUST + f"SELECT {OPS.format(order='order_index', op='invert', a='order_index', b='0')} FROM g WHERE length % 3 > 0")
def inversions_of_selected(spark, sf_dir):
    return batch.invert_selected(_selected(spark, sf_dir)).select(*COLUMNS)


@query(CUST + ", q AS (SELECT order_index AS k, row_number() OVER (ORDER BY length, order_index) - 1 AS t FROM g), m AS (SELECT q.t, count(x.k) AS more FROM q LEFT JOIN q x ON x.k < q.k AND x.t > q.t GROUP BY q.t) "
       f"SELECT {OPS.format(order='t', op='move', a='t + more', b='t')} FROM m WHERE more > 0")
def moves_by_length(spark, sf_dir):
    return batch.sort_by_length(_seg(spark, sf_dir)).select(*COLUMNS)


STATE = "CAST(row_number() OVER (ORDER BY {order}) - 1 AS INT) AS order_index"


@query(CUST + f"SELECT {STATE.format(order='order_index, part')}, CASE WHEN length > 500000 THEN name || CASE WHEN inverted = (part = 0) THEN '_R' ELSE '_L' END ELSE name END AS segment, CASE WHEN length <= 500000 THEN length WHEN part = 0 THEN length // 2 ELSE length - length // 2 END AS length, inverted, CAST(scaffold_id AS VARCHAR) AS scaffold FROM g, (VALUES (0), (1)) v(part) WHERE part = 0 OR length > 500000")
def segments_cut_by_size(spark, sf_dir):
    return _fold(spark, sf_dir, batch.cut_by_size(_seg(spark, sf_dir), 500_000))


@query(CUST + f", s AS (SELECT *, length % 3 > 0 AS sel FROM g), n AS (SELECT *, sum(CASE WHEN sel AND coalesce(b, false) THEN 0 ELSE 1 END) OVER (ORDER BY order_index) AS run FROM (SELECT *, lag(sel) OVER (ORDER BY order_index) AS b FROM s)) SELECT {STATE.format(order='min(order_index)')}, string_agg(name, '+' ORDER BY order_index) AS segment, CAST(sum(length) AS BIGINT) AS length, bool_and(inverted) AS inverted, arg_min(CAST(coalesce(scaffold_id, -1) AS VARCHAR), order_index) AS scaffold FROM n GROUP BY run")
def segments_joined_in_runs(spark, sf_dir):
    return _fold(spark, sf_dir, batch.join_runs(_selected(spark, sf_dir))).withColumn("scaffold", F.coalesce("scaffold", F.lit("-1")))


@query(CUST + f"SELECT {STATE.format(order='length, order_index')}, name AS segment, length, inverted <> (length % 3 > 0) AS inverted, CAST(scaffold_id AS VARCHAR) AS scaffold FROM g")
def segments_inverted_and_sorted(spark, sf_dir):
    """Inversions of the selected segments, then the moves that sort all by length."""
    return _fold(spark, sf_dir, batch.after(batch.invert_selected(_selected(spark, sf_dir)), batch.sort_by_length(_seg(spark, sf_dir))))


PARTS = """, p AS (SELECT row_number() OVER (ORDER BY order_index, part) - 1 AS place, g.*, part, length // 2 AS m FROM g, (VALUES (0), (1)) v(part) WHERE part = 0 OR length > 500000),
q AS (SELECT place, name, coalesce(CAST(scaffold_id AS VARCHAR), 'unplaced_' || place) AS object, inverted <> (place % 2 = 1) AS back,
CASE WHEN length <= 500000 THEN 0 WHEN part = 0 THEN CASE WHEN inverted THEN length - m ELSE 0 END ELSE CASE WHEN inverted THEN 0 ELSE m END END AS s,
CASE WHEN length <= 500000 THEN length WHEN part = 0 THEN CASE WHEN inverted THEN length ELSE m END ELSE CASE WHEN inverted THEN length - m ELSE length END END AS e FROM p) """


@query(CUST + PARTS + "SELECT object, CAST(row_number() OVER w AS INT) AS part, CAST(sum(e - s) OVER w - (e - s) + 1 AS BIGINT) AS object_start, CAST(sum(e - s) OVER w AS BIGINT) AS object_end, name AS source, s + 1 AS source_start, e AS source_end, CASE WHEN back THEN '-' ELSE '+' END AS orientation FROM q WINDOW w AS (PARTITION BY object ORDER BY place)")
def layout_after_edits(spark, sf_dir):
    """Cuts by size, then every second segment turned: the layout names where all parts come from."""
    cuts = batch.cut_by_size(_seg(spark, sf_dir), 500_000)
    n = _seg(spark, sf_dir).count() + cuts.count()
    turns = batch.invert_selected(spark.range(n // 2).select((2 * F.col("id") + 1).alias("order_index")))
    states = provenance.fold_tree(_map(spark, sf_dir), batch.after(cuts, turns).withColumn("map_id", F.lit(0).cast("long")))
    return provenance.layout_rows(states).drop("map_id").withColumnsRenamed({"start": "source_start", "end": "source_end"})


@query("WITH o AS (SELECT DISTINCT user_id AS map_id, 1 + event_id * 7919 % 999983 AS b FROM events), k AS (SELECT map_id, b, row_number() OVER (PARTITION BY map_id ORDER BY b) AS k FROM o), "
       "e AS (SELECT map_id, 0 AS k, 0 AS s UNION ALL SELECT map_id, k, b FROM k), s AS (SELECT map_id, k, s, coalesce(lead(s) OVER (PARTITION BY map_id ORDER BY k), 1000000) AS e FROM e) "
       "SELECT map_id, CAST(greatest(k - 1, 0) AS INT) AS order_index, CASE WHEN k = 0 THEN 1 ELSE 0 END AS part, 'whole' AS source, s AS piece_start, e AS piece_end, k < 2 AS reversed FROM s".replace("SELECT map_id, 0 AS k, 0 AS s UNION ALL", "SELECT DISTINCT map_id, 0 AS k, 0 AS s FROM o UNION ALL"))
def pieces_after_edits(spark, sf_dir):
    """A map a user: one segment cut at many places, its first two parts joined, and the joined one turned."""
    e = inputs.read(spark, sf_dir, "events").select(F.col("user_id").alias("map_id"), (1 + F.col("event_id") * 7919 % 999983).alias("b")).distinct()
    none = F.lit(None).cast("string")
    cuts = e.select("map_id", F.row_number().over(W.Window.partitionBy("map_id").orderBy(F.desc("b"))).cast("long").alias("seq"), F.lit("cut").alias("op"), F.lit(0).alias("a"), "b", none.alias("text"))
    ends = e.groupBy("map_id").agg(F.count(F.lit(1)).alias("n"))
    more = [ends.select("map_id", (F.col("n") + k).alias("seq"), F.lit(op).alias("op"), F.lit(0).alias("a"), F.lit(0).cast("long").alias("b"), none.alias("text")) for k, op in ((1, "join"), (2, "invert"))]
    initial = ends.select("map_id", F.lit(0).alias("order_index"), F.lit("whole").alias("segment"), F.lit(1_000_000).cast("long").alias("length"), F.lit(False).alias("inverted"), none.alias("scaffold"))
    states = provenance.fold_tree(initial, cuts.unionByName(more[0]).unionByName(more[1]))
    return provenance.pieces_of(states).withColumnsRenamed({"start": "piece_start", "end": "piece_end"})


SCRIPT = ["assert contigs >= 60", "assert n50 > 700 kb", "assert length < 30Mb", "assert scaffolds == 5", "select where length > 500kb", "select where inverted", "select where unscaffolded", "invert #0", "select where inverted", "select #0..#4", "cut #0 0", "join #0 #2", "assert scaffolds < 9", "scaffold delete building", "assert scaffolds == 4", "select where scaffolded", "select all", "echo done", "frob #1"]
SCRIPT_SQL = """WITH g AS (SELECT c_nationkey AS m, c_custkey AS k, CAST(floor(abs(c_acctbal)*100) AS BIGINT) AS len, c_custkey % 2 = 1 AS inv, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS sc, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS place FROM customer),
c AS (SELECT *, sum(len) OVER (PARTITION BY m ORDER BY len DESC, k) AS cum, sum(len) OVER (PARTITION BY m) AS total FROM g),
s AS (SELECT m, count(*) AS n, max(len) FILTER (2*cum >= total) AS n50, any_value(total) AS total, count(DISTINCT sc) AS scs, count(*) FILTER (len > 500000) AS longer, count(*) FILTER (inv) AS invs, count(*) FILTER (sc IS NULL) AS free, bool_or(inv AND place = 1) AS first, count(*) FILTER (sc IS NOT NULL AND sc <> 'BUILDING') AS kept, bool_or(coalesce(sc = 'BUILDING', false)) AS building FROM c GROUP BY m),
l AS (SELECT m, CAST(t.line AS BIGINT) AS line, t.command, t.success, CAST(t.value AS DOUBLE) AS value FROM s, LATERAL (VALUES
(1, 'assert', n >= 60, n), (2, 'assert', n50 > 700000, n50), (3, 'assert', total < 30000000, total), (4, 'assert', scs = 5, scs), (5, 'select_where', true, longer), (6, 'select_where', true, invs), (7, 'select_where', true, free),
(8, 'invert', true, NULL), (9, 'select_where', true, invs + CASE WHEN first THEN -1 ELSE 1 END), (10, 'select_range', n >= 5, CASE WHEN n >= 5 THEN 5 END), (11, 'cut', false, NULL), (12, 'join', false, NULL), (13, 'assert', scs < 9, scs), (14, 'scaffold_delete', building, NULL),
(15, 'assert', scs - CAST(building AS INT) = 4, scs - CAST(building AS INT)), (16, 'select_where', true, kept), (17, 'select_all', true, n), (18, 'echo', true, NULL), (19, 'error', false, NULL)) t(line, command, success, value))
SELECT m AS map_id, line, command, success, value FROM l"""


@query(SCRIPT_SQL)
def script_results(spark, sf_dir):
    """One script on the map of every nation: assertions, selections, and edits that succeed or fail, all of it run."""
    return _scripted(spark, sf_dir, True)


@query(f"WITH r AS ({SCRIPT_SQL}) SELECT map_id, line, command, success, value FROM r WHERE line <= (SELECT coalesce(min(f.line), 1000) FROM r f WHERE f.map_id = r.map_id AND NOT f.success)")
def halted_scripts(spark, sf_dir):
    """The same script, which ends at the first failure on each map."""
    return _scripted(spark, sf_dir, False)


def _scripted(spark, sf_dir, go_on):
    c = inputs.read(spark, sf_dir, "customer")
    place = (F.row_number().over(W.Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1).alias("order_index")
    segments = c.select(F.col("c_nationkey").cast("long").alias("map_id"), place, F.col("c_name").alias("segment"), F.floor(F.abs("c_acctbal") * 100).cast("long").alias("length"), (F.col("c_custkey") % 2 == 1).alias("inverted"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("scaffold"))
    lines = spark.range(1).select(F.posexplode(F.array(*[F.lit(x) for x in SCRIPT]))).select((F.col("pos") + 1).cast("long").alias("line"), F.col("col").alias("body"))
    commands = segments.select("map_id").distinct().crossJoin(F.broadcast(history.commands(lines)))  # a fixed script
    return scripts.results(scripts.execute(segments, commands, continue_on_error=go_on))


@query()
def executed_scripts(spark, sf_dir):
    """The log written as scripts, read, and run: the same states as the fold of the log."""
    log = _log(spark, sf_dir)
    lines = history.as_script(log).select(F.col("map_id"), F.col("seq").alias("line"), F.col("command").alias("body"))
    named = lines.select("map_id").distinct().select("map_id", F.lit(-1).cast("long").alias("line"), F.lit("scaffold create chr1").alias("body"))
    commands = history.commands(lines.unionByName(named), "map_id")
    return scripts.final(scripts.execute(_initial(spark, sf_dir), commands, continue_on_error=True))


@query("SELECT user_id AS map_id, max(event_id) AS seq, user_id % 7 <> 0 AS matches FROM events GROUP BY user_id")
def replay_check(spark, sf_dir):
    """Every log replayed against a snapshot of its end; every seventh snapshot is spoilt."""
    log, start = _log(spark, sf_dir), _initial(spark, sf_dir)
    seen = history.digests(history.fold(start, log)).withColumn("digest", F.when(F.col("map_id") % 7 == 0, F.reverse("digest")).otherwise(F.col("digest")))
    recorded = seen.join(log.groupBy("map_id").agg(F.max("seq").alias("seq")), "map_id")
    return history.replay(start, log, recorded)


def _broken(spark, sf_dir):
    """The derived map with breaks put in: every 16 bins few contacts cross, and few come near."""
    crosses = F.floor((F.col("i") + 8) / 16) != F.floor((F.col("j") + 8) / 16)
    near = lambda c: (F.col(c) % 16).between(6, 9)
    return inputs.contact(spark, sf_dir).withColumn("v", F.when(crosses | near("i") | near("j"), F.col("v") * 0.02).otherwise(F.col("v")))


def _curated(spark, sf_dir, **how):
    """Cuts under the operator's own limits but the sizes, which fit a map of 128 bins, and an order."""
    return curate.curated(_broken(spark, sf_dir), inputs.ranges(spark, sf_dir, "p_type"), NB, window=4, min_fragment=4, **how)


@query()
def curated_segments(spark, sf_dir):
    """Automatic cuts, then parts ordered inside the segments that they were cut from, applied as an edit log."""
    log, _ = _curated(spark, sf_dir, by="whole")
    return curate.applied(inputs.ranges(spark, sf_dir, "p_type"), log).drop("map_id")


@query()
def curation_scores(spark, sf_dir):
    """The composed run: cuts, the order of all parts, and its score."""
    return curate.sort_scores(_curated(spark, sf_dir, least_segments=0)[1]).select("items", r("tau").alias("tau"), "longest", "neighbours", r("orientation").alias("orientation"))


@query()
def scaffold_orders(spark, sf_dir):
    """Brands ordered inside their scaffolds by the links of the derived map."""
    return curate.scaffold_order(inputs.contact(spark, sf_dir), inputs.ranges(spark, sf_dir), NB, "scaffold_id")


@query()
def sort_sweep(spark, sf_dir):
    """27 settings of the automatic order of brands on the derived map, scored in one run; the truth is the order on the map."""
    ranges = inputs.ranges(spark, sf_dir)
    found = sweep.orders(inputs.contact(spark, sf_dir), ranges, NB, sweep.grid())
    truth = ranges.select("order_index", F.col("order_index").alias("place"), F.coalesce("scaffold_id", F.lit(0)).alias("chromosome"), F.lit(False).alias("inverted"))
    return sweep.scores(found, truth).select("setting", "items", "chains", *[r(c).alias(c) for c in ("tau", "ari", "orientation", "score")])
