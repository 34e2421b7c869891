"""Queries over selections, edit logs, text formats, sequences and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import sequences
from ..operators import history, select, windows
from ..plans import summary
from ..sinks import text as sink
from ..sources import text as source
from ..streaming import logs
from . import inputs
from .inputs import NB
from .queries import query, r


def _seg(spark, sf_dir):
    """Every customer as a segment."""
    c = inputs.read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("order_index"), F.col("c_name").alias("name"), F.floor(F.abs("c_acctbal") * 100).cast("long").alias("length"), (F.col("c_custkey") % 2 == 1).alias("inverted"), F.when(F.col("c_nationkey") < 20, F.col("c_nationkey")).alias("scaffold_id"))


CUST = "WITH g AS (SELECT c_custkey AS order_index, c_name AS name, CAST(floor(abs(c_acctbal)*100) AS BIGINT) AS length, c_custkey % 2 = 1 AS inverted, CASE WHEN c_nationkey < 20 THEN c_nationkey END AS scaffold_id FROM customer) "


@query(CUST + "SELECT order_index, name FROM g WHERE name LIKE 'Customer%7%' OR length BETWEEN 100000 AND 200000")
def select_by_name_and_size(spark, sf_dir):
    return _seg(spark, sf_dir).where(select.glob(F.col("name"), "Customer*7*") | select.size_between(100000, 200000)).select("order_index", "name")


@query(CUST + "SELECT order_index, scaffold_id IS NOT NULL AS scaffolded, inverted FROM g WHERE length >= 300000 AND (inverted OR scaffold_id IS NULL)")
def select_where(spark, sf_dir):
    limit = select.base_pairs(F.lit("300 kb"))
    s = _seg(spark, sf_dir).where(F.col("length") >= limit)
    return s.where(F.col("inverted") | F.col("scaffold_id").isNull()).select("order_index", F.col("scaffold_id").isNotNull().alias("scaffolded"), "inverted")


@query("WITH r AS (SELECT DISTINCT CASE WHEN n_nationkey % 3 = 0 THEN '#' || n_nationkey WHEN n_nationkey % 3 = 1 THEN lower(n_name) ELSE n_name || 'x' END AS ref FROM nation) SELECT ref, CAST(coalesce(a.n_nationkey, b.n_nationkey, -1) AS INT) AS order_index, CASE WHEN a.n_nationkey IS NULL AND b.n_nationkey IS NULL THEN 'unknown' ELSE 'found' END AS status FROM r LEFT JOIN nation a ON ref = '#' || a.n_nationkey LEFT JOIN nation b ON lower(ref) = lower(b.n_name)")
def resolved_references(spark, sf_dir):
    n = inputs.read(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    refs = n.select(F.when(k % 3 == 0, F.concat(F.lit("#"), k.cast("string"))).when(k % 3 == 1, F.lower("n_name")).otherwise(F.concat("n_name", F.lit("x"))).alias("ref"))
    return select.resolved(n.select(k.alias("order_index"), F.col("n_name").alias("name")), refs).withColumn("order_index", F.coalesce("order_index", F.lit(-1)))


@query("WITH a AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_quantity > 45), b AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_discount > 0.05) SELECT CAST(k AS BIGINT) AS order_index FROM ((SELECT k FROM a EXCEPT SELECT k FROM b) UNION (SELECT k FROM b EXCEPT SELECT k FROM a))")
def toggled_selection(spark, sf_dir):
    li = inputs.read(spark, sf_dir, "lineitem")
    pick = lambda cond: li.where(cond).select(F.col("l_suppkey").alias("order_index"))
    return select.toggled(pick("l_quantity > 45"), pick("l_discount > 0.05"))


@query(CUST + "SELECT order_index FROM g WHERE order_index BETWEEN least(20, (SELECT min(order_index) FROM g WHERE length > 900000)) AND greatest(20, (SELECT min(order_index) FROM g WHERE length > 900000))")
def range_selection(spark, sf_dir):
    s = _seg(spark, sf_dir)
    return select.range_selected(s.where("length > 900000"), 20, s)


@query(CUST + "SELECT order_index, CAST(row_number() OVER (ORDER BY order_index) - 1 AS INT) AS place FROM g WHERE order_index NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def included_segments(spark, sf_dir):
    out = inputs.read(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("order_index"))
    return select.included(_seg(spark, sf_dir), out).select("order_index", "place")


@query("SELECT p, order_index, p - s AS \"offset\" FROM (SELECT DISTINCT CAST(floor(l_partkey*128/((SELECT max(p_partkey) FROM part)+1.0)) AS INT) AS p FROM lineitem) JOIN cr ON p >= s AND p < e", "cr")
def hit_test(spark, sf_dir):
    top = inputs.read(spark, sf_dir, "part").agg((F.max("p_partkey") + 1.0).alias("top"))
    pts = inputs.read(spark, sf_dir, "lineitem").crossJoin(F.broadcast(top)).select(F.floor(F.col("l_partkey") * NB / F.col("top")).cast("int").alias("p")).distinct()  # one row
    return select.hits(pts, inputs.ranges(spark, sf_dir))


@query("SELECT p_size % 4 AS level, p_partkey % 8 AS tx, p_suppkey AS ty FROM (SELECT p_size, p_partkey, (p_partkey // 8) % 8 AS p_suppkey FROM part) WHERE p_size % 4 = 2 AND p_partkey % 8 BETWEEN 1 AND 2 AND p_suppkey BETWEEN 0 AND 3")
def visible_tiles(spark, sf_dir):
    t = inputs.read(spark, sf_dir, "part").select((F.col("p_size") % 4).alias("level"), (F.col("p_partkey") % 8).alias("tx"), (F.floor(F.col("p_partkey") / 8) % 8).alias("ty"))
    return select.visible_tiles(t, 4.0, 0.25, 0.0, 0.6, 0.9, 4)


@query("SELECT DISTINCT x, y, CAST(floor((2*8 - least(x, y) - 1)*least(x, y)/2.0) + greatest(x, y) AS BIGINT) AS k FROM (SELECT CAST(p_partkey % 8 AS INT) AS x, CAST(p_size % 8 AS INT) AS y FROM part)")
def triangle_index(spark, sf_dir):
    t = inputs.read(spark, sf_dir, "part").select((F.col("p_partkey") % 8).cast("int").alias("x"), (F.col("p_size") % 8).cast("int").alias("y")).distinct()
    return t.withColumn("k", select.triangle_index(F.col("x"), F.col("y"), 8))


@query("SELECT t AS tag, count(e.event_id) AS count FROM (VALUES ('reviewed'), ('ambiguous'), ('chimeric'), ('contaminant')) v(t) LEFT JOIN events e ON t = CASE e.event_type WHEN 'click' THEN 'reviewed' WHEN 'view' THEN 'ambiguous' WHEN 'purchase' THEN 'chimeric' END GROUP BY t")
def tag_counts(spark, sf_dir):
    e = F.col("event_type")
    tags = inputs.read(spark, sf_dir, "events").select(F.when(e == "click", "reviewed").when(e == "view", "ambiguous").when(e == "purchase", "chimeric").alias("tag")).where("tag is not null")
    return select.tag_counts(tags)


@query("SELECT count(*) AS cells, CAST(0 AS BIGINT) AS not_finite, CAST(0 AS BIGINT) AS outside, CAST(0 AS BIGINT) AS repeated FROM cm", "cm")
def matrix_validity(spark, sf_dir):
    return select.matrix_valid(inputs.contact(spark, sf_dir), NB)


@query("WITH w AS (SELECT s_suppkey AS id, (s_acctbal + s_nationkey)/2 AS d FROM supplier) SELECT coalesce((SELECT arg_min(id, d) FROM w WHERE d > 100.0), (SELECT arg_min(id, d) FROM w)) AS next_id, coalesce((SELECT arg_max(id, d) FROM w WHERE d < 100.0), (SELECT arg_max(id, d) FROM w)) AS previous_id")
def waypoints(spark, sf_dir):
    s = inputs.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    return select.next_waypoint(s, 100.0)


def _log(spark, sf_dir):
    """Events as edits: a user is a map, event numbers and properties give the operands."""
    e = inputs.read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    op = F.element_at(F.array(*[F.lit(x) for x in ("cut", "join", "invert", "move", "paint")]), (F.col("event_id") % 5 + 1).cast("int"))
    a, b = (F.col("event_id") % 11).cast("int"), F.when(F.col("event_id") % 5 == 0, F.lit(400)).otherwise(F.coalesce(k, F.lit(0)) % 9).cast("int")
    return e.select(F.col("user_id").alias("map_id"), F.col("event_id").alias("seq"), op.alias("op"), a.alias("a"), b.alias("b"), F.when(F.col("event_id") % 10 == 4, F.lit("chr1")).alias("text"), F.col("ts"), "event_type")


def _initial(spark, sf_dir, n=8):
    users = inputs.read(spark, sf_dir, "events").select(F.col("user_id").alias("map_id")).distinct()
    k = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return users.select("map_id", k.alias("order_index")).select("map_id", "order_index", F.concat(F.lit("s"), F.col("order_index").cast("string")).alias("segment"), F.lit(1000).cast("long").alias("length"), F.lit(False).alias("inverted"), F.lit(None).cast("string").alias("scaffold"))


@query()
def folded_edits(spark, sf_dir):
    """Final order of every map."""
    return history.fold(_initial(spark, sf_dir), _log(spark, sf_dir))


@query("SELECT user_id AS map_id, event_id AS seq, CASE event_id % 5 WHEN 0 THEN 'cut #' || event_id % 11 || ' 400' WHEN 1 THEN 'join #' || event_id % 11 || ' #' || (event_id % 11 + 1) WHEN 2 THEN 'invert #' || event_id % 11 WHEN 3 THEN 'move #' || event_id % 11 || ' to ' || coalesce(CAST(json_extract(props, '$.k') AS INT), 0) % 9 ELSE CASE WHEN event_id % 10 = 4 THEN 'scaffold paint #' || event_id % 11 || ' chr1' ELSE 'scaffold unpaint #' || event_id % 11 END END AS command FROM events")
def edits_as_script(spark, sf_dir):
    return history.as_script(_log(spark, sf_dir))


@query("SELECT event_id AS line, CASE event_id % 5 WHEN 0 THEN 'cut' WHEN 1 THEN 'join' WHEN 2 THEN 'invert' WHEN 3 THEN 'move_to' ELSE CASE WHEN event_id % 10 = 4 THEN 'scaffold_paint' ELSE 'scaffold_unpaint' END END AS command, '#' || event_id % 11 AS a, CASE event_id % 5 WHEN 0 THEN '400' WHEN 1 THEN '#' || (event_id % 11 + 1) WHEN 2 THEN '' WHEN 3 THEN CAST(coalesce(CAST(json_extract(props, '$.k') AS INT), 0) % 9 AS VARCHAR) ELSE CASE WHEN event_id % 10 = 4 THEN 'chr1' ELSE '' END END AS b FROM events")
def parsed_script(spark, sf_dir):
    """Scripts made of the log, read again as commands."""
    s = history.as_script(_log(spark, sf_dir))
    return history.commands(s.select(F.col("seq").alias("line"), F.col("command").alias("body")))


def _undo_log(spark, sf_dir):
    e = inputs.read(spark, sf_dir, "events").select(F.col("user_id").alias("map_id"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("back"))
    # only undo what is there: one undo after an edit
    w = W.Window.partitionBy("map_id").orderBy("seq")
    prev = F.lag("back").over(w)
    return e.select("map_id", "seq", F.when(F.col("back") & (~prev), "undo").otherwise("invert").alias("op"))


@query("WITH l AS (SELECT user_id AS map_id, event_id AS seq, CASE WHEN event_type = 'error' AND NOT lag(event_type = 'error') OVER (PARTITION BY user_id ORDER BY event_id) THEN 'undo' ELSE 'invert' END AS op FROM events) SELECT map_id, seq FROM (SELECT map_id, seq, op, lead(op) OVER (PARTITION BY map_id ORDER BY seq) AS nx FROM l) WHERE op = 'invert' AND coalesce(nx, '') <> 'undo'")
def standing_edits(spark, sf_dir):
    return history.effective(_undo_log(spark, sf_dir)).select("map_id", "seq")


DEPTH = 20


@query(f"""WITH e AS (SELECT user_id AS m, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
d AS (SELECT m, day, min(seq) - 1 AS st, row_number() OVER (PARTITION BY m ORDER BY day DESC) AS back FROM e GROUP BY m, day),
n AS (SELECT m, count(*) AS n FROM e GROUP BY m),
b AS (SELECT n.m, n, coalesce(max(st) FILTER (st <= n - {DEPTH}), 0) AS cut, max(st) FILTER (back = 1) AS st1, max(st) FILTER (back = 2) AS st2 FROM n JOIN d USING (m) GROUP BY n.m, n)
SELECT m AS map_id, seq, seq <= cut AS settled FROM e JOIN b USING (m) WHERE seq <= CASE WHEN m % 2 = 0 THEN cut WHEN st2 >= cut THEN st1 - 1 ELSE n - 1 END OR seq <= cut""")
def standing_batches(spark, sf_dir):
    """A user's day is a batch.  Even users undo batch after batch as far as the history goes; odd ones undo two, redo one, and undo one edit."""
    e = inputs.read(spark, sf_dir, "events")
    edits = e.select(F.col("user_id").alias("map_id"), F.row_number().over(W.Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("seq"), F.lit("invert").alias("op"), F.to_date("ts").cast("string").alias("batch"))
    even, odd = F.array(*[F.lit("undo_batch")] * 40), F.array(*[F.lit(x) for x in ("undo_batch", "undo_batch", "redo_batch", "undo")])
    ends = edits.groupBy("map_id").agg(F.max("seq").alias("n")).select("map_id", "n", F.posexplode(F.when(F.col("map_id") % 2 == 0, even).otherwise(odd)).alias("k", "op"))
    return history.standing(edits.unionByName(ends.select("map_id", (F.col("n") + F.col("k") + 1).alias("seq"), "op", F.lit(None).cast("string").alias("batch"))), DEPTH)


def _states(spark, sf_dir):
    li = inputs.read(spark, sf_dir, "lineitem")
    w = W.Window.partitionBy("l_orderkey")
    base = li.groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("n"), F.min("l_suppkey").alias("s"), F.min("l_quantity").alias("q"))
    a = base.where("q > 5").select(F.col("l_orderkey").alias("map_id"), F.col("l_partkey").alias("segment"), F.row_number().over(w.orderBy("n", "l_partkey")).alias("order_index"), F.lit(False).alias("inverted"))
    b = base.where("q < 45").select(F.col("l_orderkey").alias("map_id"), F.col("l_partkey").alias("segment"), F.row_number().over(w.orderBy("s", "n", "l_partkey")).alias("order_index"), (F.col("q") > 30).alias("inverted"))
    return a, b


DIFF = "WITH base AS (SELECT l_orderkey AS m, l_partkey AS g, min(l_linenumber) AS n, min(l_suppkey) AS s, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2), a AS (SELECT m, g, n, false AS inv FROM base WHERE q > 5), b AS (SELECT m, g, s, n, q > 30 AS inv FROM base WHERE q < 45), ab AS (SELECT a.m, a.g, row_number() OVER (PARTITION BY a.m ORDER BY a.n, a.g) AS pa, row_number() OVER (PARTITION BY a.m ORDER BY b.s, b.n, b.g) AS pb, b.inv FROM a JOIN b ON a.m = b.m AND a.g = b.g) SELECT m AS map_id, g AS segment, CASE WHEN inv THEN 'inverted' WHEN pa <> pb THEN 'moved' ELSE 'unchanged' END AS change FROM ab UNION ALL SELECT m, g, 'removed' FROM a WHERE (m, g) NOT IN (SELECT (m, g) FROM b) UNION ALL SELECT m, g, 'added' FROM b WHERE (m, g) NOT IN (SELECT (m, g) FROM a)"


@query(DIFF)
def state_differences(spark, sf_dir):
    return history.differences(*_states(spark, sf_dir))


@query("WITH d AS (" + DIFF + ") SELECT map_id, concat_ws(', ', 'added ' || count(*) FILTER (change = 'added'), 'removed ' || count(*) FILTER (change = 'removed'), 'inverted ' || count(*) FILTER (change = 'inverted'), 'moved ' || count(*) FILTER (change = 'moved'), 'unchanged ' || count(*) FILTER (change = 'unchanged')) AS body FROM d GROUP BY map_id")
def difference_reports(spark, sf_dir):
    return history.diff_report(history.differences(*_states(spark, sf_dir)))


@query("WITH m AS (SELECT user_id, min(event_id) AS a, max(event_id) AS z FROM events WHERE event_type = 'purchase' GROUP BY user_id) SELECT e.user_id AS map_id, event_id AS seq, row_number() OVER (PARTITION BY e.user_id ORDER BY event_id) - 1 AS step FROM events e JOIN m ON m.user_id = e.user_id AND event_id > a AND event_id <= z")
def recorded_macros(spark, sf_dir):
    """Operations of each map between its first and its last purchase."""
    log = _log(spark, sf_dir)
    marks = log.where("event_type = 'purchase'").groupBy("map_id").agg(F.min("seq").alias("after"), F.max("seq").alias("upto"))
    return history.macro(log, marks).select("map_id", "seq", "step")


FLAGGED = "SELECT 'inverted' AS flag, order_index FROM g WHERE inverted UNION ALL SELECT 'scaffolded', order_index FROM g WHERE scaffold_id IS NOT NULL UNION ALL SELECT 'unscaffolded', order_index FROM g WHERE scaffold_id IS NULL UNION ALL SELECT 'misassembled', order_index FROM g WHERE order_index IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%') UNION ALL SELECT 'excluded', order_index FROM g WHERE order_index IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')"


@query(CUST + FLAGGED)
def flagged_segments(spark, sf_dir):
    o, s = inputs.read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "order_index"), _seg(spark, sf_dir)
    flags = ("inverted", "scaffolded", "unscaffolded", "misassembled", "excluded")
    found = [select.flagged(s, f, o.where("o_orderpriority like '1%'"), o.where("o_orderstatus = 'F'")).select(F.lit(f).alias("flag"), "order_index") for f in flags]
    return reduce(lambda a, b: a.unionByName(b), found)


@query("WITH l AS (SELECT user_id, event_id, event_type, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS nw FROM events), g AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM l) SELECT user_id AS map_id, min(event_id) AS first_seq, max(event_id) AS last_seq, count(*) AS n, any_value(event_type) AS batch FROM g GROUP BY user_id, run")
def edit_batches(spark, sf_dir):
    e = inputs.read(spark, sf_dir, "events").select(F.col("user_id").alias("map_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("batch_id"))
    return history.batches(e)


@query("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type")
def changed_values(spark, sf_dir):
    e = inputs.read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return history.changed_values(e, "event_type", "user_id", "event_id")


OBJ = ", o AS (SELECT *, coalesce('scaffold_' || scaffold_id, 'unplaced_' || order_index) AS object FROM g), q AS (SELECT *, min(order_index) OVER (PARTITION BY object) AS first, row_number() OVER (PARTITION BY object ORDER BY order_index) AS part, coalesce(sum(length) OVER (PARTITION BY object ORDER BY order_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (row_number() OVER (PARTITION BY object ORDER BY order_index) - 1)*200 AS st FROM o) "


@query(CUST + OBJ + "SELECT CAST(row_number() OVER (ORDER BY first, part, n) AS INT) AS k, body FROM (SELECT first, part, 1 AS n, concat_ws(chr(9), object, CAST(st + 1 AS BIGINT), CAST(st + length AS BIGINT), 2*part - 1, 'W', name, 1, length, CASE WHEN inverted THEN '-' ELSE '+' END) AS body FROM q UNION ALL SELECT first, part, 0, concat_ws(chr(9), object, CAST(st - 199 AS BIGINT), CAST(st AS BIGINT), 2*part - 2, 'N', 200, 'scaffold', 'yes', 'proximity_ligation') FROM q WHERE part > 1)")
def layout_lines(spark, sf_dir):
    return sink.layout_lines(_seg(spark, sf_dir))


@query(CUST + OBJ + "SELECT CAST(row_number() OVER (ORDER BY first, part) AS INT) AS k, concat_ws(chr(9), object, CAST(st AS BIGINT), CAST(st + length AS BIGINT), name, '0', CASE WHEN inverted THEN '-' ELSE '+' END) AS body FROM q")
def bed_lines(spark, sf_dir):
    return sink.bed_lines(_seg(spark, sf_dir))


@query("SELECT p, name, CAST(floor((p - s)*(length/(e - s)::DOUBLE) + 0.5) AS BIGINT) AS bp_start, least(CAST(floor((p - s + 1)*(length/(e - s)::DOUBLE) + 0.5) AS BIGINT), length) AS bp_end FROM bins JOIN cr ON p >= s AND p < e", "bins", "cr")
def bins_to_base_pairs(spark, sf_dir):
    return sink.bin_to_bp(inputs.ranges(spark, sf_dir))


@query("SELECT 't' AS file, CAST(l_orderkey*10 + l_linenumber AS INT) AS line, 'p' || l_partkey AS chrom, l_suppkey AS start, l_suppkey + CAST(l_quantity AS BIGINT) AS end, l_discount AS value FROM lineitem WHERE l_linenumber < 7")
def parsed_intervals(spark, sf_dir):
    """Interval lines made of lineitem, with some that don't parse, read again."""
    li = inputs.read(spark, sf_dir, "lineitem")
    tab = F.concat_ws("\t", F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.col("l_suppkey").cast("string"), (F.col("l_suppkey") + F.col("l_quantity").cast("long")).cast("string"), F.when(F.col("l_linenumber") < 7, F.col("l_discount").cast("string")).otherwise("none"))
    return source.bedgraph(li.select(F.lit("t").alias("file"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("int").alias("line"), tab.alias("body")))


@query("SELECT 'f' || conv_id AS file, turn AS record, role AS name, 'turn ' || turn AS description, regexp_replace(regexp_replace(text, '(?m)^[;>]', '.', 'g'), '[ \\t\\n\\x0B\\f\\r]+', '', 'g') AS sequence FROM (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn FROM conversations)")
def parsed_sequences(spark, sf_dir):
    """Sequence records made of conversations, read again from their lines; lines that would be headers or comments start with a dot."""
    c = inputs.read(spark, sf_dir, "conversations").withColumn("text", F.regexp_replace("text", "(?dm)^[;>]", "."))
    t = F.row_number().over(W.Window.partitionBy("conv_id").orderBy("turn"))
    rec = F.concat(F.lit(">"), "role", F.lit(" turn "), F.col("t").cast("string"), F.lit("\n"), "text")
    whole = c.withColumn("t", t).groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("t", rec.alias("x")))), lambda s: s["x"]), "\n").alias("value"))
    rows = source.numbered(whole.select(F.concat(F.lit("f"), F.col("conv_id").cast("string")).alias("file"), "value"))
    return source.fasta(rows)


@query(CUST + "SELECT order_index AS new_index_key, name FROM g WHERE order_index < 0")
def empty_selection(spark, sf_dir):
    """An empty selection keeps its columns."""
    return _seg(spark, sf_dir).where("order_index < 0").select(F.col("order_index").alias("new_index_key"), "name")


@query("WITH a AS (SELECT p_name AS name, min(p_partkey) AS k, arg_min(p_size % 2 = 1, p_partkey) AS inv FROM part WHERE p_size < 25 GROUP BY p_name), s AS (SELECT p_name AS name, CAST(row_number() OVER (ORDER BY min(p_partkey)) - 1 AS INT) AS order_index FROM part GROUP BY p_name) SELECT order_index, inv AS inverted, CASE WHEN a.name IS NULL THEN 'appended' ELSE 'listed' END AS status, CAST(row_number() OVER (ORDER BY a.name IS NULL, coalesce(a.k, order_index), order_index) - 1 AS INT) AS new_index FROM s LEFT JOIN a USING (name)")
def planned_order(spark, sf_dir):
    """A layout of small parts, planned onto all part names."""
    p = inputs.read(spark, sf_dir, "part")
    body = F.concat_ws("\t", F.lit("o"), F.lit("1"), F.lit("2"), F.lit("1"), F.lit("W"), "p_name", F.lit("1"), F.lit("2"), F.when(F.col("p_size") % 2 == 1, "-").otherwise("+"))
    rows = source.layout(p.where("p_size < 25").select(F.lit("t").alias("file"), F.col("p_partkey").cast("int").alias("line"), body.alias("body")))
    s = p.groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    seg = s.select((F.row_number().over(W.Window.orderBy("k")) - 1).cast("int").alias("order_index"), F.col("p_name").alias("name"))
    return source.planned_order(rows, seg)


LETTERS = "upper(regexp_replace(translate(coalesce(text, ''), 'aeiouthnrs', 'ACGTACGTAC'), '[^ACGT]', 'N', 'g'))"


def _letters(spark, sf_dir):
    """Documents spelled with four letters; all else is N."""
    d = inputs.read(spark, sf_dir, "documents")
    s = F.upper(F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), "aeiouthnrs", "ACGTACGTAC"), "[^ACGT]", "N"))
    return d.select("doc_id", s.alias("s"))


@query(f"WITH t AS (SELECT doc_id, {LETTERS} AS s FROM documents) SELECT doc_id, md5(reverse(translate(s, 'ACGT', 'TGCA'))) AS back, CAST((length(s) - length(replace(s, 'CA', '')))/2 AS INT) AS motifs, round(length(regexp_replace(s, '[^GC]', '', 'g'))/nullif(length(regexp_replace(s, '[^ACGT]', '', 'g')), 0)::DOUBLE, 6) AS gc FROM t")
def sequence_functions(spark, sf_dir):
    t = _letters(spark, sf_dir)
    return t.select("doc_id", F.md5(sequences.reverse_complement(F.col("s"))).alias("back"), sequences.motif_count(F.col("s"), "ca").alias("motifs"), r(sequences.gc_share(F.col("s"))).alias("gc"))


@query(f"WITH t AS (SELECT doc_id, {LETTERS} AS s FROM documents), x AS (SELECT doc_id, substr(s, 1, 1000) AS a, right(s, 1000) AS z FROM t), y AS (SELECT doc_id, coalesce(greatest(length(a) - length(replace(a, 'CAA', '')), length(a) - length(replace(a, 'TTG', '')))/nullif(length(a), 0)::DOUBLE, 0) AS p, coalesce(greatest(length(z) - length(replace(z, 'CAA', '')), length(z) - length(replace(z, 'TTG', '')))/nullif(length(z), 0)::DOUBLE, 0) AS q FROM x) SELECT doc_id, round(p, 6) AS density_5p, round(q, 6) AS density_3p, concat_ws(',', CASE WHEN p >= 0.05 THEN '5p' END, CASE WHEN q >= 0.05 THEN '3p' END) AS hits FROM y")
def end_motifs(spark, sf_dir):
    out = sequences.end_motifs(_letters(spark, sf_dir), "s", "CAA", 1000, 0.05)
    return out.select("doc_id", r("density_5p").alias("density_5p"), r("density_3p").alias("density_3p"), "hits")


@query(f"""WITH t AS (SELECT doc_id, {LETTERS} AS s FROM documents), p AS (SELECT doc_id, s, length(s) AS len, sum(length(s)) OVER (ORDER BY doc_id) - length(s) AS st FROM t),
w AS (SELECT *, unnest(range(CAST(st // 1000 AS BIGINT), CAST((st + len - 1) // 1000 AS BIGINT) + 1)) AS win FROM p WHERE len > 0),
x AS (SELECT win, substr(s, CAST(greatest(win*1000, st) - st + 1 AS BIGINT), CAST(least((win + 1)*1000, st + len) - greatest(win*1000, st) AS BIGINT)) AS part FROM w),
y AS (SELECT win, sum(2*length(part) - length(replace(part, 'CAA', '')) - length(replace(part, 'TTG', ''))) AS letters FROM x GROUP BY win), z AS (SELECT sum(len) AS total FROM p)
SELECT win AS "window", round(least(1.0, letters/(least(total, (win + 1)*1000) - win*1000)::DOUBLE), 6) AS density FROM y, z""")
def motif_windows(spark, sf_dir):
    """Motifs in windows along all documents, end to end."""
    rows = _letters(spark, sf_dir).select(F.col("doc_id").alias("order_index"), F.length("s").alias("length"), "s")
    return sequences.motif_windows(rows, "s", "CAA", 1000).withColumn("density", r("density"))


@query(f"""WITH t AS (SELECT doc_id, {LETTERS} AS s, doc_id % 2000 * 2 AS a, doc_id % 2000 * 2 + 1 + doc_id % 3 AS z FROM documents), c AS (SELECT doc_id, unnest(range(1, length(s) + 1)) AS p, s FROM t), n AS (SELECT doc_id, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS run, p FROM c WHERE s[p] = 'N'),
g AS (SELECT doc_id, min(p) - 1 AS st, count(*) AS len FROM n GROUP BY doc_id, run), q AS (SELECT greatest(0, floor(a + st/length(s)::DOUBLE*(z - a))) AS p0, least(4000, greatest(greatest(0, floor(a + st/length(s)::DOUBLE*(z - a))) + 1, ceil(a + (st + len)/length(s)::DOUBLE*(z - a)))) AS p1 FROM g JOIN t USING (doc_id)),
e AS (SELECT a, z, substr(s, 1, 1000) AS h, right(s, 1000) AS r FROM t), d AS (SELECT a, z, greatest(length(h) - length(replace(h, 'CAA', '')), length(h) - length(replace(h, 'TTG', '')))/nullif(length(h), 0)::DOUBLE AS x, greatest(length(r) - length(replace(r, 'CAA', '')), length(r) - length(replace(r, 'TTG', '')))/nullif(length(r), 0)::DOUBLE AS y FROM e)
SELECT DISTINCT track, p FROM (SELECT 'gaps' AS track, unnest(range(CAST(p0 AS BIGINT), CAST(p1 AS BIGINT))) AS p FROM q UNION ALL SELECT 'telomeres', a FROM d WHERE x >= 0.05 UNION ALL SELECT 'telomeres', z - 1 FROM d WHERE y >= 0.05) WHERE p BETWEEN 0 AND 3999""")
def sequence_marks(spark, sf_dir):
    """Pixels with gaps and telomeres of documents placed on a texture of 4000."""
    a = F.col("doc_id") % 2000 * 2
    rows = _letters(spark, sf_dir).select(F.col("doc_id").alias("order_index"), F.length("s").alias("length"), a.alias("pixel_start"), (a + 1 + F.col("doc_id") % 3).alias("pixel_end"), "s")
    return sequences.sequence_marks(rows, "s", 4000, "CAA", 1000, 0.05)


@query(f"WITH t AS (SELECT doc_id, {LETTERS} AS s FROM documents), c AS (SELECT doc_id, unnest(range(1, length(s) + 1)) AS p, s FROM t), n AS (SELECT doc_id, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS run, p FROM c WHERE s[p] = 'N') SELECT doc_id, CAST(min(p) - 1 AS BIGINT) AS start, CAST(count(*) AS INT) AS length FROM n GROUP BY doc_id, run HAVING count(*) >= 6")
def letter_runs(spark, sf_dir):
    return sequences.letter_runs(_letters(spark, sf_dir), "doc_id", "s", "N", 6)


GC_BINS = f", t AS (SELECT doc_id, {LETTERS} AS s FROM documents), l AS (SELECT doc_id, s, length(s) AS n, sum(length(s)) OVER (ORDER BY doc_id) AS cum, sum(length(s)) OVER () AS total, greatest(1, length(s)//2000) AS step FROM t), q AS (SELECT *, array_to_string(list_transform(range(1, n + 1, step), lambda i: substr(s, CAST(i AS INT), 1)), '') AS taken FROM l), g AS (SELECT length(regexp_replace(taken, '[^GC]', '', 'g'))/nullif(length(regexp_replace(taken, '[^ACGT]', '', 'g')), 0)::DOUBLE AS gc, floor((cum - n)*1024.0/total + 0.5) AS sp, floor(cum*1024.0/total + 0.5) AS ep FROM q), b AS (SELECT gc, ep - sp AS px, CAST(least(128, floor(sp/1024*128 + 0.5)) AS INT) AS b0, CAST(least(128, floor(ep/1024*128 + 0.5)) AS INT) AS b1 FROM g WHERE gc IS NOT NULL), w AS (SELECT gc, px/greatest(1, b1 - b0) AS w, unnest(range(b0, greatest(b0 + 1, b1))) AS p FROM b) SELECT CAST(p AS INT) AS p, round(sum(gc*w)/sum(w), 6) AS gc FROM w WHERE p < 128 GROUP BY p HAVING sum(w) > 0"


@query("WITH x AS (SELECT 1) " + GC_BINS)
def gc_per_bin(spark, sf_dir):
    """Documents as sequences of segments on 1024 pixels; their sampled GC on 128 bins."""
    t = _letters(spark, sf_dir).select("doc_id", sequences.sampled_gc(F.col("s")).alias("gc"), F.length("s").alias("n"))
    w = W.Window.orderBy("doc_id")  # metadata: one row a segment, without its letters
    total = F.sum("n").over(W.Window.partitionBy())
    at = lambda c: F.floor(c * 1024.0 / total + 0.5)
    placed = t.select("gc", at(F.sum("n").over(w) - F.col("n")).alias("start"), at(F.sum("n").over(w)).alias("end"))
    return sequences.gc_of_bins(placed, 1024, 128).withColumn("gc", r("gc"))


@query(f"SELECT item_id, CAST(pos AS INT) AS pos, CAST(x = 'A' AS INT) AS a, CAST(x = 'C' AS INT) AS c, CAST(x = 'G' AS INT) AS g, CAST(x = 'T' AS INT) AS t FROM (SELECT item_id, pos, substr(s, CAST(pos + 1 AS INT), 1) AS x FROM (SELECT item_id, s, unnest(range(length(s))) AS pos FROM (SELECT item_id, {LETTERS} AS s FROM benchmark)))")
def one_hot_letters(spark, sf_dir):
    b = inputs.read(spark, sf_dir, "benchmark")
    s = F.upper(F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), "aeiouthnrs", "ACGTACGTAC"), "[^ACGT]", "N"))
    return sequences.one_hot(b.select("item_id", s.alias("s")), "item_id", "s")


EXPORT = "x AS (SELECT p, name, CAST(floor((p - s)*(length/(e - s)::DOUBLE) + 0.5) AS BIGINT) AS a, least(CAST(floor((p - s + 1)*(length/(e - s)::DOUBLE) + 0.5) AS BIGINT), length) AS z FROM bins JOIN cr ON p >= s AND p < e)"


@query(f", {EXPORT} SELECT -1 AS k, 'track type=bedGraph name=\"price\"' AS body UNION ALL SELECT p, concat_ws(chr(9), name, a, z, printf('%.5f', coalesce(round(value, 3), 0))) FROM x LEFT JOIN tr USING (p) WHERE z > a", "bins", "cr", "tr")
def track_export(spark, sf_dir):
    t = inputs.track(spark, sf_dir).withColumn("value", F.round("value", 3))
    return sink.track_lines(t, inputs.ranges(spark, sf_dir), "price")


@query(f", {EXPORT}, bo AS (SELECT p, strength FROM (SELECT p, norm, lag(norm) OVER (ORDER BY p) AS a, lead(norm) OVER (ORDER BY p) AS b, least(max(norm) OVER (ORDER BY p ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), max(norm) OVER (ORDER BY p ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)) - norm AS strength FROM insn) WHERE norm < a AND norm < b AND strength >= 0.01) SELECT CAST(row_number() OVER (ORDER BY p) AS INT) AS k, concat_ws(chr(9), name, a, z, 'TAD_' || row_number() OVER (ORDER BY p), CAST(floor(strength*1000 + 0.5) AS BIGINT), '.') AS body FROM x JOIN bo USING (p)", "bins", "cr", "insn")
def boundary_export(spark, sf_dir):
    dom = windows.boundaries(windows.normalised_insulation(windows.insulation(inputs.contact(spark, sf_dir), NB)), prominence=0.01)
    return sink.boundary_lines(dom, inputs.ranges(spark, sf_dir))


@query("SELECT name, nullif(coalesce(nullif(regexp_extract(name, '^(?i:chr(?:omosome)?)[_ ]?([0-9]+|[XYZWM])', 1), ''), nullif(regexp_extract(name, '#([0-9]+)$', 1), '')), '') AS label FROM (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN 'chr_' || p_size ELSE p_brand END AS name FROM part)")
def chromosome_names(spark, sf_dir):
    p = inputs.read(spark, sf_dir, "part").select(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("chr_"), F.col("p_size").cast("string"))).otherwise(F.col("p_brand")).alias("name")).distinct()
    return p.select("name", sequences.chromosome_of(F.col("name")).alias("label"))


@query("WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A') SELECT k, 'both' AS side FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT k, 'first' FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT k, 'second' FROM (SELECT k FROM b EXCEPT SELECT k FROM a)")
def set_operations(spark, sf_dir):
    li = inputs.read(spark, sf_dir, "lineitem")
    a, b = (li.where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("k")) for f in ("R", "A"))
    return select.sides(a, b)


@query("SELECT k AS key, arg_max(v, pr) AS value FROM (SELECT n_nationkey AS k, n_name AS v, 0 AS pr FROM nation UNION ALL SELECT n_nationkey, upper(n_name), 1 FROM nation WHERE n_regionkey = 1) GROUP BY k")
def union_with_override(spark, sf_dir):
    n = inputs.read(spark, sf_dir, "nation")
    base, own = n.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value")), n.where("n_regionkey = 1").select(F.col("n_nationkey").alias("key"), F.upper("n_name").alias("value"))
    return select.overridden(base, own, "key", "value")


@query("SELECT p_brand AS value, CAST(row_number() OVER (ORDER BY min(p_partkey)) - 1 AS INT) AS place FROM part GROUP BY p_brand")
def first_seen(spark, sf_dir):
    p = inputs.read(spark, sf_dir, "part").select(F.col("p_brand").alias("value"), F.col("p_partkey").alias("line"))
    return source.first_seen(p, "value")


@query("SELECT order_index, name, length FROM (SELECT c_custkey AS order_index, c_name AS name, CAST(floor(abs(c_acctbal)*100) AS BIGINT) AS length FROM customer) ORDER BY length DESC, order_index LIMIT 50")
def longest_segments(spark, sf_dir):
    return _seg(spark, sf_dir).select("order_index", "name", "length").orderBy(F.col("length").desc(), "order_index").limit(50)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN s >= 1e9 THEN printf('%.2f', floor(s/1e9*100 + 0.5)/100) || ' Gb' WHEN s >= 1e6 THEN printf('%.2f', floor(s/1e6*100 + 0.5)/100) || ' Mb' WHEN s >= 1e3 THEN printf('%.2f', floor(s/1e3*100 + 0.5)/100) || ' kb' ELSE s || ' bp' END AS shown FROM (SELECT l_orderkey, l_linenumber, l_partkey*l_suppkey AS s FROM lineitem)")
def formatted_lengths(spark, sf_dir):
    li = inputs.read(spark, sf_dir, "lineitem").withColumn("s", F.col("l_partkey") * F.col("l_suppkey"))
    return li.select("l_orderkey", "l_linenumber", select.formatted_length(F.col("s")).alias("shown"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def event_windows_stream(spark, sf_dir):
    """The events as a stream, summed by hour, read back from its sink."""
    stream = spark.readStream.schema(inputs.read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    out = logs.contact_stream(stream.withColumn("ts", F.col("ts").cast("timestamp")), "1 hour", "60 days")
    return _drained(spark, out, "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", r("value", 4).alias("value"))


@query("SELECT 'f' || conv_id AS file, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS record, role AS name, CAST(length(regexp_replace(regexp_replace(text, '(?m)^[;>]', '.', 'g'), '[ \\t\\n\\x0B\\f\\r]+', '', 'g')) AS BIGINT) AS letters FROM conversations")
def chunked_sequences_stream(spark, sf_dir):
    """Conversations as files of records, cut into chunks in the middle of their lines, read as a stream."""
    stream = spark.readStream.schema(inputs.read(spark, sf_dir, "conversations").schema).parquet(f"{sf_dir}/conversations.parquet*")
    body = F.concat(F.lit(">"), "role", F.lit("\n"), F.regexp_replace("text", "(?dm)^[;>]", "."), F.lit("\n"))
    third = F.ceil(F.length(body) / 3).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.substring(body, k * third + 1, third))
    chunks = stream.select(F.concat(F.lit("f"), F.col("conv_id").cast("string")).alias("file"), "turn", F.posexplode(cut).alias("k", "value"))
    out = logs.fasta_chunk_stream(chunks.select("file", (F.col("turn") * 3 + F.col("k")).alias("chunk"), "value"))
    return _drained(spark, out, "update").groupBy("file", "record").agg(F.max_by("name", "letters").alias("name"), F.max("letters").alias("letters"))


def _drained(spark, stream, mode):
    """Runs a stream over all that is there and reads what it gave: at last, or in all batches of updates."""
    import uuid

    from ..functions.tables import shared_dir, written

    kept = []

    def keep(batch, _):
        kept[:] = [*(kept if mode == "update" else []), written(batch, "batch")]

    q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return reduce(DataFrame.unionByName, kept) if kept else spark.createDataFrame([], stream.schema)


@query()
def folded_edits_stream(spark, sf_dir):
    """The edit log as a stream, folded with state; one row a map after the last batch."""
    schema = inputs.read(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    k = F.get_json_object("props", "$.k").cast("int")
    op = F.element_at(F.array(*[F.lit(x) for x in ("cut", "join", "invert", "move", "paint")]), (F.col("event_id") % 5 + 1).cast("int"))
    a, b = (F.col("event_id") % 11).cast("int"), F.when(F.col("event_id") % 5 == 0, F.lit(400)).otherwise(F.coalesce(k, F.lit(0)) % 9).cast("int")
    ops = stream.select(F.col("user_id").alias("map_id"), F.col("event_id").alias("seq"), op.alias("op"), a.alias("a"), b.alias("b"), F.when(F.col("event_id") % 10 == 4, F.lit("chr1")).alias("text"))
    updates = _drained(spark, logs.folded_stream(ops, 8), "update")
    return updates.groupBy("map_id").agg(F.max_by(F.struct(*updates.columns), "edits").alias("last")).select("last.*")


@query("SELECT CAST(c_nationkey AS VARCHAR) AS file, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INT) AS place, c_name AS id, c_acctbal AS size FROM customer QUALIFY c_mktsegment = 'BUILDING' AND c_custkey % 3 > 0")
def catalogue_entries(spark, sf_dir):
    """A catalogue a nation, written as a document and read again: entries of one difficulty that can be loaded."""
    c = inputs.read(spark, sf_dir, "customer")
    entry = F.struct("c_custkey", F.col("c_name").alias("id"), F.col("c_acctbal").alias("sizeMB"), F.col("c_mktsegment").alias("difficulty"), F.when(F.col("c_custkey") % 3 > 0, F.concat("c_name", F.lit(".map"))).alias("releaseAsset"))
    docs = c.groupBy("c_nationkey").agg(F.to_json(F.struct(F.lit("1").alias("version"), F.sort_array(F.collect_list(entry)).alias("specimens"))).alias("value"))
    entries = source.catalogue(docs.select(F.col("c_nationkey").cast("string").alias("file"), "value"))
    return source.catalogue_entries(entries, "BUILDING", True).select("file", "place", "id", F.col("sizeMB").alias("size"))


@query()
def map_health(spark, sf_dir):
    """Health of the derived map, from all of its analyses."""
    return summary.health(inputs.contact(spark, sf_dir), inputs.ranges(spark, sf_dir), NB).select("exponent", "cis_ratio", "flags", "checkerboard", "overall")

