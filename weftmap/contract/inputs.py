"""Contact maps, segments and tracks derived from the given tables, and the same in SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..model import contact_from_groups, half_up, place

NB = 128  # bins of the map from lineitem
HOURS = 720  # bins of the map from events


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that share an order, by bin of part key."""
    top = read(spark, sf_dir, "part").agg((F.max("p_partkey") + 1.0).alias("top"))
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_partkey").crossJoin(F.broadcast(top))  # one row
    return contact_from_groups(rows.select("k", F.floor(F.col("l_partkey") * NB / F.col("top")).cast("int").alias("bin")), "k", "bin")


def contact_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one user within six hours of each other, by hour.

    A user's day is cut into buckets of six hours; an event meets those of its own bucket and
    of the next one, so the pairs that are made are at most about twice those that count.
    """
    hour = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) / 1000000 - 1704067200) / 3600).cast("int")
    e = read(spark, sf_dir, "events").select("user_id", "ts", hour.alias("h")).withColumn("bucket", F.floor(F.col("h") / 6))
    first = e.select("user_id", "ts", F.col("h").alias("i"), F.explode(F.array("bucket", F.col("bucket") + 1)).alias("bucket"))
    second = e.select("user_id", F.col("ts").alias("ts2"), F.col("h").alias("j"), "bucket")
    near = first.join(second, ["user_id", "bucket"]).where((F.col("ts2") > F.col("ts")) & (F.col("ts2") <= F.col("ts") + F.expr("INTERVAL 6 HOURS")))
    return near.groupBy("i", "j").agg(F.count(F.lit(1)).cast("double").alias("v"))


def segments(spark: SparkSession, sf_dir: str, by: str = "p_brand") -> DataFrame:
    """Segments are brands (or types) of parts; the first digit of a brand is its scaffold."""
    g = read(spark, sf_dir, "part").groupBy(F.col(by).alias("name")).agg(F.sum("p_size").cast("long").alias("length"))
    scaffold = F.when(F.col("name").rlike("^Brand#[1-4]"), F.substring("name", 7, 1).cast("int"))
    return g.select((F.row_number().over(W.Window.orderBy("name")) - 1).cast("int").alias("order_index"), "name", "length", scaffold.alias("scaffold_id"))


def ranges(spark: SparkSession, sf_dir: str, by: str = "p_brand", n: int = NB) -> DataFrame:
    return place(segments(spark, sf_dir, by), n)


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p, value): mean price of the parts in a bin."""
    top = read(spark, sf_dir, "part").agg((F.max("p_partkey") + 1.0).alias("top"))
    rows = read(spark, sf_dir, "part").crossJoin(F.broadcast(top))
    return rows.groupBy(F.floor(F.col("p_partkey") * NB / F.col("top")).cast("int").alias("p")).agg(F.round(F.avg("p_retailprice"), 6).alias("value"))


__all__ = ["HOURS", "NB", "contact", "contact_events", "half_up", "ranges", "read", "segments", "track"]

#: The same as common table expressions; each entry may use the ones before.
CTE = {
    "b": f"SELECT l_orderkey AS k, CAST(floor(l_partkey*{NB}/((SELECT max(p_partkey) FROM part)+1.0)) AS INT) AS bin FROM lineitem",
    "cm": "SELECT x.bin AS i, y.bin AS j, CAST(count(*) AS DOUBLE) AS v FROM b x JOIN b y ON x.k = y.k AND x.bin <= y.bin GROUP BY x.bin, y.bin",
    "sym": "SELECT i, j, v FROM cm UNION ALL SELECT j, i, v FROM cm WHERE i < j",
    "eh": "SELECT user_id, ts, CAST(floor((epoch(ts) - 1704067200)/3600) AS INT) AS h FROM events",
    "ce": "SELECT x.h AS i, y.h AS j, CAST(count(*) AS DOUBLE) AS v FROM eh x JOIN eh y ON x.user_id = y.user_id AND y.ts > x.ts AND y.ts <= x.ts + INTERVAL 6 HOUR GROUP BY x.h, y.h",
    "bins": f"SELECT CAST(range AS INT) AS p FROM range({NB})",
    "hours": f"SELECT CAST(range AS INT) AS p FROM range({HOURS})",
    "seg": "SELECT CAST(row_number() OVER (ORDER BY p_brand) - 1 AS INT) AS order_index, p_brand AS name, CAST(sum(p_size) AS BIGINT) AS length, CASE WHEN regexp_matches(p_brand, '^Brand#[1-4]') THEN CAST(substr(p_brand, 7, 1) AS INT) END AS scaffold_id FROM part GROUP BY p_brand",
    "segt": "SELECT CAST(row_number() OVER (ORDER BY p_type) - 1 AS INT) AS order_index, p_type AS name, CAST(sum(p_size) AS BIGINT) AS length FROM part GROUP BY p_type",
    "cr": f"SELECT *, CAST(floor((sum(length) OVER (ORDER BY order_index) - length)*{NB}.0/(SELECT sum(length) FROM seg) + 0.5) AS INT) AS s, CAST(floor(sum(length) OVER (ORDER BY order_index)*{NB}.0/(SELECT sum(length) FROM seg) + 0.5) AS INT) AS e FROM seg",
    "crt": f"SELECT *, CAST(floor((sum(length) OVER (ORDER BY order_index) - length)*{NB}.0/(SELECT sum(length) FROM segt) + 0.5) AS INT) AS s, CAST(floor(sum(length) OVER (ORDER BY order_index)*{NB}.0/(SELECT sum(length) FROM segt) + 0.5) AS INT) AS e FROM segt",
    "own": "SELECT p AS bin, order_index AS c, scaffold_id AS sc, s, e FROM bins JOIN cr ON p >= s AND p < e",
    "ownt": "SELECT p AS bin, order_index AS c, s, e FROM bins JOIN crt ON p >= s AND p < e",
    "tr": f"SELECT CAST(floor(p_partkey*{NB}/((SELECT max(p_partkey) FROM part)+1.0)) AS INT) AS p, round(avg(p_retailprice), 6) AS value FROM part GROUP BY 1",
    "expd": f"SELECT p AS d, coalesce(s, 0)/({NB} - p) AS expected FROM bins LEFT JOIN (SELECT j - i AS dd, sum(v) AS s FROM cm GROUP BY j - i) q ON dd = p",
    "oe": "SELECT i, j, v, CASE WHEN expected > 0 THEN v/expected ELSE 0 END AS oe FROM cm JOIN expd ON d = j - i",
    "prof": "SELECT d, pairs, coalesce(sv, 0)/pairs AS mean FROM (SELECT d, CAST(sum(e - s - d) AS BIGINT) AS pairs FROM crt, (SELECT CAST(range AS INT) AS d FROM range(1, 65)) WHERE e - s > d GROUP BY d) LEFT JOIN (SELECT j - i AS dd, sum(v) AS sv FROM cm JOIN ownt a ON a.bin = i JOIN ownt z ON z.bin = j WHERE a.c = z.c GROUP BY j - i) ON dd = d",
    "insz": f"SELECT p, CASE WHEN p > 0 THEN coalesce(s, 0)/(least(10, p)*least(10, {NB} - p)) ELSE 0 END AS score FROM bins LEFT JOIN (SELECT p AS pp, sum(v) AS s FROM bins JOIN cm ON i >= p - 10 AND i < p AND j >= p AND j < p + 10 GROUP BY p) ON pp = p",
    "insn": "SELECT p, CASE WHEN mx > mn THEN (l - mn)/(mx - mn) ELSE 0 END AS norm FROM (SELECT p, l, min(l) OVER () AS mn, max(l) OVER () AS mx FROM (SELECT p, log2(greatest(score, (SELECT min(score) FROM insz WHERE score > 0))) AS l FROM insz))",
    "di0": "SELECT p, coalesce((SELECT sum(v) FROM cm WHERE j = p AND i >= p - 10 AND i < p), 0) AS up, coalesce((SELECT sum(v) FROM cm WHERE i = p AND j <= p + 10 AND j > p), 0) AS down FROM bins",
    "di": f"SELECT p, up, down, CASE WHEN p >= 10 AND {NB} - p > 10 THEN CASE WHEN up + down > 0 THEN (CASE WHEN down >= up THEN 1 ELSE -1 END)*(2*((up - down)/2)*((up - down)/2)/((up + down)/2)) ELSE 0 END END AS di FROM di0",
    "dens": f"SELECT p, coalesce((SELECT sum(v) FROM sym WHERE i = p AND abs(j - p) BETWEEN 1 AND 8), 0)/(least(8, {NB} - 1 - p) + least(8, p)) AS density FROM bins",
}


def sql(body: str, *names: str) -> str:
    """``body`` under the named expressions and all that those use."""
    keys = list(CTE)
    wanted = set(names)
    for k in reversed(keys):
        if k in wanted:
            wanted |= {m for m in re.findall(r"\b\w+\b", CTE[k]) if m in CTE and keys.index(m) < keys.index(k)}
    return "WITH " + ", ".join(f"{k} AS ({CTE[k]})" for k in keys if k in wanted) + ("" if body.startswith(",") else " ") + body
