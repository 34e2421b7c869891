"""Text formats as DataFrame reads: intervals, sequences, layouts, sessions and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

SESSION = "version int, filename string, timestamp string, contigOrder array<int>, contigStates map<string, struct<inverted: boolean, scaffoldId: int>>, scaffolds array<struct<id: int, name: string, color: string>>, waypoints array<struct<id: int, name: string, mapX: double, mapY: double>>, operationLog array<struct<type: string, timestamp: bigint, description: string>>"
LOG = "version string, sourceFile string, entries array<struct<sequence: int, timestamp: string, operationType: string, description: string, parameters: map<string, string>>>"
SESSION_VERSION = 1


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, body) with line numbers from 1 in each file.

    Each file is read whole by one task, so its line numbers hold; many files spread.
    """
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return numbered(raw)


def numbered(whole: DataFrame) -> DataFrame:
    """(file, line, body) from (file, value)."""
    split = F.split(F.regexp_replace("value", "\r\n?", "\n"), "\n", -1)
    return whole.select("file", F.posexplode(split).alias("k", "body")).select("file", (F.col("k") + 1).alias("line"), "body")


def _field(k: int) -> Column:
    return F.get(F.split("body", "\t", -1), F.lit(k))


def _number(c: Column, kind: str = "double") -> Column:
    return c.try_cast(kind)


def bedgraph(rows: DataFrame) -> DataFrame:
    """(file, line, chrom, start, end, value): lines of four fields with numbers; others are skipped."""
    kept = rows.where(~F.col("body").rlike(r"^\s*(#|browser|track|$)"))
    out = kept.select("file", "line", _field(0).alias("chrom"), _number(_field(1), "bigint").alias("start"), _number(_field(2), "bigint").alias("end"), _number(_field(3)).alias("value"))
    return out.where("start is not null and end is not null and value is not null and not isnan(value)")


def track_names(rows: DataFrame) -> DataFrame:
    """(file, name) from track lines: quoted either way, or bare."""
    t = rows.where(F.col("body").rlike(r"^track\b"))
    quoted = F.regexp_extract("body", r"""name=("([^"]*)"|'([^']*)'|(\S+))""", 1)
    return t.groupBy("file").agg(F.min_by(F.regexp_replace(quoted, "^[\"']|[\"']$", ""), "line").alias("name"))


def first_seen(rows: DataFrame, value: str) -> DataFrame:
    """Distinct values with their places in order of first appearance."""
    g = rows.groupBy(value).agg(F.min("line").alias("first"))
    return g.select(value, (F.row_number().over(W.Window.orderBy("first")) - 1).cast("int").alias("place"))


def fasta(rows: DataFrame) -> DataFrame:
    """(file, record, name, description, sequence): records start at ``>``; ``;`` lines are comments.

    A running count of headers numbers the records of a file; what stands before the first
    one is dropped.
    """
    body = rows.where(~F.col("body").rlike(r"^;") & (F.trim("body") != ""))
    w = W.Window.partitionBy("file").orderBy("line").rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    head = F.col("body").startswith(">")
    r = body.withColumn("record", F.sum(head.cast("int")).over(w)).where("record > 0").withColumn("head", head)
    title = F.max(F.when(F.col("head"), F.expr("substring(body, 2)")))
    parts = F.sort_array(F.collect_list(F.when(~F.col("head"), F.struct("line", F.regexp_replace("body", r"\s+", "").alias("s")))))
    g = r.groupBy("file", "record").agg(title.alias("title"), parts.alias("parts"))
    name = F.regexp_extract("title", r"^(\S*)", 1)
    return g.select("file", "record", name.alias("name"), F.trim(F.regexp_extract("title", r"^\S*\s+(.*)$", 1)).alias("description"), F.array_join(F.transform("parts", lambda p: p["s"]), "").alias("sequence"))


def layout(rows: DataFrame) -> DataFrame:
    """(file, line, object, name, inverted, unplaced, start, end) of component rows of a nine-column layout."""
    f = F.split("body", "\t", -1)
    kept = rows.where(~F.col("body").startswith("#") & (F.size(f) >= 9) & (F.get(f, F.lit(4)) == "W"))
    return kept.select("file", "line", _field(0).alias("object"), _field(5).alias("name"), (F.trim(_field(8)) == "-").alias("inverted"), _field(0).startswith("unplaced_").alias("unplaced"), _number(_field(6), "bigint").alias("start"), _number(_field(7), "bigint").alias("end"))


def planned_order(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """(new_index, order_index, inverted, status): the order that a layout asks for.

    The first mention of a name counts; segments that it doesn't list follow in their order.
    """
    one = rows.groupBy("name").agg(F.min_by(F.struct("line", "inverted"), "line").alias("f"))
    listed = segments.select("order_index", "name").join(one, "name").select("order_index", F.col("f.line").alias("k"), F.col("f.inverted").alias("inverted"), F.lit("listed").alias("status"))
    rest = segments.select("order_index", "name").join(one, "name", "left_anti").select("order_index", F.col("order_index").cast("int").alias("k"), F.lit(None).cast("boolean").alias("inverted"), F.lit("appended").alias("status"))
    both = listed.unionByName(rest)
    return both.withColumn("new_index", (F.row_number().over(W.Window.orderBy(F.col("status") == "appended", "k", "order_index")) - 1).cast("int")).drop("k")


def sessions(whole: DataFrame) -> DataFrame:
    """Session documents (file, value) that are valid as a whole: version, order, names."""
    s = whole.select("file", F.from_json("value", SESSION).alias("s")).select("file", "s.*")
    order = F.col("contigOrder")
    return s.where((F.col("version") == SESSION_VERSION) & F.col("filename").isNotNull() & order.isNotNull() & ~F.exists(order, lambda x: x.isNull() | (x < 0)) & (F.size(F.array_distinct(order)) == F.size(order)))


def edit_logs(whole: DataFrame) -> DataFrame:
    """(file, seq, at, op, description, parameters), numbered anew in the order of each document."""
    s = whole.select("file", F.from_json("value", LOG).alias("s")).where("s.version is not null and s.entries is not null")
    e = s.select("file", F.posexplode("s.entries").alias("k", "e"))
    return e.select("file", (F.col("k") + 1).alias("seq"), F.col("e.timestamp").try_cast("timestamp").alias("at"), F.col("e.operationType").alias("op"), F.col("e.description").alias("description"), F.col("e.parameters").alias("parameters"))


CATALOGUE = "version string, specimens array<struct<id:string,species:string,commonName:string,taxon:string,sizeMB:double,chromosomeCount:int,contigCount:int,difficulty:string,patterns:array<string>,releaseAsset:string,releaseTag:string,genomeArkKeys:struct<pre:string,post:string>,benchmarkBaseline:struct<f1:double,kendallTau:double,orientationAccuracy:double>>>"


def catalogue(whole: DataFrame) -> DataFrame:
    """Catalogues (file, value) as a row an entry (file, version, place, id, ...); other documents give none."""
    c = whole.select("file", F.from_json("value", CATALOGUE).alias("c")).where("c.version is not null")
    return c.select("file", "c.version", F.posexplode("c.specimens").alias("place", "s")).select("file", "version", "place", "s.*")


def catalogue_entries(entries: DataFrame, difficulty: str | None = None, loadable: bool = False) -> DataFrame:
    """Entries of a difficulty, and with ``loadable`` only those that have a file to load."""
    if difficulty is not None:
        entries = entries.where(F.col("difficulty") == difficulty)
    return entries.where("releaseAsset is not null") if loadable else entries
