"""Text formats as DataFrame writes: each function gives ordered lines; ``write_lines`` writes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.sequences import reverse_complement, wrapped
from ..functions.tables import numbered
from ..model import bins_of

GAP = 200


def write_lines(lines: DataFrame, path: str) -> None:
    """Ordered text files: the parts, by name, follow each other; a small report is one part."""
    lines.repartitionByRange("k").sortWithinPartitions("k").select("body").write.mode("overwrite").text(path)


def _objects(segments: DataFrame) -> DataFrame:
    """Segments with the object they go to, numbered by first member, and running coordinates."""
    object_ = F.coalesce(F.concat(F.lit("scaffold_"), F.col("scaffold_id").cast("string")), F.concat(F.lit("unplaced_"), F.col("order_index").cast("string")))
    s = segments.withColumn("object", object_)
    w = W.Window.partitionBy("object").orderBy("order_index")
    s = s.withColumn("first", F.min("order_index").over(W.Window.partitionBy("object"))).withColumn("part", F.row_number().over(w))
    before = F.coalesce(F.sum("length").over(w.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    return s.withColumn("at", before + (F.col("part") - 1) * GAP)


def layout_lines(segments: DataFrame) -> DataFrame:
    """(k, body): nine tab-separated columns; a gap row before every component but an object's first."""
    s = _objects(segments)
    tab = lambda *c: F.concat_ws("\t", *[x.cast("string") if isinstance(x, Column) else F.lit(str(x)) for x in c])
    row = tab(F.col("object"), F.col("at") + 1, F.col("at") + F.col("length"), 2 * F.col("part") - 1, "W", F.col("name"), 1, F.col("length"), F.when(F.col("inverted"), "-").otherwise("+"))
    gap = tab(F.col("object"), F.col("at") - GAP + 1, F.col("at"), 2 * F.col("part") - 2, "N", GAP, "scaffold", "yes", "proximity_ligation")
    both = F.when(F.col("part") > 1, F.array(gap, row)).otherwise(F.array(row))
    e = s.select("first", "part", F.posexplode(both).alias("n", "body"))
    return numbered(e, "first", "part", "n").select("k", "body")


def bed_lines(segments: DataFrame) -> DataFrame:
    """(k, body): six columns, half-open from 0; gaps move the coordinates and have no row."""
    s = _objects(segments)
    body = F.concat_ws("\t", "object", F.col("at").cast("string"), (F.col("at") + F.col("length")).cast("string"), "name", F.lit("0"), F.when(F.col("inverted"), "-").otherwise("+"))
    return numbered(s.select("first", "part", body.alias("body")), "first", "part").select("k", "body")


def fasta_lines(segments: DataFrame, sequences: DataFrame) -> DataFrame:
    """(k, body): a record a segment in order, turned where inverted, 80 letters a line; a missing one is named so."""
    j = segments.join(sequences.select("name", "sequence"), "name", "left")
    seq = F.when(F.col("inverted"), reverse_complement(F.col("sequence"))).otherwise(F.col("sequence"))
    sign = F.when(F.col("inverted"), "-").otherwise("+")
    head = F.concat(F.lit(">"), "name", F.lit(" orientation="), sign, F.when(F.col("sequence").isNull(), " WARNING:sequence_not_found").otherwise(""))
    body = F.when(F.col("sequence").isNull() | (F.col("sequence") == ""), head).otherwise(F.concat(head, F.lit("\n"), wrapped(seq)))
    return j.select(F.col("order_index").alias("k"), body.alias("body"))


def bin_to_bp(ranges: DataFrame) -> DataFrame:
    """(p, name, bp_start, bp_end): the base pairs of each bin in the segment that owns it."""
    b = bins_of(ranges, "name", "length").withColumnRenamed("bin", "p")
    scale = F.col("length") / (F.col("end_bin") - F.col("start_bin"))
    at = lambda x: F.floor(x * scale + 0.5).cast("long")
    off = F.col("p") - F.col("start_bin")
    return b.select("p", "name", at(off).alias("bp_start"), F.least(at(off + 1), F.col("length")).alias("bp_end"))


def track_lines(track: DataFrame, ranges: DataFrame, title: str) -> DataFrame:
    """(k, body): interval lines of a track under a title; no value shows as 0, empty intervals are left out."""
    j = bin_to_bp(ranges).join(track, "p", "left").where("bp_end > bp_start")
    v = F.format_string("%.5f", F.coalesce("value", F.lit(0.0)))
    rows = j.select(F.col("p").alias("k"), F.concat_ws("\t", "name", F.col("bp_start").cast("string"), F.col("bp_end").cast("string"), v).alias("body"))
    head = track.sparkSession.range(1).select(F.lit(-1).alias("k"), F.lit(f'track type=bedGraph name="{title}"').alias("body"))
    return head.unionByName(rows)


def boundary_lines(boundaries: DataFrame, ranges: DataFrame) -> DataFrame:
    """(k, body): domain boundaries as numbered intervals with a score of 1000 times their strength."""
    j = bin_to_bp(ranges).join(boundaries, "p")
    k = F.row_number().over(W.Window.orderBy("p"))
    return j.select(k.alias("k"), F.concat_ws("\t", "name", F.col("bp_start").cast("string"), F.col("bp_end").cast("string"), F.concat(F.lit("TAD_"), k.cast("string")), F.floor(F.col("strength") * 1000 + 0.5).cast("string"), F.lit(".")).alias("body"))


def decay_lines(curve: DataFrame, fit: DataFrame) -> DataFrame:
    """(k, body): a commented fit, a header and a row a distance."""
    f = lambda c: F.format_string("%.6f", F.col(c))
    top = fit.select(F.explode(F.array(F.struct(F.lit(-3).alias("k"), F.concat(F.lit("# exponent: "), f("slope")).alias("body")), F.struct(F.lit(-2).alias("k"), F.concat(F.lit("# r2: "), f("r2")).alias("body")), F.struct(F.lit(-1).alias("k"), F.lit("distance\tmean\tlog10_distance\tlog10_mean").alias("body")))).alias("x")).select("x.*")
    return top.unionByName(curve.select(F.col("d").alias("k"), F.concat_ws("\t", F.col("d").cast("string"), f("mean"), f("log_d"), f("log_mean")).alias("body")))


def quality_lines(library: DataFrame, each: DataFrame, ranges: DataFrame) -> DataFrame:
    """(k, body): library quality as comments, a header, and the cis share of each segment in order.

    ``library`` and ``each`` as ``blocks.library_quality`` and ``blocks.segment_quality`` give them; a segment without pairs has 0.
    """
    f = lambda c, n: F.format_string(f"%.{n}f", c)
    odd = each.agg(F.count_if("flagged").alias("flagged"))  # one row
    trans = F.coalesce(F.col("cis") / F.when(F.col("trans") > 0, F.col("trans")), F.lit(0.0))
    comments = [F.lit("# Hi-C library quality metrics"), F.concat(F.lit("# Cis/trans ratio: "), f(trans, 4)), F.concat(F.lit("# Cis percentage: "), f(F.col("cis_ratio") * 100, 2), F.lit("%")), F.concat(F.lit("# Long/short ratio: "), f(F.col("long_short"), 4)), F.concat(F.lit("# Mean occupied contact: "), f(F.col("density"), 6)), F.concat(F.lit("# Flagged contigs: "), F.col("flagged").cast("string")), F.lit("contig\tcis_ratio")]
    top = library.crossJoin(F.broadcast(odd)).select(F.posexplode(F.array(*comments)).alias("k", "body")).select((F.col("k") - len(comments)).alias("k"), "body")
    rows = ranges.select("order_index", "name").join(each.select("order_index", "ratio"), "order_index", "left")
    return top.unionByName(rows.select(F.col("order_index").alias("k"), F.concat_ws("\t", "name", f(F.coalesce("ratio", F.lit(0.0)), 4)).alias("body")))


def saddle_lines(table: DataFrame, bins: int) -> DataFrame:
    """(k, body): the saddle matrix, a row a class."""
    wide = table.groupBy("a").pivot("b", list(range(bins))).agg(F.first("mean"))
    return wide.select(F.col("a").alias("k"), F.concat_ws("\t", *[F.coalesce(F.format_string("%.4f", F.col(f"`{b}`")), F.lit("0")) for b in range(bins)]).alias("body"))


def session_json(segments: DataFrame, log: DataFrame, filename: str) -> DataFrame:
    """One row (value): a session document of order, states and operations."""
    order = segments.agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "order_index"))), lambda x: x["order_index"]).alias("contigOrder"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("order_index").cast("string").alias("k"), F.struct("inverted", F.col("scaffold_id").alias("scaffoldId")).alias("v"))))).alias("contigStates"))
    ops = log.agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.col("op").alias("type"), F.col("at").alias("timestamp"), "description"))), lambda x: F.struct(x["type"].alias("type"), x["timestamp"].alias("timestamp"), x["description"].alias("description"))).alias("operationLog"))
    doc = order.crossJoin(ops)  # one row each
    return doc.select(F.to_json(F.struct(F.lit(1).alias("version"), F.lit(filename).alias("filename"), "contigOrder", "contigStates", "operationLog")).alias("value"))


def edit_log_json(log: DataFrame, source: str) -> DataFrame:
    """One row (value): a log document with entries numbered from 1."""
    entries = F.transform(F.sort_array(F.collect_list(F.struct("seq", "at", "op", "description"))), lambda x, k: F.struct((k + 1).alias("sequence"), F.date_format(F.timestamp_millis(x["at"]), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), x["op"].alias("operationType"), x["description"].alias("description")))
    return log.agg(F.to_json(F.struct(F.lit("1.0").alias("version"), F.lit(source).alias("sourceFile"), entries.alias("entries"))).alias("value"))
