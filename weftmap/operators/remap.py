"""Reordered views: a bin table from display to source, applied to maps and tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.tables import running_counts
from ..model import half_up, place


def remap_table(segments: DataFrame, order: DataFrame, n: int) -> DataFrame:
    """(dest, src): bins of a new order (order_index, new_index, inverted) in terms of the old one.

    Both orders round their running sums on their own, so spans may differ by a bin; the last
    source bin then repeats.  Inverted segments read backwards.
    """
    src = place(segments, n).select("order_index", "length", F.col("start_bin").alias("s"), F.col("end_bin").alias("e"))
    new = src.join(order, "order_index").select(F.col("new_index").alias("order_index"), "length", "s", "e", "inverted")
    dst = place(new, n).where("end_bin > start_bin and e > s")
    k = dst.select("s", "e", "inverted", "start_bin", F.explode(F.sequence("start_bin", F.col("end_bin") - 1)).alias("dest"))
    off = F.least(F.col("dest") - F.col("start_bin"), F.col("e") - F.col("s") - 1)
    return k.select("dest", F.when(F.col("inverted"), F.col("e") - 1 - off).otherwise(F.col("s") + off).alias("src"))


def reordered(contact: DataFrame, table: DataFrame) -> DataFrame:
    """The map seen through a bin table: two joins on the table, upper triangle again."""
    a, b = table.select(F.col("src").alias("i"), F.col("dest").alias("x")), table.select(F.col("src").alias("j"), F.col("dest").alias("y"))
    both = contact.unionByName(contact.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    return both.join(a, "i").join(b, "j").where("x <= y").select(F.col("x").alias("i"), F.col("y").alias("j"), "v")


def reordered_track(track: DataFrame, table: DataFrame) -> DataFrame:
    return table.join(track.withColumnRenamed("p", "src"), "src").select(F.col("dest").alias("p"), "value")


def rasterised(track: DataFrame, n: int, samples: int) -> DataFrame:
    """(t, value): each of ``samples`` points takes the bin at or below it."""
    t = track.sparkSession.range(samples).select(F.col("id").cast("int").alias("t"), F.least(F.lit(n - 1), F.floor(F.col("id") * (n / samples)).cast("int")).alias("p"))
    return t.join(track, "p", "left").select("t", "value")


def intervals_to_track(entries: DataFrame, segments: DataFrame, samples: int) -> DataFrame:
    """(t, value) from (line, chrom, start, end, value): scaled to 0..1 over all entries; later lines win.

    Intervals of unknown segments count for the scale only.
    """
    whole = W.Window.partitionBy()
    lo, hi = F.min("value").over(whole), F.max("value").over(whole)
    scaled = entries.withColumn("scaled", F.when(hi > lo, (F.col("value") - lo) / F.when(hi > lo, hi - lo)).otherwise(F.lit(0.5)))
    at = place(segments, samples).select(F.col("name").alias("chrom"), "length", "start_bin", (F.col("end_bin") - F.col("start_bin")).alias("w"))
    j = scaled.join(at, "chrom").where("w > 0")
    first = F.col("start_bin") + F.floor(F.col("start") / F.col("length") * F.col("w")).cast("int")
    last = F.least(F.col("start_bin") + F.ceil(F.col("end") / F.col("length") * F.col("w")).cast("int"), F.col("start_bin") + F.col("w")) - 1
    span = j.select("line", "scaled", first.alias("a"), last.alias("b")).where("a <= b")
    return span.select("line", "scaled", F.explode(F.sequence("a", "b")).alias("t")).groupBy("t").agg(F.max_by("scaled", "line").alias("value"))


def track_kind(name: Column) -> Column:
    """Kind of an embedded track by its name."""
    low = F.lower(name)
    return F.when(low.contains("telo"), "telomere").when(low.contains("gap"), "gap").when(low.contains("cov"), "coverage").when(low.contains("repeat"), "repeat").otherwise("other")


def clipped_unit(track: DataFrame, low: float = 0.01, high: float = 0.99, log: bool = True) -> DataFrame:
    """(p, value): clipped at two order statistics of rank floor(q (n - 1)), log1p, scaled to 0..1."""
    x = F.log1p("value") if log else F.col("value")
    t = track.select("p", x.alias("x"))
    total = t.agg(F.count("x").alias("n"))
    ranked = running_counts(t, "x").crossJoin(F.broadcast(total))  # one row
    pick = lambda q: F.min(F.when(F.col("upto") > F.floor(q * (F.col("n") - 1)), F.col("x")))
    ends = ranked.agg(pick(low).alias("lo"), pick(high).alias("hi"))
    span = F.col("hi") - F.col("lo")
    v = F.when(span > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("x") - F.col("lo")) / F.when(span > 0, span)))).otherwise(F.lit(0.5))
    return t.crossJoin(F.broadcast(ends)).select("p", v.alias("value"))  # one row


def embedded_tracks(tracks: DataFrame, table: DataFrame, bins: int, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """(name, kind, p, value) of named tracks, scaled by their kind and in display order; a row with null p is a track that doesn't fit.

    ``tracks`` (name, pos, value) from ``tiles.extension_tracks``; ``table`` (dest, src) from ``remap_table``.
    Telomeres and gaps become 0 or 1; others are clipped at two order statistics and scaled to
    0..1, coverage by its logarithm; a flat one is 0.  A track fits if it has a value for each
    of ``bins`` places.  Values are counted before they are ranked, name by name.
    """
    kind = track_kind(F.col("name"))
    t = tracks.withColumn("kind", kind).withColumn("x", F.when(kind == "coverage", F.log1p(F.greatest(F.col("value").cast("double"), F.lit(0.0)))).otherwise(F.col("value").cast("double")))
    sizes = t.groupBy("name", "kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("pos").alias("places"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    fits = (F.col("n") == bins) & (F.col("places") == bins) & (F.col("first") == 0) & (F.col("last") == bins - 1)
    upto = F.sum("c").over(W.Window.partitionBy("name").orderBy("x"))
    ranked = t.groupBy("name", "x").agg(F.count(F.lit(1)).alias("c")).withColumn("upto", upto).join(sizes.where(fits).select("name", "n"), "name")
    pick = lambda q: F.min(F.when(F.col("upto") > F.floor(q * (F.col("n") - 1)), F.col("x")))
    ends = ranked.groupBy("name").agg(pick(low).alias("lo"), pick(high).alias("hi"))
    span = F.col("hi") - F.col("lo")
    unit = F.when(span > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("x") - F.col("lo")) / F.when(span > 0, span)))).otherwise(F.lit(0.0))
    value = F.when(F.col("kind").isin("telomere", "gap"), (F.col("value") > 0).cast("double")).otherwise(unit)
    shown = t.join(ends, "name").select("name", "kind", F.col("pos").alias("src"), value.alias("value")).join(table.select("dest", "src"), "src")
    odd = sizes.where(~fits).select("name", "kind", F.lit(None).cast("int").alias("p"), F.lit(None).cast("double").alias("value"))
    return shown.select("name", "kind", F.col("dest").cast("int").alias("p"), "value").unionByName(odd)


__all__ = ["clipped_unit", "embedded_tracks", "half_up", "intervals_to_track", "rasterised", "remap_table", "reordered", "reordered_track", "track_kind"]
