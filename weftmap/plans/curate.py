"""Composed curation: automatic cuts, automatic order, and the score of the result, each as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.tables import written
from ..operators import batch, cuts, history, links, metrics


def cut_ranges(ranges: DataFrame, splits: DataFrame) -> DataFrame:
    """Ranges (order_index, name, start_bin, end_bin, length) after cuts at bins, in the same order; ``whole`` is the segment before.

    Lengths of parts are those that ``batch.automatic_cut_operations`` cuts at.
    """
    bound = ranges.select("order_index", F.col("start_bin").alias("bin")).unionByName(splits.select("order_index", F.col("split").alias("bin"))).distinct()
    part = W.Window.partitionBy("order_index").orderBy("bin")
    parts = bound.withColumn("next", F.lead("bin").over(part)).join(ranges.select("order_index", "name", "start_bin", "end_bin", "length"), "order_index")
    at = lambda b: F.floor((b - F.col("start_bin")) / (F.col("end_bin") - F.col("start_bin")) * F.col("length") + 0.5)
    end = F.coalesce("next", "end_bin")
    length = (F.when(end == F.col("end_bin"), F.col("length")).otherwise(at(end)) - F.when(F.col("bin") == F.col("start_bin"), 0).otherwise(at(F.col("bin")))).cast("long")
    index = F.row_number().over(W.Window.orderBy("order_index", "bin")) - 1  # metadata: one row a segment
    return parts.select(index.cast("int").alias("order_index"), F.col("order_index").alias("whole"), "name", F.col("bin").alias("start_bin"), end.alias("end_bin"), length.alias("length"))


#: Fewer segments keep their order: with few of them, links are mostly noise.
LEAST_SEGMENTS = 60


def automatic_order(contact: DataFrame, ranges: DataFrame, segments: DataFrame, n: int, max_distance: int = links.MAX_DISTANCE, least_segments: int = LEAST_SEGMENTS) -> DataFrame:
    """(new_index, order_index, inverted): link scores, threshold, chaining, merging, and chains laid out.

    With no link above the threshold every segment is a chain of its own, and the order stays; so it
    does with fewer than ``least_segments``.
    """
    if segments.count() < least_segments:
        return segments.select(F.col("order_index").alias("new_index"), "order_index", F.lit(False).alias("inverted"))
    best = written(links.best_links(links.link_scores(contact, ranges, n, max_distance)), "links")
    threshold = links.adaptive_threshold(best)
    chained = links.merged_chains(links.chains(best, segments, threshold), best, threshold)
    return links.ordered_segments(chained)


def scaffold_order(contact: DataFrame, ranges: DataFrame, n: int, by: str, least_segments: int = LEAST_SEGMENTS) -> DataFrame:
    """(new_index, order_index, inverted): each scaffold ordered on its own; with fewer than two, all segments together."""
    if ranges.where(F.col(by).isNotNull()).select(by).distinct().limit(2).count() < 2:
        return automatic_order(contact, ranges, ranges.select("order_index"), n, least_segments=least_segments)
    return links.order_within(contact, ranges, n, by)


def curated(contact: DataFrame, ranges: DataFrame, n: int, by: str | None = None, least_segments: int = LEAST_SEGMENTS, **limits) -> tuple[DataFrame, DataFrame]:
    """(operations, order): the log of automatic cuts and then the automatic order of the parts.

    ``by`` orders parts inside groups: a column of ``ranges``, or ``whole``, the segment that a part was cut from.
    ``limits`` go to ``cuts.automatic_cuts``.  Folding the log over the segments gives the order.
    """
    contact = written(contact, "map")
    found = written(cuts.automatic_cuts(contact, ranges, n, **limits), "cuts")
    parts = cut_ranges(ranges, found)
    if by and by != "whole":
        parts = parts.join(ranges.select(F.col("order_index").alias("whole"), by), "whole")
    parts = written(parts, "parts")
    ordered = scaffold_order(contact, parts, n, by, least_segments) if by else automatic_order(contact, parts, parts.select("order_index"), n, least_segments=least_segments)
    order = written(ordered, "order")
    log = batch.after(batch.automatic_cut_operations(found, ranges), batch.automatic_sort_operations(order, parts.select("order_index", F.lit(False).alias("inverted"))))
    return log, order.join(parts.drop("name").withColumnRenamed("whole", "segment"), "order_index")


def applied(ranges: DataFrame, log: DataFrame) -> DataFrame:
    """Final state of one map (number 0) after a log."""
    start = ranges.select(F.lit(0).cast("long").alias("map_id"), "order_index", F.col("name").alias("segment"), F.col("length").cast("long").alias("length"), F.lit(False).alias("inverted"), F.lit(None).cast("string").alias("scaffold"))
    return history.fold(start, log.withColumn("map_id", F.lit(0).cast("long")))


def sort_scores(order: DataFrame) -> DataFrame:
    """One row: rank correlation, longest run, and the parts that stand next to their right neighbour.

    ``order`` (new_index, order_index, inverted); the truth is the order on the map.
    """
    ranked = order.select(F.col("new_index").alias("pos"), F.col("order_index").cast("long").alias("truth"))
    w = W.Window.orderBy("new_index")
    beside = order.select((F.abs(F.col("order_index") - F.lag("order_index").over(w)) == 1).alias("x")).agg(F.coalesce(F.count_if("x"), F.lit(0)).cast("long").alias("neighbours"))
    right = order.agg(F.coalesce(F.avg((~F.col("inverted")).cast("int")), F.lit(1.0)).alias("orientation"))
    return metrics.kendall_tau(ranked).crossJoin(metrics.longest_run(ranked)).crossJoin(beside).crossJoin(right)  # one row each
