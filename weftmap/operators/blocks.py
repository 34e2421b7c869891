"""Grouped operators over blocks of the matrix: coarsening, library quality, segment pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.tables import running_counts
from ..model import bins_of, owned, symmetric
from .bands import expected_by_distance, observed_over_expected


def row_sums(contact: DataFrame) -> DataFrame:
    return symmetric(contact).groupBy(F.col("i").alias("p")).agg(F.sum("v").alias("total"))


def coarsen(contact: DataFrame, n: int, size: int) -> DataFrame:
    """(i, j, v) of means over size x size blocks, upper triangle; the last block may be narrower."""
    if size <= 1 or n <= size:
        return contact
    width = lambda b: F.least(F.lit(size), n - b * size)
    # a block on the diagonal holds both triangles
    v = F.when((F.col("bi") == F.col("bj")) & (F.col("i") < F.col("j")), 2 * F.col("v")).otherwise(F.col("v"))
    b = contact.withColumn("bi", F.floor(F.col("i") / size).cast("int")).withColumn("bj", F.floor(F.col("j") / size).cast("int"))
    return b.groupBy("bi", "bj").agg(F.sum(v).alias("s")).select(F.col("bi").alias("i"), F.col("bj").alias("j"), (F.col("s") / (width(F.col("bi")) * width(F.col("bj")))).alias("v"))


def resize(contact: DataFrame, n: int, to: int) -> DataFrame:
    """Area-weighted means on a grid of ``to`` bins; source bins may straddle targets."""
    f = n / to

    def parts(name: str, out: str) -> Column:
        x = F.col(name)
        return F.explode(F.transform(F.sequence(F.floor(x / f).cast("int"), F.least(F.lit(to - 1), F.ceil((x + 1) / f).cast("int") - 1)), lambda t: F.struct(t.alias("t"), (F.least(x + 1, (t + 1) * f) - F.greatest(x, t * f)).alias("w")))).alias(out)

    cells = symmetric(contact).select("j", "v", parts("i", "a")).select("v", "a", parts("j", "b"))
    g = cells.where("a.w > 0 and b.w > 0").groupBy(F.col("a.t").alias("i"), F.col("b.t").alias("j")).agg(F.sum(F.col("v") * F.col("a.w") * F.col("b.w")).alias("s"))
    return g.where("i <= j").select("i", "j", (F.col("s") / (f * f)).alias("v"))


def library_quality(contact: DataFrame, ranges: DataFrame, short: int = 20) -> DataFrame:
    """One row: cis and trans sums, long and short cis sums, ratios and density.

    A pair is cis only if both bins are of one scaffold; without a scaffold it is trans.
    """
    c = _pairs(contact, ranges)
    cis = F.coalesce(F.col("a_scaffold_id") == F.col("b_scaffold_id"), F.lit(False))
    near = F.col("j") - F.col("i") <= short
    s = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("v"))), F.lit(0.0))
    t = c.agg(s(cis).alias("cis"), s(~cis).alias("trans"), s(cis & near).alias("short"), s(cis & ~near).alias("long"), F.coalesce(F.avg("v"), F.lit(0.0)).alias("density"))
    ratio = lambda a, b: F.coalesce(a / F.when(b > 0, b), F.lit(0.0))
    return t.withColumn("cis_ratio", ratio(F.col("cis"), F.col("cis") + F.col("trans"))).withColumn("long_short", ratio(F.col("long"), F.col("short")))


def _pairs(contact: DataFrame, ranges: DataFrame) -> DataFrame:
    return owned(contact.where("i < j and v > 0"), ranges, "scaffold_id")


def segment_quality(contact: DataFrame, ranges: DataFrame, low: float = 0.5) -> DataFrame:
    """(order_index, cis, total, ratio, flagged): the cis share of each segment's pairs."""
    c = _pairs(contact, ranges)
    cis = F.coalesce(F.col("a_scaffold_id") == F.col("b_scaffold_id"), F.lit(False))
    ends = c.select(F.explode(F.array_distinct(F.array("a_order_index", "b_order_index"))).alias("order_index"), F.when(cis, F.col("v")).otherwise(0.0).alias("c"), "v")
    g = ends.groupBy("order_index").agg(F.sum("c").alias("cis"), F.sum("v").alias("total"))
    ratio = F.coalesce(F.col("cis") / F.when(F.col("total") > 0, F.col("total")), F.lit(0.0))
    return g.withColumn("ratio", ratio).withColumn("flagged", (ratio < low) & (F.col("total") > 0))


def translocations(contact: DataFrame, ranges: DataFrame, threshold: float = 2.0) -> DataFrame:
    """(a, b, ratio, strength): pairs of segments two or more apart with much contact.

    Both means are over positive cells above the diagonal; the background covers all of them.
    """
    cells = contact.where("i < j and v > 0")
    background = cells.agg(F.avg("v").alias("bg"))
    wide = ranges.where("end_bin - start_bin >= 2")
    pairs = owned(cells, wide).where("b_order_index >= a_order_index + 2").groupBy(F.col("a_order_index").alias("a"), F.col("b_order_index").alias("b")).agg(F.avg("v").alias("mean"))
    out = pairs.crossJoin(F.broadcast(background)).where("bg > 0").select("a", "b", (F.col("mean") / F.col("bg")).alias("ratio"))  # one row
    return out.where(F.col("ratio") >= threshold).withColumn("strength", F.least(F.lit(1.0), (F.col("ratio") - threshold) / (2 * threshold)))


def inversions(contact: DataFrame, ranges: DataFrame, threshold: float = 2.0) -> DataFrame:
    """(order_index, ratio): segments whose anti-diagonal far from the diagonal is strong.

    Both means count absent cells; their numbers follow from the segment's width.
    """
    s = ranges.where("end_bin - start_bin >= 4").select("order_index", "start_bin", "end_bin", (F.col("end_bin") - F.col("start_bin")).alias("w"))
    s = s.withColumn("far", F.greatest(F.lit(2), F.ceil(F.col("w") / 3).cast("int")))
    d = F.sequence(F.col("far"), F.col("w") - 1)
    s = s.withColumn("cells", F.aggregate(d, F.lit(0), lambda a, x: a + (F.col("w") - x)))
    # i + j = start + end - 1 at distance d: d and w - 1 of one parity
    s = s.withColumn("anti", F.size(F.filter(d, lambda x: (x % 2) == ((F.col("w") - 1) % 2))))
    bins = s.select(F.explode(F.sequence("start_bin", F.col("end_bin") - 1)).alias("bin"), "order_index", "start_bin", "end_bin", "far")
    c = contact.join(bins, F.col("i") == F.col("bin")).where("j < end_bin and j - i >= far")
    on = F.col("i") + F.col("j") == F.col("start_bin") + F.col("end_bin") - 1
    g = c.groupBy("order_index").agg(F.sum("v").alias("all"), F.coalesce(F.sum(F.when(on, F.col("v"))), F.lit(0.0)).alias("on"))
    mean = lambda x, k: F.col(x) / F.when(F.col(k) > 0, F.col(k))
    out = s.join(g, "order_index").select("order_index", (mean("on", "anti") / F.when(F.col("all") > 0, mean("all", "cells"))).alias("ratio"))
    return out.where(F.col("ratio") >= threshold)


def neighbour_contact(contact: DataFrame, ranges: DataFrame) -> DataFrame:
    """(order_index, score, boundary, block): mean contact with the next segment, and blocks.

    A junction is a boundary under 0.3 of the median positive score (all are, if none is
    positive); blocks are the runs between boundaries.
    """
    order = W.Window.orderBy("order_index")
    w = (F.col("end_bin") - F.col("start_bin")).alias("w")
    s = ranges.select("order_index", w, F.lead(F.col("end_bin") - F.col("start_bin")).over(order).alias("w2"))
    sums = owned(contact, ranges).where("b_order_index = a_order_index + 1").groupBy(F.col("a_order_index").alias("order_index")).agg(F.sum("v").alias("s"))
    mean = F.when((F.col("w") > 1) & (F.col("w2") > 1), F.coalesce("s", F.lit(0.0)) / F.when(F.col("w") * F.col("w2") > 0, F.col("w") * F.col("w2"))).otherwise(F.lit(0.0))
    scored = s.join(sums, "order_index", "left").withColumn("mean", F.when(F.col("w2").isNotNull(), mean))
    whole = W.Window.partitionBy()
    top = F.max("mean").over(whole)
    scored = scored.withColumn("score", F.when(F.col("mean").isNotNull(), F.coalesce(F.col("mean") / F.when(top > 0, top), F.lit(0.0))))
    middle = F.median(F.when(F.col("score") > 0, F.col("score"))).over(whole)
    scored = scored.withColumn("boundary", F.when(F.col("score").isNotNull(), F.coalesce(F.col("score") < 0.3 * middle, F.lit(True))))
    before = order.rowsBetween(W.Window.unboundedPreceding, -1)
    return scored.select("order_index", "score", "boundary", F.coalesce(F.sum(F.col("boundary").cast("int")).over(before), F.lit(0)).cast("long").alias("block"))


def median_and_mad(rows: DataFrame, value: str) -> DataFrame:
    """One row: median, and median of absolute deviations from it."""
    m = rows.agg(F.median(value).alias("median"))
    return rows.crossJoin(F.broadcast(m)).groupBy("median").agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))  # one row


def join_support(contact: DataFrame, ranges: DataFrame, n: int, window: int = 6) -> DataFrame:
    """(order_index, support, confidence, flagged) for each junction of neighbours.

    Cells that straddle a junction within the window, against what the flanks on its two sides
    show at the same distances (else the map's mean there).  Junctions between different
    scaffolds are left out.
    """
    order = W.Window.orderBy("order_index")
    nxt = lambda c: F.lead(c).over(order)
    j = ranges.select("order_index", "scaffold_id", "start_bin", "end_bin", nxt("end_bin").alias("end2"), nxt("scaffold_id").alias("scaffold2"))
    j = j.where("end2 is not null and end_bin > start_bin and end2 > end_bin and not (scaffold_id is not null and scaffold2 is not null and scaffold_id <> scaffold2)")
    j = j.select("order_index", F.greatest("start_bin", F.col("end_bin") - window).alias("lo"), F.col("end_bin").alias("mid"), F.least("end2", F.col("end_bin") + window).alias("hi"), F.least(F.col("end_bin") - F.col("start_bin"), F.col("end2") - F.col("end_bin")).alias("least"))
    near = j.select("order_index", "lo", "mid", "hi", "least", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("p"))
    band = contact.where((F.col("j") - F.col("i")).between(1, window))
    cells = near.join(band, F.col("p") == F.col("i")).where("j < hi").withColumn("d", F.col("j") - F.col("i"))
    across = (F.col("i") < F.col("mid")) & (F.col("j") >= F.col("mid"))
    seen = cells.groupBy("order_index", "d").agg(F.coalesce(F.sum(F.when(across, F.col("v"))), F.lit(0.0)).alias("obs"), F.coalesce(F.sum(F.when(~across, F.col("v"))), F.lit(0.0)).alias("flank"))
    # numbers of cells come from the widths a and b of the two flanks
    a, b, d = F.col("mid") - F.col("lo"), F.col("hi") - F.col("mid"), F.col("d")
    at = j.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(window), F.col("hi") - F.col("lo") - 1))).alias("d"))
    at = at.withColumn("in_flank", F.greatest(F.lit(0), a - d) + F.greatest(F.lit(0), b - d)).withColumn("in_all", a + b - d)
    at = at.withColumn("n_across", F.col("in_all") - F.col("in_flank")).where("n_across > 0")
    e = expected_by_distance(contact, n)
    full = at.join(seen, ["order_index", "d"], "left").join(e, "d")
    local = F.coalesce("flank", F.lit(0.0)) / F.when(F.col("in_flank") > 0, F.col("in_flank"))
    wanted = F.when(local > 0, local).otherwise(F.col("expected"))
    g = full.groupBy("order_index", "least").agg(F.sum(F.coalesce("obs", F.lit(0.0))).alias("o"), F.sum(wanted * F.col("n_across")).alias("x"))
    out = g.where("x > 0").select("order_index", (F.col("o") / F.col("x")).alias("support"), F.when(F.col("least") >= 3, "high").when(F.col("least") >= 2, "medium").otherwise("low").alias("confidence"))
    m = median_and_mad(out, "support")
    limit = F.greatest(F.lit(0.35), F.col("median") - 2.5 * F.col("mad"))
    return out.crossJoin(F.broadcast(m)).select("order_index", "support", "confidence", (F.col("support") < limit).alias("flagged"))  # one row


def duplicate_segments(contact: DataFrame, ranges: DataFrame, n: int, apart: int = 4) -> DataFrame:
    """(order_index, partner, enrichment, candidate): the far segment with the highest mean ratio.

    Means are over all cells of the block, absent ones as 0.
    """
    oe = observed_over_expected(contact, n).select("i", "j", F.col("oe").alias("v"))
    far = owned(oe, ranges).where(F.abs(F.col("b_order_index") - F.col("a_order_index")) >= apart)
    size = (F.col("a_end_bin") - F.col("a_start_bin")) * (F.col("b_end_bin") - F.col("b_start_bin"))
    pairs = far.groupBy(F.col("a_order_index").alias("a"), F.col("b_order_index").alias("b"), size.alias("cells")).agg(F.sum("v").alias("s")).select("a", "b", (F.col("s") / F.col("cells")).alias("e"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "e"))
    best = both.groupBy(F.col("a").alias("order_index")).agg(F.max_by(F.struct("b", "e"), F.struct("e", (-F.col("b")).alias("k"))).alias("m")).select("order_index", F.col("m.b").alias("partner"), F.col("m.e").alias("enrichment"))
    m = median_and_mad(best, "enrichment")
    limit = F.greatest(F.lit(2.0), F.col("median") + 3 * F.col("mad"))
    return best.crossJoin(F.broadcast(m)).select("order_index", "partner", "enrichment", (F.col("enrichment") >= limit).alias("candidate"))  # one row


def coverage_ratios(track: DataFrame, ranges: DataFrame) -> DataFrame:
    """(order_index, ratio): median of a track in each segment over the median of the positive medians."""
    own = bins_of(ranges).select(F.col("bin").alias("p"), "order_index")
    med = track.join(own, "p").groupBy("order_index").agg(F.median("value").alias("m"))
    middle = med.where("m > 0").agg(F.median("m").alias("mm"))
    return med.crossJoin(F.broadcast(middle)).select("order_index", (F.col("m") / F.col("mm")).alias("ratio"))  # one row


def order_statistic(rows: DataFrame, value: str, q: float, upper: bool = False) -> DataFrame:
    """One row: the value of rank floor(q n) from 0 (ceil for upper), at most the last.

    Equal values share their ranks, so running counts of distinct values, by ranges, find it.
    """
    total = rows.agg(F.count(value).alias("n"))
    rank = (F.ceil if upper else F.floor)(F.lit(q) * F.col("n"))
    ranked = running_counts(rows, value).crossJoin(F.broadcast(total))  # one row
    return ranked.where(F.col("upto") > F.least(rank, F.col("n") - 1)).agg(F.min(value).alias("value"))


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, count) on equal bins; values beyond an end count in its bin."""
    k = F.floor((F.col(value) - low) / (high - low) * bins)
    return rows.where(F.col(value).isNotNull()).groupBy(F.least(F.lit(bins - 1), F.greatest(F.lit(0), k)).cast("int").alias("bin")).agg(F.count(F.lit(1)).cast("long").alias("count"))


def entropy_score(hist: DataFrame, bins: int) -> DataFrame:
    """One row: Shannon entropy in nats, and as a percentage of that of even bins."""
    share = F.col("count") / F.sum("count").over(W.Window.partitionBy())
    h = hist.select(share.alias("q")).agg((-F.sum(F.col("q") * F.log("q"))).alias("entropy"))
    return h.withColumn("score", F.col("entropy") / F.log(F.lit(float(bins))) * 100)


def auto_contrast(contact: DataFrame, n: int, bins: int = 256) -> DataFrame:
    """One row (floor, cap): the median off-diagonal bin, absent cells as 0.

    Values are first scaled by the map's maximum.
    """
    top = contact.agg(F.max("v").alias("top"))
    off = contact.where("i < j").crossJoin(F.broadcast(top)).select((F.col("v") / F.col("top")).alias("x"))  # one row
    h = histogram(off, "x", 0.0, 1.0, bins)
    zeros = contact.sparkSession.range(1).select(F.lit(0).alias("bin"), F.lit(n * (n - 1) // 2).cast("long").alias("count"))
    seen = h.agg((-F.coalesce(F.sum("count"), F.lit(0))).alias("count")).select(F.lit(0).alias("bin"), "count")
    full = h.unionByName(zeros).unionByName(seen).groupBy("bin").agg(F.sum("count").alias("count"))
    upto = F.sum("count").over(W.Window.orderBy("bin"))
    middle = full.withColumn("upto", upto).where(F.col("upto") * 2 >= n * (n - 1) // 2).agg(F.min("bin").alias("b"))
    x = F.col("b") / float(bins)
    return middle.select(x.alias("median"), F.when(x > 0.25, x).otherwise(F.lit(0.0)).alias("floor"), F.lit(0.7).alias("cap"))
