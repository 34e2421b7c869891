"""Where segments should be cut, and where chromosomes end, from the map alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.tables import dropped, written
from ..model import bins_of, owned
from .windows import diagonal_density, local_baseline, low_regions

SAMPLES = 100


def cross_split_means(contact: DataFrame, ranges: DataFrame, splits: DataFrame) -> DataFrame:
    """(order_index, split, mean): mean contact across a split of a segment, at most 100 rows by 100 columns of it.

    ``splits`` (order_index, split).  Rows and columns are taken at even steps from the start
    and from the split; absent cells count as 0.
    """
    s = splits.distinct().join(ranges.select("order_index", "start_bin", "end_bin"), "order_index").where("split > start_bin and split < end_bin")
    step = lambda n: F.greatest(F.lit(1), F.ceil(n / SAMPLES)).cast("int")
    left, right = F.col("split") - F.col("start_bin"), F.col("end_bin") - F.col("split")
    s = s.withColumn("sl", step(left)).withColumn("sr", step(right)).withColumn("cells", F.ceil(left / F.col("sl")) * F.ceil(right / F.col("sr")))
    inside = owned(contact, ranges).where("a_order_index = b_order_index and i < j").select(F.col("a_order_index").alias("order_index"), "i", "j", "v")
    c = inside.join(s, "order_index").where("i < split and j >= split and (i - start_bin) % sl = 0 and (j - split) % sr = 0")
    sums = c.groupBy("order_index", "split").agg(F.sum("v").alias("s"))
    return s.join(sums, ["order_index", "split"], "left").select("order_index", "split", (F.coalesce("s", F.lit(0.0)) / F.col("cells")).alias("mean"))


def split_ratios(contact: DataFrame, ranges: DataFrame, candidates: DataFrame) -> DataFrame:
    """(order_index, split, ratio): contact across a candidate against the upper median of that across seven even splits.

    1 where that median is 0.
    """
    w = F.col("end_bin") - F.col("start_bin")
    at = F.explode(F.array(*[F.floor(w * (k / 10)) for k in range(2, 9)])).alias("k")
    even = ranges.select("order_index", "start_bin", "end_bin", at).select("order_index", (F.col("start_bin") + F.col("k")).cast("int").alias("split")).distinct()
    means = cross_split_means(contact, ranges, even.unionByName(candidates.select("order_index", "split")))
    ref = means.join(even, ["order_index", "split"], "left_semi").groupBy("order_index").agg(F.sort_array(F.collect_list("mean")).alias("m"))  # seven a segment
    middle = ref.select("order_index", F.get("m", F.floor(F.size("m") / 2).cast("int")).alias("median"))
    j = means.join(candidates.select("order_index", "split").distinct(), ["order_index", "split"], "left_semi").join(middle, "order_index")
    return j.select("order_index", "split", F.coalesce(F.col("mean") / F.when(F.col("median") > 0, F.col("median")), F.lit(1.0)).alias("ratio"))


def automatic_cuts(contact: DataFrame, ranges: DataFrame, n: int, window: int = 8, drop: float = 0.30, min_fragment: int = 16, least: float = 0.5, most_ratio: float = 0.3) -> DataFrame:
    """(order_index, split, confidence, ratio): cuts in long segments where density is low and few contacts cross.

    Of candidates that lie closer than the least fragment, the first counts: a running minimum
    over the sorted candidates of a segment.
    """
    wide = ranges.where(F.col("end_bin") - F.col("start_bin") >= 2 * min_fragment)
    own = bins_of(wide).withColumnRenamed("bin", "p")
    d = diagonal_density(contact, n, window).join(own, "p")
    low = low_regions(local_baseline(d, "density", 4 * window, "order_index"), "density", drop, max(3, window // 2), "order_index")
    at = low.join(wide.select("order_index", "start_bin", "end_bin"), "order_index").where((F.col("middle") - F.col("start_bin") >= min_fragment) & (F.col("end_bin") - F.col("middle") >= min_fragment) & (F.col("confidence") > least))
    sorted_ = F.sort_array(F.collect_list(F.struct(F.col("middle").alias("split"), "confidence")))
    zero = F.array().cast("array<struct<split:int,confidence:double>>")
    spaced = F.aggregate("c", zero, lambda acc, x: F.when((F.size(acc) == 0) | (x["split"] - F.element_at(acc, -1)["split"] >= min_fragment), F.array_append(acc, x)).otherwise(acc))
    kept = at.groupBy("order_index").agg(sorted_.alias("c")).select("order_index", F.explode(spaced).alias("x")).select("order_index", "x.split", "x.confidence")
    return kept.join(split_ratios(contact, wide, kept), ["order_index", "split"]).where(F.col("ratio") < most_ratio)


def chromosome_ends(contact: DataFrame, ranges: DataFrame, corner: int = 10) -> DataFrame:
    """(order_index, mean, end): contact in the corner between neighbours; under min(0.3 mean, lower quartile) a chromosome ends."""
    order = W.Window.orderBy("order_index")
    s = ranges.where(F.col("end_bin") - F.col("start_bin") >= 3)
    s = s.select("order_index", F.greatest("start_bin", F.col("end_bin") - corner).alias("r0"), F.col("end_bin").alias("r1"), F.lead("start_bin").over(order).alias("c0"), F.lead("end_bin").over(order).alias("e"))
    s = s.where("c0 is not null").withColumn("c1", F.least("e", F.col("c0") + corner))
    rows = s.select("order_index", "r0", "r1", "c0", "c1", F.explode(F.sequence("r0", F.col("r1") - 1)).alias("i"))
    sums = rows.join(contact, "i").where("j >= c0 and j < c1").groupBy("order_index").agg(F.sum("v").alias("s"))
    cells = (F.col("r1") - F.col("r0")) * (F.col("c1") - F.col("c0"))
    m = s.join(sums, "order_index", "left").select("order_index", (F.coalesce("s", F.lit(0.0)) / cells).alias("mean"))
    limit = m.agg(F.least(0.3 * F.avg("mean"), F.percentile("mean", 0.25)).alias("limit"))
    return m.crossJoin(F.broadcast(limit)).select("order_index", "mean", (F.col("mean") < F.col("limit")).alias("end"))  # one row


def merged_ranges(ranges: DataFrame, least: int = 3) -> DataFrame:
    """(range, first, start_bin, end_bin): ranges of at least ``least`` bins, narrow neighbours put together, in order.

    A wide segment is a range.  Narrow ones in a row are taken together from the left until they
    are wide enough, again and again; what is left before a wide segment is a narrow range, and at
    the end of the map none.  Where a group that begins at a segment ends follows from
    running sums of widths, as each sum is reached in one segment; which segments do begin groups
    is found by jumps of 1, 2, 4, ... groups.
    """
    w = W.Window.orderBy("order_index")
    s = ranges.select("order_index", "start_bin", "end_bin", (F.col("end_bin") - F.col("start_bin")).alias("width")).withColumn("k", F.row_number().over(w) - 1)
    s = s.withColumn("narrow", F.col("width") < least)
    run = F.sum((F.coalesce(F.lag("narrow").over(w), F.lit(False)) != F.col("narrow")).cast("int")).over(w)
    s = written(s.withColumn("run", run), "segments")
    small = s.where("narrow").withColumn("upto", F.sum("width").over(W.Window.partitionBy("run").orderBy("k"))).withColumn("begin", F.col("k") == F.min("k").over(W.Window.partitionBy("run")))
    small = small.withColumn("before", F.col("upto") - F.col("width"))
    # every sum from before + 1 to upto is first reached in this segment
    reach = small.where("width > 0").select("run", F.explode(F.sequence(F.col("before") + 1, F.col("upto"))).alias("sum"), F.col("k").alias("last"))
    jump = written(small.select("run", "k", (F.col("before") + least).alias("sum")).join(reach, ["run", "sum"]).select("k", (F.col("last") + 1).alias("next")), "jumps")
    begins = written(small.where("begin").select("k").distinct(), "begins")
    known = small.select("k")
    while True:
        more = written(begins.unionByName(begins.join(jump, "k").select(F.col("next").alias("k")).join(known, "k", "left_semi")).distinct(), "begins")
        grown = more.count() > begins.count()
        dropped(begins)
        begins = more
        if not grown:
            break
        far = jump.select(F.col("k").alias("next"), F.col("next").alias("then"))
        jump = written(jump.join(far, "next").select("k", F.col("then").alias("next")), "jumps")
    starts = begins.withColumn("new", F.lit(1)).unionByName(s.where("not narrow").select("k", F.lit(1).alias("new")))
    group = F.sum(F.coalesce("new", F.lit(0))).over(W.Window.orderBy("k"))
    found = s.join(starts, "k", "left").withColumn("range", (group - 1).cast("int")).groupBy("range").agg(F.min("order_index").alias("first"), F.min("start_bin").alias("start_bin"), F.max("end_bin").alias("end_bin"), F.max("k").alias("last"))
    end = s.agg(F.max("k").alias("end"))  # one row
    return found.crossJoin(F.broadcast(end)).where((F.col("end_bin") - F.col("start_bin") >= least) | (F.col("last") < F.col("end"))).select("range", "first", "start_bin", "end_bin")


def chromosome_boundaries(contact: DataFrame, ranges: DataFrame, drop: float = 0.3, corner: int = 10) -> DataFrame:
    """(order_index, signal, pass): segments that begin a chromosome; the first one has pass 0.

    The signal between neighbouring ``merged_ranges`` is the mean of the corner where they meet.  Of signals
    above 0 the mean and the lower quartile (by rank) give the limit of pass 1; if no signal of
    more than five lies below it, those below twice the limit do in pass 2.
    """
    m = merged_ranges(ranges)
    w = W.Window.orderBy("range")
    pairs = m.select("range", F.lead("first").over(w).alias("order_index"), "start_bin", "end_bin", F.lead("start_bin").over(w).alias("s2"), F.lead("end_bin").over(w).alias("e2")).where("order_index is not null")
    size = F.least(F.lit(corner), F.col("end_bin") - F.col("start_bin"), F.col("e2") - F.col("s2"))
    pairs = written(pairs.withColumn("size", size), "pairs")
    rows = pairs.where("size > 0").select("order_index", "s2", "size", F.explode(F.sequence(F.col("end_bin") - F.col("size"), F.col("end_bin") - 1)).alias("i"))
    sums = rows.join(contact, "i").where("j >= s2 and j < s2 + size").groupBy("order_index").agg(F.sum("v").alias("sum"))
    signal = F.when(F.col("size") > 0, F.coalesce("sum", F.lit(0.0)) / (F.col("size") * F.col("size"))).otherwise(F.lit(0.0))
    found = written(pairs.join(sums, "order_index", "left").select("order_index", signal.alias("signal")), "signals")
    some = found.where("signal > 0")
    counts = some.groupBy("signal").agg(F.count(F.lit(1)).alias("c")).withColumn("upto", F.sum("c").over(W.Window.orderBy("signal")))
    whole = some.agg(F.count(F.lit(1)).alias("n"), F.avg("signal").alias("mean"))  # one row
    quartile = counts.crossJoin(F.broadcast(whole)).where(F.col("upto") > F.floor(F.col("n") * 0.25)).agg((F.least(drop * F.first("mean"), F.min("signal"))).alias("limit"))
    judged = found.crossJoin(F.broadcast(quartile)).crossJoin(F.broadcast(found.crossJoin(F.broadcast(quartile)).agg(F.count_if(F.col("signal") < F.col("limit")).alias("low"), F.count(F.lit(1)).alias("all"))))  # one row each
    first = F.when(F.col("signal") < F.col("limit"), 1).when((F.col("low") == 0) & (F.col("all") > 5) & (F.col("signal") < 2 * F.col("limit")), 2)
    begin = ranges.agg(F.min("order_index").alias("order_index")).where("order_index is not null").select("order_index", F.lit(None).cast("double").alias("signal"), F.lit(0).alias("pass"))
    return begin.unionByName(judged.withColumn("pass", first).where("pass is not null").select("order_index", "signal", "pass"))


def chromosome_assignments(ranges: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(order_index, chromosome): numbered from 0 by the boundaries up to each segment."""
    marks = ranges.select("order_index").join(boundaries.select("order_index").distinct().withColumn("new", F.lit(1)), "order_index", "left")
    return marks.select("order_index", (F.sum(F.coalesce("new", F.lit(0))).over(W.Window.orderBy("order_index")) - 1).cast("int").alias("chromosome"))
