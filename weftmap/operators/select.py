"""Selection and lookup predicates over segments, tiles and side tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import numbered

TAGS = ("reviewed", "ambiguous", "chimeric", "contaminant")


def glob(name: Column, pattern: str) -> Column:
    """Whole-name match where only ``*`` is special; case counts."""
    parts = [p.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") for p in pattern.split("*")]
    return name.like("%".join(parts))


def size_between(low: int | None = None, high: int | None = None) -> Column:
    """Length bounds, both inclusive and optional."""
    c = F.lit(True)
    if low is not None:
        c = c & (F.col("length") >= low)
    if high is not None:
        c = c & (F.col("length") <= high)
    return c


def base_pairs(text: Column) -> Column:
    """Number with an optional bp, kb, Mb or Gb suffix, in base pairs; NULL if it isn't one."""
    number = F.regexp_extract(text, r"^\s*([0-9]+\.?[0-9]*)\s*([A-Za-z]*)\s*$", 1)
    unit = F.lower(F.regexp_extract(text, r"^\s*([0-9]+\.?[0-9]*)\s*([A-Za-z]*)\s*$", 2))
    scale = F.when(unit.isin("", "bp"), 1.0).when(unit == "kb", 1e3).when(unit == "mb", 1e6).when(unit == "gb", 1e9)
    return F.when(number != "", F.when(number != "", number).cast("double") * scale)


def formatted_length(bp: Column) -> Column:
    """Length with a unit, two decimals from a thousand on."""
    f = lambda s, u: F.concat(F.format_string("%.2f", F.floor(bp / s * 100 + 0.5) / 100), F.lit(u))
    return F.when(bp >= 1e9, f(1e9, " Gb")).when(bp >= 1e6, f(1e6, " Mb")).when(bp >= 1e3, f(1e3, " kb")).otherwise(F.concat(bp.cast("string"), F.lit(" bp")))


def resolved(segments: DataFrame, references: DataFrame) -> DataFrame:
    """(ref, order_index, status): ``#n`` by place, an exact name, else a unique one in another case.

    status is found, ambiguous or unknown.  References are as many as commands; segments are
    joined on their names, not compared one by one.
    """
    r = references.select("ref").distinct().withColumn("n", F.regexp_extract("ref", "^#([0-9]+)$", 1))
    seg = segments.select("order_index", "name")
    place = r.where("n <> ''").join(seg, F.col("n").cast("long") == F.col("order_index")).select("ref", "order_index", F.lit(0).alias("rank"))
    exact = r.join(seg, F.col("ref") == F.col("name")).select("ref", "order_index", F.lit(1).alias("rank"))
    loose = r.join(seg, F.lower("ref") == F.lower("name")).select("ref", "order_index", F.lit(2).alias("rank"))
    hits = place.unionByName(exact).unionByName(loose)
    best = hits.groupBy("ref", "rank").agg(F.count(F.lit(1)).alias("c"), F.min("order_index").alias("order_index"))
    top = best.groupBy("ref").agg(F.min(F.struct("rank", "c", "order_index")).alias("b"))
    j = r.select("ref").join(top, "ref", "left")
    many = (F.col("b.rank") == 2) & (F.col("b.c") > 1)
    return j.select("ref", F.when(many, F.lit(None)).otherwise(F.col("b.order_index")).alias("order_index"), F.when(F.col("b").isNull(), "unknown").when(many, "ambiguous").otherwise("found").alias("status"))


def toggled(selection: DataFrame, one: DataFrame, key: str = "order_index") -> DataFrame:
    """Symmetric difference of two selections."""
    a, b = selection.select(key).distinct(), one.select(key).distinct()
    return a.join(b, key, "left_anti").unionByName(b.join(a, key, "left_anti"))


def range_selected(selection: DataFrame, to: int, segments: DataFrame) -> DataFrame:
    """Segments from the least selected one (else the target) to the target, either way round."""
    anchor = selection.agg(F.coalesce(F.min("order_index"), F.lit(to)).alias("anchor"))
    return segments.crossJoin(F.broadcast(anchor)).where(F.col("order_index").between(F.least("anchor", F.lit(to)), F.greatest("anchor", F.lit(to)))).select("order_index")  # one row


def included(segments: DataFrame, excluded: DataFrame) -> DataFrame:
    """Segments that are not excluded, in their order, with their new places."""
    kept = segments.join(excluded.select("order_index").distinct(), "order_index", "left_anti")
    return numbered(kept, "order_index", name="place", start=0)


def hits(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """(p, order_index, offset): owner of each position, by bins rather than by comparing all ranges."""
    from ..model import bins_of

    own = bins_of(ranges).select(F.col("bin").alias("p"), "order_index", "start_bin")
    return points.join(own, "p").select("p", "order_index", (F.col("p") - F.col("start_bin")).alias("offset"))


def visible_tiles(tiles: DataFrame, zoom: float, x0: float, y0: float, x1: float, y1: float, levels: int) -> DataFrame:
    """Tiles of the level for a zoom whose cells meet a view in 0..1; filters that prune partitions by level."""
    import math

    level = max(0, min(levels - 1, math.floor(math.log2(max(zoom, 1e-9)) + 0.5)))
    n = 2**level
    cell = lambda v: max(0, min(n - 1, math.floor(v * n)))
    return tiles.where((F.col("level") == level) & F.col("tx").between(cell(x0), cell(x1)) & F.col("ty").between(cell(y0), cell(y1)))


def triangle_index(x: Column, y: Column, n: int) -> Column:
    """Place of a tile among those of the upper triangle, row by row."""
    a, b = F.least(x, y), F.greatest(x, y)
    return (F.floor((2 * n - a - 1) * a / 2) + b).cast("long")


def tag_counts(tags: DataFrame, known: tuple[str, ...] = TAGS) -> DataFrame:
    """(tag, count) of every known tag, absent ones as 0."""
    every = tags.sparkSession.range(1).select(F.explode(F.array(*[F.lit(t) for t in known])).alias("tag"))
    return every.join(tags.groupBy("tag").agg(F.count(F.lit(1)).alias("c")), "tag", "left").select("tag", F.coalesce("c", F.lit(0)).cast("long").alias("count"))


def matrix_valid(contact: DataFrame, n: int) -> DataFrame:
    """One row: cells inside the triangle of n bins, none twice, all finite."""
    v = F.col("v")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    out = (F.col("i") < 0) | (F.col("j") >= n) | (F.col("i") > F.col("j"))
    twice = contact.groupBy("i", "j").agg(F.count(F.lit(1)).alias("c"), F.count_if(bad).alias("b"), F.count_if(out).alias("o"))
    return twice.agg(F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("cells"), F.coalesce(F.sum("b"), F.lit(0)).cast("long").alias("not_finite"), F.coalesce(F.sum("o"), F.lit(0)).cast("long").alias("outside"), F.count_if(F.col("c") > 1).cast("long").alias("repeated"))


def next_waypoint(waypoints: DataFrame, at: float) -> DataFrame:
    """One row: the nearest waypoint ahead of and behind a place on the diagonal, wrapping around.

    Of waypoints at one place the one of the lowest id counts, both ahead and behind.
    """
    d = (F.col("x") + F.col("y")) / 2
    up, down = F.struct(d, "id"), F.struct(~F.isnan(d), -d, "id")  # NaN is above all numbers, as in max_by
    ahead, first = F.min_by("id", F.when(d > at, up)), F.min_by("id", F.when(d.isNotNull(), up))
    behind, last = F.min_by("id", F.when(d < at, down)), F.min_by("id", F.when(d.isNotNull(), down))
    return waypoints.agg(F.coalesce(ahead, first).alias("next_id"), F.coalesce(behind, last).alias("previous_id"))


def flagged(segments: DataFrame, flag: str, misassembled: DataFrame | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """Segments with a flag: inverted, scaffolded, unscaffolded, or listed as misassembled or excluded (order_index)."""
    if flag in ("misassembled", "excluded"):
        listed = misassembled if flag == "misassembled" else excluded
        return segments.limit(0) if listed is None else segments.join(listed.select("order_index").distinct(), "order_index", "left_semi")
    return segments.where({"inverted": F.col("inverted"), "scaffolded": F.col("scaffold_id").isNotNull(), "unscaffolded": F.col("scaffold_id").isNull()}[flag])


def sides(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of two tables with the side that has them: both, first or second."""
    tag = lambda df, s: df.withColumn("side", F.lit(s))
    return tag(a.intersect(b), "both").unionByName(tag(a.subtract(b), "first")).unionByName(tag(b.subtract(a), "second"))


def overridden(base: DataFrame, own: DataFrame, key: str, value: str) -> DataFrame:
    """One value a key: that of ``own`` where it has one, else that of ``base``."""
    both = base.select(key, value, F.lit(0).alias("__rank")).unionByName(own.select(key, value, F.lit(1).alias("__rank")))
    return both.groupBy(key).agg(F.max_by(value, "__rank").alias(value))
