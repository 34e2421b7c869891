"""Batch edits: operations on many segments, as rows of an edit log.

Each function returns (seq, op, a, b, text): what ``history.fold`` applies, in an order in which
no operation changes the places that later ones name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import numbered
from .metrics import earlier_items


def _log(rows: DataFrame, op: str, a, b, *order) -> DataFrame:
    """Operations numbered from 0 in an order, by ranges of it."""
    placed = numbered(rows, *order, name="seq", start=0)
    return placed.select(F.col("seq").cast("long").alias("seq"), F.lit(op).alias("op"), a.cast("int").alias("a"), b.cast("int").alias("b"), F.lit(None).cast("string").alias("text"))


def after(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two logs, one after the other."""
    end = first.agg((F.coalesce(F.max("seq"), F.lit(-1)) + 1).alias("__end"))  # one row
    later = second.crossJoin(F.broadcast(end)).withColumn("seq", F.col("seq") + F.col("__end")).drop("__end")
    return first.unionByName(later)


def cut_by_size(segments: DataFrame, longer_than: int) -> DataFrame:
    """Cuts in the middle of every segment longer than a limit, from the last one back."""
    middle = F.floor(F.col("length") / 2)
    return _log(segments.where((F.col("length") > longer_than) & (middle > 0)), "cut", F.col("order_index"), middle, F.col("order_index").desc())


def join_runs(selected: DataFrame) -> DataFrame:
    """Joins of neighbouring selected segments (order_index), from the last pair back."""
    s = selected.select("order_index").distinct()
    pairs = s.join(s.select((F.col("order_index") - 1).alias("order_index")), "order_index")
    return _log(pairs, "join", F.col("order_index"), F.lit(0), F.col("order_index").desc())


def invert_selected(selected: DataFrame) -> DataFrame:
    return _log(selected.select("order_index").distinct(), "invert", F.col("order_index"), F.lit(0), "order_index")


def moves_to_order(wanted: DataFrame) -> DataFrame:
    """Moves that bring segments (order_index) to their ``new_index``, from the first place on.

    When place i is filled, the places before it are done and all others stand in their old order:
    the segment is found at i plus the number of those before it that are still to be placed.
    Segments that stand right already make no move.
    """
    ahead = earlier_items(wanted.select(F.col("order_index").alias("pos"), F.col("new_index").alias("truth")))
    found = ahead.withColumn("at", F.col("truth") + F.col("more")).where("more > 0")
    return _log(found, "move", F.col("at"), F.col("truth"), "truth")


def sort_by_length(segments: DataFrame, descending: bool = False) -> DataFrame:
    """Moves that sort segments by length; equal ones keep their order."""
    length = F.col("length").desc() if descending else F.col("length").asc()
    return moves_to_order(numbered(segments.select("order_index", "length"), length, "order_index", name="new_index", start=0).select("order_index", "new_index"))


def automatic_cut_operations(cuts: DataFrame, ranges: DataFrame) -> DataFrame:
    """Cuts at the splits (order_index, split) of bins that ``cuts.automatic_cuts`` finds, in base pairs.

    From the last split back, so that places and offsets before it stay.
    """
    share = (F.col("split") - F.col("start_bin")) / (F.col("end_bin") - F.col("start_bin"))
    at = cuts.select("order_index", "split").join(ranges.select("order_index", "start_bin", "end_bin", "length"), "order_index").withColumn("offset", F.floor(share * F.col("length") + 0.5))
    at = at.where((F.col("offset") > 0) & (F.col("offset") < F.col("length")))
    return _log(at, "cut", F.col("order_index"), F.col("offset"), F.col("order_index").desc(), F.col("split").desc())


def automatic_sort_operations(ordered: DataFrame, inverted: DataFrame) -> DataFrame:
    """Inversions, then moves, that give segments the order and orientation of ``links.ordered_segments``.

    ``inverted`` (order_index, inverted) is how they stand now.
    """
    turned = ordered.select("order_index", F.col("inverted").alias("wanted")).join(inverted.select("order_index", "inverted"), "order_index").where("wanted <> inverted")
    return after(invert_selected(turned), moves_to_order(ordered))
