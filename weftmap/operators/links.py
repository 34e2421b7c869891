"""Ordering segments: link scores of segment ends, best links, and greedy chaining in rounds."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.tables import dropped, running_counts, written
from ..model import owned, symmetric
from .bands import intra_profile

# Which ends of the two segments meet, in the order in which ties are settled.
ORIENTATIONS = ("HH", "HT", "TH", "TT")
MIN_SPAN, MAX_DISTANCE, MIN_SCORE = 4, 50, 0.05


def link_scores(contact: DataFrame, ranges: DataFrame, n: int, max_distance: int = MAX_DISTANCE, by: str | None = None) -> DataFrame:
    """(by, a, b, orientation, score) of all pairs of segments a < b that have contact.

    With ``by``, a column of ``ranges`` without nulls, pairs and the profile are those within a group.

    At distance d from the meeting corner the mean of the band r + c = d (inner cells twice)
    is compared with the profile inside segments; scores of bands count with 1 / sqrt(d).
    Pairs without any contact score 0 throughout and are left out.
    """
    group = [by] if by else []
    wide = ranges.where(F.col("end_bin") - F.col("start_bin") >= MIN_SPAN).select("order_index", "start_bin", "end_bin", *group)
    profile = intra_profile(contact, ranges, max_distance, by).select(*group, "d", F.col("mean").alias("expected")).where("expected > 0")
    pairs = owned(contact.where("v > 0"), wide, *group).where("a_order_index < b_order_index")
    for g in group:
        pairs = pairs.where(F.col(f"a_{g}") == F.col(f"b_{g}")).withColumnRenamed(f"a_{g}", g)
    met = pairs.select(*group, "a_order_index", "b_order_index", "a_start_bin", "a_end_bin", "b_start_bin", "b_end_bin").distinct()
    ways = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(o).alias("orientation")) for k, o in enumerate(ORIENTATIONS)])).alias("o")
    p = met.select("*", ways, F.least(F.lit(max_distance), F.col("a_end_bin") - F.col("a_start_bin"), F.col("b_end_bin") - F.col("b_start_bin")).alias("reach")).select("*", "o.orientation")
    head_a, tail_b = F.col("orientation").isin("TH", "TT"), F.col("orientation").isin("HT", "TT")
    p = p.withColumn("row0", F.when(head_a, F.col("a_start_bin")).otherwise(F.col("a_end_bin") - 1)).withColumn("row_step", F.when(head_a, 1).otherwise(-1))
    p = p.withColumn("col0", F.when(tail_b, F.col("b_end_bin") - 1).otherwise(F.col("b_start_bin"))).withColumn("col_step", F.when(tail_b, -1).otherwise(1))
    at = p.select(*group, F.col("a_order_index").alias("a"), F.col("b_order_index").alias("b"), "orientation", "row0", "row_step", "col0", "col_step", F.explode(F.sequence(F.lit(1), "reach")).alias("d"))
    at = at.join(profile, [*group, "d"]).select("*", F.explode(F.sequence(F.lit(0), "d")).alias("r"))
    at = at.withColumn("i", F.col("row0") + F.col("row_step") * F.col("r")).withColumn("j", F.col("col0") + F.col("col_step") * (F.col("d") - F.col("r")))
    at = at.where((F.col("i") >= 0) & (F.col("i") < n) & (F.col("j") >= 0) & (F.col("j") < n)).withColumn("w", F.when((F.col("r") > 0) & (F.col("r") < F.col("d")), 2).otherwise(1))
    bands = at.join(symmetric(contact), ["i", "j"], "left").groupBy(*group, "a", "b", "orientation", "d", "expected").agg((F.sum(F.coalesce("v", F.lit(0.0)) * F.col("w")) / F.sum("w")).alias("o"))
    fit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(F.col("o") - F.col("expected")) / F.col("expected")))
    w = 1 / F.sqrt("d")
    return bands.groupBy(*group, "a", "b", "orientation").agg((F.sum(fit * w) / F.sum(w)).alias("score"))


def best_links(scores: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """The best orientation of each pair, the first in ``ORIENTATIONS`` among equals."""
    k = F.array_position(F.array(*[F.lit(o) for o in ORIENTATIONS]), F.col("orientation"))
    best = scores.groupBy("a", "b").agg(F.max_by(F.struct("orientation", "score"), F.struct("score", (-k).alias("k"))).alias("m"))
    return best.select("a", "b", "m.orientation", "m.score").where(F.col("score") >= least)


def adaptive_threshold(links: DataFrame, share: float = 0.15, cap: float = 0.2) -> float:
    """The smaller of ``cap`` and the score at rank floor(share * links) in descending order."""
    n = links.count()
    if not n:
        return cap
    return min(cap, running_counts(links, "score", True).where(F.col("upto") > int(share * n)).agg(F.max("score")).first()[0])


def group_thresholds(links: DataFrame, by: str, share: float = 0.15, cap: float = 0.2) -> DataFrame:
    """(by, threshold): ``adaptive_threshold`` of the links of each group; equal scores are counted before they are ranked."""
    counts = links.groupBy(by, "score").agg(F.count(F.lit(1)).alias("c"))
    own = W.Window.partitionBy(by)
    ranked = counts.withColumn("upto", F.sum("c").over(own.orderBy(F.col("score").desc()))).withColumn("n", F.sum("c").over(own))
    return ranked.where(F.col("upto") > F.floor(share * F.col("n"))).groupBy(by).agg(F.least(F.lit(cap), F.max("score")).alias("threshold"))


def order_within(contact: DataFrame, ranges: DataFrame, n: int, by: str, max_distance: int = MAX_DISTANCE, least_members: int = 3) -> DataFrame:
    """(new_index, order_index, inverted): segments ordered inside their groups, which keep their places on the map.

    Links join members of one group only, by a profile and a threshold of the group's own, so
    one run of the rounds chains all groups.  A group's chains, largest first, fill the places
    that it had; groups of fewer than ``least_members`` stay as they are.  A null ``by`` is a group too.
    ``ranges`` may have ``inverted``, as segments stand now, for those that stay.
    """
    label = F.coalesce(F.concat(F.lit("1"), F.col(by).cast("string")), F.lit("0"))
    stays = F.col("inverted") if "inverted" in ranges.columns else F.lit(False)
    named = written(ranges.select("order_index", "start_bin", "end_bin", label.alias("grp"), stays.alias("stands")), "groups")
    large = named.groupBy("grp").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") >= least_members)
    own = named.join(large.select("grp"), "grp")
    scores = written(link_scores(contact, own, n, max_distance, "grp"), "scores")
    best = best_links(scores).join(own.select(F.col("order_index").alias("a"), "grp"), "a")
    limited = written(best.join(group_thresholds(best, "grp"), "grp"), "links")
    taken = chains(limited.where("score >= threshold"), own, 0.0)
    chained = merged_chains(taken, limited.where(F.col("score") >= F.greatest(F.lit(MIN_SCORE), 0.3 * F.col("threshold"))), 0.0)
    size = F.count(F.lit(1)).over(W.Window.partitionBy("chain"))
    rank = F.row_number().over(W.Window.partitionBy("grp").orderBy(F.col("size").desc(), "chain", "pos"))
    placed = chained.join(own.select("order_index", "grp"), "order_index").withColumn("size", size).select("grp", "order_index", "inverted", rank.alias("rank"))
    slots = own.select("grp", F.col("order_index").alias("new_index"), F.row_number().over(W.Window.partitionBy("grp").orderBy("order_index")).alias("rank"))
    moved = placed.join(slots, ["grp", "rank"]).select("new_index", "order_index", "inverted")
    rest = named.join(large.select("grp"), "grp", "left_anti").select(F.col("order_index").alias("new_index"), "order_index", F.col("stands").alias("inverted"))
    return moved.unionByName(rest)


def chains(links: DataFrame, segments: DataFrame, threshold: float, max_rounds: int | None = None) -> DataFrame:
    """(order_index, chain, pos, inverted): greedy chaining by descending score.

    Taking links one by one, a link joins two chains if both its segments are ends of
    different chains.  The same links are taken in rounds: a link that is the best one left at
    both of its chains would be taken before any other that touches them, so all such links
    join at once.  Each round is a few joins of small tables, and every segment keeps its
    place and orientation as chains are reversed and appended.
    """
    m = segments.select("order_index", F.col("order_index").alias("chain"), F.lit(0).alias("pos"), F.lit(1).alias("size"), F.lit(False).alias("inverted"))
    return _joined(m, links.where(F.col("score") >= threshold), True, max_rounds)


def merged_chains(chained: DataFrame, links: DataFrame, threshold: float, max_rounds: int | None = None) -> DataFrame:
    """Chains (as ``chains`` returns them) merged by their best link, whichever segments it joins.

    Links of at least max(0.05, 0.3 threshold) count.  Two chains of two or more segments stay
    apart if the link scores under half of the weaker chain's mean score between neighbours.
    """
    size = F.count(F.lit(1)).over(W.Window.partitionBy("chain")).cast("int")
    m = chained.withColumn("size", size).select("order_index", "chain", "pos", "size", "inverted")
    return _joined(m, links.where(F.col("score") >= max(MIN_SCORE, 0.3 * threshold)), False, max_rounds)


def _joined(m: DataFrame, links: DataFrame, ends_only: bool, max_rounds: int | None) -> DataFrame:
    """Rounds of joining; each is one written table of segments, with a mark on those that it moved."""
    kept = written(links.select("a", "b", "orientation", "score"), "links")
    m = written(m.withColumn("moved", F.lit(True)), "chains")
    for k in itertools.count():
        at_end = (F.col("pos") == 0) | (F.col("pos") == F.col("size") - 1)
        end = m.where(at_end) if ends_only else m
        side = lambda p: end.select(F.col("order_index").alias(p), F.col("chain").alias(f"{p}_chain"), F.col("pos").alias(f"{p}_pos"), F.col("size").alias(f"{p}_size"))  # noqa: B023, E731
        open_links = kept.join(side("a"), "a").join(side("b"), "b").where("a_chain <> b_chain")
        if not ends_only:
            w = W.Window.partitionBy("chain").orderBy("pos")
            step = m.select("chain", F.col("order_index").alias("x"), F.lead("order_index").over(w).alias("y")).where("y is not null")
            near = step.select("chain", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).join(kept, ["a", "b"]).groupBy("chain").agg(F.avg("score").alias("mean"))
            mean = lambda p: near.select(F.col("chain").alias(f"{p}_chain"), F.col("mean").alias(f"{p}_mean"))  # noqa: B023, E731
            open_links = open_links.join(mean("a"), "a_chain", "left").join(mean("b"), "b_chain", "left")
            weak = (F.col("a_size") >= 2) & (F.col("b_size") >= 2) & F.coalesce(F.col("score") < 0.5 * F.least("a_mean", "b_mean"), F.lit(False))
            open_links = open_links.where(~weak).drop("a_mean", "b_mean")
        # the best link left of each chain; one that is the best of both of its chains is taken
        rank = F.struct((-F.col("score")).alias("s"), "a", "b")
        # a ends up last in its chain, b first in its own; single segments turn as the link wants
        want_a, want_b = F.col("orientation").isin("TH", "TT"), F.col("orientation").isin("HT", "TT")
        whole = (F.col("a_size") + F.col("b_size")).alias("whole")
        left = F.struct(F.col("a_chain").alias("chain"), F.col("a_chain").alias("into"), ((F.col("a_pos") == 0) & (F.col("a_size") > 1)).alias("turn"), F.when(F.col("a_size") == 1, want_a).alias("want"), F.lit(0).alias("shift"), whole)
        right = F.struct(F.col("b_chain").alias("chain"), F.col("a_chain").alias("into"), ((F.col("b_pos") == F.col("b_size") - 1) & (F.col("b_size") > 1)).alias("turn"), F.when(F.col("b_size") == 1, want_b).alias("want"), F.col("a_size").alias("shift"), whole)
        best = open_links.select(rank.alias("rank"), F.explode(F.array(left, right)).alias("move")).groupBy("move.chain").agg(F.min(F.struct("rank", "move")).alias("best"))
        both = W.Window.partitionBy("best.rank")
        moves = best.withColumn("agree", F.count(F.lit(1)).over(both)).where("agree = 2").select("best.move.*")
        j = m.drop("moved").join(moves, "chain", "left")
        turn = F.coalesce("turn", F.lit(False))
        pos = F.when(turn, F.col("size") - 1 - F.col("pos")).otherwise(F.col("pos")) + F.coalesce("shift", F.lit(0))
        inverted = F.when(F.col("want").isNotNull(), F.col("want")).when(turn, ~F.col("inverted")).otherwise(F.col("inverted"))
        after = written(j.select("order_index", F.coalesce("into", "chain").alias("chain"), pos.alias("pos"), F.coalesce("whole", "size").alias("size"), inverted.alias("inverted"), F.col("into").isNotNull().alias("moved")), "chains")
        dropped(m)
        m = after
        if not m.where("moved").limit(1).count():
            break
        if k == max_rounds:
            raise RuntimeError(f"chains did not settle in {max_rounds} rounds")
    dropped(kept)
    return m.select("order_index", "chain", "pos", "inverted")


def ordered_segments(chained: DataFrame) -> DataFrame:
    """(new_index, order_index, inverted): chains by size, largest first, then by id."""
    size = F.count(F.lit(1)).over(W.Window.partitionBy("chain"))
    rank = F.row_number().over(W.Window.orderBy(F.col("size").desc(), "chain", "pos")) - 1  # metadata: one row a segment
    return chained.withColumn("size", size).select(rank.cast("int").alias("new_index"), "order_index", "inverted")
