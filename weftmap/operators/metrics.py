"""Assembly metrics, ordering metrics and evaluation against a truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.tables import written


def n_statistics(lengths: DataFrame, *by: str, levels: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """(by, n50, l50, n90, l90): shortest length among the longest that make up a share, and their number.

    Equal lengths are counted first, so the running sum is over distinct lengths.
    """
    g = lengths.groupBy(*by, "length").agg(F.count(F.lit(1)).alias("c"))
    w = W.Window.partitionBy(*by).orderBy(F.col("length").desc())
    before = w.rowsBetween(W.Window.unboundedPreceding, -1)
    size = F.col("c") * F.col("length")
    g = g.withColumns({"cum": F.coalesce(F.sum(size).over(before), F.lit(0)), "k": F.coalesce(F.sum("c").over(before), F.lit(0)), "total": F.sum(size).over(W.Window.partitionBy(*by))})
    cols = []
    for q in levels:
        name, want = round(q * 100), F.lit(q) * F.col("total")
        inside = F.col("cum") < want
        # of the last length that is needed, as many as it takes
        need = F.least(F.col("c"), F.greatest(F.lit(1), F.ceil((want - F.col("cum")) / F.when(F.col("length") > 0, F.col("length")))))
        cols += [F.coalesce(F.min(F.when(inside, F.col("length"))), F.lit(0)).cast("long").alias(f"n{name}"), F.coalesce(F.max(F.when(inside, F.col("k") + need)), F.lit(0)).cast("long").alias(f"l{name}")]
    return g.groupBy(*by).agg(*cols) if by else g.agg(*cols)


def aun(length: str = "length") -> Column:
    """Area under the Nx curve: sum of squares over the sum; 0 without length.

    Squares of whole lengths are summed as decimals: exact, and they fit wherever the sum of lengths fits a long.
    """
    total, whole = F.sum(length), F.col(length).cast("decimal(19,0)")
    return F.coalesce(F.sum(whole * whole).cast("double") / F.when(total > 0, total), F.lit(0.0))


def assembly_metrics(segments: DataFrame) -> DataFrame:
    """One row of counts, lengths, N and L statistics of segments and of scaffolds.

    A segment without a scaffold is a scaffold of its own.
    """
    basic = segments.agg(
        F.count(F.lit(1)).cast("long").alias("count"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("total"), F.coalesce(F.min("length"), F.lit(0)).cast("long").alias("shortest"), F.coalesce(F.max("length"), F.lit(0)).cast("long").alias("longest"),
        F.coalesce(F.avg("length"), F.lit(0.0)).alias("mean"), F.coalesce(F.median("length"), F.lit(0.0)).alias("median"), aun().alias("aun"),
        F.count_distinct("scaffold_id").cast("long").alias("scaffolds"), F.coalesce(F.sum(F.when(F.col("scaffold_id").isNotNull(), F.col("length"))) / F.when(F.sum("length") > 0, F.sum("length")), F.lit(0.0)).alias("assigned"),
    )
    key = F.coalesce(F.concat(F.lit("s"), F.col("scaffold_id").cast("string")), F.concat(F.lit("c"), F.col("order_index").cast("string")))
    whole = segments.groupBy(key.alias("key")).agg(F.sum("length").alias("length"))
    scaf = whole.agg(aun().alias("scaffold_aun"), F.coalesce(F.max("length"), F.lit(0)).cast("long").alias("largest_scaffold"))
    n = n_statistics(segments.select("length"))
    ns = n_statistics(whole.select("length"), levels=(0.5,)).withColumnsRenamed({"n50": "scaffold_n50", "l50": "scaffold_l50"})
    return basic.crossJoin(n).crossJoin(scaf).crossJoin(ns)  # one row each


def metric_changes(history: DataFrame, *values: str) -> DataFrame:
    """One row: the last snapshot's values less the first's, by seq; NULL with fewer than two."""
    first, last = [F.min_by(v, "seq") for v in values], [F.max_by(v, "seq") for v in values]
    enough = F.count(F.lit(1)) >= 2
    return history.agg(F.count(F.lit(1)).cast("long").alias("snapshots"), *[F.when(enough, b - a).alias(f"{v}_change") for v, a, b in zip(values, first, last)])


def earlier_items(ranked: DataFrame, *by: str) -> DataFrame:
    """(by, pos, truth, less, more): how many items that come earlier by pos have a lower, and a higher, truth.

    A merge sort in windows: at level L the places fall into blocks of 2**(L + 1), and an item
    of a right half meets the left half of its block in a running sum over the sorted truths.
    Two items meet at one level only, so this is n log n rows for n items (metadata: one row a
    segment).
    """
    place = F.row_number().over(W.Window.partitionBy(*by).orderBy("pos")) - 1
    r = ranked.where(F.col("truth").isNotNull()).withColumn("__k", place.cast("long"))
    top = r.groupBy(*by).agg(F.length(F.bin(F.max("__k"))).alias("__levels"))
    r = r.join(top, list(by)) if by else r.crossJoin(F.broadcast(top))  # one row
    at = r.select("*", F.explode(F.sequence(F.lit(0), F.col("__levels") - 1)).alias("__level"))
    shifted = lambda n: F.call_function("shiftright", F.col("__k"), n)  # noqa: E731  the width is a column
    at = at.withColumn("__block", shifted(F.col("__level") + 1)).withColumn("__left", (shifted(F.col("__level")) % 2 == 0).cast("long"))
    block = W.Window.partitionBy(*by, "__level", "__block")
    upto, same, whole = F.sum("__left").over(block.orderBy("truth")), F.sum("__left").over(W.Window.partitionBy(*by, "__level", "__block", "truth")), F.sum("__left").over(block)
    met = at.withColumns({"__less": upto - same, "__more": whole - upto}).where("__left = 0")
    sums = met.groupBy(*by, "__k").agg(F.sum("__less").alias("less"), F.sum("__more").alias("more"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return r.join(sums, [*by, "__k"], "left").select(*by, "pos", "truth", zero("less"), zero("more"))


def kendall_tau(ranked: DataFrame, *by: str) -> DataFrame:
    """(by, items, tau) from (by, pos, truth): concordant less discordant pairs over all pairs."""
    e = earlier_items(ranked, *by)
    sums = [F.count(F.lit(1)).cast("long").alias("items"), F.sum((F.col("less") - F.col("more")).cast("double")).alias("s")]
    j = e.groupBy(*by).agg(*sums) if by else e.agg(*sums)
    pairs = F.col("items") * (F.col("items") - 1) / 2
    return j.select(*by, "items", F.coalesce(F.coalesce("s", F.lit(0.0)) / F.when(pairs > 0, pairs), F.lit(1.0)).alias("tau"))


def longest_run(ranked: DataFrame, *by: str) -> DataFrame:
    """(by, longest): most consecutive items whose truth goes up by one each."""
    w = W.Window.partitionBy(*by).orderBy("pos")
    step = F.coalesce((F.col("truth") - F.lag("truth").over(w) != 1).cast("int"), F.lit(0))
    r = ranked.where(F.col("truth").isNotNull()).withColumn("step", step)
    r = r.withColumn("run", F.sum("step").over(w))
    g = r.groupBy(*by, "run").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy(*by).agg(F.max("n").cast("long").alias("longest")) if by else g.agg(F.max("n").cast("long").alias("longest"))


def adjusted_rand(pairs: DataFrame, *by: str) -> DataFrame:
    """(by, ari): agreement of two labellings (pred, truth), corrected for chance; 1 if undefined."""
    two = lambda c: (F.sum(F.col(c) * (F.col(c) - 1)) / 2)
    cell = pairs.groupBy(*by, "pred", "truth").agg(F.count(F.lit(1)).cast("double").alias("c"))
    summed = lambda df, *what: df.groupBy(*by).agg(*what) if by else df.agg(*what)
    rows = summed(cell.groupBy(*by, "pred").agg(F.sum("c").alias("c")), two("c").alias("a"))
    cols = summed(cell.groupBy(*by, "truth").agg(F.sum("c").alias("c")), two("c").alias("b"))
    both = summed(cell, two("c").alias("x"), F.sum("c").alias("n"))
    j = both.join(rows, list(by)).join(cols, list(by)) if by else both.crossJoin(rows).crossJoin(cols)  # one row each
    wanted = F.col("a") * F.col("b") / F.when(F.col("n") > 1, F.col("n") * (F.col("n") - 1) / 2)
    top = (F.col("a") + F.col("b")) / 2 - wanted
    return j.select(*by, F.coalesce(F.when(F.abs(top) > 1e-12, (F.col("x") - wanted) / F.when(F.abs(top) > 1e-12, top)), F.lit(1.0)).alias("ari"))


def chain_quality(items: DataFrame) -> DataFrame:
    """One row from (chain, chrom, inverted, truth_inverted): orientation accuracy, purity, completeness.

    Purity is the mean over chains of the share of the commonest chromosome; completeness the
    mean over chromosomes of the share of the commonest chain.
    """
    n = items.groupBy("chain", "chrom").agg(F.count(F.lit(1)).alias("c"))
    share = lambda key, name: n.groupBy(key).agg((F.max("c") / F.sum("c")).alias("q")).agg(F.coalesce(F.avg("q"), F.lit(0.0)).alias(name))
    right = items.agg(F.coalesce(F.avg((F.col("inverted") == F.col("truth_inverted")).cast("int")), F.lit(1.0)).alias("orientation"))
    return right.crossJoin(share("chain", "purity")).crossJoin(share("chrom", "completeness"))  # one row each


def chromosome_completeness(items: DataFrame) -> DataFrame:
    """One row: macro and micro share of base pairs in each chromosome's best chain, and how many exceed 0.9."""
    n = items.groupBy("chrom", "chain").agg(F.sum("length").alias("bp")).groupBy("chrom").agg(F.max("bp").alias("best"), F.sum("bp").alias("total"))
    q = F.col("best") / F.when(F.col("total") > 0, F.col("total"))
    return n.agg(F.coalesce(F.avg(q), F.lit(0.0)).alias("macro"), F.coalesce(F.sum("best") / F.when(F.sum("total") > 0, F.sum("total")), F.lit(0.0)).alias("micro"), F.count_if(q > 0.9).cast("long").alias("complete"), F.count(F.lit(1)).cast("long").alias("chromosomes"))


def breakpoint_matches(found: DataFrame, truth: DataFrame, tolerance: int) -> DataFrame:
    """(grp, p, q): one-to-one matches of found (grp, p) and true (grp, q) points within a tolerance.

    Rounds of mutual nearest points (ties to the left) take, at each step, what nearest-first
    matching would take.
    """
    gap = F.abs(F.col("p") - F.col("q"))
    left = written(found.join(truth, "grp").where(gap <= tolerance).select("grp", "p", "q"), "candidates")
    done = None
    while True:  # each round takes the nearest pair left, at least
        r = left.withColumn("kp", F.row_number().over(W.Window.partitionBy("grp", "p").orderBy(gap, "q"))).withColumn("kq", F.row_number().over(W.Window.partitionBy("grp", "q").orderBy(gap, "p")))
        took = written(r.where("kp = 1 and kq = 1").select("grp", "p", "q"), "matches")
        done = took if done is None else done.unionByName(took)
        left = written(left.join(took.select("grp", "p"), ["grp", "p"], "left_anti").join(took.select("grp", "q"), ["grp", "q"], "left_anti"), "candidates")
        if left.limit(1).count() == 0:
            break
    return done


def precision_recall(found: DataFrame, truth: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: precision (1 if nothing was found), recall (1 if there was nothing), F1."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).cast("double").alias(name))
    j = n(found, "f").crossJoin(n(truth, "t")).crossJoin(n(matches, "m"))  # one row each
    ratio = lambda a, b: F.coalesce(a / F.when(b > 0, b), F.lit(1.0))
    j = j.withColumns({"precision": ratio(F.col("m"), F.col("f")), "recall": ratio(F.col("m"), F.col("t"))})
    s = F.col("precision") + F.col("recall")
    return j.select(F.col("m").cast("long").alias("matched"), "precision", "recall", F.coalesce(2 * F.col("precision") * F.col("recall") / F.when(s > 0, s), F.lit(0.0)).alias("f1"))


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def health_score(rows: DataFrame) -> DataFrame:
    """Adds five component scores from 0 to 100 and their weighted mean; an input that is NULL scores 50.

    Columns: n50, total, exponent, flags, eigenvalue, checkerboard, cis_ratio.
    """
    share = F.col("n50") / F.when(F.col("total") > 0, F.col("total"))
    fifty = F.lit(50.0)
    parts = {
        "contiguity": F.coalesce(F.when(share <= 0.1, F.lit(0.0)).otherwise(clamp((1 + F.log10(share)) * 100)), fifty),
        "decay": F.coalesce(clamp(100 - F.abs(F.col("exponent") + 1.15) / 0.85 * 100), fifty),
        "integrity": F.coalesce(clamp(100.0 - 10.0 * F.col("flags")), fifty),
        "compartments": F.coalesce((clamp(200 * F.col("eigenvalue")) + clamp(F.col("checkerboard"))) / 2, fifty),
        "library": F.coalesce(clamp(F.col("cis_ratio") / 0.7 * 100), fifty),
    }
    # Weights of the components
    weights = {"contiguity": 0.20, "decay": 0.25, "integrity": 0.20, "compartments": 0.15, "library": 0.20}
    out = rows.withColumns(parts)
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + w * F.col(name)
    return out.withColumn("overall", F.floor(total + 0.5).cast("long"))


def sort_metrics(items: DataFrame) -> DataFrame:
    """One row of all ordering metrics from (pos, truth, chain, chrom, inverted, truth_inverted): the chain is the predicted cluster."""
    clusters = items.select(F.dense_rank().over(W.Window.orderBy("chain")).alias("pred"), F.dense_rank().over(W.Window.orderBy("chrom")).alias("truth"))
    ranked = items.select("pos", "truth")
    return kendall_tau(ranked).crossJoin(longest_run(ranked)).crossJoin(adjusted_rand(clusters)).crossJoin(chain_quality(items))  # one row each


def run_summary(rows: DataFrame, value: str) -> DataFrame:
    """One row: mean, sample deviation (0 of one) and number of a measure over runs."""
    return rows.agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.count(F.lit(1)).alias("n"))


def rating_summary(rows: DataFrame, by: str, rating: str) -> DataFrame:
    """(by, n, mean_rating) of each kind."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(rating).alias("mean_rating"))


def layout_counts(rows: DataFrame, component: str, object_: str, named: Column) -> DataFrame:
    """One row: components, objects, named objects, and components placed in those."""
    return rows.agg(F.count_distinct(component).alias("components"), F.count_distinct(object_).alias("objects"), F.count_distinct(F.when(named, F.col(object_))).alias("named"), F.count_if(named).alias("placed"))


def reoriented(before: DataFrame, after: DataFrame, key: str = "k", turned: str = "inverted") -> DataFrame:
    """One row: components whose orientation differs from the layout before, or which are new."""
    old = before.select(key, F.col(turned).alias("__before"))
    return after.select(key, turned).join(old, key, "left").where(~F.col("__before").eqNullSafe(F.col(turned))).agg(F.count(F.lit(1)).alias("changed"))


def progress(series: DataFrame, order: str, value: str = "tau", least: float = 0.001) -> DataFrame:
    """Adds ``change`` against the state before, and whether it improves; metadata: one row a state."""
    change = F.col(value) - F.lag(value).over(W.Window.orderBy(order))
    return series.withColumn("change", change).withColumn("improving", F.coalesce(F.col("change") > least, F.lit(False)))


def best_settings(grid: DataFrame, parts: dict[str, tuple[Column, float]], keep: tuple[str, ...], n: int) -> DataFrame:
    """The ``n`` best rows of a table of settings by a weighted score, then by the settings."""
    score = sum((weight * c for c, weight in parts.values()), F.lit(0.0))
    return grid.select(*keep, score.alias("score")).orderBy(F.col("score").desc(), *keep).limit(n)
