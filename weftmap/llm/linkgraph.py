"""URL filters: host rules, and trust and distrust over the link graph of hosts.

Rules judge the pages they fit; the longest wins.  For all others the method decides: trust
flows by personalised PageRank from hosts with allowed pages along links, distrust from hosts
with blocked pages along reversed links (who links to a bad host is suspect).  A host is blocked,
with all of its pages that no rule fits, if distrust is more than ``max_distrust`` of its trust,
its distrust and an even share of the mass that restarts, so that a trace of distrust blocks nothing.
Edges are absolute links between hosts, and links both ways between a host and the one above it, up
to names of two parts (``blog.a.org`` and ``a.org``), whether or not that has pages.

Scores of hosts without out-links leak, as the sums are only compared with each other.  Mass
moves on until all that is still on its way is below ``TOLERANCE`` of such a share, whatever the
number of hosts.  A host whose score is within that of a limit may fall on either side of it.

Defined results
    null url, no ``://``   host and path are empty; no rule fits; an empty host is allowed
    null html              no links
    unreached host         no distrust: allowed
    repeated rows          each page is judged; a host's seeds count them all
    empty table            no rows
    extra columns          not read
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, saved


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))
DAMPING, SAVE_EVERY, MAX_DISTRUST = 0.85, 8, 0.5
#: Mass still on its way at the end, at most, as a part of an even share of what restarts.
TOLERANCE = 1e-3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def by_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.host + r.path).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(src, dst, links) between different hosts, summed over all pages."""
    found = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"(?i)href\s*=\s*[\"']?\s*(?:https?:)?(//[^\s\"'<>]+)"), F.lit(1))
    links = pages.select(host_of(F.col(url)).alias("src"), F.explode(found).alias("to")).select("src", host_of(F.concat(F.lit(":"), F.col("to"))).alias("dst"))
    links = links.where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("links"))
    hosts = pages.select(host_of(F.col(url)).alias("host")).distinct().select(F.split("host", r"\.").alias("names"))
    # hosts above need no page of their own: mass moves through them between hosts of one name
    part = lambda k: F.array_join(F.slice("names", k, F.size("names")), ".")
    steps = F.transform(F.sequence(F.lit(1), F.size("names") - 2), lambda k: F.struct(part(k).alias("src"), part(k + 1).alias("dst")))
    above = hosts.where((F.size("names") > 2) & ~F.array_contains("names", "")).select(F.explode(steps).alias("s")).select("s.src", "s.dst").distinct().withColumn("links", F.lit(1.0))
    site = above.unionByName(above.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links"))
    return links.unionByName(site).groupBy("src", "dst").agg(F.sum("links").alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = 1e-9) -> DataFrame:
    """(kind, host, score): personalised PageRank of each kind over its own edges.

    ``edges`` (kind, src, dst, links) and ``seeds`` (kind, host, seed), seeds of a kind
    summing to 1.  Both kinds move in the same joins.  ``rest`` is the mass on its way, not yet
    in ``score``; once it has arrived, it may still bring at most damping / (1 - damping) times its
    sum, so a sum over one column tells when to stop.  A host has an edge to itself that keeps its
    columns, so a round is one join and one sum, and several rounds are one plan, which is written out.
    ``settled`` then adds the rounds so that little is left, which takes a few plans instead of a dozen.
    """
    out = edges.groupBy("kind", "src").agg(F.sum("links").alias("__all"))
    moves = edges.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("links") / F.col("__all") * damping).alias("share"))
    hosts = edges.select("kind", F.col("src").alias("host")).union(edges.select("kind", "dst")).union(seeds.select("kind", "host")).distinct()
    step = saved(moves.unionByName(hosts.select("kind", "host", F.col("host").alias("dst"), F.lit(None).cast("double").alias("share"))), "links")
    table = saved(seeds.select("kind", "host", F.lit(0.0).alias("score"), (F.col("seed") * (1 - damping)).alias("rest")), "scores")
    now, left = table, table.agg(F.sum("rest")).first()[0] or 0.0
    while left * damping / (1 - damping) >= tolerance:
        after = now.withColumnRenamed("rest", "r0")
        for k in range(SAVE_EVERY):
            met = after.join(step, ["kind", "host"]).where(F.col("share").isNull() | (F.col(f"r{k}") != 0))
            columns = ["score", *[f"r{j}" for j in range(k + 1)]]
            kept = [F.when(F.col("share").isNull(), F.col(c)).otherwise(0.0).alias(c) for c in columns]
            moved = F.coalesce(F.col(f"r{k}") * F.col("share"), F.lit(0.0)).alias(f"r{k + 1}")
            after = met.select("kind", F.col("dst").alias("host"), *kept, moved).groupBy("kind", "host").agg(*[F.sum(c).alias(c) for c in [*columns, f"r{k + 1}"]])
        after = saved(after, "scores")
        drop_saved(table)
        table = after
        now, left = settled(table)
    drop_saved(step)
    return now.select("kind", "host", F.greatest(F.col("score") + F.col("rest"), F.lit(0.0)).alias("score"))


def settled(rounds: DataFrame) -> tuple[DataFrame, float]:
    """(kind, host, score, rest) after rounds of ``rest``, r0 to the last, and the sum of what is left on its way.

    To add c times a round to the score takes c times (this round - the next) from the rest, whatever c
    is.  Least squares over all hosts choose the c of each round (restarted GMRES); only the sums of products
    come to the driver.  If that leaves more on its way than c = 1, which adds the rounds as they are,
    c is 1.  The c are rounded, so that reruns agree although Spark adds in another order.
    """
    r = [F.col(f"r{k}") for k in range(SAVE_EVERY + 1)]
    fall = [r[k] - r[k + 1] for k in range(SAVE_EVERY)]
    pairs = [(i, j) for i in range(SAVE_EVERY) for j in range(i + 1)]
    sums = rounds.agg(*[F.sum(fall[i] * fall[j]) for i, j in pairs], *[F.sum(f * r[0]) for f in fall], F.sum(F.abs(r[-1]))).first()
    square = np.zeros((SAVE_EVERY, SAVE_EVERY))
    for (i, j), v in zip(pairs, sums):
        square[i, j] = square[j, i] = v
    size = np.sqrt(square.diagonal())
    scale = np.divide(1, size, out=np.zeros(SAVE_EVERY), where=size > 0)
    to = np.array(sums[len(pairs) : -1]) * scale
    c = np.round(scale * (np.linalg.pinv(square * np.outer(scale, scale), rcond=1e-8, hermitian=True) @ to), 6)

    score, rest = F.col("score"), r[0]
    for k in range(SAVE_EVERY):
        score, rest = score + r[k] * float(c[k]), rest - fall[k] * float(c[k])
    best = rounds.select("kind", "host", score.alias("score"), rest.alias("rest"))
    left = best.agg(F.sum(F.abs("rest"))).first()[0]
    if left < sums[-1]:
        return best, left
    return rounds.select("kind", "host", sum(r[:-1], F.col("score")).alias("score"), r[-1].alias("rest")), sums[-1]


def filter_urls(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", rules: Sequence[Rule] = RULES, max_distrust: float = MAX_DISTRUST) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust, neighbours) of every page."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rule, verdict = by_rule(F.col("host"), F.col("path"), rules)
    judged = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path")).withColumns({"rule": rule, "__ruled": verdict})
    kind = F.when(F.col("__ruled") == "allow", "trust").otherwise("distrust")
    counts = judged.where("__ruled is not null and host <> ''").groupBy(kind.alias("kind"), "host").agg(F.count(F.lit(1)).cast("double").alias("__pages"))
    counts = saved(counts, "seeds")
    totals = counts.groupBy("kind").agg(F.sum("__pages").alias("__total"))
    seeds = counts.join(F.broadcast(totals), "kind").select("kind", "host", (F.col("__pages") / F.col("__total")).alias("seed"))  # two rows
    edges = saved(host_edges(pages, url, html), "edges")
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "links").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "links"))
    nodes = max(1, edges.select("src").union(edges.select("dst")).union(judged.select("host")).distinct().count())
    even = (1 - DAMPING) / nodes
    scores = propagate(both, seeds, tolerance=TOLERANCE * even)
    wide = scores.groupBy("host").agg(*[F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")])
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("neighbours")).withColumnRenamed("src", "host")
    known = wide.join(degree, "host", "full")
    out = judged.join(known, "host", "left").withColumns({k: F.coalesce(k, F.lit(0.0)) for k in ("trust", "distrust")})
    spread = F.when(F.col("distrust") > max_distrust * (F.col("trust") + F.col("distrust") + even), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("__ruled", spread).alias("verdict"), F.round("trust", 12).alias("trust"), F.round("distrust", 12).alias("distrust"), F.coalesce("neighbours", F.lit(0)).alias("neighbours"))
