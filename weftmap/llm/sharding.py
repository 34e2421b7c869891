"""Shards from a hierarchical weighted hash tree, in DataFrame functions.

A key descends region, rack and shard, at each level to the child of least draw.  A child draws
``-ln(u) / weight`` with ``u`` hashed from the key and the child's name; a region weighs what its
racks weigh, a rack what its shards weigh, so every node is chosen in proportion to its weight.  A
change of weights moves keys only where it changes draws: within the subtrees whose weights
change, and between them and the others.

Shards up to ``base`` fill racks and regions in order.  Every later one opens a region of its own, so
no weight of an older node changes and one more shard takes rows only into itself.  A layout
keeps its base for life.  A key costs a hash for each child on its way down.

Defined results
    null key        one fixed key of its own; all its rows share a shard
    null text       no bytes, crc32 of nothing (0)
    repeated rows   same shard, consecutive slots; which copy gets which slot doesn't matter
    empty table     no rows
    extra columns   kept by ``assign``, which refuses a name that the table has already
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import saved

SHARDS_PER_RACK, RACKS_PER_REGION = 4, 2
OVERHEAD_BYTES = 16
#: Rows of one shard that are numbered in one sort.
ROWS_PER_RUN = 100_000


def tree(weights: Sequence[float], base: int | None = None, per_rack: int = SHARDS_PER_RACK, per_region: int = RACKS_PER_REGION) -> list[list[list[tuple[int, float]]]]:
    """Regions of racks of (shard, weight): the first ``base`` fill them in order, each later one is a region."""
    leaves = [(k, float(w)) for k, w in enumerate(weights)]
    first = leaves[: len(leaves) if base is None else base]
    racks = [first[i : i + per_rack] for i in range(0, len(first), per_rack)]
    return [racks[i : i + per_region] for i in range(0, len(racks), per_region)] + [[[leaf]] for leaf in leaves[len(first) :]]


def descend(key: Column, regions: list) -> Column:
    """The shard at the end of the way down; nodes of weight 0 are left out."""

    def node(name: str, weight: float, **inner: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), F.lit(weight).alias("weight"), *[c.alias(k) for k, c in inner.items()])

    top = []
    for g, region in enumerate(regions):
        racks = []
        for k, rack in enumerate(region):
            shards = [node(f"shard{s}", w, shard=F.lit(s)) for s, w in rack if w > 0]
            if shards:
                racks.append(node(f"region{g}/rack{k}", sum(w for _, w in rack), children=F.array(*shards)))
        if racks:
            top.append(node(f"region{g}", sum(w for rack in region for _, w in rack), children=F.array(*racks)))
    u = lambda c: (F.shiftrightunsigned(F.xxhash64(key, c["name"]), 11).cast("double") + 0.5) / float(1 << 53)
    drawn = lambda children: F.array_min(F.transform(children, lambda c: F.struct((-F.log(u(c)) / c["weight"]).alias("draw"), c.alias("node"))))["node"]
    return drawn(drawn(drawn(F.array(*top))["children"])["children"])["shard"]


def assign(df: DataFrame, key: str, weights: Sequence[float], out: str = "shard", base: int | None = None) -> DataFrame:
    """``df`` with a column of shard numbers decided by ``key``, the weights and the layout's base alone."""
    if not any(w > 0 for w in weights):
        raise ValueError("a shard needs a weight above 0")
    if out in df.columns:
        raise ValueError(f"the table has a column {out}; name another one for the shard")
    return df.withColumn(out, descend(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null key")), tree(weights, base)))


def slots(df: DataFrame, shard: str, order: Sequence[str], rows_per_run: int = ROWS_PER_RUN) -> DataFrame:
    """Number the rows of each shard from 0 without a gap; ``df`` must be a saved table.

    A shard is cut into runs by a hash of its order columns, which should tell equal rows
    apart.  Run sizes are summed first (map-side), their running totals give each run its
    offset, and only a run is ever sorted in one task, so a shard may hold any number of rows.
    """
    runs = max(1, -(-df.count() // rows_per_run))
    df = df.withColumn("__run", F.pmod(F.xxhash64(*order), F.lit(runs)))
    sizes = df.groupBy(shard, "__run").agg(F.count(F.lit(1)).alias("__rows"))
    before = W.Window.partitionBy(shard).orderBy("__run").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = sizes.select(shard, "__run", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    inside = W.Window.partitionBy(shard, "__run").orderBy(*order)
    ranked = df.withColumn("__rank", F.row_number().over(inside) - 1)
    return ranked.join(offsets, [shard, "__run"]).withColumn("slot", F.col("__before") + F.col("__rank")).drop("__run", "__rank", "__before")


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Digest of ``docs``: size, text crc32, shard, slot and the shard with one more shard."""
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    slim = docs.select("doc_id", (F.octet_length(text) + OVERHEAD_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    slim = assign(assign(slim, "doc_id", [1.0] * shards), "doc_id", [1.0] * (shards + 1), "grown_shard", base=shards)
    # a written row number tells equal rows apart, so that they don't make one run
    numbered = slots(saved(slim.withColumn("__row", F.monotonically_increasing_id()), "shards"), "shard", ["doc_id", "text_crc32", "size", "__row"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
