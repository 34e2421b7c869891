"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same expected number of copies, target / size of
the source (at most 2).  The whole part is taken outright; the fractions are rounded in
pairs: two documents a and b move *words*, one up and the other down, until one of them is
whole.  With d1 the words that a can gain from b and d2 those that b can gain from a, a gains
with probability d2 / (d1 + d2).  That leaves each document's expectation unchanged and the
source's words exactly the same, so only the one document that is left over at the end makes
a difference: a source misses its target by at most the words of one document.

Pairs meet first inside hashed blocks of documents, each block leaving at most one fraction
for each source; then these residuals meet in a reduction tree of blocks of blocks, until a
source has one, which is rounded by its fraction.  Larger documents pair first, so the one
left over is a small one as a rule.  All draws are hashes of the documents, so
reruns agree.

Defined results
    null source     one source of its own, last in order
    null, empty or blank text   size 0: it takes no words and has the whole part of copies
    source of size 0            target 0
    repeated rows   each is a document of its own; the rows share what they get as a multiset
    empty table     no rows
    extra columns   are carried along; helper names start with two underscores
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .common import SPACES, positional, restored, saved, shuffle_partitions

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, LIMIT = 1.5, 2.0
DOCS_PER_BLOCK, FANOUT = 4_000, 64
EPS = 1e-9


def n_words(text: str = "text"):
    body = F.coalesce(F.col(text), F.lit(""))
    # runs of words become one letter each, spaces vanish
    return F.length(F.regexp_replace(F.regexp_replace(body, r"[^\x20\x09-\x0D]+", "x"), SPACES, "")).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """(__source, source_size, target): the shares, none above ``limit`` times its size.

    ``sizes`` has one row a document (__source, __size).  Sharing the excess again until none
    is above fills all sources to one level: with c = limit * size, the sources of least
    c / weight are full, and the rest share what is left.  One sort of the sources finds how
    many are full.
    """
    per = sizes.groupBy("__source").agg(F.sum("__size").cast("double").alias("__total"))
    in_order = W.Window.orderBy(F.col("__source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("__weight", F.get(cycle, ((F.row_number().over(in_order) - 1) % len(weights)).cast("int")))
    per = per.withColumn("__cap", limit * F.col("__total")).withColumn("__level", F.col("__cap") / F.col("__weight"))
    by_level = W.Window.orderBy("__level", F.col("__source").asc_nulls_last())
    before = by_level.rowsBetween(W.Window.unboundedPreceding, -1)
    whole = W.Window.partitionBy()
    per = per.withColumn("__left", share * F.sum("__total").over(whole) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0)))
    per = per.withColumn("__free", F.sum("__weight").over(whole) - F.coalesce(F.sum("__weight").over(before), F.lit(0.0)))
    per = per.withColumn("__even", F.col("__left") / F.col("__free"))
    # the first source, in this order, whose own level is above what is offered sets the level of all after it
    per = per.withColumn("__open", F.min(F.when(F.col("__level") > F.col("__even"), F.struct("__level", "__even"))).over(whole)["__even"])
    target = F.when(F.col("__level") > F.col("__open"), F.col("__weight") * F.col("__open")).otherwise(F.col("__cap"))
    return per.select("__source", F.col("__total").cast("long").alias("source_size"), target.alias("target"))


def _draws(keys: np.ndarray) -> np.ndarray:
    """Uniform numbers from 64-bit keys (a finaliser of shifts and multiplications)."""
    x = keys.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _pivot(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Round the fractions of rows in order of (__block, __source); at most one of each group stays.

    A row that is still fractional waits, as a slice of its batch, for the next of its group.
    """
    waiting: pa.RecordBatch | None = None
    held: tuple | None = None  # (group, fraction, size, key) of the waiting row
    for batch in batches:
        if not batch.num_rows:
            continue
        col = {n: batch.column(batch.schema.get_field_index(n)) for n in ("__block", "__source", "__frac", "__size", "__key")}
        blocks, sources = col["__block"].to_pylist(), col["__source"].to_pylist()
        frac, size = col["__frac"].to_numpy(zero_copy_only=False).copy(), col["__size"].to_numpy(zero_copy_only=False).astype(float)
        keys = col["__key"].to_numpy(zero_copy_only=False)
        open_row, first = None, waiting  # index in this batch of the row that waits
        out_wait = None
        for k in range(batch.num_rows):
            group = (blocks[k], sources[k])
            if held is not None and held[0] != group:
                if open_row is None and first is not None:
                    out_wait, first = (first, held[1]), None
                held, open_row = None, None
            p, s = frac[k], size[k]
            if p <= EPS or p >= 1 - EPS:
                frac[k] = round(p)
                continue
            if held is None:
                held, open_row = (group, p, s, keys[k]), k
                continue
            _, q, t, key = held
            gain, loss = min((1 - q) * t, p * s), min(q * t, (1 - p) * s)  # words to the waiting row, or from it
            u = _draws(np.array([key], dtype=np.int64).view(np.uint64) ^ (np.array([keys[k]], dtype=np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))[0]
            if u * (gain + loss) < loss:
                q, p = q + gain / t, p - gain / s
            else:
                q, p = q - loss / t, p + loss / s
            q, p = (round(x) if x <= EPS or x >= 1 - EPS else x for x in (q, p))
            frac[k] = p
            if open_row is None:
                if q in (0, 1):
                    out_wait, first = (first, float(q)), None
                    held, open_row = ((group, p, s, keys[k]), k) if p not in (0, 1) else (None, None)
                else:
                    held = (group, q, t, key)
            else:
                frac[open_row] = q
                if q in (0, 1):
                    held, open_row = ((group, p, s, keys[k]), k) if p not in (0, 1) else (None, None)
                else:
                    held = (group, q, t, key)
            if out_wait is not None:
                yield _with_frac(out_wait[0], np.array([out_wait[1]]), schema)
                out_wait = None
        if out_wait is not None:
            yield _with_frac(out_wait[0], np.array([out_wait[1]]), schema)
        done = _with_frac(batch, frac, schema)
        if open_row is None:
            waiting = _with_frac(first, np.array([held[1]]), schema) if held is not None and first is not None else None
            yield done
        else:
            waiting = done.slice(open_row, 1)
            yield done.slice(0, open_row)
            yield done.slice(open_row + 1)
    if waiting is not None:
        yield waiting


def _with_frac(batch: pa.RecordBatch, frac: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(frac, pa.float64()) if f.name == "__frac" else batch.column(k) for k, f in enumerate(batch.schema)]
    return pa.RecordBatch.from_arrays(columns, names=[f.name for f in batch.schema])


def pivotal_copies(docs: DataFrame, source: str = "source", text: str = "text", weights: Sequence[float] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, size: str | None = None, docs_per_block: int = DOCS_PER_BLOCK, fanout: int = FANOUT) -> DataFrame:
    """``docs`` with ``__size``, ``__source_size``, ``__target`` (its source's) and ``__copies``.

    Where ``docs`` has such a column itself, the one here gets one more underscore in front.
    """
    spark = docs.sparkSession
    inner, (source, counted) = positional(docs, source, size or text)
    own = inner.columns
    df = inner.withColumn("__size", F.col(counted).cast("long") if size else n_words(counted)).withColumn("__source", F.col(source))
    tallied = saved(df.groupBy("__source").agg(F.sum("__size").alias("__size"), F.count(F.lit(1)).alias("__rows")), "mix-sizes")
    targets = source_targets(tallied, weights, share, limit).withColumnsRenamed({"source_size": "__source_size", "target": "__target", "__source": "__its"})
    rows = tallied.agg(F.sum("__rows")).first()[0] or 0
    blocks = max(1, -(-rows // docs_per_block))
    df = df.join(targets, F.col("__source").eqNullSafe(F.col("__its"))).drop("__its")
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    df = df.withColumn("__rate", F.least(F.lit(float(limit)), rate)).withColumn("__whole", F.floor(F.col("__rate") + F.lit(EPS)).cast("long"))
    df = df.withColumn("__frac", F.when(F.col("__size") > 0, F.greatest(F.lit(0.0), F.col("__rate") - F.col("__whole"))).otherwise(F.lit(0.0)))
    df = df.withColumn("__key", F.xxhash64(*[F.col(f"`{c}`") for c in own if inner.schema[c].dataType.typeName() not in ("map", "variant")]))
    df = df.withColumn("__block", F.pmod(F.xxhash64("__key", F.lit(7)), F.lit(blocks)).cast("long")).drop("__rate")
    schema = df.schema

    def level(rows: DataFrame) -> DataFrame:
        n = max(1, min(shuffle_partitions(spark), blocks))
        dealt = rows.repartition(n, "__block").sortWithinPartitions("__block", F.col("__source").asc_nulls_last(), F.col("__size").desc(), "__key")
        return dealt.mapInArrow(lambda it: _pivot(it, None), T.StructType([*schema]))

    done = saved(level(df), "mix")
    parts, is_open = [], (F.col("__frac") > 0) & (F.col("__frac") < 1)
    while blocks > 1:
        parts.append(done.where(~is_open))
        blocks = -(-blocks // fanout)
        done = saved(level(done.where(is_open).withColumn("__block", F.floor(F.col("__block") / fanout))), "mix")
    last = done.withColumn("__frac", F.when(is_open, F.when(F.pmod(F.xxhash64("__key", F.lit(11)), F.lit(1 << 30)) < F.col("__frac") * (1 << 30), 1.0).otherwise(0.0)).otherwise(F.col("__frac")))
    for p in parts:
        last = last.unionByName(p)
    last = last.withColumn("__copies", (F.col("__whole") + F.round("__frac")).cast("long"))
    named = [F.col(f"in{k}").alias(c) for k, c in enumerate(docs.columns)]
    return last.select(*named, *[F.col(c).alias(_free(c, docs.columns)) for c in ("__size", "__source_size", "__target", "__copies")])


def _free(name: str, taken: Sequence[str]) -> str:
    return _free("_" + name, taken) if name in taken else name


def mix(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    inner, (source, text) = positional(docs, source, text)
    counted = pivotal_copies(inner, source, text).where(F.col("__copies") > 0)
    return restored(counted.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))), docs)


def mix_documents(docs: DataFrame) -> DataFrame:
    """Digest of the mix: size, source size, target and words taken of every document."""
    slim = docs.select("doc_id", "source", n_words().alias("size"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("text_md5"))
    out = pivotal_copies(slim, size="size")
    return out.select("doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__copies") * F.col("size")).alias("taken"))
