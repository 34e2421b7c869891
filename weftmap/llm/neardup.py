"""Near-duplicate documents by DartMinHash signatures, banded joining and an exact check.

A document is a weighted set: its five-word shingles, weighted by how often they occur (all
words as one shingle if there are fewer than five).  Hashed darts land in the region of each
element, [0, weight) by rank [0, infinity), as a Poisson process with rate 1, each on one of K
coordinates; all documents that hold an element see the same darts.  A coordinate keeps its
dart of least rank.  Two documents agree on a coordinate with probability equal to their
weighted Jaccard similarity.  Only ranks up to K (ln K + 2) / total weight are thrown, so the
work is the number of elements plus about K ln K darts, not elements times K; documents
with an empty coordinate throw on with twice the rank.

Bands of ROWS coordinates make buckets.  Equal texts count once.  Each text is first checked
against the hubs it shares most buckets with, exactly, on the weighted shingle sets.
Classes are connected components.  Then every pair of texts of different classes in a bucket
is checked, or ruled out by exact bounds: the sizes of the two sets, and that a set must share
one of its |set| - ceil(0.8 |set|) + 1 rarest units with any set like it.  The pairs of a bucket
are dealt in blocks of about BLOCK_TEXTS texts: those outside its largest class against each
other and against those inside it.  A block merges classes as it finds links and leaves out
pairs of one class, which no link can change.  So the result is the components of all pairs of
a bucket at 0.8 or more.  The checks of a group in one class grow with its size; those of a
group that falls into many classes grow with the square, in as many blocks.

With 36 bands of 6 a pair of similarity 0.8 shares no bucket with probability 2e-5.

What is shuffled: one row of signatures a text, three numbers a band of it, and the texts and
sets of those that share a bucket.  A text is known by the two halves of its MD5 digest.

Defined results
    null text          an empty text
    no words           all such texts make one class (their shingle sets are equal)
    repeated rows      each gets the class of its text; a class is named by its least doc_id
    null doc_id        sorts after all others when a class is named; null if it has no other
    one text           a class of its own
    empty table        no rows
    extra columns      ``keep_first`` carries them; helper names start with two underscores
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, drop_saved, positional, restored, saved
from .components import components
from .shingles import SHINGLE, mix, units_by_text

THRESHOLD = 0.8
BANDS, ROWS = 36, 6
#: Hubs that a text meets at first.
FIRST_HUBS = 2
#: Texts and bytes of units on one side of a block, about.
BLOCK_TEXTS, BLOCK_BYTES = 256, 1 << 24
#: Rows that go to Python at once: shingle sets are wide.
BATCH_ROWS = 256
#: Darts that are thrown at once when few elements are left.
DARTS_AT_ONCE = 1 << 14
U = np.uint64


def units(text: str, size: int = SHINGLE) -> np.ndarray:
    """The weighted set of one text as a plain one, ascending."""
    return next(units_by_text(pa.array([text]), size))[2]


def dart_signatures(elements: np.ndarray, owner: np.ndarray, n: int, k: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Signatures (n, k) of n weighted sets, as the hash of the earliest dart at each coordinate.

    ``elements`` and ``owner`` give the elements of all sets.  Elements without ``weight``
    have weight 1; with it, each is a whole or partial strip [0, weight) with weight <= 1, on
    which darts also have a place.  Sets without elements keep zeros.
    """
    best = np.full(n * k, np.inf)
    sign = np.zeros(n * k, dtype=np.uint64)
    total = np.bincount(owner, weights=weight, minlength=n)
    full = total > 0
    reach = np.zeros(n)
    reach[full] = k * (np.log(k) + 2) / total[full]
    todo = full
    while todo.any():
        own = slice(None) if todo.all() else todo[owner]
        e, d, w = elements[own], owner[own], np.ones(1) if weight is None else weight[own]
        _throw(e, d * k, reach[d], w, k, best, sign)
        todo = full & np.isinf(best.reshape(n, k)).any(axis=1)
        reach[todo] *= 2
        best.reshape(n, k)[todo] = np.inf
    return sign.reshape(n, k)


def _throw(e: np.ndarray, base: np.ndarray, reach: np.ndarray, w: np.ndarray, k: int, best: np.ndarray, sign: np.ndarray) -> None:
    """All darts of the elements up to their reach; ``best`` and ``sign`` keep the earliest of each cell."""
    rank, i, weighted = np.zeros(len(e)), 0, len(w) == len(e) and (w < 1).any()
    while len(e):
        m = max(1, min(DARTS_AT_ONCE // 64, DARTS_AT_ONCE // len(e)))  # arrivals of each element in this turn
        with np.errstate(over="ignore"):
            h = mix(e[:, None] + (np.arange(i, i + m, dtype=np.uint64) * U(2) + U(1)) * U(0x9E3779B97F4A7C15))
        ranks = rank[:, None] - np.cumsum(np.log(((h >> U(11)).astype(np.float64) + 0.5) / float(1 << 53)), axis=1)
        on = ranks <= reach[:, None]
        row, _ = np.nonzero(on)
        g, r = mix(h[on] ^ U(0xA0761D6478BD642F)), ranks[on]
        cell = base[row] + ((g >> U(32)) * U(k) >> U(32)).astype(np.int64)
        if weighted:
            inside = mix(g ^ U(0xE7037ED1A0B428DB)) / 2.0**64 < w[row]
            g, r, cell = g[inside], r[inside], cell[inside]
        np.minimum.at(best, cell, r)
        won = best[cell] == r
        sign[cell[won]] = g[won]
        more = np.flatnonzero(on[:, -1])
        e, base, reach, rank = e[more], base[more], reach[more], ranks[more, -1]
        if weighted:
            w = w[more]
        i += m


def _bands(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, n, sets, sizes in units_by_text(batch.column(2)):
            sign = dart_signatures(sets, np.repeat(np.arange(n), sizes), n, bands * rows)
            out = np.zeros((n, bands), dtype=np.uint64)
            with np.errstate(over="ignore"):
                for r in range(rows):
                    out = mix(out * U(0x9E3779B97F4A7C15) + sign[:, r::rows] + U(r))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(out.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(1).slice(at, n), lists], names=["__hi", "__lo", "__bands"])


def _units_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, n, sets, sizes in units_by_text(batch.column(2)):
            ends = np.cumsum(sizes)
            each = [sets[end - size : end].tobytes() for end, size in zip(ends, sizes)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(each, pa.binary()), pa.array(8 * sizes, pa.int64())], names=["__hi", "__lo", "__units", "__bytes"])


def block_links(roots: list, inner: np.ndarray, own: np.ndarray, sets: list[np.ndarray], threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Links (places of two texts) that join all classes of a block that a pair at ``threshold`` joins.

    Pairs of texts of different sides, and of texts that are both ``own``, are checked.
    """
    n, out = len(sets), []
    names: dict = {}
    local = np.array([names.setdefault(r, len(names)) for r in roots])
    sizes = np.array([len(x) for x in sets])
    found, unit, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    holders = np.repeat(np.arange(n), sizes)[np.argsort(unit, kind="stable")]
    ends, at = np.cumsum(times), np.cumsum(sizes)
    starts, place = ends - times, np.arange(n)
    for u in range(n):
        maybe = (place > u) & (local != local[u]) & ((inner != inner[u]) | (own & own[u]))
        maybe &= np.minimum(sizes, sizes[u]) >= threshold * np.maximum(sizes, sizes[u]) - 1e-9
        if not maybe.any():
            continue
        if not sizes[u]:
            like = maybe  # sets without elements are equal
        else:
            mine = unit[at[u] - sizes[u] : at[u]]
            mine = mine[np.argsort(times[mine], kind="stable")]
            first = sizes[u] - int(np.ceil(threshold * sizes[u] - 1e-9)) + 1
            rare = [holders[starts[k] : ends[k]] for k in mine[:first] if times[k] > 1]
            if not rare:
                continue
            reached = np.zeros(n, dtype=bool)
            reached[np.concatenate(rare)] = True
            maybe &= reached
            if not maybe.any():
                continue
            both = np.bincount(np.concatenate([*rare, *(holders[starts[k] : ends[k]] for k in mine[first:])]), minlength=n)
            like = maybe & (both / (sizes + sizes[u] - both + (sizes + sizes[u] == 0)) >= threshold)
        for v in np.flatnonzero(like):
            if local[v] != local[u]:
                out.append((u, int(v)))
                local[local == local[v]] = local[u]
    return out


def _linked(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Links of the blocks whose rows follow each other."""

    def links(rows: list[tuple]) -> pa.RecordBatch:
        _, texts, roots, inner, own, sets = zip(*rows)
        pairs = block_links(roots, np.array(inner), np.array(own), [np.frombuffer(x, np.uint64) for x in sets], threshold)
        return pa.RecordBatch.from_arrays([pa.array([f(texts[i], texts[j]) for i, j in pairs], pa.binary()) for f in (max, min)], names=["u", "v"])

    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and rows[0][0] != row[0]:
                yield links(rows)
                rows = []
            rows.append(row)
    if rows:
        yield links(rows)


def _half(text: str, at: int) -> Column:
    """Half of the digest of a text, as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))), at, 16), 16, -10).cast("long")


def _node() -> Column:
    """The digest of a text as the name of a node."""
    return F.unhex(F.concat(F.lpad(F.hex("__hi"), 16, "0"), F.lpad(F.hex("__lo"), 16, "0")))


def _with_digest(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumn("__hi", _half(text, 1)).withColumn("__lo", _half(text, 17))


TEXT = ["__hi", "__lo"]


def classes(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(__hi, __lo, __class) for every text that is linked to another.

    Returns a saved table.  ``__class`` is the least digest of the connected component.
    """
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        return _classes(docs, text, threshold, bands, rows)


def _classes(docs: DataFrame, text: str, threshold: float, bands: int, rows: int) -> DataFrame:
    each = _with_digest(docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__body")), "__body").select(*TEXT, "__body")
    signed = each.mapInArrow(lambda it: _bands(it, bands, rows), "__hi long, __lo long, __bands array<long>")
    # copies of a text meet here, in partial aggregates first
    signed = saved(signed.groupBy(*TEXT).agg(F.first("__bands").alias("__bands")), "bands")
    keyed = signed.select(*TEXT, F.posexplode("__bands").alias("__band", "__key")).select(F.xxhash64("__band", "__key").alias("__at"), *TEXT)
    shared = keyed.groupBy("__at").agg(F.min("__hi").alias("__hub"), F.max("__hi").alias("__top"), F.count(F.lit(1)).alias("__n")).where("__hub <> __top")
    members = saved(keyed.join(shared, "__at").select("__at", *TEXT, "__hub", "__n"), "buckets")
    drop_saved(signed)
    wanted = members.select(*TEXT).distinct()
    # one row a text, then its units: copies of a wanted text collapse before anything is computed
    bodies = each.join(wanted, TEXT, "left_semi").groupBy(*TEXT).agg(F.first("__body").alias("__body"))
    sets = saved(bodies.mapInArrow(_units_of, "__hi long, __lo long, __units binary, __bytes long"), "units")
    links = saved(_checked(_hubs(members, sets), sets, threshold), "links")
    # then all pairs across classes, bucket by bucket
    more = saved(_checked(_blocks(members, components(links), sets.select(*TEXT, "__bytes")), sets, threshold), "links")
    found = components(links.unionByName(more))
    half = lambda at: F.conv(F.substring(F.hex("node"), at, 16), 16, -10).cast("long")
    out = saved(found.select(half(1).alias("__hi"), half(17).alias("__lo"), F.col("root").alias("__class")), "classes")
    for t in (members, sets, links, more):
        drop_saved(t)
    return out


def _checked(dealt: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(u, v) of the links that join the classes of each block; ``dealt`` has (__at, __hi, __lo, __root, __inner, __own)."""
    wide = dealt.join(sets.drop("__bytes"), TEXT).select("__at", _node().alias("__node"), "__root", "__inner", "__own", "__units")
    return wide.repartition("__at").sortWithinPartitions("__at", "__inner", "__node").mapInArrow(lambda it: _linked(it, threshold), "u binary, v binary").distinct()


def _hubs(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Blocks in which each text meets the hubs that it shares most buckets with; a hub is the least text of a bucket.

    The texts of a hub are dealt by hash, by the size of the largest bucket that they share with it.
    """
    met = members.where("__hi <> __hub").groupBy(*TEXT, "__hub").agg(F.count(F.lit(1)).alias("__buckets"), F.max("__n").alias("__n"))
    most = F.slice(F.sort_array(F.collect_list(F.struct("__buckets", "__hub", "__n")), asc=False), 1, FIRST_HUBS)
    best = met.groupBy(*TEXT).agg(most.alias("__most")).select(*TEXT, F.explode("__most").alias("m")).select(*TEXT, "m.__hub", F.ceil(F.col("m.__n") / BLOCK_TEXTS).alias("__parts"))
    best = best.withColumn("__at", F.xxhash64("__hub", "__parts", F.pmod(F.xxhash64(*TEXT), "__parts")))
    heads = best.select("__at", "__hub").distinct().join(sets.select(F.col("__hi").alias("__hub"), *TEXT), "__hub")
    marked = lambda df, inner: df.select("__at", *TEXT, _node().alias("__root"), F.lit(inner).alias("__inner"), F.lit(False).alias("__own"))
    return marked(best, False).unionByName(marked(heads, True))


def _blocks(members: DataFrame, found: DataFrame, sizes: DataFrame) -> DataFrame:
    """(__at, __hi, __lo, __root, __inner, __own): the blocks that hold all pairs across classes of every bucket.

    Texts of a bucket's largest class are ``inner``.  A bucket's texts are dealt by hash; inner
    parts meet outer parts, outer parts also meet each other and themselves (``own``).
    """
    named = sizes.withColumn("node", _node()).join(found, "node", "left").select(*TEXT, "__bytes", F.coalesce("root", "node").alias("__root"))
    rooted = saved(members.select("__at", *TEXT).join(named, TEXT), "rooted")
    seen = lambda k: F.bit_xor(F.xxhash64(*TEXT, F.lit(k)))
    group = rooted.groupBy("__at", "__root").agg(F.count(F.lit(1)).alias("__n"), F.sum("__bytes").alias("__bytes"), seen(0).alias("__x"), seen(1).alias("__y"))
    top = F.max(F.struct("__n", "__root", "__bytes")).alias("top")
    bucket = group.groupBy("__at").agg(F.count(F.lit(1)).alias("__classes"), top, F.sum("__n").alias("__n"), F.sum("__bytes").alias("__bytes"), F.bit_xor("__x").alias("__x"), F.bit_xor("__y").alias("__y")).where("__classes > 1")
    # buckets of different bands with the same texts have the same pairs
    parts = lambda n, size: F.greatest(F.ceil(n / BLOCK_TEXTS), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")
    inside = parts(F.col("top.__n"), F.col("top.__bytes")).alias("__in")
    outside = parts(F.col("__n") - F.col("top.__n"), F.col("__bytes") - F.col("top.__bytes")).alias("__out")
    asked = bucket.select("__at", "__n", "__x", "__y", F.col("top.__root").alias("__top"), inside, outside)
    asked = asked.groupBy("__n", "__x", "__y").agg(F.min(F.struct("__at", "__top", "__in", "__out")).alias("b")).select("b.*")
    rows = rooted.join(asked, "__at").withColumn("__inner", F.col("__root") == F.col("__top"))
    part = F.pmod(F.xxhash64(*TEXT, F.lit(2)), F.when(F.col("__inner"), F.col("__in")).otherwise(F.col("__out"))).cast("int")
    rows = rows.withColumn("__part", part)
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    place = lambda i, j, own: F.struct(i.alias("i"), j.alias("j"), F.lit(own).alias("own"))
    met = F.transform(upto(F.col("__in")), lambda k: place(k, F.col("__part"), False))
    # i is below 0 where outer parts meet
    beside = F.transform(upto(F.col("__out")), lambda k: place(-1 - F.least(k, "__part"), F.greatest(k, F.col("__part")), True))
    wanted = F.when(F.col("__inner"), F.transform(upto(F.col("__out")), lambda k: place(F.col("__part"), k, False))).otherwise(F.concat(met, beside))
    return rows.select("__at", *TEXT, "__root", "__inner", F.explode(wanted).alias("p")).select(F.xxhash64("__at", "p.i", "p.j").alias("__at"), *TEXT, "__root", "__inner", F.col("p.own").alias("__own"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, class_id, class_size) of every row; class_id is the least doc_id of the class."""
    inner = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("__body"))
    slim = saved(_with_digest(inner, "__body").select("doc_id", *TEXT), "digests")
    linked = classes(inner, "__body")
    own = slim.groupBy(*TEXT).agg(F.min("doc_id").alias("__least"), F.count(F.lit(1)).alias("__rows"))
    named = own.join(linked, TEXT, "left").withColumn("__class", F.coalesce("__class", _node()))
    sizes = named.groupBy("__class").agg(F.min("__least").alias("class_id"), F.sum("__rows").alias("class_size"))
    by_text = named.select(*TEXT, "__class").join(sizes, "__class").select(*TEXT, "class_id", "class_size")
    return slim.join(by_text, TEXT).select("doc_id", "class_id", "class_size")


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each class: the one of least doc_id, then least text; columns as they came."""
    inner, (text, doc_id) = positional(docs, text, doc_id)
    linked = classes(inner, text)
    marked = _with_digest(inner, text).withColumn("__id", F.col(doc_id))
    first = F.min(F.struct(F.col("__id").isNull().alias("__null"), "__id")).alias("__first")
    named = marked.groupBy(*TEXT).agg(first).join(linked, TEXT, "left").withColumn("__class", F.coalesce("__class", _node()))
    best = named.groupBy("__class").agg(F.min(F.struct("__first", *TEXT)).alias("__best"))
    chosen = best.select(F.col("__best.__hi").alias("__hi"), F.col("__best.__lo").alias("__lo"), F.col("__best.__first.__id").alias("__kept"))
    # the texts move once, by digest; rows that repeat both id and text then meet in place
    rows = marked.join(chosen, TEXT).where(F.col("__id").eqNullSafe(F.col("__kept"))).dropDuplicates(TEXT)
    return restored(rows, docs)
