"""Phrase collocations by multikey three-way quicksort of suffix pointers.

Every word of a text begins a suffix, which ends with its piece and counts up to ``longest`` words.
Where the texts are read, suffixes of about ``RUN_WORDS`` words are sorted and equal ones become one
row with a count.  Suffixes are then routed to buckets by their language and leading words:
by as few words as keep a bucket small, so a leading word that begins a large share of all suffixes
is routed by two, and so on.  In a bucket, pointers to suffixes go through a three-way quicksort
to the depth of ``longest``: a partition equal to its pivot is a phrase and its size the count, which
the next word then divides; partitions of fewer than ``least`` are abandoned, as every
phrase in them is whole in this bucket.  All partitions of one round are divided at once.

Leading words that are routed further ("heavy") are found by sums over what holds more than a share
of its run; there are at most ``2 * HEAVY`` of each length, and only their hashes go to the tasks.
Hashes decide about routes alone: words that share one are only routed further than need be.
Scores are exact: products are decimals of 38 digits.

Defined results
    null or empty text     no words
    null language          ``und``, together with rows of that name
    very long text         taken part by part, cut at the ends of pieces
    repeated rows          all count
    ties                   equal scores and counts go by the phrase's bytes
    fewer than ``least``   no rows, as for an empty table
    extra columns          not read
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .bytewords import byte_set, pieces, words
from .common import arrow_rows, drop_saved, saved
from .shingles import mix, word_hashes

LONGEST, LEAST, TOP = 3, 10, 2000
#: A candidate goes if a longer one holds it and has this share (of 100) of its count.
COVERED = 50
#: Words of a run, and of a bucket on average.
RUN_WORDS, BUCKET_WORDS = (1 << 20) - 1, 1 << 21
#: A leading phrase is heavy if it begins more than a quarter of a bucket, and this part of all suffixes.
HEAVY = 1 << 18
#: Buckets that a run is divided into at once; beyond them suffixes are dealt twice.
FAN_OUT = 4096
BATCH_ROWS = 1000
BREAK = byte_set(".,;:!?\n\x0b\x0c\r")
INSIDE = ~(BREAK | byte_set(" \t"))
U = np.uint64
#: Rows of suffixes: words of each (numbers from 1 into ``names``, 0 after the end of the piece), and counts.
ROWS = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("words", T.LongType()), T.StructField("names", T.BinaryType()), T.StructField("grams", T.BinaryType()), T.StructField("counts", T.BinaryType())])


def summed(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of ``grams`` in order, and the sums of their counts."""
    if not len(grams):
        return grams, counts
    bits = U(max(1, int(grams.max()).bit_length()))
    key, width = grams[:, 0].astype(U), int(bits)
    for d in range(1, grams.shape[1]):
        if width + int(bits) > 63:  # number the rows so far
            _, key = np.unique(key, return_inverse=True)
            key, width = key.astype(U), max(1, int(key.max()).bit_length())
        key, width = (key << bits) | grams[:, d].astype(U), width + int(bits)
    own = max(1, int(len(key) - 1).bit_length())
    if width + own <= 64:  # sorting keys with their place is several times faster than sorting places
        packed = (key << U(own)) | np.arange(len(key), dtype=U)
        packed.sort()
        order, key = (packed & U((1 << own) - 1)).astype(np.int64), packed >> U(own)
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return grams[order[first]], np.add.reduceat(counts[order], first)


def packed(bucket: int, lang: str, total: int, names: pa.Array, grams: np.ndarray, counts: np.ndarray) -> tuple:
    """A row of ``ROWS``; grams are in order, so differences of the first word are small."""
    used = np.zeros(len(names) + 1, bool)
    used[grams] = True
    used[0] = False
    number = np.cumsum(used, dtype=np.int32) * used
    own = names.take(pa.array(np.flatnonzero(used) - 1))
    flat = number[grams].T.astype("<i4")
    flat[0] = np.diff(flat[0], prepend=0)
    shrink = lambda x: pa.compress(x, codec="zstd", asbytes=True)
    text = "\n".join(own.to_pylist()).encode()
    sizes = np.array([len(own), len(text), len(counts), grams.shape[1]], "<i8").tobytes()
    return bucket, lang, total, sizes + shrink(text), shrink(flat.tobytes()), shrink(counts.astype("<i8").tobytes())


def unpacked(names: bytes, grams: bytes, counts: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    n_names, n_text, n, depth = np.frombuffer(names[:32], "<i8").tolist()
    text = pa.decompress(names[32:], n_text, codec="zstd", asbytes=True)
    flat = np.frombuffer(pa.decompress(grams, 4 * n * depth, codec="zstd"), "<i4").reshape(depth, n).copy()
    flat[0] = np.cumsum(flat[0])
    return pa.array(text.decode().split("\n") if n_names else [], pa.string()), flat.T, np.frombuffer(pa.decompress(counts, 8 * n, codec="zstd"), "<i8")


def merged(rows: list[tuple[pa.Array, np.ndarray, np.ndarray]]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Several lists of suffixes under one vocabulary, equal ones summed."""
    if len(rows) == 1:
        return rows[0]
    coded = pa.concat_arrays([names for names, _, _ in rows]).dictionary_encode()
    number, at, grams = coded.indices.to_numpy().astype(np.int32) + 1, 0, []
    for names, own, _ in rows:
        grams.append(np.append(np.int32(0), number[at : at + len(names)])[own])
        at += len(names)
    return coded.dictionary, *summed(np.concatenate(grams), np.concatenate([c for _, _, c in rows]))


def emitted(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.string(), pa.int64(), *[pa.binary()] * 3])], names=ROWS.names)


def suffix_runs(docs: DataFrame, text: str, lang: str, longest: int, run_words: int) -> DataFrame:
    """Written rows of ``ROWS``, a run and language each; ``words`` is the number of words."""

    class Open:
        """Words of one language, and the number of words from each to the end of its piece."""

        def __init__(self) -> None:
            self.words: list[pa.Array] = []
            self.left: list[np.ndarray] = []

        def row(self, lang: str) -> tuple:
            coded = pa.concat_arrays(self.words).dictionary_encode()
            own, left = coded.indices.to_numpy().astype(np.int32) + 1, np.concatenate(self.left)
            padded = np.append(own, np.zeros(longest, np.int32))
            grams = np.stack([np.where(left > d, padded[d : d + len(own)], 0) for d in range(longest)], axis=1)
            return packed(0, lang, len(own), coded.dictionary, *summed(grams, np.ones(len(own), np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        openings: dict[str, Open] = {}
        held = 0
        for batch in batches:
            names = batch.column(0)
            for name in pc.unique(names).to_pylist():
                for _, data, ends, _ in pieces(pc.filter(batch.column(1), pc.equal(names, name)), BREAK):
                    own, starts = words(data, ends, INSIDE)
                    if not len(own):
                        continue
                    if held and held + len(own) > run_words:
                        yield emitted([o.row(k) for k, o in openings.items()])
                        openings, held = {}, 0
                    broken = np.cumsum(BREAK[data], dtype=np.int64)[starts] + np.searchsorted(ends, starts, side="right")
                    last = np.flatnonzero(np.append(np.diff(broken) != 0, True))
                    at = np.arange(len(own))
                    o = openings.setdefault(name, Open())
                    o.words.append(own)
                    o.left.append(last[np.searchsorted(last, at)] - at + 1)
                    held += len(own)
        if held:
            yield emitted([o.row(k) for k, o in openings.items()])

    named = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        return saved(named.mapInArrow(run, ROWS), "runs")


def chained(lang: str, names: pa.Array, grams: np.ndarray) -> np.ndarray:
    """Hashes of the leading 0, 1, 2, ... words of each suffix, the language included; a column a number of words."""
    own = np.append(U(0), _hashes(names))
    out = np.empty((len(grams), grams.shape[1] + 1), U)
    out[:, 0] = xxhash.xxh64_intdigest(lang.encode())
    for d in range(grams.shape[1]):
        with np.errstate(over="ignore"):
            out[:, d + 1] = np.where(grams[:, d] > 0, mix(out[:, d] * U(0x9E3779B97F4A7C15) + own[grams[:, d]] + U(d)), out[:, d])
    return out


def _hashes(names: pa.Array) -> np.ndarray:
    data = np.frombuffer(" ".join(names.to_pylist()).encode(), np.uint8)
    return word_hashes(data, np.array([len(data)]))[0] if len(names) else np.empty(0, U)


def weights(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, which = np.unique(hashes, return_inverse=True)
    return keys, np.bincount(which, weights=counts).astype(np.int64)


def heavy_hashes(runs: DataFrame, total: int, bucket_words: int, heavy: int) -> np.ndarray:
    """Sorted hashes of leading phrases that begin more than a quarter of a bucket.

    With a share s = threshold / total, a run names what has s / 2 of its words.  What runs leave out
    is below s / 2 of all in sum, so a phrase with s of all words is named with half of it at least.
    """
    threshold = max(bucket_words / 4, total / heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, lang, words, *rest in zip(*(batch.column(c).to_pylist() for c in ROWS.names)):
                names, grams, counts = unpacked(*rest)
                found = chained(lang, names, grams)
                for d in range(found.shape[1] - 1):
                    own = np.ones(len(grams), bool) if d == 0 else grams[:, d - 1] > 0
                    keys, sums = weights(found[own, d], counts[own])
                    keep = sums >= words * threshold / total / 2
                    yield pa.RecordBatch.from_arrays([pa.array(keys[keep].view(np.int64)), pa.array(sums[keep])], names=["hash", "words"])

    with arrow_rows(runs.sparkSession, 1):
        named = runs.mapInArrow(run, "hash long, words long").groupBy("hash").agg(F.sum("words").alias("words")).where(F.col("words") >= threshold / 2)
        return np.sort(np.array([r["hash"] for r in named.collect()], np.int64).view(U))  # at most 2 * heavy of each length


def isin(x: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def dealt(rows: DataFrame, heavy: np.ndarray, buckets: int, of: int, first: bool) -> DataFrame:
    """Suffixes by ``of`` buckets together; ``first``: with a row (bucket -1) that sums the heavy leading phrases."""

    def routes(found: np.ndarray) -> np.ndarray:
        out, go = found[:, 0].copy(), np.ones(len(found), bool)
        for d in range(found.shape[1] - 1):
            go &= isin(out, heavy)
            out[go] = found[go, d + 1]
        return ((out % U(buckets)) // U(of)).astype(np.int64)

    def split(lang: str, names: pa.Array, grams: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = chained(lang, names, grams)
        if first:
            for d in range(1, found.shape[1] - 1):
                own = (grams[:, d - 1] > 0) & isin(found[:, d], heavy)
                if own.any():
                    lead = grams[own].copy()
                    lead[:, d:] = 0
                    yield emitted([packed(-1, lang, 0, names, *summed(lead, counts[own]))])
        where = routes(found)
        order = np.argsort(where, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(where[order]) != 0, True])
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = np.sort(order[a:b])  # grams stay in order
            yield emitted([packed(int(where[own[0]]), lang, int(counts[own].sum()), names, grams[own], counts[own])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0
        for batch in batches:
            for _, lang, _, *rest in zip(*(batch.column(c).to_pylist() for c in ROWS.names)):
                own = unpacked(*rest)
                if size and (first or size + len(own[1]) > RUN_WORDS):
                    for k, parts in held.items():
                        yield from split(k, *merged(parts))
                    held, size = {}, 0
                held.setdefault(lang, []).append(own)
                size += len(own[1])
        for k, parts in held.items():
            yield from split(k, *merged(parts))

    return rows.mapInArrow(run, ROWS)


def quicksorted(grams: np.ndarray, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a suffix, words, count) of every phrase that leads suffixes of at least ``least`` in sum.

    Pointers to suffixes are divided by a pivot's word into lower, equal and higher ones; equal
    ones go on with their next word.  Partitions lie side by side and each round divides them all.
    """
    longest = grams.shape[1]
    sums = np.bincount(grams[:, 0], weights=counts) if len(grams) else np.empty(0)
    at = np.flatnonzero(sums[grams[:, 0]] >= least) if len(grams) else np.empty(0, np.int64)  # leading words first
    sizes, depth = np.array([len(at)] if len(at) else [], np.int64), np.zeros(min(1, len(at)), np.int64)
    flat = np.ascontiguousarray(grams).ravel()
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(at):
        part = np.repeat(np.arange(len(sizes)), sizes)
        word = flat[at * longest + depth[part]]
        middle = np.cumsum(sizes) - sizes + sizes // 2
        pivot = word[middle]
        side = part * 3 + 1 + np.sign(word - pivot[part])
        weight = np.bincount(side, weights=counts[at], minlength=3 * len(sizes))
        number = np.bincount(side, minlength=3 * len(sizes))
        keep = (weight >= least) & (number > 0)
        equal = np.flatnonzero(keep[1::3])
        if len(equal):
            out.append((at[middle[equal]], depth[equal] + 1, weight[1::3][equal].astype(np.int64)))
        keep[1::3] &= depth + 1 < longest
        going = keep[side]
        at, side = at[going], side[going]
        after = np.repeat(depth, 3)
        after[1::3] += 1
        # words end with their piece: equal pointers without a next word stop here
        is_equal = side % 3 == 1
        ended = np.zeros(len(at), bool)
        ended[is_equal] = flat[at[is_equal] * longest + after[side[is_equal]]] == 0
        at, side = at[~ended], side[~ended]
        order = np.argsort(side, kind="stable")
        at, side = at[order], side[order]
        live, sizes = np.unique(side, return_counts=True)
        depth = after[live]
    if not out:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out))


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, run_words: int = RUN_WORDS, bucket_words: int = BUCKET_WORDS, heavy: int = HEAVY, fan_out: int = FAN_OUT) -> tuple[DataFrame, DataFrame]:
    """Written (lang, phrase, words, f) of all phrases with f >= ``least``, and (lang, n)."""
    spark = docs.sparkSession
    runs = suffix_runs(docs, text, lang, longest, run_words)
    per_lang = saved(runs.groupBy("lang").agg(F.sum("words").alias("n")), "words")
    total = per_lang.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_words))
    found = heavy_hashes(runs, total, bucket_words, heavy) if buckets > 1 else np.empty(0, U)
    with arrow_rows(spark, 1):
        if buckets > fan_out:
            wide = math.ceil(buckets / fan_out)
            rough = saved(dealt(runs, found, buckets, wide, True), "dealt")
            whole = rough.where("bucket < 0")
            parts = dealt(rough.where("bucket >= 0").repartition("bucket"), found, buckets, 1, False)
            rows = parts.unionByName(whole)
        else:
            rough, rows = None, dealt(runs, found, buckets, 1, True)
        slices = min(buckets, 1 << 16)
        rows = rows.repartition(slices, F.when(F.col("bucket") < 0, F.abs(F.hash("names")) % slices).otherwise(F.col("bucket"))).sortWithinPartitions("bucket", "lang")

        def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
            now: tuple[int, str] | None = None

            def phrases() -> pa.RecordBatch:
                names, grams, counts = merged(held)
                bucket, language = now
                if bucket < 0:  # sums of heavy phrases, over other rows too
                    at, size, f = np.arange(len(grams)), (grams > 0).sum(axis=1), counts
                else:
                    at, size, f = quicksorted(grams, counts, least)
                    hashes = chained(language, names, grams[at])
                    light = ~isin(hashes[np.arange(len(at)), size], found)  # their suffixes are in other buckets too
                    light |= size == longest
                    at, size, f = at[light], size[light], f[light]
                first = names.take(pa.array(grams[at, 0] - 1))
                text = first
                for d in range(1, longest):
                    more = pa.array(np.where(size > d, grams[at, d] - 1, 0), pa.int64(), mask=size <= d)
                    text = pc.binary_join_element_wise(text, names.take(more), " ", null_handling="skip")
                return pa.RecordBatch.from_arrays([pa.array([language] * len(at), pa.string()), text, pa.array(size.astype(np.int32)), pa.array(f.astype(np.int64))], names=["lang", "phrase", "words", "f"])

            for batch in batches:
                for bucket, language, _, *rest in zip(*(batch.column(c).to_pylist() for c in ROWS.names)):
                    if held and now != (bucket, language):
                        yield phrases()
                        held = []
                    now = (bucket, language)
                    held.append(unpacked(*rest))
            if held:
                yield phrases()

        partial = saved(rows.mapInArrow(sort, "lang string, phrase string, words int, f long"), "phrases")
    counts = saved(partial.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= least), "counts")
    drop_saved(runs, partial, *([rough] if rough is not None else []))
    return counts, per_lang


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = TOP, covered: int = COVERED, **sizes: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases by their weakest cut."""
    counts, per_lang = phrase_counts(docs, text, lang, longest, least, **sizes)
    joined = lambda own, start, size: F.array_join(F.slice(own, start, size), " ")
    candidates = counts.where("words >= 2").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("own"))
    size = F.size("own")
    cuts = candidates.select("lang", "phrase", "a", "own", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select("lang", "phrase", "a", "k", joined("own", F.lit(1), F.col("k")).alias("head"), joined("own", F.col("k") + 1, size).alias("tail"))
    heads, tails = (counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)) for part, name in (("head", "l"), ("tail", "r")))
    exact = {c: F.col(c).cast("decimal(16,0)") for c in "alr"}
    score = F.call_function("div", exact["a"] * exact["a"] * F.lit(1_000_000).cast("decimal(7,0)"), exact["l"] * exact["r"])
    best = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # parts of at least two words of longer candidates
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("own") - n + 1), lambda s: joined("own", s, n))))
    inside = candidates.where(size > 2).select("lang", F.col("a").alias("of"), F.explode(F.array_distinct(spans)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("of").alias("of"))
    left = best.join(inside, ["lang", "phrase"], "left").where(F.col("of").isNull() | (F.col("of") * 100 < F.col("a") * covered))
    order = W.Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    first = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return first.join(per_lang, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


#: The same in SQL: every phrase of one to three words, counted.
SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, p, unnest(w) AS t, generate_subscripts(w, 1) AS k FROM w),
x AS (SELECT lang, t AS t1, lead(t, 1) OVER o AS t2, lead(t, 2) OVER o AS t3 FROM t WINDOW o AS (PARTITION BY p ORDER BY k)),
g AS (SELECT lang, t1 AS phrase, 1 AS s FROM x UNION ALL SELECT lang, t1 || ' ' || t2, 2 FROM x WHERE t2 IS NOT NULL UNION ALL SELECT lang, t1 || ' ' || t2 || ' ' || t3, 3 FROM x WHERE t3 IS NOT NULL),
c AS (SELECT lang, phrase, s, count(*)::BIGINT AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE s = 1 GROUP BY lang),
cand AS (SELECT lang, phrase, s, f AS a, string_split(phrase, ' ') AS w FROM c WHERE s >= 2 AND f >= 10),
cut AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:s], ' ') AS tail FROM cand CROSS JOIN (VALUES (1), (2)) AS v(k) WHERE k < s),
scored AS (SELECT cut.lang, cut.phrase, a, k, h.f AS l, t.f AS r, (1000000::HUGEINT * a * a // (h.f::HUGEINT * t.f))::BIGINT AS score FROM cut JOIN c h ON h.lang = cut.lang AND h.phrase = head JOIN c t ON t.lang = cut.lang AND t.phrase = tail),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, part, max(a) AS most FROM (SELECT lang, a, array_to_string(w[1:2], ' ') AS part FROM cand WHERE s = 3 UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM cand WHERE s = 3) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer x ON x.lang = b.lang AND x.part = b.phrase WHERE x.most IS NULL OR 100 * x.most < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
