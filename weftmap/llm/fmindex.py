"""Benchmark decontamination with one FM-index for each shard of the training texts.

A shard is a run of documents of about ``SHARD_WORDS`` words, made where they are read; no text is
shuffled.  Its index is one row of a written table: the Burrows-Wheeler transform of the
shard's word numbers as a wavelet matrix, counts of words, and every ``SAMPLE``-th suffix position.
It depends on the documents alone, so other benchmarks can be searched in it later.  Phrases (all
windows of benchmark items) are searched backwards by ranks, all phrases of a block at once;
occurrences walk to the nearest sampled position, and their spans are merged for each document.

Phrases are dealt into blocks of a fixed size and each block is searched in every shard, so neither
the benchmark nor the corpus is ever held whole; a task holds one shard and one block.

Defined results
    null or empty text     no words, no hits
    fewer words than a window   an item of them is one window; an item without words is none
    null item              its name is empty
    repeated items         each name counts once; repeated documents are each judged
    very long text         cut over several shards, which overlap by the longest window less one
    empty tables           no rows; without items nothing is hit
    extra columns          not read
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tables import numbered
from .bytewords import byte_set, pieces, words
from .common import arrow_rows, drop_saved, saved

WINDOW = 10
#: Words of a shard at most; with a separator a document they must fit 21 bits.
SHARD_WORDS = 1 << 20
BITS = 21
#: Every so many positions of a shard one is kept.
SAMPLE = 16
#: Phrases that are searched at once.
BLOCK = 100_000
#: Rows that go to Python at once, texts and indexes.
BATCH_ROWS, BATCH_INDEXES = 1000, 2
INSIDE = ~byte_set("".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])))
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def suffix_array(first: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order, by prefix doubling on keys of (rank, rank further on, position).

    ``first`` holds the symbols as numbers below 2 ** BITS; the last one occurs nowhere else.
    """
    n, b = len(first), np.uint64(BITS)
    mask = np.uint64((1 << BITS) - 1)
    rank = first.astype(np.uint64)
    ahead = np.append(rank[1:], np.uint64(0))
    key = (rank << (b + b)) | (ahead << b) | np.arange(n, dtype=np.uint64)
    slots, order, depth = np.arange(n), np.empty(n, np.int64), 2
    while True:
        key.sort()
        at = (key & mask).astype(np.int64)
        order[slots] = at
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] >> b) != (key[:-1] >> b)
        rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        alone = new & np.append(new[1:], True)
        slots = slots[~alone]
        if not len(slots):
            return order
        at = order[slots]
        key = (rank[at] << (b + b)) | (rank[at + depth] << b) | at.astype(np.uint64)
        depth *= 2


class Bits:
    """A bit vector with ranks in constant time."""

    def __init__(self, packed: np.ndarray):
        self.words = packed
        self.before = np.zeros(len(packed) + 1, np.int64)
        np.cumsum(np.bitwise_count(packed), out=self.before[1:])

    @staticmethod
    def pack(flags: np.ndarray) -> np.ndarray:
        out = np.zeros(8 * (len(flags) // 64 + 1), np.uint8)
        got = np.packbits(flags, bitorder="little")
        out[: len(got)] = got
        return out.view("<u8")

    def rank(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


class Shard:
    """The index of one shard; symbol 0 is a separator, word k of the vocabulary is symbol k + 1."""

    def __init__(self, levels: np.ndarray, counts: np.ndarray, marked: np.ndarray, samples: np.ndarray):
        self.counts, self.samples = counts.astype(np.int64), samples
        self.height = max(1, (len(counts) - 1).bit_length())
        self.levels = [Bits(x) for x in levels.reshape(self.height, -1)]
        self.marked = Bits(marked)
        n = int(self.counts.sum())
        self.zeros = [n - int(x.rank(np.array([n]))[0]) for x in self.levels]
        below = np.cumsum(self.counts) - self.counts
        # where the symbol's own rows begin after all levels: by its bits, the lowest first
        turned = np.zeros(len(counts), np.int64)
        for k in range(self.height):
            turned = (turned << 1) | ((np.arange(len(counts)) >> k) & 1)
        by = np.argsort(turned, kind="stable")
        starts = np.empty(len(counts), np.int64)
        starts[by] = np.cumsum(self.counts[by]) - self.counts[by]
        self.below, self.shift = below, below - starts

    @staticmethod
    def build(symbols: np.ndarray, n_symbols: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The four arrays of an index over symbols, with a separator (0) after each document; documents start at ``starts``."""
        stops = symbols == 0
        first = np.where(stops, np.cumsum(stops) - 1, symbols + (int(stops.sum()) - 1))
        order = suffix_array(first)
        now = symbols[order - 1].astype(np.uint32)
        counts = np.bincount(symbols, minlength=n_symbols).astype(np.int32)
        height, levels = max(1, (n_symbols - 1).bit_length()), []
        for k in reversed(range(height)):
            bit = (now & np.uint32(1 << k)) != 0
            levels.append(Bits.pack(bit))
            now = np.concatenate([now[~bit], now[bit]])
        keep = np.zeros(len(symbols), bool)
        keep[::SAMPLE] = True
        keep[starts] = True  # so that no walk passes a separator
        marked = keep[order]
        return np.concatenate(levels), counts, Bits.pack(marked), order[marked].astype(np.int32)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows below ``below[symbol]`` plus the occurrences of the symbol before row ``at`` of the transform."""
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
            ones = bits.rank(at)
            at = np.where((symbol >> (self.height - 1 - k)) & 1, zeros + ones, at - ones)
        return at + self.shift[symbol]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of phrases, rows of symbols of which the first ``lengths`` count."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), int(self.counts.sum()))
        for step in range(phrases.shape[1]):
            live = np.flatnonzero((lengths > step) & (low < high))
            if not len(live):
                break
            symbol = phrases[live, lengths[live] - 1 - step]
            low[live], high[live] = self.rank(symbol, low[live]), self.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to a sampled one."""
        out, left, rows = np.zeros(len(rows), np.int64), np.arange(len(rows)), rows.copy()
        steps = 0
        while len(left):
            found = self.marked.get(rows).astype(bool)
            out[left[found]] = self.samples[self.marked.rank(rows[found])] + steps
            left, rows = left[~found], rows[~found]
            symbol, at = np.zeros(len(rows), np.int64), rows
            for bits, zeros in zip(self.levels, self.zeros):
                bit, ones = bits.get(at).astype(np.int64), bits.rank(at)
                symbol, at = (symbol << 1) | bit, np.where(bit, zeros + ones, at - ones)
            rows = at + self.shift[symbol]
            steps += 1
        return out


class Builder:
    """Collects documents until a shard is full; ``finish`` gives its row."""

    def __init__(self, longest: int):
        self.longest = longest
        self.tail: tuple[int, int, pa.Array] | None = None
        self.clear()

    def clear(self) -> None:
        self.parts: list[pa.Array] = []
        self.segments: list[list[int]] = []  # row, first word in the document, words
        self.ended: list[tuple[int, object, int]] = []
        self.words = 0

    def add(self, row: int, doc_id: object, at: int, own: pa.Array, whole: bool) -> None:
        """Words of a document from its word ``at`` on; ``whole``: they are its last."""
        if len(own):
            if self.segments and self.segments[-1][0] == row:
                self.segments[-1][2] += len(own)
            elif at and self.tail and self.tail[0] == row:  # goes on from an earlier shard
                _, begin, tail = self.tail
                self.parts.append(tail)
                self.segments.append([row, begin, len(tail) + len(own)])
                self.words += len(tail)
            else:
                self.segments.append([row, at, len(own)])
            self.parts.append(own)
            self.words += len(own)
        if whole:
            self.ended.append((row, doc_id, at + len(own)))
            self.tail = None
        else:
            have = pa.concat_arrays([self.tail[2], own]) if self.tail and self.tail[0] == row else own
            have = have.slice(max(0, len(have) - (self.longest - 1)))
            self.tail = (row, at + len(own) - len(have), have)

    def finish(self) -> dict[str, object]:
        if self.words:
            coded = pa.concat_arrays(self.parts).dictionary_encode()
            lengths = np.array([s[2] for s in self.segments])
            ends = np.cumsum(lengths)
            symbols = np.insert(coded.indices.to_numpy().astype(np.int64) + 1, ends, 0)
            starts = ends - lengths + np.arange(len(lengths))
            names = "\n".join(coded.dictionary.to_pylist()).encode()
            levels, counts, marked, samples = Shard.build(symbols, len(coded.dictionary) + 1, starts)
        else:
            names, starts = b"", np.empty(0, np.int64)
            levels, counts, marked, samples = (np.empty(0, np.int32) for _ in range(4))
        rows, ids, totals = zip(*self.ended) if self.ended else ((), (), ())
        out = {"rows": list(rows), "ids": list(ids), "words": list(totals), "segment_rows": [s[0] for s in self.segments], "segment_from": [s[1] for s in self.segments], "segment_start": starts.tolist()}
        out |= {"names": names} | {k: v.tobytes() for k, v in (("levels", levels), ("counts", counts), ("marked", marked), ("samples", samples))}
        self.clear()
        return out


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", longest: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Written table of indexes, one row a shard, for phrases of up to ``longest`` words."""
    kind = docs.schema[doc_id].dataType
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("rows", longs), T.StructField("ids", T.ArrayType(kind)), *[T.StructField(c, longs) for c in ("words", "segment_rows", "segment_from", "segment_start")], *[T.StructField(c, T.BinaryType()) for c in ("names", "levels", "counts", "marked", "samples")]])
    if 2 * shard_words > 1 << BITS:
        raise ValueError(f"a shard holds at most {1 << (BITS - 1)} words")

    def row_of(made: dict[str, object], ids: pa.DataType) -> pa.RecordBatch:
        types = [pa.list_(pa.int64()), pa.list_(ids), *[pa.list_(pa.int64())] * 4, *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array([made[f.name]], t) for f, t in zip(schema, types)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids = Builder(longest), pa.int64()
        for batch in batches:
            rows, names, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(1).type
            at = 0  # words of the present document in earlier parts
            for first, data, ends, whole in pieces(batch.column(2), ~INSIDE):
                own, starts = words(data, ends, INSIDE)
                if shard.words and shard.words + len(own) + longest > shard_words or len(shard.ended) >= shard_words:
                    yield row_of(shard.finish(), ids)
                cuts = [0, *np.searchsorted(starts, ends).tolist()]
                for k in range(len(ends)):
                    shard.add(rows[first + k], names[first + k], at, own.slice(cuts[k], cuts[k + 1] - cuts[k]), whole)
                    at = 0 if whole else at + len(own)
        if shard.words or shard.ended:
            yield row_of(shard.finish(), ids)

    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        return saved(docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema), "fm-index")


def words_of(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def windows_of(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(phrase, item): the distinct windows of items, words joined by blanks."""
    split = items.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item"), words_of(F.col(f"`{text}`")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    return split.select("item", F.explode(F.transform(starts, lambda k: F.array_join(F.slice("words", k, window), " "))).alias("phrase")).distinct()


def phrase_blocks(windows: DataFrame, block: int = BLOCK) -> Iterator[tuple[list[str], list[list[str]]]]:
    """(phrases, items of each) of at most ``block`` pairs at a time."""
    placed = saved(numbered(windows, "phrase", "item", start=0), "windows")
    count = placed.count()
    for first in range(0, count, block):
        pairs: dict[str, list[str]] = {}
        for phrase, item in placed.where(F.col("k").between(first, first + block - 1)).select("phrase", "item").collect():  # bounded by the block
            pairs.setdefault(phrase, []).append(item)
        yield list(pairs), list(pairs.values())
    drop_saved(placed)


def occurrences(index: DataFrame, phrases: list[str], items: list[list[str]]) -> DataFrame:
    """(row, spans, items): where phrases of one block lie in each document (word positions), merged, and whose they are."""
    split = [p.split(" ") for p in phrases]
    names = sorted({w for p in split for w in p})
    number = {w: k for k, w in enumerate(names)}
    lengths = np.array([len(p) for p in split])
    table = np.zeros((len(split), int(lengths.max(initial=1))), np.int32)
    for k, p in enumerate(split):
        table[k, : len(p)] = [number[w] for w in p]
    owners = sorted({i for own in items for i in own})
    owner = {i: k for k, i in enumerate(owners)}
    listed = np.array([owner[i] for own in items for i in own], np.int64)
    ends = np.cumsum([len(own) for own in items])
    schema = "row long, spans array<struct<start:long,end:long>>, items array<string>"
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def hits(shard: dict[str, object], known: pa.Array) -> Iterator[tuple[int, list[dict[str, int]], list[str]]]:
        got = pc.index_in(known, value_set=pa.array(shard["names"].decode().split("\n"))).fill_null(-1).to_numpy().astype(np.int64) + 1
        there = (got > 0)[table] | (np.arange(table.shape[1])[None, :] >= lengths[:, None])
        live = np.flatnonzero(there.all(axis=1))
        if not len(live):
            return
        fm = Shard(*(np.frombuffer(shard[c], kind) for c, kind in (("levels", "<u8"), ("counts", "<i4"), ("marked", "<u8"), ("samples", "<i4"))))
        low, high = fm.search(got[table[live]], lengths[live])
        sizes = high - low
        if not sizes.sum():
            return
        which = np.repeat(live, sizes)
        at = fm.locate(np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum())))
        segment = np.searchsorted(np.array(shard["segment_start"]), at, side="right") - 1
        by = np.lexsort((at, segment))
        which, at, segment = which[by], at[by], segment[by]
        cuts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1], True])
        for a, b in zip(cuts[:-1], cuts[1:]):
            s = segment[a]
            begin = at[a:b] - shard["segment_start"][s] + shard["segment_from"][s]
            reach = np.maximum.accumulate(begin + lengths[which[a:b]])
            new = np.flatnonzero(np.r_[True, begin[1:] > reach[:-1]])
            spans = [{"start": int(begin[x]), "end": int(y)} for x, y in zip(new, reach[np.r_[new[1:] - 1, b - a - 1]])]
            own = np.unique(np.concatenate([listed[ends[p] - len(items[p]) : ends[p]] for p in np.unique(which[a:b])]))
            yield shard["segment_rows"][s], spans, [owners[k] for k in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(names, pa.string())
        for batch in batches:
            for k in range(batch.num_rows):
                shard = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                if shard["segment_rows"]:
                    found = list(hits(shard, known))
                    if found:
                        rows, spans, whose = zip(*found)
                        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(whose, pa.list_(pa.string()))], names=["row", "spans", "items"])

    slim = index.select("segment_rows", "segment_from", "segment_start", "names", "levels", "counts", "marked", "samples")
    with arrow_rows(index.sparkSession, BATCH_INDEXES):
        return saved(slim.mapInArrow(run, schema), "hits")


def removal_spans(index: DataFrame, windows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(row, spans, items) of every document with an occurrence: merged spans [start, end) of words, and sorted item names."""
    found = [occurrences(index, *b) for b in phrase_blocks(windows, block)]
    if not found:
        return index.sparkSession.createDataFrame([], "row long, spans array<struct<start:long,end:long>>, items array<string>")
    every = reduce(DataFrame.unionByName, found)
    by = every.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # spans in order: one that begins within the last goes into it
    joined = F.aggregate("spans", F.slice("spans", 1, 0), lambda out, s: F.when((F.size(out) > 0) & (s["start"] <= F.element_at(out, -1)["end"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["start"].alias("start"), F.greatest(s["end"], F.element_at(out, -1)["end"]).alias("end"))))).otherwise(F.concat(out, F.array(s))))
    return by.withColumn("spans", joined)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    index = build_index(docs, longest=window, shard_words=shard_words)
    hits = removal_spans(index, windows_of(items, window=window), block)
    each = index.select(F.explode(F.arrays_zip("rows", "ids", "words")).alias("d")).select(F.col("d.rows").alias("row"), F.col("d.ids").alias("doc_id"), F.col("d.words").alias("n_words"))
    out = each.join(hits, "row", "left")
    hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]), F.lit(0).cast("long"))
    names = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


#: The same in SQL: windows of documents joined with windows of items.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bt AS (SELECT item, row_number() OVER () AS i, w FROM b),
bx AS (SELECT item, n, k, [t, lead(t, 1) OVER o, lead(t, 2) OVER o, lead(t, 3) OVER o, lead(t, 4) OVER o, lead(t, 5) OVER o, lead(t, 6) OVER o, lead(t, 7) OVER o, lead(t, 8) OVER o, lead(t, 9) OVER o] AS v FROM (SELECT item, i, len(w) AS n, unnest(w) AS t, generate_subscripts(w, 1) AS k FROM bt) WINDOW o AS (PARTITION BY i ORDER BY k)),
bw AS (SELECT DISTINCT item, least(n, 10) AS n, array_to_string(v[1:least(n, 10)], ' ') AS phrase FROM bx WHERE k = 1 OR k <= n - 9),
sizes AS (SELECT DISTINCT n FROM bw),
x AS (SELECT r, k, n, [t, lead(t, 1) OVER o, lead(t, 2) OVER o, lead(t, 3) OVER o, lead(t, 4) OVER o, lead(t, 5) OVER o, lead(t, 6) OVER o, lead(t, 7) OVER o, lead(t, 8) OVER o, lead(t, 9) OVER o] AS v FROM (SELECT r, len(w) AS n, unnest(w) AS t, generate_subscripts(w, 1) AS k FROM d) WINDOW o AS (PARTITION BY r ORDER BY k)),
hits AS (SELECT r, k, k + s.n AS e, item FROM x CROSS JOIN sizes s JOIN bw ON bw.n = s.n AND bw.phrase = array_to_string(v[1:s.n], ' ') AND k + s.n - 1 <= x.n),
marked AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(k, e)) AS p FROM (SELECT DISTINCT r, k, e FROM hits)) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY encode(item)) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (r) LEFT JOIN named USING (r)
"""
