"""Document fingerprints from prefix polynomial hashes.

For code points c[0], c[1], ... the prefix array is P[i] = sum over k < i of c[k] * B**k
modulo p = 2**31 - 1.  The hash of a span [l, r) is (P[r] - P[l]) * B**(M - l) for a fixed
M past every position, so equal spans have equal hashes wherever they stand; two bases
make 62 bits.  That answers any span equality in constant time and finds longest common
extensions by binary search (``Prefix``).

A fingerprint is the hash and length of the whole text, and the 64 least values among all its
spans of 16 code points.  A text counts as if 15 blanks that no text holds stood before and
after it, so a text of any length has spans of one width, and short texts are compared by the
same rule as long ones.  A value is 32 mixed bits of the first base's hash and 8 of the second's,
so spans of unrelated texts hardly ever agree by chance, however many there are.  Likeness of two
fingerprints estimates the share of common spans among all spans of the two (bottom-k); equal
texts have equal fingerprints and likeness 1, an empty text is like an empty text alone.

Defined results
    null text           an empty text
    very long text      hashed whole, with memory in proportion to the text
    ties, repeated rows documents of one id follow each other by a hash of the text, then the text
    null doc_id         comes last in descending order
    empty table         no rows
    extra columns       not read
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .common import saved, shuffle_partitions

P = np.uint64((1 << 31) - 1)
BASES = (911382323, 972663749)
SPAN, KEPT, KEPT_BYTES = 16, 64, 5
U = np.uint64


def _mod(x: np.ndarray) -> np.ndarray:
    """x mod 2**31 - 1 for x below 2**62 or so, by folding; works in place."""
    for _ in range(2):
        high = x >> U(31)
        x &= P
        x += high
    x *= x != P
    return x


class Powers:
    """B**k and B**-k modulo p for k below a length that doubles on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, int(P) - 2, int(P))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> Powers:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, _mod(self.up * U(pow(self.base, k, int(P))))])
            self.down = np.concatenate([self.down, _mod(self.down * U(pow(self.inverse, k, int(P))))])
        return self


_powers = tuple(Powers(b) for b in BASES)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _mixed(h: np.ndarray) -> np.ndarray:
    """32 well spread bits of hashes below 2**31; different hashes hardly ever share them."""
    h = (h + U(1)) * U(0x9E3779B97F4A7C15)
    h ^= h >> U(29)
    h *= U(0xBF58476D1CE4E5B9)
    h >>= U(32)
    return h


class Prefix:
    """Prefix arrays of one text: ``sums[base][i]`` belongs to its first i code points.

    A text that starts with ``kept`` code points of another one takes that part of its arrays.
    """

    def __init__(self, text: str | np.ndarray, other: Prefix | None = None, kept: int = 0):
        codes = code_points(text) if isinstance(text, str) else text
        self.n, self.sums = len(codes), []
        tail = codes[kept:].astype(np.uint64) + U(1)
        for k, w in enumerate(_powers):
            # terms are below 2**31, so sums of up to 2**32 of them fit
            terms = _mod(tail * w.to(self.n + SPAN).up[kept : self.n])
            start = other.sums[k][: kept + 1] if other else np.zeros(1, np.uint64)
            self.sums.append(np.concatenate([start, _mod(np.cumsum(terms, dtype=np.uint64) + start[-1])]))

    def span(self, left: int, right: int) -> tuple[int, int]:
        """Hashes of one span under both bases, moved to position 0."""
        return tuple((int(s[right]) - int(s[left])) * int(w.down[left]) % int(P) for s, w in zip(self.sums, _powers))

    def common_extension(self, i: int, other: Prefix, j: int) -> int:
        """Length of the longest common extension of position i here and j there."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            if self.span(i, i + mid) == other.span(j, j + mid):
                low = mid
            else:
                high = mid - 1
        return low

    def padded(self, first: int, last: int, which: int, at: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the padded text's spans ``first`` to ``last`` (all, or those ``at`` some places).

        Span i holds the code points i - SPAN + 1 to i; blanks count 0.
        """
        s, down = self.sums[which], _powers[which].to(self.n + SPAN).down
        if at is None:
            low = max(first, SPAN - 1)
            start = np.concatenate([np.zeros(max(0, min(last, SPAN - 1) - first), np.uint64), s[low - SPAN + 1 : max(low, last) - SPAN + 1]])
            end = s[first + 1 : min(last, self.n) + 1]
            end = np.concatenate([end, np.full(last - first - len(end), s[-1])])
            return _mod(_mod(end + P - start) * down[first:last])
        return _mod(_mod(s[np.minimum(at + 1, self.n)] + P - s[np.maximum(at - SPAN + 1, 0)]) * down[at])

    def least(self, first: int, last: int, kept: int = KEPT) -> np.ndarray:
        """The least values of spans ``first`` to ``last``, ascending and distinct; at least ``kept`` of them if there are."""
        if last <= first:
            return np.empty(0, dtype=np.uint64)
        h = _mixed(self.padded(first, last, 0))
        want = kept + 32
        while True:  # copies of a span share one value
            at = np.argpartition(h, want)[:want] if want < len(h) else np.arange(len(h))
            if want < len(h):
                at = at[h[at] < h[at].max()]  # of the largest, some may be left out
            values = np.unique((h[at] << U(8)) | (_mixed(self.padded(first, last, 1, at + first)) & U(255)))
            if len(values) >= kept or want >= len(h):
                return values
            want *= 4

    def head(self) -> bytes:
        whole = self.span(0, self.n) if self.n else (0, 0)
        return self.n.to_bytes(6, "big") + whole[0].to_bytes(4, "big") + whole[1].to_bytes(4, "big")


def _packed(head: bytes, *values: np.ndarray) -> bytes:
    """Binary fingerprint: length, whole-text hash, sketch."""
    least = np.unique(np.concatenate(values))[:KEPT]
    return head + least.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - KEPT_BYTES :].tobytes()


def own_print(p: Prefix) -> bytes:
    return _packed(p.head(), p.least(0, p.n + SPAN - 1 if p.n else 0))


def fingerprint(text: str | None) -> bytes:
    with np.errstate(over="ignore"):
        return own_print(Prefix(text or ""))


def fingerprint_both(codes: np.ndarray, following: np.ndarray) -> tuple[bytes, bytes, int]:
    """Fingerprints of a text and of the edited one, and the length of their common prefix.

    The edited text shares the prefix arrays and spans of the part that stays.
    """
    n, k = len(codes), len(codes) // 3
    with np.errstate(over="ignore"):
        own = Prefix(codes)
        if not n:
            return own_print(own), own_print(own), 0
        new = Prefix(np.concatenate([codes[: n - k], following[:k]]), own, n - k)
        shared = own.least(0, n - k)
        rest = [p.least(n - k, p.n + SPAN - 1) for p in (own, new)]
        return _packed(own.head(), shared, rest[0]), _packed(new.head(), shared, rest[1]), own.common_extension(0, new, 0)


def _values(packed: bytes) -> np.ndarray:
    out = np.zeros(((len(packed) - 14) // KEPT_BYTES, 8), dtype=np.uint8)
    out[:, 8 - KEPT_BYTES :] = np.frombuffer(packed, np.uint8, offset=14).reshape(-1, KEPT_BYTES)
    return out.view(">u8").ravel().astype(np.uint64)


def likeness(a: bytes, b: bytes) -> float:
    """Estimated share of common spans among all spans of two fingerprinted texts, 0 to 1."""
    if a == b:
        return 1.0
    x, y = _values(a), _values(b)
    if not len(x) or not len(y):
        return 0.0
    # a sketch with fewer values than it may keep holds all its spans
    both = np.sort(np.concatenate([x, y]))
    twice = np.flatnonzero(both[1:] == both[:-1])
    distinct = len(both) - len(twice)
    if max(len(x), len(y)) < KEPT or distinct <= KEPT:
        return len(twice) / distinct
    last = np.delete(both, twice)[KEPT - 1]
    return int((both[twice] <= last).sum()) / KEPT


def shown(packed: bytes) -> str:
    return base64.b64encode(packed).decode()


def edited(text: str, following: str) -> str:
    """The last third of a text replaced by as many first code points of the following one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


ROW = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.BinaryType()),
    T.StructField("fingerprint", T.BinaryType()), T.StructField("edited_fingerprint", T.BinaryType()),
    T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()), T.StructField("common_prefix", T.LongType()),
    T.StructField("part", T.LongType()), T.StructField("edge", T.StringType()), T.StructField("edge_text", T.StringType()),
])


def _row(doc_id, text: str, following: str) -> tuple:
    """The row of a document whose next one is known, but for its likeness to that one."""
    own, changed, shared = fingerprint_both(code_points(text), code_points(following[: len(text) // 3]))
    digest = hashlib.sha256(edited(text, following).encode("utf-8", "surrogatepass")).digest()
    return doc_id, len(text), digest, own, changed, likeness(own, changed), None, shared, -1, None, None


def _finished(row: tuple, following_print: bytes) -> tuple:
    return *row[:6], likeness(row[3], following_print), *row[7:]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=ROW.names)


def _edge(doc_id, part: int, edge: str, text: str) -> tuple:
    return doc_id, None, None, None, None, None, None, None, part, edge, text


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprint documents in order; each needs the one after it.

    The first and the last document of a partition also leave their text, as its edges.  A
    document's likeness to the next one is known when that one's own fingerprint is, so a
    finished row waits for one document.
    """
    part, before, waiting, rows = TaskContext.get().partitionId(), None, None, []
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = text or ""
            if before is None:
                rows.append(_edge(doc_id, part, "first", text))
            else:
                row = _row(*before, text)
                if waiting is not None:
                    rows.append(_finished(waiting, row[3]))
                waiting = row
            before = (doc_id, text)
            if len(rows) >= 500:
                yield _batch(rows)
                rows = []
    if waiting is not None:
        rows.append(_finished(waiting, fingerprint(before[1])))
    if before is not None:
        rows.append(_edge(before[0], part, "last", before[1]))
    if rows:
        yield _batch(rows)


def _join_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_finished(_row(d, t or "", f or ""), fingerprint(f)) for d, t, f in zip(*(c.to_pylist() for c in batch.columns))]
        if rows:
            yield _batch(rows)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row a document; texts are shuffled once, by range of doc_id.

    Within a partition the next document is the next row.  Across partitions two edge rows
    a partition are joined by their order, so nothing passes through the driver or one task.
    """
    spark = docs.sparkSession
    by_id = F.col("doc_id").desc_nulls_last()
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("__hash", F.xxhash64("text"))
    # rows of one id are told apart by text, and equal rows by place, so no id and no row fills a range of its own
    dealt = slim.repartitionByRange(shuffle_partitions(spark), by_id, "__hash", F.monotonically_increasing_id()).sortWithinPartitions(by_id, "__hash", "text")
    dealt = dealt.select("doc_id", "text")
    walked = saved(dealt.mapInArrow(_walk, ROW), "fingerprints")
    edges = walked.where(F.col("edge").isNotNull())
    # partitions that hold rows, in order: two rows for each of them, without their texts
    parts = edges.where("edge = 'first'").select("part")
    ring = parts.select("part", F.coalesce(F.lead("part").over(W.Window.orderBy("part")), F.min("part").over(W.Window.partitionBy())).alias("after"))
    last = edges.where("edge = 'last'").select("part", "doc_id", F.col("edge_text").alias("text"))
    first = edges.where("edge = 'first'").select(F.col("part").alias("after"), F.col("edge_text").alias("next_text"))
    joined = last.join(ring, "part").join(first, "after").select("doc_id", "text", "next_text").mapInArrow(_join_edges, ROW)
    whole = walked.where(F.col("edge").isNull()).unionByName(joined)
    printed = lambda c: F.base64(F.col(c)).alias(c)
    return whole.select("doc_id", "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), printed("fingerprint"), printed("edited_fingerprint"), "near_edited", "near_next", "common_prefix")
