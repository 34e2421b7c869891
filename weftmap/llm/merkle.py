"""Merkle manifest of a dataset with incremental witnesses.

Rows are leaves.  Leaves of a group, in their order, are appended to a stream of aligned
subtrees: an open subtree has a digest, and each of its members a partial witness.  When a sibling
completes, both close into their parent and every member's witness grows by the other's digest.
The stream of a group is cut into aligned blocks of ``2 ** bits`` leaves, which any task can
append on its own; the roots of blocks are appended to the next stream in the same way, until a
group has one block.  The roots of the groups form a last stream, whose root covers everything.
Witnesses of blocks then extend those of their members, from the top down.

A group's rows are numbered by ranges (one row a range and group is summed), a task holds one block,
and every join is on a block, so a group may hold any share of the rows.

Defined results
    null group, order    a group of its own, before all others; before all numbers
    a null column        ``-`` in the leaf; an empty text is ``0:``
    repeated rows        a leaf each, beside each other; rows with one order are told by their leaf
    very long text       hashed by Spark where it is read; only digests move
    largest number       tampering counts on without overflow
    one row              its leaf is subroot and root; its proof is the digest of nothing
    empty table          no rows
    extra columns        not read
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .common import drop_saved, saved

#: Leaves of a block: 2 ** BITS.
BITS = 10
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: What a level adds to a witness: one of these bytes and, but for ALONE, the sibling's 32 bytes.
ALONE, LEFT, RIGHT = b"\0", b"\1", b"\2"


def digest_of(*hexes: bytes) -> bytes:
    """Hex digest of hex digests, concatenated."""
    return hashlib.sha256(b"".join(hexes)).hexdigest().encode()


class Subtrees:
    """A stream of leaves as aligned subtrees that are still open, with a witness for each leaf.

    ``open`` holds (height, digest, first leaf) from left to right, heights falling.
    """

    def __init__(self) -> None:
        self.open: list[tuple[int, bytes, int]] = []
        self.witness: list[bytearray] = []

    def append(self, digest: bytes) -> None:
        self.open.append((0, digest, len(self.witness)))
        self.witness.append(bytearray())
        while len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
            self._join()

    def _join(self) -> None:
        (_, right, middle), (height, left, first) = self.open.pop(), self.open.pop()
        to_left, to_right = RIGHT + bytes.fromhex(right.decode()), LEFT + bytes.fromhex(left.decode())
        for k in range(first, middle):
            self.witness[k] += to_left
        for k in range(middle, len(self.witness)):
            self.witness[k] += to_right
        self.open.append((height + 1, digest_of(left, right), first))

    def close(self, height: int) -> bytes:
        """The root of all leaves at a height; a last run of one node becomes the digest of that node."""
        while len(self.open) > 1 or self.open[0][0] < height:
            if len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
                self._join()
                continue
            own, digest, first = self.open.pop()
            for k in range(first, len(self.witness)):
                self.witness[k] += ALONE
            self.open.append((own + 1, digest_of(digest), first))
        return self.open[0][1]


def siblings(witness: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(side, hex digest) of every level of a witness; the digest is empty where a node is alone."""
    at = 0
    while at < len(witness):
        side = witness[at : at + 1]
        end = at + 1 + 32 * (side != ALONE)
        yield side, witness[at + 1 : end].hex().encode()
        at = end


def folded(leaf: bytes, witness: bytes) -> bytes:
    """The root that a leaf and its witness lead to."""
    for side, other in siblings(witness):
        leaf = digest_of(other, leaf) if side == LEFT else digest_of(leaf, other)
    return leaf


def proof_of(witness: bytes) -> bytes:
    return digest_of(*(other for _, other in siblings(witness)))


def leaf_of(columns: Sequence[Column]) -> Column:
    """Hex sha256 of columns: ``-`` for a null, else the bytes of the value, ``:`` and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (c.cast("string") for c in columns)]
    return F.sha2(F.concat(*parts), 256)


def placed(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` (key, ...) with ``at``, a row's place within its key from 0, and ``n``, the key's rows.

    Rows are dealt by ranges of (key, order) and written, so that no task sorts a whole key.
    """
    dealt = saved(df.repartitionByRange("key", *order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("__range", "key").agg(F.count(F.lit(1)).alias("__rows"))
    own = W.Window.partitionBy("key")
    before = own.orderBy("__range").rowsBetween(W.Window.unboundedPreceding, -1)
    starts = sizes.select("__range", "key", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"), F.sum("__rows").over(own).alias("n"))
    inside = F.row_number().over(W.Window.partitionBy("__range", "key").orderBy(*order)) - 1
    return dealt.withColumn("__inside", inside).join(starts, ["__range", "key"]).withColumn("at", F.col("__before") + F.col("__inside")).drop("__range", "__before", "__inside")


def appended(nodes: DataFrame, bits: int) -> DataFrame:
    """``nodes`` (key, at, n, digest, ...) with block, witness within the block, and the block's root."""
    size = 1 << bits
    dealt = nodes.withColumn("block", F.shiftright("at", bits)).repartition("key", "block").sortWithinPartitions("key", "at")

    def finish(rows: pa.Table) -> pa.RecordBatch:
        """The rows of whole blocks."""
        at, n, digests = rows["at"].to_numpy(), rows["n"].to_numpy(), rows["digest"].to_pylist()
        keys = rows["key"].combine_chunks().dictionary_encode().indices.to_numpy()
        starts = np.flatnonzero(np.r_[True, (np.diff(keys) != 0) | (np.diff(at >> bits) != 0)])
        witnesses, roots = [], []
        for a, b in zip(starts, [*starts[1:], len(at)]):
            tree = Subtrees()
            for d in digests[a:b]:
                tree.append(d.encode())
            root = tree.close(bits if n[a] > size else int(n[a] - 1).bit_length()).decode()
            witnesses += map(bytes, tree.witness)
            roots += [root] * (b - a)
        own = rows.append_column("witness", pa.array(witnesses, pa.binary())).append_column("root", pa.array(roots, pa.string()))
        return own.combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []  # the last block so far
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([*rest, batch])
            at, keys = rows["at"].to_numpy() >> bits, rows["key"].combine_chunks().dictionary_encode().indices.to_numpy()
            last = int(np.flatnonzero(np.r_[True, (np.diff(keys) != 0) | (np.diff(at) != 0)])[-1])
            if last:
                yield finish(rows.slice(0, last))
            rest = rows.slice(last).combine_chunks().to_batches()
        if rest:
            yield finish(pa.Table.from_batches(rest))

    return dealt.mapInArrow(run, T.StructType([*dealt.schema, T.StructField("witness", T.BinaryType()), T.StructField("root", T.StringType())]))


def streams(nodes: DataFrame, bits: int) -> list[DataFrame]:
    """Written tables of ``appended``: the leaves, the roots of their blocks, and so on, until no key has two blocks."""
    out = [saved(appended(nodes, bits), "subtrees")]
    while True:
        more = out[-1].where(F.col("n") > (1 << bits))
        if more.limit(1).count() == 0:
            return out
        blocks = F.shiftright(F.col("n") + ((1 << bits) - 1), bits)
        roots = more.where(F.col("at") == F.shiftleft(F.col("block"), bits)).select("key", F.col("block").alias("at"), blocks.alias("n"), F.col("root").alias("digest"))
        out.append(saved(appended(roots, bits), "subtrees"))


def roots_of(tables: Sequence[DataFrame], bits: int) -> DataFrame:
    """(key, level, root): a key's root, and the table in which it has one block."""
    found = [t.where((F.col("n") <= (1 << bits)) & (F.col("at") == 0)).select("key", F.lit(k).alias("level"), "root") for k, t in enumerate(tables)]
    return reduce(DataFrame.unionByName, found)


def extended(tables: Sequence[DataFrame], above: DataFrame) -> DataFrame:
    """The first table with whole witnesses, and the roots that ``above`` (key, level, witness, subroot, root) has for its key."""
    carried: DataFrame | None = None
    for k in reversed(range(len(tables))):
        own = tables[k].drop("root")
        up = above.where(F.col("level") == k).select("key", F.lit(0).cast("long").alias("block"), F.col("witness").alias("__more"), "subroot", "root")
        if carried is not None:
            up = up.unionByName(carried.select("key", F.col("at").alias("block"), F.col("witness").alias("__more"), "subroot", "root"))
        carried = own.join(up, ["key", "block"]).withColumn("witness", F.concat("witness", "__more")).drop("__more")
    return carried


def witnessed(leaves: DataFrame, order: Sequence[str], bits: int = BITS) -> DataFrame:
    """``leaves`` (key, digest, ...) with at, n, witness (up to the root of all), subroot and root.

    ``key`` is a string without nulls that sorts as the groups do.
    """
    rows = placed(leaves, order)
    tables = streams(rows, bits)
    groups = saved(roots_of(tables, bits), "subroots")
    tops = placed(groups.select(F.lit("").alias("key"), F.col("key").alias("group"), "level", F.col("root").alias("digest")), ["group"])
    top_tables = streams(tops, bits)
    whole = roots_of(top_tables, bits).select("key", "level", F.lit(b"").alias("witness"), F.col("root").alias("subroot"), "root")
    above = extended(top_tables, whole).select(F.col("group").alias("key"), F.col("level"), "witness", F.col("digest").alias("subroot"), "root")
    above = saved(above, "witnesses")
    out = saved(extended(tables, above), "witnesses")
    drop_saved(groups, above, *tables, *top_tables)
    return out


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, group: str = "lang", order: str = "doc_id", changed: str = "n_chars", bits: int = BITS) -> DataFrame:
    """(order, leaf, tampered, witness, subroot, root), one row a row of ``docs``.

    ``tampered`` is the leaf with 1 added to ``changed`` where 7 divides the crc32 of ``order``.
    """
    plus = (F.col(f"`{changed}`").cast("decimal(20,0)") + 1).cast("string")
    hit = (F.crc32(F.col(f"`{order}`").cast("string").cast("binary")) % 7 == 0) & F.col(f"`{changed}`").isNotNull()
    own = [F.col(f"`{c}`") for c in columns]
    other = leaf_of([plus if c == changed else F.col(f"`{c}`") for c in columns])
    key = F.coalesce(F.concat(F.lit("1"), F.col(f"`{group}`").cast("string")), F.lit("0"))
    leaves = docs.select(key.alias("key"), F.col(f"`{order}`").alias("order"), leaf_of(own).alias("digest"), F.when(hit, other).alias("tampered"))
    leaves = saved(leaves.withColumn("row", F.monotonically_increasing_id()), "leaves")
    out = witnessed(leaves, ["order", "digest", "row"], bits)
    drop_saved(leaves)
    return out.select(F.col("order").alias(order), F.col("digest").alias("leaf"), "tampered", "witness", "subroot", "root")


def verify_documents(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Digest of the manifest: each (tampered) leaf folded with its witness and compared with the root."""
    rows = manifest(docs, bits=bits)
    own = rows.select("doc_id", "leaf", "subroot", "root").schema
    schema = T.StructType([*own, T.StructField("proof_sha256", T.StringType()), T.StructField("folded_root", T.StringType()), T.StructField("verified", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves, changed, witnesses = (batch.column(c).to_pylist() for c in ("leaf", "tampered", "witness"))
            roots = [folded((c or leaf).encode(), w).decode() for leaf, c, w in zip(leaves, changed, witnesses)]
            proofs = [proof_of(w).decode() for w in witnesses]
            same = [a == b for a, b in zip(roots, batch.column("root").to_pylist())]
            own = [batch.column(c) for c in ("doc_id", "leaf", "subroot", "root")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(proofs, pa.string()), pa.array(roots, pa.string()), pa.array(same, pa.bool_())], names=schema.names)

    return rows.mapInArrow(run, schema)


#: The same in SQL: levels by recursion, crc32 bit by bit.
SQL = """
WITH RECURSIVE base AS (
  SELECT doc_id, lang, coalesce('1' || lang, '0') AS grp, n_chars IS NOT NULL AS has, [doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text] AS v,
    [doc_id::VARCHAR, source, lang, (n_chars::HUGEINT + 1)::VARCHAR, text] AS w FROM documents),
hashed AS (
  SELECT doc_id, grp, has, sha256(list_aggregate([coalesce(strlen(x)::VARCHAR || ':' || x, '-') FOR x IN v], 'string_agg', '')) AS leaf,
    sha256(list_aggregate([coalesce(strlen(x)::VARCHAR || ':' || x, '-') FOR x IN w], 'string_agg', '')) AS other FROM base),
crc(doc_id, k, c) AS (
  SELECT DISTINCT doc_id, 0::BIGINT, 4294967295::BIGINT FROM base WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT doc_id, k + 1, CASE WHEN k % 9 = 0 THEN xor(c, ascii(substr(doc_id::VARCHAR, (k // 9 + 1)::INT, 1))::BIGINT) ELSE xor(c >> 1, 3988292384 * (c & 1)) END
  FROM crc WHERE k < 9 * length(doc_id::VARCHAR)),
leaves AS (
  SELECT h.doc_id, grp, leaf, CASE WHEN has AND xor(c, 4294967295) % 7 = 0 THEN other ELSE leaf END AS start,
    row_number() OVER (PARTITION BY grp ORDER BY h.doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM hashed h LEFT JOIN crc ON h.doc_id IS NOT DISTINCT FROM crc.doc_id AND crc.k = 9 * length(h.doc_id::VARCHAR)),
lower_tree(grp, level, pos, d, n) AS (
  SELECT grp, 0, pos, leaf, count(*) OVER (PARTITION BY grp) FROM leaves
  UNION ALL
  SELECT grp, level + 1, pos // 2, sha256(string_agg(d, '' ORDER BY pos)), any_value((n + 1) // 2) FROM lower_tree WHERE n > 1 GROUP BY grp, level, pos // 2),
subroots AS (SELECT grp, d, row_number() OVER (ORDER BY encode(grp)) - 1 AS pos FROM lower_tree WHERE n = 1),
upper_tree(level, pos, d, n) AS (
  SELECT 0, pos, d, count(*) OVER () FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(d, '' ORDER BY pos)), any_value((n + 1) // 2) FROM upper_tree WHERE n > 1 GROUP BY level, pos // 2),
roots AS (SELECT d AS root FROM upper_tree WHERE n = 1),
walk AS (
  SELECT l.doc_id, l.grp, l.leaf, l.start, l.pos, t.level AS step, coalesce(s.d, '') AS sibling, (l.pos >> t.level) & 1 AS side
  FROM leaves l JOIN (SELECT DISTINCT grp, level FROM lower_tree WHERE n > 1) t ON t.grp = l.grp
  LEFT JOIN lower_tree s ON s.grp = l.grp AND s.level = t.level AND s.pos = xor(l.pos >> t.level, 1)
  UNION ALL
  SELECT l.doc_id, l.grp, l.leaf, l.start, l.pos, 1000 + t.level, coalesce(s.d, ''), (g.pos >> t.level) & 1
  FROM leaves l JOIN subroots g ON g.grp = l.grp CROSS JOIN (SELECT DISTINCT level FROM upper_tree WHERE n > 1) t
  LEFT JOIN upper_tree s ON s.level = t.level AND s.pos = xor(g.pos >> t.level, 1)),
steps AS (SELECT *, row_number() OVER (PARTITION BY grp, pos ORDER BY step) AS k FROM walk),
fold(grp, pos, k, d) AS (
  SELECT grp, pos, 0::BIGINT, start FROM leaves
  UNION ALL
  SELECT f.grp, f.pos, s.k, sha256(CASE WHEN s.side = 1 THEN s.sibling || f.d ELSE f.d || s.sibling END) FROM fold f JOIN steps s ON s.grp = f.grp AND s.pos = f.pos AND s.k = f.k + 1),
proofs AS (SELECT grp, pos, string_agg(sibling, '' ORDER BY k) AS p, max(k) AS top FROM steps GROUP BY grp, pos)
SELECT l.doc_id, l.leaf, g.d AS subroot, r.root, sha256(coalesce(p.p, '')) AS proof_sha256, f.d AS folded_root, f.d = r.root AS verified
FROM leaves l JOIN subroots g ON g.grp = l.grp CROSS JOIN roots r LEFT JOIN proofs p ON p.grp = l.grp AND p.pos = l.pos
JOIN fold f ON f.grp = l.grp AND f.pos = l.pos AND f.k = coalesce(p.top, 0)
"""
