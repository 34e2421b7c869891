"""The Merkle manifest against a plain tree over lists."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from weftmap.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (3, "three", "en", "a", 5), (1, None, "en", None, None), (None, "no id", "en", "b", 2), (2, "", "en", "b", 0), (2, "", "en", "b", 0), (2, "same id", "en", "b", 7),
    (7, "x" * 100000, None, "a", 100000), (8, "größe 日本", None, "a", 8), (9, "alone", "zz", "a", 5), (11, "big", "de", "c", (1 << 63) - 1), (26, "big", "de", "c", (1 << 63) - 1), (-4, "empty lang", "", "c", 3),
] + [(100 + k, f"text {k}", "fr", "s", k) for k in range(21)]


def h(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)))


def tree(leaves):
    """(root, proof of every leaf as lists of runs with the leaf's side)."""
    proofs, members, level = [[] for _ in leaves], [[k] for k in range(len(leaves))], list(leaves)
    while len(level) > 1:
        up, groups = [], []
        for k in range(0, len(level), 2):
            run = level[k : k + 2]
            for side in range(len(run)):
                for m in members[k + side]:
                    proofs[m].append((side, run[1 - side] if len(run) == 2 else None))
            up.append(h(*run)), groups.append(sum(members[k : k + 2], []))
        level, members = up, groups
    return level[0], proofs


def fold(d, proof):
    for side, other in proof:
        d = h(d) if other is None else h(other, d) if side else h(d, other)
    return d


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    order = {g: sorted(by[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))) for g in langs}
    lower = {g: tree([leaf(*r) for r in order[g]]) for g in langs}
    root, upper = tree([lower[g][0] for g in langs])
    out = []
    for g, top in zip(langs, upper):
        for r, proof in zip(order[g], lower[g][1]):
            whole = proof + top
            bad = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            got = fold(leaf(*r[:4], r[4] + 1) if bad else leaf(*r), whole)
            out.append((r[0], leaf(*r), lower[g][0], root, h(*(o or "" for _, o in whole)), got, got == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [1, 3, 10])
def test_manifest_equals_a_plain_tree(spark, bits):
    docs = spark.createDataFrame(ODD, SCHEMA).repartition(3)
    for c in ("key", "at", "digest", "witness", "root", "block", "row", "order", "n"):
        docs = docs.withColumn(c, F.lit(c))
    got = sorted((tuple(r) for r in merkle.verify_documents(docs, bits).collect()), key=str)
    want = brute(ODD)
    assert got == want and {r[-1] for r in got} == {True, False}


def test_one_row_and_no_rows(spark):
    one = merkle.verify_documents(spark.createDataFrame([(5, "t", "en", "a", 1)], SCHEMA)).collect()
    assert [tuple(r) for r in one] == brute([(5, "t", "en", "a", 1)]) and one[0]["proof_sha256"] == h()
    empty = merkle.verify_documents(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_witnesses_grow_as_siblings_complete():
    s, leaves = merkle.Subtrees(), [h(str(k)).encode() for k in range(13)]
    for k, d in enumerate(leaves):
        s.append(d)
        assert [1 << height for height, _, _ in s.open] == [1 << b for b in range(5, -1, -1) if (k + 1) >> b & 1]
        for height, digest, first in s.open:  # every partial witness leads to its open subtree
            assert all(merkle.folded(leaves[m], bytes(s.witness[m])) == digest for m in range(first, first + (1 << height)))
    root = s.close(4)
    assert root.decode() == tree([x.decode() for x in leaves])[0] and all(merkle.folded(d, bytes(w)) == root for d, w in zip(leaves, s.witness))


def test_equals_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    want = sorted(con.sql(merkle.SQL).fetchall())
    assert sorted(tuple(r) for r in merkle.verify_documents(spark.read.parquet(path)).collect()) == want
