"""FM-index search against a plain search over word lists."""

import hashlib
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftmap.llm import bytewords, fmindex

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add("" if item is None else str(item))
    lengths = {len(p) for p in windows}
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, names = set(), set()
        for k in range(len(w)):
            for n in lengths:
                got = windows.get(tuple(w[k : k + n])) if k + n <= len(w) else None
                if got:
                    hit.update(range(k, k + n))
                    names |= got
        joined = ",".join(sorted(names, key=str.encode)).encode()
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(joined).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def fixture():
    r = np.random.default_rng(5)
    prose = lambda n: " ".join("".join(r.choice(list("abcd"), 2)) for _ in range(n))
    long_item = prose(25)
    items = [(1, long_item), (10, "Short Ones here"), (2, "short ones HERE"), (3, None), (4, " .,; "), (5, prose(10)), (None, prose(12)), (1, prose(11)), (6, "aa"), (7, "größe über 日本語 ok x")]
    docs = [
        (1, f"{prose(40)} {long_item.upper()} {prose(7)}"), (2, " ".join(long_item.split()[3:14])), (3, " ".join(long_item.split()[3:12])), (4, None), (5, ""), (6, "--- \x00 \x7f"),
        (7, f"x {' '.join(long_item.split()[:12])} y {' '.join(long_item.split()[10:])}"), (8, "Short\nones, here! short ones here here short"), (9, items[5][1]), (9, items[5][1]), (None, items[6][1]),
        (10, "GRÖSSE größe über 日本語 ok x"), (11, prose(3000)), (12, (long_item + " ") * 40), (13, long_item), (13, long_item), (14, "aa aa aa b aa"),
    ] + [(100 + k, prose(30 + k)) for k in range(30)]
    return docs, items


@pytest.mark.parametrize("shard_words,block", [(1 << 20, 100_000), (64, 7), (200, 3)])
def test_equals_plain_search(spark, monkeypatch, shard_words, block):
    monkeypatch.setattr(fmindex, "pieces", lambda texts, cut: bytewords.pieces(texts, cut, 60 if shard_words < 1000 else 1 << 18))
    docs, items = fixture()
    if shard_words == 200:
        docs, items = docs[:17], items[:3]  # many blocks of few phrases
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    for c in ("row", "words", "spans", "items", "phrase", "n_words", "k", "ids"):
        d, b = d.withColumn(c, F.lit(c)), b.withColumn(c, F.lit(c))
    assert sorted(map(tuple, fmindex.decontaminate(d, b, shard_words=shard_words, block=block).collect()), key=str) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = fixture()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert fmindex.decontaminate(d.where("false"), b).count() == 0
    assert sorted(map(tuple, fmindex.decontaminate(d, b.where("false")).collect()), key=str) == brute(docs, [])


def test_suffix_array_search_and_locate():
    r = np.random.default_rng(1)
    for case in range(30):
        docs = [r.integers(1, 4, int(n)) for n in r.integers(1, 80, 4)]
        if case % 3 == 0:
            docs.append(docs[0])  # equal documents
        symbols = np.concatenate([np.append(d, 0) for d in docs])
        stops = symbols == 0
        first = np.where(stops, np.cumsum(stops) - 1, symbols + stops.sum() - 1)
        assert fmindex.suffix_array(first).tolist() == sorted(range(len(first)), key=lambda k: first[k:].tolist())
        starts = np.cumsum([0, *[len(d) + 1 for d in docs[:-1]]])
        shard = fmindex.Shard(*fmindex.Shard.build(symbols, 4, starts))
        phrases = r.integers(1, 4, (20, 5))
        lengths = r.integers(1, 6, 20)
        for p, n, low, high in zip(phrases, lengths, *shard.search(phrases, lengths)):
            want = [k for k in range(len(symbols)) if symbols[k : k + n].tolist() == p[:n].tolist()]
            assert sorted(shard.locate(np.arange(low, high)).tolist()) == want


def test_words_on_bytes():
    texts = ["Ab c", None, "", "x-y", "größe ½", "--", "end", "A" * 50 + " b " + "c" * 70 + " d"]
    for size in (8, 1 << 18):
        got = [[] for _ in texts]
        for first, data, ends, _ in bytewords.pieces(pa.array(texts), ~fmindex.INSIDE, size):
            own, starts = bytewords.words(data, ends, fmindex.INSIDE)
            for k, w in zip(np.searchsorted(ends, starts, side="right"), own.to_pylist()):
                got[first + k].append(w)
        assert got == [words(t) for t in texts]


def test_equals_sql(spark):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    got = fmindex.decontaminate(*(spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "benchmark")))
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(fmindex.SQL).fetchall())
    assert got.where("contaminated").count() > 0
