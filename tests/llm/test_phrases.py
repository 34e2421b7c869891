"""Phrase mining against plain counting."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weftmap.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, longest):
    f, n = {}, Counter()
    for text, lang in rows:
        own = f.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            own.update(tuple(w[k : k + s]) for k in range(len(w)) for s in range(1, longest + 1) if k + s <= len(w))
    return f, n


def brute(rows, longest=3, least=10, top=2000):
    out = []
    f, n = counted(rows, longest)
    for lang, own in f.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[k : k + len(p)] == p for k in range(len(q))) for q, b in candidates.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def fixture():
    r = np.random.default_rng(3)
    zipf = [f"w{k}" for k in range(60)]
    p = 1 / np.arange(1, 61)
    text = lambda n: " ".join(r.choice(zipf, n, p=p / p.sum()))
    rows = [(text(int(r.integers(5, 200))), ["en", "de", None, "und"][k % 4]) for k in range(60)]
    rows += [("The END. of it, the end of IT!\nthe\tend  of größe 日本", "en")] * 12 + [("of the of the of the of the", "en")] * 40
    return rows + [(None, "en"), ("", "fr"), (" ,.; ", "fr"), ("rare words only here", "zz"), (text(20000), "en"), ("a " * 3000, "xx"), ("x\x00y \x0b x\x00y z " * 15, "xx")]


SIZES = [{}, {"run_words": 300, "bucket_words": 500}, {"run_words": 300, "bucket_words": 200, "fan_out": 3, "heavy": 50}]


@pytest.mark.parametrize("sizes", SIZES)
def test_equals_plain_counting(spark, sizes):
    rows = fixture()
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    for c in ("f", "n", "words", "phrase", "bucket", "rank", "names", "hash"):
        docs = docs.withColumn(c, F.lit(c))
    assert sorted(map(tuple, phrases.collocations(docs, **sizes).collect())) == brute(rows)


def test_longer_phrases_and_ties(spark):
    rows = fixture()[:50] + [("one two three four five", "en")] * 7 + [("p q. r s. t u", "en")] * 5
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = phrases.collocations(docs, longest=5, least=4, top=30, run_words=200, bucket_words=300)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, 4, 30)


def test_empty_and_infrequent(spark):
    docs = spark.createDataFrame(fixture(), "text string, lang string")
    assert phrases.collocations(docs.where("false")).count() == 0
    assert phrases.collocations(docs.where("lang = 'fr' or lang = 'zz'")).count() == 0


def test_quicksort_counts_every_frequent_lead():
    r = np.random.default_rng(2)
    for _ in range(40):
        grams = r.integers(1, 6, (int(r.integers(0, 120)), 3)).astype(np.int32)
        grams[r.random(len(grams)) < 0.2, 2] = 0
        grams[grams[:, 2] == 0, 1] *= r.integers(0, 2, (grams[:, 2] == 0).sum(), dtype=np.int32)
        counts = r.integers(1, 4, len(grams))
        want = Counter()
        for g, c in zip(grams.tolist(), counts.tolist()):
            for d in range(1, 4):
                if g[d - 1]:
                    want[tuple(g[:d])] += c
        got = {tuple(grams[a, :d].tolist()): f for a, d, f in zip(*phrases.quicksorted(grams, counts, 5))}
        assert got == {k: v for k, v in want.items() if v >= 5}


def test_scores_pass_64_bits(spark):
    a = (1 << 40) + 12345
    docs = spark.createDataFrame([(a,)], "a long").select(*[F.lit(a).cast("decimal(16,0)").alias(c) for c in "alr"])
    score = docs.select(F.call_function("div", F.col("a") * F.col("a") * F.lit(1_000_000).cast("decimal(7,0)"), F.col("l") * F.col("r"))).first()[0]
    assert score == 1_000_000


def test_equals_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    want = sorted(con.sql("SELECT lang, rank, phrase, a, l, r, n, score FROM (" + phrases.SQL + ")").fetchall())
    assert sorted(map(tuple, phrases.collocations(spark.read.parquet(path)).collect())) == want and want
