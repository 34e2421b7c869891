"""The pipeline's stages on their own inputs, and the entry without this subpackage."""

from collections import Counter

import corpus_pipeline
from tests.llm.test_documents import SCHEMA, WORD, brute_classes, brute_distance, brute_histograms, brute_quality, brute_targets, clashing, prose
from weftmap.llm import packing, quality


def test_stages_keep_columns_and_take_effect(spark):
    words = "the of and to in is that it for was".split()
    text = lambda k: " ".join(words[i % 10] if i % 2 else w for i, w in enumerate(prose(k, 150).split()))
    data = [(k, text(k), "en", "ab"[k % 2], 1) for k in range(20)] + [(50, text(3), "en", "a", 1), (51, "too short", "en", "a", 1), (52, None, None, None, None), (53, "same words all over again " * 40, "en", "b", 1)]
    docs = clashing(spark.createDataFrame(data, SCHEMA))
    kept = corpus_pipeline.STAGES[0][1](spark, docs, "")
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {*range(20), 50}
    one = corpus_pipeline.STAGES[1][1](spark, kept, "")
    assert one.columns == docs.columns and sorted(r["doc_id"] for r in one.collect()) == list(range(20))
    mixed = corpus_pipeline.STAGES[2][1](spark, one, "")
    ids = [r["doc_id"] for r in mixed.collect()]
    assert mixed.columns == docs.columns and set(ids) <= set(range(20)) and all(ids.count(k) <= 2 for k in ids)
    packed = corpus_pipeline.STAGES[3][1](spark, mixed, "").collect()
    assert sorted(r["doc_id"] for r in packed if r["start"] == 0) == sorted(ids)


def test_the_whole_pipeline_equals_brute_force(spark):
    """run() on the smallest tables: each stage again in Python, from the rows that the one before it keeps."""
    from tokenizers import Tokenizer

    d = "/root/testdata/sf0.001"
    data = [(r["doc_id"], r["text"] or "", r["lang"], r["source"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    sums, found = {}, {x[0]: brute_histograms(x[1]) for x in data}
    for doc_id, _, lang, _ in data:
        if lang in quality.COMMON_WORDS:
            have = sums.setdefault(lang, ([0] * 9, [0] * (len(quality.VOCABULARY) + 1)))
            for mine, own in zip(have, found[doc_id]):
                mine[:] = [a + b for a, b in zip(mine, own)]

    def kept(doc_id, text, lang, _):
        n = brute_quality(text)
        refs = [sums[lang]] if lang in sums else list(sums.values())
        near = lambda k: min(brute_distance(found[doc_id][k], r[k]) for r in refs)
        return n[0] >= 10 and 100 * n[4] <= 20 * n[0] and (len(text) < 200 or near(0) <= 0.3) and (n[0] < 80 or near(1) <= 0.5)

    good = [x for x in data if kept(*x)]
    one = [min((good[i] for i in g), key=lambda x: x[0]) for g in brute_classes(good)]
    words = {x[0]: len(WORD.findall(x[1])) for x in one}
    sizes = Counter()
    for x in one:
        sizes[x[3]] += words[x[0]]
    pieces = corpus_pipeline.run(spark, d).collect()
    copies = Counter(p["doc_id"] for p in pieces if p["start"] == 0)
    by_id = {x[0]: x for x in one}
    assert set(copies) <= set(by_id) and max(copies.values()) <= 2 and len(good) < len(data) and len(one) < len(good)
    for source, target in brute_targets(dict(sizes)).items():
        own = [x for x in one if x[3] == source]
        assert abs(sum(copies[x[0]] * words[x[0]] for x in own) - target) <= max(words[x[0]] for x in own)
    library, tokens = Tokenizer.from_file(packing.vocabulary_path()), Counter()
    for p in pieces:
        tokens[p["doc_id"]] += p["length"]
    assert tokens == {k: n * (len(library.encode(by_id[k][1], add_special_tokens=False).ids) + 1) for k, n in copies.items()}
    ends = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == ends.get(p["sequence_id"], 0)
        ends[p["sequence_id"]] = p["offset"] + p["length"]
    assert all(ends[k] == 2048 for k in range(len(ends) - 1)) and sorted(ends) == list(range(len(ends)))


def test_stages_keep_very_long_texts(spark):
    words = "the of and to in is that it for was".split()
    long = " ".join(w if k % 2 else words[k % 10] for k, w in enumerate(prose(5, 60_000).split()))
    docs = spark.createDataFrame([(1, long, "en", "a", 1), (2, long + " end", "en", "a", 1), (3, prose(9, 100), "en", "b", 1)], SCHEMA)
    one = corpus_pipeline.STAGES[1][1](spark, docs, "")
    assert sorted(r["doc_id"] for r in one.collect()) == [1, 3]
    packed = corpus_pipeline.STAGES[3][1](spark, docs.where("doc_id = 1"), "").collect()
    assert sum(p["length"] for p in packed) == packed[0]["doc_tokens"] > 60_000


def test_stages_take_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0, name


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
