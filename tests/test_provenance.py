"""Logs folded as a tree against the plain fold, with the pieces of every segment."""

import random

import pytest

from weftmap.operators import batch, history, provenance

SEGMENTS = "map_id long, order_index int, segment string, length long, inverted boolean, scaffold string"
LOG = "map_id long, seq long, op string, a int, b int, text string"


def plain(state, edits):
    """One edit after another on a list of [segment, length, inverted, scaffold, pieces]."""
    for _, op, a, b, text in edits:
        if op == "move":
            state.insert(b - 1 if b > a else b, state.pop(a))
        else:
            n = 2 if op == "join" else 1
            state[a : a + n] = provenance.apply_to(op, state[a : a + n], b, text)
    return state


def random_map(rng, map_id, n, edits):
    start = [(map_id, k, f"s{k}", rng.randrange(50, 2000), rng.random() < 0.5, rng.choice([None, "x"])) for k in range(n)]
    state = [[s, length, inv, sc, [(s, 0, length, inv)]] for _, _, s, length, inv, sc in start]
    log, seq = [], 0
    while len(log) < edits:
        seq += rng.randrange(1, 4)
        op, a = rng.choice(["cut", "join", "invert", "move", "paint"]), rng.randrange(len(state))
        b, text = 0, rng.choice([None, "c1"])
        if op == "cut":
            if state[a][1] < 2:
                continue
            b = rng.randrange(1, state[a][1])
        elif op == "join" and a + 1 >= len(state):
            continue
        elif op == "move":
            b = rng.randrange(len(state))
        log.append((map_id, seq, op, a, b, text))
        plain(state, [log[-1][1:]])
    return start, log, state


def rows(df):
    return sorted((r["map_id"], r["order_index"], r["segment"], r["length"], r["inverted"], r["scaffold"], [tuple(p) for p in r["pieces"]]) for r in df.collect())


@pytest.mark.parametrize("chunk,places", [(1024, 4096), (7, 5)])
def test_tree_equals_plain_fold(spark, chunk, places):
    rng = random.Random(chunk)
    maps = [random_map(rng, m, n, e) for m, (n, e) in enumerate([(30, 60), (1, 5), (8, 0), (12, 23), (3, 7)])]
    initial = spark.createDataFrame([r for s, _, _ in maps for r in s], SEGMENTS)
    log = spark.createDataFrame([r for _, edits, _ in maps for r in edits], LOG).repartition(3)
    want = sorted((m, k, *s[:4], s[4]) for m, (_, _, state) in enumerate(maps) for k, s in enumerate(state))
    got = provenance.fold_tree(initial, log, chunk, places)
    assert rows(got) == want
    same = history.fold(initial, log).collect()
    assert sorted(tuple(r) for r in same) == sorted((m, k, *s[:4]) for m, k, *s in want)
    # pieces of a segment add up to its length, and no base pair is there twice
    seen = {}
    for p in provenance.pieces_of(got).collect():
        assert p["start"] < p["end"]
        seen.setdefault((p["map_id"], p["source"]), []).append((p["start"], p["end"]))
    for m, (start, _, _) in enumerate(maps):
        for _, _, name, length, *_ in start:
            spans = sorted(seen[(m, name)])
            assert spans[0][0] == 0 and spans[-1][1] == length and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))


@pytest.fixture
def leaves(monkeypatch):
    """How many tables each table was written from."""
    seen, write = [], provenance.written

    def counted(df, tag="step"):
        seen.append(df._jdf.queryExecution().analyzed().collectLeaves().size())
        return write(df, tag)

    monkeypatch.setattr(provenance, "written", counted)
    return seen


def test_plans_do_not_grow_with_the_number_of_chunks(spark, leaves):
    """40 chunks are six levels: every table is written from few others, whatever the level."""
    rng = random.Random(5)
    maps = [random_map(rng, m, n, e) for m, (n, e) in enumerate([(25, 80), (3, 7)])]
    initial = spark.createDataFrame([r for s, _, _ in maps for r in s], SEGMENTS)
    log = spark.createDataFrame([r for _, edits, _ in maps for r in edits], LOG)
    assert rows(provenance.fold_tree(initial, log, 2, 8)) == sorted((m, k, *s[:4], s[4]) for m, (_, _, state) in enumerate(maps) for k, s in enumerate(state))
    assert max(leaves) <= 16


BATCHES = {
    "inverted and sorted": lambda s: batch.after(batch.invert_selected(s.where("length % 3 > 0")), batch.sort_by_length(s)),
    "cut": lambda s: batch.cut_by_size(s, 300),
    "joined": lambda s: batch.join_runs(s.where("length % 3 > 0")),
}


@pytest.mark.parametrize("name", BATCHES)
def test_batches_of_many_chunks(spark, leaves, name):
    rng = random.Random(9)
    start = [(0, k, f"s{k}", rng.randrange(50, 2000), k % 2 == 1, rng.choice([None, "x"])) for k in range(60)]
    initial = spark.createDataFrame(start, SEGMENTS)
    log = BATCHES[name](initial.select("order_index", "length")).selectExpr("0L as map_id", "*")
    edits = sorted(tuple(r)[1:] for r in log.collect())
    assert len(edits) >= 16  # chunks of two
    state = plain([[s, length, inv, sc, [(s, 0, length, inv)]] for _, _, s, length, inv, sc in start], edits)
    assert rows(provenance.fold_tree(initial, log, 2, 16)) == [(0, k, *s) for k, s in enumerate(state)]
    assert max(leaves) <= 16


def test_short_logs_are_worked_out_whole(spark, monkeypatch):
    """Many maps of a few edits each need no rounds that search for components."""
    monkeypatch.setattr(provenance, "components", lambda edges: pytest.fail("a search for components"))
    rng = random.Random(6)
    maps = [random_map(rng, m, 1 + m % 4, 9 + m % 3) for m in range(30)]
    initial = spark.createDataFrame([r for s, _, _ in maps for r in s], SEGMENTS)
    log = spark.createDataFrame([r for _, edits, _ in maps for r in edits], LOG)
    assert rows(provenance.fold_tree(initial, log)) == sorted((m, k, *s[:4], s[4]) for m, (_, _, state) in enumerate(maps) for k, s in enumerate(state))


def test_pieces_of_reversed_segments():
    source = ["s", 100, True, None, [("s", 0, 100, True)]]
    left, right = provenance.apply_to("cut", [source], 30, None)
    assert left[:2] == ["s_R", 30] and left[4] == [("s", 70, 100, True)] and right[4] == [("s", 0, 70, True)]
    turned = provenance.apply_to("invert", [right], None, None)[0]
    assert turned[4] == [("s", 0, 70, False)] and not turned[2]
    joined = provenance.apply_to("join", [turned, left], None, None)[0]
    assert joined[1] == 100 and joined[4] == [("s", 0, 70, False), ("s", 70, 100, True)]
    a, b = provenance.cut_pieces(joined[4], 80)
    assert a == [("s", 0, 70, False), ("s", 90, 100, True)] and b == [("s", 70, 90, True)]


@pytest.mark.parametrize("edit", [("cut", 0, 100, None), ("join", 1, 0, None), ("invert", 5, 0, None), ("delete", 0, 0, "x")])
def test_edits_that_cannot_be_made_are_errors(spark, edit):
    initial = spark.createDataFrame([(1, k, f"s{k}", 100, False, None) for k in range(2)], SEGMENTS)
    with pytest.raises(Exception):
        provenance.fold_tree(initial, spark.createDataFrame([(1, 0, *edit)], LOG)).collect()


def test_layout_of_an_edited_map(spark):
    initial = spark.createDataFrame([(1, 0, "a", 100, False, "chr"), (1, 1, "b", 50, True, None), (1, 2, "c", 10, False, "chr")], SEGMENTS)
    log = spark.createDataFrame([(1, 1, "cut", 0, 60, None), (1, 2, "invert", 1, 0, None), (1, 3, "join", 1, 0, None)], LOG)
    got = [tuple(r)[1:] for r in provenance.layout_rows(provenance.fold_tree(initial, log)).orderBy("object", "part").collect()]
    assert got == [("chr", 1, 1, 60, "a", 1, 60, "+"), ("chr", 2, 61, 100, "a", 61, 100, "-"), ("chr", 3, 101, 150, "b", 1, 50, "-"), ("chr", 4, 151, 160, "c", 1, 10, "+")]
    assert provenance.fold_tree(initial.where("false"), log.where("false")).count() == 0
