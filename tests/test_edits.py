"""Edit logs, batch edits, scripts, replay and composed curation, against plain lists."""

import random

import pytest
from pyspark.sql import functions as F

from weftmap.operators import batch, history, links, scripts, select
from weftmap.plans import curate

INITIAL = "map_id long, order_index int, segment string, length long, inverted boolean, scaffold string"
LOG = "map_id long, seq long, op string, a int, b int, text string"


def segments(n, length=10):
    return [[str(k), length, False, None] for k in range(n)]


def names(state):
    return [s[0] for s in state]


def done(state, *ops):
    state = [list(s) for s in state]
    for op in ops:
        history.apply_operation(state, *op, *[None] * (4 - len(op)))
    return state


def test_edit_algebra():
    s = segments(4)
    assert names(done(s, ("move", 0, 2))) == ["1", "0", "2", "3"] and names(done(s, ("move", 3, 1))) == ["0", "3", "1", "2"]
    assert done(s, ("invert", 1, 0), ("invert", 1, 0)) == s
    cut = done(s, ("cut", 1, 4))
    assert names(cut) == ["0", "1_L", "1_R", "2", "3"] and [x[1] for x in cut] == [10, 4, 6, 10, 10]
    assert names(done(cut, ("join", 1, 0))) == ["0", "1_L+1_R", "2", "3"]
    assert done(s, ("cut", 1, 10)) == s and done(s, ("cut", 9, 4)) == s and done([], ("invert", 0, 0)) == []
    painted = done(s, ("paint", 1, 0, "x"), ("paint", 2, 0, "x"), ("paint", 3, 0, "y"))
    assert [x[3] for x in done(painted, ("rename", 2, 0, "z"))] == [None, "z", "z", "y"] and [x[3] for x in done(painted, ("delete", 0, 0, "x"))] == [None, None, None, "y"]


def brute(state, ops):
    """The same edits by slices of new lists."""
    for op, a, b, text in ops:
        n = len(state)
        if op == "delete":
            state = [(s[0], s[1], s[2], None if s[3] == text else s[3]) for s in state]
        elif 0 <= a < n:
            name, length, turned, scaffold = state[a]
            new = None
            if op == "cut" and 0 < b < length:
                first, second = ("_R", "_L") if turned else ("_L", "_R")
                new = [(name + first, b, turned, scaffold), (name + second, length - b, turned, scaffold)]
            elif op == "invert":
                new = [(name, length, not turned, scaffold)]
            elif op == "paint":
                new = [(name, length, turned, text)]
            elif op == "join" and a + 1 < n:
                x = state[a + 1]
                state = state[:a] + [(name + "+" + x[0], length + x[1], turned and x[2], scaffold)] + state[a + 2 :]
            elif op == "move" and b < n:
                rest = state[:a] + state[a + 1 :]
                to = b - 1 if b > a else b
                state = rest[:to] + [(name, length, turned, scaffold)] + rest[to:]
            if new is not None:
                state = state[:a] + new + state[a + 1 :]
    return state


def made_logs():
    rnd = random.Random(7)
    kinds = ("cut", "join", "invert", "move", "paint", "delete")
    initial = [(m, k, f"s{k}", 50 + k, k % 2 == 1, "z" if k % 3 == 0 else None) for m in range(5) for k in range(6)] + [(9, 0, "only", 5, False, None)]
    # few cuts of joined segments: names of parts hold the names of their wholes
    log = [(m, 10 * q, rnd.choice(kinds[2:] if q % 3 or not m else kinds), rnd.randrange(8), rnd.randrange(60 if q % 2 else 8), rnd.choice([None, "x", "z"])) for m in range(5) for q in range(60 if m else 1200)]
    rnd.shuffle(log)
    return initial, log


def test_fold_equals_plain_lists(spark):
    initial, log = made_logs()
    states = history.fold(spark.createDataFrame(initial, INITIAL), spark.createDataFrame(log, LOG))
    got = {}
    for r in states.collect():
        got.setdefault(r["map_id"], []).append((r["order_index"], r["segment"], r["length"], r["inverted"], r["scaffold"]))
    for m in (*range(5), 9):
        start = [tuple(x[2:]) for x in initial if x[0] == m]
        want = brute(start, [x[2:] for x in sorted((x for x in log if x[0] == m), key=lambda x: x[1])])
        assert [x[1:] for x in sorted(got[m])] == want
    half = history.fold(spark.createDataFrame(initial, INITIAL), spark.createDataFrame(log, LOG), upto=50)
    assert half.where("map_id = 9").count() == 1
    assert history.fold(spark.createDataFrame([], INITIAL), spark.createDataFrame([], LOG)).count() == 0


def test_replay_tells_which_snapshots_match(spark):
    initial, log = (spark.createDataFrame(x, s) for x, s in zip(made_logs(), (INITIAL, LOG)))
    marks = []
    for upto in (0, 200, 590):
        d = history.digests(history.fold(initial, log, upto)).where("map_id < 5")
        marks += [(r["map_id"], upto, r["digest"] if (r["map_id"], upto) != (3, 200) else "spoilt") for r in d.collect()]
    got = {(r["map_id"], r["seq"]): r["matches"] for r in history.replay(initial, log, spark.createDataFrame(marks, "map_id long, seq long, digest string")).collect()}
    assert got == {(m, u): (m, u) != (3, 200) for m in range(5) for u in (0, 200, 590)}


def test_scripts_of_a_log_give_the_states_of_its_fold(spark):
    from weftmap.contract.queries import QUERIES

    folded, executed = (sorted(map(tuple, QUERIES[q](spark, "/root/testdata/sf0.001").collect()), key=str) for q in ("folded_edits", "executed_scripts"))
    assert folded == executed and len(folded) > 50


def test_script_commands(spark):
    lines = ["cut a 4", "cut a_L 9", "join a_L a_R", "join 'c' b", "invert #9", "scaffold create Big", "scaffold paint c+b bIG", "scaffold paint A_l+a_r big", "assert scaffolds == 1", "assert misassemblies <= 2", "assert misassemblies > 2", "move d before #0", "move d after #1", "move d to 0", "select d..#1", "select where length >= 0.02kb", "scaffold unpaint #0", "scaffold delete BIG", "zoom d", "zoom nobody", "goto 1 2", "autocut", "# a remark", "", "deselect"]
    start = spark.createDataFrame([(1, k, n, 10, False, None) for k, n in enumerate("abcd")], INITIAL)
    body = spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], "map_id long, line long, body string")
    out = scripts.execute(start, history.commands(body, "map_id"), spark.createDataFrame([(1, 2)], "map_id long, misassemblies long"), continue_on_error=True)
    got = {lines[r["line"]]: (r["success"], r["value"]) for r in scripts.results(out).collect()}
    failed = {x for x, (ok, _) in got.items() if not ok}
    # c stands after b, so joining c and b keeps the order on the map: b+c
    assert failed == {"cut a_L 9", "invert #9", "scaffold paint c+b bIG", "assert misassemblies > 2", "zoom nobody", "autocut"}
    assert got["assert misassemblies > 2"] == (False, 2.0) and got["assert scaffolds == 1"] == (True, 1.0) and got["select where length >= 0.02kb"][1] == 1.0
    final = [(r["segment"], r["scaffold"]) for r in scripts.final(out).orderBy("order_index").collect()]
    assert sorted(final) == [("a_L+a_R", None), ("b+c", None), ("d", None)] and final[0][0] == "d"
    changes = {r["segment"]: r["change"] for r in scripts.preview(start, out).collect()}
    assert changes["a"] == "removed" and changes["b+c"] == "added"


@pytest.mark.parametrize("seed", range(4))
def test_moves_lead_to_the_order(spark, seed):
    rnd = random.Random(seed)
    n = (1, 2, 40, 90)[seed]
    order = list(range(n))
    rnd.shuffle(order)
    wanted = spark.createDataFrame([(o, k) for k, o in enumerate(order)], "order_index int, new_index int")
    moves = batch.moves_to_order(wanted).orderBy("seq").collect()
    state = done(segments(n), *[(r["op"], r["a"], r["b"]) for r in moves])
    assert names(state) == [str(o) for o in order] and len(moves) <= max(0, n - 1)


def test_batch_edits_keep_the_places_they_name(spark):
    seg = spark.createDataFrame([(k, x) for k, x in enumerate([5, 30, 7, 40, 1])], "order_index int, length long")
    state = [[str(r["order_index"]), r["length"], False, None] for r in seg.orderBy("order_index").collect()]
    run = lambda log: done(state, *[(r["op"], r["a"], r["b"]) for r in log.orderBy("seq").collect()])
    assert names(run(batch.cut_by_size(seg, 10))) == ["0", "1_L", "1_R", "2", "3_L", "3_R", "4"]
    chosen = spark.createDataFrame([(0,), (1,), (3,), (1,), (4,)], "order_index int")
    assert names(run(batch.join_runs(chosen))) == ["0+1", "2", "3+4"]
    assert [x[2] for x in run(batch.invert_selected(chosen))] == [True, True, False, True, True]
    assert [x[1] for x in run(batch.sort_by_length(seg, descending=True))] == [40, 30, 7, 5, 1]
    both = batch.after(batch.invert_selected(chosen), batch.sort_by_length(seg))
    assert [(x[0], x[2]) for x in run(both)] == [("4", True), ("0", True), ("2", False), ("1", True), ("3", True)]


def test_curation_as_a_log_gives_its_order(spark):
    """Cuts and the automatic order, folded from the log, stand as the order says."""
    ranges = spark.createDataFrame([(0, "a", 0, 10, 1000), (1, "b", 10, 30, 2001), (2, "c", 30, 33, 300)], "order_index int, name string, start_bin int, end_bin int, length long")
    splits = spark.createDataFrame([(1, 15), (1, 20), (0, 3)], "order_index int, split int")
    parts = curate.cut_ranges(ranges, splits).orderBy("order_index").collect()
    assert [(r["whole"], r["start_bin"], r["end_bin"]) for r in parts] == [(0, 0, 3), (0, 3, 10), (1, 10, 15), (1, 15, 20), (1, 20, 30), (2, 30, 33)]
    assert [r["length"] for r in parts] == [300, 700, 500, 501, 1000, 300]
    order = spark.createDataFrame([(k, o, o % 2 == 0) for k, o in enumerate([4, 1, 0, 5, 3, 2])], "new_index int, order_index int, inverted boolean")
    log = batch.after(batch.automatic_cut_operations(splits, ranges), batch.automatic_sort_operations(order, spark.createDataFrame([(k, False) for k in range(6)], "order_index int, inverted boolean")))
    state = curate.applied(ranges, log).orderBy("order_index").collect()
    assert [(r["length"], r["inverted"]) for r in state] == [(parts[o]["length"], o % 2 == 0) for o in (4, 1, 0, 5, 3, 2)]
    score = curate.sort_scores(order).first()
    assert score["items"] == 6 and score["longest"] == 1 and score["neighbours"] == 2


def test_merged_chains_follow_the_best_link_one_by_one(spark):
    rnd = random.Random(2)
    n = 14
    best = [(a, b, rnd.choice(links.ORIENTATIONS), round(rnd.random(), 6)) for a in range(n) for b in range(a + 1, n) if rnd.random() < 0.5]
    seg = spark.createDataFrame([(k,) for k in range(n)], "order_index int")
    table = spark.createDataFrame(best, "a int, b int, orientation string, score double")
    got = {}
    for r in links.chains(table, seg, 0.4).collect():
        got.setdefault(r["chain"], []).append((r["pos"], r["order_index"]))
    chains = {k: [k] for k in range(n)}
    for a, b, o, s in sorted(best, key=lambda x: (-x[3], x[0], x[1])):
        x, y = (next(c for c in chains.values() if k in c) for k in (a, b))
        if s < 0.4 or x is y or a not in (x[0], x[-1]) or b not in (y[0], y[-1]):
            continue
        left = x if x[-1] == a else x[::-1]
        right = y if y[0] == b else y[::-1]
        for k in left + right:
            chains[k] = left + right
        joined = left + right
        chains = {k: joined if k in joined else c for k, c in chains.items()}
    want = {tuple(c) for c in chains.values()}
    found = {tuple(o for _, o in sorted(c)) for c in got.values()}
    assert {min(c, c[::-1]) for c in found} == {min(c, c[::-1]) for c in want}


def test_signals_merge_round_by_round(spark):
    from weftmap.operators import detect

    ranges = spark.createDataFrame([(0, "a", 0, 24, 24)], "order_index int, name string, start_bin int, end_bin int, length long")
    domain = spark.createDataFrame([(10, 1.0), (12, 1.0)], "p int, strength double")
    track = spark.createDataFrame([(p, 1.0 if p < 11 or p >= 13 else -1.0) for p in range(24)], "p int, e1 double")
    got = detect.misassemblies(domain, track, ranges).orderBy("p").collect()
    assert [(r["p"], r["reason"]) for r in got] == [(11, "both"), (13, "both")]


def test_scaled_maps_of_a_stream_fold_alike(spark, tmp_path):
    """Segments of a stream of operations equal the fold of the same log."""
    from weftmap.contract.queries import QUERIES

    d = "/root/testdata/sf0.001"
    folded = QUERIES["folded_edits"](spark, d).groupBy("map_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("order_index", "segment"))), lambda x: x["segment"]), ",").alias("s"))
    want = {r["map_id"]: (r["n"], r["s"]) for r in folded.collect()}
    got = {r["map_id"]: (r["n_segments"], r["segment_order"]) for r in QUERIES["folded_edits_stream"](spark, d).collect()}
    assert got == want


def plain_standing(log, depth):
    """Lists that are cut to the depth after each edit, at the start of a batch."""
    undo, redo, settled = [], [], []
    for seq, op, batch in log:
        if op in ("undo", "undo_batch", "redo", "redo_batch"):
            a, b = (undo, redo) if op.startswith("undo") else (redo, undo)
            if a:
                first = a[-1][1]
                b.append(a.pop())
                while op.endswith("batch") and first is not None and a and a[-1][1] == first:
                    b.append(a.pop())
        else:
            undo.append((seq, batch))
            redo = []
            drop = len(undo) - depth
            while drop > 0 and undo[drop][1] is not None and undo[drop - 1][1] == undo[drop][1]:
                drop -= 1
            if drop > 0:
                settled += undo[:drop]
                undo = undo[drop:]
    return {(s, True) for s, _ in settled} | {(s, False) for s, _ in undo}


def test_undo_of_batches_with_a_capped_history(spark):
    import random

    rng = random.Random(4)
    rows, want = [], set()
    for m in range(12):
        log, batch = [], None
        for seq in range(400):
            batch = rng.choice([batch, batch, batch, None, f"b{seq}"])
            op = rng.choices(["invert", "undo", "undo_batch", "redo", "redo_batch"], [12, 2, 1, 2, 1])[0]
            log.append((seq, op, batch if op == "invert" else None))
        rows += [(m, *r) for r in log]
        want |= {(m, *x) for x in plain_standing(log, 10)}
    df = spark.createDataFrame(rows, "map_id long, seq long, op string, batch string").repartition(3)
    assert {tuple(r) for r in history.standing(df, 10).collect()} == want
    whole = {tuple(r) for r in history.standing(df).collect()}
    assert not any(settled for _, _, settled in whole)
    assert history.standing(df.where("false")).count() == 0


def test_nothing_is_dropped_in_an_atomic_action(spark):
    rows = [(0, "begin", None), (1, "begin", None)] + [(k, "invert", None) for k in range(2, 8)] + [(8, "end", None), (9, "undo", None), (10, "end", None), (11, "invert", None)]
    df = spark.createDataFrame([(1, *r) for r in rows], "map_id long, seq long, op string, batch string")
    got = {(r["seq"], r["settled"]) for r in history.standing(df, 2).collect()}
    assert got == {(2, True), (3, True), (4, True), (5, True), (6, False), (11, False)}


def test_a_failure_ends_its_own_script(spark):
    initial = spark.createDataFrame([(m, k, f"s{k}", 100, False, None) for m in (1, 2) for k in range(2)], "map_id long, order_index int, segment string, length long, inverted boolean, scaffold string")
    lines = [(1, 1, "invert", "#0", ""), (1, 2, "cut", "#9", "5"), (1, 3, "invert", "#1", ""), (2, 1, "invert", "#0", ""), (2, 2, "assert", "contigs", "> 5"), (2, 3, "invert", "#1", "")]
    commands = spark.createDataFrame(lines, "map_id long, line long, command string, a string, b string")
    got = scripts.execute(initial, commands)
    assert sorted((r["map_id"], r["line"], r["success"]) for r in scripts.results(got).collect()) == [(1, 1, True), (1, 2, False), (2, 1, True), (2, 2, False)]
    assert sorted((r["map_id"], r["order_index"], r["inverted"]) for r in scripts.final(got).collect()) == [(1, 0, True), (1, 1, False), (2, 0, True), (2, 1, False)]
    all_run = scripts.execute(initial, commands, continue_on_error=True)
    assert scripts.results(all_run).count() == 6 and scripts.final(all_run).where("inverted").count() == 4


@pytest.mark.parametrize("keep", [1000, 12])
def test_late_edits_of_a_stream_take_their_place(spark, tmp_path, keep):
    """Any order of small batches gives the plain fold; what comes later than the reach is counted."""
    from weftmap.streaming import logs

    rng = random.Random(keep)
    log = [(m, seq, rng.choice(["cut", "join", "invert", "move", "paint"]), rng.randrange(9), rng.randrange(900), rng.choice([None, "x"])) for m in range(3) for seq in range(40)]
    near = sorted(log, key=lambda r: (r[1] + (rng.randrange(4) if keep < 1000 else rng.randrange(40)), r[0]))  # late by a little, or by any number
    for k in range(8):
        rows = near[15 * k : 15 * k + 15] + (near[:3] if k == 2 and keep == 1000 else [])  # some are repeated
        spark.createDataFrame(rows, LOG).coalesce(1).write.parquet(str(tmp_path / "in" / f"b={k}"))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    kept = []
    query = logs.folded_stream(stream, 5, keep).writeStream.outputMode("update").foreachBatch(lambda df, _: kept.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    last = {}
    for r in kept:
        if r["edits"] >= last.get(r["map_id"], r)["edits"]:
            last[r["map_id"]] = r
    for m in range(3):
        state = [[f"s{k}", 1000, False, None] for k in range(5)]
        for _, _, op, a, b, text in sorted((x for x in log if x[0] == m), key=lambda x: x[1]):
            history.apply_operation(state, op, a, b, text)
        assert last[m]["segment_order"] == ",".join(s[0] for s in state) and last[m]["n_inverted"] == sum(s[2] for s in state)
        assert last[m]["edits"] == 40 and last[m]["late"] == 0 and last[m]["seq"] == 39


def test_waypoints_at_one_place_go_by_id(spark):
    places = {100.0: (3, 10, 17), 300.0: (5, 12, 19), 500.0: (4, 11, 18)}
    rows = [(k, x, 0.0) for x, ids in places.items() for k in ids] + [(0, None, 0.0)]
    for given in (rows, rows[::-1]):
        df = spark.createDataFrame(given, "id long, x double, y double").coalesce(1)
        found = [tuple(select.next_waypoint(df, at).first()) for at in (100.0, 10.0, 400.0)]
        assert found == [(5, 3), (3, 4), (3, 4)]
