"""Operators on formula fixtures, against plain NumPy, and in their degenerate cases."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftmap.operators import balance, bands, blocks, links, metrics, spectra, windows
from weftmap.sinks import text as sink
from weftmap.sources import synthetic, tiles
from weftmap.sources import text as source

N = 24


def frame(spark, m):
    i, j = np.nonzero(np.triu(m))
    return spark.createDataFrame([(int(a), int(b), float(m[a, b])) for a, b in zip(i, j)], "i int, j int, v double")


def column(df, name, key="p"):
    return {r[key]: r[name] for r in df.collect()}


@pytest.fixture(scope="module")
def decay():
    d = np.abs(np.subtract.outer(np.arange(N), np.arange(N)))
    return 1.0 / (d + 1)


@pytest.fixture(scope="module")
def board():
    b = np.arange(N) // 4 % 2
    return np.where(np.equal.outer(b, b), 1.0, 0.1)


def ranges(spark, *ends, scaffold=None):
    rows = [(k, f"c{k}", (b - a) * 100, scaffold, a, b) for k, (a, b) in enumerate(zip((0, *ends[:-1]), ends))]
    return spark.createDataFrame(rows, "order_index int, name string, length long, scaffold_id int, start_bin int, end_bin int")


def test_expected_counts_absent_cells(spark):
    m = np.zeros((6, 6))
    m[0, 2] = 3.0
    e = column(bands.expected_by_distance(frame(spark, m), 6), "expected", "d")
    assert e[2] == pytest.approx(3 / 4) and e[0] == 0 and len(e) == 6


def test_ratio_of_a_uniform_map_is_one(spark):
    o = bands.observed_over_expected(frame(spark, np.full((N, N), 0.7)), N).collect()
    assert all(r["oe"] == pytest.approx(1) for r in o)


def test_power_law_is_recovered(spark):
    d = np.abs(np.subtract.outer(np.arange(40), np.arange(40)))
    m = np.where(d > 0, np.maximum(d, 1) ** -1.2, 1.0)
    fit = bands.decay_fit(bands.intra_profile(frame(spark, m), ranges(spark, 40), 20)).first()
    assert fit["slope"] == pytest.approx(-1.2) and fit["r2"] == pytest.approx(1)


def test_insulation_of_blocks(spark):
    b = np.arange(N) // 8
    m = np.where(np.equal.outer(b, b), 0.8, 0.05)
    s = windows.normalised_insulation(windows.insulation(frame(spark, m), N, 4))
    want = {p: m[max(0, p - 4) : p, p : p + 4].mean() if p else 0.0 for p in range(N)}
    assert column(s, "score") == pytest.approx(want)
    assert {r["p"] for r in windows.boundaries(s, window=4).collect()} == {8, 16}


@pytest.mark.parametrize("value", [0.0, 1.0])
def test_flat_maps_show_nothing(spark, value):
    m = frame(spark, np.full((N, N), value))
    assert windows.boundaries(windows.normalised_insulation(windows.insulation(m, N, 4)), window=4).count() == 0
    assert all(r["di"] in (None, 0.0) for r in windows.directionality(m, N, 4).collect())
    assert {r["norm"] for r in spectra.compartments(m, N).collect()} == {0.5}
    assert blocks.translocations(m, ranges(spark, 8, 16, 24)).count() == 0


def test_coarse_means(spark):
    m = np.arange(16, dtype=float).reshape(4, 4) + 1
    m = (m + m.T) / 2
    got = {(r["i"], r["j"]): r["v"] for r in blocks.coarsen(frame(spark, m), 4, 2).collect()}
    assert got == pytest.approx({(0, 0): m[:2, :2].mean(), (0, 1): m[:2, 2:].mean(), (1, 1): m[2:, 2:].mean()})


def test_balancing(spark, decay):
    b = column(balance.balance(frame(spark, decay), N, 60, 1e-6, mask=False), "bias")
    x = np.array([b[k] for k in range(N)])
    assert np.abs((decay / np.outer(x, x)).sum(axis=1) - 1).max() < 1e-5
    assert balance.masked_bins(frame(spark, np.ones((N, N))), N).count() == N


def test_correlation_and_compartments(spark, board):
    noisy = board + 0.01 * np.random.default_rng(1).random((N, N))
    noisy = (noisy + noisy.T) / 2
    got = {(r["i"], r["j"]): r["v"] for r in spectra.row_correlation(frame(spark, noisy), N).collect()}
    want = np.corrcoef(noisy)
    assert all(v == pytest.approx(want[k]) for k, v in got.items())
    e1 = column(spectra.compartments(frame(spark, noisy), N), "e1")
    signs = [e1[4 * k] > 0 for k in range(6)]
    assert signs == [True, False] * 3 and all((e1[p] > 0) == signs[p // 4] for p in range(N))


def test_chains_take_links_in_order(spark):
    rnd = np.random.default_rng(2)
    n, rows = 14, []
    for a in range(n):
        for b in range(a + 1, n):
            rows.append((a, b, links.ORIENTATIONS[rnd.integers(4)], float(round(rnd.random(), 6))))
    seg = spark.range(n).select(F.col("id").cast("int").alias("order_index"))
    got = {r["order_index"]: (r["chain"], r["pos"], r["inverted"]) for r in links.chains(spark.createDataFrame(rows, "a int, b int, orientation string, score double"), seg, 0.3).collect()}
    chain = {k: [(k, False)] for k in range(n)}
    of = {k: k for k in range(n)}
    turn = lambda c: [(k, not v) for k, v in reversed(c)]
    for a, b, o, s in sorted(rows, key=lambda x: (-x[3], x[0], x[1])):
        if s < 0.3 or of[a] == of[b]:
            continue
        x, y = chain[of[a]], chain[of[b]]
        if a not in (x[0][0], x[-1][0]) or b not in (y[0][0], y[-1][0]):
            continue
        x = [(a, o in ("TH", "TT"))] if len(x) == 1 else turn(x) if x[0][0] == a else x
        y = [(b, o in ("HT", "TT"))] if len(y) == 1 else turn(y) if y[-1][0] == b else y
        keep, gone = of[a], of[b]
        chain[keep] = x + y
        del chain[gone]
        of.update({k: keep for k, _ in x + y})
    assert got == {k: (c, p, v) for c, items in chain.items() for p, (k, v) in enumerate(items)}


def test_known_metrics(spark):
    seg = spark.createDataFrame([(k, v, None) for k, v in enumerate([10, 8, 6, 4, 2])], "order_index int, length long, scaffold_id int")
    m = metrics.assembly_metrics(seg).first()
    assert (m["n50"], m["l50"], m["n90"], m["l90"]) == (8, 2, 4, 4) and m["aun"] == pytest.approx(220 / 30)
    none = metrics.assembly_metrics(seg.limit(0)).first()
    assert none["count"] == 0 and none["n50"] == 0 and none["aun"] == 0
    r = lambda *t: spark.createDataFrame(list(enumerate(t)), "pos int, truth int")
    assert metrics.kendall_tau(r(0, 1, 2, 3)).first()["tau"] == 1 and metrics.kendall_tau(r(3, 2, 1, 0)).first()["tau"] == -1
    perm = np.random.default_rng(0).permutation(700).tolist()
    want = sum(np.sign(perm[j] - perm[i]) for i in range(700) for j in range(i + 1, 700)) / (700 * 699 / 2)
    assert metrics.kendall_tau(r(*perm)).first()["tau"] == pytest.approx(want)
    assert metrics.adjusted_rand(spark.createDataFrame([(1, 1), (1, 1), (2, 2)], "pred int, truth int")).first()["ari"] == 1


def test_squares_of_long_scaffolds(spark):
    lengths = [4 * 10**9 + 1, 3 * 10**9 + 7, 10]  # squares beyond a long
    seg = spark.createDataFrame([(k, v, k % 2) for k, v in enumerate(lengths)], "order_index int, length long, scaffold_id int")
    m = metrics.assembly_metrics(seg).first()
    exact = lambda *v: pytest.approx(sum(x * x for x in v) / sum(v), rel=1e-15)
    assert m["aun"] == exact(*lengths) and m["scaffold_aun"] == exact(lengths[0] + 10, lengths[1])
    huge = metrics.assembly_metrics(spark.createDataFrame([(0, 9 * 10**18, None)], "order_index int, length long, scaffold_id int")).first()
    assert huge["aun"] == huge["scaffold_aun"] == 9e18


def test_layout_round_trip(spark):
    seg = spark.createDataFrame([(0, "a", 100, 1, False), (1, "b", 50, 1, True), (2, "c", 70, None, False)], "order_index int, name string, length long, scaffold_id int, inverted boolean")
    lines = sink.layout_lines(seg)
    assert [r["body"] for r in lines.orderBy("k").collect()][1] == "scaffold_1\t101\t300\t2\tN\t200\tscaffold\tyes\tproximity_ligation"
    back = source.layout(lines.select(F.lit("f").alias("file"), F.col("k").alias("line"), "body")).orderBy("line").collect()
    assert [(r["name"], r["inverted"], r["unplaced"]) for r in back] == [("a", False, False), ("b", True, False), ("c", False, True)]


def test_sequence_files(spark, tmp_path):
    (tmp_path / "x.fa").write_text("lost\n>one first record\nACGT\n;comment\nAC GT\n\n>two\r\nGG\n")
    got = source.fasta(source.lines(spark, str(tmp_path / "x.fa"))).orderBy("record").collect()
    assert [(r["name"], r["description"], r["sequence"]) for r in got] == [("one", "first record", "ACGTACGT"), ("two", "", "GG")]
    seg = spark.createDataFrame([(0, "one", True), (1, "none", False)], "order_index int, name string, inverted boolean")
    out = [r["body"] for r in sink.fasta_lines(seg, source.fasta(source.lines(spark, str(tmp_path / "x.fa")))).orderBy("k").collect()]
    assert out == [">one orientation=-\nACGTACGT", ">none orientation=+ WARNING:sequence_not_found"]


def test_session_and_log_documents(spark):
    doc = '{"version": 1, "filename": "f", "contigOrder": [1, 0], "scaffolds": []}'
    bad = '{"version": 1, "filename": "f", "contigOrder": [1, 1]}'
    docs = spark.createDataFrame([("a", doc), ("b", bad), ("c", "not json")], "file string, value string")
    assert [r["file"] for r in source.sessions(docs).collect()] == ["a"]
    log = spark.createDataFrame([(2, 1700000000000, "cut", "x"), (1, 1600000000000, "join", "y")], "seq int, at long, op string, description string")
    back = source.edit_logs(sink.edit_log_json(log, "m").withColumn("file", F.lit("l"))).orderBy("seq").collect()
    assert [(r["seq"], r["op"]) for r in back] == [(1, "join"), (2, "cut")]


def deflate(b):
    c = zlib.compressobj(wbits=-15)
    return c.compress(b) + c.flush()


def packed_map(cells, side, levels, names, tracks, broken=()):
    """A map of tiles with mip levels (every second cell of the finer one) of two values, its tracks after the tiles."""
    tiles_across = len(cells) // side
    head = struct.pack("<QI", 1000, len(names)) + b"".join(struct.pack("<f", 1 / len(names)) + n.encode().ljust(64, b"\0") for n in names) + bytes([side.bit_length() - 1, tiles_across.bit_length() - 1, levels])
    h = deflate(head)
    out = tiles.MAGIC + struct.pack("<II", len(h), len(head)) + h
    for x in range(tiles_across):
        for y in range(x, tiles_across):
            body = b""
            for level in range(levels):
                own = cells[x * side : (x + 1) * side : 1 << level, y * side : (y + 1) * side : 1 << level]
                for bx in range(len(own) // 4):
                    for by in range(len(own) // 4):
                        block = own[4 * by : 4 * by + 4, 4 * bx : 4 * bx + 4]
                        hi, lo = int(block.max()), int(block.min())
                        bits = sum((0 if block[dy, dx] == hi else 1) << (3 * (4 * dx + dy)) for dx in range(4) for dy in range(4))
                        body += bytes([hi, lo]) + bits.to_bytes(6, "little")
            t = b"\xff\xff not deflate" if (x, y, "broken") in broken else deflate(body[:-4] if (x, y, "short") in broken else body)
            out += struct.pack("<I", len(t)) + t
    for name, values in tracks:
        t = deflate(name.encode().ljust(64, b"\0") + np.array(values, "<i4").tobytes())
        out += b"pad psg" + b"psgh" + struct.pack("<I", len(t)) + t
    return out


def test_tiled_maps(spark, tmp_path):
    n, side = 64, 16
    cells = np.where(np.add.outer(np.arange(n), 3 * np.arange(n)) % 5 == 0, 255, 51)
    cells = np.triu(cells) + np.triu(cells, 1).T
    path = str(tmp_path / "m.map")
    broken = [(0, 2, "broken"), (1, 3, "short")]
    (tmp_path / "m.map").write_bytes(packed_map(cells, side, 3, ["a", "b"], [("cov", range(n)), ("short", range(3)), ("telo", [k % 2 for k in range(n)])], broken))
    found = tiles.index(spark, path)
    assert found.count() == 10
    assert {(r["tx"], r["ty"]): r["status"] for r in tiles.tile_states(found).collect() if r["status"] != "ok"} == {(0, 2): "broken", (1, 3): "short"}
    assert tiles.tile_states(found, 0).where("status = 'ok'").count() == 9  # the finest level of the short tile is whole
    spark.dataSource.register(tiles.ContactTiles)
    for level in (0, 1, None):
        k = 2 if level is None else level
        own, s = cells[:: 1 << k, :: 1 << k], side >> k
        lost = {(0, 2)} | ({(1, 3)} if k == 2 else set())
        want = {(i, j): own[i, j] / 255 for i in range(len(own)) for j in range(i, len(own)) if (i // s, j // s) not in lost}
        assert {(r["i"], r["j"]): r["v"] for r in tiles.cells(found, level).collect()} == pytest.approx(want)
        reader = spark.read.format("contact_tiles").option("path", path).option("tilesPerTask", 3)
        loaded = (reader if level is None else reader.option("level", level)).load()
        assert {(r["i"], r["j"]): r["v"] for r in loaded.collect()} == pytest.approx(want)
    assert tiles.cells(found.where("tx = 3"), 0).count() == side * (side + 1) // 2  # other tiles aren't read
    asked = spark.createDataFrame([(3, 1), (1, 2), (2, 2)], "tx int, ty int")
    got = {(r["tx"], r["ty"], r["row"], r["col"]): r["v"] for r in tiles.texels(found, asked, 0).collect()}
    assert got == pytest.approx({(x, y, a, b): cells[x * side + a, y * side + b] / 255 for x, y in ((3, 1), (1, 2), (2, 2)) for a in range(side) for b in range(side)})
    assert [r["name"] for r in tiles.segments(spark, path).orderBy("order_index").collect()] == ["a", "b"]
    tracks = tiles.extension_tracks(spark, path).orderBy("name", "pos").collect()
    assert [(r["name"], r["value"]) for r in tracks] == [("cov", k) for k in range(n)] + [("telo", k % 2) for k in range(n)]


def test_the_faithful_level_is_the_finest_that_fits(spark):
    assert [tiles.faithful_level(t, 1024, 6) for t in (1, 2, 4, 32, 64, 128)] == [0, 0, 1, 4, 5, 5]
    df = spark.createDataFrame([(t, 1024, 6) for t in (1, 2, 4, 32, 64, 128)], "tiles int, side int, levels int")
    assert [r[0] for r in df.select(tiles._level_of("faithful")).collect()] == [0, 0, 1, 4, 5, 5]


def test_a_cut_off_map_keeps_its_whole_tiles(spark, tmp_path):
    cells = np.full((32, 32), 255)
    whole = packed_map(cells, 16, 1, ["a"], [])
    (tmp_path / "cut.map").write_bytes(whole[:-5])
    found = tiles.index(spark, str(tmp_path / "cut.map"))
    states = [r["status"] for r in tiles.tile_states(found).orderBy("tx", "ty").collect()]
    assert states[0] == "ok" and states[-1] == "cut" and tiles.extension_tracks(spark, str(tmp_path / "cut.map")).count() == 0


def test_synthetic_maps_repeat(spark):
    a, b = (synthetic.contact_map(spark, 32, 4).orderBy("i", "j").collect() for _ in range(2))
    assert a == b and len(a) == 32 * 33 // 2 and all(0 < r["v"] <= 1 for r in a)
    assert synthetic.misassembled(synthetic.contact_map(spark, 40, 4), 40).count() == 1600
    t = synthetic.smooth_track(spark, 50, 1, 3).agg(F.min("value"), F.max("value")).first()
    assert tuple(t) == (0.0, 1.0) and synthetic.marker_track(spark, 50, 1, 0.2).count() == 50


def test_rounds_go_on_until_nothing_is_left(spark):
    from weftmap.operators import links, metrics

    n = 42
    found = spark.createDataFrame([(0, 2 * k) for k in range(n)], "grp int, p int")
    truth = spark.createDataFrame([(0, 2 * k + 1) for k in range(n)], "grp int, q int")
    assert {tuple(r) for r in metrics.breakpoint_matches(found, truth, 1).collect()} == {(0, 2 * k, 2 * k + 1) for k in range(n)}
    falling = spark.createDataFrame([(0, 1, "HH", 0.9), (1, 2, "HH", 0.8)], "a int, b int, orientation string, score double")
    with pytest.raises(RuntimeError):
        links.chains(falling, spark.createDataFrame([(k,) for k in range(3)], "order_index int"), 0.3, max_rounds=1).count()


def test_row_products_equal_numpy(spark):
    rnd, n = np.random.default_rng(0), 30
    m = np.triu(rnd.random((n, n)) * (rnd.random((n, n)) < 0.5))
    m = m + np.triu(m, 1).T
    cells = spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))], "i int, j int, v double")
    g = m @ m.T
    for columns in (8192, 11):
        got = {(r["i"], r["j"]): r["xy"] for r in spectra.row_products(cells, n, 7, columns).collect()}
        assert got == {(i, j): pytest.approx(g[i, j]) for i in range(n) for j in range(i + 1, n) if g[i, j]}


def test_compartments_equal_the_leading_eigenvector(spark):
    """The derived map of the given tables, by NumPy."""
    from weftmap.contract import inputs

    n, size = inputs.NB, 4
    cm = inputs.contact(spark, "/root/testdata/sf0.001")
    full = np.zeros((n, n))
    for r in cm.collect():
        full[r["i"], r["j"]] = full[r["j"], r["i"]] = r["v"]
    m = n // size
    coarse = full.reshape(m, size, m, size).mean(axis=(1, 3))
    d = np.abs(np.subtract.outer(np.arange(m), np.arange(m)))
    expected = np.array([coarse[d == k].mean() for k in range(m)])
    oe = np.where(expected[d] > 0, coarse / np.where(expected[d] > 0, expected[d], 1), 0)
    cor = np.corrcoef(oe)
    values, vectors = np.linalg.eigh(cor)
    k = np.argmax(np.abs(values))
    want = vectors[:, k] * np.sign(vectors[np.flatnonzero(np.abs(vectors[:, k]) > 1e-9)[0], k])
    got = spectra.compartments(cm, n, rounds=2000).orderBy("p").collect()
    assert [r["e1"] for r in got[::size]] == pytest.approx(want.tolist(), abs=2e-3)
    assert got[0]["eigenvalue"] == pytest.approx(abs(values[k]), rel=1e-3)


def test_narrow_segments_are_put_together(spark):
    """Against one pass from left to right."""
    import random

    from weftmap.operators import cuts

    rng = random.Random(9)
    for n in (0, 1, 7, 60, 150):
        widths = [rng.choice([0, 0, 1, 1, 2, 2, 3, 5, 9]) if k < 100 else 1 for k in range(n)]
        at, rows = 0, []
        for k, w in enumerate(widths):
            rows.append((k, at, at + w))
            at += w
        want, now = [], None
        for k, s, e in rows:
            if e - s >= 3:
                want += ([now] if now else []) + [(k, s, e)]
                now = None
            else:
                now = (now[0], now[1], e) if now else (k, s, e)
                if now[2] - now[1] >= 3:
                    want.append(now)
                    now = None
        if now and now[2] - now[1] >= 3:
            want.append(now)
        df = spark.createDataFrame(rows, "order_index int, start_bin int, end_bin int")
        got = cuts.merged_ranges(df)
        assert [tuple(r) for r in got.orderBy("range").select("first", "start_bin", "end_bin").collect()] == want
        if n == 60:
            marks = spark.createDataFrame([(0,), (20,), (41,)], "order_index int")
            assert [r["chromosome"] for r in cuts.chromosome_assignments(df, marks).orderBy("order_index").collect()] == [0] * 20 + [1] * 21 + [2] * 19


def test_scaffolds_are_ordered_on_their_own(spark):
    """All groups at once give what each gives alone, and only their own places are filled."""
    from weftmap.contract import inputs
    from weftmap.operators import links
    from weftmap.plans import curate

    sf = "/root/testdata/sf0.001"
    cm, ranges = inputs.contact(spark, sf), inputs.ranges(spark, sf)
    got = {r["new_index"]: (r["order_index"], r["inverted"]) for r in curate.scaffold_order(cm, ranges, inputs.NB, "scaffold_id").collect()}
    members = {}
    for r in ranges.collect():
        members.setdefault(r["scaffold_id"], []).append(r["order_index"])
    assert sorted(got) == sorted(k for m in members.values() for k in m) and len(members) > 2
    for group in (1, None):
        own = ranges.where(F.col("scaffold_id").eqNullSafe(F.lit(group)))
        alone = curate.automatic_order(cm, own, own.select("order_index"), inputs.NB, least_segments=0).orderBy("new_index").collect()
        assert [got[k] for k in sorted(members[group])] == [(r["order_index"], r["inverted"]) for r in alone]
    pair = ranges.where("order_index < 2").withColumn("g", F.lit(1))
    assert [tuple(r) for r in links.order_within(cm, pair, inputs.NB, "g").orderBy("new_index").collect()] == [(0, 0, False), (1, 1, False)]


def test_few_segments_keep_their_order(spark):
    from weftmap.contract import inputs
    from weftmap.plans import curate

    cm, ranges = inputs.contact(spark, "/root/testdata/sf0.001"), inputs.ranges(spark, "/root/testdata/sf0.001")
    kept = curate.automatic_order(cm, ranges, ranges.select("order_index"), inputs.NB)
    assert kept.where("new_index <> order_index or inverted").count() == 0 and kept.count() == ranges.count()


def test_motif_windows_cover_several_segments(spark):
    from weftmap.functions import sequences

    texts = ["TTAGGG" * 3, None, "ccctaa" + "N" * 5, "", "ACGT" * 10, "TTAGGGTTAGGG"]
    lengths = [18, 9, 11, 0, 40, 6]
    df = spark.createDataFrame([(k, n, t) for k, (n, t) in enumerate(zip(lengths, texts))], "order_index int, length long, s string")
    got = [r["density"] for r in sequences.motif_windows(df, "s", "TTAGGG", 12).orderBy("window").collect()]
    total, want = sum(lengths), []
    for w in range(-(-total // 12)):
        lo, hi, at, letters = w * 12, min(total, w * 12 + 12), 0, 0
        for t, n in zip(texts, lengths):
            part = (t or "")[:n].upper()[max(0, lo - at) : max(0, hi - at)]
            letters += 6 * (part.count("TTAGGG") + part.count("CCCTAA"))
            at += n
        want.append(min(1.0, letters / (hi - lo)))
    assert got == pytest.approx(want) and max(want) == 1.0
    assert sequences.motif_windows(df.where("false"), "s", "TTAGGG").count() == 0


def test_quality_lines_and_catalogues(spark):
    from weftmap.operators import blocks

    ranges = spark.createDataFrame([(0, "a", 0, 2, 1), (1, "b", 2, 4, 1), (2, "c", 4, 6, 2)], "order_index int, name string, start_bin int, end_bin int, scaffold_id int")
    cm = spark.createDataFrame([(0, 1, 6.0), (0, 2, 2.0), (1, 4, 4.0), (3, 3, 9.0)], "i int, j int, v double")
    got = [r["body"] for r in sink.quality_lines(blocks.library_quality(cm, ranges), blocks.segment_quality(cm, ranges), ranges).orderBy("k").collect()]
    assert got == ["# Hi-C library quality metrics", "# Cis/trans ratio: 2.0000", "# Cis percentage: 66.67%", "# Long/short ratio: 0.0000", "# Mean occupied contact: 4.000000", "# Flagged contigs: 1", "contig\tcis_ratio", "a\t0.6667", "b\t1.0000", "c\t0.0000"]
    doc = '{"version": "1", "specimens": [{"id": "x", "difficulty": "beginner", "releaseAsset": null, "patterns": ["inversions"]}, {"id": "y", "difficulty": "beginner", "releaseAsset": "y.map"}, {"id": "z", "difficulty": "advanced", "releaseAsset": "z.map"}]}'
    entries = source.catalogue(spark.createDataFrame([("f", doc), ("g", "no document"), ("h", '{"specimens": []}')], "file string, value string"))
    assert [r["id"] for r in entries.orderBy("place").collect()] == ["x", "y", "z"]
    assert [r["id"] for r in source.catalogue_entries(entries, "beginner", True).collect()] == ["y"]


def test_a_sweep_equals_one_run_a_setting(spark):
    from weftmap.contract import inputs
    from weftmap.operators import links, metrics
    from weftmap.plans import sweep

    sf = "/root/testdata/sf0.001"
    cm, ranges = inputs.contact(spark, sf), inputs.ranges(spark, sf)
    settings = [sweep.Setting(30, 0.05, 0.2), sweep.Setting(50, 0.1, 0.3), sweep.Setting(50, 0.6, 0.9), sweep.Setting(50, 2.0, 0.2)]
    found = sweep.orders(cm, ranges, inputs.NB, settings)
    got = {}
    for r in found.orderBy("setting", "new_index").collect():
        got.setdefault(r["setting"], []).append((r["order_index"], r["inverted"]))
    for k, s in enumerate(settings):
        best = links.best_links(links.link_scores(cm, ranges, inputs.NB, s.max_distance), s.cutoff)
        threshold = links.adaptive_threshold(best, cap=s.hard)
        alone = links.ordered_segments(links.merged_chains(links.chains(best, ranges.select("order_index"), threshold), best, threshold))
        assert got[k] == [(r["order_index"], r["inverted"]) for r in alone.orderBy("new_index").collect()]
    truth = ranges.select("order_index", F.col("order_index").alias("place"), F.lit(1).alias("chromosome"), F.lit(False).alias("inverted"))
    scored = {r["setting"]: r for r in sweep.scores(found, truth).collect()}
    n = ranges.count()
    assert scored[3]["chains"] == n and scored[3]["tau"] == 1 and scored[3]["orientation"] == 1  # no link: the order stays
    one = found.where("setting = 0").select(F.col("new_index").alias("pos"), F.col("order_index").cast("long").alias("truth"))
    assert scored[0]["tau"] == pytest.approx(metrics.kendall_tau(one).first()["tau"])
