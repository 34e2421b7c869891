"""Enhancement by tiles against the whole map; floats as text."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftmap.operators import enhance


def whole(x, factor, denoise=True, amount=0.3):
    n = len(x)
    m = int(n * factor + 0.5)
    every = (0, m, 0, n)
    return enhance.enhanced_tile(x, n, m, every, every, denoise, amount)


@pytest.mark.parametrize("n,factor,tile", [(150, 2.0, 16), (100, 1.5, 30), (40, 3.0, 256), (90, 1.0, 20), (1, 2.0, 8)])
def test_tiles_equal_the_whole_map(spark, n, factor, tile):
    r = np.random.default_rng(n)
    x = np.triu(r.random((n, n)) * (r.random((n, n)) < 0.4))
    x = x + np.triu(x, 1).T
    cells = spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(np.triu(x)))] or [(0, 0, 0.0)], "i int, j int, v double")
    want = np.triu(whole(x, factor))
    got = np.zeros_like(want)
    for row in enhance.enhanced(cells, n, factor, tile=tile).collect():
        assert row["i"] <= row["j"] and got[row["i"], row["j"]] == 0
        got[row["i"], row["j"]] = row["v"]
    assert np.abs(got - want).max(initial=0) < 1e-9


def test_steps_have_their_known_values():
    x = np.random.default_rng(1).random((30, 3))
    nodes = enhance.spline_rows(np.arange(30.0), 30, 0, x)
    assert np.abs(nodes - x).max() < 1e-12  # a spline goes through its values
    line = np.arange(30.0)[:, None] * 2 + 1
    inner = np.linspace(12, 17, 40)
    assert np.abs(enhance.spline_rows(inner, 30, 0, line)[:, 0] - (2 * inner + 1)).max() < 1e-6
    assert np.abs(enhance.smoothed(np.ones((9, 2)), 0.8) - 1).max() < 1e-12
    step = enhance.smoothed(np.eye(9), 0.8)
    assert np.allclose(step.sum(axis=0), 1) and np.allclose(step[4], step[4][::-1])
    assert np.allclose(enhance.smoothed(np.arange(3.0)[:, None], 2.0).mean(), 1.0)  # wider than the map: mirrored again and again
    flat = whole(np.full((20, 20), 5.0), 2.0)
    assert flat.shape == (40, 40) and np.abs(flat - 5).max() < 1e-9


def test_a_whole_map_is_symmetric_and_not_negative():
    x = np.random.default_rng(2).random((25, 25))
    out = whole(x + x.T, 2.0)
    assert np.abs(out - out.T).max() < 1e-9 and out.min() >= 0


def test_floats_as_text(spark):
    df = spark.createDataFrame([(1, [1.5, -2.25, 3.0, 1e-3]), (2, []), (3, None)], "k int, v array<float>")
    out = df.select("k", "v", enhance.floats_to_text(F.col("v")).alias("t")).select("*", enhance.text_to_floats(F.col("t")).alias("back"), enhance.text_to_floats(F.col("t"), 2).alias("square"))
    rows = {r["k"]: r for r in out.collect()}
    assert rows[1]["t"] == "AADAPwAAEMAAAEBAbxKDOg==" and rows[1]["back"] == rows[1]["v"] and rows[1]["square"] == rows[1]["v"]
    assert rows[2]["t"] == "" and rows[2]["back"] == [] and rows[2]["square"] is None and rows[3]["t"] is None and rows[3]["back"] is None
    bad = spark.createDataFrame([("AAAA",)], "t string").select(enhance.text_to_floats(F.col("t")).alias("v")).first()
    assert bad["v"] is None
