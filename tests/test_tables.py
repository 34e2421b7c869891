"""Written tables where the session names a shared folder and where it does not."""

import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from weftmap.functions.tables import dropped, numbered, shared_dir, written

ALONE = """
from pyspark.sql import SparkSession
from weftmap.functions.tables import dropped, numbered, shared_dir, written
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert s.conf.get("spark.checkpoint.dir", None) is None
a, b = written(s.range(10)), written(s.range(5))
assert a.count() == 10 and b.count() == 5 and shared_dir(s) == shared_dir(s)
dropped(a, b)
print("fine")
"""


def test_a_session_without_the_setting_gets_a_folder_of_its_own(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.pathsep.join(sys.path)}
    got = subprocess.run([sys.executable, "-c", ALONE], env=env, capture_output=True, text=True, timeout=120)
    assert got.stdout.strip().endswith("fine"), got.stderr[-2000:]


def test_a_cluster_without_the_setting_is_an_error():
    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(unset)


def test_dropped_tables_are_gone(spark):
    t = written(spark.range(3))
    folder = t.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:")
    assert os.path.isdir(folder)
    dropped(t)
    assert not os.path.exists(folder)


def test_rows_are_numbered_over_ranges(spark):
    from pyspark.sql import functions as F

    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x"), (F.col("id") % 10).alias("y"))
    got = numbered(df.repartition(7), F.col("y").desc(), "x", start=0).collect()
    want = sorted(((-r["y"], r["x"]) for r in df.collect()))
    assert [(-r["y"], r["x"]) for r in sorted(got, key=lambda r: r["k"])] == want and sorted(r["k"] for r in got) == list(range(1000))
    assert numbered(df.limit(0), "x").count() == 0


def test_ordered_lines_follow_each_other(spark, tmp_path):
    from weftmap.sinks.text import write_lines

    lines = spark.range(300).selectExpr("cast(300 - id as int) k", "concat('line ', 300 - id) body")
    write_lines(lines, str(tmp_path / "out"))
    parts = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part"))
    assert [x for p in parts for x in p.read_text().splitlines()] == [f"line {k}" for k in range(1, 301)]


def test_running_counts_by_ranges(spark):
    from collections import Counter

    from weftmap.functions.tables import running_counts

    values = [k * k % 97 for k in range(300)] + [None, None]
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(5)
    want = Counter(v for v in values if v is not None)
    for down in (False, True):
        order, upto = sorted(want, reverse=down), 0
        got = {r["v"]: (r["c"], r["upto"]) for r in running_counts(df, "v", down).collect()}
        for v in order:
            upto += want[v]
            assert got[v] == (want[v], upto)
    assert running_counts(df.where("false"), "v").count() == 0
