"""Every registered query against its SQL, as the driver does, on the smallest tables."""

import math
from decimal import Decimal

import duckdb
import pytest

from weftmap.contract.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or not isinstance(v, (int, float, Decimal)):
        return str(v)
    return round(float(v), 6) + 0.0


def near(a, b):
    """Equal but for one unit of the last rounded place, or of a double's last digits."""
    if a == b:
        return True
    return isinstance(a, float) and isinstance(b, float) and abs(a - b) <= max(1.1e-5 if abs(a) < 100 else 0, 2e-6 * abs(a))


def paired(got, want):
    """Rows side by side: by their exact columns first, so that last places of sums pair no wrong rows."""
    exact = [k for k in range(len(got[0]) if got else 0) if all(not isinstance(row[k], float) or row[k] == int(row[k]) for row in (*got, *want))]
    key = lambda row: ([(row[k] is not None, str(row[k])) for k in exact], [(v is not None, v if isinstance(v, float) else 0.0) for v in row])
    return zip(sorted(got, key=key), sorted(want, key=key))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    want = [tuple(map(plain, r)) for r in duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({ORACLES[name]})").fetchall()]
    assert len(got) == len(want)
    assert all(near(x, y) for g, w in paired(got, want) for x, y in zip(g, w))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, DIR)
    assert len(df.collect()) > 0 and df.columns
