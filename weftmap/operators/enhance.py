"""Enhanced maps by halo tiles: smooth, zoom with cubic splines, sharpen; and numbers as base64 text.

A tile of the new map is worked out from a window of the old one: its own bins and a margin on
each side.  All steps are linear filters along an axis whose weights fall off fast (a smoothing
kernel ends after four deviations, a spline's weights shrink by 3.7 a bin), so a margin of
``MARGIN`` bins makes a tile equal to the same part of the whole map.  Windows mirror at the map's
edges.  A task holds a tile and its margin; only tiles on or above the diagonal are made.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TILE, MARGIN = 256, 32
SMOOTH, SHARP, AMOUNT = 0.8, 1.0, 0.3


def smoothed(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian means along the first axis, to four deviations, mirrored with the edge row twice."""
    reach = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    n = len(x)
    at = np.arange(-reach, n + reach) % (2 * n)
    padded = x[np.where(at < n, at, 2 * n - 1 - at)]
    return sum(w[k] * padded[k : k + n] for k in range(len(w))) / w.sum()


def spline_rows(at: np.ndarray, n: int, first: int, x: np.ndarray) -> np.ndarray:
    """Values at places ``at`` of the cubic spline through the rows ``x``, which stand at first, first + 1, ...; mirrored at 0 and n - 1."""
    k = len(x)
    if n == 1:
        return np.repeat(x, len(at), axis=0)
    t = np.diag(np.full(k, 4.0)) + np.diag(np.ones(k - 1), 1) + np.diag(np.ones(k - 1), -1)
    if k > 1:  # mirrored at the ends; inside the map the error of that dies away in the margin
        t[0, 1] = t[-1, -2] = 2.0
    c = np.linalg.solve(t / 6, x)
    low = np.floor(at).astype(int)
    f = at - low
    weights = ((1 - f) ** 3 / 6, (4 - 6 * f**2 + 3 * f**3) / 6, (1 + 3 * f + 3 * f**2 - 3 * f**3) / 6, f**3 / 6)
    out = 0
    for d, w in zip((-1, 0, 1, 2), weights):
        j = np.abs(low + d)
        j = np.where(j > n - 1, 2 * (n - 1) - j, j)
        out = out + w[:, None] * c[np.clip(j - first, 0, k - 1)]
    return out


def window(a: int, n: int, m: int, tile: int) -> tuple[int, int, int, int]:
    """Rows [u0, u1) of the new map in tile ``a``, and the rows [lo, hi) of the old one that they need."""
    size = -(-tile * m // n)
    u0, u1 = a * size, min(m, (a + 1) * size)
    step = (n - 1) / (m - 1) if m > 1 else 0.0
    reach = int(4 * SHARP + 0.5)
    return u0, u1, max(0, int((u0 - reach) * step) - MARGIN), min(n, int((u1 + reach) * step) + MARGIN + 2)


def _zoomed(x: np.ndarray, n: int, m: int, lo: int, u0: int, u1: int, denoise: bool) -> np.ndarray:
    """Rows of the new map from a little before u0 to a little after u1, along the first axis."""
    reach = int(4 * SHARP + 0.5)
    step = (n - 1) / (m - 1) if m > 1 else 0.0
    return spline_rows(np.arange(max(0, u0 - reach), min(m, u1 + reach)) * step, n, lo, smoothed(x, SMOOTH) if denoise else x)


def enhanced_tile(x: np.ndarray, n: int, m: int, rows: tuple[int, int, int, int], cols: tuple[int, int, int, int], denoise: bool = True, amount: float = AMOUNT) -> np.ndarray:
    """The tile of rows and columns (``window``) of the new map from the window ``x`` of the old one."""
    reach = int(4 * SHARP + 0.5)
    up = _zoomed(x, n, m, rows[2], rows[0], rows[1], denoise)
    up = _zoomed(up.T, n, m, cols[2], cols[0], cols[1], denoise).T
    blurred = smoothed(smoothed(up, SHARP).T, SHARP).T
    sharp = np.maximum(0.0, up + amount * (up - blurred))
    r, c = min(rows[0], reach), min(cols[0], reach)
    return sharp[r : r + rows[1] - rows[0], c : c + cols[1] - cols[0]]


def enhanced(contact: DataFrame, n: int, factor: float = 2.0, denoise: bool = True, amount: float = AMOUNT, tile: int = TILE) -> DataFrame:
    """(i, j, v), i <= j, v > 0, of the map zoomed to round(n * factor) bins: smoothed, splined, sharpened, cut off at 0."""
    m = max(1, int(n * factor + 0.5))
    size = -(-tile * m // n)
    tiles = -(-m // size)
    reach = MARGIN + int(4 * SHARP + 0.5) + 4
    near = lambda c: F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - reach) / tile).cast("int")), F.least(F.lit(tiles - 1), F.floor((F.col(c) + reach) / tile).cast("int"))))
    cells = contact.select(F.explode(F.array(F.struct("i", "j", "v"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "v"))).alias("c")).select("c.*")
    dealt = cells.withColumn("a", near("i")).withColumn("b", near("j")).where("a <= b")

    def run(table: pa.Table) -> pa.Table:
        a, b = table["a"][0].as_py(), table["b"][0].as_py()
        rows, cols = window(a, n, m, tile), window(b, n, m, tile)
        i, j, v = (table[c].to_numpy() for c in ("i", "j", "v"))
        inside = (i >= rows[2]) & (i < rows[3]) & (j >= cols[2]) & (j < cols[3])
        x = np.zeros((rows[3] - rows[2], cols[3] - cols[2]))
        x[i[inside] - rows[2], j[inside] - cols[2]] = v[inside]  # a cell of the diagonal comes twice, with one value
        out = enhanced_tile(x, n, m, rows, cols, denoise, amount)
        r, c = np.nonzero(out)
        up = r + rows[0] <= c + cols[0]
        r, c = r[up], c[up]
        return pa.table({"i": (r + rows[0]).astype(np.int32), "j": (c + cols[0]).astype(np.int32), "v": out[r, c]})

    return dealt.groupBy("a", "b").applyInArrow(run, "i int, j int, v double")


@F.pandas_udf(T.StringType())
def _encoded(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else base64.b64encode(np.asarray(x, "<f4").tobytes()).decode())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _decoded(text: pd.Series) -> pd.Series:
    def one(t: str | None) -> list[float] | None:
        raw = base64.b64decode(t) if t is not None else None
        return None if raw is None or len(raw) % 4 else np.frombuffer(raw, "<f4")

    return text.map(one)


def floats_to_text(values: Column) -> Column:
    """Base64 of 32-bit floats, lowest byte first; null for null."""
    return _encoded(values)


def text_to_floats(text: Column, size: int | None = None) -> Column:
    """The floats again; null for null, for text of other than whole floats, and with ``size`` for another number of them than its square."""
    got = _decoded(text)
    return got if size is None else F.when(F.size(got) == size * size, got)
