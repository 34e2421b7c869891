"""Tiled binary contact maps as a Python data source: ``spark.read.format("contact_tiles")``.

Layout: magic ``pstm``; two u32 sizes and a raw-deflated header (u64 length in base pairs, u32
segments, for each an f32 share and a 64-byte name, then three bytes: log2 of the tile side,
log2 of tiles a side, mip levels); then, for each tile of the upper triangle row by row, a
length-prefixed deflate block of all its mip levels in 4-bit-per-texel blocks; then named
extension tracks, deflated too.  Option ``level`` (0 finest, or ``faithful``; default the coarsest) picks the only
level that is decoded.  A partition is a range of tiles; its task seeks past all others.  All reads are
ranges, through Arrow's file systems; ``index`` gives a row a tile, so filters skip tiles.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAGIC = b"pstm"


class Header(NamedTuple):
    length: int
    names: list[str]
    shares: list[float]
    tile: int
    tiles: int
    levels: int
    body: int  # offset of the first tile


def read_header(data: bytes) -> Header:
    if data[:4] != MAGIC:
        raise ValueError("not a tiled contact map")
    packed, _ = struct.unpack_from("<II", data, 4)
    raw = zlib.decompress(data[12 : 12 + packed], wbits=-15)
    length, n = struct.unpack_from("<QI", raw, 0)
    shares, names, at = [], [], 12
    for _ in range(n):
        shares.append(struct.unpack_from("<f", raw, at)[0])
        names.append(raw[at + 4 : at + 68].split(b"\0")[0].decode("utf-8", "replace"))
        at += 68
    tile, tiles, levels = raw[at : at + 3]
    return Header(length, names, shares, 1 << tile, 1 << tiles, levels, 12 + packed)


def palettes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Eight levels of each block from its two ends: sevenths if a > b, else fifths with 0 and 255."""
    a, b = a.astype(np.float64)[:, None], b.astype(np.float64)[:, None]
    k = np.arange(1, 7)[None, :]
    wide = ((7 - k) * a + k * b) / 7
    m = np.arange(1, 5)[None, :]
    narrow = np.concatenate([((5 - m) * a + m * b) / 5, np.zeros_like(a), np.full_like(a, 255)], axis=1)
    return np.floor(np.concatenate([a, b, np.where(a > b, wide, narrow)], axis=1))


def decode_level(data: bytes, side: int) -> np.ndarray:
    """Texels (side, side) in 0..1 of one mip level; blocks run down the columns first."""
    across = side // 4
    blocks = np.frombuffer(data, np.uint8, across * across * 8).reshape(-1, 8)
    bits = np.zeros(len(blocks), dtype=np.uint64)
    for k in range(6):
        bits |= blocks[:, 2 + k].astype(np.uint64) << np.uint64(8 * k)
    index = (bits[:, None] >> (np.arange(16, dtype=np.uint64) * np.uint64(3))) & np.uint64(7)
    texels = np.take_along_axis(palettes(blocks[:, 0], blocks[:, 1]), index.astype(np.int64), axis=1).reshape(across, across, 4, 4)
    # [bx, by, dx, dy] to rows by * 4 + dy and columns bx * 4 + dx
    return texels.transpose(1, 3, 0, 2).reshape(side, side) / 255


def level_span(side: int, level: int) -> tuple[int, int, int]:
    """(offset, bytes, side) of one mip level inside an inflated tile."""
    offset = 0
    for _ in range(level):
        offset += side * side // 2
        side //= 2
    return offset, side * side // 2, side


def opened(path: str):
    """A file for ranged reads: a local path, or a URI of a store that Arrow's file systems reach."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(path)
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def header_of(file) -> Header:
    start = file.read_at(12, 0)
    return read_header(start + file.read_at(struct.unpack_from("<I", start, 4)[0], 12)) if start[:4] == MAGIC and len(start) == 12 else read_header(start)


def walk(file, header: Header) -> Iterator[tuple[int, int, int, int]]:
    """(tx, ty, offset, bytes) of every tile of the upper triangle, from the length before each; -1 bytes: the file ends before."""
    at = header.body
    for x in range(header.tiles):
        for y in range(x, header.tiles):
            head = file.read_at(4, at) if at >= 0 else b""
            size = struct.unpack("<I", head)[0] if len(head) == 4 else -1
            yield x, y, at + 4, size
            at = at + 4 + size if size >= 0 else -1


def faithful_level(tiles: int, side: int, levels: int, limit: int = 2048) -> int:
    """The finest level whose whole map has at most ``limit`` bins a side; the coarsest if none has."""
    level = levels - 1
    while level > 0 and tiles * (side >> (level - 1)) <= limit:
        level -= 1
    return level


def decoded(body: bytes, side: int, level: int) -> tuple[np.ndarray | None, str]:
    """(texels of a level, ``ok``), or none and why: ``cut`` file, ``broken`` block, ``short`` of that level."""
    offset, size, own = level_span(side, level)
    try:
        raw = zlib.decompress(body, wbits=-15)
    except zlib.error:
        return None, "broken"
    if len(raw) < offset + size:
        return None, "short"
    return decode_level(raw[offset : offset + size], own), "ok"


class Tiles(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class TileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.level, self.per_task = options["path"], options.get("level"), int(options.get("tilesPerTask", 64))

    def partitions(self) -> list[Tiles]:
        with opened(self.path) as f:
            h = header_of(f)
        total = h.tiles * (h.tiles + 1) // 2
        return [Tiles(self.path, k, min(total, k + self.per_task)) for k in range(0, total, self.per_task)]

    def read(self, part: Tiles) -> Iterator[pa.RecordBatch]:
        with opened(part.path) as f:
            h = header_of(f)
            level = h.levels - 1 if self.level is None else faithful_level(h.tiles, h.tile, h.levels) if self.level == "faithful" else int(self.level)
            side = h.tile >> level
            for x, y, at, size in itertools.islice(walk(f, h), part.first, part.last):
                cells = decoded(f.read_at(size, at), h.tile, level)[0] if size >= 0 else None
                if cells is not None:
                    i, j, v = upper(cells, x, y, side)
                    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(v)], names=["i", "j", "v"])


def upper(cells: np.ndarray, x: int, y: int, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r, c = np.nonzero(cells)
    i, j = x * side + r, y * side + c
    keep = i <= j
    return i[keep].astype(np.int32), j[keep].astype(np.int32), cells[r, c][keep]


class ContactTiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "contact_tiles"

    def schema(self) -> str:
        return "i int, j int, v double"

    def reader(self, schema) -> TileReader:
        return TileReader(self.options)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(file): what Spark's readers find under a path, a folder or a pattern; no content is read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"))


def segments(spark: SparkSession, path: str) -> DataFrame:
    """(file, order_index, name, length) from the headers, by ranged reads."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with opened(name) as f:
                    h = header_of(f)
                n = len(h.names)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array(h.names, pa.string()), pa.array([int(s * h.length + 0.5) for s in h.shares], pa.int64())], names=["file", "order_index", "name", "length"])

    return files(spark, path).mapInArrow(rows, "file string, order_index int, name string, length bigint")


def is_tiled(content: str = "content"):
    return F.substring(F.col(content), 1, 4) == F.lit(bytearray(MAGIC))


def index(spark: SparkSession, path: str) -> DataFrame:
    """(file, tx, ty, offset, bytes, tiles, side, levels) of every tile, from the lengths before them.

    A row a tile: filter it, and the other tiles are never read.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with opened(name) as f:
                    h = header_of(f)
                    for part in iter(lambda it=walk(f, h): list(itertools.islice(it, 4096)), []):
                        n, (x, y, at, size) = len(part), zip(*part)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(x, pa.int32()), pa.array(y, pa.int32()), pa.array(at, pa.int64()), pa.array(size, pa.int64()), *(pa.array([v] * n, pa.int32()) for v in (h.tiles, h.tile, h.levels))], names=["file", "tx", "ty", "offset", "bytes", "tiles", "side", "levels"])

    return files(spark, path).mapInArrow(rows, "file string, tx int, ty int, offset bigint, bytes bigint, tiles int, side int, levels int")


def _level_of(level: int | str | None) -> Column:
    if level == "faithful":
        # each step to a finer level doubles the side
        fits = F.expr("size(filter(sequence(0, levels - 1), k -> tiles * shiftright(side, k) > 2048))")
        return F.least(fits, F.col("levels") - 1)
    return F.col("levels") - 1 if level is None else F.lit(int(level))


def _tasks(tiles: DataFrame, level: int | str | None) -> DataFrame:
    """Tiles dealt out, with the level that each is decoded at."""
    slim = tiles.select("file", "tx", "ty", "offset", "bytes", "side", _level_of(level).cast("int").alias("level"))
    return slim.repartition("file", "tx", "ty").sortWithinPartitions("file", "offset")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, int, np.ndarray | None, str]]:
    """(file, tx, ty, side of the level, texels, status) of the tiles of ``_tasks``; a file is opened once in a row."""
    name, f = None, None
    try:
        for batch in batches:
            for file, x, y, at, size, side, level in zip(*(c.to_pylist() for c in batch.columns)):
                if file != name:
                    if f is not None:
                        f.close()
                    name, f = file, opened(file)
                body = f.read_at(size, at) if size >= 0 else b""
                texels, status = decoded(body, side, level) if size >= 0 and len(body) == size else (None, "cut")
                yield file, x, y, side >> level, texels, status
    finally:
        if f is not None:
            f.close()


def cells(tiles: DataFrame, level: int | str | None = None) -> DataFrame:
    """(file, i, j, v), i <= j, of one mip level of the tiles of ``index``.

    ``level``: a number (0 the finest), ``faithful`` (``faithful_level``), or by default the coarsest.  A tile that can't
    be read holds no cells; ``tile_states`` tells which and why.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, x, y, side, texels, _ in _read(batches):
            if texels is not None:
                i, j, v = upper(texels, x, y, side)
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(i), pa.string()), pa.array(i), pa.array(j), pa.array(v)], names=["file", "i", "j", "v"])

    return _tasks(tiles, level).mapInArrow(rows, "file string, i int, j int, v double")


def tile_states(tiles: DataFrame, level: int | str | None = None) -> DataFrame:
    """(file, tx, ty, status) of every tile: ``ok``, or why a level of it can't be had (``cut``, ``broken``, ``short``)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, x, y, _, _, status in _read(batches):
            yield pa.RecordBatch.from_arrays([pa.array([file], pa.string()), pa.array([x], pa.int32()), pa.array([y], pa.int32()), pa.array([status], pa.string())], names=["file", "tx", "ty", "status"])

    return _tasks(tiles, level).mapInArrow(rows, "file string, tx int, ty int, status string")


def texels(tiles: DataFrame, wanted: DataFrame, level: int | str | None = None) -> DataFrame:
    """(file, tx, ty, row, col, v) of wanted tiles (tx, ty) in any order; one below the diagonal is its mirror, transposed."""
    low, high = F.least("tx", "ty"), F.greatest("tx", "ty")
    asked = wanted.select("tx", "ty").distinct()
    found = tiles.join(asked.select(low.alias("tx"), high.alias("ty")).distinct(), ["tx", "ty"], "left_semi")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, x, y, _, texels, _ in _read(batches):
            if texels is not None:
                r, c = np.nonzero(texels)
                n = len(r)
                yield pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array([x] * n, pa.int32()), pa.array([y] * n, pa.int32()), pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(texels[r, c])], names=["file", "x", "y", "r", "c", "v"])

    got = _tasks(found, level).mapInArrow(rows, "file string, x int, y int, r int, c int, v double")
    both = asked.select("tx", "ty", low.alias("x"), high.alias("y"))
    turned = F.col("tx") > F.col("ty")
    return got.join(both, ["x", "y"]).select("file", "tx", "ty", F.when(turned, F.col("c")).otherwise(F.col("r")).alias("row"), F.when(turned, F.col("r")).otherwise(F.col("c")).alias("col"), "v")


def extension_tracks(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, pos, value) of the named tracks after the last tile.

    A track is ``psgh``, a u32 size and a raw-deflated block of a 64-byte name and an i32 a texel.  Bytes between
    tracks are passed over; a block that is broken or too short is no track.
    """

    def found(f, h: Header) -> Iterator[tuple[str, np.ndarray]]:
        *_, (_, _, at, size) = walk(f, h)
        if size < 0:
            return
        n, rest, end = h.tile * h.tiles, at + size, f.size()
        while True:
            step = f.read_at(min(1 << 20, end - rest), rest) if rest < end else b""
            k = step.find(b"psgh")
            if k < 0:
                if rest + len(step) >= end:
                    return
                rest += max(1, len(step) - 3)
                continue
            head = f.read_at(4, rest + k + 4)
            if len(head) < 4 or rest + k + 8 + (size := struct.unpack("<I", head)[0]) > end:
                return
            body, rest = f.read_at(size, rest + k + 8), rest + k + 8 + size
            try:
                raw = zlib.decompress(body, wbits=-15)
            except zlib.error:
                continue
            if len(raw) >= 64 + 4 * n:
                yield raw[:64].split(b"\0")[0].decode("latin-1"), np.frombuffer(raw, "<i4", n, 64).astype(np.int32)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                with opened(file) as f:
                    for name, values in found(f, header_of(f)):
                        n = len(values)
                        yield pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array([name] * n, pa.string()), pa.array(np.arange(n, dtype=np.int32)), pa.array(values)], names=["file", "name", "pos", "value"])

    return files(spark, path).mapInArrow(rows, "file string, name string, pos int, value int")
