"""Words of Arrow columns of texts, cut on their UTF-8 bytes with NumPy; A-Z become lower case.

Bytes from 0x80 on belong to words, so a set of ASCII bytes says what a word is.  The words come as
one Arrow string column, which Arrow's own dictionary encoding turns into numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are cut at once, about; a longer text is cut where a word can't go on.
PIECE_BYTES = 1 << 18
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def byte_set(pattern: str) -> np.ndarray:
    """Table of 256 flags: the ASCII characters of a string."""
    out = np.zeros(256, dtype=bool)
    out[list(pattern.encode("ascii"))] = True
    return out


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends of the texts in them) of a string column; nulls are empty."""
    texts = pc.fill_null(texts, "")
    if not len(texts):
        return np.empty(0, np.uint8), np.empty(0, np.int64)
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets[1:] - offsets[0]


def pieces(texts: pa.Array, cut: np.ndarray, size: int = PIECE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """(first row, bytes in lower case, ends, whole) of runs of texts, and of parts of long ones.

    A part ends after a byte of ``cut``; the last part of a text is ``whole``, as is a run.  A text
    without such a byte stays in one part.
    """
    data, ends = raw(texts)
    starts = ends - np.diff(ends, prepend=0)
    k = 0
    while k < len(ends):
        last = int(np.searchsorted(ends, starts[k] + size, side="right"))
        if last > k:
            yield k, _LOWER[data[starts[k] : ends[last - 1]]], ends[k:last] - starts[k], True
            k = last
            continue
        at, end = int(starts[k]), int(ends[k])
        while at < end:
            stop, step = end, at
            while end - at > size and step < end:
                found = np.flatnonzero(cut[_LOWER[data[step : min(end, step + size)]]])
                if len(found):  # the last in the first stretch, or the first after it
                    stop = step + int(found[-1 if step == at else 0]) + 1
                    break
                step += size
            yield k, _LOWER[data[at:stop]], np.array([stop - at]), stop == end
            at = stop
        k += 1


def words(data: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(words, byte at which each begins): runs of bytes of the table ``inside``, which no text's end is within."""
    n = len(data)
    if not n:
        return pa.array([], pa.string()), np.empty(0, np.int64)
    own = inside[data]
    first = own.copy()
    first[1:] &= ~own[:-1]
    cuts = ends[(ends > 0) & (ends < n)]
    first[cuts] = own[cuts]
    starts = np.flatnonzero(first)
    packed = data[own]
    offsets = np.zeros(len(starts) + 1, np.int32)
    before = np.cumsum(own, dtype=np.int32)
    offsets[:-1] = before[starts] - 1
    offsets[-1] = len(packed)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(packed)), starts
