"""Word and shingle hashes of whole Arrow columns of texts, on their UTF-8 bytes with NumPy.

A word's hash comes from prefix sums of mixed bytes times powers of an odd base modulo 2**64:
the sum over a word, moved to position 0 and mixed with its length.  No string is made and no
word is looked up, so the work is a few passes over the bytes, whatever the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
#: Bytes of text that are hashed at once, about; a longer text is hashed piece by piece.
PIECE_BYTES = 1 << 18
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 3
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * U(0xD6E8FEB86659FD93))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, for positions below a length that doubles on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> _Powers:
        with np.errstate(over="ignore"):
            while len(self.up) < n:
                k = len(self.up)
                self.up = np.concatenate([self.up, self.up * U(pow(_BASE, k, 1 << 64))])
                self.down = np.concatenate([self.down, self.down * U(pow(_INVERSE, k, 1 << 64))])
        return self


_powers = _Powers()


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words of every text); texts end at ``ends`` in the bytes."""
    n = len(data)
    if not n:
        return np.empty(0, dtype=np.uint64), np.zeros(len(ends), dtype=np.int64)
    inside = ~_SPACE[data]
    cuts = ends[ends < n]
    first = np.ones(n, dtype=bool)  # nothing before, or a space, or another text
    first[1:] = ~inside[:-1]
    first[cuts] = True
    starts = np.flatnonzero(inside & first)
    last = np.ones(n, dtype=bool)  # nothing after, or a space, or another text
    last[:-1] = ~inside[1:]
    last[cuts[cuts > 0] - 1] = True
    stops = np.flatnonzero(inside & last) + 1
    w = _powers.to(n)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTES[data] * w.up[:n], out=sums[1:])
        h = mix((sums[stops] - sums[starts]) * w.down[starts] + (stops - starts).astype(np.uint64) * U(0xA0761D6478BD642F))
    return h, np.diff(np.searchsorted(starts, ends), prepend=0)


def long_word_hashes(data: np.ndarray) -> np.ndarray:
    """Word hashes of one text of any length, in pieces that end at spaces."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + PIECE_BYTES)
        if end < len(data):
            spaces = np.flatnonzero(_SPACE[data[at:end]])
            while not len(spaces) and end < len(data):  # one word that is longer than a piece
                end = min(len(data), at + 2 * (end - at))
                spaces = np.flatnonzero(_SPACE[data[at:end]])
            end = at + int(spaces[-1]) + 1 if len(spaces) and end < len(data) else end
        out.append(word_hashes(data[at:end], np.array([end - at]))[0])
        at = end
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def fold(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    out = np.zeros(max(0, len(h) - size + 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = mix(out * U(0x9E3779B97F4A7C15) + h[k : k + len(out)])
    return out


def shingled(h: np.ndarray, counts: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every shingle, number of shingles of every text); one of all words where there are fewer."""
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    runs = np.zeros(len(h), dtype=np.uint64)
    full = fold(h, size)
    runs[: len(full)] = full
    valid = np.arange(len(h)) + size <= ends[owner]
    for c in range(1, size):
        short = np.flatnonzero(counts == c)
        if len(short):
            at = ends[short] - c
            out = np.zeros(len(short), dtype=np.uint64)
            with np.errstate(over="ignore"):
                for k in range(c):
                    out = mix(out * U(0x9E3779B97F4A7C15) + h[at + k])
            runs[at], valid[at] = out, True
    return runs[valid], np.bincount(owner[valid], minlength=len(counts))


def unit_sets(runs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The weighted sets as plain ones, each ascending: the i-th copy of a shingle is an element of its own."""
    h, at = runs.copy(), 0
    ends = np.cumsum(counts)
    for end in ends:
        h[at:end].sort()
        at = end
    if not len(h):
        return h
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    new[ends[:-1][ends[:-1] < len(h)]] = True
    copy = np.arange(len(h)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    more = np.flatnonzero(copy)
    if len(more):
        with np.errstate(over="ignore"):
            h[more] = mix(h[more] + copy[more].astype(np.uint64) * U(0xD6E8FEB86659FD93))
        for k in np.unique(np.searchsorted(ends, more, side="right")):
            h[ends[k] - counts[k] : ends[k]].sort()
    return h


def pieces(texts: pa.Array, most: int = 256) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, ends of the texts in them): runs of ``most`` texts and about PIECE_BYTES at most."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    at = 0
    while at < len(texts):
        fit = int(np.searchsorted(offsets, offsets[at] + PIECE_BYTES, side="right")) - 1
        n = max(1, min(most, fit - at, len(texts) - at))
        yield at, n, data[offsets[at] : offsets[at + n]], offsets[at + 1 : at + n + 1] - offsets[at]
        at += n


def units_by_text(texts: pa.Array, size: int = SHINGLE, most: int = 256) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, units, number of units of each text) for runs of texts; ``texts`` holds no nulls."""
    for at, n, data, ends in pieces(texts, most):
        if n == 1 and len(data) > PIECE_BYTES:
            h = long_word_hashes(data)
            counts = np.array([len(h)])
        else:
            h, counts = word_hashes(data, ends)
        runs, sizes = shingled(h, counts, size)
        yield at, n, unit_sets(runs, sizes), sizes
