"""Words and word shingles of Arrow string columns, hashed with numpy.

A batch is taken in slices of a few MB of text, never row by row, so that a
Python worker's memory is bounded by the slice or by the longest single text.
Hashes have 64 bits: a random odd-base polynomial over the bytes, mixed. Two
different words or shingles are taken for equal with a chance of about 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are held as numpy arrays at a time.
SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x.copy()
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix((np.arange(1, 257, dtype=np.uint64)) * _U(0xD1342543DE82EF95))

#: White space as the contracts have it: space and the five ASCII controls from tab to carriage return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n + 1:
        size = max(n + 1, SLICE_BYTES + 1)
        made = []
        for b in (_BASE, _BASE_INV):
            power = np.full(size, _U(b))
            power[0] = 1
            made.append(np.cumprod(power, out=power))
        _powers = (made[0], made[1])
    return _powers


def text_slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, row offsets in them); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n, at = len(column), column.offset
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[at : at + n + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + max_bytes, "right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end, data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of bytes that don't separate; a row's end also ends a word."""
    inside = ~separator[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    begin, final = offsets[:-1][full], offsets[1:][full] - 1
    first[begin] = inside[begin]
    last[final] = inside[final]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    power, inverse = _powers_to(len(data))
    # eight bytes for each of the text are held once, not three times
    total = np.zeros(len(data) + 1, np.uint64)
    held = total[1:]
    np.take(_BYTE, data, out=held, mode="clip")
    held *= power[: len(data)]
    np.cumsum(held, out=held)
    return mix((total[ends] - total[starts]) * inverse[starts])


def shingles(words: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and first word of every k-word shingle; a row of fewer words, but not none, is one shingle."""
    n = len(words)
    if not n:
        return row[:0], words[:0], row[:0]
    acc = np.zeros(n, np.uint64)
    for i in range(k):
        acc[: n - i] += words[i:] * _U(pow(_BASE, 2 * i + 3, 1 << 64))
    whole = np.zeros(n, bool)
    whole[: max(0, n - k + 1)] = row[: max(0, n - k + 1)] == row[k - 1 :]
    starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    counts = np.diff(np.concatenate((starts, [n])))
    for s, c in zip(starts[counts < k].tolist(), counts[counts < k].tolist()):
        acc[s] = sum(int(words[s + i]) * pow(_BASE, 2 * i + 3, 1 << 64) for i in range(c)) + c & 0xFFFFFFFFFFFFFFFF
        whole[s] = True
    at = np.flatnonzero(whole)
    return row[at], mix(acc[at]), at


def sort_within(row: np.ndarray, values: np.ndarray, n_rows: int) -> np.ndarray:
    """Bounds of each row in ``values``, which gets sorted in place within each row."""
    bounds = np.searchsorted(row, np.arange(n_rows + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 1:
            values[a:b].sort()
    return bounds
