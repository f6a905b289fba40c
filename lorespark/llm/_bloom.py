"""The twice-seen bit array, merged on the executors by segment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SEGMENT = 1 << 20
PART_SCHEMA = "segment bigint, seen binary, again binary"


def power_of_two(x: int) -> int:
    return 1 << max(0, x - 1).bit_length()


def _pack(places: np.ndarray) -> bytes:
    """Sorted places as steps, which compress well."""
    return np.diff(places, prepend=0).astype(np.uint32).tobytes()


def part(once: np.ndarray, again: np.ndarray, bits: int) -> pa.RecordBatch:
    """A row for each segment: which bits were set (``once``, sorted), and which of these more than once (a mask)."""
    segment = min(SEGMENT, bits)
    home = (once // np.uint64(segment)).astype(np.int64)
    start = np.flatnonzero(np.concatenate(([True], home[1:] != home[:-1]))) if len(home) else np.zeros(0, np.int64)
    bound = [*start.tolist(), len(home)]
    ids, first, more = [], [], []
    for a, b in zip(bound[:-1], bound[1:]):
        local = (once[a:b] % np.uint64(segment)).astype(np.int64)
        ids.append(int(home[a]))
        first.append(_pack(local))
        more.append(_pack(local[again[a:b]]))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(first, pa.binary()), pa.array(more, pa.binary())], names=["segment", "seen", "again"])


def _merge(bits: int):
    segment = min(SEGMENT, bits)

    def run(key, rows):
        once, twice = np.zeros(segment, bool), np.zeros(segment, bool)
        for seen, again in zip(rows.column("seen"), rows.column("again")):
            at = np.cumsum(np.frombuffer(seen.as_py(), np.uint32))
            twice[at[once[at]]] = True
            once[at] = True
            twice[np.cumsum(np.frombuffer(again.as_py(), np.uint32))] = True
        packed = np.packbits(twice, bitorder="little").tobytes()
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int64()), "twice": pa.array([packed], pa.binary())})

    return run


def twice_seen(parts: DataFrame, bits: int) -> np.ndarray:
    """``bits / 8`` bytes with the bits that two parts set, or one part more than once."""
    twice = np.zeros(bits // 8, np.uint8)
    size = min(SEGMENT, bits) // 8
    for row in parts.groupBy("segment").applyInArrow(_merge(bits), "segment bigint, twice binary").toLocalIterator():
        twice[row["segment"] * size : (row["segment"] + 1) * size] = np.frombuffer(row["twice"], np.uint8)
    return twice


def test_bits(array: np.ndarray, places: np.ndarray) -> np.ndarray:
    return ((array[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
