"""Counting 64-bit hashes by packed ranges: what moves is a few sorted differences in a blob, not a row for each hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hashes that a task holds before it sorts and sends them, and hashes that a range should get, about.
HELD, RANGE = 3_000_000, 500_000
#: log2 of the number of ranges at most, and hashes that a task holds for each range at least, so that blobs do not get small.
RANGE_BITS, HELD_RANGE = 20, 16


def range_bits(expected: float) -> int:
    """log2 of the number of ranges for so many hashes."""
    return int(min(RANGE_BITS, max(3, np.ceil(np.log2(max(expected, 1) / RANGE)))))


def squeeze(values: np.ndarray) -> bytes:
    """Sorted non-negative integers as differences of as few bytes as the largest needs, after one byte that says how many."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def stretch(blob: bytes) -> np.ndarray:
    width, raw = blob[0], np.frombuffer(blob, np.uint8, offset=1)
    steps = np.zeros((len(raw) // width, 8), np.uint8)
    steps[:, :width] = raw.reshape(-1, width)
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def counted(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order and how often each is there, or the sums of its weights."""
    if not len(values):
        return values, np.zeros(0, np.int64)
    if weights is None:
        values = np.sort(values)
    else:
        order = np.argsort(values)
        values, weights = values[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[first], np.diff(np.append(first, len(values))) if weights is None else np.add.reduceat(weights, first)


def send_counts(chunks: Iterator[np.ndarray], bits: int, ranges: int) -> Iterator[pa.RecordBatch]:
    """Blobs for each range of hashes cut to ``bits``: ``part``, ``values``, ``more`` (places and counts over 1)."""
    held: list[np.ndarray] = []
    total = 0

    def flush() -> pa.RecordBatch:
        values, n = counted(np.concatenate(held) >> np.uint64(64 - bits))
        ends = np.searchsorted(values, np.arange(1, (1 << ranges) + 1, dtype=np.uint64) << np.uint64(bits - ranges))
        parts, blobs, more, start = [], [], [], 0
        for part, end in enumerate(ends):
            if end > start:
                many = np.flatnonzero(n[start:end] > 1)
                parts.append(part)
                blobs.append(squeeze(values[start:end] - (np.uint64(part) << np.uint64(bits - ranges))))
                more.append(np.concatenate([many, n[start:end][many]]).astype("<u4").tobytes())
            start = end
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary()), pa.array(more, pa.binary())], ["part", "values", "more"])

    for chunk in chunks:
        held.append(chunk)
        total += len(chunk)
        if total >= max(HELD, HELD_RANGE << ranges):
            yield flush()
            held, total = [], 0
    if total:
        yield flush()


SENT = "part int, values binary, more binary"


def _merged(group: pa.Table, ranges: int, bits: int, least: int) -> tuple[int, np.ndarray, np.ndarray]:
    """A range's number, and its hashes (less the range's start) with their counts, of those that have ``least``."""
    values, counts = [], []
    for blob, more in zip(group.column("values").to_pylist(), group.column("more").to_pylist()):
        v = stretch(blob)
        c = np.ones(len(v), np.int64)
        many = np.frombuffer(more, "<u4").reshape(2, -1)
        c[many[0]] = many[1]
        values.append(v)
        counts.append(c)
    v, c = counted(np.concatenate(values), np.concatenate(counts))
    return group.column("part")[0].as_py(), v[c >= least], c[c >= least]


def frequent_bits(sent: DataFrame, ranges: int, bits: int, least: int, table_bits: int) -> np.ndarray:
    """A table of 2^table_bits bits, with those set that a hash counted ``least`` times or more has at its top."""
    return tables_of(sent, ranges, bits, [least], table_bits)[0]


def tables_of(sent: DataFrame, ranges: int, bits: int, leasts: list[int], table_bits: int) -> list[np.ndarray]:
    """Such a table for each of several least counts: each range sends its own slices."""

    def merge(group: pa.Table) -> pa.Table:
        part, v, c = _merged(group, ranges, bits, min(leasts))
        place, slices = (v >> np.uint64(bits - table_bits)).astype(np.int64), []
        for least in leasts:
            slice_ = np.zeros(1 << (table_bits - ranges), np.uint8)
            slice_[place[c >= least]] = 1
            slices.append(np.packbits(slice_, bitorder="little").tobytes())
        return pa.table({"part": pa.array([part] * len(leasts), pa.int32()), "which": pa.array(range(len(leasts)), pa.int32()), "slice": pa.array(slices, pa.binary())})

    tables = [np.zeros(1 << (table_bits - 3), np.uint8) for _ in leasts]
    size = 1 << (table_bits - ranges - 3)
    for row in sent.groupBy("part").applyInArrow(merge, "part int, which int, slice binary").toLocalIterator():
        tables[row.which][row.part * size : (row.part + 1) * size] = np.frombuffer(row.slice, np.uint8)
    return [t.view(np.int64) for t in tables]


def bit_table(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """A table of 2^bits bits with those set that ``hashes`` has at its top bits: at most 2^(bits-6) rows come to the driver."""
    words = hashes.select(F.expr(f"shiftrightunsigned({column}, {64 - bits + 6})").alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - bits}) & 63 as int))").alias("bit"))
    set_ = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[np.asarray(set_.column("word"))] = np.asarray(set_.column("bit"))
    return table


def has_bit(table: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    place = hashes >> np.uint64(64 - bits)
    return (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)).astype(np.int64)) & 1 == 1
