"""Bloom filters built per partition and merged: values seen once, values seen again.

A filter is a bit array of ``2**log_bits`` positions held as chunks. Every
partition notes its positions sparsely, a shuffle on the chunk merges them
(bits set by one partition and again by another become "repeated"), and only
the merged, fixed-size array reaches the driver. A filter has no false
negatives, so callers keep exact results whatever its load; ``MAX_LOG_BITS``
bounds what is broadcast (128 MiB) at any input size. Callers with more rows
than one filter serves well build several, one per shard of the keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

MAX_LOG_BITS = 30
MIN_LOG_BITS = 15
CHUNK_LOG_BITS = 15
HASHES = 2


def log_bits_for(rows: int, bits_per_row: int = 16) -> int:
    """Size of a filter for so many rows, within the fixed bounds."""
    return min(MAX_LOG_BITS, max(MIN_LOG_BITS, math.ceil(math.log2(max(1, rows) * bits_per_row))))


def positions(codes: np.ndarray, log_bits: int) -> np.ndarray:
    """(n, HASHES) bit positions of 64-bit codes."""
    codes = codes.astype(np.uint64)
    mask = np.uint64((1 << log_bits) - 1)
    mixed = codes * np.uint64(0x9E3779B97F4A7C15)
    return np.stack([codes & mask, (mixed >> np.uint64(64 - log_bits)) & mask], axis=1).astype(np.int64)


def _notes(log_bits: int, code_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, again = [], []
        for batch in batches:
            codes = batch.column(code_column).drop_null().to_numpy(zero_copy_only=False)
            if len(codes):
                pos = positions(codes, log_bits)
                # a row whose two positions coincide must not look like two rows
                same = pos[:, 0] == pos[:, 1]
                flat = np.concatenate([pos[:, 0], pos[~same, 1]])
                seen, n = np.unique(flat, return_counts=True)
                once.append(seen)
                again.append(seen[n > 1])
        if not once:
            return
        seen, n = np.unique(np.concatenate(once), return_counts=True)
        more = np.unique(np.concatenate([*again, seen[n > 1]]))
        chunk = seen >> CHUNK_LOG_BITS
        starts = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
        ends = np.r_[starts[1:], len(seen)]
        low = (1 << CHUNK_LOG_BITS) - 1
        repeated = np.isin(seen, more, assume_unique=True)
        ids, firsts, seconds = [], [], []
        for a, b in zip(starts, ends):
            part = (seen[a:b] & low).astype(np.uint16)
            ids.append(int(chunk[a]))
            firsts.append(part.tobytes())
            seconds.append(part[repeated[a:b]].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(firsts, pa.binary()), pa.array(seconds, pa.binary())], names=["chunk", "once", "again"])

    return run


def _merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    counts = np.zeros(1 << CHUNK_LOG_BITS, np.uint32)
    again = np.zeros(1 << CHUNK_LOG_BITS, bool)
    for once, more in zip(pdf["once"], pdf["again"]):
        counts[np.frombuffer(once, np.uint16)] += 1
        again[np.frombuffer(more, np.uint16)] = True
    return pd.DataFrame({"chunk": [key[0]], "seen": [np.packbits(counts > 0).tobytes()], "repeated": [np.packbits(again | (counts > 1)).tobytes()]})


def merged_filter(df: DataFrame, code_column: str, log_bits: int, which: str) -> np.ndarray:
    """Merged bit array over all rows of ``df``; ``which`` is ``seen`` or ``repeated``.

    Null codes are left out; an empty table gives an all-zero array. The size
    of what the driver receives depends on ``log_bits`` alone.
    """
    notes = df.select(code_column).mapInArrow(_notes(log_bits, code_column), "chunk int, once binary, again binary")
    merged = notes.groupBy("chunk").applyInPandas(_merge, "chunk int, seen binary, repeated binary").select("chunk", which)
    bits = np.zeros((1 << log_bits) // 8, np.uint8)
    size = (1 << CHUNK_LOG_BITS) // 8
    for row in merged.toLocalIterator():
        bits[row[0] * size : (row[0] + 1) * size] = np.frombuffer(row[1], np.uint8)
    return bits


def contains(bits: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Whether each 64-bit code may be in the filter (never false for a member)."""
    log_bits = int(math.log2(len(bits) * 8))
    pos = positions(codes, log_bits)
    hit = (bits[pos >> 3] >> (7 - (pos & 7)).astype(np.uint8)) & 1
    return hit.all(axis=1)
