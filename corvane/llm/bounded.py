"""Summaries of fixed size over tables of any size.

A summary is an array of 2^bits counters or bits. Every task folds its rows into an
array of its own and hands out the blocks that are not blank, deflated; the blocks are
added up (or united) in two rounds, first those of 64 tasks, so no task receives more
than a share of them.
Only the finished array, whose size is fixed by `bits` and never by the data, goes
to the driver and out again as a broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SCHEMA = "block int, salt int, data binary"
#: Bytes of a block.
BLOCK = 1 << 15


def blocks_of(array: np.ndarray, salt: int) -> pa.RecordBatch:
    """The blocks of an array that hold anything but zeros."""
    raw = array.view(np.uint8).reshape(-1, BLOCK) if array.nbytes >= BLOCK else array.view(np.uint8).reshape(1, -1)
    used = np.flatnonzero(raw.any(axis=1))
    return pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int32()), pa.array(np.full(len(used), salt // 64), pa.int32()), pa.array([zlib.compress(raw[i].tobytes(), 1) for i in used], pa.binary())],
        names=["block", "salt", "data"],
    )


def _merge(dtype: str, add: bool) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(zlib.decompress(rows["data"].iloc[0]), dtype).copy()
        for data in rows["data"].iloc[1:]:
            other = np.frombuffer(zlib.decompress(data), dtype)
            if add:
                total = np.minimum(total.astype(np.uint64) + other, np.iinfo(dtype).max).astype(dtype)
            else:
                total |= other
        return pd.DataFrame({"block": [key[0]], "salt": [0], "data": [zlib.compress(total.tobytes(), 1)]})

    return merge


def collect_blocks(parts: DataFrame, length: int, dtype: str, add: bool) -> np.ndarray:
    """Fold the tasks' blocks (block, salt, data) into one array of `length` items."""
    merge = _merge(dtype, add)
    once = parts.groupBy("block", "salt").applyInPandas(merge, _SCHEMA)
    rows = once.groupBy("block").applyInPandas(merge, _SCHEMA).select("block", "data").collect()
    out = np.zeros(length, dtype)
    raw = out.view(np.uint8)
    for r in rows:
        data = np.frombuffer(zlib.decompress(r["data"]), np.uint8)
        raw[r["block"] * BLOCK : r["block"] * BLOCK + len(data)] = data
    return out


def counter_bits(texts: int) -> int:
    """The size of a table of shingle counts: 16 to 32 counters for each text, at most 2^24."""
    return int(np.clip(np.ceil(np.log2(max(texts, 1))) + 4, 18, 24))


def bitmap_bits(marks: int) -> int:
    """The size of a bitmap of so many marks: 64 bits for each, at most 2^26 (8 MB)."""
    return int(np.clip(np.ceil(np.log2(64 * max(1, marks))), 18, 26))


def slot(h: np.ndarray, bits: int) -> np.ndarray:
    """The upper bits of hashes."""
    return (h.astype(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def hash_bitmap(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """The bitmap of the upper `bits` of a column of 64-bit hashes, 2^bits / 8 bytes."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen = np.zeros((1 << bits) // 8, np.uint8)
        for b in batches:
            np.bitwise_or.at(seen, *_bit(slot(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits)))
        yield blocks_of(seen, TaskContext.get().partitionId())

    parts = df.select(F.col(column).cast("long")).where(F.col(column).isNotNull()).mapInArrow(fold, _SCHEMA)
    return collect_blocks(parts, (1 << bits) // 8, "uint8", add=False)


def _bit(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return at >> 3, (1 << (at & 7)).astype(np.uint8)


def in_bitmap(bitmap: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """Whether each hash may be among those of the bitmap."""
    at = slot(h, bits)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def keep_marked(df: DataFrame, key: str, bitmap: np.ndarray, bits: int) -> DataFrame:
    """The rows whose hash in column `key` is marked; some others pass too."""
    shared = df.sparkSession.sparkContext.broadcast(bitmap)
    at = df.columns.index(key)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = in_bitmap(shared.value, b.column(at).to_numpy(zero_copy_only=False).view(np.uint64), bits)
            if m.any():
                yield b.filter(pa.array(m))

    return df.mapInArrow(keep, df.schema)
