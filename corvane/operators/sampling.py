"""Seeded samples of a table."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.hashing import sample_order


def deterministic_sample(df: DataFrame, key: str, size: int, seed: int, label: str) -> DataFrame:
    """`size` rows, the same for the same seed, label and keys; other labels draw anew.

    A top-k by hash, so no order of the rows is needed. Keys must be unique. A size above
    the number of rows is an error.
    """
    if size < 0:
        raise ValueError("size must be at least 0")
    if size > df.count():
        raise ValueError("size is larger than the table")
    return df.orderBy(sample_order(seed, label, F.col(key)), key).limit(size)


def derive_seed(seed: int, label: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{seed}:{label}".encode()).digest()[:8], "big")


def sample_positions(n: int, size: int, seed: int, label: str) -> list[int]:
    """The positions that a shuffle of Python's generator draws, in order."""
    if size < 0 or size > n:
        raise ValueError("size must be between 0 and n")
    at = list(range(n))
    random.Random(derive_seed(seed, label)).shuffle(at)
    return sorted(at[:size])


def shuffle_sample(df: DataFrame, position: str, size: int, seed: int, label: str) -> DataFrame:
    """The same draw by positions 0 to n - 1, for equal members with a sequential program."""
    at = sample_positions(df.count(), size, seed, label)
    chosen = df.sparkSession.createDataFrame([(i,) for i in at], "p_ long")
    return df.join(chosen, F.col(position) == F.col("p_"), "left_semi")


def sample_dev(df: DataFrame, key: str, config) -> DataFrame:
    return deterministic_sample(df, key, config.dev_sample_size, config.seed, "dev")


def sample_official_test(df: DataFrame, key: str, config) -> DataFrame:
    """From the held-out test table, which a caller must pass on purpose."""
    return deterministic_sample(df, key, config.official_test_sample_size, config.seed, "official_test")


def overlapping_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys in both tables; none if the splits are disjoint."""
    return a.select(key).intersect(b.select(key))
