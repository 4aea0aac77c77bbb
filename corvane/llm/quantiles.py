"""Percentiles from mergeable summaries of sorted, weighted buffers.

A summary holds buffers of K sorted values; a buffer of level i stands for 2^i values
by each of its own. Two buffers of one level collapse into one of the next: of their
2 K merged values every second one is kept, from the first or the second in turn. One
collapse at level i moves no rank by more than 2^i, and a summary adds these amounts up,
so it knows its own error bound. As only buffers of one level collapse, the collapses
form a binary tree and the bound is at most n log2(n / K) / (2 K). Nothing is random.

Summaries of partitions, days or any union of them merge in any order; the merges of a
group form a tree of fixed fan-in over its tasks (`merge_summaries`). The percentile
q is the value of rank ceil(q n), at least 1, in the order of the values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import materialize

K = 2048


class Summary:
    """n values in levels of sorted buffers, and those that fill no buffer yet."""

    def __init__(self, k: int = K) -> None:
        self.k, self.n, self.error, self.turn = k, 0, 0, 0
        self.rest = np.zeros(0)
        self.levels: list[np.ndarray] = []

    def add(self, values: np.ndarray) -> Summary:
        """Values without NaN."""
        self.n += len(values)
        self.rest = np.concatenate((self.rest, values))
        full = len(self.rest) // self.k
        if full:
            self._put(0, np.sort(self.rest[: full * self.k].reshape(full, self.k), axis=1))
            self.rest = self.rest[full * self.k :]
        return self

    def _put(self, level: int, buffers: np.ndarray) -> None:
        while len(self.levels) <= level:
            self.levels.append(np.zeros((0, self.k)))
        have = np.concatenate((self.levels[level], buffers))
        pairs = len(have) // 2
        if pairs:
            merged = np.sort(have[: 2 * pairs].reshape(pairs, 2 * self.k), axis=1)
            odd = (np.arange(pairs) + self.turn) % 2
            self.turn += pairs
            at = 2 * np.arange(self.k)[None, :] + odd[:, None]
            self.error += pairs << level
            self.levels[level] = have[2 * pairs :]
            self._put(level + 1, np.take_along_axis(merged, at, axis=1))
        else:
            self.levels[level] = have

    def merge(self, other: Summary) -> Summary:
        if other.k != self.k:
            raise ValueError("summaries of different buffer sizes can't be merged")
        n = self.n + other.n
        self.error += other.error
        for level, buffers in enumerate(other.levels):
            if len(buffers):
                self._put(level, buffers)
        self.add(other.rest)
        self.n = n
        return self

    def values(self, qs: list[float]) -> list[float | None]:
        if not self.n:
            return [None] * len(qs)
        v = np.concatenate([self.rest, *(b.ravel() for b in self.levels)])
        w = np.concatenate([np.ones(len(self.rest), np.int64), *(np.full(b.size, 1 << i, np.int64) for i, b in enumerate(self.levels))])
        o = np.argsort(v, kind="stable")
        at = np.searchsorted(np.cumsum(w[o]), [target_rank(q, self.n) for q in qs])
        return [float(v[o][min(i, len(v) - 1)]) for i in at]

    def to_bytes(self) -> bytes:
        head = np.array([self.k, self.n, self.error, self.turn, len(self.rest), len(self.levels), *(len(b) for b in self.levels)], np.int64)
        return head.tobytes() + self.rest.tobytes() + b"".join(b.tobytes() for b in self.levels)

    @staticmethod
    def from_bytes(data: bytes) -> Summary:
        k, n, error, turn, rest, levels = (int(x) for x in np.frombuffer(data, np.int64, 6))
        counts = np.frombuffer(data, np.int64, levels, 48)
        values = np.frombuffer(data, np.float64, -1, 48 + 8 * levels)
        s = Summary(k)
        s.n, s.error, s.turn, s.rest = n, error, turn, values[:rest].copy()
        at = rest
        for c in counts:
            s.levels.append(values[at : at + c * k].reshape(c, k).copy())
            at += c * k
        return s


def target_rank(q: float, n: int) -> int:
    return max(1, int(np.ceil(q * n - 1e-9)))


#: Summaries that a task holds before it hands them out.
MOST_OPEN = 512
#: Summaries that one merge takes in: the fan-in of the tree.
FAN_IN = 64


def _group_codes(columns: list[pa.Array]) -> np.ndarray:
    """A number for each row, the same for rows with equal values (null equals null)."""
    code = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        one = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        code = np.unique(code * (one.max(initial=0) + 1) + one, return_inverse=True)[1]
    return code


def _summarize(keys: list[str], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        open_: dict[tuple, Summary] = {}

        def out() -> pa.RecordBatch:
            cols = [pa.array([key[i] for key in open_], schema.field(c).type) for i, c in enumerate(keys)]
            return pa.RecordBatch.from_arrays([*cols, pa.array([s.to_bytes() for s in open_.values()], pa.binary())], names=[*keys, "summary"])

        for b in batches:
            if not b.num_rows:
                continue
            schema = b.schema
            value = b.column("value").to_numpy(zero_copy_only=False).astype(np.float64)
            columns = [b.column(c) for c in keys]
            code = _group_codes(columns)
            # One sort brings the groups together; each is then a slice.
            order = np.argsort(code, kind="stable")
            value, first = value[order], np.flatnonzero(np.diff(code[order], prepend=-1))
            names = zip(*(c.take(pa.array(order[first])).to_pylist() for c in columns), strict=True)
            for key, lo, hi in zip(names, first, [*first[1:], len(value)], strict=True):
                v = value[lo:hi]
                open_.setdefault(key, Summary(k)).add(v[~np.isnan(v)])
            if len(open_) > MOST_OPEN:
                yield out()
                open_ = {}
        if open_:
            yield out()

    return run


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    """One row for all, whatever order they come in."""
    first, *rest = sorted(rows["summary"])
    total = Summary.from_bytes(first)
    for data in rest:
        total.merge(Summary.from_bytes(data))
    return rows.iloc[:1].assign(summary=[total.to_bytes()])


def part_summaries(df: DataFrame, keys: list[str], values: list[str], k: int = K) -> DataFrame:
    """Rows (keys..., metric, summary): the leaves of the tree, one for each group, column
    of `values` and task, written once.

    A task that meets more than MOST_OPEN groups hands some out early, so a group may have
    several leaves of one task.
    """
    metrics = F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values])).alias("m")
    long = df.select(*keys, metrics).select(*keys, F.col("m.metric").alias("metric"), F.coalesce(F.col("m.value"), F.lit(float("nan"))).alias("value"))
    by = [*keys, "metric"]
    types = dict(long.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in by) + ", summary binary"
    return materialize(long.mapInArrow(_summarize(by, k), schema), "summaries")


def summaries(df: DataFrame, keys: list[str], values: list[str], k: int = K) -> DataFrame:
    """Rows (keys..., metric, summary), one for each group and column of `values`.

    Null and NaN values are left out; a group without a value has a row with an empty
    summary. Null keys form groups of their own.
    """
    return merge_summaries(part_summaries(df, keys, values, k), [*keys, "metric"])


def merge_summaries(parts: DataFrame, by: list[str]) -> DataFrame:
    """Summaries united by the columns `by`, over a tree: at each level a group's summaries
    are dealt to nodes of about half of FAN_IN each, until FAN_IN or fewer are left, which
    become one. So no merge takes in more than about FAN_IN summaries of fixed size,
    however many tasks or days there are, and a hot group is spread over tasks at all levels
    but the last. Which node takes a summary follows from its content.
    """
    types = dict(parts.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in by) + ", summary binary"
    level = parts.select(*by, "summary")
    while (most := level.groupBy(*by).count().agg(F.max("count")).first()[0] or 0) > FAN_IN:
        nodes = -(-2 * most // FAN_IN)
        dealt = level.groupBy(*by, F.pmod(F.xxhash64("summary"), F.lit(nodes)).alias("node_"))
        level = materialize(dealt.applyInPandas(_merge, schema), "level")
    return level.groupBy(*by).applyInPandas(_merge, schema)


def quantiles(summarized: DataFrame, qs: list[float]) -> DataFrame:
    """Rows (..., q, value, n, rank_error): the true rank of `value` is off by at most rank_error."""

    def read(data: pd.Series) -> pd.Series:
        out = []
        for d in data:
            s = Summary.from_bytes(d)
            out.append([{"q": q, "value": v, "n": s.n, "rank_error": s.error} for q, v in zip(qs, s.values(qs), strict=True)])
        return pd.Series(out)

    shape = "array<struct<q:double,value:double,n:bigint,rank_error:bigint>>"
    rest = [c for c in summarized.columns if c != "summary"]
    return summarized.select(*rest, F.explode(F.pandas_udf(read, shape)("summary")).alias("s")).select(*rest, "s.*")
