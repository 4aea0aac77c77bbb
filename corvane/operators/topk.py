"""The k best rows for each of a block of queries, kept while batches of rows go by."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row

from corvane.session import materialize

#: Rows that reach the driver at once.
MOST_ROWS = 200_000
#: Scores (rows x queries) that are laid out at once: 8 bytes each.
MOST_CELLS = 4_000_000


def rows_at_once(queries: int) -> int:
    return max(1, MOST_CELLS // max(1, queries))


def products(a: np.ndarray, row: np.ndarray, b: np.ndarray, query: np.ndarray) -> np.ndarray:
    """The inner products of some rows of `a` with some of `b`, of which MOST_CELLS entries are laid out at once."""
    out, step = np.zeros(len(row)), max(1, MOST_CELLS // max(1, a.shape[1]))
    for at in range(0, len(row), step):
        out[at : at + step] = np.einsum("ij,ij->i", a[row[at : at + step]], b[query[at : at + step]])
    return out


class Best:
    """The k best (key, score) of each query, by falling score rounded to 9 places, then by key.

    Scores may come as approximations first: `likely` names the cells that can reach a query's
    k-th score so far, and only these need an exact score for `put`.
    """

    def __init__(self, queries: int, k: int, key_type: pa.DataType) -> None:
        self.k = k
        self.least = np.full(queries, -np.inf)
        self._query, self._score, self._key = np.zeros(0, np.int64), np.zeros(0), pa.array([], key_type)
        self._new: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self._waiting, self._ordered = 0, True

    def likely(self, scores: np.ndarray, margin: np.ndarray | float = 0.0, above_zero: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Rows and queries of the cells (rows x queries) that may be among the best, if no score
        is off by more than the margin of its query."""
        margin = margin + 1e-9
        least = self._below(self.least - margin, scores, above_zero)
        at = np.flatnonzero(scores >= least)
        if len(at) > 4 * self.k * len(self.least) and len(scores) > self.k:
            own = np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k]
            at = np.flatnonzero(scores >= np.maximum(least, self._below(own - 2 * margin, scores, above_zero)))
        return np.divmod(at, len(self.least))

    @staticmethod
    def _below(least: np.ndarray, scores: np.ndarray, above_zero: bool) -> np.ndarray:
        """Bounds in the type of the scores, never above the given ones."""
        with np.errstate(over="ignore"):
            least = np.nextafter(least.astype(scores.dtype), scores.dtype.type(-np.inf))
        return np.maximum(least, np.finfo(scores.dtype).smallest_subnormal) if above_zero else least

    def put(self, row: np.ndarray, query: np.ndarray, scores: np.ndarray, keys: pa.Array) -> None:
        """Exact scores of cells; `keys` are those of all rows."""
        some = np.flatnonzero((np.round(scores, 9) >= self.least[query]) & (scores > -np.inf))
        self._new.append((query[some], scores[some], keys.take(pa.array(row[some]))))
        self._waiting, self._ordered = self._waiting + len(some), False
        if self._waiting > max(4096, self.k * len(self.least) // 2):
            self._cut(False)

    def add(self, scores: np.ndarray, keys: pa.Array, hit: np.ndarray | None = None) -> None:
        """Exact scores of rows x queries and the rows' keys; without `hit` (rows x queries) all rows count."""
        if not scores.size:
            return
        if hit is not None:
            scores = np.where(hit, scores, -np.inf)
        row, query = self.likely(scores)
        self.put(row, query, scores[row, query], keys)

    def _cut(self, last: bool) -> None:
        """Leave the k best of each query. Of equals of the k-th one all may stay until the
        last time, as comparing keys takes longer, unless they are many."""
        query = np.concatenate([self._query, *(x[0] for x in self._new)])
        score = np.concatenate([self._score, *(x[1] for x in self._new)])
        key = pa.concat_arrays([self._key, *(x[2] for x in self._new)])
        self._new, self._waiting = [], 0
        s = -np.round(score, 9)
        o = np.lexsort((s, query))
        q = query[o]
        rank = np.arange(len(q)) - np.searchsorted(q, q, "left")
        kth = o[rank == self.k - 1]
        self.least[query[kth]] = -s[kth]
        o = o[-s[o] >= self.least[q]]
        if last or len(o) > 2 * self.k * len(self.least):
            key = key.take(pa.array(o))
            query, score = query[o], score[o]
            o = pc.sort_indices(pa.table({"q": query, "s": s[o], "k": key}), [("q", "ascending"), ("s", "ascending"), ("k", "ascending")]).to_numpy()
            q = query[o]
            o = o[np.arange(len(q)) - np.searchsorted(q, q, "left") < self.k]
        self._query, self._score, self._key = query[o], score[o], key.take(pa.array(o))

    def _done(self) -> Best:
        if not self._ordered:
            self._cut(True)
            self._ordered = True
        return self

    @property
    def query(self) -> np.ndarray:
        return self._done()._query

    @property
    def score(self) -> np.ndarray:
        return self._done()._score

    @property
    def key(self) -> pa.Array:
        return self._done()._key


def in_order(df: DataFrame, *by: str, most: int = MOST_ROWS) -> Iterator[Row]:
    """The rows of a table in order, of which the driver holds about `most` at a time."""
    kept = materialize(df, "in-order")
    parts = max(1, kept.count() // most)
    return kept.repartitionByRange(parts, *by).sortWithinPartitions(*by).toLocalIterator()
