"""Overlaps between the records of evaluation and training splits.

Edit-distance segment join over words. An evaluation text of n words is cut into
m = n // width segments of `width` words; k edits leave all but k of them unchanged. So of
any k + l of them at least l stand in each text within k edits, and each at an allowed
position: shifted by at most k. The k + l rarest in the training side are chosen, with
l = 2 and k = 2 m / 5: the others are often set phrases, shared by a part of all texts,
and a join on them grows with the square of the tables. Training texts are probed
with all their substrings of `width` words; a banded dynamic program decides whether a
candidate is within k edits. The exact overlap is checked at the end.

Moved sentences leave the overlap as it is but not the edit distance, and so do blocks of
more than k words that are added or left out. These pairs come by a second path of the
same join: of a text's n distinct (overlapping) segments at most floor((1 - t) n) can be
missing from a text whose overlap with it is t or more, so of the floor((1 - t) n) + 4
rarest at least 4 are shared, at any position. `path` tells which way a pair came.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import bounded
from corvane.llm.kernels import jaccard, shingles, words
from corvane.llm.seedjoin import expand, numbered, query_classes, with_texts
from corvane.session import materialize

#: Segments that a pair must share on the second path, and those (l above) of the segment join.
SHARED, UNCHANGED = 4, 2


def _counts(width: int, bits: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = np.zeros(1 << bits, np.uint32)
        for b in batches:
            x, _, _ = shingles(*words(b.column(0).to_pylist()), width)
            np.add.at(table, bounded.slot(x, bits), 1)
        yield bounded.blocks_of(np.minimum(table, 255).astype(np.uint8), TaskContext.get().partitionId())

    return count


def edits_allowed(n_words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For texts of so many words: the edits k that the segment join covers, and how many
    of their k + l chosen segments must be left unchanged (l, less for short texts)."""
    m = n_words // width
    k = np.clip(np.minimum(2 * m // 5, m - UNCHANGED), 0, None)
    return k, np.minimum(UNCHANGED, m - k)


_Q_SCHEMA = "h long, query long, n int, w int, k int, least int, a int, lo int, hi int, b int"
_C_SCHEMA = "h long, doc long, n int, w int, lo int, hi int"


def _spread(x: np.ndarray, row: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values of each row: where they begin in the order by row, value and
    position, that order, and their first and last positions."""
    o = np.lexsort((p, x, row))
    new = np.ones(len(o), bool)
    new[1:] = (x[o][1:] != x[o][:-1]) | (row[o][1:] != row[o][:-1])
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(o)]))[: len(first)] - 1
    return first, o, p[o[first]], p[o[last]]


def _among_rarest(row: np.ndarray, freq: np.ndarray, x: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which entries are among the `most[row]` rarest of their row."""
    o = np.lexsort((x, freq, row))
    n = np.bincount(row, minlength=len(most))
    rank = np.empty(len(row), np.int64)
    rank[o] = np.arange(len(row)) - (np.cumsum(n) - n)[row[o]]
    return rank < most[row]


def _evaluation_seeds(width: int, t: float, bits: int, counts):
    """For each distinct segment of an evaluation text: how often it is one of the k + l
    chosen segments (`a`, between positions `lo` and `hi`), and whether it is one of the
    rarest that a text with moved parts must share (`b`)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, off = words(batch.column(1).to_pylist())
            w = np.diff(off)
            x, row, pos = shingles(h, off, width)
            p = pos - off[row]
            freq = counts.value[bounded.slot(x, bits)]
            k, least = edits_allowed(w, width)
            a = np.zeros(len(x), bool)
            cut = np.flatnonzero(p % width == 0)
            a[cut[_among_rarest(row[cut], freq[cut], x[cut], k + least)]] = True
            first, o, _, _ = _spread(x, row, p)
            r, v = row[o[first]], x[o[first]]
            n = np.bincount(r, minlength=len(w))
            b = _among_rarest(r, freq[o[first]], v, np.floor((1 - t) * n + 1e-9).astype(np.int64) + SHARED)
            if not len(first):
                continue
            some, at = a[o], p[o]
            n_a = np.add.reduceat(some.astype(np.int64), first)
            lo = np.minimum.reduceat(np.where(some, at, 1 << 30), first)
            hi = np.maximum.reduceat(np.where(some, at, -1), first)
            m = (n_a > 0) | b
            r = r[m]
            cols = [n[r], w[r], k[r], least[r], n_a[m], lo[m], hi[m], b[m]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v[m].view(np.int64)), batch.column(0).take(pa.array(r)), *(pa.array(c.astype(np.int32)) for c in cols)], names=[c.split()[0] for c in _Q_SCHEMA.split(", ")]
            )

    return emit


def _training_seeds(width: int, min_words: int, marks, bits: int):
    """All substrings of `width` words that may be an evaluation text's segment, with their positions."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, off = words(batch.column(1).to_pylist())
            w = np.diff(off)
            x, row, pos = shingles(h, off, width)
            first, o, lo, hi = _spread(x, row, pos - off[row])
            r, v = row[o[first]], x[o[first]]
            n = np.bincount(r, minlength=len(w))
            m = (w[r] >= min_words) & bounded.in_bitmap(marks.value, v, bits)
            r = r[m]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v[m].view(np.int64)), batch.column(0).take(pa.array(r)), *(pa.array(c.astype(np.int32)) for c in (n[r], w[r], lo[m], hi[m]))], names=[c.split()[0] for c in _C_SCHEMA.split(", ")]
            )

    return emit


def banded_distance(a: list[np.ndarray], b: list[np.ndarray], band: np.ndarray) -> np.ndarray:
    """Edit distances over words, pair by pair; -1 where one exceeds its band.

    The pairs advance together, row by row of their matrices, of which only the cells
    within the widest band of a group are held.
    """
    n_a, n_b = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    out = np.full(len(a), -1, np.int64)
    order = np.lexsort((n_a, band))
    at = 0
    while at < len(order):
        k = int(band[order[at]])
        group = order[at : at + max(1, 400_000 // (2 * k + 32))]
        group = group[(band[group] <= 2 * k + 8)]
        at += len(group)
        k = int(band[group].max())
        p, la, lb = len(group), int(n_a[group].max(initial=0)), int(n_b[group].max(initial=0))
        wa, wb = np.zeros((p, la), np.uint64), np.zeros((p, lb + 2 * k + la + 2), np.uint64)
        for i, g in enumerate(group):
            wa[i, : n_a[g]] = a[g]
            wb[i, k : k + n_b[g]] = b[g]
        offset = np.arange(-k, k + 1)
        far = 1 << 30
        d = np.broadcast_to(np.where(offset >= 0, offset, far), (p, 2 * k + 1)).copy()
        d[offset[None, :] > n_b[group][:, None]] = far
        final = np.full(p, far)
        done = n_a[group] == 0
        at_end = n_b[group] - n_a[group] + k
        inside = (at_end >= 0) & (at_end <= 2 * k)
        rows = np.arange(p)
        col = np.clip(at_end, 0, 2 * k)
        final[done] = d[rows, col][done]
        for i in range(1, la + 1):
            j = i + offset
            same = (wa[:, i - 1 : i] == wb[:, i - 1 : i - 1 + 2 * k + 1]) & (j >= 1)
            new = np.where(same, d, d + 1)
            new[:, :-1] = np.minimum(new[:, :-1], d[:, 1:] + 1)
            new[:, (j < 0)] = far
            new = np.minimum.accumulate(new - offset, axis=1) + offset
            new[:, (j < 0)] = far
            d = np.minimum(new, far)
            now = n_a[group] == i
            if now.any():
                final[now] = d[rows, col][now]
        ok = inside & (final <= band[group])
        out[group[ok]] = final[ok]
    return out


def _verify(width: int, t: float, min_words: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, c = b.column("q_text").to_pylist(), b.column("c_text").to_pylist()
            hq, oq = words(q)
            hc, oc = words(c)
            k, _ = edits_allowed(np.diff(oq), width)
            # The banded program decides on what the segments at allowed positions found.
            near = np.flatnonzero(b.column("near").to_numpy(zero_copy_only=False).astype(bool))
            edits = np.full(len(q), -1, np.int64)
            edits[near] = banded_distance([hq[oq[i] : oq[i + 1]] for i in near], [hc[oc[i] : oc[i + 1]] for i in near], k[near])
            use = np.flatnonzero((edits >= 0) | b.column("moved").to_numpy(zero_copy_only=False).astype(bool))
            j, n_q, n_c = jaccard([q[i] for i in use], [c[i] for i in use], width)
            ok = (j >= t - 1e-12) & (n_q >= min_words) & (n_c >= min_words)
            m, e = use[ok], edits[use[ok]]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc").take(pa.array(m)), b.column("query").take(pa.array(m)), pa.array(j[ok]), pa.array(e, pa.int64(), mask=e < 0)], names=["doc", "query", "overlap", "edits"]
            )

    return verify


def split_overlaps(
    evaluation: DataFrame, evaluation_key: str, evaluation_text: str, training: DataFrame, training_key: str, training_text: str, width: int = 5, threshold: float = 0.8, min_words: int = 15
) -> DataFrame:
    """Rows (query_key, corpus_key, overlap, edits, path): evaluation and training records
    whose sets of `width` consecutive words overlap by at least `threshold`.

    `path` is "edits" for pairs within the k edits of the segment join, and `edits` their
    edit distance in words; "moved" for the others, whose distance is null.

    Null keys and texts and texts under `min_words` words give no row; a key exported twice
    counts once. Other columns are ignored.
    """
    spark = training.sparkSession
    q, c = numbered(evaluation, evaluation_key, evaluation_text), numbered(training, training_key, training_text)
    least_words = max(min_words, width)
    classes = query_classes(q, least_words)
    bits = bounded.counter_bits(c.count())
    table = bounded.collect_blocks(c.select("text").mapInArrow(_counts(width, bits), "block int, salt int, data binary"), 1 << bits, "uint8", add=True)
    counts = spark.sparkContext.broadcast(table)
    one = classes.select("query", "text").dropDuplicates(["query"])
    seeds = materialize(one.mapInArrow(_evaluation_seeds(width, threshold, bits, counts), _Q_SCHEMA), "split-seeds")
    mark_bits = bounded.bitmap_bits(seeds.count())
    marks = spark.sparkContext.broadcast(bounded.hash_bitmap(seeds, "h", mark_bits))
    hits = c.select("doc", "text").mapInArrow(_training_seeds(width, least_words, marks, mark_bits), _C_SCHEMA).distinct()
    e, s = hits.alias("c"), seeds.alias("q")
    k = F.col("q.k")
    # Positions of a substring span lo to hi, so a substring may be let through that isn't at an allowed one.
    near = (F.col("q.a") > 0) & (F.abs(F.col("q.w") - F.col("c.w")) <= k) & (F.col("c.lo") <= F.col("q.hi") + k) & (F.col("c.hi") >= F.col("q.lo") - k)
    moved = (F.col("q.b") > 0) & (F.col("c.n") >= threshold * F.col("q.n") - 1e-6) & (F.col("q.n") >= threshold * F.col("c.n") - 1e-6)
    joined = e.join(s, (F.col("q.h") == F.col("c.h")) & (near | moved))
    shared = joined.groupBy("c.doc", "q.query").agg(
        F.sum(F.when(near, F.col("q.a")).otherwise(0)).alias("a"), F.sum(moved.cast("int")).alias("b"), F.max("q.least").alias("least"), F.max(F.greatest("q.n", "c.n")).alias("n")
    )
    # Texts of few distinct segments may share fewer.
    shared = shared.select("doc", "query", (F.col("a") >= F.col("least")).alias("near"), (F.col("b") >= F.least(F.lit(SHARED), F.ceil(threshold * F.col("n") - 1e-9))).alias("moved"))
    pairs = materialize(shared.where("near or moved"), "split-candidates")
    found = with_texts(pairs, classes, c).mapInArrow(_verify(width, threshold, min_words), "doc long, query long, overlap double, edits long")
    best = found.groupBy("doc", "query").agg(F.max("overlap").alias("overlap"), F.min("edits").alias("edits"))
    return expand(best.withColumn("path", F.when(F.col("edits").isNull(), "moved").otherwise("edits")), classes, c)
