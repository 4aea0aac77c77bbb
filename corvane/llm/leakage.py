"""Passages of held-out texts inside a corpus, by spaced-seed hashing.

A mask lays a window over consecutive words and ignores some of its positions, so
that a substituted word there doesn't change the hash. Windows of both sides are hashed
at every position, so each run of `span` equal words is found, and of the overlaps
with substitutions all that hold a window in which only ignored positions differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.kernels import U, mix, starts, words
from corvane.llm.seedjoin import candidates, expand, numbered, query_classes, with_texts

#: Fixed masks; 0 is an ignored position.
MASKS = ("1110110111011011", "1101111010111101", "1011101101101110")


#: Equal pairs of words that are laid out at once when overlaps are measured.
MOST_PAIRS = 4_000_000


def spaced_seeds(masks: tuple[str, ...], stride: int):
    """Seeds of the windows at every `stride`-th position of a row, under each mask."""
    span = len(masks[0])

    def seeds(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pos, row = starts(off, span)
        if stride > 1:
            m = (pos - off[row]) % stride == 0
            pos, row = pos[m], row[m]
        xs = []
        for k, mask in enumerate(masks):
            x = np.full(len(pos), k + 1, U)
            for i, bit in enumerate(mask):
                if bit == "1":
                    x += h[pos + i] * U((0x9E3779B97F4A7C15 * (2 * i + 3) * (2 * k + 5) | 1) & (2**64 - 1))
            xs.append(mix(x))
        return np.concatenate(xs), np.tile(row, len(masks)), np.zeros(len(row) * len(masks), np.int32)

    return seeds


def aligned_runs(q: list[str], c: list[str], gap: int, window: int = 20) -> dict[str, np.ndarray]:
    """For each row, the longest equal run of words and the longest overlap in which at
    most `gap` words in a row are substituted: `run`, `span`, `same` (equal words of the
    span), `q_start`, `c_start`, the word count `q_words`, and `dense`, the most equal words
    among `window` aligned ones."""
    hq, oq = words(q)
    hc, oc = words(c)
    rq = np.repeat(np.arange(len(q)), np.diff(oq))
    rc = np.repeat(np.arange(len(c)), np.diff(oc))
    # Row and word as one sortable key: words get dense numbers first.
    vocabulary, code = np.unique(np.concatenate((hq, hc)), return_inverse=True)
    key_q = rq * len(vocabulary) + code[: len(hq)]
    key_c = rc * len(vocabulary) + code[len(hq) :]
    order = np.argsort(key_c, kind="stable")
    key_c = key_c[order]
    lo, hi = np.searchsorted(key_c, key_q, "left"), np.searchsorted(key_c, key_q, "right")
    n = hi - lo
    out = {k: np.zeros(len(q), np.int64) for k in ("run", "span", "same", "q_start", "c_start", "dense")}
    out["q_words"] = np.diff(oq)
    # Equal pairs of words are laid out for a block of rows at a time.
    upto = np.concatenate(([0], np.cumsum(n)))[oq]
    first = 0
    while first < len(q):
        last = max(first + 1, int(np.searchsorted(upto, upto[first] + MOST_PAIRS, "right")) - 1)
        at = np.arange(oq[first], oq[last])
        m = n[at]
        i = np.repeat(at, m)
        j = order[np.repeat(lo[at], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
        row = rq[i]
        _longest(out, row, i - oq[row], j - oc[row], gap, window)
        first = last
    return out


def _longest(out: dict[str, np.ndarray], row: np.ndarray, i: np.ndarray, j: np.ndarray, gap: int, window: int) -> None:
    """Put the longest run and overlap among the equal pairs (i, j) of some rows into `out`."""
    if not len(i):
        return
    o = np.lexsort((i, j - i, row))
    i, j, row = i[o], j[o], row[o]
    new = np.concatenate(([True], (row[1:] != row[:-1]) | ((j - i)[1:] != (j - i)[:-1])))
    # Places on one line, diagonal after diagonal, so far apart that no window reaches the next.
    line = np.cumsum(new) * (2 * int(i.max()) + 2 * window) + i
    np.maximum.at(out["dense"], row, np.searchsorted(line, line + window, "left") - np.arange(len(line)))
    step = np.concatenate(([1], np.diff(i)))
    for allowed in (0, gap):
        first = np.flatnonzero(new | (step > allowed + 1))
        last = np.concatenate((first[1:], [len(i)])) - 1
        span, same, r = i[last] - i[first] + 1, last - first + 1, row[first]
        best = np.lexsort((-first, span, r))
        best = best[np.concatenate((r[best][1:] != r[best][:-1], [True]))]
        if allowed == 0:
            out["run"][r[best]] = span[best]
        if allowed == gap:
            out["span"][r[best]], out["same"][r[best]] = span[best], same[best]
            out["q_start"][r[best]], out["c_start"][r[best]] = i[first[best]], j[first[best]]


def _measure(gap: int, run: int):
    names = ["run", "span", "same", "q_start", "c_start", "q_words", "dense"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = aligned_runs(b.column("q_text").to_pylist(), b.column("c_text").to_pylist(), gap, run)
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("query"), *(pa.array(m[k].astype(np.int32)) for k in names)], names=["doc", "query", *names])

    return measure


def leaked_passages(corpus: DataFrame, corpus_key: str, corpus_text: str, tests: DataFrame, test_key: str, test_text: str, run: int = 20, masks: tuple[str, ...] = MASKS, gap: int = 1) -> DataFrame:
    """Rows (query_key, corpus_key, run, span, same, q_start, c_start, q_words) of the
    test texts that stand wholly or partly in a corpus text.

    A pair is returned if as many consecutive words of both as the parameter `run` says
    differ in at most one; at a `run` of 20 and the masks here every such pair is found.
    `run` is its longest run of equal consecutive words; `span` its longest overlap with
    single substitutions, of which `same` words are equal.

    Null texts and keys, and test texts with fewer than `run` words, give no row. A key
    loaded twice counts once; of two texts under one key each is searched.
    """
    span = len(masks[0])
    if run < span:
        raise ValueError(f"run must be at least the masks' span of {span}")
    c, q = numbered(corpus, corpus_key, corpus_text), numbered(tests, test_key, test_text)
    classes = query_classes(q, run)
    pairs = candidates(classes, c, spaced_seeds(masks, 1), spaced_seeds(masks, 1), None, span, "leak")
    names = "run int, span int, same int, q_start int, c_start int, q_words int, dense int"
    found = with_texts(pairs, classes, c).mapInArrow(_measure(gap, run), f"doc long, query long, {names}").where(F.col("dense") >= run - 1)
    best = found.groupBy("doc", "query").agg(F.max(F.struct("run", "span", "same", "q_start", "c_start", "q_words")).alias("m")).select("doc", "query", "m.*")
    return expand(best, classes, c)
