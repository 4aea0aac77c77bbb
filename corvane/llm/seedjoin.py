"""Joins of a set of query texts with a corpus through shared seeds.

Both sides hash parts of their texts. The queries' seeds are marked in a bitmap of at
most 2^26 bits (8 MB, however many there are: a fuller map only lets more through);
of the corpus only seeds that hit it are shuffled. Joined seeds give candidate pairs.
Only texts that have one are read a second time, and every candidate is then verified
against both whole texts.

Query texts with equal words are one query, whose number is the hash of its words. Corpus
texts are numbered by the 64-bit hash of their characters, and each distinct one is
joined and verified once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm import bounded
from corvane.llm.kernels import sequence_hash, words
from corvane.session import materialize

#: (word hashes, offsets) to (seed hashes, rows, sizes of the rows' texts).
Seeds = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
MARK_BITS = 23


def numbered(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, doc, text) with a number for each text, so that copies are one text from
    here on; null keys and texts are left out."""
    return df.select(F.col(key).cast("string").alias("key"), F.xxhash64(F.col(text).cast("string")).alias("doc"), F.col(text).cast("string").alias("text")).where(
        F.col("key").isNotNull() & F.col("text").isNotNull()
    )


def query_classes(queries: DataFrame, min_words: int) -> DataFrame:
    """Rows (key, query, n, text) of the texts with at least `min_words` words."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, off = words(b.column(1).to_pylist())
            n = np.diff(off)
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(sequence_hash(h, off).view(np.int64)), pa.array(n.astype(np.int32)), b.column(1)], names=["key", "query", "n", "text"])
            yield out.filter(pa.array(n >= min_words))

    return queries.select("key", "text").mapInArrow(number, "key string, query long, n int, text string")


def _emit(seeds: Seeds, marks, bits: int, min_words: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, off = words(b.column(1).to_pylist())
            x, row, size = seeds(h, off)
            m = np.diff(off)[row] >= min_words
            if marks is not None:
                m &= bounded.in_bitmap(marks.value, x, bits)
            x, row, size = x[m], row[m], size[m].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), b.column(0).take(pa.array(row)), pa.array(size)], names=["h", "id", "n"])

    return emit


def candidates(classes: DataFrame, corpus: DataFrame, query_seeds: Seeds, corpus_seeds: Seeds, allowed: Column | None, min_words: int, name: str, least: Column | int = 1) -> DataFrame:
    """The (doc, query) that share `least` seeds. `allowed` is over q.n and c.n, `least` may be over `n`, the larger of both."""
    spark = corpus.sparkSession
    schema = "h long, id long, n int"
    one = classes.select("query", "text").dropDuplicates(["query"])
    seeds = materialize(one.mapInArrow(_emit(query_seeds, None, 0, 0), schema).distinct(), f"{name}-seeds")
    bits = bounded.bitmap_bits(seeds.count())
    marks = spark.sparkContext.broadcast(bounded.hash_bitmap(seeds, "h", bits))
    hits = corpus.select("doc", "text").mapInArrow(_emit(corpus_seeds, marks, bits, min_words), schema).distinct()
    q, c = seeds.alias("q"), hits.alias("c")
    on = F.col("q.h") == F.col("c.h")
    pairs = c.join(q, on if allowed is None else on & allowed).select(F.col("c.id").alias("doc"), F.col("q.id").alias("query"), F.greatest("q.n", "c.n").alias("n"))
    shared = pairs.groupBy("doc", "query").agg(F.count("*").alias("shared"), F.max("n").alias("n"))
    return materialize(shared.where(F.col("shared") >= least).select("doc", "query"), f"{name}-candidates")


def with_texts(pairs: DataFrame, classes: DataFrame, corpus: DataFrame) -> DataFrame:
    """The candidates with both texts: (doc, query, ..., c_text, q_text).

    The queries' texts are joined first, while rows are small; corpus texts come last, each
    distinct one once, by `doc`, so a query with many partners never gathers their texts.
    """
    marked = bounded.hash_bitmap(pairs, "doc", MARK_BITS)
    few = bounded.keep_marked(corpus.select("doc", "text"), "doc", marked, MARK_BITS).dropDuplicates(["doc"])
    one = classes.select("query", F.col("text").alias("q_text")).dropDuplicates(["query"])
    return pairs.join(one, "query").join(few.withColumnRenamed("text", "c_text"), "doc")


def expand(found: DataFrame, classes: DataFrame, corpus: DataFrame) -> DataFrame:
    """Rows of `found` for each key of both sides: (query_key, corpus_key, ...)."""
    rest = [c for c in found.columns if c not in ("doc", "query")]
    keys_q = classes.select("query", F.col("key").alias("query_key")).distinct()
    keys_c = corpus.select("doc", F.col("key").alias("corpus_key")).distinct()
    return found.join(keys_c, "doc").join(keys_q, "query").select("query_key", "corpus_key", *rest)
