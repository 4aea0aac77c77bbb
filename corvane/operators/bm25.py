"""Sparse retrieval over an inverted index held as relations.

A document's postings lie together in one row, so they are scored where they are read:
the weights of a block of queries go to all tasks, each task keeps its k best documents
of each query, and only these are shuffled, however frequent a term is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corvane.functions.text import word_set, word_tokens
from corvane.operators.topk import Best, in_order, products, rows_at_once

#: Most terms of queries, and most queries, that are sent to all executors at once.
MOST_TERMS, MOST_QUERIES = 1_000_000, 20_000
#: Terms of this share of a block's queries are multiplied as a dense matrix.
FREQUENT = 0.05


class Index:
    """docs(doc_id, len, terms, tfs) with a document's distinct terms and their counts,
    terms(term, df), totals(n, avgdl)."""

    def __init__(self, docs: DataFrame, terms: DataFrame, totals: DataFrame) -> None:
        self.docs, self.terms, self.totals = docs, terms, totals

    @property
    def postings(self) -> DataFrame:
        """Rows (term, doc_id, tf)."""
        p = F.explode(F.arrays_zip("terms", "tfs")).alias("p")
        return self.docs.select("doc_id", p).select("p.terms", "doc_id", "p.tfs").toDF("term", "doc_id", "tf")

    @property
    def lengths(self) -> DataFrame:
        return self.docs.select("doc_id", "len")

    def save(self, path: str) -> None:
        """The statistics are taken from what was written."""
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        written = from_docs(self.docs.sparkSession.read.parquet(f"{path}/docs"))
        written.terms.write.mode("overwrite").parquet(f"{path}/terms")
        written.totals.write.mode("overwrite").parquet(f"{path}/totals")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        return Index(*[spark.read.parquet(f"{path}/{name}") for name in ("docs", "terms", "totals")])


def _counted():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = b.column(1)
            n = pc.list_value_length(w).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = w.flatten().dictionary_encode()
            code = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            joint, tf = np.unique(np.repeat(np.arange(len(n)), n) * (len(flat.dictionary) + 1) + code, return_counts=True)
            row, code = np.divmod(joint, len(flat.dictionary) + 1)
            offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(n))))).astype(np.int32))
            terms = pa.ListArray.from_arrays(offsets, flat.dictionary.take(pa.array(code)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), terms, pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32)))], names=["doc_id", "len", "terms", "tfs"])

    return run


def build(docs: DataFrame, key: str, text: str) -> Index:
    """Null texts count as empty; an empty document has length 0 and counts in the totals."""
    tokens = docs.select(F.col(key).alias("doc_id"), word_tokens(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    docs_ = tokens.mapInArrow(_counted(), f"doc_id {dict(tokens.dtypes)['doc_id']}, len bigint, terms array<string>, tfs array<int>")
    # The statistics come from the tokens: who wants only these needs no Python.
    terms = tokens.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    totals = tokens.agg(F.count("*").alias("n"), F.avg(F.size("w").cast("bigint")).alias("avgdl"))
    return Index(docs_, terms, totals)


def from_docs(docs: DataFrame) -> Index:
    """An index over documents with counted terms, with their statistics."""
    terms = docs.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    totals = docs.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))
    return Index(docs, terms, totals)


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def top(scored: DataFrame, by: str, k: Column | int, key: str = "doc_id") -> DataFrame:
    """The k best of each `by`, with ranks from 1; ties by the smaller key."""
    w = Window.partitionBy(by).orderBy(F.round("score", 9).desc(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _search_block(terms: np.ndarray, query: np.ndarray, weight: np.ndarray, names: list[str], queries: pa.Array, k: int, value: Callable[[np.ndarray, np.ndarray], np.ndarray], most: float):
    """The k best documents of each query in a task's part of the index. Entries (term, query,
    weight) refer to `names` and `queries`; a term's count and the document's length give a
    `value` of at most `most`.

    All cells are scored in single precision, and those that can be among the best again in double.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(queries)
        dense = np.flatnonzero(np.bincount(terms, minlength=len(names)) > FREQUENT * n)
        place = np.full(len(names), -1)
        place[dense] = np.arange(len(dense))
        matrix = np.zeros((n, len(dense)))
        m = place[terms] >= 0
        matrix[query[m], place[terms[m]]] = weight[m]
        single = np.ascontiguousarray(matrix.T, np.float32)
        o = np.flatnonzero(~m)
        o = o[np.argsort(terms[o], kind="stable")]
        rare_query, rare_weight = query[o], weight[o]
        begin = np.searchsorted(terms[o], np.arange(len(names) + 1))
        # No score is further off than a unit of its sum's last place for each term.
        margin = np.bincount(query, weight, n) * most * (np.bincount(query, minlength=n) + 8) * 2.0**-23
        best, known = None, pa.array(names, pa.string())
        step = rows_at_once(max(n, len(dense)))
        wanted = np.zeros(step * n, bool)
        for whole in batches:
            if best is None:
                best = Best(n, k, whole.column(0).type)
            listed = whole.column("terms")
            length = pc.list_value_length(listed).to_numpy(zero_copy_only=False).astype(np.int64)
            code = pc.fill_null(pc.index_in(listed.flatten(), known), -1).to_numpy(zero_copy_only=False)
            some = np.flatnonzero(code >= 0)
            code, row = code[some], np.repeat(np.arange(whole.num_rows), length)[some]
            values = value(whole.column("tfs").flatten().to_numpy(zero_copy_only=False)[some], whole.column("len").to_numpy(zero_copy_only=False)[row])
            for at in range(0, whole.num_rows, step):
                rows = min(step, whole.num_rows - at)
                lo, hi = np.searchsorted(row, (at, at + rows))
                c, r, v = code[lo:hi], row[lo:hi] - at, values[lo:hi]
                often = place[c] >= 0
                counts = np.zeros((rows, len(dense)))
                counts[r[often], place[c[often]]] = v[often]
                scores = counts.astype(np.float32) @ single
                c, r, v = c[~often], r[~often], v[~often]
                each = begin[c + 1] - begin[c]
                entry = np.repeat(begin[c], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                cell = np.repeat(r * n, each) + rare_query[entry]
                x = np.repeat(v, each) * rare_weight[entry]
                np.add.at(scores.reshape(-1), cell, x.astype(np.float32))
                # Weights are above 0, so a document without a term of the query has exactly 0.
                hit, q = best.likely(scores, margin, above_zero=True)
                if not len(hit):
                    continue
                cells = hit * n + q
                wanted[cells] = True
                of = np.flatnonzero(wanted[cell])
                wanted[cells] = False
                exact = products(counts, hit, matrix, q)
                exact += np.bincount(np.searchsorted(cells, cell[of]), x[of], len(cells))
                best.put(hit, q, exact, whole.column(0).slice(at, rows))
        if best is not None and len(best.query):
            yield pa.RecordBatch.from_arrays([queries.take(pa.array(best.query)), best.key, pa.array(best.score)], names=["query", "doc_id", "score"])

    return run


def scan(docs: DataFrame, weights: DataFrame, k: int, weigh: Callable[[np.ndarray], np.ndarray], value: Callable[[np.ndarray, np.ndarray], np.ndarray], most: float) -> DataFrame | None:
    """Rows (query, doc_id, score) with the k best of each task's documents for each query, at
    least; None without queries.

    `docs` has (doc_id, len, terms, tfs), `weights` rows (query, term, df), of which `weigh`
    makes weights above 0. Queries go out in blocks of bounded size.
    """
    kind = weights.schema["query"].dataType
    schema = f"query {kind.simpleString()}, doc_id {dict(docs.dtypes)['doc_id']}, score double"
    # Fewer parts than cores stay as they are; more would send more lists of k each.
    docs = docs.coalesce(docs.sparkSession.sparkContext.defaultParallelism)
    found, block, number = None, {"term": [], "query": [], "df": []}, {}

    def flush(found: DataFrame | None) -> DataFrame:
        names, terms = np.unique(np.array(block["term"], object), return_inverse=True)
        weight = weigh(np.array(block["df"], np.float64))
        run = _search_block(terms, np.array(block["query"], np.int64), weight, names.tolist(), pa.array(list(number), to_arrow_type(kind)), k, value, most)
        part = docs.mapInArrow(run, schema)
        return part if found is None else found.unionByName(part)

    # One row for each query: a row for each term takes the driver ten times as long.
    lists = weights.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("term", "df"))).alias("t")).select("query", "t.term", "t.df")
    for r in in_order(lists, "query", most=5000):
        if number and (len(block["term"]) >= MOST_TERMS or len(number) >= MOST_QUERIES):
            found = flush(found)
            block, number = {"term": [], "query": [], "df": []}, {}
        block["term"] += r["term"]
        block["query"] += [len(number)] * len(r["term"])
        block["df"] += r["df"]
        number[r["query"]] = len(number)
    return flush(found) if number else found


def search(index: Index, queries: DataFrame, query_key: str, query_text: str, k: int = 5, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Rows (query, doc_id, score, rank) of the k best documents.

    Each distinct term of a query counts once, in ties the smaller key comes first. Documents
    without a term of the query, empty queries and those of unknown terms give no row. Queries
    go out in blocks of bounded size, each of which reads the index once.
    """
    q = queries.select(F.col(query_key).alias("query"), F.explode(word_set(query_text)).alias("term"))
    totals = index.totals.first()
    avgdl = totals["avgdl"] or 1.0

    def value(tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avgdl))

    found = scan(index.docs, q.join(index.terms, "term"), k, lambda df: np.log(1 + (totals["n"] - df + 0.5) / (df + 0.5)), value, k1 + 1)
    if found is None:
        found = queries.sparkSession.createDataFrame([], f"query {dict(queries.dtypes)[query_key]}, doc_id {dict(index.docs.dtypes)['doc_id']}, score double")
    return top(found.withColumnRenamed("query", query_key), query_key, k)
