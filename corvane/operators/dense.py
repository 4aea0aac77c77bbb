"""Exact top-k search by inner product, in blocks of matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corvane.operators.topk import Best, in_order, products, rows_at_once

#: Most bytes of query vectors that are sent to all executors at once.
MOST_QUERY_BYTES = 64 << 20
#: Most queries of a block, so that a task scores many rows at once.
MOST_QUERIES = 20_000
#: Below this product of lengths, sums in single precision neither overflow nor lose more than their last places.
MOST_SINGLE = 1e18


def check_vectors(vectors: DataFrame, vector: str) -> int:
    """The common length of all vectors; an error if there is none or several."""
    row = vectors.agg(F.min(F.size(vector)).alias("lo"), F.max(F.size(vector)).alias("hi"), F.count("*").alias("n"), F.count(vector).alias("have")).first()
    if not row["n"] or row["have"] != row["n"] or row["lo"] != row["hi"] or row["lo"] < 1:
        raise ValueError("vectors must be present and of one length")
    return int(row["lo"])


def dense_topk(vectors: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, k: int = 5) -> DataFrame:
    """Rows (query_key, key, score, rank) of the k nearest; ties by the smaller key.

    The queries go out in blocks of at most MOST_QUERY_BYTES and MOST_QUERIES; each task scores
    slices of its rows of bounded size and keeps its k best for each query of a block, so
    only these are shuffled. Null vectors are left out.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    spark = vectors.sparkSession
    types = dict(vectors.dtypes)
    q_type = dict(queries.dtypes)[query_key]
    q = queries.where(F.col(query_vector).isNotNull()).select(F.col(query_key).alias("q"), F.col(query_vector).cast("array<double>").alias("v"))
    dims = vectors.agg(F.max(F.size(vector))).first()[0] or 1
    per_block = max(1, min(MOST_QUERIES, MOST_QUERY_BYTES // (8 * dims)))
    schema = f"`{query_key}` {q_type}, `{key}` {types[key]}, score double"
    found = None
    block: list = []

    def search(rows: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(([r["q"] for r in rows], np.array([r["v"] for r in rows], np.float64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, matrix = shared.value
            single = np.ascontiguousarray(matrix.T, np.float32)
            norm = np.sqrt((matrix * matrix).sum(axis=1))
            best, step = None, rows_at_once(len(ids))
            for whole in batches:
                if best is None:
                    best = Best(len(ids), k, whole.column(0).type)
                for at in range(0, whole.num_rows, step):
                    b = whole.slice(at, step)
                    flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                    most = norm.max() * np.sqrt((flat * flat).sum(axis=1).max())
                    if not most < MOST_SINGLE:
                        best.add(flat @ matrix.T, b.column(0))
                        continue
                    # All cells in single precision, those that can be among the best again in double.
                    margin = norm * (most / max(norm.max(), 1e-300)) * (matrix.shape[1] + 4) * 2.0**-23
                    row, query = best.likely(flat.astype(np.float32) @ single, margin)
                    best.put(row, query, products(flat, row, matrix, query), b.column(0))
            if best is not None and len(best.query):
                q_ids = pa.array(ids).take(pa.array(best.query))
                yield pa.RecordBatch.from_arrays([q_ids.cast(to_arrow_type(q_kind)), best.key, pa.array(best.score)], names=[query_key, key, "score"])

        q_kind = queries.schema[query_key].dataType
        return vectors.where(F.col(vector).isNotNull()).select(key, vector).coalesce(spark.sparkContext.defaultParallelism).mapInArrow(run, schema)

    for r in in_order(q, "q"):
        block.append(r)
        if len(block) == per_block:
            part = search(block)
            found = part if found is None else found.unionByName(part)
            block = []
    if block or found is None:
        part = search(block) if block else spark.createDataFrame([], schema)
        found = part if found is None else found.unionByName(part)
    w = Window.partitionBy(query_key).orderBy(F.round("score", 9).desc(), F.col(key))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
