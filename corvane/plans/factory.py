"""From a run's settings and folders to what it needs, made once for each session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import bm25
from corvane.plans import embeddings, pipeline
from corvane.plans.clients import Client
from corvane.session import materialize
from corvane.sources import tables
from corvane.sources.config import RunConfig

_catalog: dict[tuple[str, str, type], tuple[DataFrame, bm25.Index, DataFrame]] = {}


def retrieval_tables(spark: SparkSession, path: str, embedding: type = embeddings.HashEmbedding) -> tuple[DataFrame, bm25.Index, DataFrame]:
    """The passages, sparse index and vectors of an index folder, opened once for each session.

    Vectors that the folder lacks are made by the embedding client and written.
    """
    key = (spark.sparkContext.applicationId, path, embedding)
    if key not in _catalog:
        passages, index = tables.load_index(spark, path)
        if tables._exists(spark, f"{path}/vectors"):
            v = tables.read_vectors(spark, f"{path}/vectors")
            vectors = v.toDF("passage_id", "v")
        else:
            searched = passages.join(index.docs.select(F.col("doc_id").alias("passage_id")), "passage_id", "left_semi")
            vectors = materialize(searched.select("passage_id", embeddings.vector(F.col("text"), embedding).alias("v")), "vectors")
        _catalog[key] = passages, index, vectors
    return _catalog[key]


def forget(spark: SparkSession) -> None:
    """Open folders anew from now on."""
    for key in [k for k in _catalog if k[0] == spark.sparkContext.applicationId]:
        del _catalog[key]


def build_stack(spark: SparkSession, config: RunConfig, client: Callable[[], Client], index: str | None = None, cases: str | None = None, embedding: type = embeddings.HashEmbedding, **rest) -> pipeline.Engine:
    """An engine over an index folder and a folder of memory cases; without an index nothing is found."""
    known = tables.read_memory(spark, cases) if cases else None
    if index:
        return pipeline.build_engine(spark, config, client, *retrieval_tables(spark, index, embedding), known, embedding, **rest)
    empty = "question_id string, passage_id string, source string, text string, score double, rank int"
    return pipeline.Engine(spark, config, client, lambda queries, k: spark.createDataFrame([], empty), known, **rest)
