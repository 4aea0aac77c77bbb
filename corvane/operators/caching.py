"""Requests against tables of earlier results: hits, misses and their completion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import materialize


def hits(requests: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    return requests.join(cache.select(key).distinct(), key, "left_semi")


def misses(requests: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """The requests to compute: not cached, each key once."""
    return requests.join(cache.select(key).distinct(), key, "left_anti").dropDuplicates([key])


def complete(requests: DataFrame, cache: DataFrame, compute: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """The requests joined with their results, and the results that are new.

    `compute` gets batches of misses and gives rows (key, results...) of `schema`. New
    results are written once before they are used, so a task that runs twice can't give
    two answers; a key that is cached twice counts once.
    """
    new = materialize(misses(requests, cache, key).mapInPandas(compute, schema).dropDuplicates([key]), "computed")
    known = cache.dropDuplicates([key]).select(*new.columns).unionByName(new)
    return requests.join(known, key, "left"), new


def append(new: DataFrame, path: str) -> None:
    new.write.mode("append").parquet(path)


def embed_missing(texts: DataFrame, cache: DataFrame, embed: Callable[[list[str]], list[list[float]]], key: str = "cache_key", batch: int = 16) -> tuple[DataFrame, DataFrame]:
    """`texts` (ordinal, key, text) with `vector`, in any order; `embed` sees misses only, in batches."""

    def compute(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                yield pd.DataFrame({key: part[key], "vector": embed(part["text"].tolist())})

    return complete(texts, cache, compute, f"{key} string, vector array<float>", key)


def split_report(requests: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """One row (n_requests, n_keys, n_hits, n_to_compute)."""
    marked = requests.join(cache.select(key).distinct().withColumn("hit_", F.lit(1)), key, "left")
    return marked.agg(F.count("*").alias("n_requests"), F.countDistinct(key).alias("n_keys"), F.count("hit_").alias("n_hits"), F.countDistinct(F.when(F.col("hit_").isNull(), F.col(key))).alias("n_to_compute"))
