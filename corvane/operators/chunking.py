"""Cutting documents into flat chunks, or parents with children."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import blank_words


def _pieces(words: Column, size: int, step: int) -> Column:
    n = F.when(F.size(words) > 0, F.ceil(F.greatest(F.size(words) - (size - step), F.lit(1)) / step)).otherwise(0).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.slice(words, i * step + 1, F.lit(size)))


def chunk_flat(docs: DataFrame, key: str, text: str, size: int = 128, overlap: int = 0) -> DataFrame:
    """Rows (key, ix, chunk_id, text) of `size` words; the last may be shorter.

    A null or blank text gives no row. `overlap` words are shared by neighbours.
    """
    if size <= 0:
        raise ValueError("size must be positive")
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    cut = docs.select(F.col(key), F.posexplode(_pieces(blank_words(text), size, size - overlap)).alias("ix", "w"))
    return cut.select(key, "ix", F.concat(F.col(key).cast("string"), F.lit("::chunk-"), F.col("ix")).alias("chunk_id"), F.array_join("w", " ").alias("text"))


def _parents(docs: DataFrame, key: str, text: str, child: int, parent: int) -> DataFrame:
    if child <= 0 or parent <= 0:
        raise ValueError("sizes must be positive")
    if parent < child:
        raise ValueError("a parent must be at least as large as a child")
    w = docs.select(F.col(key), F.posexplode(_pieces(blank_words(text), parent, parent)).alias("parent_ix", "w"))
    return w.withColumn("parent_id", F.concat(F.col(key).cast("string"), F.lit("::parent-"), F.col("parent_ix")))


def chunk_parents(docs: DataFrame, key: str, text: str, child: int = 64, parent: int = 512) -> DataFrame:
    """Rows (key, parent_ix, chunk_id, text)."""
    p = _parents(docs, key, text, child, parent)
    return p.select(key, "parent_ix", F.col("parent_id").alias("chunk_id"), F.array_join("w", " ").alias("text"))


def chunk_children(docs: DataFrame, key: str, text: str, child: int = 64, parent: int = 512) -> DataFrame:
    """Rows (key, parent_ix, child_ix, chunk_id, parent_id, text).

    Children never cross a parent, and are numbered through their document: all earlier
    parents are full, so a child's number follows from its parent's.
    """
    p = _parents(docs, key, text, child, parent)
    c = p.select(key, "parent_ix", "parent_id", F.posexplode(_pieces(F.col("w"), child, child)).alias("in_parent", "w"))
    ix = F.col("parent_ix") * (-(-parent // child)) + F.col("in_parent")
    return c.select(key, "parent_ix", ix.alias("child_ix"), F.concat(F.col(key).cast("string"), F.lit("::child-"), ix).alias("chunk_id"), "parent_id", F.array_join("w", " ").alias("text"))


def chunk_hierarchy(docs: DataFrame, key: str, text: str, child: int = 64, parent: int = 512) -> DataFrame:
    """Parents and children in one relation (chunk_id, source, text, parent_id, parent_ix, child_ix)."""
    p = chunk_parents(docs, key, text, child, parent).select("chunk_id", F.col(key).cast("string").alias("source"), "text", F.lit(None).cast("string").alias("parent_id"), "parent_ix", F.lit(None).cast("int").alias("child_ix"))
    c = chunk_children(docs, key, text, child, parent).select("chunk_id", F.col(key).cast("string").alias("source"), "text", "parent_id", "parent_ix", "child_ix")
    return p.unionByName(c)
