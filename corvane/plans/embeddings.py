"""Embedding clients: passages and queries to vectors, over batches, with a table of earlier ones."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import hashing
from corvane.operators import caching


class EmbeddingClient(Protocol):
    """Passages and queries may have encoders of their own. `name` is part of the cache key."""

    name: str

    def embed_passages(self, texts: list[str]) -> list[list[float]]: ...

    def embed_queries(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedding:
    """A stand-in without a model: how many words fall on each first hex digit of their MD5, of
    unit length. Words met before are looked up."""

    name = "hash-16"
    dims = 16

    def __init__(self) -> None:
        self._place: dict[str, int] = {}

    def _digit(self, word: str) -> int:
        if word not in self._place:
            if len(self._place) > 1_000_000:
                self._place.clear()
            self._place[word] = int(hashlib.md5(word.encode("utf-8", "replace")).hexdigest()[0], 16)
        return self._place[word]

    def embed_passages(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dims))
        for i, t in enumerate(texts):
            for w, n in Counter(re.findall(r"\w+", t.lower()) if isinstance(t, str) else ()).items():
                out[i, self._digit(w)] += n
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, norm, out=out, where=norm > 0).tolist()

    embed_queries = embed_passages


_clients: dict[type, EmbeddingClient] = {}


def client_of(make: type) -> EmbeddingClient:
    """The client of this process, made once."""
    if make not in _clients:
        _clients[make] = make()
    return _clients[make]


def vector(text: Column, make: type = HashEmbedding, kind: str = "passage") -> Column:
    """The vectors of a column, by a pandas function over batches."""

    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = client_of(make)
        run = c.embed_passages if kind == "passage" else c.embed_queries
        for texts in batches:
            yield pd.Series(run(texts.tolist()))

    embed.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(embed, "array<double>")(text)


def cached_vectors(texts: DataFrame, text: str, cache: DataFrame, make: type = HashEmbedding, kind: str = "query") -> tuple[DataFrame, DataFrame]:
    """`texts` with `vector`, and the rows (cache_key, vector) that are new. Only texts that the
    cache lacks reach the client, each once; a single text is a table of one row. Queries and
    passages have keys of their own."""
    keyed = texts.withColumn("cache_key", hashing.embedding_key(F.lit(kind), F.col(text), F.lit(make.name)))

    def embed(some: list[str]) -> list[list[float]]:
        c = client_of(make)
        return c.embed_passages(some) if kind == "passage" else c.embed_queries(some)

    return caching.embed_missing(keyed.withColumn("text", F.col(text)) if text != "text" else keyed, cache, embed)
