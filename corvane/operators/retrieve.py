"""The whole retrieval of passages for a table of queries, as one plan."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.tools import hyde_context
from corvane.operators import bm25, fusion


@dataclass(frozen=True)
class Settings:
    """The switches of a retrieval."""

    top_k: int = 2
    buffer: int = 2
    relevance: float = 0.0
    option_boosting: bool = False
    option_weight: float = 0.05
    dynamic_k: bool = False
    compression: bool = False
    entity_rerank: bool = False
    pruning: bool = False
    synonyms: bool = False
    mmr: bool = False
    mmr_weight: float = 0.7
    hybrid: bool = True
    hyde: bool = False

    def label(self) -> str:
        """All switches as a text, for keys."""
        return " ".join(f"{f.name}={getattr(self, f.name)}" for f in fields(self))

    @staticmethod
    def from_config(config) -> Settings:
        return Settings(
            config.rag_top_k, config.rag_retrieval_buffer, config.rag_relevance_threshold, config.rag_use_option_boosting, config.rag_option_boost_weight, config.rag_dynamic_top_k,
            config.rag_heuristic_compression, config.rag_use_reranker, config.rag_use_query_pruning, config.rag_use_synonym_expansion, config.rag_use_mmr, config.rag_mmr_lambda, config.rag_use_hybrid, config.rag_use_hyde,
        )


def rewrite(queries: DataFrame, text: str, s: Settings, hyde: str | None = None) -> DataFrame:
    """Queries with `search_text`: pruned, widened by synonyms and, with `s.hyde`, by a
    hypothetical passage: that of column `hyde`, else one made from the query."""
    c = F.col(text)
    if s.pruning:
        c = T.prune_query(c)
    q = queries.withColumn("search_text", c)
    if s.synonyms:
        q = q.withColumn("search_text", T.expand_synonyms("search_text"))
    if s.hyde or hyde:
        passage = T.stripped(F.col(hyde) if hyde else hyde_context(F.col("search_text")))
        q = q.withColumn("search_text", F.concat_ws(" ", "search_text", F.when(passage != "", passage)))
    return q


def fuse(dense: DataFrame | None, sparse: DataFrame | None, query: str, s: Settings) -> DataFrame:
    """One list from the dense and the sparse one, each cut to its fetch size."""
    n = fusion.fetch_size(s.top_k, s.buffer, s.mmr, s.hybrid)
    if s.hybrid:
        return fusion.rrf(dense.where(F.col("rank") <= n), sparse.where(F.col("rank") <= n), query)
    return dense.where(F.col("rank") <= n)


def finish(hits: DataFrame, queries: DataFrame, query: str, text: str, passages: DataFrame, s: Settings, options: str | None = None) -> DataFrame:
    """From a fused list (query, passage_id, score, rank) to the passages that are returned:
    boosts, dynamic k, threshold, one hit for each parent, compression and diversity.

    `queries` has (query, text, search_text and, if named, options), one row for each query.
    """
    cols = [query, F.col(text).alias("q_text"), "search_text"] + ([F.col(options).alias("q_options")] if options else [])
    asked = queries.select(*cols)
    boosted = s.option_boosting and options and s.hybrid or s.entity_rerank
    if boosted:
        h = fusion.with_context(hits, passages).join(asked, query)
    else:
        # Only the hits that stay need their texts.
        h = hits.join(passages.select("passage_id", "parent_id"), "passage_id")
    if s.option_boosting and options and s.hybrid:
        h = fusion.boost_options(h.withColumn("words_o", F.coalesce(fusion.option_words(F.col("q_options")), F.array().cast("array<string>"))), "words_o", s.option_weight).drop("words_o")
        h = fusion.rerank(h, query)
    if s.entity_rerank:
        own = F.array_union(T.entities("search_text"), T.entities("q_text"))
        if options:
            own = F.array_union(own, F.coalesce(F.flatten(F.transform(F.map_values("q_options"), lambda o: T.entities(o))), F.array().cast("array<string>")))
        h = fusion.boost_entities(h.withColumn("ents_", own), "ents_").drop("ents_")
        h = fusion.rerank(h, query)
    h = fusion.dynamic_limit(h, query, s.top_k) if s.dynamic_k and s.hybrid else h.withColumn("limit_", F.lit(s.top_k))
    h = fusion.first_of_parents(fusion.threshold(h, s.relevance), query)
    if not s.mmr:
        h = h.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy("rank"))).where(F.col("rank") <= F.col("limit_"))
    if not boosted:
        h = fusion.with_context(h.drop("parent_id"), passages).join(asked, query)
    h = fusion.as_parents(h)
    if s.compression:
        words = T.keywords("q_text")
        if options:
            words = F.array_union(words, F.coalesce(fusion.option_words(F.col("q_options")), F.array().cast("array<string>")))
        h = h.withColumn("text", T.compress_sentences("text", words))
    h = h.select(query, "passage_id", "source", "text", "score", "rank", "limit_")
    if s.mmr:
        h = fusion.mmr_skip(h, query, s.top_k, s.mmr_weight)
    return h.where(F.col("rank") <= F.col("limit_")).drop("limit_")


def retrieve(queries: DataFrame, query: str, text: str, passages: DataFrame, s: Settings, index: bm25.Index | None, dense_hits, options: str | None = None, hyde: str | None = None) -> DataFrame:
    """Rows (query, passage_id, source, text, score, rank).

    `dense_hits(queries with search_text, k)` gives the dense list, so any embedding may
    stand behind it; `index` is that of the passages to search.
    """
    q = rewrite(queries, text, s, hyde)
    n = fusion.fetch_size(s.top_k, s.buffer, s.mmr, s.hybrid)
    dense = dense_hits(q, n)
    sparse = bm25.search(index, q, query, "search_text", n).withColumnRenamed("doc_id", "passage_id") if s.hybrid else None
    return finish(fuse(dense, sparse, query, s), q, query, text, passages, s, options)
