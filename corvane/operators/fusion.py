"""Fusing, boosting, cutting and diversifying ranked lists of passages.

A list of hits is a relation (query, passage_id, score, rank) with ranks from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T


def _order(*columns: str) -> list[Column]:
    return [F.round("score", 9).desc(), *(F.col(c) for c in columns)]


def rerank(hits: DataFrame, query: str, key: str = "passage_id") -> DataFrame:
    """Ranks anew by falling score, ties by the smaller key."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*_order(key))))


def rrf(dense: DataFrame, sparse: DataFrame, query: str, key: str = "passage_id", constant: int = 60, rank_base: int = 0) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (constant + rank), ranks counted from `rank_base`."""
    both = dense.select(query, key, "rank").unionByName(sparse.select(query, key, "rank"))
    return rerank(both.groupBy(query, key).agg(F.sum(1.0 / (constant + F.col("rank") - 1 + rank_base)).alias("score")), query, key)


def merge_queries(hits: DataFrame, query: str, part: str, k: int, key: str = "passage_id") -> DataFrame:
    """Of the hits of several sub-queries, each passage once with its best score, the k best."""
    first = F.row_number().over(Window.partitionBy(query, key).orderBy(F.round("score", 9).desc(), F.col(part)))
    once = hits.withColumn("first_", first).where("first_ = 1").drop("first_")
    w = Window.partitionBy(query).orderBy(F.round("score", 9).desc(), F.col(part), F.col(key))
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def threshold(hits: DataFrame, least: float) -> DataFrame:
    return hits.where(F.col("score") >= least)


def fetch_size(k: int, buffer: int = 2, mmr: bool = False, hybrid: bool = False) -> int:
    """How many hits to fetch so that k are left after siblings and copies are dropped."""
    n = (2 * k if mmr else k) + buffer
    return 2 * n if hybrid else n


def with_context(hits: DataFrame, passages: DataFrame, key: str = "passage_id") -> DataFrame:
    """Hits with their passage (source, text, parent_id) and the parent's (parent_source, parent_text).

    Hits without a passage are dropped; a missing parent leaves nulls. Passages must be
    unique by id.
    """
    own = passages.select(F.col("passage_id").alias(key), "source", "text", "parent_id")
    parents = passages.select(F.col("passage_id").alias("parent_id"), F.col("source").alias("parent_source"), F.col("text").alias("parent_text"))
    return hits.join(own, key).join(parents, "parent_id", "left")


def full_text() -> Column:
    """The passage's text followed by its parent's."""
    return F.concat_ws(" ", F.coalesce(F.col("text"), F.lit("")), F.col("parent_text"))


def option_words(options: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.map_values(options), lambda o: T.keywords(o)))))


def boost_options(hits: DataFrame, words: str, weight: float = 0.05) -> DataFrame:
    """score + weight where the passage or its parent has one of the options' keywords."""
    hit = F.arrays_overlap(T.word_tokens(full_text()), F.col(words))
    return hits.withColumn("score", F.col("score") + F.when(hit, weight).otherwise(0.0))


def boost_entities(hits: DataFrame, entities: str, weight: float = 0.10) -> DataFrame:
    """score + weight for each entity of the query in the passage or its parent."""
    n = F.size(F.array_intersect(T.entities(full_text()), F.col(entities)))
    return hits.withColumn("score", F.col("score") + weight * n)


def dynamic_limit(hits: DataFrame, query: str, k: int) -> DataFrame:
    """With `limit_`: fewer than k where the best score shows high confidence."""
    best = F.max("score").over(Window.partitionBy(query))
    limit = F.when(best >= 0.030, max(1, k - 2)).when(best >= 0.026, max(1, k - 1)).otherwise(k)
    return hits.withColumn("limit_", limit)


def first_of_parents(hits: DataFrame, query: str, key: str = "passage_id") -> DataFrame:
    """The first hit of each parent; one without a parent stands for itself."""
    group = F.coalesce("parent_id", key)
    first = F.row_number().over(Window.partitionBy(query, group).orderBy("rank"))
    return hits.withColumn("first_", first).where("first_ = 1").drop("first_")


def as_parents(hits: DataFrame) -> DataFrame:
    """Hits with the text and source of their parents, where these have a text."""
    has = F.col("parent_text").isNotNull()
    return hits.withColumn("source", F.when(has, F.col("parent_source")).otherwise(F.col("source"))).withColumn("text", F.coalesce("parent_text", "text"))


def dedup_parents(hits: DataFrame, query: str, key: str = "passage_id") -> DataFrame:
    """The first hit of each parent. It keeps its own id and takes the parent's text and source."""
    return as_parents(first_of_parents(hits, query, key))


def rescore(hits: DataFrame, query: str, query_text: str, key: str = "passage_id") -> DataFrame:
    """Scores raised by shared words; the order of equal scores stays."""
    s = hits.withColumn("score", T.rescore(query_text, "text", F.col("score")))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.round("score", 9).desc(), F.col("rank"))))


def _folded(hits: DataFrame, query: str) -> DataFrame:
    """The hits of each query as one array, in order of rank. Lists are at most the fetch size long."""
    item = F.struct("rank", "score", *[c for c in hits.columns if c not in (query, "rank", "score")], T.word_set(F.coalesce(F.col("text"), F.lit(""))).alias("words_"))
    return hits.groupBy(query).agg(F.array_sort(F.collect_list(item)).alias("h"))


def _unfolded(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    out = df.select(query, F.posexplode("picked").alias("pos_", "x"))
    return out.select(query, *[F.col(f"x.{c}") for c in columns if c not in (query, "rank")], (F.col("pos_") + 1).alias("rank")).select(*columns)


def _most_alike(words: Column, picked: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(picked, lambda p: T.jaccard(words, p["words_"]))), F.lit(0.0))


def mmr_skip(hits: DataFrame, query: str, k: int, weight: float = 0.7) -> DataFrame:
    """In order of rank, up to k hits; one is skipped if weight * score - (1 - weight) *
    (largest overlap with those taken) is negative. Without text a hit is like none."""
    lists = _folded(hits, query)
    empty = F.filter(F.col("h"), lambda x: F.lit(False))

    def step(acc: Column, x: Column) -> Column:
        adjusted = weight * x["score"] - (1 - weight) * _most_alike(x["words_"], acc)
        take = (F.size(acc) < k) & ((F.size(acc) == 0) | (adjusted >= 0))
        return F.when(take, F.concat(acc, F.array(x))).otherwise(acc)

    return _unfolded(lists.withColumn("picked", F.aggregate("h", empty, step)), query, hits.columns)


def mmr_greedy(hits: DataFrame, query: str, k: int, weight: float = 0.7) -> DataFrame:
    """Maximal marginal relevance: the first hit, then again and again the one with the
    largest weight * score - (1 - weight) * (largest overlap with those taken), the
    earlier of equals. A list of at most k hits stays as it is."""
    lists = _folded(hits, query)
    empty = F.filter(F.col("h"), lambda x: F.lit(False))

    def step(acc: Column, _: Column) -> Column:
        left = F.filter(F.col("h"), lambda x: ~F.exists(acc, lambda p: p["rank"] == x["rank"]))
        scored = F.transform(left, lambda x: F.struct(F.round(weight * x["score"] - (1 - weight) * _most_alike(x["words_"], acc), 12).alias("s"), (-x["rank"]).alias("r"), x.alias("x")))
        best = F.array_max(F.transform(scored, lambda y: F.struct(y["s"], y["r"])))
        pick = F.transform(F.filter(scored, lambda y: (y["s"] == best["s"]) & (y["r"] == best["r"])), lambda y: y["x"])
        return F.when(F.size(acc) == 0, F.slice(F.col("h"), 1, 1)).otherwise(F.concat(acc, pick))

    chosen = F.aggregate(F.sequence(F.lit(1), F.lit(k)), empty, step)
    return _unfolded(lists.withColumn("picked", F.when(F.size("h") <= k, F.col("h")).otherwise(chosen)), query, hits.columns)


def token_budget(hits: DataFrame, query: str, total: int = 400) -> DataFrame:
    """Texts cut to max(2, total // hits) words and `...`, up to the one that reaches the total."""
    n = F.count("*").over(Window.partitionBy(query))
    share = F.greatest(F.lit(2), F.floor(F.lit(total) / n)).cast("int")
    w = T.blank_words("text")
    short = F.when(F.size(w) > share, F.concat(F.array_join(F.slice(w, F.lit(1), share), " "), F.lit("..."))).otherwise(F.col("text"))
    cut = hits.withColumn("text", short).withColumn("used_", F.coalesce(T.token_count("text"), F.lit(0)))
    before = F.coalesce(F.sum("used_").over(Window.partitionBy(query).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut.withColumn("before_", before).where(F.col("before_") < total).drop("used_", "before_")
