"""The registered queries of the core operators over the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import hashing, parsing, tools
from corvane.functions import text as T
from corvane.operators import bm25, caching, chunking, dag, dataset, dense, evaluation, fusion, memory, retrieve, sampling
from corvane.plans import clients, embeddings, pipeline
from corvane.session import materialize, read_table, scratch_dir, ship_package, stored
from corvane.sources.config import RunConfig
from corvane.sources.tables import build_index, load_index, passage_table, read_chunks, read_predictions, read_questions, write_chunks, write_predictions
from corvane.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
VARIANTS = ["V0", "V1", "V2", "V3", "V4"]
PAIRS = [("V0", "V1"), ("V1", "V2"), ("V2", "V3"), ("V4", "V3"), ("V0", "V3")]
LETTERS = ("A", "B", "C", "D", "E")
#: The kept index with the version of what lies in it.
INDEX = "index-v2"


def _questions(s: SparkSession, d: str) -> DataFrame:
    """One row for each id; stems of rows exported twice are equal."""
    q = read_table(s, d, "questions").where("question_id is not null")
    one = q.groupBy("question_id").agg(F.max(F.struct(F.coalesce("question", F.lit("")).alias("question"), F.map_entries("options").alias("o"), "answer", "source")).alias("m"))
    return one.select("question_id", "m.question", F.map_from_entries("m.o").alias("options"), "m.answer", "m.source")


def _held_out(q: DataFrame) -> DataFrame:
    return q.where(F.col("question_id").startswith("dev-") | F.col("question_id").startswith("test-"))


def _searches(s: SparkSession, d: str) -> DataFrame:
    """The query set of the searches: evaluation questions whose number is divisible by 50."""
    return _held_out(_questions(s, d)).where(F.substring_index("question_id", "-", -1).cast("bigint") % 50 == 0)


def citation_ids(s, d):
    """The passages of each parent as numbered citations of at most 15 words."""
    p = _passages(s, d).where("parent_id is not null")
    item = F.struct(F.regexp_extract("passage_id", r"(\d+)$", 1).cast("int").alias("at"), "source", F.coalesce("text", F.lit("")).alias("text"))
    lists = p.groupBy("parent_id").agg(F.array_sort(F.collect_list(item)).alias("p"))
    return lists.select("parent_id", F.explode(tools.compress_passages(F.col("p"), 15)).alias("c")).select("parent_id", "c.citation_id", "c.source", F.md5("c.text").alias("text"))


def first_rows(s, d):
    return dataset.first_rows(_questions(s, d), "question_id", 25).select("question_id")


def passage_kinds(s, d):
    """Children and parents by their filters."""
    p = _passages(s, d)
    a, b = (x.select("passage_id", F.lit(kind).alias("kind")) for x, kind in ((dataset.children(p), "child"), (dataset.parents(p), "parent")))
    return a.unionByName(b)


def records_judged(s, d):
    """Results against the gold answers of their questions."""
    r = _records(s, d, "question_id", "predicted_answer", "is_invalid").select("record_id", "question_id", F.col("predicted_answer").alias("answer"), (~F.col("is_invalid")).alias("is_valid"))
    return evaluation.records(r, _questions(s, d)).select("record_id", "predicted_answer", "correct_answer", "is_correct", "is_invalid")


def relevance_lines(s, d):
    """What a judge's lines say; the last line of a field counts, an absent one has a default."""
    r = _records(s, d, "trace", "variant").where("trace is not null")
    first = F.when(F.col("variant") == "V1", "").otherwise(F.concat(F.lit("Relevance: "), F.coalesce("trace.decision", F.lit("")), F.lit("\n")))
    t = F.concat(first, F.lit("Reason: none\nReason: "), F.coalesce("trace.router_query", F.lit("")), F.lit("\nSuggested Focus: dose"))
    v = parsing.parse_relevance(t)
    return r.select("record_id", v["relevance"].alias("relevance"), v["reason"].alias("reason"), v["focus"].alias("focus"))


def _scratch(s, name: str) -> str:
    return f"{scratch_dir(s)}/{name}-{uuid.uuid4().hex}"


def index_built(s, d):
    """Documents chunked, written and indexed, and read back: passages, searched ones and their mean length."""
    path = _scratch(s, "index")
    build_index(_documents(s, d), "doc_id", "text", path)
    passages, index = load_index(s, path)
    return passages.agg(F.count("*").alias("n_passages")).crossJoin(F.broadcast(index.totals.select(F.col("n").alias("n_searched"), F.round("avgdl", 6).alias("avgdl"))))


def questions_read_back(s, d):
    """Questions written as JSON lines and read strictly."""
    path = _scratch(s, "questions")
    _questions(s, d).where("options is not null and answer is not null").select("question_id", "question", "options", "answer").write.json(path)
    return read_questions(s, path).select("question_id", F.md5("question").alias("question"), F.size("options").alias("n_options"), "answer")


def chunks_read_back(s, d):
    path = _scratch(s, "chunks")
    write_chunks(_passages(s, d).where("source is not null and text is not null"), path)
    return read_chunks(s, path).select("passage_id", "source", "parent_id", F.md5("text").alias("text"))


def predictions_read_back(s, d):
    path = _scratch(s, "predictions")
    p = _records(s, d, "variant", "question_id", "is_correct", "total_tokens", "trace", "run_day")
    write_predictions(p, path, "json")
    return read_predictions(s, path, "json").select("record_id", "question_id", "variant", "is_correct", "total_tokens", "run_day", F.size("trace.retrieved_passages").alias("n_passages"))


def embedding_cache(s, d):
    """Vectors of all stems, of which those of train questions are known: the largest component, and how many were made."""
    q = _questions(s, d).select("question_id", "question")
    none = s.createDataFrame([], "cache_key string, vector array<float>")
    _, known = embeddings.cached_vectors(q.where(F.col("question_id").startswith("train-")), "question", none)
    all_, new = embeddings.cached_vectors(q, "question", known)
    made = new.agg(F.count("*").alias("n_made"))
    return all_.select("question_id", F.round(F.array_max("vector").cast("double"), 4).alias("largest")).crossJoin(F.broadcast(made))


def retrieval_cache(s, d):
    """Searches of which some repeat others: all get passages, equal ones run once."""
    e = _engine(s, d)
    q = _searches(s, d).select("question_id", F.col("question").alias("query"), "options")
    twice = q.unionByName(q.withColumn("question_id", F.concat("question_id", F.lit("-again"))))
    found = materialize(e.find(twice, 3), "found")
    later = e.find(q, 3).count()
    return found.agg(F.count("*").alias("n_answered")).withColumn("n_later", F.lit(later)).withColumn("n_run", F.lit(e.retrievals.count()))


def call_log(s, d):
    """The log of one flow run twice: the second time every call is a hit."""
    e = _engine(s, d)
    q = _held_out(_questions(s, d))
    for _ in range(2):
        pipeline.answer(e, q, "V0")
    return e.call_log().groupBy("question_id", "role").agg(F.count("*").alias("n_calls"), F.count(F.when(F.col("cache_hit"), 1)).alias("n_hits"), F.sum("total_tokens").alias("total_tokens"))


def _passages(s: SparkSession, d: str) -> DataFrame:
    return passage_table(read_table(s, d, "passages"))


def _searched(p: DataFrame) -> DataFrame:
    """Children and flat chunks; parents are only shown."""
    return p.where(F.col("text").isNotNull() & ~F.contains("passage_id", F.lit("::parent-")))


def _documents(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "documents").where("text is not null")


def _records(s: SparkSession, d: str, *columns: str) -> DataFrame:
    """Each record once, as delivered last, with its variant in one spelling. Only the named
    columns are read and shuffled."""
    p = read_table(s, d, "predictions").where("record_id is not null")
    last = p.groupBy("record_id").agg(F.max_by(F.struct(*columns), "received_at").alias("m"))
    out = last.select("record_id", "m.*")
    return out.withColumn("variant", F.upper(F.trim("variant"))) if "variant" in columns else out


def _md5(c: Column, sep: str = "|") -> Column:
    return F.md5(F.array_join(c, sep))


# tokenisers, text functions and keys


def tok_words(s, d):
    return _documents(s, d).select("doc_id", F.size(T.word_tokens("text")).alias("n"), _md5(T.word_tokens("text")).alias("words"))


def tok_keywords(s, d):
    return _documents(s, d).select("doc_id", F.size(T.keywords("text")).alias("n"), _md5(T.keywords("text")).alias("words"))


def tok_sentences(s, d):
    return _documents(s, d).select("doc_id", F.size(T.sentences(T.stripped("text"))).alias("n"), _md5(T.sentences(T.stripped("text"))).alias("parts"))


def token_count(s, d):
    return _documents(s, d).select("doc_id", T.token_count("text").alias("n"), T.estimated_tokens("text").alias("estimate"))


def _family(s, d) -> DataFrame:
    """Each child with its parent's text."""
    p = _passages(s, d)
    parents = p.select(F.col("passage_id").alias("parent_id"), F.coalesce("text", F.lit("")).alias("parent_text"))
    return p.where("parent_id is not null").select("passage_id", F.coalesce("text", F.lit("")).alias("text"), "parent_id").join(parents, "parent_id")


def jaccard_pairs(s, d):
    return _family(s, d).select("passage_id", F.round(T.text_jaccard("text", "parent_text"), 6).alias("jaccard"))


def overlap_weight(s, d):
    return _family(s, d).select("passage_id", F.round(T.overlap_weight("text", "parent_text"), 6).alias("weight"))


def truncate_words(s, d):
    p = _passages(s, d).where("text is not null")
    return p.select("passage_id", F.md5(T.truncate_words("text", 20)).alias("cut"), F.md5(tools.compress_passage(F.col("text"), 15)).alias("short"))


def cache_key(s, d):
    k = hashing.request_key(F.lit("reasoner"), F.col("text"), F.lit("model-a"), F.lit(0.0), F.col("lang"))
    return _documents(s, d).select("doc_id", k.alias("request"), hashing.embedding_key(F.lit("passage"), F.col("text"), F.lit("model-e")).alias("embedding"))


def retrieval_key(s, d):
    q = _questions(s, d)
    k = hashing.retrieval_key(F.col("question"), tools.option_list(F.col("options")), F.lit(5), F.lit("index-a"), F.lit("hybrid"))
    return q.select("question_id", k.alias("key"))


def context_id(s, d):
    ids = F.col("trace.retrieved_passages")
    return _records(s, d, "trace").where(ids.isNotNull()).select("record_id", hashing.context_id(ids).alias("context"))


def sub_seed(s, d):
    return _questions(s, d).select("question_id", hashing.sub_seed(F.lit(42), F.col("question_id")).alias("seed"))


# chunks


def chunk_flat(s, d):
    return chunking.chunk_flat(_documents(s, d), "doc_id", "text", 128).select("doc_id", "chunk_id", F.md5("text").alias("text"))


def chunk_parents(s, d):
    return chunking.chunk_parents(_documents(s, d), "doc_id", "text", 64, 512).select("doc_id", "chunk_id", F.md5("text").alias("text"))


def chunk_children(s, d):
    return chunking.chunk_children(_documents(s, d), "doc_id", "text", 64, 512).select("doc_id", "chunk_id", "parent_id", F.md5("text").alias("text"))


def child_parent_join(s, d):
    """Each child passage with its parent's source and text, its own where there is no parent."""
    p = _passages(s, d).where("text is not null")
    h = p.where(~F.contains("passage_id", F.lit("::parent-"))).select("passage_id")
    c = fusion.with_context(h, _passages(s, d))
    return c.select("passage_id", F.coalesce("parent_source", "source").alias("source"), F.md5(F.coalesce("parent_text", "text")).alias("text"))


def rows_joined(s, d):
    p = _passages(s, d).where("parent_id is not null").withColumn("pos", F.regexp_extract("passage_id", r"(\d+)$", 1).cast("int"))
    return dataset.join_rows(p, "parent_id", "pos", "text").select("parent_id", F.md5("text").alias("text"))


# sparse and dense retrieval


def _index_parts(s, d) -> tuple[DataFrame, bm25.Index, DataFrame]:
    """The unique passages, the sparse index and the vectors, made once for each state of the passages' table."""

    def make(path: str) -> None:
        _passages(s, d).write.parquet(f"{path}/passages")
        searched = _searched(s.read.parquet(f"{path}/passages"))
        bm25.build(searched, "passage_id", "text").save(f"{path}/bm25")
        searched.select("passage_id", embeddings.vector(F.col("text")).alias("v")).write.parquet(f"{path}/vectors")

    path = stored(s, INDEX, f"{d}/passages.parquet", make)
    return s.read.parquet(f"{path}/passages"), bm25.Index.load(s, f"{path}/bm25"), s.read.parquet(f"{path}/vectors")


def _index(s, d) -> bm25.Index:
    return _index_parts(s, d)[1]


def bm25_term_df(s, d):
    return bm25.build(_searched(_passages(s, d)), "passage_id", "text").terms


def bm25_stats(s, d):
    return bm25.build(_searched(_passages(s, d)), "passage_id", "text").totals.select("n", F.round("avgdl", 6).alias("avgdl"))


def bm25_idf(s, d):
    i = bm25.build(_searched(_passages(s, d)), "passage_id", "text")
    return i.terms.crossJoin(F.broadcast(i.totals)).select("term", F.round(bm25.idf(F.col("n"), F.col("df")), 6).alias("idf"))


def bm25_topk(s, d):
    r = bm25.search(_index(s, d), _searches(s, d), "question_id", "question", 5)
    return r.select("question_id", F.col("doc_id").alias("passage_id"), F.round("score", 6).alias("score"), "rank")


def dense_topk(s, d):
    e = read_table(s, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    return dense.dense_topk(e, "vec_id", "embedding", q, "query_id", "v", 5).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def _lists(s, d, n: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    passages, index, vectors = _index_parts(s, d)
    q = materialize(_searches(s, d).withColumn("search_text", F.col("question")), "searches")
    sparse = bm25.search(index, q, "question_id", "question", n).withColumnRenamed("doc_id", "passage_id")
    return materialize(pipeline.hits_by(vectors)(q, n).select("question_id", "passage_id", "score", "rank"), "dense"), materialize(sparse, "sparse"), passages


def _shown(h: DataFrame) -> DataFrame:
    return h.select("question_id", "passage_id", F.round("score", 6).alias("score"), "rank")


def rrf_zero_based(s, d):
    a, b, _ = _lists(s, d)
    return _shown(fusion.rrf(a, b, "question_id", rank_base=0))


def rrf_one_based(s, d):
    a, b, _ = _lists(s, d)
    return _shown(fusion.rrf(a, b, "question_id", rank_base=1))


def _fused(s, d) -> tuple[DataFrame, DataFrame]:
    a, b, p = _lists(s, d)
    h = fusion.with_context(fusion.rrf(a, b, "question_id"), p)
    q = _searches(s, d).select("question_id", F.col("question").alias("q_text"), F.coalesce(fusion.option_words(F.col("options")), F.array().cast("array<string>")).alias("words_o"))
    return h.join(q, "question_id"), p


def option_boost(s, d):
    return _shown(fusion.rerank(fusion.boost_options(_fused(s, d)[0], "words_o"), "question_id"))


def entity_rerank(s, d):
    h = _fused(s, d)[0].withColumn("ents", T.entities("q_text"))
    return _shown(fusion.rerank(fusion.boost_entities(h, "ents"), "question_id"))


def dynamic_topk(s, d):
    a, b, _ = _lists(s, d)
    h = fusion.dynamic_limit(fusion.rrf(a, b, "question_id"), "question_id", 5)
    return _shown(h.where(F.col("rank") <= F.col("limit_")))


def parent_dedup(s, d):
    h = fusion.dedup_parents(_fused(s, d)[0], "question_id")
    return h.select("question_id", "passage_id", "source", F.md5("text").alias("text"), F.round("score", 6).alias("score"))


def relevance_threshold(s, d):
    a, b, _ = _lists(s, d)
    return _shown(fusion.threshold(fusion.rrf(a, b, "question_id"), 0.016))


def token_overlap_rescore(s, d):
    return _shown(fusion.rescore(_fused(s, d)[0], "question_id", "q_text"))


def multi_query_merge(s, d):
    """Three narrower queries for each question, merged to the five best passages."""
    q = _searches(s, d).select("question_id", F.posexplode(tools.decompose(F.col("question"))).alias("part", "text"))
    q = q.withColumn("key", F.concat_ws("#", "question_id", "part"))
    h = bm25.search(_index(s, d), q, "key", "text", 5).join(q.select("key", "question_id", "part"), "key").withColumnRenamed("doc_id", "passage_id")
    return _shown(fusion.merge_queries(h, "question_id", "part", 5))


FULL = retrieve.Settings(top_k=5, option_boosting=True, dynamic_k=True, compression=True, entity_rerank=True, pruning=True, synonyms=True, hybrid=True)


def hybrid_retrieve(s, d):
    passages, index, vectors = _index_parts(s, d)
    q = materialize(_searches(s, d).select("question_id", "question", "options"), "searches")
    r = retrieve.retrieve(q, "question_id", "question", passages, FULL, index, pipeline.hits_by(vectors), "options")
    return r.select("question_id", "passage_id", "source", F.md5("text").alias("text"), F.round("score", 6).alias("score"), "rank")


def _texts(s, d) -> DataFrame:
    h, _ = _fused(s, d)
    return h.withColumn("text", F.coalesce("text", F.lit(""))).select("question_id", "passage_id", "source", "text", "score", "rank")


def mmr_greedy(s, d):
    return _shown(fusion.mmr_greedy(_texts(s, d), "question_id", 5))


def mmr_skip(s, d):
    return _shown(fusion.mmr_skip(_texts(s, d), "question_id", 5, 0.5))


def token_budget(s, d):
    h = fusion.token_budget(_texts(s, d).where("rank <= 5"), "question_id", 60)
    return h.select("question_id", "passage_id", F.md5("text").alias("text"), "rank")


def context_savings(s, d):
    h = _texts(s, d).where("rank <= 5").withColumn("short", tools.compress_passage(F.col("text"), 20))
    return evaluation.savings(h, "question_id", "text", "short")


# rewriting of queries


def query_prune(s, d):
    return _questions(s, d).select("question_id", F.md5(T.prune_query("question")).alias("pruned"), F.md5(T.prune_query("question", need_entity=False)).alias("without_question"))


def synonym_expand(s, d):
    """Over whole stems, each followed by a term that has synonyms."""
    words = F.array(*[F.lit(k) for k, _ in T.SYNONYMS])
    term = F.element_at(words, (F.substring_index("question_id", "-", -1).cast("int") % len(T.SYNONYMS)) + 1)
    return _questions(s, d).select("question_id", T.expand_synonyms(F.concat("question", F.lit(" "), term)).alias("expanded"))


def entities_a(s, d):
    return _questions(s, d).select("question_id", F.array_join(T.entities("question", T.ENTITY_TERMS_A), "|").alias("entities"))


def entities_b(s, d):
    return _questions(s, d).select("question_id", F.array_join(T.entities("question", T.ENTITY_TERMS_B), "|").alias("entities"))


def compress_sentences(s, d):
    words = F.array(*[F.lit(w) for w in ("fever", "histology", "laboratory", "patients")])
    return _passages(s, d).where("text is not null").select("passage_id", F.md5(T.compress_sentences("text", words)).alias("text"))


def _answers(s, d) -> DataFrame:
    q = _held_out(_questions(s, d)).select("question_id", "question", "options")
    return _records(s, d, "explanation", "question_id").where("explanation is not null").join(q, "question_id")


def coverage(s, d):
    """The words of a question are taken once, not for each of its records."""
    q = _held_out(_questions(s, d)).select("question_id", T.content_words("question").alias("q_words"))
    r = _records(s, d, "explanation", "question_id").where("explanation is not null")
    r = r.select("record_id", "question_id", T.word_set("explanation").alias("p_words")).join(q, "question_id")
    r = r.withColumn("c", T.coverage_of(F.col("q_words"), F.col("p_words")))
    c = F.col("c")
    return r.select("record_id", F.round(c["ratio"], 6).alias("ratio"), c["is_sufficient"].alias("is_sufficient"), F.array_join(c["missing"], "|").alias("missing"))


def cooccurrence(s, d):
    return _answers(s, d).select("record_id", F.round(T.cooccurrence("question", "explanation"), 6).alias("share"))


# replies and options


def parse_answer_strict(s, d):
    p = parsing.parse_answer(F.col("explanation"), LETTERS)
    return _records(s, d, "explanation").select("record_id", p["is_valid"].alias("is_valid"), p["answer"].alias("answer"), p["reason"].alias("reason"))


def parse_answer_lenient(s, d):
    p = parsing.parse_answer(F.col("explanation"), LETTERS, lenient=True)
    return _records(s, d, "explanation").select("record_id", p["is_valid"].alias("is_valid"), p["answer"].alias("answer"))


def strip_answer(s, d):
    return _records(s, d, "explanation").where("explanation is not null").select("record_id", F.md5(parsing.strip_answer(F.col("explanation"))).alias("text"))


def parse_kv_lines(s, d):
    text = F.concat(F.lit("Decision: "), F.coalesce("trace.decision", F.lit("")), F.lit("\nReview Memo: "), F.coalesce("predicted_answer", F.lit("none")), F.lit("\nSearch Query: "), F.coalesce("trace.router_query", F.lit("")))
    r = _records(s, d, "trace", "predicted_answer").where("trace is not null").withColumn("t", text)
    review = parsing.parse_review(F.col("t"))
    return r.select("record_id", review["decision"].alias("decision"), review["memo"].alias("memo"), parsing.parse_search_query(F.col("t")).alias("query"), F.size(parsing.parse_search_queries(F.col("t"), F.array(F.lit("x")))).alias("n_queries"))


def _options(s, d) -> DataFrame:
    return _questions(s, d).where("options is not null").select("question_id", "question", F.explode("options").alias("letter", "option"))


def option_scores(s, d):
    return _options(s, d).select("question_id", "letter", F.round(tools.option_score(F.coalesce("option", F.lit("")), F.col("question")), 6).alias("score"), tools.eliminated(F.coalesce("option", F.lit("")), F.array(F.lit("ITIS"), F.lit("ose"))).alias("eliminated"))


def confidence(s, d):
    """The best option by its score, the first of equals, and the margin."""
    o = _options(s, d).withColumn("score", F.round(tools.option_score(F.coalesce("option", F.lit("")), F.col("question")), 6))
    best = F.min_by("letter", F.struct(-F.col("score"), F.col("letter")))
    return o.groupBy("question_id").agg(best.alias("letter"), F.round(tools.confidence(F.collect_list("score")), 6).alias("confidence"))


def _cited(s, d) -> DataFrame:
    return _records(s, d, "explanation", "trace").where("explanation is not null").withColumn("n", F.coalesce(F.size("trace.retrieved_passages"), F.lit(0)))


def citation_audit(s, d):
    a = tools.audit_citations(F.col("explanation"), F.col("n"))
    return _cited(s, d).select("record_id", a["has_citations"].alias("has_citations"), a["citation_count"].alias("citation_count"))


def citation_fidelity(s, d):
    bad = tools.unknown_citations(F.col("explanation"), F.col("n"))
    return _cited(s, d).select("record_id", (F.size(bad) == 0).alias("is_valid"), F.array_join(F.transform(bad, lambda x: x.cast("string")), "|").alias("unknown"))


def halluc_risk(s, d):
    return _cited(s, d).select("record_id", tools.ungrounded(F.col("explanation"), F.col("n")).alias("risk"))


def fast_path(s, d):
    return _questions(s, d).select("question_id", tools.is_direct(F.col("question")).alias("direct"))


def fast_path_short(s, d):
    """Of short questions, one after each option: stems are too long for the fast path."""
    short = F.concat(F.lit("What is the first-line drug for "), F.coalesce("option", F.lit("")), F.when(F.col("letter") == "B", F.col("question")).otherwise(""))
    return _options(s, d).select("question_id", "letter", tools.is_direct(short).alias("direct"))


def search_strategy(s, d):
    return _questions(s, d).select("question_id", tools.search_strategy(F.col("question")).alias("strategy"))


def formatters(s, d):
    c = read_table(s, d, "memory_cases").select("case_id", *[F.coalesce(x, F.lit("")).alias(x) for x in ("question", "correct_answer", "explanation")]).distinct()
    one = F.array(F.struct("question", "correct_answer", "explanation"))
    return c.select(
        "case_id",
        F.md5(tools.pearls(one)).alias("pearls"),
        F.md5(tools.few_shot(one)).alias("few_shot"),
        F.md5(tools.mechanism_chain(F.col("question"), F.col("explanation"), F.col("correct_answer"))).alias("chain"),
        F.md5(tools.consensus(F.col("explanation"), F.col("question"))).alias("consensus"),
        F.md5(tools.hyde_context(F.col("question"))).alias("hyde"),
        F.md5(tools.callback(F.col("question"), F.col("correct_answer").isin("A", "B").cast("int") * 2)["message"]).alias("callback"),
    )


def option_listing(s, d):
    return _questions(s, d).where("options is not null").select("question_id", F.md5(tools.option_list(F.col("options"))).alias("listing"))


def options_mapped(s, d):
    """All endings of each question as options, null where it has fewer, and the letter at the answer's place."""
    endings = [f"ending{i}" for i in range(len(LETTERS))]
    label = F.array_position(T.strings(LETTERS), F.upper(F.trim("answer"))) - 1
    q = _questions(s, d).where("options is not null").select("question_id", *[F.col("options")[x].alias(e) for x, e in zip(LETTERS, endings, strict=True)], F.when(label >= 0, label).alias("label"))
    options, letter = dataset.options_from_endings(endings, "label")
    return q.withColumn("o", options).select("question_id", *[F.col("o")[x].alias(x.lower()) for x in LETTERS], F.when(F.col("label").isNotNull(), letter).alias("answer"))


# samples and memory


def sample_dev(s, d):
    q = _questions(s, d).where(F.col("question_id").startswith("dev-"))
    return sampling.sample_dev(q, "question_id", RunConfig("model-a", 0.0)).select("question_id")


def sample_official(s, d):
    q = _questions(s, d).where(F.col("question_id").startswith("test-"))
    return sampling.sample_official_test(q, "question_id", RunConfig("model-a", 0.0)).select("question_id")


def memory_topk(s, d):
    return memory.exemplars(_searches(s, d), "question_id", "question", read_table(s, d, "memory_cases"), 2)


def split_disjoint(s, d):
    q = _questions(s, d)
    dev, test = (q.where(F.col("question_id").startswith(x)).select(F.substring_index("question_id", "-", -1).alias("n"), F.col("question_id")) for x in ("dev-", "test-"))
    return sampling.overlapping_keys(dev, test, "question_id").agg(F.count("*").alias("n_shared"))


# evaluation


def leaderboard(s, d):
    return evaluation.leaderboard(_records(s, d, "variant", "is_correct", "is_invalid", "total_tokens", "latency_seconds", "prompt_tokens", "completion_tokens"))


def usage_rollup(s, d):
    return evaluation.usage(_records(s, d, "question_id", "variant", "prompt_tokens", "completion_tokens", "total_tokens"), "question_id", "variant")


def throughput(s, d):
    return evaluation.throughput(_records(s, d, "variant", "is_correct", "latency_seconds", "total_tokens"))


def error_causes(s, d):
    return evaluation.causes(_records(s, d, "variant", "is_correct", "is_invalid", "predicted_answer"))


def _scores(s, d) -> DataFrame:
    return evaluation.scores_by_question(_records(s, d, "variant", "question_id", "is_correct"))


def paired_comparison(s, d):
    c = evaluation.compare(_scores(s, d), PAIRS)
    return c.withColumn("finding", evaluation.finding(F.col("delta")))


def p_values(s, d):
    return evaluation.with_p_values(evaluation.compare(_scores(s, d), PAIRS)).select("pair", "p_value", "p_exact")


def bootstrap_ci(s, d):
    return evaluation.bootstrap(evaluation.paired(_scores(s, d), "V0", "V3"))


def loss_sets(s, d):
    """Of questions that count as right only if every run is."""
    every = evaluation.scores_by_question(_records(s, d, "variant", "question_id", "is_correct"), least=1.0)
    return evaluation.losses(every, "V0", "V3")


def variant_pivot(s, d):
    return evaluation.pivot_by_question(_records(s, d, "variant", "question_id", "predicted_answer"), VARIANTS)


def answers_corrected(s, d):
    return _records(s, d, "predicted_answer", "correct_answer", "prompt_tokens", "completion_tokens").select("record_id", evaluation.is_correct(F.col("predicted_answer"), F.col("correct_answer")).alias("correct"), F.round(evaluation.cost(F.col("prompt_tokens"), F.col("completion_tokens")), 9).alias("cost"))


# caches, pages, catalog, graphs


def cache_misses(s, d):
    """Requests by (question, variant) against a cache of those of even record numbers."""
    r = _records(s, d, "question_id", "variant").select("record_id", hashing.key_of(question=F.col("question_id"), variant=F.col("variant")).alias("cache_key"))
    return caching.split_report(r.select("cache_key"), r.where("record_id % 2 = 0").select("cache_key"))


def dataset_search_page(s, d):
    hits = dataset.search(_questions(s, d), "question", "Which")
    return dataset.page_with_total(hits, "question_id", 2, 10).select("question_id", "total")


def fan_out(s, d):
    return dataset.fan_out(_held_out(_questions(s, d)).select("question_id"), VARIANTS)


def tool_catalog(s, d):
    return tools.catalog(s).groupBy("agent").agg(F.count("*").alias("n"))


def dag_levels(s, d):
    return dag.levels(_passages(s, d).select(F.col("passage_id").alias("node"), F.col("parent_id").alias("dep")))


def _rings(s, d) -> DataFrame:
    """Rings of ten documents, and as many open chains."""
    i = F.col("doc_id")
    ring = F.floor(i / 10) % 2 == 0
    return read_table(s, d, "documents").select(i.alias("node"), F.when(i % 10 < 9, i + 1).when(ring, i - 9).alias("dep"))


def dag_cycle(s, d):
    return dag.on_cycles(_rings(s, d))


# flows


def _engine(s, d, script=None, **settings) -> pipeline.Engine:
    config = RunConfig("model-a", 0.0, **({"rag_top_k": 3, "rag_use_hybrid": True} | settings))
    return pipeline.build_engine(s, config, lambda: clients.ScriptedClient(script), *_index_parts(s, d), read_table(s, d, "memory_cases"))


def _flow(variant: str, **settings) -> Query:
    def run(s, d):
        r = pipeline.answer(_engine(s, d, **settings), _held_out(_questions(s, d)), variant)
        return r.select("question_id", "variant", "answer", "is_valid", "total_tokens", "n_calls", "trace.decision")

    return run


variant_v0, variant_v1, variant_v2, variant_v3, variant_v4 = (_flow(v) for v in VARIANTS)
#: What the router is made to reply, so that the researcher has a query of several parts.
_PARTS = {"router": lambda prompt: "Search Query: " + " ".join(prompt.split("Question:\n", 1)[-1].split()) + " || treatment || "}
variant_v4_parts = _flow("V4", script=_PARTS, rag_use_mmr=True, rag_use_hyde=True, rag_use_query_pruning=True, rag_use_synonym_expansion=True)
variant_v2_advanced = _flow("V2", rag_enable_backtracking=True, rag_enable_debate=True, rag_use_multi_query=True, rag_adaptive_routing=True, rag_heuristic_compression=True)


def stream_daily(s, d):
    """The closed days of the event stream."""
    base = f"{scratch_dir(s)}/stream-{uuid.uuid4().hex}"
    windows.run_once(windows.daily_counts(windows.read_events(s, d)), f"{base}/out", f"{base}/state")
    return s.read.parquet(f"{base}/out").select(F.col("day").cast("date").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


_NAMES = """
tok_words tok_keywords tok_sentences token_count jaccard_pairs overlap_weight truncate_words cache_key retrieval_key context_id sub_seed
chunk_flat chunk_parents chunk_children child_parent_join rows_joined bm25_term_df bm25_stats bm25_idf bm25_topk dense_topk
rrf_zero_based rrf_one_based option_boost entity_rerank dynamic_topk parent_dedup relevance_threshold token_overlap_rescore multi_query_merge hybrid_retrieve mmr_greedy mmr_skip token_budget context_savings citation_ids
first_rows passage_kinds records_judged relevance_lines index_built questions_read_back chunks_read_back predictions_read_back embedding_cache retrieval_cache call_log
query_prune synonym_expand entities_a entities_b compress_sentences coverage cooccurrence parse_answer_strict parse_answer_lenient strip_answer parse_kv_lines option_scores confidence citation_audit citation_fidelity halluc_risk
fast_path fast_path_short search_strategy formatters option_listing options_mapped sample_dev sample_official memory_topk split_disjoint leaderboard usage_rollup throughput error_causes paired_comparison p_values bootstrap_ci loss_sets variant_pivot answers_corrected
cache_misses dataset_search_page fan_out tool_catalog dag_levels dag_cycle variant_v0 variant_v1 variant_v2 variant_v2_advanced variant_v3 variant_v4 variant_v4_parts stream_daily
"""


def _shipped(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {n: _shipped(globals()[n]) for n in _NAMES.split()}


def oracle_sql() -> dict[str, str]:
    from corvane.oracle import SQL

    return dict(SQL)
