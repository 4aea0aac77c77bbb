"""The staged question-answering flows V0 to V4 over a table of questions.

A stage is asked for all its questions at once: prompts are columns, their keys are
looked up in the table of earlier replies, and only misses reach the client. What a
stage decides is a column too; questions that skip a stage are left out of its requests
and stay in the table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import hashing, parsing, text, tools
from corvane.operators import bm25, caching, dense, fusion, memory, retrieve
from corvane.plans import embeddings, prompts
from corvane.plans.clients import REPLY_SCHEMA, Client, as_batches
from corvane.session import materialize
from corvane.sources.config import RunConfig

VARIANTS = ("V0", "V1", "V2", "V3", "V4")
_USAGE = ("prompt_tokens", "completion_tokens", "total_tokens")
NO_EVIDENCE = "No clinical evidence retrieved."
_HITS = "array<struct<rank:int,passage_id:string,source:string,text:string,score:double>>"
CALLS = "question_id string, role string, model string, temperature double, prompt string, context_id string, cache_key string, cache_hit boolean, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint, latency_seconds double"
#: From this score on the raw question is a good enough query.
ROUTED_SCORE = 0.030


@dataclass
class Engine:
    """What the flows need. `retrieve(queries(question_id, query, options), k)` gives rows
    (question_id, passage_id, source, text, score, rank)."""

    spark: SparkSession
    config: RunConfig
    make_client: Callable[[], Client]
    retrieve: Callable[[DataFrame, int], DataFrame] | None = None
    cases: DataFrame | None = None
    cache: DataFrame | None = None
    #: What earlier retrievals found: (cache_key, found). `searched` names the index and settings they hold for.
    retrievals: DataFrame | None = None
    searched: str = "index"
    #: False reproduces a flow whose memory brief is made but not shown to the reasoner.
    memory_in_reasoner: bool = True
    calls: list[DataFrame] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.cache is None:
            self.cache = self.spark.createDataFrame([], REPLY_SCHEMA)
        if self.retrievals is None:
            self.retrievals = self.spark.createDataFrame([], f"cache_key string, found {_HITS}")

    def start(self, questions: DataFrame) -> DataFrame:
        """One row for each question id, without usage yet."""
        one = questions.where("question_id is not null").groupBy("question_id").agg(F.max(F.struct(F.coalesce("question", F.lit("")).alias("question"), F.map_entries("options").alias("o"))).alias("m"))
        s = one.select("question_id", "m.question", F.coalesce(F.map_from_entries("m.o"), F.create_map().cast("map<string,string>")).alias("options"))
        for c in _USAGE:
            s = s.withColumn(c, F.lit(0).cast("bigint"))
        return s.withColumn("latency_seconds", F.lit(0.0)).withColumn("n_calls", F.lit(0))

    def ask(self, state: DataFrame, role: str, prompt: Column, into: str, where: Column | None = None, context: Column | None = None) -> DataFrame:
        """`state` with the replies in column `into`, null where it wasn't asked."""
        c = self.config
        asked = state if where is None else state.where(F.coalesce(where, F.lit(False)))
        requests = asked.select("question_id", F.lit(role).alias("role"), prompt.alias("prompt"), F.lit(c.model).alias("model"), F.lit(float(c.temperature)).alias("temperature"), (F.lit(None).cast("string") if context is None else context).alias("context_id"))
        requests = requests.withColumn("cache_key", hashing.request_key(F.col("role"), F.col("prompt"), F.col("model"), F.col("temperature"), F.col("context_id")))
        answered, new = caching.complete(materialize(requests, "requests"), self.cache, as_batches(self.make_client), REPLY_SCHEMA)
        self.cache = self.cache.unionByName(new)
        asked_now = new.select("cache_key").withColumn("cache_hit", F.lit(False))
        log = answered.join(asked_now, "cache_key", "left").withColumn("cache_hit", F.coalesce("cache_hit", F.lit(True)))
        self.calls.append(log.select("question_id", "role", "model", "temperature", "prompt", "context_id", "cache_key", "cache_hit", *_USAGE, "latency_seconds"))
        got = answered.select("question_id", F.col("text").alias(into), *[F.col(u).alias(f"{u}_") for u in (*_USAGE, "latency_seconds")])
        s = state.join(got, "question_id", "left")
        for u in (*_USAGE, "latency_seconds"):
            s = s.withColumn(u, F.col(u) + F.coalesce(f"{u}_", F.lit(0))).drop(f"{u}_")
        s = s.withColumn("n_calls", F.col("n_calls") + F.when(F.col(into).isNotNull(), 1).otherwise(0))
        return materialize(s, "stage")

    def call_log(self) -> DataFrame:
        """One row for each call so far, hits included, with all that led to it."""
        if not self.calls:
            return self.spark.createDataFrame([], CALLS)
        out = self.calls[0]
        for c in self.calls[1:]:
            out = out.unionByName(c)
        return out

    def save_calls(self, path: str) -> None:
        """Append the calls so far to the log at `path`, and begin anew."""
        self.call_log().write.mode("append").parquet(path)
        self.calls = []

    def find(self, queries: DataFrame, k: int) -> DataFrame:
        """Rows (question_id, found) for queries (question_id, query, options): the passages as an
        array in order of rank. Equal retrievals run once; earlier ones are looked up."""
        listing = F.when(F.size("options") > 0, tools.option_list(F.col("options")))
        key = hashing.retrieval_key(F.col("query"), listing, F.lit(k), F.lit("passages"), F.lit(self.searched))
        keyed = materialize(queries.select("question_id", "query", "options", key.alias("cache_key")), "retrievals")
        # One of the equal requests stands for all; they differ in nothing that counts.
        missing = caching.misses(keyed, self.retrievals).select(F.col("cache_key").alias("question_id"), "query", "options")
        item = F.struct(F.col("rank").cast("int").alias("rank"), "passage_id", "source", "text", "score")
        lists = self.retrieve(missing, k).groupBy("question_id").agg(F.array_sort(F.collect_list(item)).alias("found"))
        new = missing.select("question_id").join(lists, "question_id", "left").select(F.col("question_id").alias("cache_key"), F.coalesce("found", F.array().cast(_HITS)).alias("found"))
        new = materialize(new, "retrieved")
        known = self.retrievals
        self.retrievals = known.unionByName(new)
        return keyed.join(self.retrievals.dropDuplicates(["cache_key"]), "cache_key").select("question_id", "found")

    def look_up(self, state: DataFrame, query: Column, into: str, k: int, where: Column | None = None) -> DataFrame:
        """`state` with the passages found by `query` as an array in order of rank."""
        some = state if where is None else state.where(F.coalesce(where, F.lit(False)))
        lists = self.find(some.select("question_id", query.alias("query"), "options"), k).withColumnRenamed("found", "found_")
        s = state.join(lists, "question_id", "left").withColumn("found_", F.coalesce("found_", F.array().cast(_HITS)))
        old = F.col(into) if into in state.columns else F.array().cast(_HITS)
        new = F.col("found_") if where is None else F.when(F.coalesce(where, F.lit(False)), F.col("found_")).otherwise(old)
        return materialize(s.withColumn(into, new).drop("found_"), "passages")


def hits_by(vectors: DataFrame, make: type = embeddings.HashEmbedding) -> Callable[[DataFrame, int], DataFrame]:
    """Dense hits by stored vectors (passage_id, v), for queries (question_id, search_text)
    embedded on the way."""

    def hits(queries: DataFrame, k: int) -> DataFrame:
        q = queries.select("question_id", embeddings.vector(F.col("search_text"), make, "query").alias("qv"))
        return dense.dense_topk(vectors, "passage_id", "v", q, "question_id", "qv", k)

    return hits


def build_engine(
    spark: SparkSession, config: RunConfig, client: Callable[[], Client], passages: DataFrame, index: bm25.Index, vectors: DataFrame, cases: DataFrame | None = None, embedding: type = embeddings.HashEmbedding, **rest
) -> Engine:
    """An engine whose retrieval follows all the settings of the run."""
    settings = retrieve.Settings.from_config(config)

    def look_up(queries: DataFrame, k: int) -> DataFrame:
        return retrieve.retrieve(queries, "question_id", "query", passages, replace(settings, top_k=k), index, hits_by(vectors, embedding), "options")

    return Engine(spark, config, client, look_up, cases, searched=f"{embedding.name} {settings.label()}", **rest)


def _ids(hits: Column) -> Column:
    return F.transform(hits, lambda h: h["passage_id"])


def _context(hits: Column) -> Column:
    return hashing.context_id(_ids(hits))


def _result(state: DataFrame, variant: str, reply: Column, valid_reply: Column, **trace: Column) -> DataFrame:
    """The common shape of all results; what a variant lacks in its trace is null."""
    kinds = {
        "router_query": "string", "entities": "array<string>", "retrieved_passages": "array<string>", "memory_exemplars_count": "int", "memory_brief": "string", "decision": "string", "loops": "int",
        "backtrack_history": "array<struct<loop:int,query:string,reason:string>>", "debate_history": "array<struct<memo:string,reply:string>>",
    }
    parsed = parsing.parse_answer(valid_reply, lenient=False)
    if "router_query" in trace:
        # What the router names in the question goes with its query.
        trace["entities"] = text.entities(F.col("question"), text.ENTITY_TERMS_B)
    t = F.struct(*[(trace[k] if k in trace else F.lit(None)).cast(kind).alias(k) for k, kind in kinds.items()])
    return state.withColumn("p_", parsed).select(
        "question_id", F.lit(variant).alias("variant"), F.col("p_.answer").alias("answer"), parsing.strip_answer(F.coalesce(reply, F.lit(""))).alias("explanation"), F.coalesce("p_.is_valid", F.lit(False)).alias("is_valid"),
        reply.alias("raw_response"), *_USAGE, "latency_seconds", "n_calls", t.alias("trace"),
    )


def v0(e: Engine, questions: DataFrame) -> DataFrame:
    s = e.ask(e.start(questions), "direct", prompts.direct(F.col("question"), F.col("options")), "reply")
    return _result(s, "V0", F.col("reply"), F.col("reply"))


def v1(e: Engine, questions: DataFrame) -> DataFrame:
    s = e.look_up(e.start(questions), F.col("question"), "hits", e.config.rag_top_k)
    p = prompts.with_passages(F.col("question"), F.col("options"), F.col("hits"), e.config.rag_max_passage_tokens)
    s = e.ask(s, "rag", p, "reply", context=_context(F.col("hits")))
    return _result(s, "V1", F.col("reply"), F.col("reply"), retrieved_passages=_ids(F.col("hits")))


def _brief(hits: Column) -> Column:
    joined = F.array_join(F.transform(hits, lambda h, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(h["text"], F.lit("")))), "\n")
    return F.when(F.size(hits) > 0, joined).otherwise(NO_EVIDENCE)


def _budget(hits: Column, total: int) -> Column:
    """The array form of a token budget: equal shares, up to the one that reaches the total."""
    from corvane.functions.text import token_count, truncate_words

    share = F.greatest(F.lit(2), F.floor(F.lit(total) / F.greatest(F.size(hits), F.lit(1)))).cast("int")

    def cut(h: Column) -> Column:
        from corvane.functions.text import blank_words

        w = blank_words(h["text"])
        return h.withField("text", F.when(F.size(w) > share, F.concat(F.array_join(F.slice(w, F.lit(1), share), " "), F.lit("..."))).otherwise(h["text"]))

    zero = F.struct(F.lit(0).alias("used"), F.array().cast(_HITS).alias("kept"))
    step = lambda a, h: F.when(a["used"] >= total, a).otherwise(F.struct((a["used"] + token_count(h["text"])).alias("used"), F.concat(a["kept"], F.array(h)).alias("kept")))
    return F.aggregate(F.transform(hits, cut), zero, step)["kept"]


def _v2_baseline(e: Engine, s: DataFrame, variant: str, lesson: Column | None, **trace: Column) -> DataFrame:
    q, o = F.col("question"), F.col("options")
    s = e.ask(s, "router", prompts.router(q), "route")
    s = e.look_up(s.withColumn("query", parsing.parse_search_query(F.col("route"))), F.col("query"), "hits", e.config.rag_top_k)
    s = e.ask(s, "reasoner", prompts.reasoner(q, o, prompts.passages_block(F.col("hits"), e.config.rag_max_passage_tokens), lesson), "proposal", context=_context(F.col("hits")))
    s = s.withColumn("candidate", parsing.parse_answer(F.col("proposal"))["answer"])
    s = e.ask(s, "verifier", prompts.verifier(q, o, F.col("hits"), F.col("candidate"), parsing.strip_answer(F.col("proposal")), e.config.rag_max_passage_tokens), "reply", context=_context(F.col("hits")))
    same = F.coalesce(F.col("candidate") == parsing.parse_answer(F.col("reply"))["answer"], F.lit(False))
    return _result(s, variant, F.col("reply"), F.col("reply"), router_query=F.col("query"), retrieved_passages=_ids(F.col("hits")), decision=F.when(same, "approve").otherwise("override"), **trace)


def _several(e: Engine, s: DataFrame, queries: Column, where: Column, k: int, keep: int) -> DataFrame:
    """Rows (question_id, passage..., rank): the `keep` best passages of several queries for each
    question, of which each fetches k."""
    parts = s.where(where).select("question_id", "options", F.posexplode(queries).alias("part", "query"))
    keyed = parts.withColumn("question_id", F.concat_ws("\u0001", "question_id", F.col("part").cast("string")))
    hits = e.find(keyed.select("question_id", "query", "options"), k).select("question_id", F.explode("found").alias("h")).select("question_id", "h.*")
    named = hits.withColumn("part", F.substring_index("question_id", "\u0001", -1).cast("int")).withColumn("question_id", F.substring_index("question_id", "\u0001", 1))
    return fusion.merge_queries(named, "question_id", "part", keep).drop("part")


def _with_hits(s: DataFrame, hits: DataFrame, where: Column) -> DataFrame:
    """`s` whose `hits` are replaced by the rows of `hits` where asked."""
    lists = hits.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), "passage_id", "source", "text", "score"))).alias("m_"))
    out = s.join(lists, "question_id", "left").withColumn("hits", F.when(where, F.coalesce("m_", F.array().cast(_HITS))).otherwise(F.col("hits"))).drop("m_")
    return materialize(out, "passages")


def _multi(e: Engine, s: DataFrame, queries: Column, where: Column, k: int) -> DataFrame:
    """Several queries for each question, merged to the k best passages."""
    return _with_hits(s, _several(e, s, queries, where, k, k), where)


def research(e: Engine, s: DataFrame, query: Column) -> DataFrame:
    """The researcher's retrieval: a query of several parts, divided by a double bar, is searched
    part by part with k passages each, merged to 2 k; any other with 2 k at once. Of these
    k stay, the most diverse ones if the settings ask for that, else the first."""
    c, k, hits = e.config, e.config.rag_top_k, F.col("hits")
    s = materialize(s.withColumn("query", query), "research")
    split = F.contains(F.col("query"), F.lit("||"))
    parts = F.filter(F.transform(F.split("query", r"\|\|"), lambda p: F.trim(p)), lambda p: p != "")
    s = e.look_up(s, F.col("query"), "hits", 2 * k, where=~split)
    s = _with_hits(s, _several(e, s, parts, split, k, 2 * k), split)
    if c.rag_use_mmr:
        flat = s.select("question_id", F.explode("hits").alias("h")).select("question_id", "h.*")
        return _with_hits(s, fusion.mmr_greedy(flat, "question_id", k, c.rag_mmr_lambda), F.lit(True))
    return s.withColumn("hits", F.slice(hits, 1, k))


def _v2_advanced(e: Engine, s: DataFrame, variant: str, lesson: Column | None, **trace: Column) -> DataFrame:
    c, q, o, hits = e.config, F.col("question"), F.col("options"), F.col("hits")
    k = c.rag_top_k
    if c.rag_adaptive_routing:
        s = e.look_up(s, q, "hits", k)
        s = s.withColumn("bypass", F.coalesce(F.array_max(F.transform(hits, lambda h: h["score"])) >= ROUTED_SCORE, F.lit(False)))
    else:
        s = s.withColumn("hits", F.array().cast(_HITS)).withColumn("bypass", F.lit(False))
    routed = ~F.col("bypass")
    if c.rag_use_multi_query:
        s = e.ask(s, "router_multi", prompts.router_multi(q), "route", where=routed)
        s = s.withColumn("queries", parsing.parse_search_queries(F.col("route"), F.array(q)))
        s = s.withColumn("query", F.when(routed, F.array_join("queries", " || ")).otherwise(q))
        s = _multi(e, s, F.col("queries"), routed, k)
    else:
        s = e.ask(s, "router", prompts.router(q), "route", where=routed)
        s = s.withColumn("query", F.when(routed, parsing.parse_search_query(F.col("route"))).otherwise(q))
        s = e.look_up(s, F.col("query"), "hits", k, where=routed)
    s = s.withColumn("loops", F.lit(1)).withColumn("history", F.array().cast("array<struct<loop:int,query:string,reason:string>>"))
    if c.rag_enable_backtracking:
        going = F.lit(True)
        for loop in range(1, c.rag_max_retrieval_loops):
            s = e.ask(s, "researcher_eval", prompts.sufficiency(q, F.col("query"), hits, c.rag_max_passage_tokens), f"judged{loop}", where=going)
            s = s.withColumn("j_", parsing.parse_relevance(F.col(f"judged{loop}")))
            again = F.col(f"judged{loop}").isNotNull() & F.contains(F.col("j_.relevance"), F.lit("insufficient")) & (F.size(hits) > 0)
            s = s.withColumn(f"again{loop}", F.coalesce(again, F.lit(False))).withColumn("reason_", F.col("j_.reason")).drop("j_")
            going = F.col(f"again{loop}")
            s = e.ask(s, "router_reformulate", prompts.reformulate(q, F.col("query"), F.col("reason_")), f"reroute{loop}", where=going)
            step = F.array(F.struct(F.lit(loop).alias("loop"), F.col("query").alias("query"), F.col("reason_").alias("reason")))
            s = s.withColumn("history", F.when(going, F.concat("history", step)).otherwise(F.col("history")))
            s = s.withColumn("query", F.when(going, parsing.parse_search_query(F.col(f"reroute{loop}"))).otherwise(F.col("query"))).withColumn("loops", F.col("loops") + going.cast("int"))
            s = e.look_up(s, F.col("query"), "hits", k, where=going)
    if c.rag_heuristic_compression:
        s = s.withColumn("hits", _budget(hits, 350)).withColumn("brief", _brief(hits))
    else:
        s = e.ask(s, "researcher_synthesis", prompts.synthesis(q, hits, c.rag_max_passage_tokens), "brief", where=F.size(hits) > 0)
        s = s.withColumn("brief", F.coalesce("brief", F.lit(NO_EVIDENCE)))
    s = e.ask(s, "reasoner", prompts.reasoner(q, o, F.col("brief"), lesson), "proposal", context=_context(hits))
    s = s.withColumn("candidate", parsing.parse_answer(F.col("proposal"))["answer"])
    s = e.ask(s, "verifier_review", prompts.review(q, o, F.col("brief"), F.col("candidate"), parsing.strip_answer(F.col("proposal"))), "review")
    s = s.withColumn("r_", parsing.parse_review(F.col("review"))).withColumn("decision", F.col("r_.decision")).withColumn("memo", F.col("r_.memo")).drop("r_")
    against = F.contains(F.col("decision"), F.lit("disagree"))
    if c.rag_enable_debate:
        s = e.ask(s, "reasoner_debate", prompts.debate(q, o, F.col("brief"), F.col("candidate"), F.col("memo")), "rebuttal", where=against)
        s = e.ask(s, "verifier_consensus", prompts.consensus(q, o, F.col("brief"), F.col("proposal"), F.col("memo"), F.col("rebuttal")), "agreed", where=against)
        final = F.when(against, F.col("agreed")).otherwise(F.col("proposal"))
        debated = F.when(against, F.array(F.struct(F.col("memo").alias("memo"), F.col("rebuttal").alias("reply"))))
    else:
        final = F.when(against, F.col("review")).otherwise(F.col("proposal"))
        debated = F.lit(None)
    return _result(s, variant, final, final, router_query=F.col("query"), retrieved_passages=_ids(hits), decision=F.col("decision"), loops=F.col("loops"), backtrack_history=F.col("history"), debate_history=debated, **trace)


def _v2_from(e: Engine, s: DataFrame, variant: str, lesson: Column | None = None, **trace: Column) -> DataFrame:
    c = e.config
    advanced = c.rag_enable_backtracking or c.rag_enable_debate
    return (_v2_advanced if advanced else _v2_baseline)(e, s, variant, lesson, **trace)


def v2(e: Engine, questions: DataFrame) -> DataFrame:
    return _v2_from(e, e.start(questions), "V2")


def _with_memory(e: Engine, s: DataFrame) -> DataFrame:
    """`memory_brief` and `n_exemplars`, from the cases closest to each question."""
    cases = e.cases if e.cases is not None else memory.default_cases(e.spark)
    one = cases.dropDuplicates(["case_id"])
    found = memory.exemplars(s.select("question_id", "question"), "question_id", "question", cases, e.config.memory_top_k)
    item = F.struct("rank", F.coalesce("question", F.lit("")).alias("question"), F.coalesce("correct_answer", F.lit("")).alias("correct_answer"), F.coalesce("explanation", F.lit("")).alias("explanation"))
    lists = found.join(one, "case_id").groupBy("question_id").agg(F.array_sort(F.collect_list(item)).alias("ex"))
    s = s.join(lists, "question_id", "left")
    s = s.withColumn("n_exemplars", F.coalesce(F.size("ex"), F.lit(0))).withColumn("shown", F.coalesce(tools.few_shot(F.col("ex")), F.lit(""))).drop("ex")
    return e.ask(materialize(s, "memory"), "memory_specialist", prompts.memory(F.col("question"), F.col("shown")), "memory_brief")


def v3(e: Engine, questions: DataFrame) -> DataFrame:
    s = _with_memory(e, e.start(questions))
    brief = F.col("memory_brief") if e.memory_in_reasoner else None
    return _v2_from(e, s, "V3", brief, memory_brief=F.col("memory_brief"), memory_exemplars_count=F.col("n_exemplars"))


def v4(e: Engine, questions: DataFrame) -> DataFrame:
    """Memory, router, researcher and reasoner, without a verifier."""
    c, q, o, hits = e.config, F.col("question"), F.col("options"), F.col("hits")
    s = _with_memory(e, e.start(questions))
    s = e.ask(s, "router", prompts.router(q), "route")
    s = research(e, s, parsing.parse_search_query(F.col("route")))
    if c.rag_heuristic_compression:
        s = s.withColumn("brief", _brief(hits))
    else:
        s = e.ask(s, "researcher_synthesis", prompts.synthesis(q, hits, c.rag_max_passage_tokens), "brief", where=F.size(hits) > 0)
        s = s.withColumn("brief", F.coalesce("brief", F.lit(NO_EVIDENCE)))
    s = e.ask(s, "reasoner", prompts.reasoner(q, o, F.col("brief"), F.col("memory_brief")), "reply", context=_context(hits))
    return _result(s, "V4", F.col("reply"), F.col("reply"), router_query=F.col("query"), retrieved_passages=_ids(hits), memory_brief=F.col("memory_brief"), memory_exemplars_count=F.col("n_exemplars"))


FLOWS = {"V0": v0, "V1": v1, "V2": v2, "V3": v3, "V4": v4}


def answer(e: Engine, questions: DataFrame, variant: str) -> DataFrame:
    if variant not in FLOWS:
        raise NotImplementedError(f"no flow is named {variant!r}")
    return FLOWS[variant](e, questions)


def run(e: Engine, questions: DataFrame, variants: list[str], path: str | None = None) -> DataFrame:
    """Prediction records of several variants, written to `path` if named."""
    from corvane.operators.evaluation import records
    from corvane.sources.tables import write_predictions

    parts = [records(answer(e, questions, v), questions) for v in variants]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if path:
        write_predictions(out, path)
    return out
