"""The agents' tools as column expressions, and their catalog.

The texts that they put together (sub-queries, headings of exemplars, messages) are fixed
values: they have to equal those of other implementations of these tools.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T

# What names a question that can be answered directly.
DIRECT_PHRASES = ("first-line", "drug of choice", "causative organism", "treatment for")


def decompose(question: Column) -> Column:
    """Three narrower queries."""
    ends = ("symptoms diagnosis presentation", "pathogenesis biological mechanism etiology", "pharmacology treatment first line therapy")
    return F.array(*[F.concat(question, F.lit(f" {e}")) for e in ends])


def hyde_context(question: Column) -> Column:
    return F.concat(F.lit("Hypothetical clinical textbook passage discussing diagnosis and mechanisms for: "), F.substring(question, 1, 80))


def is_direct(question: Column) -> Column:
    """Fewer than 30 words and one of the direct phrases."""
    low, any_ = F.lower(question), F.lit(False)
    for p in DIRECT_PHRASES:
        any_ = any_ | F.contains(low, F.lit(p))
    return (T.token_count(question) < 30) & any_


def search_strategy(question: Column) -> Column:
    e = T.entities(question, T.ENTITY_TERMS_B)
    acronym = F.exists(e, lambda x: x.rlike("^[A-Z]{2,}$"))
    return F.when(F.size(e) >= 2, "hybrid").when(acronym, "sparse").otherwise("dense")


def compress_passage(text: Column, words: int = 150) -> Column:
    return T.truncate_words(text, words, "...")


def compress_passages(passages: Column, words: int = 150) -> Column:
    """An array of passages (source, text) as an array of structs (citation_id, source, text),
    numbered from [1], each text cut to `words` words."""
    return F.transform(passages, lambda p, i: F.struct(F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]")).alias("citation_id"), F.coalesce(p["source"], F.lit("Corpus")).alias("source"), compress_passage(p["text"], words).alias("text")))


def option_score(option: Column, passages: Column) -> Column:
    """The share of the option's words that stand in the joined passages; 0.5 without words."""
    w = F.array_except(T.word_set(option), T.strings(T.STOP_OPTION))
    low = F.lower(passages)
    return F.when(F.size(w) > 0, F.size(F.filter(w, lambda x: F.contains(low, x))) / F.size(w)).otherwise(F.lit(0.5))


def eliminated(option: Column, contraindications: Column) -> Column:
    low = F.lower(option)
    return F.exists(contraindications, lambda c: F.contains(low, F.lower(c)))


def confidence(scores: Column) -> Column:
    """Half plus the margin of the best of an array of scores; 0.9 for one, 0.5 for none."""
    s = F.sort_array(scores, asc=False)
    return F.when(F.size(s) == 0, 0.5).when(F.size(s) == 1, 0.9).otherwise(F.least(F.lit(1.0), 0.5 + F.get(s, F.lit(0)) - F.get(s, F.lit(1))))


def citations(text: Column) -> Column:
    """The numbers cited as [n], in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("bigint"))


def audit_citations(text: Column, passages: Column) -> Column:
    """Struct (has_citations, citation_count); without passages there is nothing to cite."""
    n = F.when(passages == 0, 0).otherwise(F.size(citations(text)))
    return F.struct(((passages == 0) | (n > 0)).alias("has_citations"), n.alias("citation_count"))


def unknown_citations(text: Column, passages: Column) -> Column:
    return F.filter(citations(text), lambda n: (n < 1) | (n > passages))


def ungrounded(text: Column, passages: Column) -> Column:
    """More than ten words without a citation, though there are passages."""
    return (passages > 0) & (F.coalesce(F.length(text), F.lit(0)) > 0) & (F.size(citations(text)) == 0) & (T.token_count(text) > 10)


def callback(memo: Column, retries: Column) -> Column:
    again = retries < 2
    message = F.when(again, F.concat(F.lit("Callback Request (Re-Retrieval Required): "), memo)).otherwise("Max retries reached. Executing safe consensus fallback.")
    return F.struct(again.alias("can_retry"), message.alias("message"))


def pearls(exemplars: Column) -> Column:
    """Of an array of structs (question, correct_answer, explanation)."""
    line = F.transform(
        exemplars, lambda x, i: F.concat(F.lit("Exemplar ["), (i + 1).cast("string"), F.lit("]: "), F.substring(x["question"], 1, 80), F.lit("... -> Answer "), x["correct_answer"], F.lit(": "), F.substring(x["explanation"], 1, 100), F.lit("..."))
    )
    return F.when(F.size(exemplars) > 0, F.array_join(line, "\n")).otherwise("No previous clinical exemplars found.")


def few_shot(exemplars: Column) -> Column:
    block = F.transform(
        exemplars, lambda x, i: F.concat(F.lit("**Case #"), (i + 1).cast("string"), F.lit("**:\nQuestion: "), x["question"], F.lit("\nCorrect Answer: "), x["correct_answer"], F.lit("\nExplanation: "), x["explanation"], F.lit("\n"))
    )
    return F.when(F.size(exemplars) > 0, F.concat(F.lit("### Clinical Case Memory Exemplars:\n"), F.array_join(block, "\n"))).otherwise("")


def mechanism_chain(etiology: Column, mechanism: Column, treatment: Column) -> Column:
    return F.concat(F.lit("Etiology: "), etiology, F.lit(" -> Pathogenesis: "), mechanism, F.lit(" -> First-line Therapy: "), treatment)


def consensus(explanation: Column, memo: Column) -> Column:
    return F.concat(F.lit("Consensus Summary: Evaluated Reasoner proposal ('"), F.substring(explanation, 1, 60), F.lit("...') against Verifier Audit ('"), F.substring(memo, 1, 60), F.lit("...'). Consensus reached."))


def option_list(options: Column) -> Column:
    """The options of a map, one on a line, by letter."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(options)), lambda e: F.concat(e["key"], F.lit(") "), e["value"])), "\n")


# Agent, tool, its arguments (name:JSON type, * for optional).
_CATALOG = """
router extract_entities text:string
router generate_hyde_context question:string
router decompose_subqueries question:string
router prune_vignette_noise question:string
router fast_thinking_evaluator question:string options:object
router search_strategy_planner question:string
researcher faiss_dense_search query:string retriever:object* top_k:integer
researcher bm25_sparse_search query:string retriever:object* top_k:integer
researcher rrf_fusion_ranker dense_passages:array sparse_passages:array
researcher mmr_filter_passages passages:array top_k:integer mmr_lambda:number*
researcher evaluate_passages_coverage question:string passages:array
researcher passage_token_compressor passages:array
researcher entity_cooccurrence_scorer query:string passage:string
researcher cross_encoder_rescorer query:string passages:array
memory long_term_memory_search memory_store:object* question:string top_k:integer
memory clinical_pearls_extractor exemplars:array
memory fewshot_exemplar_formatter exemplars:array
memory exemplar_similarity_scorer q1:string q2:string
reasoner differential_diagnosis_evaluator question:string options:object passages:array
reasoner audit_citations explanation:string passage_count:integer
reasoner pathophysiology_chain_builder etiology:string mechanism:string treatment:string
reasoner option_elimination_scorer options:object contraindications:array
reasoner confidence_score_estimator option_scores:object
verifier anti_hallucination_fact_checker explanation:string passages:array
verifier citation_fidelity_verifier explanation:string passages:array
verifier re_retrieval_callback_issuer review_memo:string retry_count:integer*
verifier debate_consensus_synthesizer reasoner_explanation:string verifier_memo:string
"""


def catalog_rows() -> list[tuple[str, str, str]]:
    rows = []
    for line in _CATALOG.strip().splitlines():
        agent, name, *args = line.split()
        fields = [a.rstrip("*").split(":") for a in args]
        schema = {"type": "object", "properties": {n: {"type": t} for n, t in fields}, "required": [a.split(":")[0] for a in args if not a.endswith("*")]}
        rows.append((agent, name, json.dumps(schema, sort_keys=True)))
    return rows


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(catalog_rows(), "agent string, name string, parameters_schema string")


class Registry:
    """Named functions: register, get, list, schemas, execute."""

    def __init__(self) -> None:
        self._tools: dict[str, tuple[Callable, str]] = {}

    def register(self, name: str, function: Callable, schema: str = "{}") -> None:
        self._tools[name] = (function, schema)

    def get(self, name: str) -> Callable | None:
        return self._tools[name][0] if name in self._tools else None

    def names(self) -> list[str]:
        return sorted(self._tools)

    def schemas(self) -> dict[str, dict]:
        return {n: json.loads(s) for n, (_, s) in self._tools.items()}

    def execute(self, name: str, *args, **kwargs):
        if name not in self._tools:
            raise ValueError(f"no tool is named {name!r}")
        return self._tools[name][0](*args, **kwargs)


#: Tools that are functions of columns, by name.
COLUMN_TOOLS: dict[str, Callable] = {
    "extract_entities": lambda c: T.entities(c, T.ENTITY_TERMS_B),
    "generate_hyde_context": hyde_context,
    "decompose_subqueries": decompose,
    "prune_vignette_noise": lambda c: T.prune_query(c, need_entity=False),
    "fast_thinking_evaluator": lambda q, _=None: is_direct(q),
    "search_strategy_planner": search_strategy,
    "evaluate_passages_coverage": T.coverage,
    "passage_token_compressor": compress_passages,
    "entity_cooccurrence_scorer": T.cooccurrence,
    "cross_encoder_rescorer": T.rescore,
    "clinical_pearls_extractor": pearls,
    "fewshot_exemplar_formatter": few_shot,
    "exemplar_similarity_scorer": T.text_jaccard,
    "differential_diagnosis_evaluator": option_score,
    "audit_citations": audit_citations,
    "pathophysiology_chain_builder": mechanism_chain,
    "option_elimination_scorer": eliminated,
    "confidence_score_estimator": confidence,
    "anti_hallucination_fact_checker": ungrounded,
    "citation_fidelity_verifier": unknown_citations,
    "re_retrieval_callback_issuer": callback,
    "debate_consensus_synthesizer": consensus,
}


def toolkit(agent: str) -> Registry:
    """The registry of one agent; searches are operators on tables and bound by the caller."""
    from corvane.operators import bm25, dense, fusion, memory

    tables = {"faiss_dense_search": dense.dense_topk, "bm25_sparse_search": bm25.search, "rrf_fusion_ranker": fusion.rrf, "mmr_filter_passages": fusion.mmr_greedy, "long_term_memory_search": memory.exemplars}
    r = Registry()
    for owner, name, schema in catalog_rows():
        if owner == agent:
            r.register(name, COLUMN_TOOLS.get(name) or tables[name], schema)
    return r
