import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.functions import hashing, parsing, tools
from corvane.functions import text as T


def one(spark, expr, **cols):
    types = {str: "string", int: "int", list: "array<string>", float: "double", type(None): "string", dict: "map<string,string>"}
    schema = ", ".join(f"{k} {types[type(v)]}" for k, v in cols.items())
    return spark.createDataFrame([tuple(cols.values())], schema).select(expr.alias("x")).first()["x"]


TEXTS = ["", "  two  words\n", "250mg of Naïve (β-cells)", "Ends. Here! Then? more", None, "x " * 3000, "ТЕКСТ на русском", "a_b c d"]


@pytest.mark.parametrize("t", TEXTS)
def test_tokenizers_agree_with_python(spark, t):
    w1, w2 = one(spark, T.blank_words("t"), t=t), one(spark, T.word_tokens("t"), t=t)
    if t is None:
        assert w1 is None and w2 is None
        return
    assert w1 == t.split()
    assert w2 == re.findall(r"\b\w+\b", t.lower())
    assert one(spark, T.sentences("t"), t=t) == re.split(r"(?<=[.!?]) +", t)
    assert set(one(spark, T.keywords("t"), t=t)) == {w for w in re.sub(r"[^\w\s]", " ", t.lower()).split() if len(w) > 3}


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text(alphabet="abcXY .!?_-\n\té1", max_size=40), min_size=60, max_size=60))
def test_tokenizers_on_random_texts(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("t", T.blank_words("t").alias("a"), T.word_tokens("t").alias("b"), T.truncate_words("t", 3).alias("c")).collect():
        assert r["a"] == r["t"].split()
        assert r["b"] == re.findall(r"\b\w+\b", r["t"].lower())
        w = r["t"].split()
        assert r["c"] == (" ".join(w[:3]) + " [Truncated]" if len(w) > 3 else r["t"])


def test_entities_and_rewrites(spark):
    q = "HIV and arthritis with MRSA. It rained. Which of the following is most likely?"
    assert one(spark, T.entities("t"), t=q) == ["HIV", "MRSA", "arthritis"]
    assert one(spark, T.prune_query("t"), t=q) == "HIV and arthritis with MRSA."
    assert one(spark, T.prune_query("t", need_entity=False), t=q) == "HIV and arthritis with MRSA. It rained."
    assert one(spark, T.prune_query("t"), t="What is the cause?") == "What is the cause?"
    assert one(spark, T.expand_synonyms("t"), t="mrsa with csf") == "mrsa with csf cerebrospinal fluid lumbar puncture methicillin-resistant staphylococcus vancomycin"
    assert one(spark, T.expand_synonyms("t"), t="nothing") == "nothing"


def test_compress_jaccard_coverage(spark):
    s = "Fever came. Nothing else. Fever again."
    w = F.array(F.lit("fever"))
    assert one(spark, T.compress_sentences("t", w), t=s) == "Fever came. Fever again."
    assert one(spark, T.compress_sentences("t", F.array(F.lit("zzz"))), t=s) == "Fever came. Nothing else."
    assert one(spark, T.compress_sentences("t", F.array().cast("array<string>")), t=s) == s
    assert one(spark, T.text_jaccard("a", "b"), a="a b c", b="B c d") == 0.5
    assert one(spark, T.text_jaccard("a", "b"), a="", b="x") == 0.0
    c = one(spark, T.coverage("a", "b"), a="the fever and cough rash", b="cough")
    assert (round(c["ratio"], 6), c["is_sufficient"], c["missing"]) == (0.333333, True, ["fever", "rash"])
    assert one(spark, T.cooccurrence("a", "b"), a="arthritis MRSA", b="with mrsa") == 0.5
    assert one(spark, T.cooccurrence("a", "b"), a="plain", b="x") == 0.5


VALID = ["Final Answer: A", "final answer:b", "x\nFinal Answer: (C)", "Final  Answer : D.", "Final Answer: (A) because"]
INVALID = ["", "Final Answer: AB", "FinalAnswer: A", "Final Answer A", "Final Answer: A\nFinal Answer: A", "Final Answer: E", "Final Answer: 1", None]


def test_parse_answer(spark):
    for t in VALID:
        assert one(spark, parsing.parse_answer(F.col("t")), t=t)["is_valid"], t
    for t in INVALID:
        assert not one(spark, parsing.parse_answer(F.col("t")), t=t)["is_valid"], t
    assert one(spark, parsing.parse_answer(F.col("t"), ("A", "B", "C", "D", "E")), t="Final Answer: e")["answer"] == "E"
    assert one(spark, parsing.parse_answer(F.col("t"), lenient=True), t="Option b it is")["answer"] == "B"
    assert one(spark, parsing.strip_answer(F.col("t")), t="Because.\nFinal Answer: (B)") == "Because."
    assert one(spark, parsing.strip_answer(F.col("t")), t="no line") == "no line"


def test_line_parsers(spark):
    assert one(spark, parsing.parse_search_query(F.col("t")), t="x\nSearch Query: a: b\n") == "a: b"
    assert one(spark, parsing.parse_search_query(F.col("t")), t=" plain ") == "plain"
    assert one(spark, parsing.parse_search_queries(F.col("t"), F.array(F.lit("q"))), t="Search Query 1: a\n- search query 2: b\nx") == ["a", "b"]
    assert one(spark, parsing.parse_search_queries(F.col("t"), F.array(F.lit("q"))), t="none") == ["q"]
    r = one(spark, parsing.parse_review(F.col("t")), t="Decision: agree\nReview Memo: m\nDECISION: Disagree")
    assert (r["decision"], r["memo"]) == ("disagree", "m")
    assert one(spark, parsing.parse_relevance(F.col("t")), t="?")["relevance"] == "sufficient"


def test_tools(spark):
    assert one(spark, tools.unknown_citations(F.col("t"), F.lit(2)), t="see [1] and [5]") == [5]
    a = one(spark, tools.audit_citations(F.col("t"), F.lit(2)), t="no")
    assert (a["has_citations"], a["citation_count"]) == (False, 0)
    assert one(spark, tools.audit_citations(F.col("t"), F.lit(0)), t="no")["has_citations"]
    assert one(spark, tools.ungrounded(F.col("t"), F.lit(1)), t="w " * 11) is True
    assert one(spark, tools.search_strategy(F.col("t")), t="HIV") == "sparse"
    assert one(spark, tools.is_direct(F.col("t")), t="The drug of choice?") is True
    assert len(one(spark, tools.decompose(F.col("t")), t="q")) == 3
    assert one(spark, tools.callback(F.lit("m"), F.col("n")), n=2)["can_retry"] is False
    assert len(tools.catalog_rows()) == 27
    r = tools.toolkit("router")
    assert len(r.names()) == 6 and r.get("nope") is None
    with pytest.raises(ValueError):
        r.execute("nope")
    r.register("twice", lambda x: 2 * x)
    assert r.execute("twice", 4) == 8


def test_keys(spark):
    base = dict(role="r", prompt="p", model="m", temperature=0.0, context_id=None)

    def key(**change):
        v = {**base, **change}
        return one(spark, hashing.request_key(*[F.lit(v[k]) for k in ("role", "prompt", "model", "temperature", "context_id")]), z=1)

    keys = {key()} | {key(**{k: x}) for k, x in (("role", "s"), ("prompt", "q"), ("model", "n"), ("temperature", 0.5), ("context_id", "c"), ("context_id", ""))}
    assert len(keys) == 7 and all(len(k) == 64 for k in keys)
    assert key() == key()
    assert int(one(spark, hashing.sub_seed(F.lit(42), F.lit("dev")), z=1)) == __import__("corvane.operators.sampling", fromlist=["x"]).derive_seed(42, "dev")
