import pytest

from corvane import queries as core
from corvane.plans.clients import ScriptedClient

LONG = "A teacher has a rash and fever and asks a question that goes on well beyond sixty characters, "
Q = [
    ("dev-1", LONG + "and mrsa grows; what is the drug of choice?", {"A": "a", "B": "b", "C": "c", "D": "d", "E": "e"}, "E", "s"),
    ("test-7", "word " * 40 + "treatment for", {"A": "a", "B": "b", "C": "c", "D": "d"}, "C", "s"),
    ("train-3", "Short stem.", {"B": "b", "A": "a"}, None, "s"),
    ("train-4", None, None, "A", "s"),
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(Q, "question_id string, question string, options map<string,string>, answer string, source string").write.parquet(f"{d}/questions.parquet")
    return d


def rows(spark, d, name):
    return {r[0]: tuple(r)[1:] for r in core.queries()[name](spark, d).collect()}


def test_stems_and_endings_are_whole(spark, tables):
    got = rows(spark, tables, "synonym_expand")
    assert all(got[k][0].startswith(t or "") for k, t, *_ in Q)
    assert "methicillin-resistant" in got["dev-1"][0]
    assert rows(spark, tables, "fast_path") == {"dev-1": (True,), "test-7": (False,), "train-3": (False,), "train-4": (False,)}
    assert rows(spark, tables, "options_mapped") == {"dev-1": ("a", "b", "c", "d", "e", "E"), "test-7": ("a", "b", "c", "d", None, "C"), "train-3": ("a", "b", None, None, None, None)}


def test_flows_take_all_evaluation_questions(spark, monkeypatch, tables):
    asked = {}
    monkeypatch.setattr(core, "_engine", lambda *a, **k: None)
    monkeypatch.setattr(core.pipeline, "answer", lambda e, q, v: asked.update({v: {r["question_id"] for r in q.collect()}}) or spark.sql("select '' question_id, '' variant, '' answer, true is_valid, 0 total_tokens, 0 n_calls, named_struct('decision', '') trace"))
    for name in ("variant_v0", "variant_v1", "variant_v2", "variant_v3", "variant_v4"):
        core.queries()[name](spark, tables)
    assert asked == {v: {"dev-1", "test-7"} for v in core.VARIANTS}


def test_scripted_router_returns_the_whole_question():
    q = LONG + "with\nmore lines\n\nand more."
    flat = " ".join(q.splitlines())
    ask = lambda role, rest="": ScriptedClient().complete(role, f"Write.\n\nQuestion:\n{q}{rest}", "m", 0.0).text
    assert ask("router") == f"Search Query: {flat}"
    assert ask("router_reformulate", "\n\nFailed query:\nold\n\nReason:\nnone") == f"Search Query: {flat} again"
