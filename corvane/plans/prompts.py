"""Prompts as column expressions: what each role is shown, and in what order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import truncate_words
from corvane.functions.tools import option_list

ANSWER_LINE = "End with a line of the form 'Final Answer: X', where X is one of the letters."


def _parts(*parts: Column | str) -> Column:
    return F.concat_ws("\n\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _titled(title: str, body: Column) -> Column:
    return F.concat(F.lit(f"{title}:\n"), F.coalesce(body, F.lit("")))


def _case(question: Column, options: Column) -> Column:
    return F.concat(_titled("Question", question), F.lit("\n\n"), _titled("Options", option_list(options)))


def passages_block(passages: Column, words: int = 200) -> Column:
    """Numbered texts of an array of structs (source, text), each cut to `words` words."""
    return F.array_join(F.transform(passages, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] ("), F.coalesce(p["source"], F.lit("unknown")), F.lit(") "), F.coalesce(truncate_words(p["text"], words), F.lit("")))), "\n")


def direct(question: Column, options: Column) -> Column:
    return _parts("Answer the multiple-choice question and explain why.", _case(question, options), ANSWER_LINE)


def with_passages(question: Column, options: Column, passages: Column, words: int = 200) -> Column:
    return _parts("Answer the multiple-choice question from the passages and cite them as [n].", _titled("Passages", passages_block(passages, words)), _case(question, options), ANSWER_LINE)


def router(question: Column) -> Column:
    return _parts("Write one search query for the question, on a line 'Search Query: ...'.", _titled("Question", question))


def router_multi(question: Column) -> Column:
    return _parts("Write up to three search queries for the question, each on a line 'Search Query n: ...'.", _titled("Question", question))


def reformulate(question: Column, failed: Column, reason: Column) -> Column:
    return _parts("The search found too little. Write a better one on a line 'Search Query: ...'.", _titled("Question", question), _titled("Failed query", failed), _titled("Reason", reason))


def sufficiency(question: Column, query: Column, passages: Column, words: int = 200) -> Column:
    return _parts("Judge whether the passages suffice. Lines: 'Relevance: sufficient|insufficient', 'Reason: ...', 'Suggested Focus: ...'.", _titled("Question", question), _titled("Query", query), _titled("Passages", passages_block(passages, words)))


def synthesis(question: Column, passages: Column, words: int = 200) -> Column:
    return _parts("Sum up what the passages say on the question, with citations [n].", _titled("Question", question), _titled("Passages", passages_block(passages, words)))


def memory(question: Column, exemplars: Column) -> Column:
    return _parts("Say what the solved cases teach for the question.", _titled("Cases", exemplars), _titled("Question", question))


def reasoner(question: Column, options: Column, brief: Column, memory_brief: Column | None = None) -> Column:
    parts = ["Reason step by step over the evidence and propose an answer.", _titled("Evidence", brief)]
    if memory_brief is not None:
        parts.append(F.when(memory_brief.isNotNull(), _titled("Memory", memory_brief)))
    return _parts(*parts, _case(question, options), ANSWER_LINE)


def verifier(question: Column, options: Column, passages: Column, candidate: Column, explanation: Column, words: int = 200) -> Column:
    return _parts("Check the proposal against the passages and give the answer.", _titled("Passages", passages_block(passages, words)), _case(question, options), _titled("Proposed answer", candidate), _titled("Explanation", explanation), ANSWER_LINE)


def review(question: Column, options: Column, brief: Column, candidate: Column, explanation: Column) -> Column:
    return _parts("Review the proposal. Lines: 'Decision: agree|disagree', 'Review Memo: ...'.", _titled("Evidence", brief), _case(question, options), _titled("Proposed answer", candidate), _titled("Explanation", explanation))


def debate(question: Column, options: Column, brief: Column, candidate: Column, memo: Column) -> Column:
    return _parts("Answer the reviewer's objection; keep or change the answer.", _titled("Evidence", brief), _case(question, options), _titled("Proposed answer", candidate), _titled("Objection", memo), ANSWER_LINE)


def consensus(question: Column, options: Column, brief: Column, first: Column, memo: Column, second: Column) -> Column:
    return _parts("Decide after the debate.", _titled("Evidence", brief), _case(question, options), _titled("Proposal", first), _titled("Objection", memo), _titled("Reply", second), ANSWER_LINE)
