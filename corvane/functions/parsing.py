"""Strict readers of model replies, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import stripped

# The answer line, and what the lenient mode takes besides.
ANSWER = r"(?i)Final\s+Answer\s*:\s*\(?\s*([A-Za-z])\s*\)?(?![A-Za-z0-9])"
FALLBACK = r"(?i)(?:Option|Choice|Answer|correct answer is|is)\s*:?\s*\(?\s*([A-D])\s*\)?"
LETTERS = ("A", "B", "C", "D")


def parse_answer(text: Column, valid: tuple[str, ...] = LETTERS, lenient: bool = False) -> Column:
    """Struct (is_valid, answer, reason). Exactly one answer line with a valid letter is
    valid. The lenient mode, without any such line, takes the first letter named as an
    option. Null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    found = F.transform(F.regexp_extract_all(t, F.lit(ANSWER), F.lit(1)), lambda x: F.upper(x))
    n = F.size(found)
    one = F.get(found, F.lit(0))
    allowed = [v.upper() for v in valid]
    other = F.upper(F.regexp_extract(t, FALLBACK, 1))
    rescued = (n == 0) & other.isin(*allowed) if lenient else F.lit(False)
    ok = ((n == 1) & one.isin(*allowed)) | rescued
    answer = F.when(ok & (n == 1), one).when(ok, other)
    reason = (
        F.when(rescued, F.lit("fallback"))
        .when(n == 0, F.lit("no answer line"))
        .when(n > 1, F.concat(F.lit("ambiguous: "), n.cast("string"), F.lit(" answer lines")))
        .when(~ok, F.concat(one, F.lit(" is no valid option")))
    )
    return F.struct(ok.alias("is_valid"), answer.alias("answer"), reason.alias("reason"))


def strip_answer(text: Column) -> Column:
    """Without the answer lines, trimmed."""
    return stripped(F.regexp_replace(text, ANSWER, ""))


def _lines(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda x: stripped(x))


def _after_colon(line: Column) -> Column:
    return stripped(F.regexp_replace(line, r"^[^:]*:", ""))


def parse_search_query(text: Column) -> Column:
    """What follows "search query:" on the first line that begins so, else the whole text."""
    hit = F.get(F.filter(_lines(text), lambda x: F.lower(x).startswith("search query:")), F.lit(0))
    return F.coalesce(_after_colon(hit), stripped(text))


def parse_search_queries(text: Column, fallback: Column) -> Column:
    """What follows the colon on every line that names a search query, else `fallback`."""
    lines = F.filter(_lines(text), lambda x: F.contains(F.lower(x), F.lit("search query")) & F.contains(x, F.lit(":")))
    found = F.filter(F.transform(lines, _after_colon), lambda x: x != "")
    return F.when(F.size(found) > 0, found).otherwise(fallback)


def parse_field(text: Column, field: str, default: str | None = None) -> Column:
    """The value of the last line "field: value" (any case), else the default."""
    hits = F.filter(_lines(text), lambda x: F.lower(x).startswith(f"{field}:"))
    value = F.when(F.size(hits) > 0, _after_colon(F.element_at(hits, -1)))
    return value if default is None else F.coalesce(value, F.lit(default))


def parse_relevance(text: Column) -> Column:
    return F.struct(F.lower(parse_field(text, "relevance", "sufficient")).alias("relevance"), parse_field(text, "reason", "").alias("reason"), parse_field(text, "suggested focus", "").alias("focus"))


def parse_review(text: Column) -> Column:
    return F.struct(F.lower(parse_field(text, "decision", "agree")).alias("decision"), parse_field(text, "review memo", "").alias("memo"))
