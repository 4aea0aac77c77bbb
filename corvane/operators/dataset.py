"""Looking through the question pool, and moving results between shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search(df: DataFrame, text: str, needle: str) -> DataFrame:
    """Rows whose text holds the needle, in any case."""
    return df.where(F.contains(F.lower(text), F.lit(needle.lower()))) if needle else df


def page(df: DataFrame, order: str, number: int, size: int) -> DataFrame:
    """The page `number` (from 1) of `size` rows in the order of a unique column."""
    return df.orderBy(order).offset((number - 1) * size).limit(size)


def page_with_total(df: DataFrame, order: str, number: int, size: int) -> DataFrame:
    """The rows of a page, each with the `total` of all pages. A page past the end has no row."""
    total = df.agg(F.count("*").alias("total"))
    return page(df, order, number, size).crossJoin(F.broadcast(total))


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(order).limit(n)


def children(passages: DataFrame) -> DataFrame:
    return passages.where(F.col("parent_id").isNotNull())


def parents(passages: DataFrame) -> DataFrame:
    return passages.where(F.col("parent_id").isNull())


def fan_out(questions: DataFrame, variants: list[str]) -> DataFrame:
    """Each question once for each of a few variants."""
    return questions.withColumn("variant", F.explode(F.array(*[F.lit(v) for v in variants])))


def options_from_endings(endings: list[str], label: str) -> tuple[Column, Column]:
    """(options by letter, answer letter) of columns with the endings and a label from 0."""
    letters = F.array(*[F.lit(chr(65 + i)) for i in range(len(endings))])
    return F.map_from_arrays(letters, F.array(*[F.col(e) for e in endings])), F.element_at(letters, F.col(label).cast("int") + 1)


def join_rows(rows: DataFrame, title: str, position: str, content: str) -> DataFrame:
    """One text for each title: its rows' contents in order, joined by a blank. A title's
    text is one value and must fit in memory."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.coalesce(F.col(content), F.lit("")).alias("c"))))
    return rows.groupBy(title).agg(F.array_join(F.transform(parts, lambda x: x["c"]), " ").alias("text"))
