"""Datasets that a service hands out in pages."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_pages(spark: SparkSession, fetch: Callable[[int, int], list[dict]], total: int, schema: str, size: int = 100, attempts: int = 5, pause: float = 1.0, pages_each: int = 16) -> DataFrame:
    """The rows `fetch(offset, length)` gives for all pages of `size` rows, with `row_no` from 0.

    Tasks fetch `pages_each` pages each. A page that fails is asked for again after pauses that
    grow, up to `attempts` times in all; then its error ends the run, as a page left out would
    be a hole in the dataset. Fields outside the schema are left out, absent ones are null.
    """
    fields = [f.name for f in T._parse_datatype_string(schema).fields]
    pages = -(-total // size)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for page in f["id"]:
                first, rows = int(page) * size, None
                for attempt in range(1, attempts + 1):
                    try:
                        rows = fetch(first, min(size, total - first))
                        break
                    except Exception:
                        if attempt == attempts:
                            raise
                        time.sleep(pause * attempt)
                if rows:
                    yield pd.DataFrame([{"row_no": first + i, **{c: r.get(c) for c in fields}} for i, r in enumerate(rows)], columns=["row_no", *fields])

    ids = spark.range(0, pages, 1, max(1, -(-pages // pages_each)))
    return ids.mapInPandas(run, f"row_no bigint, {schema}")


def read_question_pages(spark: SparkSession, fetch: Callable[[int, int], list[dict]], total: int, endings: int = 4, **paging) -> DataFrame:
    """Questions of a paged dataset with columns id, sent1, ending0 .. and a label from 0."""
    from corvane.operators.dataset import options_from_endings

    names = [f"ending{i}" for i in range(endings)]
    rows = read_pages(spark, fetch, total, "id string, sent1 string, " + ", ".join(f"{n} string" for n in names) + ", label bigint", **paging)
    options, answer = options_from_endings(names, "label")
    return rows.select(F.col("id").alias("question_id"), F.col("sent1").alias("question"), options.alias("options"), answer.alias("answer"))


def read_corpus_pages(spark: SparkSession, fetch: Callable[[int, int], list[dict]], total: int, title: str = "title", content: str = "content", **paging) -> DataFrame:
    """Rows (source, text) of a paged corpus: the contents of each title in their order, joined by a blank."""
    from corvane.operators.dataset import join_rows

    rows = read_pages(spark, fetch, total, f"{title} string, {content} string", **paging)
    return join_rows(rows, title, "row_no", content).withColumnRenamed(title, "source")
