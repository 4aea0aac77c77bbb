"""Long-term memory of solved cases."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import bm25
from corvane.session import materialize

SCHEMA = "case_id string, ord int, question string, options map<string,string>, correct_answer string, explanation string"


def case_words() -> F.Column:
    """The distinct words of a case: question, options and explanation."""
    parts = [F.coalesce(F.col("question"), F.lit("")), F.coalesce(F.array_join(F.map_values("options"), " "), F.lit("")), F.coalesce(F.col("explanation"), F.lit(""))]
    return T.word_set(F.concat_ws(" ", *parts))


def exemplars(queries: DataFrame, key: str, text: str, cases: DataFrame, k: int = 2) -> DataFrame:
    """Rows (key, case_id, overlap, rank): the k cases with most of the query's words.

    Cases without a common word still rank, by `ord`. Common words are counted where a case
    is read, for blocks of queries, and only each task's k best of a query are shuffled. The k
    first cases by `ord` fill up short lists.
    """
    spark = queries.sparkSession
    q = queries.select(F.col(key).alias("query"), F.explode(F.array_except(T.word_set(F.coalesce(F.col(text), F.lit(""))), T.strings(T.STOP_COVERAGE))).alias("term"))
    dealt = cases.repartition(spark.sparkContext.defaultParallelism, "case_id")
    c = dealt.groupBy("case_id").agg(F.min("ord").alias("ord"), F.max(F.struct("question", F.map_values("options").alias("o"), "explanation")).alias("m"))
    words = T.word_set(F.concat_ws(" ", F.coalesce("m.question", F.lit("")), F.coalesce(F.array_join("m.o", " "), F.lit("")), F.coalesce("m.explanation", F.lit(""))))
    docs = c.select(_place().alias("doc_id"), words.alias("terms")).select("doc_id", F.size("terms").alias("len"), "terms", F.array_repeat(F.lit(1), F.size("terms")).alias("tfs"))
    docs = materialize(docs, "cases")
    one = lambda x, *_: np.ones(len(x))
    found = bm25.scan(docs, q.withColumn("df", F.lit(1)), k, one, one, 1.0)
    first = docs.select("doc_id").orderBy("doc_id").limit(k)
    both = queries.select(key).distinct().crossJoin(F.broadcast(first)).withColumn("overlap", F.lit(0).cast("bigint"))
    if found is not None:
        both = found.select(F.col("query").alias(key), "doc_id", F.col("score").cast("bigint").alias("overlap")).unionByName(both)
    both = both.groupBy(key, "doc_id").agg(F.max("overlap").alias("overlap"))
    w = Window.partitionBy(key).orderBy(F.desc("overlap"), "doc_id")
    case = F.when(F.substring("doc_id", 12, 1) == "1", F.expr("substring(doc_id, 13)")).alias("case_id")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(key, case, "overlap", "rank")


def _place() -> Column:
    """A text whose order is that by `ord` and `case_id`, nulls first, and that ends with `case_id`."""
    at = F.concat(F.lit("1"), F.lpad((F.col("ord").cast("bigint") + (1 << 31)).cast("string"), 10, "0"))
    return F.concat(F.coalesce(at, F.lit("0" * 11)), F.coalesce(F.concat(F.lit("1"), F.col("case_id")), F.lit("0")))


def add_case(cases: DataFrame, case: DataFrame) -> DataFrame:
    """The case goes to the end."""
    last = cases.agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0]
    return cases.unionByName(case.withColumn("ord", F.lit(last + 1).cast("int")), allowMissingColumns=True)


def default_cases(spark: SparkSession) -> DataFrame:
    """Three cases to begin with."""
    rows = [
        ("default-1", 0, "A young adult has sudden joint pain; gram-negative diplococci are seen in the joint fluid.", {"A": "Ceftriaxone", "B": "Gentamicin"}, "A", "Third-generation cephalosporins act on the cell wall of Neisseria."),
        ("default-2", 1, "A patient with crushing chest pain has raised troponin and ST elevation.", {"A": "Pulmonary embolism", "B": "Myocardial infarction"}, "B", "Coronary occlusion raises troponin."),
        ("default-3", 2, "A febrile patient has nuchal rigidity and cloudy cerebrospinal fluid.", {"A": "Bacterial meningitis", "B": "Migraine"}, "A", "Neutrophils and low glucose in the CSF point to bacteria."),
    ]
    return spark.createDataFrame(rows, SCHEMA)
