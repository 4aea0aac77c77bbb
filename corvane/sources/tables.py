"""Reading and writing the engine's relations: JSON lines, text files, Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.operators.bm25 import Index
from corvane.operators.memory import SCHEMA as CASES

QUESTIONS = "question_id string, question string, options map<string,string>, answer string"
CHUNKS = "passage_id string, source string, text string, parent_id string"
PREDICTIONS = (
    "question_id string, variant string, predicted_answer string, explanation string, correct_answer string, is_correct boolean, is_invalid boolean, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint, "
    "latency_seconds double, trace struct<router_query:string,retrieved_passages:array<string>,memory_exemplars_count:int,decision:string>, record_id bigint, run_day date"
)
SAVED = "question string, options map<string,string>, saved_at timestamp, expected_answer string, question_id string"


class BadRecord(ValueError):
    """A line that can't be read; the message names its file and line."""


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_json_lines(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """Rows of a schema; blank lines are skipped; a bad line or an absent field is an error
    that names it. Line numbers are those of the file, counted where an error is found."""
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    with_bad = T.StructType([*fields.fields, T.StructField("_bad", T.StringType())])
    raw = spark.read.text(path).withColumn("_file", F.input_file_name())
    parsed = raw.where(F.trim("value") != "").withColumn("r", F.from_json("value", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    lacking = F.lit(False)
    for c in required:
        lacking = lacking | F.col(f"r.{c}").isNull()
    bad = parsed.where(F.col("r").isNull() | F.col("r._bad").isNotNull() | lacking).select("_file", "value").limit(1).collect()
    if bad:
        file, value = bad[0]
        at = next((i for i, line in enumerate(spark.read.text(file).toLocalIterator(), 1) if line["value"] == value), 0)
        raise BadRecord(f"{file}:{at}: not a complete record")
    return parsed.select(*[F.col(f"r.{f.name}").alias(f.name) for f in fields.fields])


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return read_json_lines(spark, path, QUESTIONS, ["question_id", "question", "options", "answer"])


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (source, text) of a folder's .txt files; the source is the file's stem."""
    if not _exists(spark, folder):
        raise FileNotFoundError(folder)
    df = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True).withColumn("_file", F.input_file_name())
    return df.select(F.regexp_extract(F.url_decode("_file"), r"([^/]+)\.txt$", 1).alias("source"), F.col("value").alias("text"))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """JSON lines; a null parent is left out of its line."""
    chunks.select("passage_id", "source", "text", "parent_id").write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Files from before parents existed have null parents."""
    return read_json_lines(spark, path, CHUNKS, ["passage_id", "source", "text"])


def write_predictions(records: DataFrame, path: str, form: str = "parquet") -> None:
    """Replaces what is there; Parquet is parted by variant."""
    w = records.write.mode("overwrite")
    (w.option("ignoreNullFields", "false").json(path) if form == "json" else w.partitionBy("variant").parquet(path))


def read_predictions(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    return spark.read.schema(PREDICTIONS).json(path) if form == "json" else spark.read.parquet(path)


def write_vectors(vectors: DataFrame, key: str, vector: str, path: str) -> None:
    from corvane.operators.dense import check_vectors

    check_vectors(vectors, vector)
    vectors.select(F.col(key), F.col(vector).cast("array<float>")).write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.parquet(path)


def write_memory(cases: DataFrame, path: str) -> None:
    cases.write.mode("overwrite").parquet(path)


def read_memory(spark: SparkSession, path: str) -> DataFrame:
    """Empty where nothing was saved yet."""
    return spark.read.schema(CASES).parquet(path) if _exists(spark, path) else spark.createDataFrame([], CASES)


def passage_table(passages: DataFrame) -> DataFrame:
    """Passages unique by id; of several rows with one id the smallest by text."""
    one = passages.where("passage_id is not null").groupBy("passage_id").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("t"), "source", "text", "parent_id")).alias("m"))
    return one.select("passage_id", "m.source", "m.text", "m.parent_id")


def save_question(spark: SparkSession, path: str, question: str, options: dict[str, str], expected_answer: str | None = None, question_id: str | None = None) -> None:
    row = spark.createDataFrame([(question, options, expected_answer, question_id)], "question string, options map<string,string>, expected_answer string, question_id string")
    row.withColumn("saved_at", F.current_timestamp()).select(*[f.name for f in T._parse_datatype_string(SAVED).fields]).coalesce(1).write.mode("append").parquet(path)


def saved_questions(spark: SparkSession, path: str) -> DataFrame:
    """With `ix` from 0, in the order in which they were saved. The list is one user's."""
    df = spark.read.schema(SAVED).parquet(path) if _exists(spark, path) else spark.createDataFrame([], SAVED)
    return df.withColumn("ix", F.row_number().over(Window.orderBy("saved_at", "question")) - 1)


def delete_saved(spark: SparkSession, path: str, ix: int) -> None:
    left = saved_questions(spark, path).where(F.col("ix") != ix).drop("ix")
    rows = left.collect()
    spark.createDataFrame(rows, left.schema).coalesce(1).write.mode("overwrite").parquet(path)


def clear_saved(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], SAVED).write.mode("overwrite").parquet(path)


def first_present(spark: SparkSession, *paths: str) -> DataFrame:
    """The questions of the first path that exists."""
    for p in paths:
        if _exists(spark, p):
            return read_questions(spark, p)
    raise FileNotFoundError(", ".join(paths))


def build_index(docs: DataFrame, key: str, text: str, path: str, child: int = 64, parent: int = 512, hierarchical: bool = True, embed=None) -> None:
    """Chunk, write the passages, index what is searched (children, or flat chunks) and,
    with `embed` (passages to rows (passage_id, vector)), their vectors."""
    from corvane.operators import bm25, chunking

    if hierarchical:
        c = chunking.chunk_hierarchy(docs, key, text, child, parent)
        passages = c.select(F.col("chunk_id").alias("passage_id"), "source", "text", "parent_id")
        searched = passages.where(F.col("parent_id").isNotNull())
    else:
        passages = chunking.chunk_flat(docs, key, text, parent).select(F.col("chunk_id").alias("passage_id"), F.col(key).cast("string").alias("source"), "text", F.lit(None).cast("string").alias("parent_id"))
        searched = passages
    passages.write.mode("overwrite").parquet(f"{path}/passages")
    bm25.build(searched, "passage_id", "text").save(f"{path}/bm25")
    if embed is not None:
        write_vectors(embed(searched), "passage_id", "vector", f"{path}/vectors")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, Index]:
    return spark.read.parquet(f"{path}/passages"), Index.load(spark, f"{path}/bm25")
