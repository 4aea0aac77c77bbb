"""`python -m corvane.cli answer|run`: one question, or a sample of a question file."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import DataFrame, SparkSession

from corvane.operators import sampling
from corvane.plans import clients, factory, pipeline
from corvane.session import build_session, ship_package
from corvane.sources import env, tables
from corvane.sources.config import RunConfig


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corvane", description="Answer questions by one of the flows V0 to V4.")
    commands = p.add_subparsers(dest="command", required=True)
    one = commands.add_parser("answer", help="answer one question")
    one.add_argument("--question", required=True)
    one.add_argument("--options", required=True, help='JSON object from letters to options, as {"A": "...", "B": "..."}')
    many = commands.add_parser("run", help="answer the sample of a question file and write the records")
    many.add_argument("--data", required=True, help="question file, one JSON object a line")
    many.add_argument("--output", required=True, help="folder of the records")
    many.add_argument("--log", help="folder of the call log")
    for c in (one, many):
        c.add_argument("--config", required=True, help="JSON file of the settings")
        c.add_argument("--variant", default="V0", choices=pipeline.VARIANTS)
        c.add_argument("--index", help="folder of an index that build_index wrote; without it nothing is retrieved")
        c.add_argument("--client", default="scripted", choices=("scripted", "http"))
        c.add_argument("--url", default="")
        c.add_argument("--key-prefix", default="API_KEY")
        c.add_argument("--env-file", default=".env", help="KEY=VALUE lines; what the shell exports comes first")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    """Runs the command and returns its result, which `answer` prints as JSON too."""
    a = build_parser().parse_args(argv)
    config = RunConfig.from_json_file(a.config)
    spark = spark or build_session()
    ship_package(spark)
    env.load_env_file(a.env_file)
    client = clients.make_client(a.client, a.url, dict(os.environ), a.key_prefix, config.model, config.model)
    engine = factory.build_stack(spark, config, client, a.index)
    if a.command == "answer":
        row = ("cli-question", a.question, json.loads(a.options))
        questions = spark.createDataFrame([row], "question_id string, question string, options map<string,string>")
        out = pipeline.answer(engine, questions, a.variant)
        print(out.toJSON().first())
        return out
    questions = sampling.sample_dev(tables.read_questions(spark, a.data), "question_id", config)
    out = pipeline.run(engine, questions, [a.variant], a.output)
    if a.log:
        engine.save_calls(a.log)
    return out


if __name__ == "__main__":
    main()
