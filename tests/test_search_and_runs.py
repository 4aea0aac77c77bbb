import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane import cli
from corvane.operators import bm25, dag, dataset, dense
from corvane.operators.topk import Best
from corvane.plans import clients, embeddings, pipeline
from corvane.plans.clients import CascadeClient, Provider, Reply, ScriptedClient
from corvane.session import clear_scratch, materialize, scratch_dir, stored
from corvane.sources import tables
from corvane.sources.config import RunConfig


def test_best_rows_equal_a_full_sort():
    rng = np.random.default_rng(1)
    scores = np.round(rng.normal(size=(300, 7)), 1)
    keys = [f"k{i:03d}" for i in rng.permutation(300)]
    best = Best(7, 4, pa.string())
    for at in range(0, 300, 37):
        best.add(scores[at : at + 37], pa.array(keys[at : at + 37]))
    for q in range(7):
        want = sorted(range(300), key=lambda i: (-scores[i, q], keys[i]))[:4]
        mine = [(k.as_py(), s) for k, s, x in zip(best.key, best.score, best.query, strict=True) if x == q]
        assert mine == [(keys[i], scores[i, q]) for i in want]


def test_sparse_search_in_blocks(spark, monkeypatch):
    random.seed(2)
    words = [f"w{i}" for i in range(40)] + ["the"] * 40
    docs = [(f"d{i}", " ".join(random.choices(words, k=random.randint(0, 30)))) for i in range(200)] + [("none", None)]
    queries = [(i, " ".join(random.choices(words, k=5))) for i in range(30)] + [(90, ""), (91, None), (92, "unknown")]
    ix = bm25.build(spark.createDataFrame(docs, "id string, text string"), "id", "text")
    q = spark.createDataFrame(queries, "q long, t string")
    found = lambda: sorted((r["q"], r["doc_id"], round(r["score"], 9), r["rank"]) for r in bm25.search(ix, q, "q", "t", 3).collect())
    whole = found()
    monkeypatch.setattr(bm25, "MOST_TERMS", 20)
    assert found() == whole
    assert {r[0] for r in whole} == set(range(30))
    df = {r["term"]: r["df"] for r in ix.terms.collect()}
    n, avgdl = ix.totals.first()
    split = {k: (t or "").split() for k, t in docs}
    for i, t in queries[:30]:
        score = {}
        for d, w in split.items():
            s = sum(np.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * w.count(x) * 2.5 / (w.count(x) + 1.5 * (0.25 + 0.75 * len(w) / avgdl)) for x in set(t.split()) if x in w)
            if s:
                score[d] = s
        want = sorted(score, key=lambda d: (-round(score[d], 9), d))[:3]
        assert [r[1] for r in sorted((r for r in whole if r[0] == i), key=lambda r: r[3])] == want
    assert ix.postings.where("term = 'the'").count() == df["the"]


def test_dense_search_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = [(int(i), rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(120)]
    df = spark.createDataFrame(v, "id int, v array<double>").repartition(3)
    monkeypatch.setattr(dense, "MOST_QUERIES", 4)
    got = {(r["q"], r["rank"]): r["id"] for r in dense.dense_topk(df, "id", "v", df.where("id < 10").select(F.col("id").alias("q"), F.col("v").alias("qv")), "q", "qv", 3).collect()}
    for q in range(10):
        want = sorted(range(120), key=lambda i: (-np.dot(v[i][1], v[q][1]), i))[:3]
        assert [got[q, r] for r in (1, 2, 3)] == want


def test_levels_and_cycles_by_doubling(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(200)], "node int, dep int")
    assert {r["node"]: r["level"] for r in dag.levels(chain).collect()} == {i: i for i in range(200)}
    ring = chain.unionByName(spark.createDataFrame([(1000 + i, 1000 + (i + 1) % 7) for i in range(7)] + [(2000, 1000)], "node int, dep int"))
    with pytest.raises(ValueError, match="8 nodes"):
        dag.levels(ring)
    assert {r["node"] for r in dag.on_cycles(ring).collect()} == {1000 + i for i in range(7)}
    assert dag.on_cycles(chain).count() == 0 and dag.levels(chain.limit(0)).count() == 0


def test_pages_know_the_total(spark):
    df = spark.range(25).select("id")
    assert [tuple(r) for r in dataset.page_with_total(df, "id", 3, 10).collect()] == [(i, 25) for i in range(20, 25)]
    assert dataset.page_with_total(df, "id", 4, 10).count() == 0


def test_stored_tables_follow_their_source(spark, tmp_path):
    made = []

    def make(path):
        made.append(path)
        spark.range(len(made)).write.parquet(path)

    source = str(tmp_path / "t")
    spark.range(3).write.parquet(source)
    a = stored(spark, "test", source, make)
    assert stored(spark, "test", source, make) == a and len(made) == 1
    spark.range(5).write.mode("overwrite").parquet(source)
    assert stored(spark, "test", source, make) != a and len(made) == 2
    materialize(spark.range(3), "test").count()
    assert clear_scratch(spark) > 0 and clear_scratch(spark) == 0 and scratch_dir(spark)


def test_cascade_takes_keys_in_turn_and_tries_again():
    asked, slept = [], []

    class One:
        def __init__(self, key):
            self.key = key

        def complete(self, role, prompt, model, temperature, context_id=None):
            asked.append((self.key, model))
            if len(asked) < 5:
                raise OSError("busy")
            return Reply("yes")

    c = CascadeClient([Provider(One, ["a", "b"], "small", "large"), Provider(One, ["c"], "s2", "l2"), Provider(One, [], "x", "x")], sleep=slept.append)
    assert c.complete("router", "p", "m", 0.0).text == "yes"
    assert asked == [("a", "small"), ("b", "small"), ("c", "s2"), ("a", "small"), ("b", "small")] and len(slept) == 5
    with pytest.raises(RuntimeError):
        CascadeClient([Provider(One, [], "x", "x")]).complete("router", "p", "m", 0.0)
    assert clients.keys_from({"K_1": " a ", "K2": "b", "K": "c"}, "K") == ["a", "b"] and clients.keys_from({"K": "c"}, "K") == ["c"]
    assert clients.tier("eval_coverage") == "light" and clients.tier("router_multi") == "strong"
    with pytest.raises(ValueError):
        clients.make_client("http")


def passages(spark):
    rows = [("b::child-0", "b", "fever and rash", "b::parent-0"), ("b::parent-0", "b", "fever and rash treatment of gout", None), ("c::chunk-1", "c", "gout treatment with rest", None), ("c::chunk-2", "c", "cough", None)]
    return spark.createDataFrame(rows, "passage_id string, source string, text string, parent_id string")


def engine(spark, script=None, **settings):
    p = passages(spark)
    searched = p.where(~F.contains("passage_id", F.lit("parent")))
    vectors = searched.select("passage_id", embeddings.vector(F.col("text")).alias("v"))
    return pipeline.build_engine(spark, RunConfig("m", 0.0, rag_use_hybrid=True, **settings), lambda: ScriptedClient(script), p, bm25.build(searched, "passage_id", "text"), vectors)


def test_researcher_and_retrieval_cache(spark):
    q = spark.createDataFrame([("q1", "fever?", {"A": "gout"}), ("q2", "fever?", {"A": "gout"})], "question_id string, question string, options map<string,string>")
    for mmr in (False, True):
        e = engine(spark, {"router": "Search Query: fever rash || gout rest ||"}, rag_top_k=2, rag_use_mmr=mmr)
        r = {x["question_id"]: x for x in pipeline.answer(e, q, "V4").collect()}
        ids = r["q1"]["trace"]["retrieved_passages"]
        assert len(ids) == 2 and r["q1"]["trace"] == r["q2"]["trace"] and (mmr or set(ids) == {"b::child-0", "c::chunk-1"})
        # Two parts and no whole query, however many questions ask them.
        assert e.retrievals.count() == 2
    again = e.find(q.select("question_id", F.lit("gout rest").alias("query"), "options"), 2)
    assert e.retrievals.count() == 2 and again.count() == 2


def test_settings_reach_the_retrieval(spark):
    q = spark.createDataFrame([("q1", "Nothing.", {"A": "gout"})], "question_id string, query string, options map<string,string>")
    top = lambda **s: [p["passage_id"] for p in engine(spark, **s).find(q, 1).first()["found"]]
    plain = engine(spark).find(q, 2).first()["found"][0]["score"]
    assert engine(spark, rag_use_option_boosting=True).find(q, 2).first()["found"][0]["score"] >= plain + 0.04
    assert engine(spark, rag_relevance_threshold=0.9).find(q, 2).first()["found"] == []
    assert engine(spark).searched != engine(spark, rag_use_hyde=True).searched and len(top(rag_use_hyde=True)) == 1


def test_call_log(spark, tmp_path):
    e = engine(spark)
    q = spark.createDataFrame([("q1", "fever?", None), ("q2", "fever?", None)], "question_id string, question string, options map<string,string>")
    pipeline.answer(e, q, "V0").collect()
    pipeline.answer(e, q, "V0").collect()
    log = e.call_log().collect()
    assert len(log) == 4 and sum(not r["cache_hit"] for r in log) == 2 and all(r["model"] == "m" and "fever?" in r["prompt"] for r in log)
    e.save_calls(str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4 and e.call_log().count() == 0


def test_embedding_cache(spark):
    t = spark.createDataFrame([(0, "fever"), (1, "gout"), (2, "fever"), (3, None)], "ordinal int, q string")
    empty = spark.createDataFrame([], "cache_key string, vector array<float>")
    first, new = embeddings.cached_vectors(t, "q", empty)
    assert new.count() == 3 and first.count() == 4
    one, more = embeddings.cached_vectors(t.where("ordinal = 1"), "q", new)
    assert more.count() == 0 and one.first()["vector"] == [r["vector"] for r in first.collect() if r["ordinal"] == 1][0]
    assert embeddings.cached_vectors(t, "q", new, kind="passage")[1].count() == 3


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "c.json").write_text(json.dumps({"model": "m", "temperature": 0.0, "dev_sample_size": 2, "rag_use_hybrid": True}))
    (tmp_path / "d.jsonl").write_text("".join(json.dumps({"question_id": f"dev-{i}", "question": f"fever {i}?", "options": {"A": "x", "B": "y"}, "answer": "A"}) + "\n" for i in range(4)))
    tables.build_index(spark.createDataFrame([("d1", "fever and rash come with gout")], "id string, text string"), "id", "text", str(tmp_path / "ix"), 3, 6)
    common = ["--config", str(tmp_path / "c.json"), "--env-file", str(tmp_path / "none")]
    cli.main(["answer", "--question", "fever?", "--options", '{"A": "x"}', "--variant", "V1", "--index", str(tmp_path / "ix"), *common], spark)
    assert json.loads(capsys.readouterr().out)["trace"]["retrieved_passages"]
    out = cli.main(["run", "--data", str(tmp_path / "d.jsonl"), "--output", str(tmp_path / "out"), "--log", str(tmp_path / "log"), *common], spark)
    assert out.count() == 2 and spark.read.parquet(str(tmp_path / "out")).count() == 2 and spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_pages_are_asked_for_again(spark):
    def fetch(offset, length):
        import os
        import tempfile

        mark = os.path.join(tempfile.gettempdir(), f"corvane-page-{os.getppid()}-{offset}")
        if offset == 20 and not os.path.exists(mark):
            open(mark, "w").close()
            raise OSError("busy")
        return [{"id": str(offset + i), "sent1": f"q{offset + i}", "ending0": "a", "ending1": None, "label": i % 2, "more": 1, "title": f"t{(offset + i) % 2}", "content": str(offset + i)} for i in range(length)]

    from corvane.sources.pages import read_corpus_pages, read_pages, read_question_pages

    rows = read_pages(spark, fetch, 45, "id string, none string", size=10, pause=0.01).orderBy("row_no").collect()
    assert [(r["row_no"], r["id"], r["none"]) for r in rows] == [(i, str(i), None) for i in range(45)]
    q = read_question_pages(spark, fetch, 12, endings=2, size=10, pause=0.01).orderBy(F.col("question_id").cast("int")).collect()
    assert q[1]["answer"] == "B" and q[0]["options"] == {"A": "a", "B": None} and len(q) == 12
    texts = {r["source"]: r["text"] for r in read_corpus_pages(spark, fetch, 12, size=10, pause=0.01).collect()}
    assert texts == {"t0": "0 2 4 6 8 10", "t1": "1 3 5 7 9 11"}
    with pytest.raises(Exception, match="gone"):
        read_pages(spark, lambda offset, length: (_ for _ in ()).throw(OSError("gone")), 5, "id string", attempts=2, pause=0.01).collect()


def test_index_folders_are_opened_once(spark, tmp_path):
    from corvane.plans import factory

    tables.build_index(spark.createDataFrame([("d1", "fever and rash come with gout")], "id string, text string"), "id", "text", str(tmp_path / "ix"), 3, 6)
    a = factory.retrieval_tables(spark, str(tmp_path / "ix"))
    assert factory.retrieval_tables(spark, str(tmp_path / "ix")) is a
    factory.forget(spark)
    assert factory.retrieval_tables(spark, str(tmp_path / "ix")) is not a and a[2].count() == 2
