import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corvane.operators import bm25, caching, chunking, components, dag, dataset, dense, evaluation, fusion, memory, sampling


def rows(df):
    return [tuple(r) for r in df.collect()]


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "id string, text string")


def test_chunks(spark):
    d = docs(spark, " ".join(map(str, range(10))), "", None, "  ")
    got = chunking.chunk_flat(d, "id", "text", 4).orderBy("ix").collect()
    assert [len(r["text"].split()) for r in got] == [4, 4, 2] and got[0]["chunk_id"] == "d0::chunk-0"
    over = chunking.chunk_flat(d, "id", "text", 4, 1).orderBy("ix").collect()
    assert [r["text"] for r in over] == ["0 1 2 3", "3 4 5 6", "6 7 8 9"]
    h = chunking.chunk_hierarchy(docs(spark, " ".join(map(str, range(18)))), "id", "text", 4, 8)
    p = {r["chunk_id"]: r["text"] for r in h.where("parent_id is null").collect()}
    c = h.where("parent_id is not null").orderBy("child_ix").collect()
    assert [r["chunk_id"] for r in c] == [f"d0::child-{i}" for i in range(5)]
    whole = defaultdict(list)
    for r in c:
        whole[r["parent_id"]].append(r["text"])
    assert {k: " ".join(v) for k, v in whole.items()} == p
    for bad in ((0, 8), (8, 4)):
        with pytest.raises(ValueError):
            chunking.chunk_parents(d, "id", "text", *bad)
    with pytest.raises(ValueError):
        chunking.chunk_flat(d, "id", "text", 0)
    assert chunking.chunk_flat(d.limit(0), "id", "text").count() == 0


def test_bm25_against_python(spark, tmp_path):
    texts = ["the cat sat", "the dog sat on the cat", "", None, "birds fly high"]
    ix = bm25.build(docs(spark, *texts), "id", "text")
    ix.save(str(tmp_path / "ix"))
    ix = bm25.Index.load(spark, str(tmp_path / "ix"))
    q = spark.createDataFrame([("q0", "cat cat sat"), ("q1", "zebra"), ("q2", "fly")], "q string, t string")
    got = {(r["q"], r["doc_id"]): r["score"] for r in bm25.search(ix, q, "q", "t", 10).collect()}
    toks = [(t or "").split() for t in texts]
    n, avg = len(toks), sum(map(len, toks)) / len(toks)
    df = Counter(w for t in toks for w in set(t))
    want = {}
    for qid, qt in (("q0", {"cat", "sat"}), ("q1", {"zebra"}), ("q2", {"fly"})):
        for i, t in enumerate(toks):
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in qt if w in t)
            if s:
                want[qid, f"d{i}"] = s
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert bm25.search(ix, q.limit(0), "q", "t").count() == 0


def test_dense(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 0.0]), ("n", None)], "id string, v array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.1])], "q int, qv array<float>")
    got = dense.dense_topk(v, "id", "v", q, "q", "qv", 9).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["a", "c", "b"]
    assert dense.check_vectors(v.where("v is not null"), "v") == 2
    for bad in (v, v.limit(0)):
        with pytest.raises(ValueError):
            dense.check_vectors(bad, "v")
    assert dense.dense_topk(v.limit(0), "id", "v", q, "q", "qv").count() == 0


HITS = "q string, passage_id string, text string, score double, rank int"


def test_fusion(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "q string, passage_id string, rank int")
    b = spark.createDataFrame([("q", "y", 1)], "q string, passage_id string, rank int")
    r = {x["passage_id"]: x["score"] for x in fusion.rrf(a, b, "q").collect()}
    assert abs(r["y"] - (1 / 61 + 1 / 60)) < 1e-12 and abs(r["x"] - 1 / 60) < 1e-12
    r = {x["passage_id"]: x["score"] for x in fusion.rrf(a, b, "q", rank_base=1).collect()}
    assert abs(r["x"] - 1 / 61) < 1e-12
    assert fusion.fetch_size(3, 2, mmr=True, hybrid=True) == 16
    best = spark.createDataFrame([("q", "x", 2 / 60, 1), ("r", "x", 0.027, 1), ("s", "x", 0.01, 1)], "q string, passage_id string, score double, rank int")
    assert {x["q"]: x["limit_"] for x in fusion.dynamic_limit(best, "q", 3).collect()} == {"q": 1, "r": 2, "s": 3}


def test_mmr(spark):
    h = spark.createDataFrame([("q", "p1", "a b c", 0.9, 1), ("q", "p2", "a b c", 0.9, 2), ("q", "p3", "x y z", 0.5, 3)], HITS)
    skip = fusion.mmr_skip(h, "q", 3, 0.5).orderBy("rank").collect()
    assert [r["passage_id"] for r in skip] == ["p1", "p3"]
    greedy = fusion.mmr_greedy(h, "q", 2, 0.7).orderBy("rank").collect()
    assert [r["passage_id"] for r in greedy] == ["p1", "p3"]
    assert [r["passage_id"] for r in fusion.mmr_greedy(h, "q", 3).orderBy("rank").collect()] == ["p1", "p2", "p3"]
    b = fusion.token_budget(h, "q", 5).orderBy("rank").collect()
    assert [r["text"] for r in b] == ["a b...", "a b...", "x y..."]
    empty = h.limit(0)
    assert fusion.mmr_greedy(empty, "q", 2).count() == 0


def test_parents(spark):
    p = spark.createDataFrame([("P", "s", "whole text", None), ("c1", "s1", "whole", "P"), ("c2", "s1", "text", "P"), ("o", "s2", "orphan", "gone")], "passage_id string, source string, text string, parent_id string")
    h = spark.createDataFrame([("q", "c1", 0.9, 1), ("q", "c2", 0.8, 2), ("q", "o", 0.7, 3), ("q", "lost", 0.6, 4)], "q string, passage_id string, score double, rank int")
    got = fusion.dedup_parents(fusion.with_context(h, p), "q").orderBy("rank").collect()
    assert [(r["passage_id"], r["source"], r["text"]) for r in got] == [("c1", "s", "whole text"), ("o", "s2", "orphan")]


def test_sampling(spark):
    d = spark.createDataFrame([(f"i{k:03}",) for k in range(60)], "id string")
    one = {r[0] for r in sampling.deterministic_sample(d, "id", 10, 1, "dev").collect()}
    assert one == {r[0] for r in sampling.deterministic_sample(d.orderBy(F.desc("id")), "id", 10, 1, "dev").collect()} and len(one) == 10
    assert one != {r[0] for r in sampling.deterministic_sample(d, "id", 10, 1, "test").collect()}
    assert sampling.deterministic_sample(d, "id", 0, 1, "dev").count() == 0
    for n in (-1, 61):
        with pytest.raises(ValueError):
            sampling.deterministic_sample(d, "id", n, 1, "dev")
    at = sampling.sample_positions(60, 7, 1, "dev")
    assert at == sorted(at) and len(set(at)) == 7
    p = d.withColumn("pos", F.substring("id", 2, 3).cast("long"))
    assert sorted(r["pos"] for r in sampling.shuffle_sample(p, "pos", 7, 1, "dev").collect()) == at


def test_memory(spark):
    cases = memory.default_cases(spark)
    q = spark.createDataFrame([(1, "raised troponin and chest pain"), (2, ""), (3, None)], "k int, t string")
    got = {(r["k"], r["rank"]): r["case_id"] for r in memory.exemplars(q, "k", "t", cases, 2).collect()}
    assert got[1, 1] == "default-2" and got[2, 1] == "default-1" and got[3, 2] == "default-2"
    assert memory.add_case(cases, cases.limit(1).drop("ord")).agg(F.max("ord")).first()[0] == 3
    assert memory.exemplars(q, "k", "t", cases.limit(0)).count() == 0


def test_cache(spark):
    calls = spark.sparkContext.accumulator(0)
    req = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "cache_key string, n int")
    cache = spark.createDataFrame([("a", "old")], "cache_key string, text string")

    def compute(frames):
        for f in frames:
            calls.add(len(f))
            yield f[["cache_key"]].assign(text="new")

    out, new = caching.complete(req, cache, compute, "cache_key string, text string")
    assert sorted((r["n"], r["text"]) for r in out.collect()) == [(1, "old"), (2, "new"), (3, "new")]
    assert calls.value == 1 and new.count() == 1
    again, none = caching.complete(req, cache.unionByName(new), compute, "cache_key string, text string")
    assert none.count() == 0 and calls.value == 1 and again.count() == 3
    assert rows(caching.split_report(req, cache)) == [(3, 2, 1, 1)]


def test_dag_and_components(spark):
    e = spark.createDataFrame([("r", None), ("m", None), ("s", "r"), ("z", "s"), ("z", "m")], "node string, dep string")
    assert dict(rows(dag.levels(e))) == {"r": 0, "m": 0, "s": 1, "z": 2}
    ring = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], "node string, dep string")
    with pytest.raises(ValueError):
        dag.levels(ring)
    assert sorted(r[0] for r in dag.on_cycles(ring).collect()) == ["a", "b"]
    g = dag.Graph()
    g.add("a", lambda r: 1)
    g.add("b", lambda r: r["a"] + 1, {"a"})
    assert g.order() == [["a"], ["b"]] and g.run() == {"a": 1, "b": 2}
    g.add("c", lambda r: 0, {"d"})
    with pytest.raises(ValueError):
        g.order()
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    c = dict(rows(components.connected_components(spark.createDataFrame(chain, "x long, y long"), "x", "y")))
    assert {c[i] for i in range(41)} == {0} and c[101] == 100
    assert components.connected_components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def test_dataset(spark):
    d = spark.createDataFrame([("2", "Which?"), ("1", "what"), ("3", None)], "id string, q string")
    assert rows(dataset.search(d, "q", "WH").select("id").orderBy("id")) == [("1",), ("2",)]
    assert rows(dataset.page(d, "id", 2, 2).select("id")) == [("3",)]
    assert dataset.fan_out(d, ["V0", "V1"]).count() == 6
    o, a = dataset.options_from_endings(["id", "q"], "l")
    assert rows(d.withColumn("l", F.lit(1)).select(o.alias("o"), a.alias("a")).limit(1))[0] == ({"A": "2", "B": "Which?"}, "B")


@pytest.mark.parametrize("win,loss,p", [(32, 20, 0.1272), (38, 25, 0.1306), (39, 20, 0.0191), (28, 16, 0.0973), (0, 0, 1.0)])
def test_mcnemar(win, loss, p):
    assert abs(evaluation.mcnemar_p(win, loss) - p) < 1e-4
    assert 0 <= evaluation.exact_p(win, loss) <= 1


def test_comparison(spark):
    n, win, loss = 1270, 39, 20
    data = []
    for i in range(n):
        a, b = (0, 1) if i < win else (1, 0) if i < win + loss else (1, 1)
        data += [("V2", f"q{i}", a), ("V3", f"q{i}", b)]
    s = spark.createDataFrame(data, "variant string, question_id string, score int")
    r = evaluation.compare(s, [("V2", "V3")]).first()
    assert (r["win"], r["loss"], r["tie"]) == (39, 20, 1211)
    assert (round(r["low"], 2), round(r["high"], 2), round(r["delta"], 2)) == (0.31, 2.68, 1.50)
    b = evaluation.bootstrap(evaluation.paired(s, "V2", "V3")).first()
    assert abs(b["low"] - 0.31) < 0.2 and abs(b["high"] - 2.68) < 0.2
    assert evaluation.with_p_values(evaluation.compare(s, [("V2", "V3")])).first()["p_value"] == pytest.approx(0.0191, abs=1e-4)
    assert evaluation.compare(s.limit(0), [("V2", "V3")]).count() == 0
