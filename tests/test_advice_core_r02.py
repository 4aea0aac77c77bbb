import random

import numpy as np
import pyarrow as pa

from corvane.operators import bm25, fusion, memory, retrieve
from corvane.operators.topk import Best


def test_memory_counts_words_without_pairs(spark, monkeypatch):
    random.seed(4)
    words = [f"w{i}" for i in range(30)] + ["the", "zu"]
    say = lambda n: " ".join(random.choices(words, k=n))
    cases = [(f"c{i % 57:02}", None if i == 3 else i % 57 - 5, say(6) if i % 7 else None, {"A": say(2)}, "A", say(3)) for i in range(57)]
    cases.append(cases[0])
    queries = [(i, say(8)) for i in range(40)] + [(50, None), (51, "the"), (52, "unknown")]
    c, q = spark.createDataFrame(cases, memory.SCHEMA), spark.createDataFrame(queries, "k int, t string")
    got = lambda: sorted(tuple(r) for r in memory.exemplars(q, "k", "t", c, 3).collect())
    words_of = {x[0]: set(" ".join([x[2] or "", *x[3].values(), x[5]]).split()) for x in cases}
    order = {x[0]: (x[1] is not None, x[1] or 0, x[0]) for x in cases}
    want = []
    for k, t in queries:
        common = {x: len(w & set((t or "").split()) - {"the"}) for x, w in words_of.items()}
        want += [(k, x, common[x], r + 1) for r, x in enumerate(sorted(common, key=lambda x: (-common[x], order[x]))[:3])]
    assert got() == sorted(want)
    monkeypatch.setattr(bm25, "MOST_QUERIES", 7)
    assert got() == sorted(want)
    # Words are counted where the cases are read: no join makes a row of each common word.
    plan = memory.exemplars(q, "k", "t", c, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join Inner, (" not in plan


def test_best_of_approximate_scores():
    rng = np.random.default_rng(5)
    exact = np.round(rng.normal(size=(400, 6)), 1)
    rough = (exact + rng.uniform(-0.2, 0.2, exact.shape)).astype(np.float32)
    keys = [f"k{i:03d}" for i in rng.permutation(400)]
    best, looked = Best(6, 3, pa.string()), 0
    for at in range(0, 400, 50):
        row, query = best.likely(rough[at : at + 50], np.full(6, 0.21))
        looked += len(row)
        best.put(row, query, exact[at : at + 50][row, query], pa.array(keys[at : at + 50]))
    assert looked < exact.size / 2
    for q in range(6):
        want = sorted(range(400), key=lambda i: (-exact[i, q], keys[i]))[:3]
        assert [k.as_py() for k, x in zip(best.key, best.query, strict=True) if x == q] == [keys[i] for i in want]


def test_only_hits_that_stay_get_their_texts(spark, monkeypatch):
    passages = spark.createDataFrame([(f"p{i}", "s", f"text {i}", "parent" if i in (0, 2) else None) for i in range(12)] + [("parent", "t", "whole", None)], "passage_id string, source string, text string, parent_id string")
    hits = spark.createDataFrame([("q", f"p{i}", 1.0 - i / 100, i + 1) for i in range(12)] + [("q", "gone", 2.0, 0)], "question_id string, passage_id string, score double, rank int")
    queries = spark.createDataFrame([("q", "stem", "stem")], "question_id string, query string, search_text string")
    seen, whole = [], fusion.with_context
    monkeypatch.setattr(fusion, "with_context", lambda h, p, *a: seen.append(h.count()) or whole(h, p, *a))
    got = retrieve.finish(hits, queries, "question_id", "query", passages, retrieve.Settings(top_k=3))
    assert [tuple(r)[1:4] + (r["rank"],) for r in got.orderBy("rank").collect()] == [("p0", "t", "whole", 1), ("p1", "s", "text 1", 2), ("p3", "s", "text 3", 3)]
    assert seen == [3]
