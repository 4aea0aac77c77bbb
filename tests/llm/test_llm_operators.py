import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import canonical, leakage, mixing, nearpairs, packing, quality, quantiles, splits, tokens
from corvane.llm.ranks import ranked

W = re.compile(r"[^\W_]+")


def sets(texts, width, least):
    out = {}
    for k, t in texts:
        w = W.findall(t.lower()) if t and k is not None else []
        if len(w) >= least:
            out[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
    return out


def similar(a, b, t):
    return len(a & b) >= t * len(a | b) - 1e-9


@pytest.fixture(scope="module")
def texts():
    random.seed(7)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[random.choice(vocabulary) for _ in range(random.randint(16, 60))] for _ in range(60)]
    rows = []
    for i, w in enumerate(base):
        rows.append((f"t{i}", " ".join(w)))
        for j in range(random.randint(0, 3)):
            v = list(w)
            for _ in range(random.randint(0, 5)):
                k = random.randrange(len(v))
                v[k : k + 1] = random.choice(([], ["new"], [v[k], "extra"]))
            if random.random() < 0.3:
                c = len(v) // 2
                v = v[c:] + v[:c]
            rows.append((f"t{i}v{j}", " ".join(v)))
    rows += [("null", None), ("empty", ""), ("short", "too few words"), (None, rows[0][1]), rows[3]]
    rows += [(f"copy{i}", " ".join(base[0])) for i in range(90)]
    rows += [("long", " ".join(random.choices(vocabulary, k=20000))), ("flat1", "fever " * 30), ("flat2", "Fever " * 25), ("two1", "a b " * 10), ("two2", "b a " * 9)] + [(f"flat{i}", "fever " * i) for i in range(16, 90)]
    return rows


def test_near_duplicates(spark, texts):
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in texts], "id string, text string, doc int, key string")
    for width, t in ((3, 0.6), (5, 0.8)):
        got = {tuple(r) for r in nearpairs.similar_pairs(df, "id", "text", width, t, 15).collect()}
        s = sets(texts, width, 15)
        keys = sorted(s)
        want = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if similar(s[a], s[b], t)}
        assert got == want
    assert nearpairs.similar_pairs(df.limit(0), "id", "text").count() == 0


def test_split_regions(spark, texts, monkeypatch):
    """Regions of frequent shingles are split, again and again, without losing a pair."""
    some = [(k, t) for k, t in texts if not (k or "").startswith("copy")]
    s = sets(some, 3, 15)
    keys = sorted(s)
    want = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if similar(s[a], s[b], 0.6)}
    for limit in (1, 3):
        monkeypatch.setattr(nearpairs, "REGION", limit)
        assert {tuple(r) for r in nearpairs.similar_pairs(spark.createDataFrame(some, "id string, text string"), "id", "text", 3, 0.6, 15).collect()} == want


def test_regions_of_whole_texts(spark, texts):
    rows = nearpairs.regions_per_text(spark.createDataFrame(texts, "id string, text string"), "id", "text", 3, [0.6, 0.95], [2, 16]).collect()
    n = len({k for k in sets(texts, 3, 15)})
    assert len(rows) == 4 and all(1 <= r["regions"] <= r["n_pivots"] and r["n_texts"] >= n for r in rows)


def test_split_overlaps(spark, texts):
    df = spark.createDataFrame(texts, "id string, text string")
    ev, tr = df.where("id like 't%' or id in ('null', 'flat1', 'two1', 'long')"), df.where("not id like 't%' or id like '%v1' or id is null")
    got = {(r["query_key"], r["corpus_key"]) for r in splits.split_overlaps(ev, "id", "text", tr, "id", "text", 3, 0.6, 15).collect()}
    a, b = sets([(r[0], r[1]) for r in ev.collect()], 3, 15), sets([(r[0], r[1]) for r in tr.collect()], 3, 15)
    assert got == {(x, y) for x in a for y in b if similar(a[x], b[y], 0.6)}
    # Every pair within k edits comes by the segment join, with its edit distance; the others are moved.
    stems = {r[0]: W.findall(r[1].lower()) for df_ in (ev, tr) for r in df_.collect() if r[0] and r[1]}
    paths = Counter()
    for r in splits.split_overlaps(ev, "id", "text", tr, "id", "text", 3, 0.6, 15).collect():
        x, y = stems[r["query_key"]], stems[r["corpus_key"]]
        if len(x) > 1000:
            assert (r["path"], r["edits"]) == ("edits", 0)
            continue
        row = list(range(len(y) + 1))
        for i, v in enumerate(x, 1):
            row, before = [i], row
            for j, u in enumerate(y, 1):
                row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (u != v)))
        k = int(splits.edits_allowed(np.array([len(x)]), 3)[0][0])
        assert (r["path"], r["edits"]) == (("edits", row[-1]) if row[-1] <= k else ("moved", None))
        paths[r["path"]] += 1
    assert paths["edits"] > 20 and paths["moved"] > 5
    assert splits.split_overlaps(ev.limit(0), "id", "text", tr, "id", "text", 3, 0.6).count() == 0
    assert splits.split_overlaps(ev, "id", "text", tr.limit(0), "id", "text", 3, 0.6).count() == 0


def test_leaks(spark, texts):
    random.seed(8)
    stems = [(f"q{i}", " ".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=random.randint(15, 40)))) for i in range(40)] + [("null", None), ("q0", None)]
    corpus = list(texts)
    for i in range(0, 40, 2):
        w = stems[i][1].split()
        n = random.choice([18, 19, 20, 21, len(w)])
        corpus.append((f"leak{i}", "before it " + " ".join(w[-n:]) + " after it"))
        v = list(w)
        v[len(v) // 2] = "changed"
        corpus.append((f"sub{i}", " ".join(v)))
    c, q = spark.createDataFrame(corpus, "id string, text string"), spark.createDataFrame(stems, "id string, text string")
    rows = leakage.leaked_passages(c, "id", "text", q, "id", "text").collect()
    got = {(r["corpus_key"], r["query_key"]) for r in rows if r["run"] >= 20}
    grams = {k: {tuple(w[i : i + 20]) for i in range(len(w) - 19)} for k, t in stems if t for w in [W.findall(t)]}
    want = set()
    for k, t in corpus:
        w = W.findall(t.lower()) if t and k else []
        have = {tuple(w[i : i + 20]) for i in range(len(w) - 19)}
        want |= {(k, s) for s, g in grams.items() if g & have}
    assert got == want and want
    assert {r["corpus_key"] for r in rows if r["run"] < 20} <= {k for k, _ in corpus}
    assert leakage.leaked_passages(c.limit(0), "id", "text", q, "id", "text").count() == 0
    with pytest.raises(ValueError):
        leakage.leaked_passages(c, "id", "text", q, "id", "text", run=10)


def test_same_looking(spark):
    rows = [(1, "fine"), (2, "ﬁne"), (3, "fine"), (4, "Fine"), (5, None), (6, ""), (7, "​"), (8, " "), (9, "ｆine"), (None, "ﬁne"), (2, "ﬁne")]
    df = spark.createDataFrame([(k, t, "x", "y") for k, t in rows], "id long, text string, form string, raw string")
    got = {tuple(r) for r in canonical.same_looking(df, "id", "text").collect()}
    assert got == {(1, 2), (2, 3), (1, 9), (3, 9), (2, 9)}
    assert canonical.with_canonical(df, "text", "form").where("id = 9").first()["form"] == "fine"
    assert canonical.same_looking(df.limit(0), "id", "text").count() == 0


def test_defects(spark):
    a = spark.createDataFrame([(1, "q", None, "z"), (1, "q", None, "z"), (2, "q", "All good here. [1]", "z"), (3, "lost", "It breaks off because the", "z"), (None, "q", "", "z"), (4, None, "B", "z")], "id long, q string, text string, defects string")
    q = spark.createDataFrame([("q", "What is it that hurts?", {"A": "Gout"}), ("q", "What is it that hurts?", {"A": "Gout"}), (None, None, None)], "qid string, stem string, options map<string,string>")
    got = {r["id"]: r["defect"] for r in quality.first_defect(quality.defective_pairs(a, "id", "text", "q", q, "qid", "stem", "options"), "id").collect()}
    assert got == {1: "empty", 3: "truncated", 4: "empty"}
    assert quality.defective_pairs(a.limit(0), "id", "text", "q", q.limit(0), "qid", "stem", "options").count() == 0


def test_defects_by_a_salted_join(spark, monkeypatch):
    """Beyond the broadcast limit each answer meets its question once, a question with most answers too."""
    stem = "A teacher has fever and a rash on the arm for two weeks. What is it?"
    a = spark.createDataFrame([(i, "hot" if i % 3 else "cold", stem if i % 5 == 0 else "Gout explains the fever of the teacher. [1]") for i in range(300)] + [(900, None, "")], "id long, q string, text string")
    q = spark.createDataFrame([("hot", stem, {"A": "Gout"}), ("cold", stem, None)], "qid string, stem string, options map<string,string>")
    run = lambda: {tuple(map(str, r)) for r in quality.defective_pairs(a, "id", "text", "q", q, "qid", "stem", "options").collect()}
    small = run()
    monkeypatch.setattr(quality, "MOST_STEM_BYTES", 0)
    assert run() == small and len(small) == 61


def test_percentiles(spark):
    random.seed(9)
    rows = [(random.choice("ab"), i % 3, random.gauss(0, 1), i, "m") for i in range(6000)] + [("a", 0, None, None, "m"), ("a", 1, float("nan"), 5, "m"), (None, 0, 1.0, 1, "m"), ("void", 0, None, None, "m")]
    df = spark.createDataFrame(rows, "g string, day int, x double, n long, metric string").repartition(5)
    daily = quantiles.summaries(df, ["g", "day"], ["x", "n"], 64)
    whole = quantiles.quantiles(quantiles.merge_summaries(daily, ["g", "metric"]), [0.1, 0.5, 0.9]).collect()
    for g in ("a", "b", None):
        for metric, at in (("x", 2), ("n", 3)):
            v = sorted(float(r[at]) for r in rows if r[0] == g and r[at] is not None and r[at] == r[at])
            for r in whole:
                if r["g"] == g and r["metric"] == metric:
                    t = quantiles.target_rank(r["q"], len(v))
                    assert r["n"] == len(v)
                    assert sum(x < r["value"] for x in v) + 1 - r["rank_error"] <= t <= sum(x <= r["value"] for x in v) + r["rank_error"]
    void = [r for r in whole if r["g"] == "void"]
    assert len(void) == 6 and all(r["n"] == 0 and r["value"] is None for r in void)
    assert quantiles.quantiles(quantiles.summaries(df.limit(0), ["g"], ["x"]), [0.5]).count() == 0


def test_percentiles_over_a_deep_tree(spark, monkeypatch):
    """Many leaves of one group, merged at several levels, keep n and the bound."""
    monkeypatch.setattr(quantiles, "FAN_IN", 4)
    rows = spark.range(40000, numPartitions=40).selectExpr("'hot' as g", "cast((id * 7919) % 40000 as double) as x").unionByName(spark.createDataFrame([("cold", 1.0)], "g string, x double"))
    leaves = quantiles.part_summaries(rows, ["g"], ["x"], 64)
    assert leaves.where("g = 'hot'").count() == 40
    got = quantiles.quantiles(quantiles.merge_summaries(leaves, ["g", "metric"]), [0.01, 0.5, 0.99]).where("g = 'hot'").collect()
    assert len(got) == 3
    for r in got:
        assert r["n"] == 40000 and 0 < r["rank_error"] <= 40000 * 10 / 128
        assert abs(r["value"] + 1 - quantiles.target_rank(r["q"], 40000)) <= r["rank_error"]


def test_ranks(spark):
    df = spark.createDataFrame([("hot" if i % 3 else "cold", i, i % 7) for i in range(2000)] + [(None, 1, 1), (None, 2, 2)], "g string, i int, other int")
    got = ranked(df, ["g"], ["i"], "t").collect()
    by = {}
    for r in got:
        by.setdefault(r["g"], []).append((r["i"], r["rank_"]))
    assert all([rank for _, rank in sorted(v)] == list(range(len(v))) for v in by.values()) and len(got) == 2002


def test_pack_and_mix(spark):
    random.seed(10)
    docs = [(i, random.choice(["s1", "s2", "s3", None]), " ".join(["word"] * random.randint(0, 60)) + f" {i}") for i in range(400)] + [(900, "s1", ""), (901, "s1", None), (902, "s2", "word " * 700), (903, "s1", "same text"), (904, "s2", "same text")]
    df = spark.createDataFrame(docs, "id long, source string, text string").withColumn("fingerprint", F.md5("text"))
    sized = tokens.token_sizes(df, "text", ["id", "source", "fingerprint"])
    n = {r["id"]: r["tokens"] for r in sized.collect()}
    assert n[901] is None and n[900] == 0 and n[902] >= 700
    kinds = spark.createDataFrame([("small", 64), ("large", 500), ("none", 0), (None, 5)], "container_kind string, capacity_tokens int")
    got = packing.pack(sized, "id", kinds)
    rows = got.collect()
    for kind, cap in (("small", 64), ("large", 500)):
        mine = [r for r in rows if r["container_kind"] == kind]
        assert {r["id"] for r in mine} == set(n)
        load, whole, pieces = Counter(), Counter(), Counter()
        for r in mine:
            if r["container_no"] is not None:
                load[r["container_no"]] += r["tokens"]
            whole[r["id"]] += r["tokens"]
            pieces[r["id"]] += 1
        assert max(load.values()) <= cap and all(whole[i] == (t or 0) for i, t in n.items())
        assert all(pieces[i] == max(1, -(-(t or 0) // cap)) for i, t in n.items())
        assert len(load) <= 1.1 * sum(load.values()) / cap + 1
    assert {r["container_kind"] for r in packing.container_use(got, kinds).collect()} == {"small", "large"}
    targets = spark.createDataFrame([("s1", 0.5, 2), ("s2", 0.3, 1), ("gone", 0.2, 4)], "source string, target_share double, max_repeats int")
    m, report = mixing.mix(sized, "id", targets)
    m, report = m.collect(), {r["source"]: r for r in report.collect()}
    assert len({r["id"] for r in m}) == len(m) and not ({903, 904} <= {r["id"] for r in m})
    for s, share, cap in (("s1", 0.5, 2), ("s2", 0.3, 1)):
        mine = [r for r in m if r["source"] == s]
        assert sum(r["tokens"] * r["uses"] for r in mine) == report[s]["actual_tokens"] and max(r["uses"] for r in mine) <= cap
        assert abs(report[s]["actual_share"] - share / 0.8) < 0.01
    assert report["gone"]["actual_tokens"] == 0
    m, report = mixing.mix(sized, "id", targets, total=10**7)
    assert {r["source"]: r["most_uses"] for r in report.collect()} == {"s1": 2, "s2": 1, "gone": 0}
    m, report = mixing.mix(sized.limit(0), "id", targets)
    assert m.count() == 0 and report.count() == 3
    assert packing.pack(sized.limit(0), "id", kinds).count() == 0


def test_look_alike_classes(spark):
    rows = [(1, "fine"), (2, "ﬁne"), (3, "fine"), (4, "Fine"), (5, None), (6, ""), (7, "​"), (None, "ﬁne"), (2, "ﬁne"), (8, "Fіne"), (9, "alone")]
    df = spark.createDataFrame([(k, t, "x", 1, "y") for k, t in rows], "id long, text string, form string, raw int, class string")
    got = {tuple(r) for r in canonical.look_alikes(df, "id", "text").collect()}
    assert got == {(1, 1, 3, 2), (2, 1, 3, 2), (3, 1, 3, 2), (4, 4, 2, 2), (8, 4, 2, 2)}
    assert canonical.look_alikes(df.limit(0), "id", "text").count() == 0


def test_empty_tables_and_clashing_names(spark):
    """Columns of the operators' own names change nothing; empty tables give empty results."""
    names = "doc, seq, key, text_, a, b, w, h, n, query, block, salt, data, summary, value, metric_, rank_, size, m, k, s, bucket".split(", ")
    rows = [("x", " ".join(f"w{i}" for i in range(40))), ("y", " ".join(f"w{i}" for i in range(38))), ("z", None), (None, "w"), ("v", ""), ("x", " ".join(f"w{i}" for i in range(40)))]
    df = spark.createDataFrame([(k, t) for k, t in rows], "id string, text string")
    for i, n in enumerate(names):
        df = df.withColumn(n, F.lit(i))
    assert [tuple(r) for r in nearpairs.similar_pairs(df, "id", "text", 3, 0.6).collect()] == [("x", "y")]
    pairs, members = nearpairs.similar_texts(df, "id", "text", 3, 0.6)
    assert pairs.count() == 1 and {r["key"] for r in members.collect()} == {"x", "y"}
    hits = splits.split_overlaps(df, "id", "text", df, "id", "text", 3, 0.6).collect()
    assert {(r["query_key"], r["corpus_key"]) for r in hits} == {(a, b) for a in "xy" for b in "xy"}
    assert {(r["query_key"], r["corpus_key"]) for r in leakage.leaked_passages(df, "id", "text", df, "id", "text").collect()} == {(a, b) for a in "xy" for b in "xy"}
    assert nearpairs.regions_per_text(df, "id", "text", 3, [0.6], [4]).first()["n_texts"] == 3
    none = df.limit(0)
    assert nearpairs.similar_texts(none, "id", "text")[1].count() == 0 and nearpairs.regions_per_text(none, "id", "text", 3, [0.6], [4]).count() == 0
    assert leakage.leaked_passages(none, "id", "text", none, "id", "text").count() == 0
    long = quantiles.summaries(df, ["id"], ["size", "rank_"])
    assert {r["id"] for r in long.collect()} == {"x", "y", "z", "v", None}
