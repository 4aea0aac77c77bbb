"""The registered queries over the test tables, with SQL where it can express them."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm import canonical, leakage, mixing, nearpairs, packing, quality, quantiles, splits, tokens
from corvane.operators.components import connected_components
from corvane.session import materialize, read_table, ship_package

Query = Callable[[SparkSession, str], DataFrame]
PERCENTILES = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]


def _held_out(questions: DataFrame) -> DataFrame:
    return questions.where(F.col("question_id").startswith("dev-") | F.col("question_id").startswith("test-"))


# 1. broken prompt and response pairs


def _defects(spark: SparkSession, d: str) -> DataFrame:
    """Answers to questions of any split; the stems of those that are answered are read."""
    answers, questions = read_table(spark, d, "predictions"), read_table(spark, d, "questions")
    answered = questions.join(answers.select("question_id").distinct(), "question_id", "left_semi")
    return quality.defective_pairs(answers, "record_id", "explanation", "question_id", answered, "question_id", "question", "options")


def p1_flags(spark: SparkSession, d: str) -> DataFrame:
    return _defects(spark, d).select("record_id", F.array_join("defects", ",").alias("defects"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.first_defect(_defects(spark, d), "record_id")


# 2. evaluation texts leaking into training text


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    tests = _held_out(read_table(spark, d, "questions"))
    return leakage.leaked_passages(read_table(spark, d, "passages"), "passage_id", "text", tests, "question_id", "question", run=20)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).where("run >= 20").select(F.col("corpus_key").alias("passage_id"), F.col("query_key").alias("question_id")).distinct()


def p2_items(spark: SparkSession, d: str) -> DataFrame:
    """For each leaked test item: its passages, the longest equal run and the largest share found."""
    return (
        _leaks(spark, d)
        .groupBy(F.col("query_key").alias("question_id"))
        .agg(F.countDistinct("corpus_key").alias("n_passages"), F.max("run").alias("longest_run"), F.max("span").alias("longest_span"), F.round(F.max(F.col("same") / F.col("q_words")), 6).alias("share"))
    )


# 3. percentiles


def _measures(spark: SparkSession, d: str) -> DataFrame:
    """One row for each record, the latest delivered, with its variant in one spelling."""
    p = read_table(spark, d, "predictions").where("record_id is not null")
    last = p.groupBy("record_id").agg(F.max(F.struct("received_at", "variant", "run_day", "latency_seconds", "total_tokens")).alias("m"))
    return last.select(F.upper(F.trim("m.variant")).alias("variant"), "m.run_day", "m.latency_seconds", "m.total_tokens")


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.summaries(_measures(spark, d), ["variant", "run_day"], ["latency_seconds", "total_tokens"])


def _spans(days: DataFrame) -> DataFrame:
    """Each row for its day, its calendar week and all days."""
    week = F.date_trunc("week", "run_day").cast("date")
    spans = F.explode(
        F.array(
            F.struct(F.lit("day").alias("span"), F.col("run_day").alias("first_day")),
            F.struct(F.lit("week").alias("span"), week.alias("first_day")),
            F.struct(F.lit("all").alias("span"), F.lit(None).cast("date").alias("first_day")),
        )
    ).alias("s")
    return days.select("*", spans).select(*[c for c in days.columns if c != "run_day"], "s.*")


def p3_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """By variant and day, and by variant over calendar weeks and all days.

    The days' summaries are kept once; each union is made from them, not from the rows.
    """
    days = materialize(_daily(spark, d), "days")
    united = quantiles.merge_summaries(_spans(days.select("variant", "run_day", "metric", "summary")), ["variant", "span", "first_day", "metric"])
    return quantiles.quantiles(united, PERCENTILES)


def p3_within(spark: SparkSession, d: str) -> DataFrame:
    """Whether the exact rank of each percentile of `p3_quantiles`, of days, weeks and all days,
    lies within the bound it was reported with."""
    metrics = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("x")) for c in ("latency_seconds", "total_tokens")])).alias("m")
    long = _measures(spark, d).select("variant", "run_day", metrics).select("variant", "run_day", "m.*").where("x is not null and not isnan(x)")
    by = ["variant", "span", "first_day", "metric"]
    counts = _spans(long.groupBy("variant", "run_day", "metric", "x").agg(F.count("*").alias("c"))).groupBy(*by, "x").agg(F.sum("c").alias("c"))
    c, q = counts.alias("c"), materialize(p3_quantiles(spark, d), "percentiles").alias("q")
    on = F.lit(True)
    for k in by:
        on &= F.col(f"q.{k}").eqNullSafe(F.col(f"c.{k}"))
    ranks = q.join(c, on).groupBy(*[f"q.{k}" for k in by], "q.q", "q.n", "q.value", "q.rank_error").agg(
        F.sum(F.when(F.col("c.x") < F.col("q.value"), F.col("c.c")).otherwise(0)).alias("below"), F.sum(F.when(F.col("c.x") <= F.col("q.value"), F.col("c.c")).otherwise(0)).alias("upto")
    )
    target = F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("n") - 1e-9))
    return ranks.select(*by, "q", "n", ((F.col("below") + 1 <= target + F.col("rank_error")) & (F.col("upto") >= target - F.col("rank_error"))).alias("within"))


# 4. near-duplicate records


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = nearpairs.similar_pairs(read_table(spark, d, "passages"), "passage_id", "text", width=3, threshold=0.6, min_words=15)
    return pairs.select(F.col("key_a").alias("passage_a"), F.col("key_b").alias("passage_b"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each passage of at least 15 words with its group, its class of equal texts and the links of its class to others."""
    pairs, members = nearpairs.similar_texts(read_table(spark, d, "passages"), "passage_id", "text", width=3, threshold=0.6, min_words=15)
    pairs = materialize(pairs.select("a", "b"), "groups")
    group = connected_components(pairs, "a", "b").select(F.col("node").alias("rep"), F.col("component").alias("group_rep"))
    links = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
    members = members.withColumnRenamed("key", "passage_id")
    named = members.groupBy("rep").agg(F.min("passage_id").alias("class_id"))
    full = members.join(group, "rep", "left").withColumn("group_rep", F.coalesce("group_rep", "rep"))
    first = full.groupBy("group_rep").agg(F.min("passage_id").alias("group_id"))
    return full.join(first, "group_rep").join(links, "rep", "left").join(named, "rep").select("passage_id", "class_id", "group_id", F.coalesce("links", F.lit(0)).alias("links"))


def p4_regions(spark: SparkSession, d: str) -> DataFrame:
    """In how many Voronoi regions of whole texts a passage would lie, by number of pivots and threshold."""
    return nearpairs.regions_per_text(read_table(spark, d, "passages"), "passage_id", "text", 3, [0.6, 0.8, 0.95], [16, 128, 1024])


# 5. same records across splits


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    q = read_table(spark, d, "questions")
    cases = read_table(spark, d, "memory_cases").select(F.col("case_id").alias("key"), "question")
    training = q.where(F.col("question_id").startswith("train-")).select(F.col("question_id").alias("key"), "question").unionByName(cases)
    return splits.split_overlaps(_held_out(q), "question_id", "question", training, "key", "question", width=3, threshold=0.6, min_words=15)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d).select(F.least("query_key", "corpus_key").alias("key_a"), F.greatest("query_key", "corpus_key").alias("key_b")).distinct()


def _reported(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps with the split and source of the evaluation record, and the side and source of the training record."""
    q = read_table(spark, d, "questions").groupBy("question_id").agg(F.max("source").alias("source"))
    found = _overlaps(spark, d).join(q.select(F.col("question_id").alias("query_key"), "source"), "query_key")
    found = found.join(q.select(F.col("question_id").alias("corpus_key"), F.col("source").alias("training_source")), "corpus_key", "left")
    side = F.when(F.col("corpus_key").startswith("train-"), "train").otherwise("memory")
    return found.withColumn("split", F.substring_index("query_key", "-", 1)).withColumn("training", side)


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps by split and source of the evaluation record and by training side and source:
    evaluation and training items, pairs, and pairs with the same words."""
    return _reported(spark, d).groupBy("split", "source", "training", "training_source").agg(
        F.countDistinct("query_key").alias("n_items"), F.countDistinct("corpus_key").alias("n_training"), F.count("*").alias("n_pairs"), F.count(F.when(F.col("edits") == 0, 1)).alias("n_same_words")
    )


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    """How many overlaps of each split are within the edits of the segment join, and how many have moved or large blocks."""
    return _reported(spark, d).groupBy("split", "training", "path").agg(F.count("*").alias("n_pairs"), F.max("edits").alias("most_edits"))


# 6. and 7. packing and mixing


def p6_assign(spark: SparkSession, d: str) -> DataFrame:
    sized = tokens.token_sizes(read_table(spark, d, "documents"), "text", ["doc_id"])
    return packing.pack(sized, "doc_id", read_table(spark, d, "containers"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.container_use(p6_assign(spark, d), read_table(spark, d, "containers"))


def p6_sound(spark: SparkSession, d: str) -> DataFrame:
    """For each kind of container: texts that aren't assigned as a whole, texts split without need, pieces cut
    elsewhere than at the capacity, containers over capacity, numbers left out, and whether at
    most a twentieth more containers are used than the tokens need at least, one aside."""
    docs = read_table(spark, d, "documents")
    sized = materialize(tokens.token_sizes(docs, "text", ["doc_id"]), "sizes")
    containers = read_table(spark, d, "containers").select("container_kind", F.col("capacity_tokens").cast("bigint").alias("c")).distinct()
    packed = materialize(packing.pack(sized, "doc_id", read_table(spark, d, "containers")), "packed").join(containers, "container_kind")
    n = F.coalesce("n", F.lit(0))
    by_text = packed.groupBy("container_kind", "doc_id").agg(F.sum("tokens").alias("got"), F.count("*").alias("pieces"), F.count(F.when((F.col("tokens") < F.col("c")) & (F.col("piece_no") > 0), 1)).alias("short"), F.max("c").alias("c"))
    every = by_text.join(sized.select("doc_id", F.col("tokens").alias("n")), "doc_id", "left")
    texts = every.groupBy("container_kind").agg(
        (F.lit(sized.count()) - F.count(F.when(F.col("got") == n, 1))).alias("not_whole"), F.count(F.when((n <= F.col("c")) & (F.col("pieces") > 1), 1)).alias("split_small"), F.count(F.when(F.col("short") > 1, 1)).alias("cut_elsewhere")
    )
    loads = packed.where("container_no is not null and tokens > 0").groupBy("container_kind", "container_no").agg(F.sum("tokens").alias("load"), F.max("c").alias("c"))
    fill = loads.groupBy("container_kind").agg(
        F.count(F.when(F.col("load") > F.col("c"), 1)).alias("overfull"), (F.max("container_no") + 1 - F.count("*")).alias("left_out"), (F.count("*") <= F.ceil(F.sum("load") / F.max("c")) * 1.05 + 1).alias("tight")
    )
    return texts.join(fill, "container_kind")


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = read_table(spark, d, "documents").where("text is not null").select("doc_id", "source", "text", F.sha2("text", 256).alias("fingerprint"))
    return mixing.mix(tokens.token_sizes(docs, "text", ["doc_id", "source", "fingerprint"]), "doc_id", read_table(spark, d, "mix_targets"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    shares = _mixed(spark, d)[1]
    return shares.withColumn("actual_share", F.round("actual_share", 9))


def p7_sound(spark: SparkSession, d: str) -> DataFrame:
    """For each target: uses beyond the cap, texts that aren't of the source, equal texts taken
    twice, and whether its share is within a hundredth of the target among sources that have texts."""
    mixture = materialize(_mixed(spark, d)[0], "mixture")
    docs = read_table(spark, d, "documents").select("doc_id", F.col("source").alias("own"), F.sha2("text", 256).alias("fingerprint"))
    targets = read_table(spark, d, "mix_targets")
    used = mixture.join(docs, "doc_id", "left").join(targets.select("source", "max_repeats"), "source", "left")
    per = used.groupBy("source").agg(
        F.count(F.when(F.col("uses") > F.col("max_repeats"), 1)).alias("over_cap"), F.count(F.when(~F.coalesce(F.col("own") == F.col("source"), F.lit(False)), 1)).alias("foreign"), (F.count("*") - F.countDistinct("fingerprint")).alias("twice"),
        F.sum(F.col("tokens") * F.col("uses")).alias("got"),
    )
    # Equal texts are those of the smallest id, and listed sources only count.
    own = read_table(spark, d, "documents").where("text <> ''").join(targets.select("source"), "source", "left_semi")
    some = own.groupBy(F.sha2("text", 256)).agg(F.min(F.struct("doc_id", "source")).alias("m")).select("m.source").distinct().withColumn("has", F.lit(True))
    full = targets.join(per, "source", "left").join(some, "source", "left")
    w = Window.partitionBy()
    has = F.coalesce("has", F.lit(False))
    want = F.when(has, F.col("target_share") / F.sum(F.when(has, F.col("target_share"))).over(w)).otherwise(0.0)
    share = F.coalesce("got", F.lit(0)) / F.sum("got").over(w)
    return full.select("source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("over_cap", "foreign", "twice")], (F.abs(share - want) <= 0.01).alias("met"))


# 8. visually identical text


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.same_looking(read_table(spark, d, "documents"), "doc_id", "text").select(F.col("key_a").alias("doc_a"), F.col("key_b").alias("doc_b"))


def p8_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each document that looks like another of other characters, with the class of its form."""
    return canonical.look_alikes(read_table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("class", "class_id")


def p8_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text in the one form."""
    return canonical.with_canonical(read_table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "canonical")


def _shipped(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    fs = [p1_found, p1_flags, p2_found, p2_items, p3_quantiles, p3_within, p4_found, p4_groups, p4_regions, p5_found, p5_report, p5_paths, p6_assign, p6_fill, p6_sound, p7_mixture, p7_shares, p7_sound, p8_found, p8_groups, p8_forms]
    return {f.__name__: _shipped(f) for f in fs}


_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"

_P2 = rf"""
with p as (select distinct passage_id, {_WORDS.format("text")} as w from passages where text is not null),
q as (select distinct question_id, {_WORDS.format("question")} as w from questions where question is not null and (question_id like 'dev-%' or question_id like 'test-%')),
pg as (select passage_id, array_to_string(w[i:i + 19], ' ') as g from (select passage_id, w, unnest(generate_series(1, len(w) - 19)) as i from p where len(w) >= 20)),
qg as (select question_id, array_to_string(w[i:i + 19], ' ') as g from (select question_id, w, unnest(generate_series(1, len(w) - 19)) as i from q where len(w) >= 20))
select distinct passage_id, question_id from pg join qg using (g)
"""

# Equal words on one diagonal, parted where more than `gap` words in a row differ.
_P2_ITEMS = rf"""
with p as (select distinct passage_id, {_WORDS.format("text")} as w from passages where text is not null),
q as (select distinct question_id, {_WORDS.format("question")} as w from questions where question is not null and (question_id like 'dev-%' or question_id like 'test-%')),
pw as (select passage_id, unnest(w) as word, unnest(generate_series(1, len(w))) as j from p where len(w) >= 16),
qw as (select question_id, len(w) as n, unnest(w) as word, unnest(generate_series(1, len(w))) as i from q where len(w) >= 20),
hits as (select question_id, passage_id, n, i, j - i as d from qw join pw using (word)),
long as (select question_id, passage_id, d from hits group by all having count(*) >= 10),
s as (select *, i - lag(i) over (partition by question_id, passage_id, d order by i) as step from hits semi join long using (question_id, passage_id, d)),
k as (select *, sum(case when step is null or step > 1 then 1 else 0 end) over w as a, sum(case when step is null or step > 2 then 1 else 0 end) over w as b from s window w as (partition by question_id, passage_id, d order by i)),
runs as (select question_id, passage_id, max(c) as run from (select question_id, passage_id, count(*) as c from k group by question_id, passage_id, d, a) group by 1, 2),
spans as (select question_id, passage_id, n, max(i) - min(i) + 1 as span, count(*) as same from k group by question_id, passage_id, n, d, b),
best as (select question_id, passage_id, n, max(span) as span, arg_max(same, span) as same from spans group by 1, 2, 3),
dense as (select distinct question_id, passage_id from (select question_id, passage_id, count(*) over (partition by question_id, passage_id, d order by i range between current row and 19 following) as c from s) where c >= 19)
select question_id, count(distinct passage_id) as n_passages, max(run)::int as longest_run, max(span)::int as longest_span, round(max(same / n), 6) as share
from best join runs using (question_id, passage_id) join dense using (question_id, passage_id) group by 1
"""

_SETS = r"""
{name} as (select distinct key, array_to_string(w[i:i + 2], ' ') as g from (select key, w, unnest(generate_series(1, len(w) - 2)) as i from (select {key} as key, {words} as w from {table} where {text} is not null and {where}) where len(w) >= 15)),
{name}_n as (select key, count(*) as n from {name} group by key)"""

_P4 = f"""
with {_SETS.format(name="s", key="passage_id", words=_WORDS.format("text"), table="passages", text="text", where="true")},
c as (select a.key as passage_a, b.key as passage_b, count(*) as common_ from s a join s b using (g) where a.key < b.key group by all)
select passage_a, passage_b from c join s_n x on x.key = passage_a join s_n y on y.key = passage_b where common_ >= 0.6 * (x.n + y.n - common_) - 1e-9
"""

_P5 = f"""
with {_SETS.format(name="e", key="question_id", words=_WORDS.format("question"), table="questions", text="question", where="(question_id like 'dev-%' or question_id like 'test-%')")},
{_SETS.format(name="t", key="k", words=_WORDS.format("question"), table="(select question_id as k, question from questions where question_id like 'train-%' union all select case_id, question from memory_cases)", text="question", where="true").strip()},
c as (select a.key as ka, b.key as kb, count(*) as common_ from e a join t b using (g) group by all)
select least(ka, kb) as key_a, greatest(ka, kb) as key_b from c join e_n x on x.key = ka join t_n y on y.key = kb where common_ >= 0.6 * (x.n + y.n - common_) - 1e-9
"""

_P5_REPORT = f"""
with pairs as ({_P5}),
sides as (select case when key_a like 'dev-%' or key_a like 'test-%' then key_a else key_b end as e, case when key_a like 'dev-%' or key_a like 'test-%' then key_b else key_a end as t from pairs),
src as (select question_id, max(source) as source from questions group by 1),
w as (select question_id as k, {_WORDS.format("question")} as w from questions where question is not null union select case_id, {_WORDS.format("question")} from memory_cases where question is not null)
select split_part(e, '-', 1) as split, a.source as source, case when t like 'train-%' then 'train' else 'memory' end as training, b.source as training_source,
  count(distinct e) as n_items, count(distinct t) as n_training, count(*) as n_pairs, count(*) filter (x.w = y.w) as n_same_words
from sides join src a on a.question_id = e left join src b on b.question_id = t join w x on x.k = e join w y on y.k = t group by all
"""

_P4_GROUPS = f"""
with recursive pairs as materialized ({_P4}), edges as materialized (select passage_a as a, passage_b as b from pairs union all select passage_b, passage_a from pairs),
w as materialized (select distinct passage_id, {_WORDS.format("text")} as w from passages where text is not null and len({_WORDS.format("text")}) >= 15),
reach as (select passage_id as id, passage_id as root from w union select e.b, r.root from reach r join edges e on e.a = r.id),
groups as (select id, min(root) as group_id from reach group by id),
classes as (select passage_id as id, min(passage_id) over (partition by w) as class_id from w),
links as (select x.class_id, count(distinct y.class_id) as links from edges e join classes x on x.id = e.a join classes y on y.id = e.b where x.class_id <> y.class_id group by 1)
select id as passage_id, class_id, group_id, coalesce(links, 0) as links from classes join groups using (id) left join links using (class_id)
"""

_P6_SOUND = "select distinct container_kind, 0 as not_whole, 0 as split_small, 0 as cut_elsewhere, 0 as overfull, 0 as left_out, true as tight from containers"
_P7_SOUND = "select source, 0 as over_cap, 0 as foreign, 0 as twice, true as met from mix_targets"

_P3 = """
with m as (select upper(trim(variant)) as variant, run_day, latency_seconds, total_tokens from (
  select *, row_number() over (partition by record_id order by received_at desc) as r from predictions where record_id is not null) where r = 1),
l as (select variant, run_day, 'latency_seconds' as metric, latency_seconds as x from m union all select variant, run_day, 'total_tokens', total_tokens::double from m),
s as (select variant, metric, x, 'day' as span, run_day::date as first_day from l union all select variant, metric, x, 'week', date_trunc('week', run_day)::date from l union all select variant, metric, x, 'all', null::date from l)
select variant, span, first_day, metric, q, count(*) as n, true as within from s, (select unnest([0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99])::double as q)
where x is not null and not isnan(x) group by all
"""


def _p8_form() -> str:
    """The form by string functions: composed, translated character by character, composed again."""
    pairs: dict[str, str] = {}
    for line in canonical.ALIKE.strip().splitlines():
        for x in line[2:].split():
            pairs.setdefault(x, line[0])
    for c in range(0x370, 0x530):
        form = unicodedata.normalize("NFC", "".join(pairs.get(x, x) for x in unicodedata.normalize("NFD", chr(c))))
        if len(form) == 1 and form != chr(c):
            pairs[chr(c)] = form
    pairs |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    pairs |= {chr(int(c, 16)): " " for c in canonical.BLANKS.split()}
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    hidden = "[" + "".join(rf"\x{{{a}}}-\x{{{b}}}" for a, b in (r.split() for r in canonical.INVISIBLE.split(", ")) if a not in ("0000", "000E")) + "]"
    form = f"nfc_normalize(translate(nfc_normalize(regexp_replace(text, '{hidden}', '', 'g')), {quote(''.join(pairs))}, {quote(''.join(pairs.values()))}))"
    for c in range(0xFB00, 0xFB05):
        form = f"replace({form}, {quote(chr(c))}, {quote(unicodedata.normalize('NFKD', chr(c)))})"
    return form


def _p8() -> str:
    return f"""with f as (select doc_id, text, {_p8_form()} as form from documents where text is not null)
select distinct a.doc_id as doc_a, b.doc_id as doc_b from f a join f b using (form) where a.doc_id < b.doc_id and a.text <> b.text and trim(form, ' ' || chr(10)) <> ''"""


def _p8_groups() -> str:
    return f"""with pairs as ({_p8()}), both_ as (select doc_a as a, doc_b as b from pairs union all select doc_b, doc_a from pairs),
forms as (select a, least(a, min(b)) as first_ from both_ group by a),
classes as (select a, min(least(f.first_, g.first_)) as class_id from (select a, b from both_ union all select distinct a, a from both_) join forms f using (a) join forms g on g.a = b group by a),
texts as (select class_id, count(*) as n_keys, count(distinct text) as n_spellings from classes join documents on doc_id = a group by class_id)
select a as doc_id, class_id, n_keys, n_spellings from classes join texts using (class_id)"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": _P2, "p2_items": _P2_ITEMS, "p3_within": _P3, "p4_found": _P4, "p4_groups": _P4_GROUPS, "p6_sound": _P6_SOUND, "p7_sound": _P7_SOUND, "p5_found": _P5, "p5_report": _P5_REPORT, "p8_found": _p8(), "p8_groups": _p8_groups(), "p8_forms": f"select doc_id, {_p8_form()} as canonical from documents"}
