"""The core queries again, as SQL for an independent engine (DuckDB's dialect).

Built from the same parameters and fixed values, but not from the same plans.
"""

from __future__ import annotations

from corvane.functions import text as T
from corvane.functions import tools

_B = T.BLANK
_W = T.WORD


def lst(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_B}+|{_B}+$', '', 'g')"


def w1(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{_B}+'), lambda z1: z1 <> '')"


def w2(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{_W}')"


def wset(x: str) -> str:
    return f"list_sort(list_distinct({w2(x)}))"


def kw(x: str) -> str:
    plain = f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}]', ' ', 'g')"
    return f"list_sort(list_distinct(list_filter({w1(plain)}, lambda z2: length(z2) > 3)))"


def sents(x: str) -> str:
    return f"string_split(regexp_replace({x}, '([.!?]) +', '\\1' || chr(1), 'g'), chr(1))"


def join(x: str, sep: str = "' '") -> str:
    return f"coalesce(array_to_string({x}, {sep}), '')"


def jac(a: str, b: str) -> str:
    """Of two lists of distinct words."""
    both = f"len(list_intersect({a}, {b}))"
    return f"case when len({a}) > 0 and len({b}) > 0 then {both}::double / (len({a}) + len({b}) - {both}) else 0.0 end"


def ents(x: str, terms) -> str:
    ending = "(" + "|".join(T.ENTITY_SUFFIXES) + ")$"
    acronyms = f"list_filter(regexp_extract_all({x}, '{_W}'), lambda z3: regexp_full_match(z3, '[A-Z]{{2,}}'))"
    known = f"list_filter({w2(x)}, lambda z4: length(z4) >= 4 and (regexp_matches(z4, '{ending}') or list_contains({lst(terms)}, z4)))"
    return f"list_sort(list_distinct(list_concat({acronyms}, {known})))"


def minus(a: str, stop) -> str:
    return f"list_filter({a}, lambda z5: not list_contains({lst(stop)}, z5))"


def asks(x: str) -> str:
    return "(" + " or ".join(f"contains(lower({x}), '{p}')" for p in T.QUESTION_PHRASES) + ")"


def cut(x: str, n: str, mark: str) -> str:
    return f"case when len({w1(x)}) > {n} then array_to_string(list_slice({w1(x)}, 1, {n}), ' ') || '{mark}' else {x} end"


def key(**fields: str) -> str:
    parts = [f"'{n}=' || coalesce({fields[n]}, chr(0) || 'none')" for n in sorted(fields)]
    return "sha256(" + " || chr(10) || ".join(f"length({p})::varchar || ':' || {p}" for p in parts) + ")"


def prune(x: str, need: bool) -> str:
    keep = f"not {asks('z6')}" + (f" and len({ents('z6', T.ENTITY_TERMS_A)}) > 0" if need else "")
    left = f"list_filter({sents(strip(x))}, lambda z6: {keep})"
    return f"case when len({left}) > 0 then array_to_string({left}, ' ') else {x} end"


def expand(x: str) -> str:
    table = "[" + ", ".join(f"{{'k': '{k}', 'v': {lst(v)}}}" for k, v in T.SYNONYMS) + "]"
    added = f"list_filter(flatten(list_transform(list_filter({table}, lambda e1: contains(lower({x}), e1.k)), lambda e2: e2.v)), lambda e3: not contains(lower({x}), e3))"
    return f"case when len({added}) > 0 then {x} || ' ' || array_to_string({added}, ' ') else {x} end"


def compress(x: str, words: str) -> str:
    s = sents(strip(x))
    hit = f"list_filter({s}, lambda z7: len(list_intersect({w2('z7')}, {words})) > 0)"
    return f"case when len({words}) = 0 then {x} when len({hit}) > 0 then array_to_string({hit}, ' ') else array_to_string(list_slice({s}, 1, 2), ' ') end"


Q = """q as (select question_id, coalesce(max(question), '') as question, max(answer) as answer, any_value(options) as options from questions where question_id is not null group by 1)"""
HELD = "(question_id like 'dev-%' or question_id like 'test-%')"
S = f"sq as (select * from q where {HELD} and cast(split_part(question_id, '-', 2) as bigint) % 50 = 0)"
P = "p as (select passage_id, any_value(source) as source, any_value(text) as text, any_value(parent_id) as parent_id from passages where passage_id is not null group by 1)"
PS = "ps as (select * from p where text is not null and not contains(passage_id, '::parent-'))"
R = "r as (select * exclude (rn) replace (upper(trim(variant)) as variant) from (select *, row_number() over (partition by record_id order by received_at desc) as rn from predictions where record_id is not null) where rn = 1)"
D = "d as (select doc_id, text, lang from documents where text is not null)"
BM = f"""tok as (select passage_id as doc_id, {w2("text")} as w from ps),
len_ as (select doc_id, len(w) as len from tok),
post as (select term, doc_id, count(*) as tf from (select doc_id, unnest(w) as term from tok) group by all),
tdf as (select term, count(*) as df from post group by 1),
tot as (select count(*) as n, avg(len) as avgdl from len_)"""


def bm_scores(name: str, queries: str, qkey: str, text: str) -> str:
    return f"""{name}_t as (select {qkey} as qk, unnest({wset(text)}) as term from {queries}),
{name} as (select qk, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))) as score
  from {name}_t join post using (term) join tdf using (term) join len_ using (doc_id) cross join tot group by all),
{name}_r as (select *, row_number() over (partition by qk order by round(score, 9) desc, doc_id) as rank from {name})"""


def hv(name: str, table: str, id_: str, text: str) -> str:
    """Vectors as rows (id, dim, x), of unit length."""
    return f"""{name}_c as (select {id_} as id, h, count(*)::double as c from (select {id_}, unnest(list_transform({w2(text)}, lambda z8: substr(md5(z8), 1, 1))) as h from {table}) group by all),
{name} as (select id, h, c / sqrt(sum(c * c) over (partition by id)) as x from {name}_c)"""


def lists(n: int, text: str = "question") -> str:
    """sparse(qk, doc_id, rank) and dense(qk, doc_id, rank) of the search questions."""
    return f"""{BM}, {bm_scores("bs", "sq", "question_id", text)}, sparse as (select qk, doc_id, rank from bs_r where rank <= {n}),
{hv("qv", "sq", "question_id", text)}, {hv("pv", "ps", "passage_id", "text")},
ds as (select a.id as qk, b.id as doc_id, sum(a.x * b.x) as score from qv a join pv b using (h) group by all),
pairs_ as (select question_id as qk, passage_id as doc_id, coalesce(score, 0.0) as score from sq cross join ps left join ds on ds.qk = question_id and ds.doc_id = passage_id),
dense as (select qk, doc_id, rank from (select *, row_number() over (partition by qk order by round(score, 9) desc, doc_id) as rank from pairs_) where rank <= {n})"""


def fused(base: int) -> str:
    return f"""f0 as (select qk, doc_id, sum(1.0 / (60 + rank - 1 + {base})) as score from (select * from dense union all select * from sparse) group by all),
f as (select *, row_number() over (partition by qk order by round(score, 9) desc, doc_id) as rank from f0)"""


CTX = """c as (select f.qk, f.doc_id, f.score, f.rank, x.source, x.text, x.parent_id, y.source as parent_source, y.text as parent_text, sq.question as q_text, sq.options as q_options
  from f join p x on x.passage_id = f.doc_id left join p y on y.passage_id = x.parent_id join sq on sq.question_id = f.qk)"""
FULLTEXT = "coalesce(text, '') || case when parent_text is null then '' else ' ' || parent_text end"
OPTW = f"coalesce(list_distinct(flatten(list_transform(map_values(q_options), lambda o1: {kw('o1')}))), [])"
BASE = f"with {Q}, {S}, {P}, {PS}, {lists(10)}"
SHOW = "select qk as question_id, doc_id as passage_id, round(score, 6) as score, row_number() over (partition by qk order by round(score, 9) desc, doc_id) as rank"

SQL: dict[str, str] = {}
SQL["tok_words"] = f"with {D} select doc_id, len({w2('text')}) as n, md5({join(w2('text'), chr(39) + '|' + chr(39))}) as words from d"
SQL["tok_keywords"] = f"with {D} select doc_id, len({kw('text')}) as n, md5({join(kw('text'), chr(39) + '|' + chr(39))}) as words from d"
SQL["tok_sentences"] = f"with {D} select doc_id, len({sents(strip('text'))}) as n, md5({join(sents(strip('text')), chr(39) + '|' + chr(39))}) as parts from d"
SQL["token_count"] = f"with {D} select doc_id, len({w1('text')}) as n, floor(len({w1('text')}) * 4 / 3)::bigint as estimate from d"
FAMILY = f"with {P}, fam as (select c.passage_id, coalesce(c.text, '') as text, coalesce(x.text, '') as parent_text from p c join p x on x.passage_id = c.parent_id)"
SQL["jaccard_pairs"] = f"{FAMILY}, s as (select passage_id, {wset('text')} as a, {wset('parent_text')} as b from fam) select passage_id, round({jac('a', 'b')}, 6) as jaccard from s"
SQL["overlap_weight"] = f"""{FAMILY}, s as (select passage_id, {w1("lower(text)")} as a, {w1("lower(parent_text)")} as b from fam)
select passage_id, round(case when len(b) > 0 then len(list_filter(b, lambda z9: list_contains(a, z9)))::double / len(b) * (1 + ln(1 + len(list_intersect(list_distinct(a), list_distinct(b))))) else 0.0 end, 6) as weight from s"""
SQL["truncate_words"] = f"with {P} select passage_id, md5({cut('text', '20', ' [Truncated]')}) as cut, md5({cut('text', '15', '...')}) as short from p where text is not null"
SQL["cache_key"] = f"""with {D} select doc_id, {key(role="'reasoner'", prompt="text", model="'model-a'", temperature="'0.0'", context="lang")} as request, {key(kind="'passage'", text="text", model="'model-e'")} as embedding from d"""
OPTLIST = "array_to_string(list_transform(list_sort(map_entries(options)), lambda o2: o2.key || ') ' || o2.value), chr(10))"
SQL["retrieval_key"] = f"""with {Q} select question_id, {key(query="question", options=f"case when options is null then null else {OPTLIST} end", top_k="'5'", index="'index-a'", settings="'hybrid'")} as key from q"""
SQL["context_id"] = f"with {R} select record_id, sha256(array_to_string(trace.retrieved_passages, ',')) as context from r where trace.retrieved_passages is not null"

SQL["chunk_flat"] = f"""with {D}, w as (select doc_id, {w1("text")} as w from d), e as (select doc_id, w, unnest(range(0, cast(ceil(len(w) / 128.0) as bigint))) as i from w)
select doc_id, doc_id || '::chunk-' || i as chunk_id, md5(array_to_string(list_slice(w, i * 128 + 1, i * 128 + 128), ' ')) as text from e"""
_PAR = f"""with {D}, w as (select doc_id, {w1("text")} as w from d), e as (select doc_id, w, unnest(range(0, cast(ceil(len(w) / 512.0) as bigint))) as i from w),
pp as (select doc_id, i, doc_id || '::parent-' || i as parent_id, list_slice(w, i * 512 + 1, i * 512 + 512) as w from e)"""
SQL["chunk_parents"] = f"{_PAR} select doc_id, parent_id as chunk_id, md5(array_to_string(w, ' ')) as text from pp"
SQL["chunk_children"] = f"""{_PAR}, cc as (select doc_id, parent_id, i, j, list_slice(w, j * 64 + 1, j * 64 + 64) as w from (select *, unnest(range(0, cast(ceil(len(w) / 64.0) as bigint))) as j from pp))
select doc_id, doc_id || '::child-' || (row_number() over (partition by doc_id order by i, j) - 1) as chunk_id, parent_id, md5(array_to_string(w, ' ')) as text from cc"""
SQL["child_parent_join"] = f"with {P} select c.passage_id, coalesce(x.source, c.source) as source, md5(coalesce(x.text, c.text)) as text from p c left join p x on x.passage_id = c.parent_id where c.text is not null and not contains(c.passage_id, '::parent-')"
SQL["rows_joined"] = f"with {P} select parent_id, md5(string_agg(coalesce(text, ''), ' ' order by cast(regexp_extract(passage_id, '(\\d+)$', 1) as int))) as text from p where parent_id is not null group by 1"

SQL["bm25_term_df"] = f"with {P}, {PS}, {BM} select term, df from tdf"
SQL["bm25_stats"] = f"with {P}, {PS}, {BM} select n, round(avgdl, 6) as avgdl from tot"
SQL["bm25_idf"] = f"with {P}, {PS}, {BM} select term, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) as idf from tdf cross join tot"
SQL["bm25_topk"] = f"with {Q}, {S}, {P}, {PS}, {BM}, {bm_scores('bs', 'sq', 'question_id', 'question')} select qk as question_id, doc_id as passage_id, round(score, 6) as score, rank from bs_r where rank <= 5"
SQL["dense_topk"] = """with s as (select a.vec_id as query_id, b.vec_id, list_dot_product(a.embedding::double[], b.embedding::double[]) as score from embeddings a, embeddings b where a.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, vec_id) as rank from s) select query_id, vec_id, round(score, 6) as score, rank from r where rank <= 5"""
SQL["rrf_zero_based"] = f"{BASE}, {fused(0)} select qk as question_id, doc_id as passage_id, round(score, 6) as score, rank from f"
SQL["rrf_one_based"] = f"{BASE}, {fused(1)} select qk as question_id, doc_id as passage_id, round(score, 6) as score, rank from f"
SQL["option_boost"] = f"{BASE}, {fused(0)}, {CTX}, b as (select qk, doc_id, score + case when len(list_intersect({w2(FULLTEXT)}, {OPTW})) > 0 then 0.05 else 0.0 end as score from c) {SHOW} from b"
SQL["entity_rerank"] = f"{BASE}, {fused(0)}, {CTX}, b as (select qk, doc_id, score + 0.10 * len(list_intersect({ents(FULLTEXT, T.ENTITY_TERMS_A)}, {ents('q_text', T.ENTITY_TERMS_A)})) as score from c) {SHOW} from b"
_LIMIT = "case when max(score) over (partition by qk) >= 0.030 then 3 when max(score) over (partition by qk) >= 0.026 then 4 else 5 end"
SQL["dynamic_topk"] = f"{BASE}, {fused(0)}, l as (select *, {_LIMIT} as lim from f) select qk as question_id, doc_id as passage_id, round(score, 6) as score, rank from l where rank <= lim"
_DEDUP = "u as (select *, row_number() over (partition by qk, coalesce(parent_id, doc_id) order by rank) as one from {0}), v as (select * replace (case when parent_text is not null then parent_source else source end as source, coalesce(parent_text, text) as text) from u where one = 1)"
SQL["parent_dedup"] = f"{BASE}, {fused(0)}, {CTX}, {_DEDUP.format('c')} select qk as question_id, doc_id as passage_id, source, md5(text) as text, round(score, 6) as score from v"
SQL["relevance_threshold"] = f"{BASE}, {fused(0)} select qk as question_id, doc_id as passage_id, round(score, 6) as score, rank from f where score >= 0.016"
_RW, _RP = minus("qw", T.STOP_RESCORE), "pw"
SQL["token_overlap_rescore"] = f"""{BASE}, {fused(0)}, {CTX}, b0 as (select qk, doc_id, score, rank, {minus(wset("q_text"), T.STOP_RESCORE)} as qw, {wset("text")} as pw from c),
b as (select qk, doc_id, rank as old, case when len(qw) > 0 then score + 2.0 * len(list_intersect(qw, pw)) / greatest(len(qw) + len(pw) - len(list_intersect(qw, pw)), 1) + 0.1 * len(list_intersect(qw, pw)) else score end as score from b0)
select qk as question_id, doc_id as passage_id, round(score, 6) as score, row_number() over (partition by qk order by round(score, 9) desc, old) as rank from b"""
SQL["multi_query_merge"] = f"""with {Q}, {S}, {P}, {PS}, {BM},
dq as (select question_id || '#' || part as k, question_id, part, question || ' ' || e as text from sq cross join (values (0, 'symptoms diagnosis presentation'), (1, 'pathogenesis biological mechanism etiology'), (2, 'pharmacology treatment first line therapy')) t(part, e)),
{bm_scores("bs", "dq", "k", "text")}, h as (select question_id, part, doc_id, score from bs_r join dq on k = qk where rank <= 5),
o as (select *, row_number() over (partition by question_id, doc_id order by round(score, 9) desc, part) as one from h),
m as (select *, row_number() over (partition by question_id order by round(score, 9) desc, part, doc_id) as rank from o where one = 1)
select question_id, doc_id as passage_id, round(score, 6) as score, rank from m where rank <= 5"""
_OPTE = f"coalesce(list_distinct(flatten(list_transform(map_values(q_options), lambda o3: {ents('o3', T.ENTITY_TERMS_A)}))), [])"
SQL["hybrid_retrieve"] = f"""with {Q}, sq0 as (select * from q where {HELD} and cast(split_part(question_id, '-', 2) as bigint) % 50 = 0), {P}, {PS},
sq1 as (select *, {prune("question", True)} as pruned from sq0), sq as (select *, {expand("pruned")} as search_text from sq1), {lists(14, "search_text")}, {fused(0)},
c0 as (select c.*, sq.search_text from (select f.qk, f.doc_id, f.score, f.rank, x.source, x.text, x.parent_id, y.source as parent_source, y.text as parent_text, sq.question as q_text, sq.options as q_options
  from f join p x on x.passage_id = f.doc_id left join p y on y.passage_id = x.parent_id join sq on sq.question_id = f.qk) c join sq on sq.question_id = c.qk),
c1 as (select * replace (score + case when len(list_intersect({w2(FULLTEXT)}, {OPTW})) > 0 then 0.05 else 0.0 end as score) from c0),
c2 as (select * replace (score + 0.10 * len(list_intersect({ents(FULLTEXT, T.ENTITY_TERMS_A)}, list_concat({ents("search_text", T.ENTITY_TERMS_A)}, {ents("q_text", T.ENTITY_TERMS_A)}, {_OPTE}))) as score) from c1),
c3 as (select * replace (row_number() over (partition by qk order by round(score, 9) desc, doc_id) as rank), {_LIMIT} as lim from c2),
{_DEDUP.format("c3")}, w as (select *, row_number() over (partition by qk order by rank) as pos from v)
select qk as question_id, doc_id as passage_id, source, md5({compress("text", f"list_concat({kw('q_text')}, {OPTW})")}) as text, round(score, 6) as score, pos as rank from w where pos <= lim"""
_TOP5 = f"{BASE}, {fused(0)}, {CTX}, t as (select qk, doc_id, coalesce(text, '') as text, rank from c where rank <= 5)"
SQL["token_budget"] = f"""{_TOP5}, n as (select *, greatest(2, 60 // count(*) over (partition by qk)) as share from t), k as (select *, {cut("text", "share", "...")} as short from n),
m as (select *, coalesce(sum(len({w1("short")})) over (partition by qk order by rank rows between unbounded preceding and 1 preceding), 0) as used from k)
select qk as question_id, doc_id as passage_id, md5(short) as text, rank from m where used < 60"""
SQL["context_savings"] = f"""{_TOP5}, s as (select qk, sum(len({w1("text")})) as words_before, sum(len({w1(cut("text", "20", "..."))})) as words_after from t group by 1)
select qk as question_id, words_before, words_after, round((words_before - words_after) / greatest(words_before, 1) * 100, 6) as saved from s"""

SQL["query_prune"] = f"with {Q} select question_id, md5({prune('question', True)}) as pruned, md5({prune('question', False)}) as without_question from q"
_TERM = f"{lst(k for k, _ in T.SYNONYMS)}[cast(split_part(question_id, '-', 2) as int) % {len(T.SYNONYMS)} + 1]"
SQL["synonym_expand"] = f"with {Q}, t as (select question_id, question || ' ' || {_TERM} as x from q) select question_id, {expand('x')} as expanded from t"
SQL["entities_a"] = f"with {Q} select question_id, {join(ents('question', T.ENTITY_TERMS_A), chr(39) + '|' + chr(39))} as entities from q"
SQL["entities_b"] = f"with {Q} select question_id, {join(ents('question', T.ENTITY_TERMS_B), chr(39) + '|' + chr(39))} as entities from q"
SQL["compress_sentences"] = f"with {P} select passage_id, md5({compress('text', lst(['fever', 'histology', 'laboratory', 'patients']))}) as text from p where text is not null"
_ANS = f"with {Q}, {R}, a as (select record_id, explanation, question, q.options from r join q using (question_id) where explanation is not null and {HELD})"
SQL["coverage"] = f"""{_ANS}, w as (select record_id, {minus(wset("question"), T.STOP_COVERAGE)} as qw, {wset("explanation")} as pw from a),
x as (select record_id, qw, list_sort(list_filter(qw, lambda z10: not list_contains(pw, z10))) as missing from w)
select record_id, case when len(qw) > 0 then round((len(qw) - len(missing))::double / len(qw), 6) end as ratio, case when len(qw) > 0 then (len(qw) - len(missing))::double / len(qw) >= 0.20 else true end as is_sufficient, {join("list_slice(missing, 1, 3)", "'|'")} as missing from x"""
SQL["cooccurrence"] = f"""{_ANS}, e as (select record_id, {ents("question", T.ENTITY_TERMS_B)} as e, lower(explanation) as t from a)
select record_id, round(case when len(e) > 0 then len(list_filter(e, lambda z11: contains(t, lower(z11))))::double / len(e) else 0.5 end, 6) as share from e"""

_RX = r"(?i)Final\s+Answer\s*:\s*\(?\s*([A-Za-z])\s*\)?(?:[^A-Za-z0-9]|$)"
_FB = r"(?i)(?:Option|Choice|Answer|correct answer is|is)\s*:?\s*\(?\s*([A-D])\s*\)?"
_ANSL = f"{R}, a as (select record_id, list_transform(regexp_extract_all(coalesce(explanation, ''), '{_RX}', 1), lambda z12: upper(z12)) as f, upper(regexp_extract(coalesce(explanation, ''), '{_FB}', 1)) as o from r)"
SQL["parse_answer_strict"] = f"""with {_ANSL} select record_id, len(f) = 1 and f[1] in ('A', 'B', 'C', 'D', 'E') as is_valid, case when len(f) = 1 and f[1] in ('A', 'B', 'C', 'D', 'E') then f[1] end as answer,
case when len(f) = 0 then 'no answer line' when len(f) > 1 then 'ambiguous: ' || len(f) || ' answer lines' when f[1] not in ('A', 'B', 'C', 'D', 'E') then f[1] || ' is no valid option' end as reason from a"""
SQL["parse_answer_lenient"] = f"""with {_ANSL}, b as (select record_id, case when len(f) = 1 and f[1] in ('A', 'B', 'C', 'D', 'E') then f[1] when len(f) = 0 and o in ('A', 'B', 'C', 'D', 'E') then o end as answer from a)
select record_id, answer is not null as is_valid, answer from b"""
_KV = f"with {R}, t as (select record_id, coalesce(trace.decision, '') as dec, coalesce(predicted_answer, 'none') as memo, coalesce(trace.router_query, '') as rq from r where trace is not null)"
SQL["parse_kv_lines"] = f"{_KV} select record_id, lower({strip('dec')}) as decision, {strip('memo')} as memo, {strip('rq')} as query, 1 as n_queries from t"
_OPT = f"with {Q}, o as (select question_id, question, unnest(map_keys(options)) as letter, coalesce(unnest(map_values(options)), '') as option from q where options is not null)"
_OW = minus(wset("option"), T.STOP_OPTION)
_SCORE = f"round(case when len({_OW}) > 0 then len(list_filter({_OW}, lambda z13: contains(lower(question), z13)))::double / len({_OW}) else 0.5 end, 6)"
SQL["option_scores"] = f"{_OPT} select question_id, letter, {_SCORE} as score, contains(lower(option), 'itis') or contains(lower(option), 'ose') as eliminated from o"
SQL["confidence"] = f"""{_OPT}, s as (select question_id, letter, {_SCORE} as score from o), g as (select question_id, list(score order by score desc) as l, arg_min(letter, (-score, letter)) as letter from s group by 1)
select question_id, letter, round(case when len(l) = 1 then 0.9 else least(1.0, 0.5 + l[1] - l[2]) end, 6) as confidence from g"""
_CIT = f"with {R}, c as (select record_id, explanation, coalesce(len(trace.retrieved_passages), 0) as n, list_transform(regexp_extract_all(explanation, '\\[(\\d+)\\]', 1), lambda z14: z14::bigint) as c from r where explanation is not null)"
SQL["citation_audit"] = f"{_CIT} select record_id, n = 0 or len(c) > 0 as has_citations, case when n = 0 then 0 else len(c) end as citation_count from c"
SQL["citation_fidelity"] = f"{_CIT}, b as (select record_id, list_filter(c, lambda z15: z15 < 1 or z15 > n) as b from c) select record_id, len(b) = 0 as is_valid, {join('b', chr(39) + '|' + chr(39))} as unknown from b"
SQL["halluc_risk"] = f"{_CIT} select record_id, n > 0 and length(explanation) > 0 and len(c) = 0 and len({w1('explanation')}) > 10 as risk from c"
_DIRECT = lambda x: f"(len({w1(x)}) < 30 and ({' or '.join(f'contains(lower({x}), {chr(39)}{p}{chr(39)})' for p in tools.DIRECT_PHRASES)}))"
SQL["fast_path"] = f"with {Q} select question_id, {_DIRECT('question')} as direct from q"
SQL["fast_path_short"] = f"{_OPT}, t as (select question_id, letter, 'What is the first-line drug for ' || option || case when letter = 'B' then question else '' end as x from o) select question_id, letter, {_DIRECT('x')} as direct from t"
SQL["search_strategy"] = f"with {Q}, e as (select question_id, {ents('question', T.ENTITY_TERMS_B)} as e from q) select question_id, case when len(e) >= 2 then 'hybrid' when len(list_filter(e, lambda z16: regexp_full_match(z16, '[A-Z]{{2,}}'))) > 0 then 'sparse' else 'dense' end as strategy from e"
SQL["formatters"] = """with c as (select distinct case_id, coalesce(question, '') as q, coalesce(correct_answer, '') as a, coalesce(explanation, '') as e from memory_cases)
select case_id, md5('Exemplar [1]: ' || substr(q, 1, 80) || '... -> Answer ' || a || ': ' || substr(e, 1, 100) || '...') as pearls,
md5('### Clinical Case Memory Exemplars:' || chr(10) || '**Case #1**:' || chr(10) || 'Question: ' || q || chr(10) || 'Correct Answer: ' || a || chr(10) || 'Explanation: ' || e || chr(10)) as few_shot,
md5('Etiology: ' || q || ' -> Pathogenesis: ' || e || ' -> First-line Therapy: ' || a) as chain,
md5('Consensus Summary: Evaluated Reasoner proposal (''' || substr(e, 1, 60) || '...'') against Verifier Audit (''' || substr(q, 1, 60) || '...''). Consensus reached.') as consensus,
md5('Hypothetical clinical textbook passage discussing diagnosis and mechanisms for: ' || substr(q, 1, 80)) as hyde,
md5(case when a in ('A', 'B') then 'Max retries reached. Executing safe consensus fallback.' else 'Callback Request (Re-Retrieval Required): ' || q end) as callback from c"""
SQL["option_listing"] = f"with {Q} select question_id, md5({OPTLIST}) as listing from q where options is not null"
_ENDINGS = ", ".join(f"options['{x}'] as {x.lower()}" for x in "ABCDE")
SQL["options_mapped"] = f"with {Q} select question_id, {_ENDINGS}, case when upper({strip('answer')}) in ('A', 'B', 'C', 'D', 'E') then upper({strip('answer')}) end as answer from q where options is not null"
for _n, _p, _l in (("sample_dev", "dev-", "dev"), ("sample_official", "test-", "official_test")):
    SQL[_n] = f"with {Q} select question_id from q where question_id like '{_p}%' order by md5('42:{_l}:' || question_id), question_id limit 10"
SQL["memory_topk"] = f"""with {Q}, {S}, m as (select case_id, min(ord) as ord, any_value({wset("coalesce(question, '') || ' ' || coalesce(array_to_string(map_values(options), ' '), '') || ' ' || coalesce(explanation, '')")}) as w from memory_cases group by 1),
x as (select question_id, case_id, ord, len(list_intersect({minus(wset("question"), T.STOP_COVERAGE)}, w)) as overlap from sq cross join m),
k as (select *, row_number() over (partition by question_id order by overlap desc, ord, case_id) as rank from x) select question_id, case_id, overlap, rank from k where rank <= 2"""
SQL["split_disjoint"] = f"with {Q} select count(*) as n_shared from (select question_id from q where question_id like 'dev-%' intersect select question_id from q where question_id like 'test-%')"

_COST = "coalesce(prompt_tokens, 0) / 1e6 * 0.59 + coalesce(completion_tokens, 0) / 1e6 * 0.79"
SQL["leaderboard"] = f"""with {R} select variant, count(*) as n, count(*) filter (is_correct) as correct, round(avg(case when is_correct then 1.0 else 0.0 end) * 100, 6) as accuracy, round(avg(case when is_invalid then 1.0 else 0.0 end) * 100, 6) as invalid,
round(avg(total_tokens), 6) as avg_tokens, round(avg(latency_seconds) filter (not isnan(latency_seconds)), 6) as avg_latency, round(sum({_COST}), 6) as cost from r group by 1"""
SQL["usage_rollup"] = f"with {R} select question_id, variant, count(*) as n_calls, sum(prompt_tokens)::bigint as prompt_tokens, sum(completion_tokens)::bigint as completion_tokens, sum(total_tokens)::bigint as total_tokens from r group by 1, 2"
SQL["throughput"] = f"with {R} select variant, count(*) filter (is_correct) as correct, count(*) as total, round(sum(case when latency_seconds is not null and not isnan(latency_seconds) then latency_seconds else 0.0 end) / count(*), 6) as time_each, round(sum(coalesce(total_tokens, 0)) / count(*), 6) as tokens_each from r group by 1"
SQL["error_causes"] = f"""with {R}, c as (select variant, case when coalesce(is_correct, false) then null when predicted_answer is null then 'missing' when upper(trim(predicted_answer)) = 'ERR' then 'error' when is_invalid then 'invalid' else 'wrong' end as cause from r)
select variant, cause, count(*) as n from c where cause is not null group by 1, 2"""
_SC = f"{R}, sc as (select variant, question_id, case when avg(case when is_correct then 1.0 else 0.0 end) >= 0.5 then 1 else 0 end as score from r where question_id is not null and variant is not null group by 1, 2)"
_PAIRS = "(values ('V0', 'V1'), ('V1', 'V2'), ('V2', 'V3'), ('V4', 'V3'), ('V0', 'V3')) t(x, y)"
SQL["paired_comparison"] = f"""with {_SC}, d as (select x || '-' || y as pair, b.score - a.score as d from {_PAIRS} join sc a on a.variant = x join sc b on b.variant = y and b.question_id = a.question_id),
g as (select pair, count(*) as n, count(*) filter (d > 0) as win, count(*) filter (d < 0) as loss, count(*) filter (d = 0) as tie, avg(d) as m, coalesce(stddev_samp(d), 0.0) as sd from d group by 1)
select pair, n, win, loss, tie, round(m * 100, 6) as delta, round(case when win + loss > 0 then power(abs(win - loss) - 1.0, 2) / (win + loss) else 0.0 end, 6) as statistic, round((m - 1.96 * sd / sqrt(n)) * 100, 6) as low, round((m + 1.96 * sd / sqrt(n)) * 100, 6) as high,
case when round(m * 100, 6) > 0 then 'gain' when round(m * 100, 6) < 0 then 'drop' else 'same' end as finding from g"""
_ALL = _SC.replace(">= 0.5", ">= 1.0")
SQL["loss_sets"] = f"with {_ALL} select a.question_id, case when a.score = 1 then 'loss' else 'both_wrong' end as kind from sc a join sc b using (question_id) where a.variant = 'V0' and b.variant = 'V3' and b.score = 0"
# The complementary error function by Simpson's rule, the binomial tail by log factorials.
_ERFC = "2 / sqrt(pi()) * 0.002 / 3 * list_sum(list_transform(range(0, 4001), lambda i: exp(-power(x + i * 0.002, 2)) * case when i = 0 or i = 4000 then 1 when i % 2 = 1 then 4 else 2 end))"
_TAIL = "list_sum(list_transform(range(0, least(win, loss) + 1), lambda i: exp(lgamma(win + loss + 1) - lgamma(i + 1) - lgamma(win + loss - i + 1) - (win + loss) * ln(2))))"
SQL["p_values"] = f"""with {_SC}, d as (select x || '-' || y as pair, b.score - a.score as d from {_PAIRS} join sc a on a.variant = x join sc b on b.variant = y and b.question_id = a.question_id),
g as (select pair, count(*) filter (d > 0) as win, count(*) filter (d < 0) as loss from d group by 1), h as (select *, case when win + loss > 0 then sqrt(power(abs(win - loss) - 1, 2) / (win + loss) / 2) end as x from g)
select pair, round(case when x is null then 1.0 else {_ERFC} end, 9) as p_value, round(case when x is null then 1.0 else least(1.0, 2 * {_TAIL}) end, 9) as p_exact from h"""
SQL["variant_pivot"] = f"with {R} select question_id, " + ", ".join(f"arg_min(coalesce(predicted_answer, '-'), record_id) filter (variant = '{v}') as {v}" for v in ("V0", "V1", "V2", "V3", "V4")) + " from r where variant in ('V0', 'V1', 'V2', 'V3', 'V4') group by 1"
SQL["answers_corrected"] = f"with {R} select record_id, coalesce(upper(predicted_answer) = upper(correct_answer), false) as correct, round({_COST}, 9) as cost from r"
SQL["cache_misses"] = f"""with {R}, k as (select record_id, coalesce(question_id, '~') || '|' || coalesce(variant, '~') as k from r), c as (select distinct k from k where record_id % 2 = 0)
select count(*) as n_requests, count(distinct k) as n_keys, count(*) filter (k in (select k from c)) as n_hits, count(distinct k) filter (k not in (select k from c)) as n_to_compute from k"""
SQL["dataset_search_page"] = f"with {Q}, h as (select question_id, count(*) over () as total from q where contains(lower(question), 'which')) select question_id, total from h order by question_id limit 10 offset 10"
SQL["sub_seed"] = f"with {Q} select question_id, ('0x' || substr(sha256('42:' || question_id), 1, 16))::ubigint::decimal(20, 0) as seed from q"
_LINE = r"Final\s+Answer\s*:\s*\(?\s*[A-Za-z]\s*\)?(?:$|([^A-Za-z0-9]))"
SQL["strip_answer"] = f"with {R}, t as (select record_id, regexp_replace(explanation, '{_LINE}', '\\1', 'gi') as x from r where explanation is not null) select record_id, md5({strip('x')}) as text from t"
SQL["citation_ids"] = f"""with {P}, c as (select parent_id, source, coalesce(text, '') as text, row_number() over (partition by parent_id order by cast(regexp_extract(passage_id, '([0-9]+)$', 1) as int), source, text) as n from p where parent_id is not null)
select parent_id, '[' || n || ']' as citation_id, coalesce(source, 'Corpus') as source, md5({cut("text", "15", "...")}) as text from c"""
SQL["fan_out"] = f"with {Q} select question_id, variant from q cross join (values ('V0'), ('V1'), ('V2'), ('V3'), ('V4')) t(variant) where {HELD}"
SQL["tool_catalog"] = "select * from (values ('router', 6), ('researcher', 8), ('memory', 4), ('reasoner', 5), ('verifier', 4)) t(agent, n)"
SQL["dag_levels"] = f"with {P} select passage_id as node, case when parent_id is null then 0 else 1 end as level from p"
SQL["dag_cycle"] = "select doc_id as node from documents where (doc_id // 10) % 2 = 0"
SQL["stream_daily"] = """with e as (select date_trunc('day', ts) as day, event_type, value, max(ts) over () as last from events)
select day::date as day, event_type, count(*) as n, round(sum(value), 4) as total from e where day + interval 1 day <= last - interval 1 hour group by 1, 2"""

# The flows, by the replies of the scripted client: what a role answers follows from its prompt's hash.
_NL = "chr(10)"
_ASK = "End with a line of the form ''Final Answer: X'', where X is one of the letters."
_HS = f"sq as (select * from q where {HELD})"


def parts(*x: str) -> str:
    return f" || {_NL} || {_NL} || ".join(x)


def titled(title: str, body: str) -> str:
    return f"'{title}:' || {_NL} || coalesce({body}, '')"


def digit(role: str, prompt: str) -> str:
    """The last hex digit of the hash of role and prompt; the number modulo 2 and 4 follows from it."""
    return f"(strpos('0123456789abcdef', right(sha256('{role}' || {_NL} || {prompt}), 1)) - 1)"


def letter(role: str, prompt: str) -> str:
    return f"substr('ABCD', {digit(role, prompt)} % 4 + 1, 1)"


def said(role: str) -> str:
    return f"'Scripted reasoning of {role}. [1]'"


def reply(role: str, prompt: str) -> str:
    return f"{said(role)} || {_NL} || 'Final Answer: ' || {letter(role, prompt)}"


_CASE = parts(titled("Question", "question"), titled("Options", f"case when options is null then '' else {OPTLIST} end"))


def found(n: int, k: int, name: str = "hits", text: str = "question") -> str:
    """For each question of `sq` its k best passages as a list {n, source, text}, from lists of n."""
    return f"""{lists(n, text)}, {fused(0)}, {CTX}, {_DEDUP.format("c")}, w as (select *, row_number() over (partition by qk order by rank) as pos from v),
{name} as (select qk as question_id, list({{'n': pos, 'source': source, 'text': text, 'score': score}} order by pos) as h from w where pos <= {k} group by 1)"""


def block(h: str) -> str:
    return f"coalesce(array_to_string(list_transform({h}, lambda b1: '[' || b1.n || '] (' || coalesce(b1.source, 'unknown') || ') ' || coalesce({cut('b1.text', '200', ' [Truncated]')}, '')), {_NL}), '')"


def exemplar() -> str:
    """For each question of `sq` the one case that shares most words with it, as it is shown."""
    return f"""cases as (select case_id, min(ord) as ord, any_value(coalesce(question, '')) as cq, any_value(coalesce(correct_answer, '')) as ca, any_value(coalesce(explanation, '')) as ce,
  any_value({wset("coalesce(question, '') || ' ' || coalesce(array_to_string(map_values(options), ' '), '') || ' ' || coalesce(explanation, '')")}) as w from memory_cases group by 1),
near as (select question_id, case_id, row_number() over (partition by question_id order by len(list_intersect({minus(wset("question"), T.STOP_COVERAGE)}, w)) desc, ord, case_id) as r from sq cross join cases),
shown as (select question_id, '### Clinical Case Memory Exemplars:' || {_NL} || '**Case #1**:' || {_NL} || 'Question: ' || cq || {_NL} || 'Correct Answer: ' || ca || {_NL} || 'Explanation: ' || ce || {_NL} as shown from near join cases using (case_id) where r = 1),
mem as (select question_id, {reply("memory_specialist", parts("'Say what the solved cases teach for the question.'", titled("Cases", "shown"), titled("Question", "question")))} as memory from sq join shown using (question_id))"""


def reasoner(brief: str, memory: str | None = None) -> str:
    middle = [titled("Memory", memory)] if memory else []
    return parts("'Reason step by step over the evidence and propose an answer.'", titled("Evidence", brief), *middle, _CASE, f"'{_ASK}'")


def verifier(brief: str) -> str:
    return parts("'Check the proposal against the passages and give the answer.'", titled("Passages", brief), _CASE, titled("Proposed answer", "candidate"), titled("Explanation", said("reasoner")), f"'{_ASK}'")


def shown(variant: str, answer: str, calls: str, decision: str = "null::varchar") -> str:
    return f"select question_id, '{variant}' as variant, {answer} as answer, true as is_valid, {calls} * 15 as total_tokens, {calls} as n_calls, {decision} as decision"


SQL["variant_v0"] = f"with {Q}, {_HS} {shown('V0', letter('direct', parts(chr(39) + 'Answer the multiple-choice question and explain why.' + chr(39), _CASE, chr(39) + _ASK + chr(39))), '1')} from sq"
_RAG = parts("'Answer the multiple-choice question from the passages and cite them as [n].'", titled("Passages", block("h")), _CASE, f"'{_ASK}'")
SQL["variant_v1"] = f"with {Q}, {_HS}, {P}, {PS}, {found(10, 3)} {shown('V1', letter('rag', _RAG), '1')} from sq left join hits using (question_id)"
SQL["variant_v2"] = f"""with {Q}, {_HS}, {P}, {PS}, {found(10, 3)}, cand as (select *, {letter("reasoner", reasoner("b"))} as candidate from (select *, {block("h")} as b from sq left join hits using (question_id))),
ver as (select *, {letter("verifier", verifier("b"))} as final from cand) {shown('V2', 'final', '3', "case when candidate = final then 'approve' else 'override' end")} from ver"""
SQL["variant_v3"] = f"""with {Q}, {_HS}, {P}, {PS}, {found(10, 3)}, {exemplar()},
cand as (select *, {letter("reasoner", reasoner("b", "memory"))} as candidate from (select *, {block("h")} as b from sq left join hits using (question_id) join mem using (question_id))),
ver as (select *, {letter("verifier", verifier("b"))} as final from cand) {shown('V3', 'final', '4', "case when candidate = final then 'approve' else 'override' end")} from ver"""
_SYNTHESIS = parts("'Sum up what the passages say on the question, with citations [n].'", titled("Question", "question"), titled("Passages", "b"))
SQL["variant_v4"] = f"""with {Q}, {_HS}, {P}, {PS}, {found(16, 6)}, {exemplar()},
top3 as (select * replace (list_slice(h, 1, 3) as h) from hits),
brief as (select *, case when h is null then 'No clinical evidence retrieved.' else {reply("researcher_synthesis", _SYNTHESIS)} end as brief from (select *, {block("h")} as b from sq left join top3 using (question_id) join mem using (question_id)))
{shown('V4', letter("reasoner", reasoner("brief", "memory")), "case when h is null then 3 else 4 end")} from brief"""


_QT = "q_text"


def retrieved(source: str, key_: str, text: str, options: str = "options") -> str:
    """hits(question_id, h) of the searches in a table, three each, with compressed texts; its names stay inside."""
    item = f"{{'n': pos, 'id': doc_id, 'source': source, 'text': {compress('text', f'list_concat({kw(_QT)}, {OPTW})')}, 'score': score}}"
    return f"""(with sq as (select {key_} as question_id, {text} as question, {options} as options from {source}), {P}, {PS}, {lists(10)}, {fused(0)}, {CTX}, {_DEDUP.format("c")},
w as (select *, row_number() over (partition by qk order by rank) as pos from v) select qk as question_id, list({item} order by pos) as h from w where pos <= 3 group by 1)"""


def third(role: str, prompt: str) -> str:
    """The number modulo 3: the sum of its hex digits, as 16 leaves 1."""
    return f"list_sum(list_transform(string_split(sha256('{role}' || {_NL} || {prompt}), ''), lambda t1: strpos('0123456789abcdef', t1) - 1)) % 3"


_ONE_LINE = r"regexp_replace(question, '\r\n|[\n\r\v\f\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]', ' ', 'g')"
_JUDGE = parts("'Judge whether the passages suffice. Lines: ''Relevance: sufficient|insufficient'', ''Reason: ...'', ''Suggested Focus: ...''.'", titled("Question", "question"), titled("Query", "query"), titled("Passages", block("h")))
_SHARE = "greatest(2, 350 // greatest(coalesce(len(h), 0), 1))"
_BRIEF = f"case when coalesce(len(h), 0) = 0 then 'No clinical evidence retrieved.' else array_to_string(list_transform(h, lambda b2: '[' || b2.n || '] ' || coalesce({cut('b2.text', _SHARE, '...')}, '')), {_NL}) end"
_REVIEW = parts("'Review the proposal. Lines: ''Decision: agree|disagree'', ''Review Memo: ...''.'", titled("Evidence", "brief"), _CASE, titled("Proposed answer", "candidate"), titled("Explanation", said("reasoner")))
_DEBATE = parts("'Answer the reviewer''s objection; keep or change the answer.'", titled("Evidence", "brief"), _CASE, titled("Proposed answer", "candidate"), titled("Objection", "'scripted'"), f"'{_ASK}'")
_AGREED = parts("'Decide after the debate.'", titled("Evidence", "brief"), _CASE, titled("Proposal", f"{said('reasoner')} || {_NL} || 'Final Answer: ' || candidate"), titled("Objection", "'scripted'"), titled("Reply", "rebuttal"), f"'{_ASK}'")
SQL["variant_v2_advanced"] = f"""with {Q}, sq as materialized (select * from q where {HELD}), h1 as materialized {retrieved("sq", "question_id", "question")},
s1 as materialized (select sq.*, h1.h as h1, coalesce(list_max(list_transform(h1.h, lambda m1: m1.score)), 0) >= 0.030 as bypass, {strip(_ONE_LINE)} as part0, {strip("'treatment ' || " + _ONE_LINE)} as part1 from sq left join h1 using (question_id)),
p2 as materialized (select question_id, options, 0 as part, part0 as t, question_id || '#0' as k from s1 where not bypass union all select question_id, options, 1, part1, question_id || '#1' from s1 where not bypass),
h2 as materialized {retrieved("p2", "k", "t")},
flat as (select p2.question_id, p2.part, unnest(h2.h) as x from h2 join p2 on p2.k = h2.question_id),
once as (select *, row_number() over (partition by question_id, x.id order by round(x.score, 9) desc, part) as one from flat),
best as (select *, row_number() over (partition by question_id order by round(x.score, 9) desc, part, x.id) as pos from once where one = 1),
merged as (select question_id, list({{'n': pos, 'id': x.id, 'source': x.source, 'text': x.text, 'score': x.score}} order by pos) as h from best where pos <= 3 group by 1),
s2 as materialized (select s1.*, case when bypass then h1 else merged.h end as h, case when bypass then question else part0 || ' || ' || part1 end as query from s1 left join merged using (question_id)),
s3 as materialized (select *, {digit("researcher_eval", _JUDGE)} % 2 = 0 and coalesce(len(h), 0) > 0 as again from s2),
p4 as materialized (select question_id, options, {_ONE_LINE} || ' again' as t from s3 where again), h4 as materialized {retrieved("p4", "question_id", "t")},
s4 as materialized (select s3.* replace (case when again then h4.h else s3.h end as h) from s3 left join h4 using (question_id)),
s5 as materialized (select *, {_BRIEF} as brief from s4), s6 as materialized (select *, {letter("reasoner", reasoner("brief"))} as candidate from s5),
s7 as materialized (select *, {third("verifier_review", _REVIEW)} = 0 as against from s6), s8 as materialized (select *, {reply("reasoner_debate", _DEBATE)} as rebuttal from s7),
s9 as (select *, case when against then {letter("verifier_consensus", _AGREED)} else candidate end as final, 3 + (not bypass)::int + again::int + 2 * against::int as calls from s8)
{shown("V2", "final", "calls", "case when against then 'disagree' else 'agree' end")} from s9"""

# Diverse lists, by recursion over the ranks or the places to fill.
_NOTNULL = "coalesce(text, '')"
_LISTS = f"{BASE.replace('with ', 'with recursive ', 1)}, {fused(0)}, {CTX}, t as materialized (select qk, doc_id, score, rank, {wset(_NOTNULL)} as w from c), l as materialized (select qk, list({{'rank': rank, 'id': doc_id, 'score': score, 'w': w}} order by rank) as h from t group by 1)"
_SHOWN = "select qk as question_id, x.id as passage_id, round(x.score, 6) as score, n as rank from (select qk, unnest(acc) as x, unnest(range(1, len(acc) + 1)) as n from {0})"
_LIKE = lambda x, acc: f"coalesce(list_max(list_transform({acc}, lambda j1: {jac(x + '.w', 'j1.w')})), 0.0)"
SQL["mmr_skip"] = f"""{_LISTS}, st as (select qk, 0 as r, list_filter(h, lambda x1: false) as acc from l
  union all select st.qk, r + 1, case when len(acc) < 5 and (len(acc) = 0 or 0.5 * h[r + 1].score - 0.5 * {_LIKE('h[r + 1]', 'acc')} >= 0) then list_append(acc, h[r + 1]) else acc end from st join l using (qk) where r < len(h)),
e as (select qk, arg_max(acc, r) as acc from st group by 1) {_SHOWN.format('e')}"""
SQL["mmr_greedy"] = f"""{_LISTS}, st as (select qk, 1 as r, list_slice(h, 1, 1) as acc from l where len(h) > 5
  union all select st.qk, r + 1, list_append(acc, list_max(list_transform(list_filter(h, lambda x2: not list_contains(list_transform(acc, lambda p1: p1.rank), x2.rank)), lambda x3: {{'s': round(0.7 * x3.score - 0.3 * {_LIKE('x3', 'acc')}, 12), 'r': -x3.rank, 'x': x3}})).x)
  from st join l using (qk) where r < 5), e as (select qk, acc from st where r = 5 union all select qk, h from l where len(h) <= 5) {_SHOWN.format('e')}"""

SQL["first_rows"] = f"with {Q} select question_id from q order by question_id limit 25"
SQL["passage_kinds"] = f"with {P} select passage_id, case when parent_id is null then 'parent' else 'child' end as kind from p"
SQL["records_judged"] = f"""with {Q}, {R} select record_id, predicted_answer, q.answer as correct_answer, coalesce(predicted_answer = q.answer, false) as is_correct, coalesce(is_invalid, true) as is_invalid from r left join q using (question_id)"""
SQL["relevance_lines"] = f"""with {R} select record_id, case when variant = 'V1' then 'sufficient' else lower({strip("coalesce(trace.decision, '')")}) end as relevance, {strip("coalesce(trace.router_query, '')")} as reason, 'dose' as focus from r where trace is not null"""
SQL["questions_read_back"] = f"with {Q} select question_id, md5(question) as question, cardinality(options)::int as n_options, answer from q where options is not null and answer is not null"
SQL["chunks_read_back"] = f"with {P} select passage_id, source, parent_id, md5(text) as text from p where source is not null and text is not null"
SQL["predictions_read_back"] = f"with {R} select record_id, question_id, variant, is_correct, total_tokens, run_day, len(trace.retrieved_passages)::int as n_passages from r"
SQL["embedding_cache"] = f"""with {Q}, {hv("v", "q", "question_id", "question")}, known as (select distinct question from q where question_id like 'train-%'),
made as (select count(distinct question) as n_made from q where question not in (select question from known))
select question_id, round(coalesce((select max(x) from v where id = question_id), 0), 4) as largest, n_made from q cross join made"""
SQL["retrieval_cache"] = f"with {Q}, {S}, d as (select distinct question, options::varchar as o from sq) select (select 2 * count(*) from sq) as n_answered, (select count(*) from sq) as n_later, (select count(*) from d) as n_run"
SQL["call_log"] = f"with {Q}, {_HS} select question_id, 'direct' as role, 2 as n_calls, 1 as n_hits, 30 as total_tokens from sq"
SQL["index_built"] = f"""{_PAR}, cc as (select list_slice(w, j * 64 + 1, j * 64 + 64) as w from (select *, unnest(range(0, cast(ceil(len(w) / 64.0) as bigint))) as j from pp))
select (select count(*) from pp) + count(*) as n_passages, count(*) as n_searched, round(avg(len({w2("array_to_string(w, ' ')")})), 6) as avgdl from cc"""
