"""Registered queries of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from partita.llm import chat, leaks, near, packing, personal, quality, scoring, secrets, substrings, suffixes


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.report(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_packing, op3_suffix_array_dedup, op4_secret_scans, op5_minhash_near_dedup, op6_pii, op7_substring_dedup, op8_benchmark_decontamination, op9_lm_scoring, op10_chat_formatting)}

_WORDS = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# the measures by windows over words and lines; the fences by sums over buckets, each sketch joined with its prior's 200 rows
_OP1 = rf"""with d as (select doc_id, lang, source, coalesce(text, '') as t, {_WORDS.format("coalesce(text, '')")} as a from documents),
 w as (select doc_id, generate_subscripts(a, 1) as i, unnest(a) as x from d),
 g as (select doc_id, i, case when lead(x, 2) over (partition by doc_id order by i) is not null then x || ' ' || lead(x) over (partition by doc_id order by i) || ' ' || lead(x, 2) over (partition by doc_id order by i) end as g from w),
 h as (select doc_id, i, case when g is not null and count(*) over (partition by doc_id, g) > 1 then 1 else 0 end as again from g),
 r as (select doc_id, sum(c) as n from (select doc_id, max(again) over (partition by doc_id order by i rows between 2 preceding and current row) as c from h) q group by doc_id),
 l as (select doc_id, list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) as ls from d),
 m as (select d.doc_id, lang, source, cast(len(a) as bigint) as n_words, cast(coalesce(list_sum(list_transform(a, lambda y: length(y))), 0) as bigint) as word_chars,
  cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(ls) as bigint) as n_lines, cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, cast(coalesce(r.n, 0) as bigint) as n_repeat_words
  from d join l on d.doc_id = l.doc_id left join r on r.doc_id = d.doc_id),
 f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, n_symbols / greatest(n_words, 1)::double as x1, n_dup_lines / greatest(n_lines, 1)::double as x2, n_repeat_words / greatest(n_words, 1)::double as x3 from m),
 v as (select lang, source, k, x from f, lateral (select unnest(['symbols', 'dup_lines', 'repeats']) as k, unnest([x1, x2, x3]) as x) z where not base_failed),
 c as (select lang, source, k, case when x <= 0 then -1000 else cast(floor(ln(x) / ln(1.05::double)) as int) end as b, count(*) as n from v group by all),
 ca as (select k, b, n, sum(n) over (partition by k) as rows_ from (select k, b, sum(n) as n from c group by k, b) q),
 cl as (select lang, k, b, sum(n) as n from c group by lang, k, b),
 lr as (select lang, k, sum(n) as rows_ from cl group by lang, k),
 jl as (select lr.lang, lr.k, ca.b, coalesce(cl.n, 0) + 200::double * ca.n / ca.rows_ as n, lr.rows_ + 200 as r from lr join ca on ca.k = lr.k left join cl on cl.lang = lr.lang and cl.k = lr.k and cl.b = ca.b),
 gr as (select lang, source, k, sum(n) as rows_ from c group by lang, source, k),
 jg as (select gr.lang, gr.source, gr.k, gr.rows_, jl.b, coalesce(c.n, 0) + 200::double * jl.n / jl.r as n from gr join jl on jl.lang = gr.lang and jl.k = gr.k left join c on c.lang = gr.lang and c.source = gr.source and c.k = gr.k and c.b = jl.b),
 t as (select *, sum(n) over (partition by lang, source, k order by b rows between unbounded preceding and current row) as up, sum(n) over (partition by lang, source, k) as some_ from jg where b > -1000),
 q as (select lang, source, k, min(rows_) as rows_, min(some_) as some_, min(case when up >= 0.25::double * some_ - 1e-9 then b end) as low, min(case when up >= 0.5::double * some_ - 1e-9 then b end) as mid from t group by lang, source, k),
 o as (select lang, source, k, case when mid = low then 0.3::double else least(power(1.05::double, mid + 1 + 4 * (mid - low)), 0.3::double * (1 + greatest(some_ / (rows_ + 200) - 0.5::double, 0))) end as most from q),
 p as (select lang, source, max(case when k = 'symbols' then most end) as o1, max(case when k = 'dup_lines' then most end) as o2, max(case when k = 'repeats' then most end) as o3 from o group by lang, source)
 select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(x1 <= o1, true) and coalesce(x2 <= o2, true) and coalesce(x3 <= o3, true) as kept
 from f left join p on p.lang = f.lang and p.source = f.source"""

# exact sets of all documents, all pairs that share a shingle, and what can be reached over the links
_OP5 = rf"""with recursive d as (select doc_id, {_WORDS.format(_LOWER)} as a from documents),
 s as (select distinct doc_id, unnest(case when len(a) = 0 then [] when len(a) < 5 then [array_to_string(a, ' ')] else list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' ')) end) as x from d),
 n as (select doc_id, count(*) as n from s group by doc_id),
 p as (select a.doc_id as u, b.doc_id as v, count(*) as c from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
 e as (select u, v from p join n a on a.doc_id = u join n b on b.doc_id = v where 100 * c >= 75 * (a.n + b.n - c)),
 both_ as (select u, v from e union all select v, u from e),
 reach as (select doc_id as u, doc_id as v from d union select r.u, b.v from reach r join both_ b on r.v = b.u),
 m as (select u, min(v) as least_ from reach group by u)
 select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, least_ as component_id, least_ = d.doc_id as kept from d left join n on n.doc_id = d.doc_id join m on m.u = d.doc_id"""

_OP7 = rf"""with d as (select doc_id, {_WORDS.format("coalesce(text, '')")} as a from documents), w as (select doc_id, generate_subscripts(a, 1) as i, unnest(a) as x from d),
 g as (select doc_id, i, x, case when i + 12 <= count(*) over (partition by doc_id) then string_agg(x, ' ') over (partition by doc_id order by i rows between current row and 12 following) end as g from w),
 h as (select doc_id, i, x, case when g is not null and min(doc_id) over (partition by g) < doc_id then 1 else 0 end as hit from g),
 c as (select doc_id, i, x, max(hit) over (partition by doc_id order by i rows between 12 preceding and current row) as gone from h)
 select d.doc_id, cast(len(any_value(a)) as bigint) as n_words, cast(coalesce(sum(gone), 0) as bigint) as n_removed, sha256(coalesce(string_agg(x, ' ' order by i) filter (where gone = 0), '')) as kept_sha256
 from d left join c on c.doc_id = d.doc_id group by d.doc_id"""

ORACLE = {
    "op1_quality_rules": _OP1,
    "op5_minhash_near_dedup": _OP5,
    "op7_substring_dedup": _OP7,
    "op10_chat_formatting": r"""with c as (select conv_id, turn, role, coalesce(text, '') as t from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
 select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' order by turn)) as turns_sha256,
 cast(coalesce(sum(length(t)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
 sha256(coalesce(string_agg(t, '' order by turn) filter (where role = 'assistant'), '')) as loss_sha256,
 cast(sum(23 + length(role || t) + length(regexp_replace(role || t, '[^\\<>\[\]]', '', 'g'))) as bigint) as formatted_chars
 from c group by conv_id"""
}
