"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from logstrata.llm import decontaminate, jaccard_join, lm_scoring, mixing, quality_classifier, quality_rules, secret_scan, sharding, toxicity, url_filter

SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark, sf_dir):
    return quality_classifier.classify(_t(spark, sf_dir, "documents"))


def op2_secret_scan(spark, sf_dir):
    return secret_scan.scan(_t(spark, sf_dir, "documents"))


def op3_sharding(spark, sf_dir):
    return sharding.place(_t(spark, sf_dir, "documents").select("doc_id"), SHARDS)


OP3_SQL = f"""with filled as (select string_split('{",".join(map(str, sharding.fill(SHARDS)))}', ',') as t),
placed as (select doc_id, cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) % {sharding.SLOTS} as slot from documents)
select doc_id, slot, 'shard-' || lpad(t[slot + 1], 3, '0') as shard from placed, filled"""


def op4_mixing(spark, sf_dir):
    return mixing.mix(_t(spark, sf_dir, "documents"), mixing.cycled((3, 1, 2)), share=1.5, repeats=2.0).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "shard", "quota", "passes", "first_word", "tail_words", "head_words")


def op4_source_targets(spark, sf_dir):
    """What op4_mixing aims at, source by source."""
    rows = op4_mixing(spark, sf_dir)
    return rows.groupBy("source").agg(F.max("source_size").alias("source_size"), F.round(F.max("target"), 6).alias("target"), F.count("*").alias("n_docs"))


OP4_TARGETS_SQL = r"""with s as (select source, cast(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) as double) as size, count(*) as n_docs from documents group by source),
w as (select *, ([3.0, 1.0, 2.0])[1 + (row_number() over (order by source nulls last) - 1) % 3] as weight from s),
t as (select least(1.5, 2.0) * sum(size) as whole from s),
level as (select max(l) as l from (select (whole - (select coalesce(sum(2 * size), 0) from w b where b.size / b.weight < a.size / a.weight)) / (select sum(weight) from w b where b.size / b.weight >= a.size / a.weight) as l,
  2 * a.size / a.weight as full_at, (select coalesce(max(2 * b.size / b.weight), 0) from w b where b.size / b.weight < a.size / a.weight) as before from w a, t) where l >= before and l <= full_at)
select source, cast(size as bigint) as source_size, round(case when l is null then 2 * size else least(2 * size, l * weight) end, 6) as target, n_docs from w, level"""


def op5_jaccard_join(spark, sf_dir):
    return jaccard_join.join(_t(spark, sf_dir, "documents"), n=4, percent=85)


OP5_SQL = r"""with recursive d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sh as (select distinct rid, list_slice(w, i, i + 3) as s from (select rid, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from d where len(w) > 0)),
n as (select rid, count(*) as n from sh group by rid),
shared as (select rid, s from (select rid, s, count(*) over (partition by s) as df from sh) where df > 1),
met as (select a.rid as x, b.rid as y, count(*) as k from shared a join shared b on a.s = b.s and a.rid < b.rid group by all),
link as (select x, y from met join n nx on nx.rid = x join n ny on ny.rid = y where 100 * k >= 85 * (nx.n + ny.n - k)),
e as (select x as a, y as b from link union select y, x from link),
reach as (select rid, rid as r from d union select reach.rid, e.b from reach join e on e.a = reach.r)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, min(o.doc_id) as component_id from d left join n using (rid) join reach on reach.rid = d.rid join d o on o.rid = reach.r group by d.rid, d.doc_id, n.n"""


def op6_lm_scoring(spark, sf_dir):
    scored = lm_scoring.score(_t(spark, sf_dir, "documents"))
    return scored.withColumns({c: F.round(c, 5) for c in ("log_score", "score")})  # sums of logarithms differ in their last digits


OP6_SQL = r"""with d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
t as (select rid, i, w[i] as a, w[i - 1] as b, w[i - 2] as c from (select rid, w, unnest(range(1, len(w) + 1)) as i from d)),
n as (select rid, i, count(*) over () - count(*) over (partition by rid) as rest, count(*) over (partition by a) - count(*) over (partition by rid, a) as n1,
  case when i > 1 then count(*) over (partition by b, a, i > 1) - count(*) over (partition by rid, b, a, i > 1) end as n2,
  case when i > 2 then count(*) over (partition by c, b, a, i > 2) - count(*) over (partition by rid, c, b, a, i > 2) end as n3 from t),
p as (select *, lag(n1) over (partition by rid order by i) as c1, lag(n2) over (partition by rid order by i) as c2 from n),
s1 as (select *, ln(greatest(n1, 0.5) / greatest(rest, 1)) as v1 from p),
s2 as (select *, case when i = 1 then v1 when n2 > 0 then ln(n2 / c1) else ln(0.4) + v1 end as v2 from s1),
s3 as (select *, case when i < 3 then v2 when n3 > 0 then ln(n3 / c2) else ln(0.4) + v2 end as v3 from s2),
x as (select rid, sum(v3) as v from s3 group by rid)
select doc_id, cast(len(w) as bigint) as n_words, round(coalesce(v, 0), 5) as log_score, round(coalesce(v / len(w), 0), 5) as score from d left join x using (rid)"""


URL_RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


def op7_url_filter(spark, sf_dir):
    return url_filter.judge(_t(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


def op7_url_rules(spark, sf_dir):
    """The part of op7_url_filter that rules decide."""
    rows = op7_url_filter(spark, sf_dir)
    return rows.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("rule_verdict"))


OP7_RULES_SQL = r"""with u as (select page_id, case when strpos(coalesce(url, ''), '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
r(rule, verdict) as (values ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')),
fits as (select page_id, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict
  from p join r on (host = split_part(rule, '/', 1) or ends_with(host, '.' || split_part(rule, '/', 1))) and starts_with(path, substr(rule, strpos(rule, '/'))) group by page_id)
select p.page_id, host, path, rule, verdict as rule_verdict from p left join fits using (page_id)"""


def op8_toxicity(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _t(spark, sf_dir, "labels").filter(~toxicity.held_out()))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op9_quality_rules(spark, sf_dir):
    ledger = quality_rules.apply_policy(quality_rules.evaluate(_t(spark, sf_dir, "documents")), "strict-1")
    return ledger.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality_rules.fails("base").alias("base_failed"), "kept",
        "n_lines", "n_stutter", "n_letters", "n_upper", "fail_bits")


_B = quality_rules.BIT
OP9_SQL = rf"""with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
w as (select rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
win as (select rid, i, list_slice(w, i, i + 7) as win from (select rid, w, unnest(range(1, len(w) - 6)) as i from w)),
twice as (select rid, i from (select rid, i, count(*) over (partition by rid, win) as c from win) where c > 1),
rep as (select rid, count(distinct i + k) as n from twice, range(0, 8) t(k) group by rid),
m as (select doc_id, cast(len(w) as bigint) as n_words, cast(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
  cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines,
  coalesce(rep.n, 0)::bigint as n_repeat_words, cast(len(l) as bigint) as n_lines,
  cast(len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) as bigint) as n_stutter,
  cast(length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) as bigint) as n_letters, cast(length(text) - length(regexp_replace(text, '\p{{Lu}}+', '', 'g')) as bigint) as n_upper
  from w left join rep using (rid)),
b as (select *, cast(case when n_words < 20 then {_B['few_words']} else 0 end + case when 100 * n_repeat_words > 30 * n_words then {_B['repeated_words']} else 0 end
  + case when 10 * n_symbols > n_words then {_B['symbols']} else 0 end + case when word_chars < 2 * n_words or word_chars > 20 * n_words then {_B['word_length']} else 0 end
  + case when 100 * n_dup_lines > 40 * n_lines then {_B['repeated_lines']} else 0 end + case when 100 * n_letters < 60 * word_chars then {_B['few_letters']} else 0 end
  + case when 100 * n_upper > 50 * n_letters then {_B['shouting']} else 0 end + case when 100 * n_stutter > 20 * n_words then {_B['stutter']} else 0 end as bigint) as fail_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 as base_failed, fail_bits = 0 as kept, n_lines, n_stutter, n_letters, n_upper, fail_bits from b"""


def op10_decontaminate(spark, sf_dir):
    return decontaminate.report(decontaminate.Matches(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"), window=10))


def op10_proximity(spark, sf_dir):
    """op10_decontaminate with proximity matches: four fifths of an item's words within two places of one alignment."""
    return decontaminate.report(decontaminate.Matches(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"), window=10, slop=2))


OP10_SQL = r"""with d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
iw as (select distinct item, len, list_slice(w, i, i + len - 1) as win from (select item, w, least(10, len(w)) as len, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
lens as (select distinct len from iw),
dw as (select rid, len, i, list_slice(w, i, i + len - 1) as win from (select rid, w, len, unnest(range(1, len(w) - len + 2)) as i from d, lens)),
m as (select distinct rid, item, i, len from dw join iw using (len, win)),
hit as (select rid, count(distinct p) as n from (select rid, unnest(range(i, i + len)) as p from m) group by rid),
it as (select rid, count(*) as n, string_agg(item, ',' order by item) as ids from (select distinct rid, item from m) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(hit.n, 0)::bigint as n_hit, coalesce(it.n, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(hit.n, 0) > 0 as contaminated
from d left join hit using (rid) left join it using (rid)"""

_QUERIES = {
    "op1_quality_classifier": (op1_quality_classifier, None),
    "op2_secret_scan": (op2_secret_scan, None),
    "op6_lm_scoring": (op6_lm_scoring, OP6_SQL),
    "op7_url_filter": (op7_url_filter, None),
    "op8_toxicity": (op8_toxicity, None),
    "op3_sharding": (op3_sharding, OP3_SQL),
    "op4_mixing": (op4_mixing, None),
    "op4_source_targets": (op4_source_targets, OP4_TARGETS_SQL),
    "op7_url_rules": (op7_url_rules, OP7_RULES_SQL),
    "op5_jaccard_join": (op5_jaccard_join, OP5_SQL),
    "op9_quality_rules": (op9_quality_rules, OP9_SQL),
    "op10_decontaminate": (op10_decontaminate, OP10_SQL),
    "op10_proximity": (op10_proximity, None),
}


def queries():
    return {name: run for name, (run, _) in _QUERIES.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}
