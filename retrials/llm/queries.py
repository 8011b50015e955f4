"""The operators of this subpackage bound to the given tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retrials.llm import chat_format, decontaminate, fill_in_middle, html_text, license_scan, mixing, near_duplicates, quality_rules, repeated_passages, rule_ensemble, suffix_array, token_alignment, toxicity
from retrials.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
BLANK = r"regexp_replace({}, '[\x20\x09-\x0D]', '', 'g')"

OP1 = rf"""
with d as (select doc_id, source, text, row_number() over () as rid from documents),
w as (select *, {WORDS} as words, string_split(coalesce(text, ''), chr(10)) as split from d),
lined as (select *, list_filter(split, lambda x: length({BLANK.format('x')}) > 0) as lines from w),
win as (select rid, i, array_to_string(words[i:i+7], ' ') as x from (select rid, words, unnest(range(1, len(words) - 6)) as i from lined)),
twice as (select rid, i from (select rid, i, count(*) over (partition by rid, x) as n from win) where n > 1),
rep as (select rid, count(distinct i + j) as n from twice, range(8) t(j) group by rid),
l1 as (select doc_id, source, text, rid, unnest(lines) as raw from lined),
l2 as (select *, trim(regexp_replace(regexp_replace(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
   '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') as line, len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')) as nw from l1),
l4 as (select rid, any_value(source) as source, any_value(text) as text, line, sum(nw) as nw from l2 group by rid, line),
common as (select source, line from l4 group by source, line having count(distinct text) > 10),
gone as (select rid, sum(nw) as gone from l4 join common c on l4.line = c.line and l4.source is not distinct from c.source group by rid),
s as (select doc_id, len(words)::bigint as n_words, length({BLANK.format("coalesce(text, '')")})::bigint as word_chars,
   (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
   (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words, coalesce(gone, 0) as gone
   from lined left join rep using (rid) left join gone using (rid)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
   not base_failed and n_words - gone >= 0.3 * n_words as kept from b
"""


@query(OP1)
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP7 = r"""
with s as (select doc_id, source, coalesce(text, '') as t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
k as (select doc_id, source, size, -ln((('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || ':17'), 1, 13))::bigint + 0.5::double) / 4503599627370496::double)
   / (1::double / (1::double + 4::double * (length(t) - length(regexp_replace(t, '[#*$%&|<>!]', '', 'g'))) / greatest(size, 1))) as key from s),
src as (select source, sum(size)::bigint as source_size from k group by source),
wt as (select *, [3, 1, 2][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight, sum(source_size) over () as total from src),
fl as (select *, 2 * source_size * (6 // weight) as fills from wt),
lv as (select *, coalesce(sum(2 * source_size) over (order by fills, source nulls last rows between unbounded preceding and 1 preceding), 0) as full_,
   sum(weight) over (order by fills, source nulls last rows between current row and unbounded following) as open_,
   row_number() over (order by fills, source nulls last) as n from fl),
fo as (select *, min(case when 200 * source_size * open_ >= weight * (150 * total - 100 * full_) then n end) over () as first_open from lv),
tg as (select source, source_size, case when first_open is null or n < first_open then (2 * source_size)::double else
   (weight * (150 * total - 100 * (select full_ from fo f where f.n = f.first_open)))::bigint::double
   / (100 * (select open_ from fo f where f.n = f.first_open))::bigint::double end as target from fo),
ep as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from tg),
j as (select k.*, source_size, target, epochs, floor(target)::bigint - epochs * source_size as rest,
   coalesce(sum(k.size) over (partition by k.source order by key, doc_id, k.size rows between unbounded preceding and 1 preceding), 0) as before
   from k join ep on k.source is not distinct from ep.source)
select doc_id, size, source_size, target, (epochs * size + greatest(least(rest - before, size), 0))::bigint as taken from j
"""


@query(OP7)
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP8 = """
with c as (select conv_id, turn, role, coalesce(text, '') as text from conversations union all
   select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;') as esc from c)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, esc)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, esc) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(role) + length(esc) + 24)::bigint as formatted_chars
from e group by conv_id
"""


@query(OP8)
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    part = F.struct(F.lit("text").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"),
                    F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"))
    out = chat_format.format_chat(given.unionByName(probe).withColumn("parts", F.array(part)))
    out = out.withColumn("turns", chat_format.read_back(F.col("formatted"))).withColumn("learnt", chat_format.learnt_text(F.col("formatted"), F.col("loss_spans")))
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


@query()
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query()
def op4_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


@query()
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op6_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), k=2).select("doc_id", "n_shingles", "component_id", "kept", "n_links")


OP2 = rf"""
with d as (select doc_id, {WORDS} as words, row_number() over () as rid from documents),
win as (select rid, coalesce(doc_id, 9223372036854775807) as id, i, array_to_string(words[i:i+12], ' ') as x from (select *, unnest(range(1, len(words) - 11)) as i from d)),
gone as (select distinct rid, i + j as w from (select rid, i from (select *, min(id) over (partition by x) as least from win) where id > least), range(13) t(j)),
marks as (select rid, list(w) as ws from gone group by rid),
k as (select doc_id, words, coalesce(ws, []) as ws from d left join marks using (rid))
select doc_id, len(words)::bigint as n_words, len(ws)::bigint as n_removed,
  sha256(array_to_string(list_filter(words, lambda w, i: not list_contains(ws, i)), ' ')) as kept_sha256 from k
"""


@query(OP2)
def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_passages.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query()
def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the contract's strings have 400 bytes; passages of some fifty words are shorter, so the text without those follows
    out = suffix_array.remove_repeated_bytes(table(spark, sf_dir, "documents"), passages=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.col("left_text").alias("text"))


@query()
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = token_alignment.align(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query()
def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


OP13 = """
with d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, ''))::bigint as n, sha256('1:' || coalesce(doc_id::varchar, 'null')) as h from documents),
h as (select *, ('0x' || h[1:8])::bigint % (n + 1) as c1, ('0x' || h[9:16])::bigint % (n + 1) as c2, ('0x' || h[17:24])::bigint % 100 as whole, ('0x' || h[25:32])::bigint % 100 as turned from d),
f as (select *, least(c1, c2) as a, greatest(c1, c2) as b, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or whole >= 90 then 'plain'
   when turned < 20 then 'spm' else 'psm' end as form from h),
p as (select *, substring(t, 1, a) as prefix, substring(t, a + 1, b - a) as middle, substring(t, b + 1) as suffix from f)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(t) as restored_sha256 from p
"""


@query(OP13)
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(fill_in_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
