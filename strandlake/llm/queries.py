"""Registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, htmltext, minhash, phrases, quality, sharding, suffix, tokencount, warc
from .common import table


def vocabulary_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=2)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = htmltext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrases.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), digests=True)
    return found.select("row.doc_id", "n_words", "n_removed", "kept_sha256")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.json"), digests=True)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.assign(table(spark, sf_dir, "documents"), "doc_id", "text", [1.0] * 16)
    return rows.select(F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("row.doc_id", *quality.BASE, "base_failed", "kept")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archive(spark, warc.archive(table(spark, sf_dir, "pages")))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), digests=True)
    return found.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), vocabulary_file("piece_bpe_32k.model"))


QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_html_extraction": op2_html_extraction,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_bpe": op4_bpe,
    "op5_decontamination": op5_decontamination,
    "op6_sharding": op6_sharding,
    "op7_quality_rules": op7_quality_rules,
    "op8_warc": op8_warc,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_token_counts": op10_token_counts,
}

SQL = {
    "op1_minhash_dedup": r"""
with recursive d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') words from documents),
s as (select distinct doc_id, case when len(words) < 2 then array_to_string(words, ' ') else words[i] || ' ' || words[i + 1] end sh
  from (select doc_id, words, unnest(range(1, greatest(len(words), 2))) i from d where len(words) > 0)),
n as (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
r as (select doc_id, doc_id other from d union select r.doc_id, l.b from r join l on r.other = l.a),
m as (select doc_id, min(other) component_id from r group by doc_id)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) n_shingles, m.component_id, d.doc_id = m.component_id as kept
from d left join n on d.doc_id = n.doc_id join m on d.doc_id = m.doc_id
""",
    "op3_substring_dedup": r"""
with d as (select row_number() over () rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') words from documents),
w as (select rid, doc_id, i, array_to_string(words[i : i + 12], ' ') win from (select rid, doc_id, words, unnest(range(1, len(words) - 11)) i from d where len(words) >= 13)),
f as (select win, min(doc_id) first from w group by win having count(*) > 1),
h as (select rid, i from w join f on w.win = f.win where f.first < w.doc_id),
g as (select distinct rid, unnest(range(i, i + 13)) j from h),
k as (select d.rid, string_agg(x, ' ' order by j) s, count(*) n from (select rid, unnest(words) x, unnest(range(1, len(words) + 1)) j from d) d left join g using (rid, j) where g.rid is null group by d.rid)
select doc_id, cast(len(words) as bigint) n_words, cast(len(words) - coalesce(k.n, 0) as bigint) n_removed, sha256(coalesce(k.s, '')) kept_sha256
from d left join k on d.rid = k.rid
""",
    "op5_decontamination": r"""
with d as (select row_number() over () rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') words from documents),
b as (select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') words from benchmark),
bs as (select item_id, words, least(13, len(words)) size from b where len(words) > 0),
bw as (select distinct item_id, size, array_to_string(words[i : i + size - 1], ' ') win from (select item_id, words, size, unnest(range(1, len(words) - size + 2)) i from bs)),
dw as (select rid, i, size, array_to_string(words[i : i + size - 1], ' ') win from (select rid, words, size, unnest(range(1, len(words) - size + 2)) i from d, (select distinct size from bs) where len(words) >= size)),
h as (select rid, i, dw.size, item_id from dw join bw on dw.size = bw.size and dw.win = bw.win),
n as (select rid, count(distinct j) n from (select rid, unnest(range(i, i + size)) j from h) group by rid),
t as (select rid, count(*) n, string_agg(item_id, ',' order by item_id) s from (select distinct rid, cast(item_id as varchar) item_id from h) group by rid)
select doc_id, cast(len(words) as bigint) n_words, cast(coalesce(n.n, 0) as bigint) n_hit, cast(coalesce(t.n, 0) as bigint) n_items, sha256(coalesce(t.s, '')) items_sha256,
  coalesce(n.n, 0) > 0 and 20 * coalesce(n.n, 0) >= len(words) as contaminated
from d left join n on d.rid = n.rid left join t on d.rid = t.rid
""",
    "op9_suffix_array_dedup": r"""
with d as (select row_number() over () rid, doc_id, hex(encode(coalesce(text, ''))) h from documents),
w as (select rid, doc_id, i, substr(h, 2 * i + 1, 200) win from (select rid, doc_id, h, unnest(range(0, length(h) // 2 - 99)) i from d where length(h) >= 200)),
f as (select win, min((doc_id, i)) first from w group by win having count(*) > 1),
g as (select rid, i from w join f using (win) where (doc_id, i) > first),
m as (select rid, i, i - lag(i, 1, -1000) over (partition by rid order by i) > 100 as fresh from g),
s as (select rid, i, sum(cast(fresh as int)) over (partition by rid order by i) span from m),
r as (select rid, span, min(i) a, max(i) + 100 b from s group by rid, span),
t as (select rid, count(*) n_spans, sum(b - a) n_removed, list((a, b) order by a) spans from r group by rid)
select d.doc_id, cast(length(h) // 2 as bigint) n_bytes, cast(coalesce(n_removed, 0) as bigint) n_removed, cast(coalesce(n_spans, 0) as bigint) n_spans,
  sha256(unhex(case when spans is null then h else array_to_string(list_transform(range(0, len(spans) + 1), lambda k: substr(h, case when k = 0 then 1 else 2 * spans[k][2] + 1 end, case when k = len(spans) then length(h) else 2 * spans[k + 1][1] end - case when k = 0 then 0 else 2 * spans[k][2] end)), '') end)) kept_sha256
from d left join t using (rid)
""",
    "op8_warc": r"""
with q as (select page_id, strlen(coalesce(html, '')) n, sha1(coalesce(html, '')) s from pages),
f as (select s, n, min(page_id) least_id from q group by s, n),
j as (select q.*, least_id, least_id is not null and least_id is distinct from page_id as again from q join f using (s, n))
select page_id, cast(n as bigint) payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda c: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || substr(s, cast(c // 4 * 5 + 1 as bigint), 5) as bigint) >> (15 - 5 * (c % 4))) & 31 as bigint) + 1, 1)), '') payload_digest,
  case when again then 'revisit' else 'response' end record_type, case when again then least_id end refers_to
from j
""",
    "op7_quality_rules": r"""
with t as (
  select row_number() over () rid, doc_id, coalesce(text, '') body from documents),
w as (
  select rid, doc_id, body, list_filter(string_split_regex(body, '[\x20\x09-\x0D]+'), lambda x: x <> '') words,
    list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) lns from t),
g as (
  select rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] gram
  from (select rid, words, unnest(range(1, len(words) - 1)) i from w where len(words) >= 3)),
c as (select rid, i, count(*) over (partition by rid, gram) n from g),
r as (select rid, count(distinct j) n from (select rid, unnest([i, i + 1, i + 2]) j from c where n > 1) group by rid),
m as (
  select w.rid, doc_id, cast(len(words) as bigint) n_words, cast(length(array_to_string(words, '')) as bigint) word_chars,
    cast(length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) as bigint) n_symbols,
    cast(length(body) - length(regexp_replace(body, '[0-9]', '', 'g')) as bigint) n_digits,
    cast(length(body) - length(regexp_replace(body, '[!?]', '', 'g')) as bigint) n_marks,
    cast(len(lns) as bigint) n_lines, cast(len(lns) - len(list_distinct(lns)) as bigint) n_dup_lines,
    cast(coalesce(r.n, 0) as bigint) n_repeat_words
  from w left join r on w.rid = r.rid),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and 10 * n_symbols <= n_words and 2 * n_dup_lines <= n_lines and 5 * n_repeat_words <= 2 * n_words
    and word_chars between 2 * n_words and 20 * n_words and 10 * n_digits <= 3 * word_chars and 2 * n_marks <= n_words as kept from b
""",
}
