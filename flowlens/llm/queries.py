"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.decontamination import PositionalIndex
from flowlens.llm.jaccard import ngram_jaccard_join
from flowlens.llm.merkle import fingerprints
from flowlens.llm.mixing import Mix
from flowlens.llm.multiprobe import nearest_neighbours
from flowlens.llm.periodic import collapse_periodic_runs, with_planted_runs
from flowlens.llm.repeats import remove_repeats
from flowlens.llm.resampling import importance_resample
from flowlens.llm.revisits import TRACKING, resolve_revisits
from flowlens.llm.sharding import shard_documents
from flowlens.llm.spelling import count_words, spelling_variants
from flowlens.llm.surrogates import replace_personal_data
from flowlens.llm.tokenfiles import read_token_files, write_token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


OP1_SQL = r"""
with recursive words as (
 select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+') w from documents),
starts as (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) i from words where len(w) > 0),
shingles as (select distinct doc_id, array_to_string(w[i : i + 2], ' ') t from starts),
sizes as (select doc_id, count(*) n from shingles group by doc_id),
shared as (
 select a.doc_id a, b.doc_id b, count(*) n from shingles a join shingles b on a.t = b.t and a.doc_id < b.doc_id group by 1, 2),
links as (
 select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * shared.n >= 90 * (x.n + y.n - shared.n)),
edges as (select a, b from links union all select b, a from links),
reach as (select a, b from edges union select reach.a, edges.b from reach join edges on reach.b = edges.a),
roots as (select a, min(b) b from reach group by a),
degrees as (select a, count(*) n from edges group by a)
select documents.doc_id, coalesce(sizes.n, 0) n_shingles, least(documents.doc_id, coalesce(roots.b, documents.doc_id)) component_id,
 coalesce(degrees.n, 0) n_links
from documents left join sizes on sizes.doc_id = documents.doc_id left join roots on roots.a = documents.doc_id
 left join degrees on degrees.a = documents.doc_id
"""

OP9_SQL = r"""
with words as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
starts as (select doc_id, w, unnest(range(1, len(w) - 48)) i from words where len(w) >= 50),
runs as (select doc_id, i, array_to_string(w[i : i + 49], ' ') t from starts),
firsts as (select t, min(doc_id) d from runs group by t),
gone as (
 select distinct doc_id, unnest(range(i, i + 50)) j from (
  select runs.doc_id, i from runs join firsts on runs.t = firsts.t where firsts.d < runs.doc_id)),
spelled as (select doc_id, unnest(w) word, unnest(range(1, len(w) + 1)) j from words),
kept as (
 select spelled.doc_id, count(*) n_words, count(gone.j) n_removed, string_agg(word, ' ' order by spelled.j) filter (gone.j is null) t
 from spelled left join gone on gone.doc_id = spelled.doc_id and gone.j = spelled.j group by spelled.doc_id)
select documents.doc_id, coalesce(n_words, 0) n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(t, '')) kept_sha256
from documents left join kept on kept.doc_id = documents.doc_id
"""


@query("op1_ngram_jaccard_join", OP1_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_jaccard_join(documents(spark, folder), words=3, threshold=90).drop("text_key", "representative")


@query("op4_mix_sources")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return Mix(documents(spark, folder)).taken()


@query("op7_longest_first_shards")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    placed = shard_documents(documents(spark, folder), shards=40)
    return placed.select("*", F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard"))


@query("op8_merkle_fingerprints")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints(documents(spark, folder))


WORD_TOKENIZER, END_ID = "word_bpe_49k.json", 2


@query("op5_token_files")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    from public_tokenizers import path

    return read_token_files(write_token_files(documents(spark, folder), path(WORD_TOKENIZER), END_ID))


def clean_labels(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return labels.select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("target"))


@query("op10_importance_resampling")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return importance_resample(documents(spark, folder), clean_labels(spark, folder))


OP6_SQL = r"""
with words as (
 select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[0-9a-z\x{80}-\x{10FFFF}]+') w from documents),
tests as (
 select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[0-9a-z\x{80}-\x{10FFFF}]+') w from benchmark),
windows as (
 select distinct item_id, len(p) n, array_to_string(p, ' ') p from (
  select item_id, w[i : i + 9] p from (
   select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i from tests where len(w) > 0))),
sizes as (select distinct n from windows),
runs as (
 select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') p from (
  select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from words, sizes where len(w) >= n)),
found as (select doc_id, i, runs.n, item_id from runs join windows on runs.p = windows.p and runs.n = windows.n),
hits as (
 select doc_id, count(distinct j) n_hit from (
  select doc_id, unnest(range(i, i + n)) j from (select distinct doc_id, i, n from found)) group by doc_id),
items as (
 select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) ids from (
  select distinct doc_id, cast(item_id as varchar) item_id from found) group by doc_id)
select words.doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
 sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from words left join hits on words.doc_id = hits.doc_id left join items on words.doc_id = items.doc_id
"""


@query("op6_positional_decontamination", OP6_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    return PositionalIndex(documents(spark, folder), benchmark).report().drop("text_key")


@query("op9_fixed_block_repeats", OP9_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(documents(spark, folder), window=50).drop("spans")


@query("op2_pii_surrogates")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """The key is a secret of whoever runs the job; this one only serves the test tables."""
    return replace_personal_data(documents(spark, folder), key=b"key of the test tables")


# Archive records derived from ``pages``, in SQL that both engines read: one or two full responses per
# page, a later revisit under another spelling of the URL, and for some pages one before all responses.
RECORDS = """
 select page_id * 4 record_id, 'response' kind, url, 1700000000 + page_id * 61 as at_second, 200 as status,
  '"' || cast(page_id % 97 as varchar(20)) || '"' etag, 'day ' || cast(page_id % 5 as varchar(20)) modified,
  'max-age=60' control, 'text/html' content_type, cast(null as varchar(20)) content_length, 'first' answered, html body from pages
 union all
 select page_id * 4 + 1, 'response', url, 1700086400 + page_id * 61, 200,
  'W/"n' || cast(page_id % 89 as varchar(20)) || '"', 'day ' || cast(page_id % 5 as varchar(20)),
  'max-age=90', 'text/html', cast(null as varchar(20)), 'second', html || '<!-- 2 -->' from pages where page_id % 3 = 0
 union all
 select page_id * 4 + 2, 'revisit',
  case page_id % 4 when 0 then url || '#part' when 1 then replace(url, 'http://', 'HTTP://')
   when 2 then url || case when position('?' in url) > 0 then '&utm_source=mail' else '?utm_source=mail' end
   else replace(url, 'https://', 'http://www.') end, 1700172800 + page_id * 61, 304,
  case when page_id % 5 = 0 then null when page_id % 7 = 0 then '"other"'
   when page_id % 3 = 0 then '"n' || cast(page_id % 89 as varchar(20)) || '"' else '"' || cast(page_id % 97 as varchar(20)) || '"' end,
  case when page_id % 10 = 0 then null when page_id % 25 = 0 then 'day 9' else 'day ' || cast(page_id % 5 as varchar(20)) end,
  case when page_id % 2 = 0 then 'no-cache' end, 'text/plain', '0', 'third', cast(null as varchar(20)) from pages
 union all
 select page_id * 4 + 3, 'revisit', url, 1690000000 + page_id * 61, 304, '"' || cast(page_id % 97 as varchar(20)) || '"',
  cast(null as varchar(20)), cast(null as varchar(20)), cast(null as varchar(20)), '0', 'early', cast(null as varchar(20))
 from pages where page_id % 11 = 0
"""
HEADERS = {
    "Cache-Control": "control",
    "Content-Length": "content_length",
    "Content-Type": "content_type",
    "Date": "answered",
    "ETag": "etag",
    "Last-Modified": "modified",
}

OP3_SQL = rf"""
with records as ({RECORDS}),
split as (
 select *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^(?i:[a-z][a-z0-9+.-]*:)?//(?:[^/?@]*@)?', '') rest from records),
named as (
 select *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), ':(?:80|443)?$', ''), '^www\d?\.', '') host,
  regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') path,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
   lambda p : p <> '' and not regexp_matches(p, '^(?i:{TRACKING})(?:=|$)'))), '&') params from split),
keyed as (select *, host || path || case when params <> '' then '?' || params else '' end canonical_url from named),
earlier as (
 select r.record_id, max_by(s.record_id, s.at_second * 1000000000 + s.record_id) response_id
 from keyed r join keyed s on r.canonical_url = s.canonical_url and s.at_second < r.at_second
 where r.kind = 'revisit' and s.kind = 'response' group by r.record_id),
joined as (
 select r.*, e.response_id, s.etag s_etag, s.modified s_modified, s.control s_control, s.content_type s_type,
  s.content_length s_length, s.body s_body, regexp_replace(r.etag, '^W/', '') tag, regexp_replace(s.etag, '^W/', '') s_tag
 from keyed r left join earlier e on r.record_id = e.record_id left join keyed s on s.record_id = e.response_id
 where r.kind = 'revisit'),
judged as (
 select *, case when response_id is null then 'missing'
  when tag is not null and s_tag is not null then case when tag = s_tag then 'resolved' else 'changed' end
  when modified is not null and s_modified is not null then case when modified = s_modified then 'resolved' else 'changed' end
  else 'unconfirmed' end outcome from joined),
merged as (
 select *, outcome in ('resolved', 'unconfirmed') ok from judged)
select record_id, canonical_url, response_id, outcome,
 concat_ws('; ', 'cache-control: ' || case when ok then coalesce(control, s_control) else control end,
  'content-length: ' || case when ok then s_length else content_length end,
  'content-type: ' || case when ok then s_type else content_type end, 'date: ' || answered,
  'etag: ' || case when ok then coalesce(etag, s_etag) else etag end,
  'last-modified: ' || case when ok then coalesce(modified, s_modified) else modified end) headers,
 case when ok then md5(s_body) end body_md5
from merged
"""


@query("op3_revisit_resolution", OP3_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    rows = spark.sql(RECORDS.replace("from pages", "from {pages}"), pages=pages)
    pairs = [x for name, column in HEADERS.items() for x in (F.lit(name), F.col(column))]
    records = rows.select(
        "record_id",
        "kind",
        "url",
        F.timestamp_seconds("at_second").alias("at"),
        "status",
        F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()).alias("headers"),
        "body",
    )
    lines = F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return resolve_revisits(records).select(
        "record_id",
        "canonical_url",
        "response_id",
        "outcome",
        F.array_join(F.sort_array(lines), "; ").alias("headers"),
        F.md5(F.col("body").cast("binary")).alias("body_md5"),
    )


@query("op13_periodic_runs")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return collapse_periodic_runs(with_planted_runs(documents(spark, folder))).drop("runs")


# The checksum is spelled out: DuckDB has none. One row per distinct run of a document.
OP11_SQL = r"""
with recursive bits as (
 select i, i c, 0 k from (select cast(unnest(range(256)) as bigint) i)
 union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8),
steps as (select list(c order by i) t from bits where k = 8),
runs as (
 select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') w
 from documents),
distinct_runs as (select doc_id, w, count(*) n from runs group by doc_id, w),
spelled as (select *, hex(encode(doc_id || ':' || w)) x from distinct_runs),
summed as (
 select w, n, xor(4294967295, list_reduce(
  list_transform(range(length(x) // 2), lambda i : cast('0x' || substr(x, 2 * i + 1, 2) as bigint)),
  lambda a, b : xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295)) h from spelled, steps),
words as (
 select word, cast(sum(n) as bigint) n from (
  select case when h % 199 = 0 then left(w, h % length(w)) || substr(w, h % length(w) + 2) else w end word, n from summed)
 where length(word) >= 6 group by word having sum(n) >= 5),
holes as (
 select word, n, i, left(word, i) || substr(word, i + 2) hole from (select *, unnest(range(length(word))) i from words)),
near as (
 select distinct a.word, b.word other, b.n other_n from holes a join holes b on a.hole = b.hole and a.i = b.i and a.word <> b.word
 union select a.word, b.word, b.n from holes a join words b on a.hole = b.word
 union select b.word, a.word, a.n from holes a join words b on a.hole = b.word),
best as (
 select word, count(*) n_near, first(other order by other_n desc, other) other, max(other_n) other_n from near group by word),
judged as (
 select words.word, n, coalesce(n_near, 0) n_near, case when other_n >= 5 * n then other end form,
  case when other_n >= 5 * n then other_n end form_n from words left join best on words.word = best.word),
chains as (
 select word, word r, 0 k from judged
 union all select chains.word, form, k + 1 from chains join judged on chains.r = judged.word where form is not null)
select judged.word, n, form, ends.root, n_near, form_n
from judged join (select word, max_by(r, k) root from chains group by word) ends on ends.word = judged.word
"""


@query("op11_spelling_variants", OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(count_words(documents(spark, folder), slip_every=199))


@query("op12_multiprobe_neighbours")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_neighbours(spark.read.parquet(f"{folder}/embeddings.parquet"), k=20, query_modulus=20)
