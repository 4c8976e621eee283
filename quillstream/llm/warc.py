"""Not-modified revisit resolution for web archives (operator 8).

A revisit record says that a page hasn't changed; what it stands for is the latest earlier full
response of the same canonical URL. The as-of join is a window in two steps, so that a URL with very
many records isn't one task: time is cut into ranges of about equal numbers of records, each range
of a URL finds its own last response, those are carried on from range to range (one row for each), and
a record without an earlier response in its own range takes the carried one.

Then the validators are checked (entity tags by weak comparison, or else modification dates), and
the headers that a not-modified answer may update replace those of the response.

Defined results: outcome is `resolved`, `unvalidated` (neither side's validators can be compared: the
response stands with its own headers, none is merged), `mismatch`, `no_prior`, or `no_url` for a record without a URL.
Responses of the same second are not earlier, and records without a time never match. Of repeated responses the one with
the greatest record_id counts; repeated revisits each have a row. Records with a null record_id count like others. Null
headers count as none, texts of any length are kept whole. Further columns are ignored, whatever their names. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import bounds_of, range_of

#: Headers that a not-modified answer may update (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that name no content.
TRACKING = "^(utm_[a-z]+|gclid|fbclid|ref)="
RANGES, RANGE_ROWS, MOST_RANGES = 64, 1 << 17, 1 << 13


def canonical_url(url: Column) -> Column:
    """host (lower case, without `www.` and default port) + path without closing slashes + the query's
    parameters, tracking ones dropped, sorted. Scheme and fragment don't count. Null for null."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    head = F.regexp_extract(bare, r"^([^?]*)", 1)
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(head, "^([^/]*)", 1)), "^www[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(head, "^[^/]*(.*)$", 1), "/+$", "")
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def _opaque(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def merged_headers(response: Column, revisit: Column) -> Column:
    """The response's headers (names in lower case), permitted ones replaced by the revisit's."""
    none = F.create_map().cast("map<string,string>")
    update = F.map_filter(F.coalesce(revisit, none), lambda k, _: k.isin(*PERMITTED))
    return F.map_concat(F.map_filter(F.coalesce(response, none), lambda k, _: ~F.array_contains(F.map_keys(update), k)), update)


def headers_text(headers: Column) -> Column:
    """`name: value` lines in the order of names."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), "\n")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """records: record_id, warc_type (`response` or `revisit`), url, ts (seconds), etag, last_modified,
    headers (map). One row for each revisit: record_id, canonical_url, outcome, response_id, headers
    (merged if resolved, the response's own if unvalidated, else null). Further columns are ignored."""
    r = records.select("record_id", "ts", "warc_type", "etag", "last_modified", "headers", canonical_url(F.col("url")).alias("key"))
    found = r.where("ts is not null").agg(F.count("*").alias("n")).first().n
    n = min(MOST_RANGES, max(RANGES, -(-found // RANGE_ROWS)))
    r = r.withColumn("range", range_of(F.col("ts"), bounds_of(r, "ts", n)))

    is_response = F.col("warc_type") == "response"
    response = F.struct("record_id", "etag", "last_modified", "headers")
    urls = r.where("key is not null and ts is not null")
    last = urls.groupBy("key", "range").agg(F.max_by(F.when(is_response, response), F.when(is_response, F.struct("ts", "record_id"))).alias("last"))
    before = W.Window.partitionBy("key").orderBy("range").rowsBetween(W.Window.unboundedPreceding, -1)
    carried = last.select("key", "range", F.last("last", ignorenulls=True).over(before).alias("carried"))
    # Revisits stand before responses of the same second.
    earlier = W.Window.partitionBy("key", "range").orderBy("ts", F.col("warc_type").eqNullSafe("response"), "record_id").rowsBetween(W.Window.unboundedPreceding, -1)
    near = urls.withColumn("near", F.last(F.when(is_response, response), ignorenulls=True).over(earlier)).where("warc_type = 'revisit'")
    joined = near.join(carried, ["key", "range"]).withColumn("prior", F.coalesce("near", "carried")).drop("near", "carried")
    lost = r.where("(key is null or ts is null) and warc_type = 'revisit'").withColumn("prior", F.lit(None).cast(joined.schema["prior"].dataType))
    x = joined.unionByName(lost)
    tags = F.col("etag").isNotNull() & F.col("prior.etag").isNotNull()
    dates = F.col("last_modified").isNotNull() & F.col("prior.last_modified").isNotNull()
    same = F.when(tags, _opaque(F.col("etag")) == _opaque(F.col("prior.etag"))).when(dates, F.col("last_modified") == F.col("prior.last_modified"))
    outcome = F.when(F.col("key").isNull(), "no_url").when(F.col("prior").isNull(), "no_prior").when(same.isNull(), "unvalidated").when(same, "resolved").otherwise("mismatch")
    x = x.withColumn("outcome", outcome)
    nothing = F.create_map().cast("map<string,string>")
    update = F.when(F.col("outcome") == "resolved", F.col("headers")).otherwise(nothing)
    merged = F.when(F.col("outcome").isin("resolved", "unvalidated"), merged_headers(F.col("prior.headers"), update))
    return x.select("record_id", F.col("key").alias("canonical_url"), "outcome", F.col("prior.record_id").alias("response_id"), merged.alias("headers"))


def crawl_records(pages: DataFrame) -> DataFrame:
    """A crawl made of a table of pages: each page is a full response, revisited an hour later and, where
    its id is even, half a minute before. Some validators are weak, stale or missing. A page without an id gives records
    without id and time."""
    i, digest = F.col("page_id"), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 8)
    quoted = F.concat(F.lit('"'), digest, F.lit('"'))
    modified = F.when(i % 4 != 0, F.concat(F.lit("day-"), F.floor(i / 3).cast("string")))
    tag = F.when(i % 5 != 0, quoted)
    again = F.when(i % 5 != 0, F.when(i % 7 == 0, F.lit('"stale"')).when(i % 3 == 0, F.concat(F.lit("W/"), quoted)).otherwise(quoted))
    modified_again = F.when(i % 11 == 0, F.lit("day-x")).otherwise(modified)
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")

    def record(number: int, kind: str, ts: Column, etag: Column, last_modified: Column, headers: Column) -> Column:
        return F.struct((4 * i + number).alias("record_id"), F.lit(kind).alias("warc_type"), ts.cast("long").alias("ts"), etag.alias("etag"), last_modified.alias("last_modified"), headers.alias("headers"))

    full = F.create_map(F.lit("content-length"), size, F.lit("content-type"), F.lit("text/html"), F.lit("date"), (i * 60).cast("string"), F.lit("x-cache"), F.lit("MISS"))
    answer = lambda ts: F.create_map(F.lit("cache-control"), F.concat(F.lit("max-age="), (i % 10).cast("string")), F.lit("content-length"), F.lit("0"), F.lit("date"), ts.cast("string"))
    late, early = i * 60 + 3600, i * 60 - 30
    rows = F.array(
        record(0, "response", i * 60, tag, modified, full),
        record(1, "revisit", late, again, modified_again, answer(late)),
        F.when(i % 2 == 0, record(2, "revisit", early, again, modified_again, answer(early))),
    )
    return pages.select("url", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("r")).select("url", "r.*")


def resolved_pages(pages: DataFrame) -> DataFrame:
    """The resolved revisits of crawl_records, headers as text."""
    x = resolve_revisits(crawl_records(pages))
    return x.select("record_id", "canonical_url", "outcome", "response_id", headers_text(F.col("headers")).alias("headers"))


#: The same for DuckDB, as an as-of join.
SQL = r"""
with p as (
  select page_id as i, url, substr(md5(coalesce(html, '')), 1, 8) as digest, strlen(coalesce(html, '')) as size
  from pages
), u as (
  select *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as bare from p
), parts as (
  select *, regexp_extract(bare, '^([^?]*)', 1) as head, regexp_extract(bare, '\?(.*)$', 1) as query from u
), c as (
  select *,
    regexp_replace(regexp_replace(lower(regexp_extract(head, '^([^/]*)', 1)), '^www[.]', ''), ':(80|443)$', '')
      || regexp_replace(regexp_extract(head, '^[^/]*(.*)$', 1), '/+$', '') as place,
    array_to_string(list_sort(list_filter(string_split(query, '&'),
      lambda x: x <> '' and not regexp_matches(x, '^(utm_[a-z]+|gclid|fbclid|ref)='))), '&') as kept
  from parts
), k as (
  select *, case when url is null then null else place || case when coalesce(kept, '') <> '' then '?' || kept else '' end end as key,
    case when i % 5 <> 0 then '"' || digest || '"' end as etag,
    case when i % 4 <> 0 then 'day-' || cast(i // 3 as varchar) end as modified,
    case when i % 5 <> 0 then case when i % 7 = 0 then '"stale"' else '"' || digest || '"' end end as again
  from c
), responses as (
  select 4 * i as response_id, key as r_key, i * 60 as r_ts, etag as r_etag, modified as r_modified, size as r_size from k where i is not null
), revisits as (
  select 4 * i + 1 as record_id, key, i * 60 + 3600 as ts, again, case when i % 11 = 0 then 'day-x' else modified end as modified, i from k
  union all
  select 4 * i + 2, key, i * 60 - 30, again, case when i % 11 = 0 then 'day-x' else modified end, i from k where i % 2 = 0
), j as (
  select *,
    case when again is not null and r_etag is not null then again = r_etag
         when modified is not null and r_modified is not null then modified = r_modified end as same
  from revisits asof left join responses on r_key = key and r_ts < ts
), o as (
  select *, case when key is null then 'no_url' when response_id is null then 'no_prior' when same is null then 'unvalidated'
                 when same then 'resolved' else 'mismatch' end as outcome
  from j
)
select record_id, key as canonical_url, outcome, response_id,
  case when outcome in ('resolved', 'unvalidated') then
    case when outcome = 'resolved' then 'cache-control: max-age=' || cast(i % 10 as varchar) || chr(10) else '' end
    || 'content-length: ' || cast(r_size as varchar) || chr(10) || 'content-type: text/html' || chr(10)
    || 'date: ' || cast(case when outcome = 'resolved' then ts else r_ts end as varchar) || chr(10) || 'x-cache: MISS' end as headers
from o
"""
