"""Revisit records (304 Not Modified) of a crawl, resolved to the response that they confirm.

An as-of join: for each revisit the latest earlier full response of the same canonical URL, by
``running_last``, which cuts a URL with many captures into time-sorted parts. Validators decide
whether that response is the one confirmed; the headers that a 304 may update replace its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.operators.running import running_last

# Header fields that a 304 response doesn't change in a stored response.
KEPT = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authentication-info", "proxy-authorization", "proxy-connection", "set-cookie", "te", "trailer", "transfer-encoding", "upgrade",
)
DEFAULT_PORTS = r":(80|443)$"
HOST_PREFIX = r"^(www|m)[0-9]*\."

RECORD = "record_id long, type string, url string, ts long, status int, headers map<string,string>, digest string"


def canonical(url: Column) -> Column:
    """One spelling of a URL: no scheme, user, default port, www or fragment; lower-case host; sorted query; no last slash.

    Null where there is no ``://`` or no host.
    """
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^#]*)", 1)
    host = F.lower(F.regexp_extract(rest, r"^(?:[^/?@]*@)?([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, DEFAULT_PORTS, ""), HOST_PREFIX, "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    pairs = F.array_sort(F.filter(F.split(query, "&"), lambda p: p != ""))
    return F.when(host != "", F.concat(host, path, F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise("")))


def lowered(headers: Column) -> Column:
    """Header fields under lower-case names; of names that differ in case only the last in order of spelling counts."""
    entries = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    kept = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: F.lower(later["key"]) == F.lower(e["key"])))
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(F.lower(e["key"]), F.trim(e["value"]))))


def _strong(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), r"^W/", "")


def merged(stored: Column, update: Column) -> Column:
    """Stored headers with those of a 304 that may update them, sorted by name."""
    allowed = F.map_filter(update, lambda k, v: ~k.isin(*KEPT) & v.isNotNull())
    rest = F.map_filter(stored, lambda k, v: ~F.map_contains_key(allowed, k))
    return F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(rest, allowed))))


def resolve(records: DataFrame) -> DataFrame:
    """Every revisit among ``records`` (record_id, type, url, ts, status, headers, digest) with what it confirms.

    Columns: ``record_id, url_key, ts, outcome, response_id, response_ts, digest, headers``. The
    response is the latest with a status of 200 and an earlier ts under the same canonical URL;
    of several at one ts the one with the highest record_id. Outcomes:

    - ``no_url``: the URL is null or has no host; ``no_time``: ts is null;
    - ``no_response``: there is no earlier full response;
    - ``etag_differs``, ``date_differs``: the revisit names an ETag (compared weakly) or, without
      one, a Last-Modified other than the response's; a validator that the response lacks counts
      as other;
    - ``digest_differs``: no validators, and both name a payload digest, but not the same;
    - ``resolved``: the rest; only these have response_id, response_ts, digest and headers.

    Rows of other types and responses of other statuses are no candidates. Null headers are none.
    Repeated revisits are each resolved. Other columns are not looked at; no rows give no rows.
    """
    rows = records.select("record_id", "type", canonical(F.col("url")).alias("url_key"), "ts", "status", lowered(F.col("headers")).alias("own"), F.col("digest").alias("own_digest"))
    revisits = F.col("type") == "revisit"
    usable = rows.where(F.col("url_key").isNotNull() & F.col("ts").isNotNull() & (revisits | ((F.col("type") == "response") & (F.col("status") == 200))))
    full = F.struct("record_id", F.col("ts").alias("ts"), F.col("own").alias("headers"), F.col("own_digest").alias("digest"))
    order = [F.col("ts"), (~revisits).cast("int"), F.col("record_id").asc_nulls_first()]  # at one ts revisits come first: a response must be earlier
    latest = running_last(usable.withColumn("_turn", (~revisits).cast("int")), ["url_key"], order, F.when(~revisits, full), "_found").where(revisits)
    odd = rows.where(revisits & (F.col("url_key").isNull() | F.col("ts").isNull())).withColumn("_found", F.lit(None).cast(latest.schema["_found"].dataType))
    both = latest.drop("_turn").unionByName(odd)
    theirs = F.col("_found")
    tag, date = F.get(F.array(F.col("own")["etag"]), 0), F.col("own")["last-modified"]
    outcome = (
        F.when(F.col("url_key").isNull(), "no_url").when(F.col("ts").isNull(), "no_time").when(theirs.isNull(), "no_response")
        .when(tag.isNotNull() & ~_strong(tag).eqNullSafe(_strong(theirs["headers"]["etag"])), "etag_differs")
        .when(tag.isNull() & date.isNotNull() & ~date.eqNullSafe(theirs["headers"]["last-modified"]), "date_differs")
        .when(tag.isNull() & date.isNull() & (F.col("own_digest") != theirs["digest"]), "digest_differs").otherwise("resolved")
    )
    decided = both.withColumn("outcome", outcome)
    good = lambda c: F.when(F.col("outcome") == "resolved", c)
    return decided.select(
        "record_id", "url_key", "ts", "outcome", good(theirs["record_id"]).alias("response_id"), good(theirs["ts"]).alias("response_ts"),
        good(theirs["digest"]).alias("digest"), good(merged(theirs["headers"], F.col("own"))).alias("headers"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """A crawl made of ``pages`` (page_id, url, html): each page's full response and three later or earlier visits.

    Records of page p have the numbers 8p to 8p + 3: the response at ts 10p + 5, one revisit
    before it at 10p, one soon after it by another spelling of the URL with the page's ETag, and
    one that differs by page: a weak tag, another tag, only a date, only a digest.
    """
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit("")).cast("binary")), 1, 12), F.lit('"'))
    date = F.concat(F.lit("day "), F.col("page_id") % 28)
    sha = F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)
    size = F.char_length(F.coalesce("html", F.lit(""))).cast("string")
    other = F.regexp_replace(F.regexp_replace("url", "^https?://(www\\.)?", "https://www."), "$", "#seen")
    kind = F.col("page_id") % 5
    text = lambda x: F.lit(x)
    fields = lambda *kv: F.create_map(*kv).cast("map<string,string>")
    last_tag = F.when(kind == 0, F.concat(F.lit("W/"), tag)).when(kind == 1, F.lit('"other"'))
    last = F.map_filter(fields(text("ETag"), last_tag, text("Last-Modified"), F.when(kind == 2, date).when(kind == 3, "never"), text("Age"), F.col("page_id").cast("string")), lambda k, v: v.isNotNull())
    record = lambda n, kind, url, ts, status, headers, digest: F.struct(
        (F.col("page_id") * 8 + n).alias("record_id"), F.lit(kind).alias("type"), url.alias("url"), (F.col("page_id") * 10 + ts).alias("ts"), F.lit(status).alias("status"), headers.alias("headers"), digest.alias("digest"))
    first = fields(text("ETag"), tag, text("Last-Modified"), date, text("Content-Type"), text("text/html"), text("Content-Length"), size, text("Server"), text("one"))
    again = fields(text("etag"), tag, text("Content-Type"), text("none"), text("Server"), text("two"), text("Expires"), date)
    none = F.lit(None).cast("string")
    rows = F.array(
        record(0, "response", F.col("url"), 5, 200, first, sha),
        record(1, "revisit", F.col("url"), 0, 304, again, none),
        record(2, "revisit", other, 7, 304, again, none),
        record(3, "revisit", F.col("url"), 9, 304, last, F.when(F.col("page_id") % 2 == 0, sha).otherwise(none)),
    )
    return pages.select(F.explode(rows).alias("r")).select("r.*")


def listed(resolved: DataFrame) -> DataFrame:
    """``resolve`` with headers as text: name=value, sorted, joined by semicolons."""
    entries = F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return resolved.withColumn("headers", F.array_join(entries, "; "))


_KEPT = ", ".join(f"'{k}'" for k in KEPT)
#: The same in DuckDB's SQL, over the same captures.
ORACLE = rf"""
with page as (
  select page_id, url, '"' || substr(md5(coalesce(html, '')), 1, 12) || '"' as tag, 'day ' || (page_id % 28) as day, sha256(coalesce(html, '')) as sha,
         length(coalesce(html, ''))::varchar as size, page_id % 5 as kind,
         regexp_replace(url, '^https?://(www\.)?', 'https://www.') || '#seen' as other
  from pages),
responses as (select page_id * 8 as response_id, url, page_id * 10 + 5 as response_ts, tag, day, sha, size from page),
revisits as (
  select page_id * 8 + 1 as record_id, url, page_id * 10 as ts, tag as etag, null as date, null as own_digest, ['expires=' || day, 'server=two'] as new, ['expires', 'server', 'etag'] as names from page
  union all
  select page_id * 8 + 2, other, page_id * 10 + 7, tag, null, null, ['expires=' || day, 'server=two'], ['expires', 'server', 'etag'] from page
  union all
  select page_id * 8 + 3, url, page_id * 10 + 9, case kind when 0 then 'W/' || tag when 1 then '"other"' end, case kind when 2 then day when 3 then 'never' end,
         case when page_id % 2 = 0 then sha end, ['age=' || page_id], ['age', case when kind in (0, 1) then 'etag' end, case when kind in (2, 3) then 'last-modified' end] from page),
keyed as (
  select *, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^#]*)', 1) as rest from (
    select record_id, null as response_id, url, ts, etag, date, own_digest, new, names, null as tag, null as day, null as sha, null as size from revisits
    union all
    select null, response_id, url, response_ts, null, null, null, null, null, tag, day, sha, size from responses)),
canon as (
  select *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^(?:[^/?@]*@)?([^/?]*)', 1)), ':(80|443)$', ''), '^(www|m)[0-9]*\.', '') as host,
         regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') as path,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda p: p <> '')), '&') as query
  from keyed),
named as (select *, case when host <> '' then host || path || case when query <> '' then '?' || query else '' end end as url_key from canon),
found as (
  select v.*, r.response_id as rid, r.ts as rts, r.tag as rtag, r.day as rday, r.sha as rsha, r.size as rsize
  from (select * from named where record_id is not null) v
  left join lateral (
    select * from named r where r.response_id is not null and r.url_key = v.url_key and r.ts < v.ts order by r.ts desc, r.response_id desc limit 1) r on true),
decided as (
  select *, case when url_key is null then 'no_url' when ts is null then 'no_time' when rid is null then 'no_response'
    when etag is not null and replace(etag, 'W/', '') <> rtag then 'etag_differs'
    when etag is null and date is not null and date <> rday then 'date_differs'
    when etag is null and date is null and own_digest <> rsha then 'digest_differs' else 'resolved' end as outcome
  from found)
select record_id, url_key, ts, outcome, case when outcome = 'resolved' then rid end as response_id, case when outcome = 'resolved' then rts end as response_ts,
       case when outcome = 'resolved' then rsha end as digest,
       case when outcome = 'resolved' then array_to_string(list_sort(list_concat(new, list_filter([
         case when not list_contains(names, 'etag') then 'etag=' || rtag else 'etag=' || etag end,
         case when not list_contains(names, 'last-modified') then 'last-modified=' || rday else 'last-modified=' || date end,
         'content-type=text/html', 'content-length=' || rsize, case when not list_contains(names, 'server') then 'server=one' end], lambda x: x is not null))), '; ') end as headers
from decided
"""
