"""WARC: resolving not-modified revisits against earlier full responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import bounds_of, bucket_of, table

#: Headers that a not-modified answer may renew in a stored response; all others stay.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "via", "warning")
#: Query parameters that do not name a page.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"
#: Time ranges, of about equal rows, that the as-of join is dealt to; a URL's captures are
#: ordered within each.
RANGES = 512
#: A page is asked for again after this many captures.
RECHECK = 1000


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default ports, path without a final slash, and
    the parameters that name a page, in order; scheme and fragment go. Null if there is no host."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]+)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]+([^?]*)", 1), "/+$", "")
    params = F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&")
    named = F.array_join(F.sort_array(F.filter(params, lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.when(host != "", F.concat(host, path, F.when(named != "", F.concat(F.lit("?"), named)).otherwise("")))


def merge_headers(stored: Column, fresh: Column) -> Column:
    """``stored`` with the permitted ones of ``fresh`` laid over it; names in lower case. A name
    that stands in several spellings keeps the value of the last one in order of its letters."""

    def low(m: Column) -> Column:
        entries = F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["key"].alias("as"), e["value"].alias("value"))))
        last = F.filter(entries, lambda e, i: ~F.coalesce(F.get(entries, i + 1)["key"] == e["key"], F.lit(False)))
        return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))

    none = F.create_map().cast("map<string,string>")
    allowed = F.map_filter(low(F.coalesce(fresh, none)), lambda k, _: k.isin(*PERMITTED))
    kept = F.map_filter(low(F.coalesce(stored, none)), lambda k, _: ~F.array_contains(F.map_keys(allowed), k))
    return F.map_concat(kept, allowed)


def resolve_revisits(records: DataFrame, ranges: int = RANGES) -> DataFrame:
    """As-of join of every revisit to the latest earlier full response of its canonical URL.

    ``records``: rec_id, url, ts (long), rec_type ('response' or 'revisit'), etag,
    last_modified, headers (map), digest and, if there is one, http_status: a response is full
    if that is 2xx or not known. Other columns, whatever their names, are ignored. Returns one row for each revisit: rec_id, url_key,
    ts, response_id, status, headers (merged), digest, etag. status is ``resolved`` when the
    revisit's validators (ETag, weak or strong, or else Last-Modified) are those of the
    response, ``mismatch`` when they differ or there is none to check, ``unresolved`` when no
    response is earlier. Earlier is strictly so; of responses at one time the largest rec_id
    counts. Null URLs or times stay unresolved; repeated rows keep their rows; other record
    types are passed over; empty tables give none.

    Captures are dealt to time ranges of about equal rows, by quantiles, so a URL with many
    captures, even in a burst, is ordered in many tasks; the last response of each range is
    handed on to later ranges.
    """
    code = F.col("http_status").try_cast("int") if "http_status" in records.columns else F.lit(None).cast("int")
    rows = records.select(
        F.col("rec_id").cast("long").alias("rec_id"), canonical_url(F.col("url")).alias("url_key"), F.col("ts").cast("long").alias("ts"), "rec_type",
        F.col("etag").cast("string").alias("etag"), F.col("last_modified").cast("string").alias("last_modified"), F.col("headers").cast("map<string,string>").alias("headers"), F.col("digest").cast("string").alias("digest"),
        F.coalesce(code.between(200, 299), F.lit(True)).alias("_ok"),
    ).filter(F.col("rec_type").isin("response", "revisit"))
    rows = rows.withColumn("_range", bucket_of(F.col("ts"), bounds_of(rows, "ts", ranges)))
    usable = F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    full = F.struct("ts", "rec_id", "etag", "last_modified", "headers", "digest")
    rows = rows.withColumn("_full", F.when((F.col("rec_type") == "response") & F.col("_ok") & usable, full))
    known = rows.filter(usable)
    order = F.struct("ts", "rec_id")
    ends = known.groupBy("url_key", "_range").agg(F.max_by("_full", F.when(F.col("_full").isNotNull(), order)).alias("_end"))
    earlier = Window.partitionBy("url_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("url_key", "_range", F.last("_end", ignorenulls=True).over(earlier).alias("_before"))
    # at one time revisits come first, so that they see what is strictly earlier
    inside = Window.partitionBy("url_key", "_range").orderBy("ts", (F.col("rec_type") == "response").cast("int"), "rec_id").rowsBetween(Window.unboundedPreceding, -1)
    asof = known.withColumn("_own", F.last("_full", ignorenulls=True).over(inside)).filter("rec_type = 'revisit'")
    asof = asof.join(carried, ["url_key", "_range"], "left").withColumn("_r", F.coalesce("_own", "_before"))
    lost = rows.filter((F.col("rec_type") == "revisit") & ~usable).withColumn("_r", F.lit(None).cast(asof.schema["_r"].dataType))
    cols = ["rec_id", "url_key", "ts", "etag", "last_modified", "headers", "_r"]
    out = asof.select(*cols).unionByName(lost.select(*cols))
    weak = lambda e: F.regexp_replace(e, "^W/", "")
    by_tag = F.col("etag").isNotNull() & F.col("_r.etag").isNotNull()
    same = F.when(by_tag, weak(F.col("etag")) == weak(F.col("_r.etag"))).otherwise(F.coalesce(F.col("last_modified") == F.col("_r.last_modified"), F.lit(False)))
    status = F.when(F.col("_r").isNull(), "unresolved").when(same, "resolved").otherwise("mismatch")
    good = status == "resolved"
    return out.select(
        "rec_id", "url_key", "ts", F.col("_r.rec_id").alias("response_id"), status.alias("status"),
        F.when(good, merge_headers(F.col("_r.headers"), F.col("headers"))).alias("headers"), F.when(good, F.col("_r.digest")).alias("digest"), "etag",
    )


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Captures of a crawl that fetched ``pages`` in order of page_id and asked for each page
    again, with its ETag, RECHECK captures later."""
    n = F.col("page_id").cast("long")
    digest = F.md5(F.coalesce("html", F.lit("")))
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))
    length = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    heads = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k.replace("_", "-")), v)])
    pages = pages.select(n.alias("n"), "url", tag.alias("etag"), digest.alias("digest"), length.alias("length"))
    first = pages.select((F.col("n") * 2).alias("rec_id"), "url", F.col("n").alias("ts"), F.lit("response").alias("rec_type"), "etag", F.lit(None).cast("string").alias("last_modified"), heads(content_type=F.lit("text/html"), content_length=F.col("length"), date=F.col("n").cast("string"), etag=F.col("etag")).alias("headers"), "digest")
    again = F.col("n") + RECHECK
    second = pages.select((F.col("n") * 2 + 1).alias("rec_id"), "url", again.alias("ts"), F.lit("revisit").alias("rec_type"), "etag", F.lit(None).cast("string").alias("last_modified"), heads(content_length=F.lit("0"), date=again.cast("string"), cache_control=F.lit("max-age=60")).alias("headers"), F.lit(None).cast("string").alias("digest"))
    return first.unionByName(second)


def op6_revisit_resolution(spark, sf_dir):
    out = resolve_revisits(records_of_pages(table(spark, sf_dir, "pages")))
    lines = F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.select("rec_id", "url_key", "ts", "response_id", "status", F.array_join(F.sort_array(lines), ";").alias("headers"), "digest")


OP6_SQL = r"""
with p as (select page_id::bigint n, url, md5(coalesce(html, '')) digest, octet_length(encode(coalesce(html, ''))) length,
    regexp_replace(trim(url), '#.*$', '') bare from pages),
q as (select *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]+)', 1)), ':(80|443)$', ''), '^www\.', '') host,
    regexp_replace(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]+([^?]*)', 1), '/+$', '') path,
    list_aggregate(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))), 'string_agg', '&') named from p),
r as (select n, digest, length, '"' || left(digest, 16) || '"' etag, case when host <> '' then host || path || case when coalesce(named, '') <> '' then '?' || named else '' end end url_key from q),
j as (select v.n, v.url_key, v.etag, max_by(s.n, s.n) sn from r v left join r s on s.url_key = v.url_key and s.n < v.n + 1000 group by all),
k as (select j.n, j.url_key, j.etag, s.n sn, s.etag setag, s.digest, s.length from j left join r s on s.n = j.sn and s.url_key = j.url_key)
select n * 2 + 1 as rec_id, url_key, n + 1000 as ts, sn * 2 as response_id,
    case when sn is null then 'unresolved' when etag = setag then 'resolved' else 'mismatch' end as status,
    case when etag = setag then 'cache-control=max-age=60;content-length=' || length || ';content-type=text/html;date=' || (n + 1000) || ';etag=' || setag end as headers,
    case when etag = setag then digest end as digest
from k
"""
