"""WARC revisit resolution: a not-modified record gets the latest earlier full response of its canonical URL.

The as-of join is made in two steps, so that a URL with a third of all records is not one task: the last response
inside a (URL, time slice), and, for records with none before them in their slice, the last one of the earlier
slices. Only record ids and validators move, never bodies.

A revisit is resolved if a validator that both sides have agrees (ETag, weak prefix ignored; else Last-Modified),
or if it has none at all and the response has none either. Permitted headers of the revisit then replace the
response's (RFC 9110, 15.4.5: a 304 may update these); content headers stay those of the response. Header names are
compared, and returned, in lower case.

Defined cases: records without URL, time or type are never matched (a revisit among them gets status ``unmatched``);
of responses at one instant the largest record id wins; a response at the revisit's own instant is not earlier;
repeated rows each keep a row; an empty table gives no row; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import materialize

#: Header fields, in lower case, that a not-modified response may update (RFC 9110, 15.4.5).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
SLICE_RECORDS = 4096

#: Canonical form: no fragment, scheme, www. or m. prefix, default port, tracking parameter or trailing slash; host
#: in lower case. The same steps run in the oracle.
CANONICAL = [(r"#.*$", ""), (r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), (r"^([wW]{3}|m)\.", ""), (r"^([^/?:]+):(80|443)(/|\?|$)", r"$1$3"), (r"([?&])(ref|utm_[a-z]+|sessionid)=[^&]*", "$1"), (r"&&+", "&"), (r"\?&", "?"), (r"[?&]+$", ""), (r"/+$", "")]


def canonical_url(url: Column) -> Column:
    for pattern, put in CANONICAL:
        url = F.regexp_replace(url, pattern, put)
    host = F.regexp_extract(url, r"^[^/?]*", 0)
    return F.concat(F.lower(host), F.substr(url, F.char_length(host) + 1))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Records (record_id, url, ts, kind: response/revisit, etag, last_modified, headers map) -> a row per revisit."""
    meta = records.select("record_id", canonical_url(F.col("url")).alias("curl"), F.col("ts").cast("double").alias("ts"), "kind", "etag", "last_modified", "headers")
    meta = materialize(meta.where("kind IS NOT NULL"), "records")
    known = meta.where("curl IS NOT NULL AND ts IS NOT NULL")
    span = known.agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n")).first()
    slices = max(1, -(-span.n // SLICE_RECORDS))
    width = ((span.b or 0) - (span.a or 0)) / slices or 1.0
    known = known.withColumn("slice", F.floor((F.col("ts") - (span.a or 0)) / width))

    full = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "etag", "last_modified", "headers"))
    heads = F.when(F.col("kind") == "response", F.struct("ts", "record_id"))
    lasts = known.where("kind = 'response'").groupBy("curl", "slice").agg(F.max(heads).alias("h"), F.max_by(full, heads).alias("last"))
    ahead = Window.partitionBy("curl").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    asked = known.where("kind = 'revisit'").select("curl", "slice").distinct()
    # One row a URL and slice.
    carried = lasts.select("curl", "slice", "last").join(asked, ["curl", "slice"], "full_outer").withColumn("carry", F.last("last", ignorenulls=True).over(ahead))
    carried = carried.select("curl", "slice", "carry")

    before = F.last(full, ignorenulls=True).over(Window.partitionBy("curl", "slice").orderBy("ts", F.when(F.col("kind") == "revisit", 0).otherwise(1), "record_id").rowsBetween(Window.unboundedPreceding, -1))
    found = known.withColumn("near", before).where("kind = 'revisit'").join(carried, ["curl", "slice"], "left").withColumn("hit", F.coalesce("near", "carry"))
    lost = meta.where("kind = 'revisit' AND (curl IS NULL OR ts IS NULL)").withColumn("hit", F.lit(None).cast(found.schema["hit"].dataType))
    cols = ["record_id", "curl", "ts", "etag", "last_modified", "headers", "hit"]
    return _judged(found.select(*cols).unionByName(lost.select(*cols)))


def _lower_keys(headers: Column) -> Column:
    """Header names in lower case; of names that then are equal the last one counts. No headers: an empty map."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    none = F.slice(entries, 1, 0)
    last = F.aggregate(entries, none, lambda acc, e: F.concat(F.filter(acc, lambda x: x["key"] != e["key"]), F.array(e)))
    return F.coalesce(F.map_from_entries(last), F.create_map().cast("map<string,string>"))


def _judged(df: DataFrame) -> DataFrame:
    strong = lambda c: F.regexp_replace(c, "^W/", "")
    same_tag = strong(F.col("etag")) == strong(F.col("hit.etag"))
    same_date = F.col("last_modified") == F.col("hit.last_modified")
    none = F.coalesce("etag", "last_modified", "hit.etag", "hit.last_modified").isNull()
    valid = F.coalesce(same_tag, same_date, none)
    status = F.when(F.col("hit").isNull(), "unmatched").when(valid, "resolved").otherwise("validator_mismatch")
    own = F.map_filter(_lower_keys(F.col("headers")), lambda k, v: k.isin(PERMITTED))
    theirs = F.map_filter(_lower_keys(F.col("hit.headers")), lambda k, v: ~F.map_contains_key(own, k))
    merged = F.when(status == "resolved", F.map_concat(theirs, own))
    return df.select("record_id", "curl", "ts", status.alias("status"), F.when(status == "resolved", F.col("hit.record_id")).alias("response_id"), F.col("hit.record_id").alias("candidate_id"), merged.alias("headers"))


def page_records(pages: DataFrame) -> DataFrame:
    """A crawl log from ``pages``: each page's capture, and a later not-modified recrawl of its URL.

    A page's id orders the captures; its recrawl comes 1000 captures later and carries the validators of the page, so
    it fails if another page was captured under the same canonical URL in between.
    """
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    page = pages.select("page_id", "url", tag.alias("etag"), F.char_length(F.coalesce("html", F.lit(""))).cast("string").alias("len"))
    head = lambda *kv: F.create_map(*[x if isinstance(x, Column) else F.lit(x) for x in kv])
    full = page.select((F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 2).alias("ts"), F.lit("response").alias("kind"), "etag", F.lit(None).cast("string").alias("last_modified"), head("content-type", "text/html", "content-length", F.col("len"), "cache-control", "max-age=60", "etag", F.col("etag")).alias("headers"))
    again = page.select((F.col("page_id") * 2 + 1).alias("record_id"), "url", (F.col("page_id") * 2 + 2001).alias("ts"), F.lit("revisit").alias("kind"), F.concat(F.lit("W/"), "etag").alias("etag"), F.lit(None).cast("string").alias("last_modified"), head("content-length", "0", "cache-control", "max-age=600", "etag", F.concat(F.lit("W/"), "etag")).alias("headers"))
    return full.unionByName(again)


def op10(pages: DataFrame) -> DataFrame:
    out = resolve_revisits(page_records(pages))
    h = lambda k: F.col("headers").getItem(k)
    return out.select("record_id", F.col("curl").alias("canonical_url"), "status", "response_id", "candidate_id", h("content-length").alias("content_length"), h("cache-control").alias("cache_control"), h("etag").alias("etag"))


def _sql_canonical() -> str:
    x = "url"
    for pattern, put in CANONICAL:
        x = f"regexp_replace({x}, '{pattern}', '{put.replace('$', chr(92))}', 'g')"
    return f"(WITH c AS (SELECT page_id, html, {x} AS u FROM pages) SELECT page_id, html, lower(regexp_extract(u, '^[^/?]*')) || substr(u, length(regexp_extract(u, '^[^/?]*')) + 1) AS u FROM c)"


OP10_SQL = f"""
WITH p AS (SELECT page_id, u, '"' || md5(coalesce(html, '')) || '"' AS tag, CAST(length(coalesce(html, '')) AS VARCHAR) AS len FROM {_sql_canonical()} x),
r AS (SELECT page_id * 2 AS id, u, page_id * 2 AS ts, tag, len FROM p),
v AS (SELECT page_id * 2 + 1 AS id, u, page_id * 2 + 2001 AS ts, tag FROM p),
hit AS (SELECT v.id, max(r.ts) AS rts FROM v JOIN r ON v.u = r.u AND r.ts < v.ts GROUP BY v.id)
SELECT v.id AS record_id, v.u AS canonical_url,
  CASE WHEN r.id IS NULL THEN 'unmatched' WHEN r.tag = v.tag THEN 'resolved' ELSE 'validator_mismatch' END AS status,
  CASE WHEN r.tag = v.tag THEN r.id END AS response_id, r.id AS candidate_id,
  CASE WHEN r.tag = v.tag THEN r.len END AS content_length,
  CASE WHEN r.tag = v.tag THEN 'max-age=600' END AS cache_control,
  CASE WHEN r.tag = v.tag THEN 'W/' || v.tag END AS etag
FROM v LEFT JOIN hit ON v.id = hit.id LEFT JOIN r ON r.u = v.u AND r.ts = hit.rts
"""
