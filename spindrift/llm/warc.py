"""WARC: server-not-modified revisits resolved to the response that they stand for.

A revisit (304) has no payload of its own. It is joined as of its time to the latest
earlier full response of the same canonical URL; its validators must agree with that
response (entity tags by weak comparison, else the Last-Modified date), and the headers
that a 304 may update are merged into the response's. A full response is one of status 200 or
203 (or of no known status): errors, redirects and parts (206) stand for no revisit. A
revisit of another profile (an identical payload, fetched in full) is no not-modified one and
is reported as such.

The as-of join runs in time buckets of near equal row counts: in a bucket a window finds
the latest response, across buckets one response a URL and bucket is carried forward. A
URL with a third of all records is thus spread over the buckets.

Outcomes: `resolved`; `unvalidated` (the revisit names no validator that the response has
too: the latest response stands); `etag_mismatch` and `date_mismatch` (the response had
changed: no payload); `no_response` (no earlier response); `other_profile`. Where a revisit names
the record that it refers to, `as_referred` says whether that is the one found.

Defined results: null and empty URLs have no response; a response of the very time of
the revisit isn't earlier; of several latest responses of one time that of the greatest
record_id counts; records without a time are `no_response` as revisits and never found as
responses; repeated revisits are resolved each; null headers are none; an empty table
gives an empty result; only the named columns are read, so further columns can't clash.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

#: Headers of a 304 that update the stored response (RFC 9110, 15.4.5, and Last-Modified).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=.*)?$"
BUCKET_ROWS, MAX_BUCKETS = 100_000, 4_096
#: Bytes of records that a task gathers before it hands them on; a record that claims more than MAX_RECORD is taken as cut.
BATCH_BYTES, MAX_RECORD = 16 << 20, 256 << 20
FULL_STATUS, NOT_MODIFIED = (200, 203), "server-not-modified"
HEADERS = "array<struct<name:string,value:string>>"


def canonical_url(url: Column) -> Column:
    """Host without case, user, default port and www; path without a last slash; sorted query without tracking; no scheme, no fragment."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, "^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^[^@]*@", ""), ":(80|443)$", ""), r"^www[0-9]*\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    kept = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    whole = F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(host != "", whole)


def _header(headers: Column, name: str) -> Column:
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name), F.lit(0))["value"]


def merged_headers(response: Column, revisit: Column) -> Column:
    """The response's headers, those permitted taken from the revisit where it has them; names in lower case, sorted."""
    clean = lambda hs: F.transform(hs, lambda h: F.struct(F.lower(h["name"]).alias("name"), h["value"].alias("value")))
    new = F.filter(clean(revisit), lambda h: h["name"].isin(*PERMITTED))
    old = F.filter(clean(response), lambda h: ~F.exists(new, lambda n: n["name"] == h["name"]))
    return F.array_sort(F.concat(old, new))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """records: record_id string, type (response or revisit), url, ts long, headers (HEADERS), digest string; and, where
    known, status int, profile string, refers_to string (of a revisit).

    Returns a row for each revisit: record_id, url_key, ts, outcome, response_id, digest and headers (merged), as_referred.
    """
    known = lambda name, kind: (F.col(name) if name in records.columns else F.lit(None)).cast(kind).alias(name)
    rows = records.where(F.col("type").isin("response", "revisit")).select(
        "record_id",
        "type",
        canonical_url(F.col("url")).alias("url_key"),
        "ts",
        F.coalesce("headers", F.array().cast(HEADERS)).alias("headers"),
        "digest",
        known("status", "int"),
        known("profile", "string"),
        known("refers_to", "string"),
    )
    asked = F.coalesce(F.col("profile").contains(NOT_MODIFIED), F.coalesce(F.col("status"), F.lit(304)) == 304)
    other = rows.where((F.col("type") == "revisit") & ~asked)
    full = F.col("status").isNull() | F.col("status").isin(*FULL_STATUS)
    rows = rows.where(((F.col("type") == "revisit") & asked) | ((F.col("type") == "response") & full)).drop("status", "profile")
    found = rows.agg(F.count("ts").alias("n")).first()["n"]
    n_buckets = int(min(MAX_BUCKETS, max(1, found // BUCKET_ROWS)))
    cuts = sorted(set(rows.approxQuantile("ts", [i / n_buckets for i in range(1, n_buckets)], 0.1 / n_buckets))) if n_buckets > 1 else []
    # the bounds decide where the work is done, not what comes out; looked up in two steps of the root of their number
    bucket = F.lit(0)
    if cuts:
        step = math.isqrt(len(cuts)) + 1
        parts = [[float(c) for c in cuts[i : i + step]] for i in range(0, len(cuts), step)]
        below = lambda bounds: F.size(F.filter(bounds, lambda c: c <= F.col("ts")))
        part = F.greatest(below(F.lit([p[0] for p in parts])) - 1, F.lit(0))
        bucket = part * step + below(F.get(F.array(*[F.lit(p) for p in parts]), part))
    rows = rows.withColumn("bucket", bucket)

    response = F.when((F.col("type") == "response") & F.col("ts").isNotNull() & F.col("url_key").isNotNull(), F.struct("ts", "record_id", "digest", "headers"))
    carried = rows.where(response.isNotNull()).groupBy("url_key", "bucket").agg(F.max(response).alias("last"))
    marks = rows.where("type = 'revisit' AND url_key IS NOT NULL").select("url_key", "bucket", F.lit(None).cast(carried.schema["last"].dataType).alias("last")).distinct()
    across = Window.partitionBy("url_key").orderBy("bucket").rangeBetween(Window.unboundedPreceding, -1)
    carried = carried.unionByName(marks).groupBy("url_key", "bucket").agg(F.max("last").alias("last"))
    carried = carried.select("url_key", "bucket", F.max("last").over(across).alias("carried"))
    inside = Window.partitionBy("url_key", "bucket").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    revisits = rows.where("url_key IS NOT NULL AND ts IS NOT NULL").withColumn("near", F.max(response).over(inside)).where("type = 'revisit'")
    revisits = revisits.join(carried, ["url_key", "bucket"], "left").withColumn("r", F.coalesce("near", "carried")).drop("near", "carried", "bucket")
    lost = rows.where("type = 'revisit' AND (url_key IS NULL OR ts IS NULL)").drop("bucket").withColumn("r", F.lit(None).cast(revisits.schema["r"].dataType))
    revisits = revisits.unionByName(lost)

    weak = lambda tag: F.regexp_replace(tag, "^W/", "")
    etag, etag_r = (weak(_header(h, "etag")) for h in (F.col("headers"), F.col("r.headers")))
    date, date_r = (_header(h, "last-modified") for h in (F.col("headers"), F.col("r.headers")))
    outcome = (
        F.when(F.col("r").isNull(), "no_response")
        .when(etag.isNotNull() & etag_r.isNotNull(), F.when(etag == etag_r, "resolved").otherwise("etag_mismatch"))
        .when(date.isNotNull() & date_r.isNotNull(), F.when(date == date_r, "resolved").otherwise("date_mismatch"))
        .otherwise("unvalidated")
    )
    stands = F.col("outcome").isin("resolved", "unvalidated")
    found = revisits.withColumn("outcome", outcome).select(
        "record_id",
        "url_key",
        "ts",
        "outcome",
        F.col("r.record_id").alias("response_id"),
        F.when(stands, F.col("r.digest")).alias("digest"),
        F.when(stands, merged_headers(F.col("r.headers"), F.col("headers"))).alias("headers"),
        (F.col("r.record_id") == F.col("refers_to")).alias("as_referred"),
    )
    none = {"response_id": "string", "digest": "string", "headers": HEADERS, "as_referred": "boolean"}
    return found.unionByName(other.select("record_id", "url_key", "ts", F.lit("other_profile").alias("outcome"), *[F.lit(None).cast(k).alias(c) for c, k in none.items()]))


def parse_record(record: bytes) -> dict | None:
    """A record without its version line's "WARC/": named fields, status and headers of its HTTP message, and payload; None if it is no record."""
    head, _, block = record.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if first.removeprefix("WARC/")[:2] not in ("0.", "1.") or not lines:
        return None
    pair = lambda line: tuple(x.strip() for x in line.partition(":")[::2])
    warc = {name.lower(): value for name, value in map(pair, lines)}
    if warc.get("content-length", "").isdigit():
        block = block[: int(warc["content-length"])]
    if not block.startswith(b"HTTP/"):
        return {"warc": warc, "status": None, "http": [], "payload": block}
    head, _, payload = block.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    status = first.split(" ")[1:2]
    return {"warc": warc, "status": int(status[0]) if status and status[0].isdigit() else None, "http": [pair(x) for x in lines if x], "payload": payload}


def whole_records(parts: Iterator[bytes]) -> Iterator[bytes]:
    """Records from a file cut at every line break before "WARC/": cuts inside a record's block are undone by its length."""
    held = b""
    for part in parts:
        held = held + b"\r\n\r\nWARC/" + part if held else part
        head, _, block = held.partition(b"\r\n\r\n")
        length = re.search(rb"(?i)\r\ncontent-length:\s*([0-9]+)", head)
        if length and len(block) < int(length[1]) and len(held) < MAX_RECORD:
            continue
        yield held
        held = b""
    if held:
        yield held


def read_warc(spark, path: str, skip_damaged: bool = True) -> DataFrame:
    """Response and revisit records of WARC files, plain or gzipped, as resolve_revisits takes them, with payload.

    Spark's line reader cuts files at record borders, so a task holds some records and never a file; plain files are read
    by several tasks. Defined results: what is no record, or has no time or no id, is passed over or null in that column;
    a record of less than its length (a truncated file) has what is left, or takes what follows up to its length; a damaged gzip stream ends its file (error if not
    skip_damaged).
    """

    def parsed(batches):
        names = ["record_id", "type", "url", "ts", "headers", "digest", "status", "profile", "refers_to", "payload"]
        parts = (bytes(x) for batch in batches for x in batch["value"])
        rows, size = [], 0
        for record in whole_records(parts):
            r = parse_record(record)
            if r is None or r["warc"].get("warc-type") not in ("response", "revisit"):
                continue
            w = r["warc"]
            at = pd.to_datetime(w.get("warc-date"), errors="coerce", utc=True)
            at = None if at is None or pd.isna(at) else int(at.timestamp())
            rows.append((w.get("warc-record-id"), w["warc-type"], w.get("warc-target-uri"), at, [{"name": a, "value": b} for a, b in r["http"]], w.get("warc-payload-digest"), r["status"], w.get("warc-profile"), w.get("warc-refers-to"), r["payload"]))
            size += len(record)
            if size >= BATCH_BYTES:
                yield pd.DataFrame(rows, columns=names).astype({"ts": "Int64", "status": "Int32"})
                rows, size = [], 0
        yield pd.DataFrame(rows, columns=names).astype({"ts": "Int64", "status": "Int32"})

    lines = spark.read.option("lineSep", "\r\n\r\nWARC/").option("ignoreCorruptFiles", str(skip_damaged).lower()).text(path)
    kinds = f"record_id string, type string, url string, ts long, headers {HEADERS}, digest string, status int, profile string, refers_to string, payload binary"
    return lines.select(F.col("value").cast("binary").alias("value")).mapInPandas(parsed, kinds)


def crawl_of(pages: DataFrame) -> DataFrame:
    """A crawl of pages: each fetched in full once (at its id) and asked for again later.

    Asked again under the URL in upper case host, with a fragment; every fifth page has changed
    (another entity tag), every seventh answers without a tag but with a date, every
    eleventh was first fetched after it was asked for again.
    """
    tag, digest = F.concat(F.lit('"'), F.md5("html"), F.lit('"')), F.md5("html")
    i = F.col("page_id")
    header = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    date = F.concat(F.lit("day "), i.cast("string"))
    full = pages.select(
        F.concat(F.lit("full-"), i.cast("string")).alias("record_id"),
        F.lit("response").alias("type"),
        "url",
        F.when(i % 11 == 0, i + 4_000_000_000).otherwise(i).alias("ts"),
        F.array(header("ETag", tag), header("Last-Modified", date), header("Content-Type", F.lit("text/html")), header("Date", date)).alias("headers"),
        digest.alias("digest"),
    )
    again = pages.select(
        F.concat(F.lit("again-"), i.cast("string")).alias("record_id"),
        F.lit("revisit").alias("type"),
        F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again")).alias("url"),
        (i + 2_000_000_000).alias("ts"),
        F.when(i % 7 == 0, F.array(header("Last-Modified", date), header("Content-Type", F.lit("none"))))
        .otherwise(F.array(header("ETag", F.when(i % 5 == 0, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), tag))), header("Date", F.lit("later")), header("Set-Cookie", F.lit("x"))))
        .alias("headers"),
        F.lit(None).cast("string").alias("digest"),
    )
    return full.unionByName(again)


def op3_warc_revisits(spark, sf_dir: str) -> DataFrame:
    found = resolve_revisits(crawl_of(table(spark, sf_dir, "pages")))
    return found.select(
        F.substring_index("record_id", "-", -1).cast("long").alias("page_id"),
        "url_key",
        "outcome",
        "response_id",
        "digest",
        F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit("="), h["value"])), ";").alias("merged"),
    )


OP3_SQL = r"""
WITH p AS (
  SELECT page_id, url, md5(html) AS digest, '"' || md5(html) || '"' AS tag, 'day ' || page_id AS day,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest
  FROM pages),
h AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*', 0)), '^[^@]*@', ''), ':(80|443)$', ''), '^www[0-9]*\.', '') AS host,
         regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
           lambda x: x <> '' AND NOT regexp_full_match(x, '(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=.*)?'))) AS q
  FROM p),
k AS (
  SELECT *, CASE WHEN host <> '' THEN host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS url_key,
         CASE WHEN page_id % 11 = 0 THEN page_id + 4000000000 ELSE page_id END AS ts
  FROM h),
q AS (
  SELECT *, CASE WHEN page_id % 7 <> 0 THEN CASE WHEN page_id % 5 = 0 THEN '"changed"' ELSE 'W/' || tag END END AS asked_tag,
         CASE WHEN page_id % 7 = 0 THEN day END AS asked_day, CASE WHEN page_id % 7 <> 0 THEN 'later' END AS asked_date
  FROM k),
j AS (
  SELECT a.page_id, a.url_key, a.asked_tag, a.asked_day, a.asked_date, r.page_id AS rid, r.tag, r.day, r.digest,
         row_number() OVER (PARTITION BY a.page_id ORDER BY r.ts DESC, 'full-' || r.page_id DESC) AS n
  FROM q a LEFT JOIN q r ON a.url_key = r.url_key AND r.ts < a.page_id + 2000000000),
o AS (
  SELECT *, CASE WHEN rid IS NULL THEN 'no_response'
                 WHEN asked_tag IS NOT NULL AND tag IS NOT NULL THEN CASE WHEN ltrim(asked_tag, 'W/') = tag THEN 'resolved' ELSE 'etag_mismatch' END
                 WHEN asked_day IS NOT NULL AND day IS NOT NULL THEN CASE WHEN asked_day = day THEN 'resolved' ELSE 'date_mismatch' END
                 ELSE 'unvalidated' END AS outcome
  FROM j WHERE n = 1)
SELECT page_id, url_key, outcome, 'full-' || rid AS response_id,
       CASE WHEN outcome IN ('resolved', 'unvalidated') THEN digest END AS digest,
       CASE WHEN outcome IN ('resolved', 'unvalidated') THEN
         'content-type=text/html;date=' || coalesce(asked_date, day) || ';etag=' || coalesce(asked_tag, tag) || ';last-modified=' || coalesce(asked_day, day) END AS merged
FROM o
"""
