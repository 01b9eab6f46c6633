"""WARC not-modified revisits: an as-of join by canonical URL to the latest earlier full response.

A revisit takes the response that stands last before it, in order of (ts, record_id), under its canonical URL. It is resolved
if its validators agree: equal entity tags (weak comparison) where both have one, else equal Last-Modified dates, else equal
payload digests. The resolved headers are the response's, replaced by the revisit's except those that describe a message or its
body, which a 304 must not change. All of it is DataFrame expressions.

One URL may hold a third of all records: a timeline is cut into spans of SPAN ticks. The last response of each span is a partial
aggregate; a window over these few rows carries it forward, and the window over records runs within a span.

Defined cases. Null url or ts: status no_original. Null headers: none. Header names are compared in lower case; of one name repeated in a
record the last counts. Repeated rows: each is resolved. Responses of one ts: the larger record_id is the later. Very long fields: taken whole. Empty tables: no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ticks of ts that one window partition of a URL covers.
SPAN = 4096
#: Header fields that a not-modified response leaves as they are.
UNCHANGED = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "te", "trailer", "transfer-encoding", "upgrade")


def canonical(url: Column) -> Column:
    """Without scheme, www, default ports, fragment, tracking parameters and a slash at the end; the host in lower case."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^www[.]", ""), ":(80|443)$", "")
    rest = F.regexp_replace(F.regexp_replace(bare, "^[^/?]*", ""), "([?&])(?:(?:utm_[A-Za-z]+|ref)=[^&]*(?:&|$))+", "$1")
    return F.concat(host, F.regexp_replace(F.regexp_replace(rest, "[?&]+$", ""), "/+$", ""))


def _lowered(headers: str) -> str:
    named = f"transform(map_entries(coalesce({headers}, map())), e -> named_struct('key', lower(e.key), 'value', e.value))"
    return f"filter({named}, (e, i) -> NOT exists(slice({named}, i + 2, size({named})), later -> later.key = e.key))"


def resolve(records: DataFrame, span: int = SPAN) -> DataFrame:
    """records (record_id long, url, ts long, kind 'response' or 'revisit', headers map, payload_digest) ->

    record_id, canonical_url, response_id, status (resolved, validator_mismatch, no_original), payload_digest, headers: a row for each revisit.
    """
    r = records.select(F.col("record_id").cast("long").alias("record_id"), canonical(F.col("url")).alias("canonical_url"), F.col("ts").cast("long").alias("ts"), "kind", F.expr(_lowered("headers")).alias("h"), "payload_digest")
    r = r.where("kind IN ('response', 'revisit')").withColumn("span", F.floor(F.col("ts") / span))
    full = F.struct("ts", "record_id", "h", "payload_digest")
    is_full = (F.col("kind") == "response") & F.col("ts").isNotNull()
    last = r.where(is_full & F.col("canonical_url").isNotNull()).groupBy("canonical_url", "span").agg(F.max_by(full, F.struct("ts", "record_id")).alias("last"))
    revisited = r.where("kind = 'revisit'").select("canonical_url", "span").distinct()
    spans = last.join(revisited, ["canonical_url", "span"], "full_outer")
    before = Window.partitionBy("canonical_url").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.withColumn("carried", F.last("last", ignorenulls=True).over(before)).where("canonical_url IS NOT NULL").drop("last")
    within = Window.partitionBy("canonical_url", "span").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = r.withColumn("near", F.last(F.when(is_full, full), ignorenulls=True).over(within)).where("kind = 'revisit'")
    found = seen.join(carried, ["canonical_url", "span"], "left").withColumn("o", F.when(F.col("canonical_url").isNotNull() & F.col("ts").isNotNull(), F.coalesce("near", "carried")))
    value = lambda of, name: f"try_element_at(filter({of}, e -> e.key = '{name}'), 1).value"
    tag = lambda of: F.expr(f"regexp_replace({value(of, 'etag')}, '^W/', '')")
    date = lambda of: F.expr(value(of, "last-modified"))
    agree = F.when(tag("h").isNotNull() & tag("o.h").isNotNull(), tag("h") == tag("o.h")).when(date("h").isNotNull() & date("o.h").isNotNull(), date("h") == date("o.h")).otherwise(F.coalesce(F.col("payload_digest") == F.col("o.payload_digest"), F.lit(False)))
    status = F.when(F.col("o").isNull(), "no_original").when(agree, "resolved").otherwise("validator_mismatch")
    fixed = ", ".join(f"'{x}'" for x in UNCHANGED)
    merged = F.expr(f"map_from_entries(array_sort(concat(filter(o.h, a -> a.key IN ({fixed}) OR NOT exists(h, b -> b.key = a.key)), filter(h, b -> b.key NOT IN ({fixed})))))")
    out = found.withColumn("status", status)
    ok = F.col("status") == "resolved"
    return out.select("record_id", "canonical_url", F.col("o.record_id").alias("response_id"), "status", F.when(ok, F.col("o.payload_digest")).alias("payload_digest"), F.when(ok, merged).alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """Crawl records from the pages table, which has no capture metadata of its own: each page is a full response at tick
    2 page_id; every third is revisited at the next tick under a variant of its URL, every fourth of these with a stale
    tag; every fiftieth page brings a revisit of a URL that was never seen."""
    p = pages.select(F.col("page_id").cast("long").alias("id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    tag, digest = F.concat(F.lit('"'), F.md5("html"), F.lit('"')), F.sha2("html", 256)
    text = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    response = p.select((2 * F.col("id")).alias("record_id"), "url", (2 * F.col("id")).alias("ts"), F.lit("response").alias("kind"), F.create_map(F.lit("ETag"), tag, F.lit("Content-Length"), text(F.length("html")), F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"), digest.alias("payload_digest"))
    stale = F.when(F.col("id") % 4 == 0, F.lit('"stale"')).otherwise(F.concat(F.lit("W/"), tag))
    again = p.where("id % 3 = 0").select((2 * F.col("id") + 1).alias("record_id"), F.concat("url", F.lit("#again")).alias("url"), (2 * F.col("id") + 1).alias("ts"), F.lit("revisit").alias("kind"), F.create_map(F.lit("etag"), stale, F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.concat(F.lit("max-age="), text(F.col("id") % 7)), F.lit("date"), text("id")).alias("headers"), F.lit(None).cast("string").alias("payload_digest"))
    lost = p.where("id % 50 = 0").select((-1 - F.col("id")).alias("record_id"), F.concat(F.lit("https://unseen.example.com/"), text("id")).alias("url"), (2 * F.col("id") + 1).alias("ts"), F.lit("revisit").alias("kind"), F.create_map(F.lit("etag"), tag).alias("headers"), digest.alias("payload_digest"))
    return response.unionByName(again).unionByName(lost)


def op6_warc_revisits(spark, sf_dir: str) -> DataFrame:
    out = resolve(captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    headers = F.expr("array_join(transform(array_sort(map_entries(headers)), e -> concat(e.key, '=', e.value)), ';')")
    return out.select("record_id", "canonical_url", "response_id", "status", "payload_digest", headers.alias("headers"))


OP6_SQL = r"""
WITH p AS (SELECT page_id AS id, url, coalesce(html, '') AS html FROM pages),
raw AS (
  SELECT 2 * id AS record_id, url, 2 * id AS ts, 'response' AS kind, '"' || md5(html) || '"' AS tag, length(html)::VARCHAR AS len, 'max-age=60' AS cache, NULL AS day, sha256(html) AS digest FROM p
  UNION ALL
  SELECT 2 * id + 1, url || '#again', 2 * id + 1, 'revisit', CASE WHEN id % 4 = 0 THEN '"stale"' ELSE 'W/"' || md5(html) || '"' END, '0', 'max-age=' || (id % 7), id::VARCHAR, NULL FROM p WHERE id % 3 = 0
  UNION ALL
  SELECT -1 - id, 'https://unseen.example.com/' || id, 2 * id + 1, 'revisit', '"' || md5(html) || '"', NULL, NULL, NULL, sha256(html) FROM p WHERE id % 50 = 0),
bare AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS b FROM raw),
r AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(b, '^[^/?]*', 0)), '^www[.]', ''), ':(80|443)$', '')
    || regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '^[^/?]*', ''), '([?&])(?:(?:utm_[A-Za-z]+|ref)=[^&]*(?:&|$))+', '\1', 'g'), '[?&]+$', ''), '/+$', '') AS canonical_url FROM bare),
j AS (
  SELECT v.*, o.record_id AS oid, o.tag AS otag, o.len AS olen, o.cache AS ocache, o.digest AS odigest,
         row_number() OVER (PARTITION BY v.record_id ORDER BY o.ts DESC, o.record_id DESC) AS k
  FROM r v LEFT JOIN r o ON o.kind = 'response' AND o.canonical_url = v.canonical_url AND (o.ts, o.record_id) < (v.ts, v.record_id) WHERE v.kind = 'revisit'),
s AS (SELECT *, CASE WHEN oid IS NULL THEN 'no_original' WHEN regexp_replace(tag, '^W/', '') = otag THEN 'resolved' ELSE 'validator_mismatch' END AS status FROM j WHERE k = 1)
SELECT record_id, canonical_url, oid AS response_id, status, CASE WHEN status = 'resolved' THEN odigest END AS payload_digest,
       CASE WHEN status = 'resolved' THEN 'cache-control=' || cache || ';content-length=' || olen || ';date=' || day || ';etag=' || tag END AS headers
FROM s
"""
