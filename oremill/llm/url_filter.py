"""URL filters as a temporal list join, in DataFrame functions alone.

List entries are dated: an entry adds a key (a host, a domain with all its hosts, or a host
with its first path segment) to a list or takes it off.  The entries of a key become validity
intervals, from an addition to the key's next entry.  A capture carries its URL's keys, and an
as-of join keeps the intervals that hold at its fetch time.  A capture is blocked when a block
list holds and no allow list does.

Within a day removals come after additions, so that an entry added and removed on one day never
holds.  Captures without a host (null or odd URLs) or fetch time match nothing and are kept;
entries with a null key, list, action or day are left out; repeated entries change nothing;
repeated captures give repeated, equal rows.  Other columns of captures are not read.

A hot host is no hot task: where the entries are too many to broadcast (Spark's own check of
their size), equal captures meet the list once (a partial aggregate by host, segment and day),
and AQE splits what is left of a skewed key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOREVER = "9999-12-31"
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"
SEGMENT = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^/?#]+)"


def host_of(url: Column) -> Column:
    return F.rtrim(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)), F.lit("."))


def segment_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), SEGMENT, 1)


def keys_of(host: Column, segment: Column) -> Column:
    """host:h, domain:d for the host and every domain above it, prefix:h/segment."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, k, F.size(labels)), ".")))
    own = F.array(F.concat(F.lit("host:"), host), F.concat(F.lit("prefix:"), host, F.lit("/"), segment))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.concat(own, domains))


def intervals(entries: DataFrame) -> DataFrame:
    """(key, list, kind, valid_from, valid_to) of entries (key, list, kind, action, day)."""
    e = entries.where("key is not null and list is not null and action is not null and day is not null").select("key", "list", "kind", "action", "day").distinct()
    by = Window.partitionBy("key", "list", "kind").orderBy("day", "action")
    e = e.withColumn("next", F.coalesce(F.lead("day").over(by), F.lit(FOREVER).cast("date")))
    return e.where("action = 'add' and day < next").select("key", "list", "kind", F.col("day").alias("valid_from"), F.col("next").alias("valid_to"))


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(page_id, host, n_active, lists, blocked) for each capture (page_id, url, fetched_on)."""
    c = captures.select("page_id", host_of(F.col("url")).alias("host"), segment_of(F.col("url")).alias("segment"), "fetched_on")
    distinct = c.where("host <> '' and fetched_on is not null").groupBy("host", "segment", "fetched_on").agg(F.count("*").alias("captures"))
    asked = distinct.select("host", "segment", "fetched_on", F.explode(keys_of(F.col("host"), F.col("segment"))).alias("key"))
    i = intervals(entries)
    active = asked.join(i, (asked.key == i.key) & (asked.fetched_on >= i.valid_from) & (asked.fetched_on < i.valid_to))
    verdict = active.groupBy("host", "segment", "fetched_on").agg(
        F.count("*").alias("n_active"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"),
        (F.max(F.when(F.col("kind") == "block", 1).otherwise(0)) > F.max(F.when(F.col("kind") == "allow", 1).otherwise(0))).alias("blocked"),
    )
    out = c.join(verdict, ["host", "segment", "fetched_on"], "left")
    return out.select("page_id", "host", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), F.coalesce("lists", F.lit("")).alias("lists"), F.coalesce("blocked", F.lit(False)).alias("blocked"))


def demo_captures(pages: DataFrame) -> DataFrame:
    """The tables hold no fetch time: a page's is a day of 2023 that follows from its page_id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2023-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(365)).cast("int")).alias("fetched_on"))


#: Fixed entries of the query's list.
DOMAIN_ENTRIES = [
    ("domain:example.org", "adult", "block", "add", "2023-03-01"),
    ("domain:example.org", "adult", "block", "remove", "2023-04-15"),
    ("domain:example.org", "adult", "block", "add", "2023-10-01"),
    ("domain:example.net", "spam", "block", "add", "2023-06-01"),
    ("domain:example.net", "spam", "block", "remove", "2023-07-01"),
]


def demo_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for a quarter of the hosts (by md5), a few of their segments, and whole domains."""
    spark = pages.sparkSession
    seen = pages.select(host_of(F.col("url")).alias("host"), segment_of(F.col("url")).alias("segment")).distinct().where("host <> ''")
    hexed = lambda at: F.conv(F.substring("m", at, 2), 16, 10).cast("int")
    day = lambda n: F.date_add(F.lit("2023-01-01").cast("date"), n)
    hosts = seen.select("host").distinct().withColumn("m", F.md5(F.col("host").cast("binary")))
    listed = hosts.where(F.substring("m", 1, 1).isin("0", "1", "2", "3"))
    key = F.concat(F.lit("host:"), F.col("host")).alias("key")
    add = listed.select(key, F.lit("malware").alias("list"), F.lit("block").alias("kind"), F.lit("add").alias("action"), day(hexed(3)).alias("day"))
    gone = listed.where(F.substring("m", 2, 1) < "8").select(key, F.lit("malware").alias("list"), F.lit("block").alias("kind"), F.lit("remove").alias("action"), day(hexed(3) + hexed(5)).alias("day"))
    allow = hosts.where(F.substring("m", 1, 1) == "4").select(key, F.lit("trusted").alias("list"), F.lit("allow").alias("kind"), F.lit("add").alias("action"), day(hexed(7)).alias("day"))
    parts = seen.withColumn("m", F.md5(F.concat("host", F.lit("/"), "segment").cast("binary"))).where(F.substring("m", 1, 1) == "f")
    parts = parts.select(F.concat(F.lit("prefix:"), "host", F.lit("/"), "segment").alias("key"), F.lit("section").alias("list"), F.lit("block").alias("kind"), F.lit("add").alias("action"), day(hexed(3)).alias("day"))
    fixed = spark.createDataFrame(DOMAIN_ENTRIES, "key string, list string, kind string, action string, day string").withColumn("day", F.col("day").cast("date"))
    return fixed.unionByName(add).unionByName(gone).unionByName(allow).unionByName(parts)


ORACLE = r"""
WITH c AS (
  SELECT page_id, rtrim(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '.') AS host,
         regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^/?#]+)', 1) AS segment,
         DATE '2023-01-01' + CAST((page_id * 37) % 365 AS INTEGER) AS fetched_on
  FROM pages),
hosts AS (SELECT host, md5(host) AS m FROM (SELECT DISTINCT host FROM c WHERE host <> '')),
parts AS (SELECT host, segment, md5(host || '/' || segment) AS m FROM (SELECT DISTINCT host, segment FROM c WHERE host <> '')),
entries(key, list, kind, action, day) AS (
  SELECT * FROM (VALUES ('domain:example.org', 'adult', 'block', 'add', DATE '2023-03-01'), ('domain:example.org', 'adult', 'block', 'remove', DATE '2023-04-15'),
    ('domain:example.org', 'adult', 'block', 'add', DATE '2023-10-01'), ('domain:example.net', 'spam', 'block', 'add', DATE '2023-06-01'), ('domain:example.net', 'spam', 'block', 'remove', DATE '2023-07-01'))
  UNION ALL SELECT 'host:' || host, 'malware', 'block', 'add', DATE '2023-01-01' + ('0x' || substr(m, 3, 2))::INTEGER FROM hosts WHERE substr(m, 1, 1) IN ('0', '1', '2', '3')
  UNION ALL SELECT 'host:' || host, 'malware', 'block', 'remove', DATE '2023-01-01' + ('0x' || substr(m, 3, 2))::INTEGER + ('0x' || substr(m, 5, 2))::INTEGER FROM hosts WHERE substr(m, 1, 1) IN ('0', '1', '2', '3') AND substr(m, 2, 1) < '8'
  UNION ALL SELECT 'host:' || host, 'trusted', 'allow', 'add', DATE '2023-01-01' + ('0x' || substr(m, 7, 2))::INTEGER FROM hosts WHERE substr(m, 1, 1) = '4'
  UNION ALL SELECT 'prefix:' || host || '/' || segment, 'section', 'block', 'add', DATE '2023-01-01' + ('0x' || substr(m, 3, 2))::INTEGER FROM parts WHERE substr(m, 1, 1) = 'f'),
spans AS (
  SELECT key, list, kind, action, day AS lo, coalesce(lead(day) OVER (PARTITION BY key, list, kind ORDER BY day, action), DATE '9999-12-31') AS hi
  FROM (SELECT DISTINCT * FROM entries)),
hits AS (
  SELECT c.page_id, s.list, s.kind FROM c JOIN spans s
    ON s.action = 'add' AND s.lo < s.hi AND c.host <> '' AND c.fetched_on >= s.lo AND c.fetched_on < s.hi
   AND (s.key = 'host:' || c.host OR s.key = 'prefix:' || c.host || '/' || c.segment
        OR (s.key LIKE 'domain:%' AND ('.' || c.host) LIKE ('%.' || substr(s.key, 8)))))
SELECT c.page_id, c.host, CAST(count(h.list) AS BIGINT) AS n_active, coalesce(array_to_string(list_sort(list(DISTINCT h.list) FILTER (WHERE h.list IS NOT NULL)), ','), '') AS lists,
       coalesce(bool_or(h.kind = 'block'), FALSE) AND NOT coalesce(bool_or(h.kind = 'allow'), FALSE) AS blocked
FROM c LEFT JOIN hits h ON h.page_id = c.page_id GROUP BY c.page_id, c.host
"""
