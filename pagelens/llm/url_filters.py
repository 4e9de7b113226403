"""URL filters as a temporal list join, with DataFrame functions only.

A block list changes over time: dated entries add or remove a pattern.  Entries of a
pattern become validity intervals (each lasts until the next one), and an as-of join
evaluates every capture against the intervals that hold at its fetch time.  Patterns
are looked up once per site (host and first path segment), never per capture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

URL = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/:?#\[\]]+)(?::\d*)?(?:/([^/?#]*))?"


def site_of(url: str = "url") -> list[Column]:
    """host (ASCII lower case, no final dot) and first path segment, both empty where the URL has none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1)), r"\.$", "")
    return [host.alias("host"), F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2).alias("segment")]


def intervals(entries: DataFrame) -> DataFrame:
    """entries (pattern, action add|remove, category, listed_on) -> pattern, category, valid_from, valid_to of the added spans.

    Of entries with one pattern and date the removal counts last.  valid_to is null
    while an entry still holds.  Entries without pattern or date are left out.
    """
    order = Window.partitionBy("pattern").orderBy("listed_on", "action", "category")
    spans = entries.where("pattern is not null and listed_on is not null").withColumn("valid_to", F.lead("listed_on").over(order))
    spans = spans.where("action = 'add' and (valid_to is null or valid_to > listed_on)")
    return spans.select("pattern", "category", F.col("listed_on").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (page_id, url, fetched_on) -> page_id, url, fetched_on, host, blocked, pattern, category, valid_from.

    A pattern is a domain, which covers its subdomains, or domain/segment, which covers
    that first path segment there.  Of several the longest counts, then the one listed
    first.  One row per row; a null or unusable url, or a null date, is not blocked.
    Other columns are not read; an empty list blocks nothing.
    """
    captures = captures.select("page_id", "url", "fetched_on", *site_of())
    sites = captures.select("host", "segment").where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    both = F.when(F.col("segment") != "", F.concat(suffix, F.transform(suffix, lambda s: F.concat(s, F.lit("/"), F.col("segment"))))).otherwise(suffix)
    looked_up = sites.select("host", "segment", F.explode(both).alias("pattern")).join(intervals(entries), "pattern")
    # as-of: the spans that hold when the page was fetched
    asked = captures.select("host", "segment", "fetched_on").distinct()
    holds = (F.col("valid_from") <= F.col("fetched_on")) & (F.col("valid_to").isNull() | (F.col("fetched_on") < F.col("valid_to")))
    best = F.max(F.struct(F.length("pattern").alias("length"), (-F.datediff("valid_from", F.lit("1970-01-01"))).alias("first"), "pattern", "category", "valid_from")).alias("best")
    decided = asked.join(looked_up, ["host", "segment"]).where(holds).groupBy("host", "segment", "fetched_on").agg(best)
    out = captures.join(decided, ["host", "segment", "fetched_on"], "left")
    return out.select("page_id", "url", "fetched_on", "host", F.col("best").isNotNull().alias("blocked"), "best.pattern", "best.category", "best.valid_from")


def dated_captures(pages: DataFrame) -> DataFrame:
    """Pages carry no fetch date; the query dates them over the year 2024 by page_id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int")).alias("fetched_on"))


def dated_entries(pages: DataFrame) -> DataFrame:
    """The query's list, drawn from the hosts by their MD5: hosts added, removed and added again, and host/segment entries."""
    sites = pages.select(*site_of()).where("host <> ''").distinct()
    number = lambda c, i: F.conv(F.substring(F.md5(c), i, 2), 16, 10).cast("int")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    entry = lambda action, when, category: F.struct(F.lit(action).alias("action"), F.lit(category).alias("category"), day(when).alias("listed_on"))
    hosts = sites.select(F.col("host").alias("pattern")).distinct().where(number(F.col("pattern"), 1) < 96)
    h = F.col("pattern")
    hosts = hosts.select("pattern", F.explode(F.array(entry("add", number(h, 3), "host"), entry("remove", number(h, 3) + number(h, 5) % 60, "host"), entry("add", number(h, 3) + 60 + number(h, 7) % 90, "host"))).alias("e"))
    paths = sites.where("segment <> ''").select(F.concat("host", F.lit("/"), "segment").alias("pattern")).where(number(h, 1) < 64)
    paths = paths.select("pattern", F.explode(F.array(entry("add", number(h, 3), "path"), entry("remove", number(h, 3) + 100, "path"))).alias("e"))
    return hosts.unionByName(paths).select("pattern", "e.action", "e.category", "e.listed_on")


ORACLE = r"""
with c as (
  select page_id, url, date '2024-01-01' + ((page_id % 366 + 366) % 366)::int as fetched_on,
         regexp_replace(lower(regexp_extract(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/:?#\[\]]+)(?::\d*)?(?:/([^/?#]*))?', 1)), '\.$', '') as host,
         regexp_extract(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/:?#\[\]]+)(?::\d*)?(?:/([^/?#]*))?', 2) as segment
  from pages),
s as (select distinct host, segment from c where host <> ''),
n as (select p, kind, ('0x' || substr(md5(p), 1, 2))::int as a, ('0x' || substr(md5(p), 3, 2))::int as b, ('0x' || substr(md5(p), 5, 2))::int as x, ('0x' || substr(md5(p), 7, 2))::int as y
      from (select distinct host as p, 'host' as kind from s union all select host || '/' || segment, 'path' from s where segment <> '')),
e as (select p, kind, 'add' as action, b as d from n where kind = 'host' and a < 96
      union all select p, kind, 'remove', b + x % 60 from n where kind = 'host' and a < 96
      union all select p, kind, 'add', b + 60 + y % 90 from n where kind = 'host' and a < 96
      union all select p, kind, 'add', b from n where kind = 'path' and a < 64
      union all select p, kind, 'remove', b + 100 from n where kind = 'path' and a < 64),
v as (select p as pattern, kind as category, action, date '2024-01-01' + d::int as valid_from,
             lead(date '2024-01-01' + d::int) over (partition by p order by d, action, kind) as valid_to from e),
m as (select c.page_id, c.url, c.fetched_on, c.host, v.*,
             row_number() over (partition by c.page_id, c.url order by length(v.pattern) desc, v.valid_from, v.pattern desc) as rn
      from c join v on v.action = 'add' and (v.valid_to is null or v.valid_to > v.valid_from)
           and v.valid_from <= c.fetched_on and (v.valid_to is null or c.fetched_on < v.valid_to)
           and (v.pattern = c.host or v.pattern = c.host || '/' || c.segment
                or ends_with(c.host, '.' || v.pattern) or ends_with(c.host || '/' || c.segment, '.' || v.pattern)))
select c.page_id, c.url, c.fetched_on::varchar as fetched_on, c.host, m.pattern is not null as blocked, m.pattern, m.category, m.valid_from::varchar as valid_from
from c left join m on c.page_id = m.page_id and c.url = m.url and m.rn = 1
"""
