"""robots.txt for every URL: entries of a body, and the rules that decide a path, as a join on prefixes.

A URL is cut to the lengths that its site's rules have, a handful, and meets the rules of
that site and prefix by equality; no URL is compared with every rule.  Two ways of
deciding exist: the first rule in the file that matches (the crawler's own check) and
the longest (the check of the crawlers of models), Allow before Disallow when as long.
"""

from __future__ import annotations

from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRIES = "array<struct<agents:array<string>,rules:array<struct<allow:boolean,path:string>>>>"
RULE_LINES = ("allow", "disallow", "crawl-delay", "request-rate")


def parsed_entries(body: str | None) -> list[tuple[list[str], list[tuple[bool, str]]]]:
    """Entries of a body in order: agents and rules.

    An empty line ends an entry, and drops agents that no rule followed; agents after a rule start the next; rules before any
    agent are nobody's.  An empty Disallow allows.
    """
    found, agents, rules, ruled = [], [], [], False

    def end() -> None:
        nonlocal agents, rules, ruled
        if ruled:
            found.append((agents, rules))
        agents, rules, ruled = [], [], False

    for raw in (body or "").splitlines():
        if not raw:
            end()
        key, colon, value = raw.partition("#")[0].strip().partition(":")
        key, value = key.strip().lower(), unquote(value.strip())
        if not colon:
            continue
        if key == "user-agent":
            if ruled:
                end()
            agents.append(value)
        elif key in RULE_LINES and agents:
            ruled = True
            if key in ("allow", "disallow"):
                rules.append((key == "allow" or not value, value))
    end()
    return found


def entries(robots: DataFrame) -> DataFrame:
    """robots (site, body) -> site, entry, agents, rules; a site with several bodies has the entries of each."""

    def parse(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: [{"agents": a, "rules": [{"allow": x, "path": p} for x, p in r]} for a, r in parsed_entries(b)])

    listed = F.pandas_udf(parse, ENTRIES)(F.col("body"))
    return robots.select("site", F.posexplode(listed).alias("entry", "e")).select("site", "entry", "e.agents", "e.rules")


def rules_of(robots: DataFrame, crawler: str) -> DataFrame:
    """site, pos, allow, path of the entry that speaks to a crawler: the first that names a part of its name, else the first for *."""
    name = crawler.partition("/")[0].lower()
    named = F.exists("agents", lambda a: (a != "*") & F.lit(name).contains(F.lower(a)))
    every = F.exists("agents", lambda a: a == "*")
    meant = entries(robots).withColumn("rank", F.when(named, F.lit(0)).when(every, F.lit(1))).where("rank is not null")
    first = meant.groupBy("site").agg(F.min_by("rules", F.struct("rank", "entry")).alias("rules"))
    return first.select("site", F.posexplode("rules").alias("pos", "r")).select("site", "pos", "r.allow", "r.path")


def target(url: Column) -> Column:
    """What rules are compared with: all after the host, decoded; / if that is empty."""
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    decoded = F.coalesce(F.try_url_decode(F.replace(rest, F.lit("+"), F.lit("%2B"))), rest)
    return F.when(decoded == "", "/").otherwise(decoded)


def matches(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (page_id, site, target) and rules (site, prefix, …) -> the rules that match each page, by equality of prefixes."""
    rules = rules.withColumn("size", F.length("prefix"))
    lengths = rules.groupBy("site").agg(F.array_sort(F.collect_set("size")).alias("sizes"))  # a rule has at most a few thousand characters
    cuts = pages.join(lengths, "site").select("page_id", "site", "target", F.explode("sizes").alias("size")).where(F.length("target") >= F.col("size"))
    cuts = cuts.withColumn("prefix", F.expr("substring(target, 1, size)")).drop("target")
    return cuts.join(rules, ["site", "size", "prefix"])


def first_match(pages: DataFrame, robots: DataFrame, crawler: str = "Googlebot") -> DataFrame:
    """pages (page_id, site, target) -> page_id, allowed, rule: by the first rule of the crawler's entry that matches; no rule allows."""
    found = matches(pages, rules_of(robots, crawler).withColumnRenamed("path", "prefix"))
    first = found.groupBy("page_id").agg(F.min(F.struct("pos", "allow", "prefix")).alias("first"))
    out = pages.select("page_id").distinct().join(first, "page_id", "left")
    return out.select("page_id", F.coalesce("first.allow", F.lit(True)).alias("allowed"), F.col("first.prefix").alias("rule"))


def longest_match(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (page_id, site, target), rules (site, directive, path) -> page_id, allowed: the longest match decides, Allow on ties.

    An empty path matches every target with length 0.
    """
    prefixed = rules.select("site", "directive", F.length("path").alias("own"), F.when(F.col("path") == "", "/").otherwise(F.col("path")).alias("prefix"))
    found = matches(pages, prefixed)
    best = lambda d: F.coalesce(F.max(F.when(F.col("directive") == d, F.col("own"))), F.lit(-1))
    decided = found.groupBy("page_id").agg((best("allow") >= best("disallow")).alias("allowed"))
    return pages.select("page_id").distinct().join(decided, "page_id", "left").select("page_id", F.coalesce("allowed", F.lit(True)).alias("allowed"))


def agent_rules(rules: DataFrame, crawler: str) -> DataFrame:
    """Of rules (site, agent, directive, path) those for a crawler: its own if the site names it, else those for *."""
    name = crawler.lower()
    named = rules.where(F.col("agent") == name).select("site").distinct()
    return rules.where(F.col("agent") == name).unionByName(rules.where(F.col("agent") == "*").join(named, "site", "left_anti"))
