"""JSON-LD, robots.txt, sitemaps and header maps.

JSON-LD and sitemap XML are recursive and often malformed, so two small Arrow
functions turn them into plain lists; everything after that is built-in functions.
"""

from __future__ import annotations

import html
import json
import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelens.functions.text import once
from pagelens.operators.shared import cut

# Lower-case type families and relation keys, and text and date keys.
ORGANIZATIONS = "organization airline consortium corporation educationalorganization fundingagency governmentorganization localbusiness medicalorganization ngo newsmediaorganization onlinestore performinggroup sportsorganization store travelagency".split()
ARTICLES = "article blogposting newsarticle report scholarlyarticle socialmediaposting techarticle".split()
PRODUCTS = "product productmodel individualproduct someproducts".split()
RELATIONS = frozenset("brand manufacturer haspart offer offers about mentions sameas memberof subjectof knowsabout contactpoint mainentity".split())
TEXT_KEYS = ("name", "headline", "description", "text", "alternateName")
DATE_KEYS = ("datePublished", "dateModified")
# Crawlers whose access is reported.
CRAWLERS = ("GPTBot", "OAI-SearchBot", "ChatGPT-User", "ClaudeBot", "PerplexityBot", "Google-Extended", "Googlebot", "Bingbot")

_STRINGS = T.ArrayType(T.StringType())
JSON_LD = T.StructType([T.StructField("blocks", T.IntegerType()), *[T.StructField(n, _STRINGS) for n in ("types", "same_as", "ids", "texts", "dates")], T.StructField("relations", T.IntegerType())])
SITEMAP = T.StructType([T.StructField("kind", T.StringType()), T.StructField("locations", _STRINGS)])


def plain(text: str) -> str:
    """Unescaped lower-case words separated by single spaces."""
    return " ".join(re.sub(r"[^\w\s]", " ", html.unescape(text or "").lower()).split())


def json_ld_facts(blocks: list[str] | None) -> dict:
    """What the valid blocks say, found by walking them with a stack; @graph counts twice, as a graph and as a value."""
    out = {"blocks": 0, "types": set(), "same_as": set(), "ids": set(), "texts": set(), "dates": set(), "relations": 0}
    for block in blocks if blocks is not None else ():
        try:
            todo = [(json.loads(block), 1)]
        except (ValueError, RecursionError):
            continue
        out["blocks"] += 1
        while todo:
            node, times = todo.pop()
            if isinstance(node, list):
                todo += [(n, times) for n in node]
            if not isinstance(node, dict):
                continue
            kinds = node.get("@type")
            for kind in kinds if isinstance(kinds, list) else [kinds]:
                if isinstance(kind, str) and (short := re.split(r"[/#:]", kind.strip())[-1].strip()):
                    out["types"].add(short)
            same = node.get("sameAs")
            out["same_as"] |= {str(s) for s in same if s} if isinstance(same, list) else {same} if isinstance(same, str) else set()
            if isinstance(node.get("@id"), str) and node["@id"]:
                out["ids"].add(node["@id"])
            out["dates"] |= {k for k in DATE_KEYS if isinstance(node.get(k), str) and node[k].strip()}
            out["texts"] |= {t[:140] for k in TEXT_KEYS if isinstance(node.get(k), str) and 8 <= len(t := plain(node[k])) <= 220}
            out["relations"] += times * sum(k.lower() in RELATIONS and isinstance(v, (dict, list, str)) for k, v in node.items())
            todo += [(v, 2 * times if k == "@graph" else times) for k, v in node.items() if isinstance(v, (dict, list))]
    out["relations"] = min(out["relations"], 2**31 - 1)
    return {k: sorted(v) if isinstance(v, set) else v for k, v in out.items()}


@F.pandas_udf(JSON_LD)
def json_ld(blocks: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([json_ld_facts(b) for b in blocks], columns=["blocks", "types", "same_as", "ids", "texts", "dates", "relations"])


def json_salvage(text: Column) -> Column:
    """The JSON in an answer: the whole text if it parses, else what stands from its first { to its last }, else null."""
    whole = F.trim(text)
    inner = F.regexp_extract(whole, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(whole).isNotNull(), whole).when(F.try_parse_json(inner).isNotNull(), inner)


def summarize(pages: DataFrame, key: str, blocks: str = "json_ld", text: str = "text") -> DataFrame:
    """key, blocks array<string>, text -> key and the structured-data columns that the scorers read."""
    columns = summary_columns(text)
    return pages.select(key, json_ld(F.col(blocks)).alias("f"), text).select(key, *[c.alias(n) for n, c in columns.items()])


def with_summary(pages: DataFrame, blocks: str = "json_ld", text: str = "text") -> DataFrame:
    """pages with the columns of summarize in the same pass, unless they are there already or no blocks are."""
    if blocks not in pages.columns or "json_ld_present" in pages.columns:
        return pages
    return pages.withColumn("f", json_ld(F.col(blocks))).withColumns(summary_columns(text)).drop("f")


def summary_columns(text: str) -> dict[str, Column]:
    """The columns of summarize, from f (JSON_LD) and text."""
    f = F.col
    low = F.transform("f.types", lambda t: F.lower(t))
    has = lambda *names: F.arrays_overlap(low, F.array(*map(F.lit, names)))
    shown = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))
    share = lambda s: F.bround(F.size(F.filter("f.texts", lambda t: s.contains(t))) / F.size("f.texts") * 100, 0).cast("int")
    aligned = once(shown, lambda s: F.when(s == "", 0).otherwise(share(s)))
    score = F.when(f("f.blocks") == 0, 0).when(F.size("f.texts") == 0, 50).otherwise(aligned)
    return {
        "json_ld_present": f("f.blocks") > 0, "types": f("f.types"), "has_organization": has(*ORGANIZATIONS), "has_local_business": has("localbusiness"), "has_article": has(*ARTICLES),
        "has_faq_page": has("faqpage"), "has_service": has("service"), "has_website": has("website"), "has_product": has(*PRODUCTS), "has_defined_term": has("definedterm"),
        "has_offer": has("offer"), "has_breadcrumb_list": has("breadcrumblist"), "has_date_published": F.array_contains("f.dates", "datePublished"), "has_date_modified": F.array_contains("f.dates", "dateModified"),
        "date_signal_count": F.size("f.dates"), "visible_alignment_score": score.cast("int"), "text_item_count": F.size("f.texts"), "entity_id_count": F.size("f.ids"), "relation_count": f("f.relations"), "same_as": f("f.same_as"),
    }


# -- robots.txt ---------------------------------------------------------------


def robots_lines(robots: DataFrame) -> DataFrame:
    """robots (site, body) -> site, pos, directive, value, without comments; lines without a colon are left out."""
    lines = robots.select("site", F.posexplode(F.split(F.coalesce("body", F.lit("")), r"\r\n|\r|\n")).alias("pos", "line"))
    bare = lines.withColumn("line", F.trim(F.split("line", "#", 2)[0])).where(F.col("line").contains(":"))
    return bare.select("site", "pos", F.lower(F.trim(F.split("line", ":", 2)[0])).alias("directive"), F.trim(F.split("line", ":", 2)[1]).alias("value"))


def robots_rules(robots: DataFrame) -> DataFrame:
    """site, agent, directive, path: neighbouring User-agent lines share the rules below them; rules before any go to *."""
    order = Window.partitionBy("site").orderBy("pos")
    own = robots_lines(robots).where(F.col("directive").isin("user-agent", "allow", "disallow"))
    own = own.withColumn("agent_line", F.col("directive") == "user-agent")
    own = own.withColumn("opens", F.col("agent_line") & ~F.coalesce(F.lag("agent_line").over(order), F.lit(False)))
    own = own.withColumn("block", F.sum(F.col("opens").cast("int")).over(order))
    agents = own.where("agent_line").select("site", "block", F.when(F.col("value") == "", "*").otherwise(F.lower("value")).alias("agent"))
    rules = own.where("not agent_line").select("site", "block", "directive", F.col("value").alias("path"))
    out = rules.join(agents, ["site", "block"], "left")
    return out.select("site", F.coalesce("agent", F.lit("*")).alias("agent"), "directive", "path")


def robots_verdicts(robots: DataFrame, crawlers: tuple[str, ...] = CRAWLERS, path: str = "/") -> DataFrame:
    """site, crawler, matched_agent, allowed: the longest matching prefix decides, allow on ties, the own agent before *.

    An empty Disallow matches every path, with length 0, and so blocks.
    """
    sites = robots.select("site").distinct().select("site", F.explode(F.array(*map(F.lit, crawlers))).alias("crawler"))
    rules = robots_rules(robots)
    named = rules.select("site", F.col("agent").alias("own")).distinct()
    asked = sites.join(named, (sites.site == named.site) & (F.lower("crawler") == F.col("own")), "left").select(sites.site, "crawler", F.coalesce("own", F.lit("*")).alias("agent"))
    matches = F.startswith(F.lit(path), F.when(F.col("path") == "", "/").otherwise(F.col("path")))
    longest = lambda kind: F.coalesce(F.max(F.when(matches & (F.col("directive") == kind), F.length("path"))), F.lit(-1))
    return asked.join(rules, ["site", "agent"], "left").groupBy("site", "crawler", F.col("agent").alias("matched_agent")).agg((longest("allow") >= longest("disallow")).alias("allowed"))


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    return robots_lines(robots).where("directive = 'sitemap'").select("site", "pos", F.col("value").alias("sitemap"))


# -- sitemaps -----------------------------------------------------------------


@F.pandas_udf(SITEMAP)
def sitemap_entries(xml: pd.Series) -> pd.DataFrame:
    """urlset or sitemapindex and its locations; what is not XML has none."""
    rows = []
    for text in xml:
        try:
            root = ET.fromstring(text or "")
        except ET.ParseError:
            rows.append((None, []))
            continue
        name = lambda e: e.tag.rpartition("}")[2]
        rows.append((name(root), [e.text.strip() for e in root.iter() if name(e) == "loc" and e.text and e.text.strip()]))
    return pd.DataFrame(rows, columns=["kind", "locations"])


#: Limits of a sitemap's walk, part of the rules: index files followed a site, URLs kept a site.
MOST_INDEXES, MOST_URLS = 10, 50


def sitemap_files(files: DataFrame, starts: DataFrame, most_indexes: int = MOST_INDEXES) -> DataFrame:
    """files (site, url, xml), starts (site, url, ord) -> site, url, place: the sitemap files that each site's walk reads, in its order.

    Breadth first, all sites at once: a level's files are those that its indexes name, in their order, without the files of
    earlier levels.  Of a site the first most_indexes index files are followed.  Each level is cut, so a round's plan is small;
    rounds end with the deepest site, and cycles end since no file comes twice.
    """
    parsed = cut(files.select("site", "url", sitemap_entries("xml").alias("e")).select("site", "url", "e.kind", "e.locations"))
    by_order = Window.partitionBy("site").orderBy("ord")
    firsts = starts.groupBy("site", "url").agg(F.min("ord").alias("ord")).withColumn("ord", F.row_number().over(by_order))
    level, depth = firsts.withColumn("followed", F.lit(0)), 0
    seen: DataFrame | None = None
    while True:
        read = level.join(parsed, ["site", "url"]).withColumn("is_index", (F.col("kind") == "sitemapindex") & (F.size("locations") > 0))
        read = cut(read.withColumn("rank", F.col("followed") + F.sum(F.col("is_index").cast("int")).over(by_order)))
        here = read.select("site", "url", F.struct(F.lit(depth).alias("depth"), "ord").alias("place"), "kind")
        seen = here if seen is None else seen.unionByName(here)
        opened = read.where(F.col("is_index") & (F.col("rank") <= most_indexes))
        named = opened.select("site", "ord", F.posexplode("locations").alias("pos", "url")).groupBy("site", "url").agg(F.min(F.struct("ord", "pos")).alias("at"))
        new = named.join(seen.select("site", "url"), ["site", "url"], "left_anti").withColumn("ord", F.row_number().over(Window.partitionBy("site").orderBy("at"))).drop("at")
        followed = read.groupBy("site").agg(F.max("rank").alias("followed"))
        level, depth = cut(new.join(followed, "site")), depth + 1
        if level.isEmpty():
            return seen.where("kind = 'urlset'").select("site", "url", "place").join(parsed.select("site", "url", "locations"), ["site", "url"])


def sitemap_urls(files: DataFrame, starts: DataFrame, most_indexes: int = MOST_INDEXES, most_urls: int = MOST_URLS) -> DataFrame:
    """files (site, url, xml), starts (site, url, ord) -> site, ord, page: the first most_urls URLs of each site's walk (see sitemap_files)."""
    found = sitemap_files(files, starts, most_indexes).select("site", "place", F.posexplode("locations").alias("pos", "page"))
    first = found.groupBy("site", "page").agg(F.min(F.struct("place", "pos")).alias("at"))
    ranked = first.withColumn("ord", F.row_number().over(Window.partitionBy("site").orderBy("at")))  # a limit by rank is taken before the shuffle
    return ranked.where(F.col("ord") <= most_urls).select("site", "ord", "page")


def llms_preview(body: Column) -> tuple[Column, Column]:
    """What is kept of an llms.txt: its first 500 characters, and its length; null without a body."""
    return F.substring(body, 1, 500), F.coalesce(F.length(body), F.lit(0))


def backlinks(payload: Column) -> Column:
    """The figures of a one-row CSV (; or ,; fields may be quoted) or JSON body; thousands may be parted by commas; what is not a number is null."""
    lines = F.split(payload, r"\r?\n")
    delimiter = F.when(F.get(lines, F.lit(0)).contains(";"), ";").otherwise(",")
    bare = lambda v: F.regexp_replace(F.trim(v), r'^"(.*)"$', "$1")
    # delimiters inside quotes part nothing
    fields_of = lambda i: F.transform(F.split(F.coalesce(F.get(lines, F.lit(i)), F.lit("")), F.concat(delimiter, F.lit(r'(?=(?:[^"]*"[^"]*")*[^"]*$)'))), bare)
    names, values = fields_of(0), fields_of(1)
    fields = ("ascore", "backlinks_num", "domains_num", "ips_num", "ipclass_c_num", "follows_num", "nofollows_num")
    as_json = F.trim(payload).startswith("{")
    plain = lambda v: F.replace(F.trim(v), F.lit(","), F.lit("")).try_cast("double")
    number = lambda name: plain(F.when(as_json, F.get_json_object(payload, f"$.{name}")).otherwise(F.get(values, F.array_position(names, F.lit(name)).cast("int") - 1)))
    follows, nofollows = number("follows_num"), number("nofollows_num")
    return F.struct(*[number(f).cast("long").alias(f) for f in fields], F.when(follows + nofollows > 0, F.bround(follows / (follows + nofollows), 2)).alias("follow_ratio"))
