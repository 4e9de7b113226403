"""Fetched pages to typed facts, with built-in functions only.

The table of pages (page_id, url, html) is the scan; parsing is regular expressions
over each page's html, so it stays in the JVM.  Each step of it is fixed (see `fixed`):
later steps read its columns instead of parsing the page again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions import urls
from pagelens.functions.text import once

# The character references that are decoded.
ENTITIES = {"&nbsp;": " ", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&lt;": "<", "&gt;": ">", "&copy;": "©", "&reg;": "®", "&middot;": "·", "&ndash;": "–", "&mdash;": "—", "&hellip;": "…", "&euro;": "€", "&amp;": "&"}
HIDDEN = ("script", "style", "template")


def fixed(df: DataFrame, *names: str) -> DataFrame:
    """df with the named columns computed once a row, whatever reads them.

    The optimizer merges projections and so repeats a column's expression wherever the
    column is used, for each element inside functions over arrays; it does not merge
    them through the expansion of a one-row array.
    """
    others = [c for c in df.columns if c not in names]
    return df.select(*others, F.inline(F.array(F.struct(*names)))).select(df.columns)


#: Bytes a core of a table that is dealt before its texts are searched; a larger one has splits enough, and moving it would cost more than it saves.
SMALL_SHARE = 32 << 20


def dealt(df: DataFrame) -> DataFrame:
    """A small table of few splits is dealt over all cores before its texts are searched; any other stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df if size > cores * SMALL_SHARE or df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


#: Bytes of the files of pages that one task parses.
PAGES_SHARE = 4 << 20


def parted(pages: DataFrame) -> DataFrame:
    """pages dealt over at least two tasks a core, and more the larger the table is, so no task grows with it.

    Files split by row groups, of which a file of pages may have one; and to parse a page takes far longer than to move it.
    """
    size = int(str(pages._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return pages.repartition(max(2 * pages.sparkSession.sparkContext.defaultParallelism, -(-size // PAGES_SHARE)))


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def decoded(text: Column) -> Column:
    """Character references decoded; text should be a column or an element, since it is read twice."""
    pairs = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(letter).alias("letter")) for name, letter in ENTITIES.items()])
    # to look for a reference is cheaper than to replace it where it is not
    plain = F.aggregate(pairs, text, lambda t, p: F.when(t.contains(p["name"]), F.replace(t, p["name"], p["letter"])).otherwise(t))
    return F.when(text.contains("&"), plain).otherwise(text)


def visible(html: Column) -> Column:
    """Text outside tags, comments and hidden elements; white space is one space."""
    return bare(shown(html))


def bare(html: Column) -> Column:
    """visible, of html that is shown already."""
    # single spaces stay as they are: most are
    return once(F.regexp_replace(html, r"<[^>]*>", " "), lambda t: F.trim(F.regexp_replace(decoded(t), r"\s{2,}|[^\S ]", " ")))


def shown(html: Column) -> Column:
    """html without comments and hidden elements."""
    for pattern in [r"(?s)<!--.*?-->", *(rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>" for tag in HIDDEN)]:
        html = F.regexp_replace(html, pattern, " ")
    return html


def attribute(tag: Column, name: str) -> Column:
    """An attribute's decoded value; empty if it is missing."""
    pattern = rf"(?is)\b{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))"
    return once(F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)]), decoded)


def tags(html: Column, name: str) -> Column:
    """Every opening tag of this name, with its attributes."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\b[^>]*>"), F.lit(0))


def meta_content(html: Column, *names: str) -> Column:
    """The first non-empty content of meta elements with one of these names or properties."""
    wanted = [n.lower() for n in names]
    named = F.filter(tags(html, "meta"), lambda t: F.lower(attribute(t, "name")).isin(wanted) | F.lower(attribute(t, "property")).isin(wanted))
    return F.get(F.filter(F.transform(named, lambda t: F.trim(attribute(t, "content"))), lambda c: c != ""), F.lit(0))


def headings(html: Column) -> Column:
    """array<struct<level, text>> of h1 to h6 of shown html in order, empty ones left out."""
    whole = F.regexp_extract_all(html, F.lit(r"(?is)<h[1-6]\b[^>]*>.*?</h[1-6]\s*>"), F.lit(0))
    each = F.transform(whole, lambda h: F.struct(F.lower(F.substring(h, 2, 2)).alias("level"), bare(h).alias("text")))
    return F.filter(each, lambda h: h["text"] != "")


def anchors(html: Column, url: Column, root: Column, folder: Column) -> Column:
    """array<struct<url, text>> of the anchors of shown html that lead to pages, absolute."""
    whole = F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*\bhref\b[^>]*>.*?</a\s*>"), F.lit(0))
    each = F.transform(whole, lambda a: F.struct(once(F.trim(attribute(F.regexp_extract(a, r"(?is)^<a\b[^>]*>", 0), "href")), lambda h: urls.resolved(h, url, root, folder)).alias("url"), bare(a).alias("text")))
    return F.filter(each, lambda x: x["url"].rlike("^https?://"))


def first_of_each(links: str) -> Column:
    """The first anchor of each URL; links: a column that is computed already."""
    addresses = F.transform(links, lambda x: x["url"])
    places = F.transform(F.array_distinct(addresses), lambda u: F.array_position(addresses, u))
    return F.transform(places, lambda i: F.element_at(links, i.cast("int")))


def page_facts(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> one row each with url parts, text, metadata, headings and links.

    Null html reads as an empty page; a null or empty url gives null url columns.
    """
    html = F.coalesce("html", F.lit(""))
    out = fixed(pages.select("page_id", "url", urls.normalize_url(F.col("url")).alias("page_url"), html.alias("raw"), shown(html).alias("html")), "page_url", "raw", "html")
    base = F.col("page_url")
    out = out.withColumns({"host": urls.host(base), "root": urls.site_root(base), "prefix": urls.scope_prefix(base), "folder": urls.folder(base)})
    out = fixed(out, "host", "root", "prefix", "folder")
    links = F.filter(tags(F.col("html"), "link"), lambda t: F.lower(attribute(t, "rel")) == "canonical")
    out = out.select(
        "page_id", "url", "page_url", "raw", "html", "host", "root", "prefix",
        urls.site_id(base).alias("site_id"), F.concat("root", "prefix").alias("scope_root"), urls.url_type(base).alias("url_type"),
        F.nullif(visible(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title\s*>", 1)), F.lit("")).alias("title"),
        F.nullif(F.lower(attribute(F.regexp_extract("html", r"(?is)<html\b[^>]*>", 0), "lang")), F.lit("")).alias("lang"),
        bare(F.col("html")).alias("text"),
        meta_content(F.col("html"), "description").alias("meta_description"),
        F.nullif(F.get(F.transform(links, lambda t: attribute(t, "href")), F.lit(0)), F.lit("")).alias("canonical"),
        headings(F.col("html")).alias("headings"), anchors(F.col("html"), base, F.col("root"), F.col("folder")).alias("anchors"),
        F.regexp_extract_all("raw", F.lit(r"(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script\s*>"), F.lit(1)).alias("json_ld"),
        F.length("raw").alias("html_length"),
    )
    out = fixed(out, "site_id", "url_type", "title", "lang", "text", "meta_description", "canonical", "headings", "anchors", "json_ld", "html_length")
    out = fixed(out.withColumn("links", first_of_each("anchors")), "links")
    locale = F.coalesce(urls.base_locale(F.col("lang")), urls.base_locale(urls.explicit_locale(F.col("page_url"))))
    inside = F.transform("links", lambda x: F.struct(x.alias("link"), urls.is_inside(x["url"], F.col("host"), F.col("prefix")).alias("inside")))
    out = fixed(out.withColumns({"locale": locale, "sided": inside}), "locale", "sided")
    side = lambda keep: F.transform(F.filter("sided", lambda x: x["inside"] == keep), lambda x: x["link"])
    return fixed(out.withColumns({"internal_links": side(True), "external_links": side(False)}), "internal_links", "external_links").drop("anchors", "sided", "root", "prefix")
