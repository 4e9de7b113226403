"""Inputs that the tables do not hold, drawn from what they do: page elements by page id, response figures by site id.

The given pages have no metadata, images or structured data, and there is no table of
responses.  The site queries add both by fixed rules over the whole table, so that
every rule of the audits meets cases that hold and cases that do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.sources.pages import fixed

_LONG = "What this page is about, who wrote it, when it was checked and which sources it cites, in one plain sentence."
#: Elements appended to a page's html; one expression that Spark and DuckDB both read.
ELEMENTS = f"""concat(coalesce(html, ''),
 case when page_id % 2 = 0 then concat('<meta name="description" content="', case when page_id % 4 = 0 then '{_LONG}' else 'Short text' end, '">') else '' end,
 case when page_id % 3 = 0 then concat('<link rel="canonical" href="', coalesce(url, ''), case when page_id % 9 = 0 then 'x' else '' end, '">') else '' end,
 case when page_id % 5 < 3 then '<meta property="og:title" content="t">' else '' end, case when page_id % 7 < 3 then '<meta name="twitter:card" content="summary">' else '' end,
 case when page_id % 3 < 2 then '<meta name="viewport" content="width=device-width">' else '' end, case when page_id % 6 = 1 then '<link rel="alternate" hreflang="fr-FR" href="/fr/">' else '' end,
 case when page_id % 11 = 0 then '<meta name="robots" content="noindex, follow">' else '' end, case when page_id % 4 < 2 then '<script src="/g.js"></script><meta name="google-site-verification" content="v"><script async src="https://www.googletagmanager.com/gtag/js"></script>' else '' end,
 case when page_id % 2 = 0 then '<img src="/a.png" alt="a" loading="lazy" width="9" height="9">' else '' end, case when page_id % 5 = 0 then '<img src="/b.png" alt="" loading="eager">' else '' end,
 case page_id % 4 when 0 then '<script type="application/ld+json">{{"@type":"Organization","@id":"#o","sameAs":["https://social.example/x"],"brand":{{}},"founder":{{"@id":"#f"}}}}</script>'
  when 1 then '<script type="application/ld+json">{{"@type":"Article","headline":"words that stand on no page","datePublished":"2024-01-01","dateModified":"2024-02-01"}}</script>'
  when 2 then '<script type="application/ld+json">[{{"@type":"FAQPage","about":{{"@type":"DefinedTerm"}},"mentions":{{"@type":"Service"}},"offers":{{"@type":"Product"}}}},{{"@type":"WebSite"}}]</script>' else '' end)"""


def with_elements(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.expr(ELEMENTS).alias("html"))


INPUTS = ["robots_exists", "robots_has_sitemap", "crawlers", "crawlers_allowed", "sitemap_exists", "sitemap_https", "sitemap_clean", "same_domain_sitemap", "llms_preview", "llms_length", "https_ok", "hosts_ok", "milliseconds", "etag", "last_modified", "security_count", "authority", "domains", "ip_classes", "follow", "target_locale"]


def site_inputs(site_ids: DataFrame) -> DataFrame:
    """site_id -> the inputs of modules.audited, by the bytes of the id."""
    return site_ids.select("site_id", *[v.alias(n) for n, v in _drawn().items()])


def with_inputs(sites: DataFrame) -> DataFrame:
    """sites joined with their inputs: these are a rule over the id, so neither the pages are read for them again nor rows moved."""
    drawn = {n: F.when(F.col("site_id").isNotNull(), v) for n, v in _drawn().items()}
    return fixed(sites.withColumns(drawn), *drawn)


def _drawn() -> dict[str, Column]:
    k = lambda i: F.conv(F.substring("site_id", 2 * i - 1, 2), 16, 10).cast("int")
    preview = F.lit("# Guide\nOur service and platform.\nPreferred citation: contact us.")
    each = (
        (k(1) < 230), (k(1) < 160), F.lit(8), (8 - k(2) % 3),
        (k(3) < 200), (k(3) % 7 != 0), (k(3) % 5 != 0), (k(4) % 6 != 0),
        F.when(k(5) % 2 == 0, preview), F.when(k(5) % 2 == 0, 100 + k(5) * 2).otherwise(0), (k(6) < 200), (k(6) % 3 != 0),
        (100 + k(7) * 8), (k(8) % 2 == 0), (k(8) % 3 == 0), (k(8) % 6),
        F.when(k(9) >= 128, k(9) % 101), (k(10) * 3), k(11), (k(12) / 256), F.when(k(13) < 40, "fr"),
    )
    return dict(zip(INPUTS, each))


_K = lambda i: f"('0x' || substr(site_id, {2 * i - 1}, 2))::int"
SQL_INPUTS = f"""(select site_id, {_K(1)} < 230 as robots_exists, {_K(1)} < 160 as robots_has_sitemap, 8 as crawlers, 8 - {_K(2)} % 3 as crawlers_allowed, {_K(3)} < 200 as sitemap_exists, {_K(3)} % 7 <> 0 as sitemap_https, {_K(3)} % 5 <> 0 as sitemap_clean,
 {_K(4)} % 6 <> 0 as same_domain_sitemap, case when {_K(5)} % 2 = 0 then '# Guide' || chr(10) || 'Our service and platform.' || chr(10) || 'Preferred citation: contact us.' end as llms_preview, case when {_K(5)} % 2 = 0 then 100 + {_K(5)} * 2 else 0 end as llms_length,
 {_K(6)} < 200 as https_ok, {_K(6)} % 3 <> 0 as hosts_ok, 100 + {_K(7)} * 8 as milliseconds, {_K(8)} % 2 = 0 as etag, {_K(8)} % 3 = 0 as last_modified, {_K(8)} % 6 as security_count, case when {_K(9)} >= 128 then {_K(9)} % 101 end as authority,
 {_K(10)} * 3 as domains, {_K(11)} as ip_classes, {_K(12)}::double / 256 as follow, case when {_K(13)} < 40 then 'fr' end as target_locale from (select distinct site_id from u))"""
