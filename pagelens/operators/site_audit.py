"""Site audits over fetched responses, and the smaller operators around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions import urls
from pagelens.functions.numbers import points, score, status
from pagelens.operators import scores
from pagelens.operators.scores import flag
from pagelens.sources import pages as P

c = F.col


# -- page elements ----------------------------------------------------------------


def images(html: Column) -> Column:
    """array<struct<src, alt, loading, width, height>> of images that have a source."""
    each = F.transform(P.tags(html, "img"), lambda t: F.struct(*[P.attribute(t, n).alias(n) for n in ("src", "alt", "loading", "width", "height")]))
    return F.filter(each, lambda i: i["src"] != "")


def alt_ratio(found: Column) -> Column:
    return F.when(F.size(found) == 0, 1.0).otherwise(F.bround(F.size(F.filter(found, lambda i: F.trim(i["alt"]) != "")) / F.size(found), 2))


def sync_scripts(html: Column) -> Column:
    """How many external scripts are neither async nor deferred."""
    return F.size(F.filter(P.tags(html, "script"), lambda t: (P.attribute(t, "src") != "") & ~t.rlike(r"(?i)\s(async|defer)\b")))


def stylesheets(html: Column) -> Column:
    return F.size(F.filter(P.tags(html, "link"), lambda t: F.lower(P.attribute(t, "rel")).contains("stylesheet")))


def meta_robots(html: Column) -> Column:
    named = F.filter(P.tags(html, "meta"), lambda t: F.lower(P.attribute(t, "name")) == "robots")
    return F.array_join(F.filter(F.transform(named, lambda t: F.lower(F.trim(P.attribute(t, "content")))), lambda v: v != ""), ", ")


def analytics(html: Column) -> Column:
    low = F.lower(html)
    verified = F.exists(P.tags(html, "meta"), lambda t: F.lower(P.attribute(t, "name")) == "google-site-verification")
    return F.struct((low.contains("googletagmanager.com/gtag/js") | low.contains("gtag(") | html.contains("G-") & html.rlike(r"\bG-[A-Z0-9]{4,}\b")).alias("ga4"), (low.contains("googletagmanager.com/gtm.js") | html.contains("GTM-") & html.rlike(r"\bGTM-[A-Z0-9]{4,}\b")).alias("gtm"), verified.alias("gsc_verification"))


def nofollow_internal(html: Column, base: Column) -> Column:
    inside = lambda h: (h != "") & (~F.startswith(h, F.lit("http")) | (urls.host(F.lower(h)) == urls.host(base)))
    return F.size(F.filter(P.tags(html, "a"), lambda t: inside(P.attribute(t, "href")) & F.array_contains(F.split(F.lower(P.attribute(t, "rel")), r"\s+"), "nofollow")))


def hreflang_candidates(html: Column, base: Column, locale: Column) -> Column:
    """Alternate URLs whose base locale is the one asked for, first-seen order."""
    named = F.filter(P.tags(html, "link"), lambda t: urls.base_locale(P.attribute(t, "hreflang")) == urls.base_locale(locale))
    return F.array_distinct(F.transform(named, lambda t: urls.absolute(P.attribute(t, "href"), base)))


def locale_link_candidates(html: Column, base: Column, locale: Column) -> Column:
    found = F.transform(P.tags(html, "a"), lambda t: urls.absolute(F.trim(P.attribute(t, "href")), base))
    return F.array_distinct(F.filter(found, lambda u: u.rlike("^https?://") & (urls.base_locale(urls.explicit_locale(u)) == urls.base_locale(locale))))


def target_scope(responses: DataFrame) -> DataFrame:
    """responses (site, url, html, requested_locale) -> site, scope_url, rule: the page itself if its locale is the one
    asked for, else the first of hreflang, link, path and subdomain candidates; conflict where none fits."""
    base, wanted = urls.normalize_url(c("url")), c("requested_locale")
    own = F.coalesce(urls.base_locale(F.nullif(P.attribute(F.regexp_extract("html", r"(?is)<html\b[^>]*>", 0), "lang"), F.lit(""))), urls.base_locale(urls.explicit_locale(base)))
    root = urls.site_root(base)
    path = F.concat(root, F.lit("/"), F.lower(wanted), F.lit("/"))
    rows = responses.withColumns({"base": base, "own": own, "h": F.get(hreflang_candidates(F.coalesce("html", F.lit("")), base, wanted), F.lit(0)), "l": F.get(locale_link_candidates(F.coalesce("html", F.lit("")), base, wanted), F.lit(0)), "p": path})
    rule = F.when(wanted.isNull() | (c("own") == urls.base_locale(wanted)), "same").when(c("h").isNotNull(), "hreflang").when(c("l").isNotNull(), "link").when(c("own").isNull(), "path").otherwise("conflict")
    return rows.select("site", F.when(rule == "same", c("base")).when(rule == "hreflang", c("h")).when(rule == "link", c("l")).when(rule == "path", c("p")).alias("scope_url"), rule.alias("rule"))


def entry_responses(sites: DataFrame, responses: DataFrame) -> DataFrame:
    """sites (site, url), responses (url, status, …) -> the first entry variant of each site that answers below 400."""
    tried = sites.select("site", F.posexplode(urls.entry_candidates(urls.normalize_url(c("url")))).alias("ord", "url"))
    answered = tried.join(responses.where("status < 400"), "url")
    order = Window.partitionBy("site").orderBy("ord")
    return answered.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def variant_checks(sites: DataFrame, responses: DataFrame) -> DataFrame:
    """sites (site, url), responses (url, final_url) -> whether the http and the www variants end at the preferred host."""
    preferred = urls.normalize_url(c("url"))
    each = sites.select("site", urls.host(preferred).alias("host"), F.explode(urls.entry_candidates(preferred)).alias("url"))
    seen = each.join(responses, "url", "left").withColumn("lands", (urls.scheme(c("final_url")) == "https") & (urls.host(c("final_url")) == c("host")))
    return seen.groupBy("site").agg(F.coalesce(F.bool_and(F.when(F.startswith(c("url"), F.lit("http://")), F.coalesce("lands", F.lit(False)))), F.lit(False)).alias("https_ok"), F.coalesce(F.bool_and(F.coalesce("lands", F.lit(False))), F.lit(False)).alias("hosts_ok"))


# -- module audits ------------------------------------------------------------------

# Weights of the technical audit.
TECHNICAL = {"https": 8, "meta_description": 5, "canonical": 5, "lang": 4, "unique_h1": 4, "sitemap": 8, "robots_sitemap_directive": 4, "open_graph": 5, "twitter_card": 3, "hreflang": 4, "revalidation": 4}


def technical_audit(responses: DataFrame) -> DataFrame:
    """responses (site, url, html, headers, milliseconds, has_sitemap, robots_has_sitemap, word_count) -> checks and score.

    Header names count in any case.
    """
    html = F.coalesce("html", F.lit(""))
    names = F.transform(F.map_keys("headers"), lambda k: F.lower(k))
    found = responses.withColumns({
        "https": F.startswith(c("url"), F.lit("https://")), "meta_description": P.meta_content(html, "description").isNotNull(), "canonical": F.exists(P.tags(html, "link"), lambda t: F.lower(P.attribute(t, "rel")) == "canonical"),
        "lang": P.attribute(F.regexp_extract(html, r"(?is)<html\b[^>]*>", 0), "lang") != "", "unique_h1": F.size(F.filter(P.headings(html), lambda h: h["level"] == "h1")) == 1, "sitemap": flag("has_sitemap"),
        "robots_sitemap_directive": flag("robots_has_sitemap"), "open_graph": F.exists(P.tags(html, "meta"), lambda t: F.startswith(F.lower(P.attribute(t, "property")), F.lit("og:"))), "twitter_card": F.exists(P.tags(html, "meta"), lambda t: F.startswith(F.lower(P.attribute(t, "name")), F.lit("twitter:"))),
        "hreflang": F.exists(P.tags(html, "link"), lambda t: P.attribute(t, "hreflang") != ""), "revalidation": F.array_contains(names, "etag") | F.array_contains(names, "last-modified"),
        "ssr_score": scores.ssr_signal(F.length(html), c("word_count")), "security_score": scores.security_headers(c("headers")), "image_score": scores.image_score(images(html)), "render_score": scores.render_blocking(sync_scripts(html), stylesheets(html)), "performance_score": scores.performance_score(c("milliseconds")),
    })
    shares = [(10, "ssr_score"), (16, "security_score"), (4, "image_score"), (8, "render_score"), (8, "performance_score")]
    total = points(*[(w, flag(n)) for n, w in TECHNICAL.items()]).cast("double")
    for weight, name in shares:
        total = total + c(name) / 100.0 * weight
    out = found.withColumn("technical_score", score(total))
    return out.select("site", *TECHNICAL, *[n for _, n in shares], "technical_score", status(c("technical_score")).alias("status"))


def structured_data_score() -> Column:
    """Of a site's structured data (the columns of sources.structured.summarize)."""
    aligned = F.coalesce(c("visible_alignment_score"), F.lit(0))
    return score(
        points((8, flag("json_ld_present")), (12, flag("has_organization")), (6, flag("has_website")), (9, flag("has_service")), (9, flag("has_article")), (7, flag("has_faq_page")), (9, flag("has_product")), (5, flag("has_defined_term")), (8, F.size("same_as") > 0), (4, c("entity_id_count") >= 2), (4, c("relation_count") >= 3), (4, flag("has_breadcrumb_list")), (4, flag("has_date_published")), (4, flag("has_date_modified")))
        + F.when(aligned >= 60, 7).when(aligned >= 30, 3).otherwise(0)
    )


def site_structured_data(pages: DataFrame) -> DataFrame:
    """pages (site_id + structured data) -> a row per site: unions of the sets, sums of relations, mean alignment."""
    flags = [n for n, kind in pages.dtypes if n.startswith("has_") and kind == "boolean"]
    merged = pages.groupBy("site_id").agg(F.bool_or("json_ld_present").alias("json_ld_present"), *[F.bool_or(n).alias(n) for n in flags], F.array_sort(F.array_distinct(F.flatten(F.collect_set("same_as")))).alias("same_as"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("types")))).alias("types"), F.sum("relation_count").alias("relation_count"), F.max("entity_id_count").alias("entity_id_count"), F.bround(F.avg("visible_alignment_score"), 0).cast("int").alias("visible_alignment_score"), F.count_if(flag("has_date_published") | flag("has_date_modified")).alias("dated_pages"))
    return merged.withColumn("structured_data_score", structured_data_score())


def site_content_score(key_pages: DataFrame) -> DataFrame:
    """key_pages (site_id, kind + profile columns) -> the content score of each site from its key pages."""
    words = lambda kind: F.coalesce(F.max(F.when(c("kind") == kind, c("word_count"))), F.lit(0))
    anywhere = lambda name: F.coalesce(F.bool_or(name), F.lit(False)).alias(name)
    names = {"has_faq": 8, "has_author": 10, "has_publish_date": 7, "has_quantified_data": 12, "has_reference_section": 6, "has_inline_citations": 4, "has_tldr": 4, "answer_first": 8}
    link = F.bround(c("descriptive_internal_link_ratio") * 55.0 + c("descriptive_external_link_ratio") * 45.0, 0)
    means = {"heading": (12, c("heading_quality_score")), "density": (10, c("information_density_score")), "chunks": (8, c("chunk_structure_score")), "link": (6, link)}
    out = key_pages.groupBy("site_id").agg(words("service").alias("service_words"), words("article").alias("article_words"), *[anywhere(n) for n in names], *[F.avg(v).alias(n) for n, (_, v) in means.items()])
    total = (F.when(c("service_words") >= 400, 15).when(c("service_words") >= 200, 7).otherwise(0) + F.when(c("article_words") >= 800, 20).when(c("article_words") >= 400, 10).otherwise(0) + points(*[(w, c(n)) for n, w in names.items()])).cast("double")
    for n, (weight, _) in means.items():
        total = total + c(n) / 100.0 * weight
    return out.withColumn("content_score", score(total))


# -- cache, text limits, localisation ----------------------------------------------------


def cache_key(url: Column, task: Column, mode: Column, full: Column, most_pages: Column, feedback_lang: Column, target_locale: Column, provider: Column | None = None, model: Column | None = None) -> Column:
    """SHA-256 of what decides a result; the page limit counts for full audits only, the model for premium mode only."""
    premium = mode == "premium"
    other = lambda v: F.when(premium, F.coalesce(v if v is not None else F.lit(None).cast("string"), F.lit("default"))).otherwise("none")
    named = F.concat_ws("|", task, urls.scope_root(urls.normalize_url(url)), mode, other(provider), other(model), F.concat(F.lit("full="), full.cast("int").cast("string")), F.concat(F.lit("pages="), F.when(full, most_pages).otherwise(5).cast("string")), F.concat(F.lit("lang="), feedback_lang), F.concat(F.lit("target_locale="), F.coalesce(target_locale, F.lit("auto"))))
    return F.sha2(named, 256)


def live_results(cache: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Cached rows (key, saved_at, …) younger than the limit, the latest of each key."""
    young = cache.where(c("saved_at") + F.make_interval(days=F.lit(days)) > now)
    order = Window.partitionBy("key").orderBy(c("saved_at").desc())
    return young.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def first_bytes(text: Column, most: int) -> Column:
    """The longest prefix of whole characters within so many UTF-8 bytes."""
    cut = F.substring(F.encode(text, "utf-8"), 1, most)
    whole = F.expr("true") if most <= 0 else F.octet_length(text) <= most
    # a cut character leaves one to three bytes at the end that do not decode
    tries = [F.try_validate_utf8(F.substring(cut, 1, most - k).cast("string")) for k in range(4)]
    return F.when(whole, text).otherwise(F.coalesce(*tries))


def localize(rows: DataFrame, column: str, phrases: DataFrame, templates: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """Replace exact phrases by their translation (phrases: source, target), then pattern templates in order; others stay."""
    joined = rows.join(phrases.select(c("source").alias(column), "target").dropDuplicates([column]), column, "left")
    text = c(column)
    for pattern, replacement in templates:
        text = F.regexp_replace(text, pattern, replacement)
    return joined.withColumn(column, F.coalesce("target", text)).select(rows.columns)


def projected_score(value: Column) -> Column:
    """Where a score can get: 20 more below 60, else 10, at most 100."""
    return F.least(F.lit(100), value + F.when(value < 60, 20).otherwise(10))


def progress(steps: DataFrame) -> DataFrame:
    """steps (task_id, status) -> whole percent of each task's steps that are completed."""
    return steps.groupBy("task_id").agg((F.count_if(c("status") == "completed") * 100 / F.count("*")).cast("int").alias("progress"))


