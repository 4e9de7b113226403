"""The module audits of sites: one aggregation of the pages of a site, joined with what only responses can tell.

Pages (profiles with scores, structured data and elements) are rolled up to one row a
site; the inputs table brings robots, sitemap, llms.txt, headers, timing and backlink
figures.  Every score is a rule over that one row, so all modules of all sites are one
scan, one aggregation and one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions import text as T
from pagelens.functions.numbers import blend, points, score, status
from pagelens.operators import scores
from pagelens.operators.profiles import with_elements
from pagelens.operators.rollup import KEY_PAGES
from pagelens.operators.scores import flag

c = F.col
HOME = ["title", "meta_description", "canonical", "lang", "viewport", "open_graph_present", "twitter_card_present", "hreflang_present", "hreflangs", "h1_count", "first_h1", "html_length", "word_count", "image_score", "lazy_ratio", "sync_scripts", "stylesheets", "ga4", "gsc_verification", "has_publish_date", "has_update_log", "citability_score", "page_url"]
READ = ["has_faq", "has_author", "has_publish_date", "has_quantified_data", "has_reference_section", "has_inline_citations", "has_tldr", "has_update_log", "answer_first", "word_count", "heading_quality_score", "information_density_score", "chunk_structure_score", "descriptive_internal_link_ratio", "descriptive_external_link_ratio"]
CONTENT_KINDS = ("service", "article", "about", "case_study")
TYPES = ["has_organization", "has_local_business", "has_website", "has_service", "has_article", "has_faq_page", "has_product", "has_defined_term", "has_breadcrumb_list", "has_date_published", "has_date_modified"]
SIGNALS = ("company_name_detected", "address_detected", "phone_detected", "email_detected", "awards_detected", "certifications_detected")


def site_facts(profiles: DataFrame) -> DataFrame:
    """profiles (of page_profiles) -> a row per site: its homepage, key pages, structured data, entity signals and counts over its pages.

    The homepage is the page with the shortest, then first, URL; so is each key page among the URLs of its kind.
    """
    pages = with_elements(scores.scored_pages(profiles)).withColumns(T.entity_signals(c("text"), c("title"), c("low_text"), c("has_digits")))
    first = F.struct(F.length("page_url").alias("n"), c("page_url").alias("u"), c("page_id").alias("i"))
    low, n = F.lower("page_url"), F.count_if
    title, meta = F.length(F.coalesce("title", F.lit(""))), F.length(F.coalesce("meta_description", F.lit("")))
    best = F.max(F.struct("citability_score", (-F.length("page_url")).alias("short"), (-c("page_id")).alias("early"), "page_url"))
    status_code, redirected = (c(x) if x in pages.columns else F.lit(d) for x, d in (("status_code", 200), ("redirected", False)))
    each = pages.groupBy("site_id").agg(
        F.count("*").alias("n"), F.min("host").alias("host"), F.min_by(F.struct(*HOME), first).alias("home"), best.alias("best"),
        *[F.min_by(F.struct(*READ, "page_url"), F.when(T.holds(low, words), first)).alias(kind) for kind, words in KEY_PAGES.items()],
        F.bool_or("json_ld_present").alias("json_ld_present"), *[F.bool_or(t).alias(t) for t in TYPES], F.bool_or(F.size("same_as") > 0).alias("same_as_detected"),
        F.max("entity_id_count").alias("entity_id_count"), F.sum("relation_count").alias("relation_count"), F.bround(F.avg("visible_alignment_score"), 0).cast("int").alias("visible_alignment_score"),
        *[F.bool_or(s).alias(s) for s in SIGNALS], F.min_by("detected_company_name", F.when(c("detected_company_name").isNotNull(), first)).alias("company"), F.max("homepage_brand_mentions").alias("mentions"),
        F.min_by(T.business_type(F.concat_ws(" ", "title", "meta_description", F.substring("text", 1, 1000))), first).alias("business_type"),
        n(~F.startswith(c("url"), F.lit("https://"))).alias("not_https"), n(c("url").rlike("[?_]") | (F.lower("url") != c("url")) | (F.length("url") > 110)).alias("dirty_urls"),
        n(title == 0).alias("no_title"), n((title > 0) & ~title.between(45, 65)).alias("odd_titles"), n(meta == 0).alias("no_meta"), n((meta > 0) & ~meta.between(80, 170)).alias("odd_metas"),
        n(c("h1_count") != 1).alias("odd_h1"), n(c("lang").isNull()).alias("no_lang"), n(c("html_length") > 250_000).alias("heavy"), n(c("canonical").isNotNull() & (c("canonical") != c("page_url"))).alias("other_canonical"),
        n(c("images_with_alt_ratio") < 0.8).alias("poor_alts"), n(flag("noindex")).alias("noindex"), n(c("nofollow_links") > 0).alias("nofollow"), n(status_code >= 400).alias("errors"), n(redirected).alias("redirects"),
    )
    return each


def any_of(name: str) -> Column:
    """Does any of the content key pages show it?"""
    return F.exists(F.array(*[F.coalesce(c(f"{k}.{name}"), F.lit(False)) for k in CONTENT_KINDS]), lambda x: x)


def mean_of(value) -> Column:
    """Mean over the content key pages that exist, 0 without one."""
    known = F.filter(F.array(*[F.when(c(f"{k}.page_url").isNotNull(), value(k).cast("double")) for k in CONTENT_KINDS]), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)).otherwise(0.0)


def content_columns() -> dict[str, Column]:
    """Content and the four E-E-A-T scores of a site from its key pages."""
    words, here = lambda k: F.coalesce(c(f"{k}.word_count"), F.lit(0)), lambda k: c(f"{k}.page_url").isNotNull()
    links = c("mean_links")
    total = (
        F.when(words("service") >= 400, 15).when(words("service") >= 200, 7).otherwise(0) + F.when(words("article") >= 800, 20).when(words("article") >= 400, 10).otherwise(0)
        + points((8, c("any_faq")), (10, c("any_author")), (7, c("any_date")), (12, c("any_numbers")), (6, c("any_references")), (4, c("any_citations")), (4, c("any_tldr")))
    ).cast("double") + c("mean_headings") / 100 * 12 + c("mean_density") / 100 * 10 + c("mean_chunks") / 100 * 8 + links / 100 * 6 + points((8, c("any_answer")))
    return {
        "content_score": score(total),
        "experience_score": score(points((30, here("case_study")), (20, c("any_numbers")), (20, words("service") >= 300), (30, here("about")))),
        "expertise_score": score(points((35, words("service") >= 400), (25, words("article") >= 800), (20, c("any_answer"))) + c("mean_headings") / 100 * 10 + c("mean_density") / 100 * 10),
        "authoritativeness_score": score(points((25, here("about")), (20, c("any_author")), (20, flag("awards_detected")), (15, flag("certifications_detected")), (20, flag("same_as_detected")), (10, c("any_references")))),
        "trustworthiness_score": score(points((25, here("contact")), (15, flag("phone_detected")), (15, flag("email_detected")), (15, flag("address_detected")), (15, c("any_date")), (15, c("any_author")), (10, c("any_citations")), (5, c("any_updates")))),
    }


def technical_columns() -> dict[str, Column]:
    """The technical audit of a homepage with the site's headers (etag, last_modified, security_count), robots, sitemap and timing."""
    h = lambda n: F.length(F.coalesce(c(f"home.{n}"), F.lit(""))) > 0
    ssr = scores.ssr_signal(c("home.html_length"), c("home.word_count"))
    blocking, fast, security = scores.render_blocking(c("home.sync_scripts"), c("home.stylesheets")), scores.performance_score(c("milliseconds")), F.coalesce("security_count", F.lit(0)) * 20
    fixed_part = points((8, F.startswith(c("home.page_url"), F.lit("https://"))), (5, h("meta_description")), (5, h("canonical")), (4, h("lang")), (4, c("home.h1_count") == 1), (8, flag("sitemap_exists")), (4, flag("robots_has_sitemap")), (5, c("home.open_graph_present")), (3, c("home.twitter_card_present")), (4, c("home.hreflang_present")), (4, flag("etag") | flag("last_modified")))
    total = fixed_part.cast("double") + ssr / 100 * 10 + security / 100 * 16 + c("home.image_score") / 100 * 4 + blocking / 100 * 8 + fast / 100 * 8
    return {
        "ssr_score": ssr, "blocking_score": blocking, "speed_score": fast, "security_score": security, "technical_score": score(total),
        "freshness_score": score(points((45, flag("etag")), (25, flag("last_modified")), (15, c("home.has_publish_date")), (15, c("home.has_update_log")))),
    }


def schema_column() -> Column:
    aligned = F.coalesce(c("visible_alignment_score"), F.lit(0))
    terms = [(8, flag("json_ld_present")), (12, flag("has_organization")), (6, flag("has_website")), (9, flag("has_service")), (9, flag("has_article")), (7, flag("has_faq_page")), (9, flag("has_product")), (5, flag("has_defined_term")), (8, flag("same_as_detected")), (4, c("entity_id_count") >= 2), (4, c("relation_count") >= 3), (4, flag("has_breadcrumb_list")), (4, flag("has_date_published")), (4, flag("has_date_modified"))]
    return score(points(*terms) + F.when(aligned >= 60, 7).when(aligned >= 30, 3).otherwise(0))


def brand_columns() -> dict[str, Column]:
    """Brand presence, mentions, consistency, completeness and backlinks, and their mean over those known."""
    about, contact = c("about.page_url").isNotNull(), c("contact.page_url").isNotNull()
    brand = F.lower(F.trim(F.coalesce("company", F.lit(""))))
    holds = lambda v: (brand != "") & F.lower(F.coalesce(v, F.lit(""))).contains(brand)
    fields = [c("home.title"), c("home.meta_description"), c("home.first_h1"), c("llms_preview")]
    hits = points(*[(1, holds(f)) for f in fields])
    return {
        "presence_score": score(points((35, flag("company_name_detected")), (25, flag("phone_detected") | flag("email_detected")), (20, about), (20, contact))),
        "mentions_score": score(F.least(F.lit(45), hits * 15) + F.when(c("mentions") >= 2, 20).when(c("mentions") == 1, 10).otherwise(0) + points((20, about), (15, contact))),
        "consistency_score": score(points((35, flag("same_as_detected")), (20, flag("has_organization")), (20, holds(fields[0]) | holds(fields[2]) | holds(fields[3])), (15, about & contact), (10, F.coalesce("same_domain_sitemap", F.lit(True))))),
        "completeness_score": score(points((20, flag("company_name_detected")), (15, flag("address_detected")), (15, flag("phone_detected")), (15, flag("email_detected")), (10, about), (10, contact), (10, flag("awards_detected")), (5, flag("certifications_detected")))),
        "backlink_score": scores.backlink_quality(c("authority"), c("domains"), c("ip_classes"), c("follow")),
    }


#: The signals of each platform's model with their weights.
PLATFORM_MODELS = {
    "chatgpt": {"crawler_ratio": 28, "llms_score": 0.27, "citability": 0.25, "brand_score": 0.20},
    "google_ai_mode": {"citability": 0.26, "brand_score": 0.20, "metadata_signal": 0.16, "schema_signal": 0.18, "entity_signal": 0.20},
    "google_ai_overviews": {"citability": 0.35, "schema_signal": 0.30, "faq_signal": 0.20, "metadata_signal": 0.15},
    "perplexity": {"citability": 0.34, "brand_score": 0.24, "entity_signal": 0.14, "schema_signal": 0.16, "metadata_signal": 0.12},
    "gemini": {"schema_signal": 0.40, "metadata_signal": 0.20, "citability": 0.15, "brand_score": 0.25},
    "grok": {"brand_score": 0.28, "citability": 0.22, "metadata_signal": 0.10, "schema_signal": 0.12, "entity_signal": 0.12, "llms_score": 0.16},
}
#: A platform has a gap where one of these signals is below its limit.
PLATFORM_GAPS = {
    "chatgpt": {"crawler_ratio": 1, "llms_score": 60, "citability": 70}, "google_ai_mode": {"citability": 70, "entity_signal": 60}, "google_ai_overviews": {"schema_signal": 80, "faq_signal": 80},
    "perplexity": {"citability": 70, "brand_score": 60, "entity_signal": 50}, "gemini": {"schema_signal": 80, "metadata_signal": 80}, "grok": {"brand_score": 60, "llms_score": 60},
}


def platform_columns() -> dict[str, Column]:
    return {f"{name}_score": score(blend(*[(w, c(signal)) for signal, w in model.items()])) for name, model in PLATFORM_MODELS.items()}


def audited(facts: DataFrame, inputs: DataFrame) -> DataFrame:
    """site_facts and inputs -> the facts with the scores of all modules.

    inputs, a row per site: robots_exists, robots_has_sitemap, crawlers_allowed, crawlers, sitemap_exists,
    sitemap_https, sitemap_clean, same_domain_sitemap, llms_preview, llms_length, https_ok, hosts_ok, milliseconds,
    etag, last_modified, security_count, authority, domains, ip_classes, follow, target_locale.  A site without
    inputs is audited with none of them.
    """
    return with_modules(facts.join(inputs, "site_id", "left"))


def with_modules(out: DataFrame) -> DataFrame:
    """audited, of facts that have the columns of inputs already."""
    names = {"any_faq": "has_faq", "any_author": "has_author", "any_date": "has_publish_date", "any_numbers": "has_quantified_data", "any_references": "has_reference_section", "any_citations": "has_inline_citations", "any_tldr": "has_tldr", "any_updates": "has_update_log", "any_answer": "answer_first"}
    link = lambda k: F.least(F.lit(100), F.bround(c(f"{k}.descriptive_internal_link_ratio") * 55.0 + c(f"{k}.descriptive_external_link_ratio") * 45.0, 0))
    means = {"mean_headings": mean_of(lambda k: c(f"{k}.heading_quality_score")), "mean_density": mean_of(lambda k: c(f"{k}.information_density_score")), "mean_chunks": mean_of(lambda k: c(f"{k}.chunk_structure_score")), "mean_links": mean_of(link)}
    home, best = c("home.citability_score"), c("best.citability_score")
    ratio = F.coalesce(c("crawlers_allowed") / F.greatest("crawlers", F.lit(1)), F.lit(0.0))
    out = out.withColumns({
        **{k: any_of(v) for k, v in names.items()}, **means, "crawler_ratio": ratio, "citability": F.when(best > home, score(blend((0.45, home), (0.55, best)))).otherwise(home),
        "llms_score": F.coalesce(scores.llms_effectiveness(c("llms_preview"), c("llms_length"), F.coalesce("company", F.lit(""))), F.lit(0)),
        "metadata_signal": points((35, F.length(F.coalesce("home.meta_description", F.lit(""))) > 0), (25, F.length(F.coalesce("home.canonical", F.lit(""))) > 0), (20, c("home.open_graph_present")), (20, c("home.twitter_card_present"))),
        "schema_signal": points((20, flag("json_ld_present")), (25, flag("has_organization")), (15, flag("has_website")), (20, flag("has_service")), (20, flag("has_article") | flag("has_faq_page"))),
        "entity_signal": points((40, c("entity_id_count") >= 2), (35, c("relation_count") >= 3), (25, flag("has_defined_term"))), "faq_signal": F.when(flag("has_faq_page"), 100).otherwise(30),
    })
    out = out.withColumns({**content_columns(), **technical_columns(), "schema_score": schema_column(), **brand_columns()})
    known = F.filter(F.array(*[c(f"{n}_score").cast("double") for n in ("backlink", "mentions", "consistency", "completeness")]), lambda x: x.isNotNull())
    out = out.withColumn("brand_score", score(F.aggregate(known, F.lit(0.0), lambda a, x: a + x * 0.25) / (F.size(known) * 0.25)))
    out = out.withColumn("visibility_score", score(F.floor(c("crawler_ratio") * 100) * 0.32 + c("citability") * 0.40 + c("llms_score") * 0.12 + c("presence_score") * 0.16))
    out = out.withColumns(platform_columns())
    eeat = [c(f"{n}_score").cast("double") for n in ("content", "experience", "expertise", "authoritativeness", "trustworthiness")]
    out = out.withColumns({"platform_score": score(blend(*[(w, c(f"{p}_score")) for p, w in scores.PLATFORMS.items()])), "quality_score": score(sum(eeat[1:], eeat[0]) / 5)})
    parts = {"visibility": c("visibility_score"), "brand": c("brand_score"), "content": c("quality_score"), "technical": c("technical_score"), "schema": c("schema_score"), "platform": c("platform_score")}
    return out.withColumn("composite_score", scores.composite(parts)).withColumn("status", status(c("composite_score")))


DIMENSIONS = {"visibility": "visibility_score", "brand": "brand_score", "content": "quality_score", "technical": "technical_score", "schema": "schema_score", "platform": "platform_score"}


def action_plan(sites: DataFrame) -> DataFrame:
    """The dimensions of each site, weakest first: high for the first, medium up to the third, else low."""
    items = F.array_sort(F.array(*[F.struct(c(s).alias("score"), F.lit(i).alias("ord"), F.lit(d).alias("dimension")) for i, (d, s) in enumerate(DIMENSIONS.items())]))
    long = sites.select("site_id", F.posexplode(items).alias("rank", "x"))
    return long.select("site_id", (c("rank") + 1).alias("rank"), "x.dimension", "x.score", F.when(c("rank") == 0, "high").when(c("rank") < 3, "medium").otherwise("low").alias("priority"))


def platforms(sites: DataFrame) -> DataFrame:
    """A row per site and platform: its score, status, weight and whether it has a gap."""
    gap = lambda p: F.exists(F.array(*[c(s).cast("double") < limit for s, limit in PLATFORM_GAPS[p].items()]), lambda x: x)
    each = F.array(*[F.struct(F.lit(p).alias("platform"), c(f"{p}_score").alias("score"), F.lit(w).alias("weight"), gap(p).alias("has_gap")) for p, w in scores.PLATFORMS.items()])
    return sites.select("site_id", F.explode(each).alias("x")).select("site_id", "x.*").withColumn("status", status(c("score")))


#: Keywords of how a site comes across, and those that fill up to four.
KEYWORDS = ("Authoritative", "Well-structured", "Thought Leader", "Fast-moving", "Evidence-led", "Trustworthy", "Answer-first", "Product-led")
FALLBACKS = ("Low-signal", "Entity-blurry", "Proof-light", "Structure-light")


def perception_keywords(sites: DataFrame) -> DataFrame:
    """Four keywords of each site: those whose rule holds, in order, then the fallbacks."""
    here = lambda k: c(f"{k}.page_url").isNotNull()
    rules = (
        (c("brand_score") >= 75) & flag("same_as_detected"), (c("schema_score") >= 70) & (c("technical_score") >= 70), (c("expertise_score") >= 72) & (here("article") | flag("has_defined_term")), (c("llms_score") >= 70) & c("any_date"),
        (c("experience_score") >= 65) & c("any_numbers"), (c("trustworthiness_score") >= 70) & flag("company_name_detected") & flag("phone_detected"), (c("citability") >= 70) & (c("platform_score") >= 70), here("service") & (flag("has_service") | flag("has_product")),
    )
    kept = F.filter(F.array(*[F.when(rule, name) for rule, name in zip(rules, KEYWORDS)]), lambda x: x.isNotNull())
    return sites.select("site_id", F.slice(F.concat(kept, F.array(*map(F.lit, FALLBACKS))), 1, 4).alias("keywords"))


def perception(sites: DataFrame) -> DataFrame:
    """Positive, neutral and controversial shares of each site, whole percentages that sum to 100."""
    rest = lambda n: F.lit(100) - c(n)
    penalty = points((12, c("same_domain_sitemap") == F.lit(False)), (10, ~flag("company_name_detected")), (8, ~flag("same_as_detected")), (4, F.coalesce(c("llms_length"), F.lit(0)) == 0))
    positive = blend((0.22, c("visibility_score")), (0.22, c("brand_score")), (0.12, c("expertise_score")), (0.12, c("authoritativeness_score")), (0.12, c("trustworthiness_score")), (0.08, c("technical_score")), (0.06, c("schema_score")), (0.06, c("platform_score")))
    neutral = blend((0.18, rest("citability")), (0.24, rest("presence_score")), (0.18, rest("schema_score")), (0.20, rest("content_score")), (0.20, rest("brand_score")))
    against = blend((0.28, rest("trustworthiness_score")), (0.22, rest("brand_score")), (0.12, rest("technical_score")), (0.16, rest("schema_score")), (0.10, rest("authoritativeness_score"))) + penalty
    raw = sites.select("site_id", F.greatest(positive, F.lit(12.0)).alias("positive"), F.greatest(neutral, F.lit(10.0)).alias("neutral"), F.greatest(against, F.lit(8.0)).alias("controversial"))
    return scores.percentages(raw, "site_id", ["positive", "neutral", "controversial"])
