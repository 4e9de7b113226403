"""What an audit says in words: issues, strengths and recommendations of each module, and a site's summary of them.

A module is an ordered table of rules over the row of an audited site.  A rule that
holds gives its issue and recommendation, one that does not its strength, if it has
one; the lists keep the order of the table.  The summary goes through the six
dimensions from the weakest on and takes what is new, up to a number.  All of it is
expressions over one row, so a site costs no shuffle beyond its audit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions import urls
from pagelens.operators.localize import localized
from pagelens.operators.modules import DIMENSIONS, PLATFORM_GAPS

c, lit = F.col, F.lit
TOP = 5  # issues, quick wins and steps of a plan in a summary
STRONG_PLATFORM = 65


@dataclass(frozen=True)
class Rule:
    name: str
    #: a condition over the row, as an expression in SQL
    holds: str
    issue: str | None = None
    recommendation: str | None = None
    strength: str | None = None
    #: where the strength needs more than that the rule does not hold
    well: str | None = None


# The sentences.


def visibility_rules() -> list[Rule]:
    has_llms = "coalesce(llms_length, 0) > 0"
    return [
        Rule("crawlers", "crawler_ratio < 1", "robots.txt blocks one or more major AI crawlers.", "Review robots.txt and allow GPTBot, OAI-SearchBot, PerplexityBot, and Google-Extended.", "robots.txt appears open to major AI crawlers."),
        Rule("no_llms", f"not ({has_llms})", "Site does not expose llms.txt guidance.", "Publish a concise llms.txt that describes the site, services, and citation preferences."),
        Rule("thin_llms", f"{has_llms} and llms_score < 60", "llms.txt exists but does not yet provide strong machine-facing guidance.", "Expand llms.txt with brand context, services, citation preferences, and structured sections.", "llms.txt exists and can help AI systems understand the site.", has_llms),
        Rule("citability", "citability < 60", "Homepage lacks strong citation-friendly structure and content depth.", "Improve homepage metadata, add clearer headings, and strengthen answer-first copy.", "Homepage exposes baseline citability signals."),
        Rule("presence", "presence_score < 50", "Basic entity presence is thin across about/contact and contact signals.", "Strengthen homepage, about, and contact-page entity signals with brand and contact details.", "Baseline entity presence is detectable across the site."),
        Rule("brand", "brand_score < 50", "Brand authority signals are weak on-site.", "Add complete company details, sameAs references, stronger entity consistency, and external authority proof.", "Brand authority signals show meaningful baseline coverage."),
    ]


def technical_rules() -> list[Rule]:
    return [
        Rule("https", "not startswith(home.page_url, 'https://')", "Site does not consistently enforce HTTPS.", "Redirect all traffic to HTTPS and preload HSTS once validated.", "Site resolves over HTTPS."),
        Rule("security", "security_score < 80", "Important security headers are missing.", "Add HSTS, CSP, X-Frame-Options, X-Content-Type-Options, and Referrer-Policy headers.", "Core security headers are largely in place."),
        Rule("meta", "coalesce(home.meta_description, '') = ''", "Homepage is missing a meta description.", "Add a concise meta description that describes the primary offer and location/entity."),
        Rule("locale", "asked_locale is not null and not coalesce(home_locale = asked_locale, false)", "Homepage language declaration does not match the requested target locale.", "Align html lang, visible copy, and the requested locale scope before running GEO diagnostics.", "Homepage language declaration aligns with the requested locale.", "asked_locale is not null and home_locale is not null"),
        Rule("canonical", "coalesce(home.canonical, '') = ''", "Homepage is missing a canonical tag.", "Expose self-referencing canonical tags on primary pages."),
        Rule("h1", "home.h1_count <> 1", "Homepage semantic structure should expose exactly one H1.", "Keep a single descriptive H1 and nest supporting sections under logical H2/H3 headings."),
        Rule("blocking", "blocking_score <= 65", "Homepage has medium or high render-blocking risk.", "Defer non-critical JavaScript and reduce synchronous CSS/JS payloads.", "Render-blocking risk looks manageable."),
        Rule("speed", "speed_score < 60", "Observed response time is slower than ideal for AI retrieval and user experience.", "Reduce server response latency and optimize page-critical assets.", "Observed response time is within a healthy baseline."),
        Rule("images", "home.image_score < 60", "Images are missing lazy loading and/or explicit dimensions.", "Add lazy loading and width/height attributes to primary images.", "Image delivery patterns show baseline optimization."),
        Rule("hreflang", "asked_locale is not null and home.hreflang_present and not asked_listed", "hreflang annotations do not expose the requested target locale.", "Add hreflang coverage for the requested locale and keep alternate links mutually consistent."),
        Rule("revalidation", "not (coalesce(etag, false) or coalesce(last_modified, false))", "Response headers do not expose ETag or Last-Modified freshness signals.", "Add ETag and/or Last-Modified headers so crawlers can revalidate content efficiently.", "Technical freshness signals support efficient crawler revalidation.", "freshness_score >= 60"),
    ]


_SCHEMAS = {
    "Organization": ("has_organization", "Add Organization schema with name, url, logo, contactPoint, and sameAs."), "Local Business": ("has_local_business", "Add LocalBusiness schema if the business serves a local or regional market."),
    "Article": ("has_article", "Add Article or NewsArticle schema to editorial pages."), "Faq Page": ("has_faq_page", "Add FAQPage schema to pages with FAQ sections."), "Service": ("has_service", "Add Service schema to commercial pages."),
    "Website": ("has_website", "Add WebSite schema with SearchAction where relevant."), "Product": ("has_product", "Add Product schema to product or solution detail pages where applicable."), "Defined Term": ("has_defined_term", "Model proprietary technologies or frameworks with DefinedTerm and stable @id values."),
}
SCHEMA_RECOMMENDATIONS = 5


def schema_rules() -> list[Rule]:
    lacks = lambda *names: "not (" + " or ".join(f"coalesce({n}, false)" for n in names) + ")"
    return [
        Rule("json_ld", lacks("json_ld_present"), "No JSON-LD structured data detected.", "Implement baseline JSON-LD on homepage and core landing pages.", "JSON-LD markup is present."),
        *[Rule(f"type_{column}", lacks(column), f"{name} schema is missing.", advice, f"{name} schema detected.") for name, (column, advice) in _SCHEMAS.items()],
        Rule("same_as", lacks("same_as_detected"), "No sameAs references found in structured data.", "Add sameAs links for official social, knowledge, and profile URLs.", "Structured data exposes sameAs entity references."),
        Rule("breadcrumbs", lacks("has_breadcrumb_list"), "BreadcrumbList schema is missing.", "Add BreadcrumbList schema so crawlers can infer page position and hierarchy.", "BreadcrumbList schema is present."),
        Rule("dates", lacks("has_date_published", "has_date_modified"), "Structured data does not expose machine-readable freshness dates.", "Add datePublished and/or dateModified to content and solution schemas where relevant.", "Structured data exposes machine-readable freshness dates."),
        Rule("alignment", "coalesce(visible_alignment_score, 0) < 60", "Schema text does not yet align strongly enough with visible page copy.", "Keep Schema names, descriptions, FAQs, and claims tightly aligned with on-page visible content.", "Schema text aligns well with visible page content."),
        Rule("ids", "coalesce(entity_id_count, 0) < 2", "Structured data lacks stable @id usage across brand and commercial entities.", "Add stable @id identifiers to Organization, WebSite, Product, and other core nodes.", "Structured data uses stable @id values across multiple entities."),
        Rule("relations", "coalesce(relation_count, 0) < 3", "Entity relationships are too sparse for strong machine reasoning.", "Add richer entity relationships such as brand, manufacturer, hasPart, offers, about, and contactPoint.", "Structured data exposes a usable baseline of entity relationships."),
    ]


def content_rules() -> list[Rule]:
    service, article = "service.page_url is not null", "article.page_url is not null"
    return [
        Rule("no_service", "service.page_url is null", "No clear service page was discovered for content evaluation.", "Create a dedicated service page with clear offerings, outcomes, and supporting proof."),
        Rule("thin_service", f"{service} and service.word_count < 300", "Service page copy is thin for AI citation and retrieval.", "Expand service pages with problem framing, process details, deliverables, and FAQs.", "Service page has enough depth for baseline retrieval.", service),
        Rule("no_article", "article.page_url is null", "No article or news page was discovered.", "Publish insight or blog content to increase topical coverage and retrievable expertise."),
        Rule("thin_article", f"{article} and article.word_count < 600", "Article content is too short to establish durable topical authority.", "Publish longer-form articles with original data, examples, and authored bylines.", "Article content demonstrates topical depth.", article),
        Rule("faq", "not any_faq", "FAQ content is missing.", "Add FAQ sections to commercial pages and high-intent landing pages."),
        Rule("author", "not any_author", "Author bylines are missing from evaluated content.", "Add author profiles and bylines to articles and expert pages."),
        Rule("date", "not any_date", "Publication dates are missing from evaluated content.", "Expose publish/update timestamps on editorial content."),
        Rule("references", "not any_references", "Evaluated pages do not expose a clear references or sources section.", "Add a references section or source list to pages making factual or comparative claims."),
        Rule("citations", "not any_citations", "Important claims are not supported by visible inline citation signals.", "Support factual claims with inline citations, source labels, or linked evidence."),
        Rule("tldr", "not any_tldr", None, "Add TL;DR or key takeaways blocks to improve answer-first extraction."),
        Rule("answer", "not any_answer", None, "Lead pages with direct answers before deeper explanation.", "Some content follows an answer-first structure."),
        Rule("density", "mean_density < 55", "Pages do not yet surface enough fact density for consistent AI extraction.", "Add quantified claims, concrete specifications, and sourceable proof blocks."),
        Rule("chunks", "mean_chunks < 55", "Content chunking is weaker than ideal for answer extraction and citation reuse.", "Break long sections into tighter question-led blocks with clearer subheadings."),
        Rule("links", "mean_links < 55", "Internal and external link anchors are not yet descriptive enough for strong retrieval context.", "Use descriptive anchor text that names the target topic, source, or evidence being linked."),
    ]


_PLATFORM_GAPS = {
    "chatgpt": "Crawler access, llms guidance, or high-intent answer blocks are still incomplete.", "google_ai_mode": "Query fan-out readiness is limited by shallow content coverage or weak entity depth.", "google_ai_overviews": "Weak structured answers and FAQ/schema coverage.",
    "perplexity": "Site needs more cited evidence, neutral proof, and third-party reinforcement.", "gemini": "Entity schema and metadata are underdeveloped.", "grok": "Brand signals are not yet amplified across timely, social, and discussion-led surfaces.",
}
#: Of all platforms' advice, which is the same for every site, the first six.
PLATFORM_ADVICE = (
    "Allow major AI crawlers and keep llms.txt aligned with current offers.", "Lead priority pages with answer-first summaries and tightly scoped proof blocks.", "Strengthen official entity signals on homepage, about, and support pages.",
    "Expand topic clusters so sub-queries resolve to dedicated pages, FAQs, and support content.", "Strengthen product, service, and entity relationships in structured data.", "Create multi-format evidence across website, YouTube, and community surfaces.",
)


def platform_rules() -> list[Rule]:
    gap = lambda p: " or ".join(f"{s} < {limit}" for s, limit in PLATFORM_GAPS[p].items())
    return [Rule(p, gap(p), text) for p, text in _PLATFORM_GAPS.items()] + [Rule(f"strong_{p}", f"{p}_score < {STRONG_PLATFORM}", strength=f"{p.replace('_', ' ').title()} readiness is acceptable.") for p in _PLATFORM_GAPS]


def ai_dimension_rules() -> list[Rule]:
    return [
        Rule("crawlers", "floor(crawler_ratio * 100) < 100", "AI crawlers are not fully allowed by robots.txt.", "Review robots.txt and allow GPTBot, OAI-SearchBot, PerplexityBot, and Google-Extended."),
        Rule("llms", "llms_score < 60", "llms.txt is missing or too thin to guide AI systems effectively.", "Publish or expand llms.txt with brand context, services, and citation guidance."),
        Rule("citability", "citability < 70", "Citation-ready page structure is not yet strong enough for consistent reuse.", "Improve answer-first copy, chunk structure, and metadata coverage on key pages."),
        Rule("presence", "presence_score < 60", "Basic entity presence across homepage, about, and contact experiences is thin.", "Strengthen homepage, about, and contact-page brand and contact signals."),
    ]


def brand_dimension_rules() -> list[Rule]:
    return [
        Rule("weak", "brand_score < 60", "Brand authority is weak relative to GEO citation needs."),
        Rule("backlinks", "backlink_score < 60", "External backlink authority is still light for a strong entity profile.", "Grow high-quality referring domains and editorial backlinks."),
        Rule("sitemap", "not same_domain_sitemap", "Entity consistency is weakened by sitemap or domain mismatch.", "Align sitemap URLs, canonical signals, and the primary domain."),
    ]


BRAND_ISSUE, BRAND_ADVICE = "Brand entity signals need stronger external and structured support.", "Add company details, sameAs references, and stronger entity consistency signals."
MODULES = {"visibility": visibility_rules, "technical": technical_rules, "schema": schema_rules, "content": content_rules, "platform": platform_rules}
#: A dimension's name in the summary and the module that it belongs to.
NAMES = {"visibility": ("AI Citability & Visibility", "visibility"), "brand": ("Brand Authority Signals", "brand_authority"), "content": ("Content Quality & E-E-A-T", "content"), "technical": ("Technical Foundations", "technical"), "schema": ("Structured Data", "schema"), "platform": ("Platform Optimization", "platform")}


def lists(rules: list[Rule]) -> dict[str, Column]:
    """issues, strengths and recommendations of a table of rules, in its order."""
    some = lambda items: F.filter(F.array(*items), lambda x: x.isNotNull()) if items else F.array().cast("array<string>")
    true = lambda condition: F.coalesce(F.expr(condition), lit(False))
    holds = lambda r: true(r.holds)
    well = lambda r: ~holds(r) if r.well is None else ~holds(r) & true(r.well)
    return {
        "issues": some([F.when(holds(r), r.issue) for r in rules if r.issue]), "strengths": some([F.when(well(r), r.strength) for r in rules if r.strength]),
        "recommendations": some([F.when(holds(r), r.recommendation) for r in rules if r.recommendation]),
    }


def with_findings(sites: DataFrame) -> DataFrame:
    """sites (modules.audited) -> site_id, host, composite_score, status, the scores of the dimensions, and a struct of lists for each module and dimension."""
    asked = urls.base_locale(c("target_locale"))
    listed = F.coalesce(F.array_contains("home.hreflangs", asked), lit(False))
    sites = sites.withColumns({"home_locale": urls.base_locale(c("home.lang")), "asked_locale": asked, "asked_listed": listed})
    found = {m: lists(rules()) for m, rules in MODULES.items()}
    found["schema"]["recommendations"] = F.slice(found["schema"]["recommendations"], 1, SCHEMA_RECOMMENDATIONS)
    found["platform"]["recommendations"] = F.array(*map(lit, PLATFORM_ADVICE))
    ai, brand = lists(ai_dimension_rules()), lists(brand_dimension_rules())
    pack = lambda columns: F.struct(*[v.alias(k) for k, v in columns.items()])
    named = {f"{m}_found": pack(v) for m, v in found.items()} | {"ai_found": pack(ai), "brand_found": pack(brand)}
    out = sites.select("site_id", "host", "composite_score", "status", *DIMENSIONS.values(), *[v.alias(k) for k, v in named.items()])
    # each list is computed once, whatever reads it
    return out.select("site_id", "host", "composite_score", "status", *DIMENSIONS.values(), F.inline(F.array(F.struct(*named))))


def site_findings(sites: DataFrame, language: str = "en") -> DataFrame:
    """A row for each finding of each module of each site: site_id, module, kind, pos, finding, in a language."""
    found = localized(with_findings(sites), language, [f"{m}_found" for m in MODULES])
    kinds = [F.struct(lit(m).alias("module"), lit(kind[:-1]).alias("kind"), c(f"{m}_found.{kind}").alias("texts")) for m in MODULES for kind in ("issues", "strengths", "recommendations")]
    each = found.select("site_id", F.explode(F.array(*kinds)).alias("x")).select("site_id", "x.module", "x.kind", F.posexplode("x.texts").alias("pos", "finding"))
    return each.withColumn("pos", c("pos") + 1)


def union_distinct(*parts: Column, most: int | None = None) -> Column:
    """The elements of lists one after another, each where it first stands; at most so many."""
    whole = F.array_distinct(F.flatten(F.array(*parts)))
    return whole if most is None else F.slice(whole, 1, most)


def site_summary(sites: DataFrame) -> DataFrame:
    """sites (modules.audited) -> site_id, composite_score, status, summary, top_issues, quick_wins, plan.

    Dimensions go from the weakest to the strongest, of equal ones in the order of NAMES.  The views of visibility and brand have rules of their
    own; where none holds, visibility falls back on its module's first two, brand on a fixed sentence.
    """
    found = with_findings(sites)
    own = lambda view, kind, other: F.when(F.size(c(f"{view}.{kind}")) > 0, c(f"{view}.{kind}")).otherwise(other)
    views = {
        "visibility": [own("ai_found", k, F.slice(c(f"visibility_found.{k}"), 1, 2)) for k in ("issues", "recommendations")],
        "brand": [own("brand_found", "issues", F.array(lit(BRAND_ISSUE))), own("brand_found", "recommendations", F.array(lit(BRAND_ADVICE)))],
        **{d: [c(f"{d}_found.{k}") for k in ("issues", "recommendations")] for d in ("content", "technical", "schema", "platform")},
    }
    items = [F.struct(c(DIMENSIONS[d]).alias("score"), lit(i).alias("ord"), lit(NAMES[d][0]).alias("label"), lit(NAMES[d][1]).alias("module"), views[d][0].alias("issues"), views[d][1].alias("wins")) for i, d in enumerate(DIMENSIONS)]
    rows = found.select("site_id", "host", "composite_score", "status", F.inline(F.array(F.struct(F.array_sort(F.array(*items)).alias("d")))))
    issues = F.transform("d", lambda x: F.transform(x["issues"], lambda i: F.concat(x["label"], lit(": "), i)))
    wins = F.transform("d", lambda x: x["wins"])
    steps = F.filter(F.transform("d", lambda x, i: F.struct(F.when(i == 0, "high").when(i < 3, "medium").otherwise("low").alias("priority"), x["module"].alias("module"), F.get(x["wins"], lit(0)).alias("action"), F.concat(x["label"], lit(" is one of the weakest scoring dimensions and is constraining the composite GEO score.")).alias("rationale"))), lambda s: s["action"].isNotNull())
    label = lambda i: F.get("d", lit(i))["label"]
    text = F.concat(c("host"), lit(" currently scores "), c("composite_score").cast("string"), lit("/100 for GEO readiness. The biggest gaps are in "), label(0), lit(" and "), label(1), lit("."))
    distinct = lambda x: F.slice(F.array_distinct(F.flatten(x)), 1, TOP)
    return rows.select("site_id", "composite_score", "status", text.alias("summary"), distinct(issues).alias("top_issues"), distinct(wins).alias("quick_wins"), F.slice(steps, 1, TOP).alias("plan"))
