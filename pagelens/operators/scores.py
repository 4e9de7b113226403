"""Rule scores of pages and sites: sums of fixed weights, clamped to 0..100."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions.numbers import blend, points, ratio, score, status
from pagelens.sources import structured

c = F.col


def filled(name: str) -> Column:
    return F.length(F.coalesce(c(name), F.lit(""))) > 0


def flag(name: str) -> Column:
    return F.coalesce(c(name), F.lit(False))


def citability(density: Column | None = None, chunks: Column | None = None) -> Column:
    """How ready a page is to be cited."""
    base = points(
        (8, filled("title")), (8, filled("meta_description")), (8, (c("h1_count") > 0) | (c("heading_count") >= 1)), (8, filled("canonical")),
        (10, c("heading_count") >= 3), (10, c("word_count") >= 250), (15, flag("answer_first")), (8, flag("has_quantified_data")),
        (5, flag("has_faq")), (5, flag("has_author")), (5, flag("has_publish_date")),
    )
    density, chunks = (c("information_density_score") if density is None else density), (c("chunk_structure_score") if chunks is None else chunks)
    return score(base.cast("double") + density.cast("double") * 0.1 + chunks.cast("double") * 0.1)


def citation_probability(value: Column) -> Column:
    support = points(*[(1, flag(n)) for n in ("answer_first", "has_quantified_data", "has_faq", "has_author", "has_publish_date")])
    return F.when((value >= 75) & (support >= 2), "HIGH").when(value >= 55, "MEDIUM").otherwise("LOW")


def content_score() -> Column:
    fixed = F.when(c("word_count") >= 700, 25).when(c("word_count") >= 350, 15).otherwise(5) + points(
        (15, flag("has_faq")), (12, flag("has_author")), (10, flag("has_publish_date")), (15, flag("has_quantified_data")),
        (10, flag("has_reference_section")), (6, flag("has_inline_citations")), (6, flag("has_tldr")), (12, flag("answer_first")),
    )
    return score(fixed.cast("double") + blend((0.06, c("information_density_score"))) + blend((0.05, c("chunk_structure_score"))) + blend((6, c("descriptive_internal_link_ratio"))) + blend((4, c("descriptive_external_link_ratio"))))


def technical_score() -> Column:
    return score(
        points((20, filled("title")), (15, filled("meta_description")), (15, filled("canonical")), (10, filled("lang")), (10, c("h1_count") == 1))
        + F.when(c("heading_count") >= 3, 20).when(c("heading_count") > 0, 10).otherwise(0)
        + F.when(c("word_count") >= 250, 20).when(c("word_count") >= 100, 10).otherwise(0)
    )


SCHEMA_WEIGHTS = {"json_ld_present": 18, "has_organization": 15, "has_service": 15, "has_article": 10, "has_faq_page": 10, "has_product": 10, "has_defined_term": 6, "has_breadcrumb_list": 6, "has_date_published": 5, "has_date_modified": 5}


def schema_score() -> Column:
    """Over the columns of sources.structured.summary_columns; missing structured data counts as none."""
    return score(points(*[(w, flag(n)) for n, w in SCHEMA_WEIGHTS.items()], (5, F.coalesce(c("visible_alignment_score"), F.lit(0)) >= 60), (10, F.coalesce(F.size("same_as"), F.lit(0)) > 0)))


def scored_pages(profiles: DataFrame) -> DataFrame:
    """profiles (with structured data columns, or json_ld to take them from) + citability, content, technical, schema and overall scores."""
    profiles = structured.with_summary(profiles)
    for name in [*SCHEMA_WEIGHTS, "visible_alignment_score", "same_as"]:
        if name not in profiles.columns:
            kind = {"visible_alignment_score": "int", "same_as": "array<string>"}.get(name, "boolean")
            profiles = profiles.withColumn(name, F.lit(None).cast(kind))
    out = profiles.withColumns({"citability_score": citability(), "content_score": content_score(), "technical_score": technical_score(), "schema_score": schema_score()})
    out = out.withColumn("overall_score", score(blend((0.35, c("citability_score")), (0.30, c("content_score")), (0.20, c("technical_score")), (0.15, c("schema_score")))))
    return out.withColumns({"status": status(c("overall_score")), "citation_probability": citation_probability(c("citability_score"))})


# Words of a whole URL that tell further types of page, first match first.
EXTRA_TYPES = {
    "product": ["product", "products", "item", "sku", "shop", "produit", "produits", "produkt"], "faq": ["faq", "help", "support", "fragen", "vragen", "aide"],
    "documentation": ["docs", "documentation", "guide", "manual", "gids", "handleiding", "dokumentation"], "comparison": ["compare", "comparison", "vs"],
}
KEY_TYPES = ("homepage", "about", "contact", "case_study")


def page_type() -> Column:
    """The key types by url_type; else product, faq, documentation or comparison by words anywhere in the URL; else article for a blog, or page."""
    out = F.when(c("url_type").isin(*KEY_TYPES), c("url_type"))
    for name, words in EXTRA_TYPES.items():
        out = out.when(F.lower("page_url").rlike("|".join(words)), name)
    return out.when(c("url_type") == "blog", "article").otherwise("page")


def issues() -> Column:
    """array<struct<ord, category, issue, recommendation>> of the rules that a scored page breaks, in rule order."""
    editorial = page_type().isin("article", "documentation")
    aligned = F.coalesce(c("visible_alignment_score"), F.lit(0)) >= 60
    # Rule, category, finding, advice.
    rules = [
        (c("citability_score") < 60, "citability", "Page is not yet citation-ready enough for consistent AI extraction.", "Restructure the page with answer-first sections, stronger headings, and tighter proof blocks."),
        (c("content_score") < 60, "content", "Content depth and fact density are weaker than ideal for GEO reuse.", "Add concrete claims, specifications, FAQs, and sourced proof to the page."),
        (~flag("has_reference_section") & flag("has_quantified_data"), "evidence", "Claims appear without a visible references or sources section.", "Add a references section or source list near factual and comparative claims."),
        (~flag("has_inline_citations") & flag("has_reference_section"), "evidence", "Page has source sections but lacks inline citation cues near important claims.", "Support key facts with inline citations, source labels, or explicit linked proof near the claim."),
        ((c("descriptive_internal_link_ratio") < 0.5) | (c("descriptive_external_link_ratio") < 0.5), "linking", "Link anchors are not descriptive enough to provide strong retrieval context.", "Use anchor text that names the linked topic, evidence source, or destination intent more explicitly."),
        (c("technical_score") < 60, "technical", "Page-level metadata or structure is incomplete.", "Improve title, meta description, canonical tags, language declaration, and heading coverage."),
        (c("h1_count") != 1, "semantic_html", "Page should expose exactly one H1 for stronger semantic structure.", "Keep a single descriptive H1 and nest supporting content under logical H2 and H3 sections."),
        (c("schema_score") < 50, "schema", "Structured data on this page is too thin.", "Add page-relevant JSON-LD such as Service, Product, FAQPage, Article, or DefinedTerm."),
        ((c("schema_score") >= 50) & ~aligned, "schema", "Schema content is present but not tightly aligned with visible page copy.", "Keep schema names, descriptions, FAQs, and dates synchronized with visible on-page content."),
        (flag("json_ld_present") & ~flag("has_date_published") & ~flag("has_date_modified"), "freshness", "Structured data is present but does not expose machine-readable publish or update dates.", "Add datePublished and/or dateModified in the page's JSON-LD where relevant."),
        (~flag("has_author") & editorial, "trust", "Editorial page lacks an author signal.", "Expose named authors or reviewers for editorial and knowledge pages."),
        (~flag("has_publish_date") & editorial, "freshness", "Editorial page lacks a visible publish or update timestamp.", "Expose visible publish and update timestamps on editorial and knowledge pages."),
        (~flag("has_tldr") & (c("citability_score") < 75), "ux", "Page lacks a concise answer-first summary block.", "Add a TL;DR or key takeaways block near the top of the page."),
    ]
    each = [F.when(rule, F.struct(F.lit(i).alias("ord"), F.lit(category).alias("category"), F.lit(issue).alias("issue"), F.lit(advice).alias("recommendation"))) for i, (rule, category, issue, advice) in enumerate(rules)]
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def worst_pages(scored: DataFrame, most: int = 12) -> DataFrame:
    """Each site's `most` weakest pages: lowest score, most issues, then URL (a top-k report)."""
    diagnosed = scored.withColumn("issue_count", F.size(issues()))
    order = Window.partitionBy("site_id").orderBy("overall_score", c("issue_count").desc(), "page_url", "page_id")
    kept = diagnosed.withColumn("rank", F.row_number().over(order)).where(c("rank") <= most)
    return kept.select("site_id", "rank", "page_id", "page_url", "overall_score", "status", "citability_score", "content_score", "technical_score", "schema_score", "issue_count")


# -- site scores over a row of signals ----------------------------------------


def llms_effectiveness(preview: Column, length: Column, brand: Column) -> Column:
    """Of an llms.txt preview: presence, length, brand, services, guidance and sections."""
    low = F.lower(F.coalesce(preview, F.lit("")))
    here = length > 0
    return score(points((20, here), (20, length >= 250), (20, here & (F.length(brand) > 0) & low.contains(F.lower(brand))), (20, low.rlike("service|product|solution|platform")), (10, low.rlike("citation|cite|canonical|contact|preferred")), (10, F.coalesce(preview, F.lit("")).rlike("(?m)^#"))))


def brand_presence() -> Column:
    return score(points((35, flag("company_name_detected")), (25, flag("phone_detected") | flag("email_detected")), (20, filled("about_url")), (20, filled("contact_url"))))


def business_completeness() -> Column:
    return score(points((20, flag("company_name_detected")), (15, flag("address_detected")), (15, flag("phone_detected")), (15, flag("email_detected")), (10, filled("about_url")), (10, filled("contact_url")), (10, flag("awards_detected")), (5, flag("certifications_detected"))))


def backlink_quality(authority: Column, domains: Column, ip_classes: Column, follow: Column) -> Column:
    """Null unless backlink figures are known."""
    whole = authority * 0.4 + F.least(F.lit(100), F.floor(domains / 5)) * 0.25 + F.floor(ip_classes / 3) * 0.15 + F.floor(follow * 100) * 0.2
    return score(whole)


def brand_authority(*components: Column) -> Column:
    """Mean of the components that are known."""
    known = F.filter(F.array(*[x.cast("double") for x in components]), lambda x: x.isNotNull())
    return score(F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)))


def ssr_signal(html_length: Column, words: Column) -> Column:
    return F.when((html_length >= 5000) & (words >= 300), 100).when((html_length >= 2500) & (words >= 120), 70).when((html_length >= 1200) & (words >= 60), 45).otherwise(20)


def render_blocking(sync_scripts: Column, stylesheets: Column) -> Column:
    return 100 - F.least(F.lit(100), sync_scripts * 20 + stylesheets * 10)


# Response headers that count 20 points each.
SECURITY_HEADERS = ("strict-transport-security", "content-security-policy", "x-frame-options", "x-content-type-options", "referrer-policy")


def security_headers(headers: Column) -> Column:
    """headers map<string, string>, names in any case."""
    names = F.transform(F.map_keys(headers), lambda k: F.lower(k))
    return points(*[(20, F.array_contains(names, h)) for h in SECURITY_HEADERS])


def performance_score(milliseconds: Column) -> Column:
    return F.when(milliseconds <= 300, 100).when(milliseconds <= 800, 75).when(milliseconds <= 1500, 50).otherwise(25)


def image_score(images: Column) -> Column:
    """images array<struct<loading, width, height>>: half for lazy loading, half for dimensions; 70 without images."""
    n = F.size(images)
    lazy = F.size(F.filter(images, lambda i: F.lower(i["loading"]) == "lazy"))
    sized = F.size(F.filter(images, lambda i: (F.length(i["width"]) > 0) & (F.length(i["height"]) > 0)))
    return F.when(n == 0, 70).otherwise(score(lazy / n * 50.0 + sized / n * 50.0))


# Weights of the site composite.
COMPOSITE = {"visibility": 0.25, "brand": 0.20, "content": 0.20, "technical": 0.15, "schema": 0.10, "platform": 0.10}
PLATFORMS = {"chatgpt": 0.22, "google_ai_mode": 0.18, "google_ai_overviews": 0.18, "perplexity": 0.16, "gemini": 0.13, "grok": 0.13}


def composite(columns: dict[str, Column] | None = None, weights: dict[str, float] = COMPOSITE) -> Column:
    """Sum over the dimensions of the clamped score times its weight, each to two digits."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.bround(score(c(f"{name}_score") if columns is None else columns[name]).cast("double") * weight, 2)
    return score(total)


def percentages(sites: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """Largest remainder: the parts as whole percentages that sum to 100, ties in the given order; equal where all are 0."""
    total = sum((c(p).cast("double") for p in parts[1:]), c(parts[0]).cast("double"))
    share = [F.when(total > 0, c(p).cast("double") * 100.0 / total).otherwise(100.0 / len(parts)) for p in parts]
    long = sites.select(key, F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(p).alias("part"), s.alias("share")) for i, (p, s) in enumerate(zip(parts, share))])).alias("x")).select(key, "x.*")
    long = long.withColumn("whole", F.floor("share").cast("int"))
    window = Window.partitionBy(key)
    long = long.withColumn("left", 100 - F.sum("whole").over(window)).withColumn("rank", F.row_number().over(window.orderBy((c("share") - c("whole")).desc(), "ord")))
    return long.select(key, "part", (c("whole") + F.when(c("rank") <= c("left"), 1).otherwise(0)).cast("int").alias("percentage"))


def observations(events: DataFrame) -> DataFrame:
    """events (event_type as kind per source) -> sessions, conversions, citations and their rates, a row per source.

    event_type purchase is a conversion, signup a cited sample; sources are the k of props.
    """
    source = F.get_json_object("props", "$.k")
    one = lambda kind: F.count_if(c("event_type") == kind)
    grouped = events.select(source.alias("source"), "event_type", "value").groupBy("source").agg(F.count("*").alias("sessions"), one("purchase").alias("conversions"), one("signup").alias("cited"), F.sum(F.when(c("event_type") == "signup", c("value").cast("decimal(14,6)"))).alias("total"), F.count(F.when(c("event_type") == "signup", c("value"))).alias("valued"))
    # exact sums, divided and rounded as decimals: the same on any number of partitions
    grouped = grouped.withColumn("total", F.bround(F.when(c("valued") > 0, c("total") / c("valued").cast("decimal(10,0)")), 2).cast("double")).drop("valued").withColumnRenamed("total", "cited_value")
    out = grouped.withColumns({"conversion_rate": ratio(c("conversions"), c("sessions"), 4), "citation_rate": ratio(c("cited"), c("sessions"), 2)})
    signals = points((1, c("sessions") > 0), (1, c("conversions") > 0), (1, c("cited") > 0))
    return out.withColumn("maturity", F.get(F.array(*map(F.lit, ("none", "basic", "intermediate", "advanced"))), signals))


def with_conversion_rates(sources: DataFrame) -> DataFrame:
    """sources (sessions, conversions, conversion_rate, ...) with missing rates filled where sessions and conversions are known."""
    return sources.withColumn("conversion_rate", F.coalesce("conversion_rate", ratio(c("conversions"), c("sessions"), 4)))


def top_sources(sources: DataFrame, key: str) -> DataFrame:
    """sources (key, pos, platform, sessions) -> the platform of most sessions of each key; of equals the first by pos."""
    sessions = F.coalesce(c("sessions"), F.lit(0))
    top = F.max_by(F.struct("platform", sessions.alias("sessions")), F.struct(sessions, -c("pos")))
    return sources.groupBy(key).agg(top.alias("top")).select(key, "top.*")
