"""Pages rolled up to sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.functions import text as T
from pagelens.functions import urls
from pagelens.functions.numbers import blend, score
from pagelens.operators import scores
from pagelens.sources import structured

# URL keywords of the key pages.
KEY_PAGES = {
    "about": ["about", "company", "team", "story", "关于", "uber-uns", "ueber-uns", "a-propos", "apropos", "over-ons"],
    "service": ["service", "services", "seo", "solution", "产品", "服务", "dienst", "diensten", "oplossing", "oplossingen", "leistung", "leistungen"],
    "contact": ["contact", "联系", "kontakt", "contactez", "contact-us", "neem-contact", "nous-contacter"],
    "article": ["blog", "news", "article", "insights", "posts", "actualites", "actualite", "nieuws", "artikel", "artikelen"],
    "case_study": ["case", "study", "success", "work", "portfolio", "案例", "fallstudie", "referenz", "referenzen", "etude-de-cas", "klantverhaal"],
}


def key_pages(pages: DataFrame) -> DataFrame:
    """pages (site_id, page_url) -> a row per site with the shortest, then first, URL of each kind."""
    low = F.lower("page_url")
    each = [F.min(F.when(T.holds(low, words), F.struct(F.length("page_url").alias("n"), F.col("page_url").alias("u"))))["u"].alias(f"{kind}_url") for kind, words in KEY_PAGES.items()]
    return pages.groupBy("site_id").agg(*each)


def url_type_counts(pages: DataFrame) -> DataFrame:
    kind = urls.url_type(urls.normalize_url(F.col("url")))
    return pages.groupBy(kind.alias("url_type")).agg(F.count("*").alias("pages")).withColumn("priority", urls.priority(F.col("url_type")))


def site_rollup(scored: DataFrame) -> DataFrame:
    """A row per site: counts, any-signals, means, best page and its share in the site's citability."""
    first = F.struct(F.length("page_url").alias("n"), F.col("page_url").alias("u"), "page_id")
    best = F.max(F.struct("citability_score", (-F.length("page_url")).alias("short"), (-F.col("page_id")).alias("early"), "page_url", "citation_probability"))
    mean = lambda name: F.bround(F.avg(name), 2).alias(f"avg_{name}")
    out = scored.groupBy("site_id").agg(
        F.count("*").alias("pages"), F.min("host").alias("host"), F.min("scope_root").alias("scope_root"),
        *[F.bool_or(n).alias(f"any_{n}") for n in ("has_faq", "has_author", "has_publish_date", "has_quantified_data", "has_reference_section", "answer_first")],
        mean("word_count"), mean("information_density_score"), mean("chunk_structure_score"), mean("heading_quality_score"), mean("link_context_score"),
        mean("content_score"), mean("technical_score"), mean("schema_score"), F.min_by("citability_score", first).alias("home_citability"), best.alias("best"),
        F.min_by("html_length", first).alias("home_html_length"), F.min_by("word_count", first).alias("home_word_count"),
    )
    whole = F.when(F.col("best.citability_score") > F.col("home_citability"), score(blend((0.45, F.col("home_citability")), (0.55, F.col("best.citability_score"))))).otherwise(F.col("home_citability"))
    return out.withColumns({"best_page": F.col("best.page_url"), "best_probability": F.col("best.citation_probability"), "site_citability": whole, "ssr_score": scores.ssr_signal(F.col("home_html_length"), F.col("home_word_count"))}).drop("best")


def site_signals(profiles: DataFrame) -> DataFrame:
    """Entity signals of a site: OR of the flags, first company name, most mentions, business type of its first page, roots, whether a page has sameAs."""
    linked = structured.with_summary(profiles)
    each = linked.withColumns({"same_as_detected": F.coalesce(F.size("same_as") > 0, F.lit(False)), "root": urls.site_root(F.col("page_url"))})
    each = each.withColumns(T.entity_signals(F.col("text"), F.col("title")))
    first = F.struct(F.length("page_url").alias("n"), F.col("page_url").alias("u"), "page_id")
    flags = [F.bool_or(n).alias(n) for n in ("company_name_detected", "address_detected", "phone_detected", "email_detected", "awards_detected", "certifications_detected", "same_as_detected")]
    business = T.business_type(F.concat_ws(" ", "title", "meta_description", F.substring("text", 1, 1000)))
    named = F.min_by("detected_company_name", F.when(F.col("detected_company_name").isNotNull(), first))
    return each.withColumn("business", business).groupBy("site_id").agg(*flags, named.alias("detected_company_name"), F.max("homepage_brand_mentions").alias("homepage_brand_mentions"), F.min_by("business", first).alias("business_type"), F.min_by("scope_root", first).alias("scope_root"), F.min_by("root", first).alias("root"))
