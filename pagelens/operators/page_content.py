"""The content audit of single pages, AI perception of sites, candidate pages and indexability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions import text as T
from pagelens.functions import urls
from pagelens.functions.numbers import blend, points, score
from pagelens.operators.scores import filled, flag
from pagelens.operators.shared import numbered
from pagelens.sources import pages as P
from pagelens.sources import structured

c = F.col
FACTORS = ("clear_definitions", "quotable_statements", "factual_density", "source_citations", "qa_format", "authority_signals", "content_freshness", "structure_clarity")
EEAT = ("experience", "expertise", "authoritativeness", "trustworthiness")
# Flags that a page without that input counts as false.
OPTIONAL = ("json_ld_present", "has_organization", "has_website", "has_article", "has_faq_page", "has_date_published", "has_date_modified", "has_breadcrumb_list", "has_defined_term", "same_as_detected", "company_name_detected", "awards_detected", "certifications_detected", "phone_detected", "email_detected", "address_detected", "open_graph_present", "twitter_card_present")

# The nine core checks of a page as (id, priority, label, note).
CORE_CHECKS = (
    ("C02", "high", "Direct answer in first 150 words", "Lead with a concise answer block before supporting detail."),
    ("C09", "high", "Structured FAQ with schema", "FAQ and FAQPage schema should appear together on the same page."),
    ("O02", "medium", "Summary box / key takeaways", "A TL;DR block improves answer-first extraction and snippet reuse."),
    ("O05", "high", "JSON-LD schema markup", "The page should expose machine-readable context through JSON-LD."),
    ("O06", "medium", "Section chunking", "Aim for shorter sections and cleaner H2/H3 segmentation."),
    ("R01", "high", "Precise data points", "Specific numbers, units, and benchmarks help AI quote the page."),
    ("R02", "high", "Visible citations", "Pages making factual claims should show sources inline or in a references section."),
    ("R04", "high", "Claims backed by evidence", "Evidence is strongest when quantified claims and citations appear together."),
    ("R07", "medium", "Full entity names", "Expose the brand or organization name clearly in visible copy and schema."),
)


def part(weight: float, column: str) -> Column:
    """A share of another score, rounded on its own."""
    return F.bround(c(column).cast("double") * weight, 0).cast("int")


def on_page_score() -> Column:
    title, meta = F.length(F.coalesce("title", F.lit(""))), F.length(F.coalesce("meta_description", F.lit("")))
    links = F.bround(blend((55, c("descriptive_internal_link_ratio")), (45, c("descriptive_external_link_ratio"))), 0)
    return score(
        points((10, title > 0), (8, meta > 0), (8, filled("canonical")), (5, filled("lang")), (10, c("h1_count") > 0), (5, flag("open_graph_present")), (2, flag("twitter_card_present")), (3, flag("json_ld_present")))
        + F.when(title.between(45, 65), 5).when(title.between(30, 75), 2).otherwise(0) + F.when(meta.between(80, 170), 4).when(meta.between(40, 200), 2).otherwise(0)
        + F.when(c("heading_count") >= 3, 10).when(c("heading_count") >= 2, 5).otherwise(0) + F.bround(c("images_with_alt_ratio") * 10.0, 0).cast("int")
        + F.when(c("internal_link_count") >= 3, 8).when(c("internal_link_count") >= 1, 4).otherwise(0) + F.least(F.lit(12), F.bround(links * 0.12, 0).cast("int"))
    )


def schema_support() -> Column:
    return score(
        points((15, flag("json_ld_present")), (15, flag("has_article")), (10, flag("has_faq_page")), (10, flag("has_organization") | flag("has_website")), (10, flag("has_date_published")), (10, flag("has_date_modified")), (5, flag("has_breadcrumb_list")), (8, F.coalesce(F.size("same_as"), F.lit(0)) > 0), (7, c("entity_id_count") >= 2), (5, c("relation_count") >= 3), (5, flag("has_defined_term")))
        + F.least(F.lit(10), F.coalesce(part(0.1, "visible_alignment_score"), F.lit(0)))
    )


def content_factors() -> dict[str, Column]:
    tokens = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\S+"), F.lit(0))
    defines = T.found(F.lower(F.array_join(F.slice(tokens, 1, 120), " ")), {"default": [r"is a", r"is an", r"refers to", r"means", r"is the process", r"defined as"]})
    return {
        "clear_definitions": F.when(defines, 92).when(flag("answer_first"), 72).otherwise(35),
        "quotable_statements": score(points((25, flag("has_quantified_data")), (25, flag("has_inline_citations")), (15, flag("has_reference_section"))) + part(0.2, "information_density_score") + part(0.15, "chunk_structure_score")),
        "factual_density": c("information_density_score"),
        "source_citations": score(points((55, flag("has_reference_section")), (45, flag("has_inline_citations")))),
        "qa_format": score(points((60, flag("has_faq")), (40, flag("answer_first")))),
        "authority_signals": score(points((28, flag("has_author")), (18, flag("same_as_detected")), (14, flag("company_name_detected")), (20, flag("has_reference_section")), (20, flag("has_article")))),
        "content_freshness": score(points((40, flag("has_publish_date")), (20, flag("has_update_log")), (20, flag("has_date_published")), (20, flag("has_date_modified")))),
        "structure_clarity": score(blend((0.55, c("heading_quality_score")), (0.45, c("chunk_structure_score")))),
    }


def eeat() -> dict[str, Column]:
    by_words = lambda a, b, rest: F.when(c("word_count") >= 900, a).when(c("word_count") >= 500, b).otherwise(rest)
    return {
        "experience": score(points((25, flag("has_quantified_data")), (20, flag("has_reference_section")), (15, flag("has_inline_citations")), (15, flag("has_update_log"))) + by_words(25, 15, 5)),
        "expertise": score(points((25, flag("answer_first"))) + by_words(20, 10, 0) + part(0.2, "heading_quality_score") + part(0.2, "information_density_score") + part(0.15, "chunk_structure_score")),
        "authoritativeness": score(points((25, flag("has_author")), (15, flag("company_name_detected")), (15, flag("same_as_detected")), (15, flag("has_reference_section")), (15, flag("has_article")), (15, flag("awards_detected") | flag("certifications_detected")))),
        "trustworthiness": score(points((20, flag("has_publish_date")), (15, filled("canonical")), (10, filled("lang")), (15, flag("has_inline_citations")), (10, filled("meta_description")), (10, flag("has_date_published") | flag("has_date_modified")), (10, flag("has_update_log")), (10, flag("phone_detected") | flag("email_detected") | flag("address_detected")))),
    }


def page_content_audit(profiles: DataFrame) -> DataFrame:
    """profiles (+ structured data and entity signals where known) -> factors, E-E-A-T, readiness, lenses and overall score of every page."""
    profiles = structured.with_summary(profiles)
    missing = {n: F.lit(False) for n in OPTIONAL if n not in profiles.columns}
    missing |= {n: F.lit(v) for n, v in (("images_with_alt_ratio", 1.0), ("entity_id_count", 0), ("relation_count", 0), ("visible_alignment_score", 0)) if n not in profiles.columns}
    if "same_as" not in profiles.columns:
        missing["same_as"] = F.array().cast("array<string>")
    out = profiles.withColumns(missing) if missing else profiles
    out = out.withColumns({**content_factors(), **eeat(), "on_page_score": on_page_score(), "schema_support_score": schema_support()})
    mean = lambda names: sum((c(n).cast("double") for n in names[1:]), c(names[0]).cast("double")) / float(len(names))
    out = out.withColumn("readiness_score", score(mean(FACTORS)))
    out = out.withColumn("page_content_score", score(blend((0.55, c("readiness_score"))) + mean(EEAT) * 0.45))
    out = out.withColumns({"lens_score": score(blend((0.75, c("readiness_score")), (0.25, c("schema_support_score")))), "page_score": score(blend((0.65, c("page_content_score")), (0.2, c("on_page_score")), (0.15, c("schema_support_score"))))})
    weakest = F.slice(F.array_sort(F.array(*[F.struct(c(n).cast("int").alias("score"), F.lit(i).alias("ord"), F.lit(n).alias("factor")) for i, n in enumerate(FACTORS)])), 1, 2)
    return out.select("page_id", "page_url", *FACTORS, *EEAT, "readiness_score", "page_content_score", "on_page_score", "schema_support_score", "lens_score", "page_score", F.transform(weakest, lambda w: w["factor"]).alias("weakest"))


def core_checks(profiles: DataFrame) -> DataFrame:
    """profiles (+ company_name_detected where the site's is known, else the title's) -> nine rows a page: check_id, priority, label, passed, note."""
    out = structured.with_summary(profiles)
    named = flag("company_name_detected") if "company_name_detected" in out.columns else T.company_name(c("title")).isNotNull()
    cited = flag("has_reference_section") | flag("has_inline_citations")
    passed = {
        "C02": flag("answer_first"),
        "C09": flag("has_faq") & flag("has_faq_page"),
        "O02": flag("has_tldr"),
        "O05": flag("json_ld_present"),
        "O06": c("chunk_structure_score") >= 60,
        "R01": flag("has_quantified_data") & (c("information_density_score") >= 60),
        "R02": cited,
        "R04": flag("has_quantified_data") & cited,
        "R07": named,
    }
    rows = [F.struct(F.lit(i).alias("check_id"), F.lit(p).alias("priority"), F.lit(label).alias("label"), F.coalesce(passed[i], F.lit(False)).alias("passed"), F.lit(note).alias("note")) for i, p, label, note in CORE_CHECKS]
    return out.select("page_id", "page_url", F.inline(F.array(*rows)))


def audit_candidates(sites: DataFrame, candidates: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """sites (site_id, base_url), candidates and known (site_id, url) -> the `most` shortest new internal pages of each site."""
    new = candidates.where("url <> ''").distinct().join(known, ["site_id", "url"], "left_anti").join(sites, "site_id")
    usable = ~F.lower("url").rlike("/tag/|/author/|/category/|/page/|utm_|#")
    kept = new.where(urls.is_internal(c("url"), c("base_url")) & usable)
    order = Window.partitionBy("site_id").orderBy(F.length("url"), "url")
    return kept.withColumn("ord", F.row_number().over(order)).where(c("ord") <= most).select("site_id", "ord", "url")


def merge_candidates(*groups: DataFrame) -> DataFrame:
    """Groups of (site_id, pos, url, source) in order of precedence -> site_id, url, source, ord: each URL of a site once, with the source that named it first.

    ord counts a site's URLs from 1 by group and pos, then URL.  All sites are numbered in one sort by ranges, so a site of any size is dealt over tasks.
    """
    rows = None
    for i, group in enumerate(groups):
        own = group.select("site_id", F.lit(i).alias("_group"), c("pos").cast("long").alias("_pos"), urls.normalize_url(c("url")).alias("url"), "source")
        rows = own if rows is None else rows.unionByName(own)
    first = rows.where("url is not null and site_id is not null").groupBy("site_id", "url").agg(F.min(F.struct("_group", "_pos", "source")).alias("f")).select("site_id", "url", "f.*")
    counted, _ = numbered(first, ["site_id", "_group", "_pos", "url"], 0, "_number")
    begins = counted.groupBy("site_id").agg(F.min("_number").alias("_begin"))
    return counted.join(begins, "site_id").select("site_id", "url", "source", (c("_number") - c("_begin") + 1).alias("ord"))


def indexability(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> what a search engine reads: canonical, directives, words with CJK characters counted one by one."""
    raw = F.coalesce("html", F.lit(""))
    bare = raw
    for tag in ("noscript", "svg"):
        bare = F.regexp_replace(bare, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    out = pages.select("page_id", urls.normalize_url(c("url")).alias("page_url"), raw.alias("raw"), P.visible(bare).alias("text"))
    named = F.filter(P.tags(c("raw"), "meta"), lambda t: F.lower(F.trim(P.attribute(t, "name"))).isin("robots", "googlebot"))
    directives = F.flatten(F.transform(named, lambda t: F.transform(F.split(P.attribute(t, "content"), ","), lambda d: F.lower(F.trim(d)))))
    canonical = F.get(F.transform(F.filter(P.tags(c("raw"), "link"), lambda t: F.lower(P.attribute(t, "rel")).contains("canonical")), lambda t: urls.absolute(P.attribute(t, "href"), c("page_url"))), F.lit(0))
    anchors = F.transform(P.tags(c("raw"), "a"), lambda t: urls.absolute(F.trim(P.attribute(t, "href")), c("page_url")))
    inside = F.array_distinct(F.transform(F.filter(anchors, lambda u: urls.host(F.lower(u)) == urls.host(c("page_url"))), lambda u: F.split(u, "#")[0]))
    cjk = r"[㐀-䶿一-鿿぀-ヿ가-힯]|[A-Za-z0-9À-ɏ]+(?:['’-][A-Za-z0-9À-ɏ]+)*"
    kept = F.array_sort(F.array_distinct(F.filter(directives, lambda d: d != "")))
    return out.select("page_id", "page_url", F.coalesce(canonical, F.lit("")).alias("canonical"), kept.alias("directives"), F.array_contains(kept, "noindex").alias("noindex"), F.regexp_count("text", F.lit(cjk)).alias("word_count"), F.substring("text", 1, 500).alias("text_preview"), F.size(inside).alias("internal_link_count"), F.size(P.tags(c("raw"), "script")).alias("script_count"), F.octet_length("raw").alias("html_bytes"))


def bounded_adjustments(base: DataFrame, deltas: DataFrame, key: str, most: dict[str, int]) -> DataFrame:
    """Scores moved by outside judgements (key, <score>_delta as text): each delta within its bound, the score within 0..100; what is no number moves nothing."""
    joined = base.join(deltas, key, "left")
    moved = {n: score(c(n) + F.greatest(F.lit(-m), F.least(F.lit(m), F.coalesce(c(f"{n}_delta").try_cast("int"), F.lit(0))))) for n, m in most.items()}
    return joined.withColumns(moved).select(base.columns)
