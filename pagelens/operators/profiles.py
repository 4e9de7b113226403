"""Page profiles: the feature vector that every scorer reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.functions import text as T
from pagelens.functions import urls
from pagelens.operators import site_audit as S
from pagelens.sources import pages as P
from pagelens.sources.pages import fixed, page_facts

KEPT = ["page_id", "url", "page_url", "host", "site_id", "scope_root", "url_type", "locale", "title", "lang", "meta_description", "canonical", "html_length"]


def page_profiles(pages: DataFrame) -> DataFrame:
    """One row per page; the scorers read structured data from json_ld (sources.structured.with_summary)."""
    facts = page_facts(pages)
    texts, levels = F.transform("headings", lambda h: h["text"]), F.transform("headings", lambda h: h["level"])
    labels = lambda c: F.filter(F.transform(c, lambda x: F.trim(x["text"])), lambda t: t != "")
    facts = facts.withColumns({"heading_texts": texts, "heading_levels": levels, "found_words": T.words(F.col("text")), "internal_labels": labels("internal_links"), "external_labels": labels("external_links")})
    facts = fixed(facts, "heading_texts", "heading_levels", "found_words", "internal_labels", "external_labels")
    share = lambda c: F.when(F.size(c) > 0, T.descriptive(F.col(c), F.col("locale")).cast("double") / F.size(c)).otherwise(0.0)
    known = T.looks(F.col("text"), F.col("heading_texts"))
    facts = fixed(facts.withColumns(known), *known)
    signals = T.signals(F.col("text"), F.col("heading_texts"), F.col("locale"), {k: F.col(k) for k in known})
    facts = facts.withColumns({"word_count": F.size("found_words").cast("long"), "lexical": T.variety(F.col("found_words")), "internal_share": share("internal_labels"), "external_share": share("external_labels"), **signals})
    facts = fixed(facts, "word_count", "lexical", "internal_share", "external_share", *signals)
    n = F.size("headings")
    return facts.select(
        *KEPT, "text", "low_text", "has_digits", "raw", "html", "json_ld", "internal_links", "external_links", "heading_texts", "heading_levels",
        "word_count", n.alias("heading_count"), F.size(F.filter("heading_levels", lambda v: v == "h1")).alias("h1_count"), *signals,
        F.bround("lexical", 2).alias("lexical_ratio"),
        T.information_density(F.col("word_count"), F.col("lexical"), F.col("has_quantified_data"), n).alias("information_density_score"),
        T.chunk_structure(F.col("word_count"), n, F.get("heading_levels", F.lit(0))).alias("chunk_structure_score"),
        T.heading_quality(F.col("heading_levels"), F.col("heading_texts")).alias("heading_quality_score"),
        F.size("internal_links").alias("internal_link_count"), F.size("external_links").alias("external_link_count"),
        F.bround("internal_share", 2).alias("descriptive_internal_link_ratio"), F.bround("external_share", 2).alias("descriptive_external_link_ratio"),
        T.link_score(F.size("internal_labels"), F.col("internal_share"), F.size("external_labels"), F.col("external_share")).alias("link_context_score"),
    )


ELEMENTS = ["viewport", "open_graph_present", "twitter_card_present", "hreflang_present", "hreflangs", "noindex", "images_with_alt_ratio", "lazy_ratio", "image_score", "sync_scripts", "stylesheets", "nofollow_links", "ga4", "gsc_verification", "first_h1"]


def with_elements(profiles: DataFrame) -> DataFrame:
    """profiles with the rest of a page's elements: viewport, Open Graph and Twitter cards, hreflang, robots directives, images, scripts, style sheets, analytics."""
    c = F.col
    meta = F.transform(P.tags(c("html"), "meta"), lambda t: F.struct(F.lower(P.attribute(t, "name")).alias("name"), F.lower(P.attribute(t, "property")).alias("property"), F.trim(P.attribute(t, "content")).alias("content")))
    out = fixed(profiles.withColumns({"metas": meta, "images": S.images(c("html")), "measured": S.analytics(c("raw")), "alternates": F.filter(F.transform(P.tags(c("html"), "link"), lambda t: P.attribute(t, "hreflang")), lambda h: h != "")}), "metas", "images", "measured", "alternates")
    any_meta = lambda test: F.exists("metas", test)
    lazy = F.size(F.filter("images", lambda i: F.lower(i["loading"]) == "lazy"))
    out = out.withColumns({
        "viewport": any_meta(lambda m: (m["name"] == "viewport") & (m["content"] != "")),
        "open_graph_present": any_meta(lambda m: F.startswith(m["property"], F.lit("og:"))), "twitter_card_present": any_meta(lambda m: F.startswith(m["name"], F.lit("twitter:"))),
        "hreflang_present": F.size("alternates") > 0, "hreflangs": F.transform("alternates", urls.base_locale), "noindex": any_meta(lambda m: (m["name"] == "robots") & F.lower(m["content"]).contains("noindex")),
        "images_with_alt_ratio": S.alt_ratio(c("images")), "lazy_ratio": F.when(F.size("images") > 0, F.bround(lazy / F.size("images"), 2)).otherwise(0.0), "image_score": S.scores.image_score(c("images")),
        "sync_scripts": S.sync_scripts(c("raw")), "stylesheets": S.stylesheets(c("html")), "nofollow_links": S.nofollow_internal(c("html"), c("page_url")), "ga4": c("measured.ga4"), "gsc_verification": c("measured.gsc_verification"),
        "first_h1": F.get(F.transform(F.filter(F.arrays_zip("heading_levels", "heading_texts"), lambda h: h["heading_levels"] == "h1"), lambda h: h["heading_texts"]), F.lit(0)),
    })
    return fixed(out, *ELEMENTS).drop("metas", "measured", "alternates")
