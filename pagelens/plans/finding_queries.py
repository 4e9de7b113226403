"""Findings of the site audits in words, with SQL that states each rule's condition by itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelens.operators import findings, localize, scores
from pagelens.operators.profiles import page_profiles
from pagelens.plans import oracle_parts as O
from pagelens.plans import oracle_site as S
from pagelens.plans import site_inputs
from pagelens.plans.catalogue import query
from pagelens.sources.pages import read_pages

#: module -> rule -> (condition, what a strength needs besides); conditions over the oracle's table m.
CONDITIONS = {
    "visibility": {
        "crawlers": "crawlers_allowed < crawlers", "no_llms": "llms_length = 0", "thin_llms": ("llms_length > 0 and llms_score < 60", "llms_length > 0"), "citability": "citability < 60", "presence": "presence_score < 50", "brand": "brand_score < 50",
    },
    "technical": {
        "https": "home.page_url not like 'https://%'", "security": "security_count < 4", "meta": "home.meta_description is null", "locale": ("target_locale is not null and string_split(coalesce(home.lang, ''), '-')[1] <> target_locale", "target_locale is not null and home.lang is not null"),
        "canonical": "home.canonical is null", "h1": "home.h1_count <> 1", "blocking": "home.sync_scripts * 20 + home.sheets * 10 >= 35", "speed": "milliseconds > 800", "images": "home.image_score < 60", "hreflang": "target_locale <> 'fr' and home.hreflang",
        "revalidation": ("not etag and not last_modified", "etag::int * 45 + last_modified::int * 25 + home.has_publish_date::int * 15 + home.has_update_log::int * 15 >= 60"),
    },
    "schema": {
        "json_ld": "not ld", "type_has_organization": "not organization", "type_has_local_business": "true", "type_has_article": "not article_type", "type_has_faq_page": "not faq_type", "type_has_service": "not service_type", "type_has_website": "not website", "type_has_product": "not product_type", "type_has_defined_term": "not term_type",
        "same_as": "not same_as", "breadcrumbs": "true", "dates": "not pub and not mod", "alignment": "alignment < 60", "ids": "ids < 2", "relations": "relations < 3",
    },
    "content": {
        "no_service": "service is null", "thin_service": ("service.word_count < 300", "service is not null"), "no_article": "article is null", "thin_article": ("article.word_count < 600", "article is not null"), "faq": "not a_faq", "author": "not a_author", "date": "not a_date",
        "references": "not a_references", "citations": "not a_citations", "tldr": "not a_tldr", "answer": "not a_answer", "density": "md < 55", "chunks": "mc < 55", "links": "ml < 55",
    },
    "platform": {**S.GAPS, **{f"strong_{p}": f"{p}_score < 65" for p in S.GAPS}},
    "ai": {"crawlers": "crawlers_allowed < crawlers", "llms": "llms_score < 60", "citability": "citability < 70", "presence": "presence_score < 60"},
    "brand": {"weak": "brand_score < 60", "backlinks": "backlink_score < 60", "sitemap": "not same_domain_sitemap"},
}


def _rules(module: str) -> list[findings.Rule]:
    return {**findings.MODULES, "ai": findings.ai_dimension_rules, "brand": findings.brand_dimension_rules}[module]()


def _lists(module: str) -> dict[str, str]:
    given = {n: (x, "true") if isinstance(x, str) else x for n, x in CONDITIONS[module].items()}
    some = lambda cases: "list_filter([" + ", ".join(cases) + "]::varchar[], lambda x: x is not null)"
    rules = _rules(module)
    out = {
        "issue": some(f"case when {given[r.name][0]} then {O.q(r.issue)} end" for r in rules if r.issue), "strength": some(f"case when not coalesce({given[r.name][0]}, false) and ({given[r.name][1]}) then {O.q(r.strength)} end" for r in rules if r.strength),
        "recommendation": some(f"case when {given[r.name][0]} then {O.q(r.recommendation)} end" for r in rules if r.recommendation),
    }
    if module == "schema":
        out["recommendation"] += "[1:5]"
    if module == "platform":
        out["recommendation"] = "[" + ", ".join(map(O.q, findings.PLATFORM_ADVICE)) + "]"
    return out


def _rules_sql() -> str:
    modules = [*findings.MODULES, "ai", "brand"]
    return f"""{S.SITES},
fl as materialized (select site_id, host, composite_score, visibility_score, brand_score, quality_score, technical_score, schema_score, platform_score, {', '.join(f'{v} as {m}_{k}' for m in modules for k, v in _lists(m).items())} from m)"""


@query("with " + _rules_sql() + ", x as (" + " union all ".join(f"select site_id, '{m}' as module, '{k}' as kind, {m}_{k} as texts from fl" for m in findings.MODULES for k in ("issue", "strength", "recommendation")) + ") select site_id, module, kind, generate_subscripts(texts, 1)::int as pos, unnest(texts) as finding from x")
def site_findings(spark, sf_dir):
    """Issues, strengths and recommendations of five modules, of all sites."""
    from pagelens.plans.queries import _sites

    return findings.site_findings(_sites(spark, sf_dir))


_FOUND = "x as (" + " union all ".join(f"select site_id, '{m}' as module, '{k}' as kind, {m}_{k} as texts from fl" for m in findings.MODULES for k in ("issue", "strength", "recommendation")) + "), y as (select site_id, module, kind, generate_subscripts(texts, 1)::int as pos, unnest(texts) as finding from x)"
_ZH = "case finding " + " ".join(f"when {O.q(k)} then {O.q(v)}" for k, v in localize.PHRASES["zh"].items()) + " else case " + " ".join(f"when regexp_matches(finding, {O.q(p)}) then regexp_replace(finding, {O.q(p)}, {O.q(r.replace('$1', chr(92) + '1'))})" for p, r in localize.TEMPLATES["zh"]) + " else finding end end"


@query(f"with {_rules_sql()}, {_FOUND} select site_id, module, kind, pos, {_ZH} as finding from y")
def site_findings_localized(spark, sf_dir):
    """The findings of all sites in Chinese, translated inside their nested lists."""
    from pagelens.plans.queries import _sites

    return findings.site_findings(_sites(spark, sf_dir), "zh")


_VIEWS = {
    "visibility": ("case when len(ai_issue) > 0 then ai_issue else visibility_issue[1:2] end", "case when len(ai_recommendation) > 0 then ai_recommendation else visibility_recommendation[1:2] end"),
    "brand": (f"case when len(brand_issue) > 0 then brand_issue else [{O.q(findings.BRAND_ISSUE)}] end", f"case when len(brand_recommendation) > 0 then brand_recommendation else [{O.q(findings.BRAND_ADVICE)}] end"),
    **{d: (f"{d}_issue", f"{d}_recommendation") for d in ("content", "technical", "schema", "platform")},
}


@query("with " + _rules_sql() + ", v as (" + " union all ".join(f"select site_id, host, composite_score, {findings.DIMENSIONS[d]} as score, {i} as ord, {O.q(findings.NAMES[d][0])} as label, {O.q(findings.NAMES[d][1])} as module, {_VIEWS[d][0]} as issues, {_VIEWS[d][1]} as wins from fl" for i, d in enumerate(findings.DIMENSIONS)) + f"""),
r as (select *, row_number() over (partition by site_id order by score, ord) as rank from v),
i as (select site_id, label || ': ' || unnest(issues) as t, rank, generate_subscripts(issues, 1) as k from r), i1 as (select site_id, t, min((rank, k)) as spot from i group by 1, 2), i2 as (select site_id, string_agg(t, chr(10) order by spot) as top_issues from (select * from i1 qualify row_number() over (partition by site_id order by spot) <= {findings.TOP}) group by 1),
w as (select site_id, unnest(wins) as t, rank, generate_subscripts(wins, 1) as k from r), w1 as (select site_id, t, min((rank, k)) as spot from w group by 1, 2), w2 as (select site_id, string_agg(t, chr(10) order by spot) as quick_wins from (select * from w1 qualify row_number() over (partition by site_id order by spot) <= {findings.TOP}) group by 1),
p1 as (select *, row_number() over (partition by site_id order by rank) as n from r where len(wins) > 0), p2 as (select site_id, string_agg(case when rank = 1 then 'high' when rank <= 3 then 'medium' else 'low' end || '|' || module || '|' || wins[1], chr(10) order by rank) as plan from p1 where n <= {findings.TOP} group by 1),
s as (select site_id, min(host) || ' currently scores ' || min(composite_score) || '/100 for GEO readiness. The biggest gaps are in ' || max(label) filter (rank = 1) || ' and ' || max(label) filter (rank = 2) || '.' as summary from r group by 1)
select s.site_id, summary, coalesce(top_issues, '') as top_issues, coalesce(quick_wins, '') as quick_wins, coalesce(plan, '') as plan from s left join i2 using (site_id) left join w2 using (site_id) left join p2 using (site_id)""")
def site_summary(spark, sf_dir):
    """The summary of every site in words: gaps, top issues, quick wins, plan."""
    from pagelens.plans.queries import _sites

    out = findings.site_summary(_sites(spark, sf_dir))
    plan = F.array_join(F.transform("plan", lambda s: F.concat_ws("|", s["priority"], s["module"], s["action"])), "\n")
    return out.select("site_id", "summary", F.array_join("top_issues", "\n").alias("top_issues"), F.array_join("quick_wins", "\n").alias("quick_wins"), plan.alias("plan"))


# -- pages with drawn elements: structured data, metadata and canonical links count ---------------

_IS = lambda name: f"list_contains(types, '{name}')"
_TECHNICAL = O.score(O.points((20, "title is not null"), (15, "meta_description is not null"), (15, "canonical is not null"), (10, "lang is not null"), (10, "h1_count = 1")) + " + case when heading_count >= 3 then 20 when heading_count > 0 then 10 else 0 end + case when word_count >= 250 then 20 when word_count >= 100 then 10 else 0 end")
_SCHEMA = O.score(O.points((18, "ld"), (15, _IS("Organization")), (15, _IS("Service")), (10, _IS("Article")), (10, _IS("FAQPage")), (10, _IS("Product")), (6, _IS("DefinedTerm")), (5, "pub"), (5, "mod"), (5, "alignment >= 60"), (10, "same_as")))
_DRAWN = f"""{S.ELEMENTS_SQL}, s0 as (select *, {O.CONTENT} as content_score, {_TECHNICAL} as technical_score, {_SCHEMA} as schema_score from e),
s as (select *, {O.score("citability_score::double * 0.35::double + content_score::double * 0.3::double + technical_score::double * 0.2::double + schema_score::double * 0.15::double")} as overall_score from s0)"""
_DRAWN_RULES = sorted([*O.RULES, (8, "schema", "schema_score >= 50 and alignment < 60"), (9, "freshness", "ld and not pub and not mod")])


def _drawn_scores(spark, sf_dir):
    return scores.scored_pages(page_profiles(site_inputs.with_elements(read_pages(spark, sf_dir))))


@query(f"with {_DRAWN} select page_id, citability_score, content_score, technical_score, schema_score, overall_score, {O.status('overall_score')} as status from s")
def drawn_page_scores(spark, sf_dir):
    """The scores of every page with drawn elements, structured data included."""
    return _drawn_scores(spark, sf_dir).select("page_id", "citability_score", "content_score", "technical_score", "schema_score", "overall_score", "status")


@query(f"with {_DRAWN} " + " union all ".join(f"select page_id, {i} as ord, {O.q(c)} as category from s where {t}" for i, c, t in _DRAWN_RULES))
def drawn_page_issues(spark, sf_dir):
    """The issues of every page with drawn elements; on the given tables no page breaks the rules 3, 6, 10 and 11."""
    return _drawn_scores(spark, sf_dir).select("page_id", F.explode(scores.issues()).alias("x")).select("page_id", "x.ord", "x.category")


@query(f"""with {_DRAWN}, d as (select *, {O.points(*[(1, f"({t})") for _, _, t in _DRAWN_RULES])} as issue_count from s), r as (select *, row_number() over (partition by site_id order by overall_score, issue_count desc, page_url, page_id) as rank from d)
select site_id, rank, page_id, page_url, overall_score, {O.status('overall_score')} as status, citability_score, content_score, technical_score, schema_score, issue_count from r where rank <= 12""")
def drawn_page_diagnostics_topk(spark, sf_dir):
    """The twelve worst pages of each site, with drawn elements."""
    return scores.worst_pages(_drawn_scores(spark, sf_dir))
