"""DuckDB SQL of the site audits, written from the rules: a row of facts per site, module scores, checks."""

from __future__ import annotations

from pagelens.functions import text as T
from pagelens.operators import modules, rollup, scores, seo
from pagelens.plans import oracle_parts as O
from pagelens.plans.site_inputs import ELEMENTS, SQL_INPUTS

PAGES = f"pg as (select page_id, url, {ELEMENTS} as html from pages), " + O.PROFILES.replace("from pages)", "from pg)")
_ORDER = "(length(page_url), page_url, page_id)"


def _count(pattern: str, text: str = "html") -> str:
    return f"len(regexp_extract_all({text}, {O.q(pattern)}))"


CITABILITY = O.CITABILITY.replace("case when title is not null then 8 else 0 end", "case when title is not null then 8 else 0 end + case when meta_description is not null then 8 else 0 end + case when canonical is not null then 8 else 0 end", 1)

ELEMENTS_SQL = f"""{PAGES},
e0 as (select *, nullif(trim(regexp_extract(html, '<meta name="description" content="([^"]*)"', 1)), '') as meta_description, nullif(regexp_extract(html, '<link rel="canonical" href="([^"]*)"', 1), '') as canonical,
  contains(html, 'property="og:') as og, contains(html, 'name="twitter:') as tw, contains(html, 'name="viewport"') as viewport, contains(html, 'hreflang="') as hreflang, regexp_matches(html, 'name="robots" content="[^"]*noindex') as noindex,
  {_count('<img ')} as imgs, {_count('<img [^>]*alt="[^"]+"')} as alts, {_count('<img [^>]*loading="lazy"')} as lazy, {_count('<img [^>]*width="[^"]+" height="[^"]+"')} as sized,
  len(list_filter(regexp_extract_all(raw, '<script[^>]*>'), lambda x: contains(x, 'src=') and not regexp_matches(x, '\\s(async|defer)\\b'))) as sync_scripts, {_count('<link [^>]*stylesheet')} as sheets,
  contains(lower(raw), 'googletagmanager.com/gtag/js') or contains(lower(raw), 'gtag(') or regexp_matches(raw, '\\bG-[A-Z0-9]{{4,}}\\b') as ga4, contains(html, 'google-site-verification') as gsc,
  heading_texts[list_position(heading_levels, 'h1')] as first_h1, contains(raw, 'application/ld+json') as ld, regexp_extract_all(raw, '"@type":"([A-Za-z]+)"', 1) as types, contains(raw, '"sameAs"') as same_as, {_count('"@id"', 'raw')} as ids,
  {_count('"(brand|sameAs|about|mentions|offers)"', 'raw')} as relations, contains(raw, '"headline"') as has_text, contains(raw, '"datePublished"') as pub, contains(raw, '"dateModified"') as mod,
  case when regexp_matches(title, '[|-]') then nullif(trim(string_split_regex(title, '[|-]')[-1]), '') end as company, lower(text) as low from p),
e as (select *, {CITABILITY} as citability_score, case when imgs = 0 then 1.0::double else round_even(alts::double / imgs, 2) end as alt_ratio, case when imgs = 0 then 0.0::double else round_even(lazy::double / imgs, 2) end as lazy_ratio,
  case when imgs = 0 then 70 else {O.score('lazy::double / imgs * 50.0::double + sized::double / imgs * 50.0::double')} end as image_score, case when not ld then 0 when has_text then case when contains(low, 'words that stand on no page') then 100 else 0 end else 50 end as alignment,
  case when length(company) > 0 then (length(low) - length(replace(low, lower(company), ''))) // length(company) else 0 end as mentions from e0)"""

_PAGE = ["has_faq", "has_author", "has_publish_date", "has_quantified_data", "has_reference_section", "has_inline_citations", "has_tldr", "has_update_log", "answer_first", "word_count", "heading_quality_score", "information_density_score", "chunk_structure_score", "descriptive_internal_link_ratio", "descriptive_external_link_ratio", "page_url"]
_HOME = ["title", "meta_description", "canonical", "lang", "viewport", "og", "tw", "hreflang", "h1_count", "first_h1", "html_length", "word_count", "image_score", "lazy_ratio", "sync_scripts", "sheets", "ga4", "gsc", "has_publish_date", "has_update_log", "citability_score", "page_url"]
_pack = lambda names: "struct_pack(" + ", ".join(f"{n} := {n}" for n in names) + ")"
_type = lambda *names: "bool_or(" + " or ".join(f"list_contains(types, '{n}')" for n in names) + ")"
_match = lambda pattern: f"bool_or(regexp_matches(low, {O.q(pattern)}))"

FACTS = f"""{ELEMENTS_SQL},
st as (select site_id, count(*) as n, min(host) as host, arg_min({_pack(_HOME)}, {_ORDER}) as home, max(citability_score) as best,
  {", ".join(f"arg_min({_pack(_PAGE)}, {_ORDER}) filter (where regexp_matches(lower(page_url), {O.q('|'.join(words))})) as {kind}" for kind, words in rollup.KEY_PAGES.items())},
  bool_or(ld) as ld, {_type('Organization')} as organization, {_type('WebSite')} as website, {_type('Service')} as service_type, {_type('Article')} as article_type, {_type('FAQPage')} as faq_type, {_type('Product')} as product_type, {_type('DefinedTerm')} as term_type,
  bool_or(pub) as pub, bool_or(mod) as mod, bool_or(same_as) as same_as, max(ids) as ids, sum(relations)::bigint as relations, round_even(avg(alignment), 0)::int as alignment, bool_or(company is not null) as named,
  {_match(T.ADDRESS)} as address, {_match(T.PHONE)} as phone, {_match(T.EMAIL)} as email, {_match('|'.join(T.AWARDS))} as awards, {_match('|'.join(T.CERTIFICATES))} as certificates, arg_min(company, {_ORDER}) filter (where company is not null) as company, max(mentions) as mentions,
  count(*) filter (where not starts_with(url, 'https://')) as not_https, count(*) filter (where regexp_matches(url, '[?_]') or lower(url) <> url or length(url) > 110) as dirty, count(*) filter (where title is null) as no_title,
  count(*) filter (where title is not null and length(title) not between 45 and 65) as odd_titles, count(*) filter (where meta_description is null) as no_meta, count(*) filter (where length(meta_description) not between 80 and 170) as odd_metas,
  count(*) filter (where h1_count <> 1) as odd_h1, count(*) filter (where lang is null) as no_lang, count(*) filter (where html_length > 250000) as heavy, count(*) filter (where canonical <> page_url) as other_canonical,
  count(*) filter (where alt_ratio < 0.8) as poor_alts, count(*) filter (where noindex) as noindex from e group by site_id)"""


def _any(name: str) -> str:
    return "(" + " or ".join(f"coalesce({k}.{name}, false)" for k in modules.CONTENT_KINDS) + ")"


def _mean(value) -> str:
    kinds = modules.CONTENT_KINDS
    total = " + ".join(f"case when {k} is not null then ({value(k)})::double else 0 end" for k in kinds)
    number = " + ".join(f"({k} is not null)::int" for k in kinds)
    return f"case when {number} > 0 then ({total}) / ({number}) else 0.0::double end"


_CONTENT = f"(case when service.word_count >= 400 then 15 when service.word_count >= 200 then 7 else 0 end + case when article.word_count >= 800 then 20 when article.word_count >= 400 then 10 else 0 end + {O.points((8, 'a_faq'), (10, 'a_author'), (7, 'a_date'), (12, 'a_numbers'), (6, 'a_references'), (4, 'a_citations'), (4, 'a_tldr'))})::double + mh / 100 * 12 + md / 100 * 10 + mc / 100 * 8 + ml / 100 * 6 + {O.points((8, 'a_answer'))}"
_TECHNICAL = f"({O.points((8, 'starts_with(home.page_url, chr(104) || chr(116) || chr(116) || chr(112) || chr(115) || chr(58) || chr(47) || chr(47))'), (5, 'home.meta_description is not null'), (5, 'home.canonical is not null'), (4, 'home.lang is not null'), (4, 'home.h1_count = 1'), (8, 'sitemap_exists'), (4, 'robots_has_sitemap'), (5, 'home.og'), (3, 'home.tw'), (4, 'home.hreflang'), (4, 'etag or last_modified'))})::double + ssr::double / 100 * 10 + (security_count * 20)::double / 100 * 16 + home.image_score::double / 100 * 4 + blocking::double / 100 * 8 + speed::double / 100 * 8"
_HOLDS = lambda v: f"(length(brand) > 0 and contains(lower(coalesce({v}, '')), brand))"
_ROBUST = "case when authority is not null then greatest(0, least(100, round_even(authority * 0.4::double + least(100, floor(domains / 5)) * 0.25::double + floor(ip_classes / 3) * 0.15::double + floor(follow * 100) * 0.2::double, 0)::int)) end"
_known = ("backlink_score", "mentions_score", "consistency_score", "completeness_score")

SITES = f"""{FACTS},
m0 as (select st.*, i.* exclude (site_id), {", ".join(f"{_any(v)} as a_{k}" for k, v in (("faq", "has_faq"), ("author", "has_author"), ("date", "has_publish_date"), ("numbers", "has_quantified_data"), ("references", "has_reference_section"), ("citations", "has_inline_citations"), ("tldr", "has_tldr"), ("updates", "has_update_log"), ("answer", "answer_first")))},
  {_mean(lambda k: f"{k}.heading_quality_score")} as mh, {_mean(lambda k: f"{k}.information_density_score")} as md, {_mean(lambda k: f"{k}.chunk_structure_score")} as mc,
  {_mean(lambda k: f"least(100, round_even({k}.descriptive_internal_link_ratio * 55.0::double + {k}.descriptive_external_link_ratio * 45.0::double, 0))")} as ml,
  case when best > home.citability_score then {O.score("home.citability_score::double * 0.45::double + best::double * 0.55::double")} else home.citability_score end as citability, lower(trim(coalesce(company, ''))) as brand,
  case when home.html_length >= 5000 and home.word_count >= 300 then 100 when home.html_length >= 2500 and home.word_count >= 120 then 70 when home.html_length >= 1200 and home.word_count >= 60 then 45 else 20 end as ssr,
  100 - least(100, home.sync_scripts * 20 + home.sheets * 10) as blocking, case when milliseconds <= 300 then 100 when milliseconds <= 800 then 75 when milliseconds <= 1500 then 50 else 25 end as speed, crawlers_allowed::double / crawlers as crawler_ratio,
  {O.points((35, "home.meta_description is not null"), (25, "home.canonical is not null"), (20, "home.og"), (20, "home.tw"))} as metadata_signal, {O.points((20, "ld"), (25, "organization"), (15, "website"), (20, "service_type"), (20, "article_type or faq_type"))} as schema_signal,
  {O.points((40, "ids >= 2"), (35, "relations >= 3"), (25, "term_type"))} as entity_signal, case when faq_type then 100 else 30 end as faq_signal
  from st join {SQL_INPUTS} i on st.site_id = i.site_id),
m1 as (select *, {O.score(_CONTENT)} as content_score, {O.score(O.points((30, "case_study is not null"), (20, "a_numbers"), (20, "service.word_count >= 300"), (30, "about is not null")))} as experience_score,
  {O.score("(" + O.points((35, "service.word_count >= 400"), (25, "article.word_count >= 800"), (20, "a_answer")) + ") + mh / 100 * 10 + md / 100 * 10")} as expertise_score,
  {O.score(O.points((25, "about is not null"), (20, "a_author"), (20, "awards"), (15, "certificates"), (20, "same_as"), (10, "a_references")))} as authoritativeness_score,
  {O.score(O.points((25, "contact is not null"), (15, "phone"), (15, "email"), (15, "address"), (15, "a_date"), (15, "a_author"), (10, "a_citations"), (5, "a_updates")))} as trustworthiness_score,
  {O.score(_TECHNICAL)} as technical_score, {O.score(O.points((8, "ld"), (12, "organization"), (6, "website"), (9, "service_type"), (9, "article_type"), (7, "faq_type"), (9, "product_type"), (5, "term_type"), (8, "same_as"), (4, "ids >= 2"), (4, "relations >= 3"), (4, "pub"), (4, "mod")) + " + case when alignment >= 60 then 7 when alignment >= 30 then 3 else 0 end")} as schema_score,
  {O.score(O.points((20, "llms_length > 0"), (20, "llms_length >= 250"), (20, "llms_length > 0 and length(brand) > 0 and contains(lower(llms_preview), lower(company))"), (20, "regexp_matches(lower(llms_preview), 'service|product|solution|platform')"), (10, "regexp_matches(lower(llms_preview), 'citation|cite|canonical|contact|preferred')"), (10, "regexp_matches(llms_preview, '(?m)^#')")))} as llms_score,
  {O.score(O.points((35, "named"), (25, "phone or email"), (20, "about is not null"), (20, "contact is not null")))} as presence_score,
  {O.score(f"least(45, ({O.points((1, _HOLDS('home.title')), (1, _HOLDS('home.meta_description')), (1, _HOLDS('home.first_h1')), (1, _HOLDS('llms_preview')))}) * 15) + case when mentions >= 2 then 20 when mentions = 1 then 10 else 0 end + {O.points((20, 'about is not null'), (15, 'contact is not null'))}")} as mentions_score,
  {O.score(O.points((35, "same_as"), (20, "organization"), (20, f"{_HOLDS('home.title')} or {_HOLDS('home.first_h1')} or {_HOLDS('llms_preview')}"), (15, "about is not null and contact is not null"), (10, "same_domain_sitemap")))} as consistency_score,
  {O.score(O.points((20, "named"), (15, "address"), (15, "phone"), (15, "email"), (10, "about is not null"), (10, "contact is not null"), (10, "awards"), (5, "certificates")))} as completeness_score, {_ROBUST} as backlink_score from m0),
m2 as (select *, {O.score(f"({' + '.join(f'coalesce({k} * 0.25::double, 0)' for k in _known)}) / (({' + '.join(f'({k} is not null)::int' for k in _known)}) * 0.25::double)")} as brand_score, {O.score("(content_score + experience_score + expertise_score + authoritativeness_score + trustworthiness_score)::double / 5")} as quality_score,
  {O.score("floor(crawler_ratio * 100) * 0.32::double + citability * 0.40::double + llms_score * 0.12::double + presence_score * 0.16::double")} as visibility_score from m1),
m3 as (select *, {", ".join(O.score(" + ".join(f"{s}::double * {float(w)}::double" for s, w in model.items())) + f" as {p}_score" for p, model in modules.PLATFORM_MODELS.items())} from m2),
m4 as (select *, {O.score(" + ".join(f"{p}_score::double * {w}::double" for p, w in scores.PLATFORMS.items()))} as platform_score from m3),
m as (select *, {O.score("0.0::double + " + " + ".join(f"round_even({modules.DIMENSIONS[d]}::double * {w}::double, 2)" for d, w in scores.COMPOSITE.items()))} as composite_score from m4)"""

_TESTS = {
    "CHK-001": "robots_exists and robots_has_sitemap", "CHK-002": "sitemap_exists and sitemap_https and sitemap_clean", "CHK-003": "home.ga4 and home.gsc", "CHK-004": "home.page_url like 'https://%' and https_ok", "CHK-005": "hosts_ok", "CHK-006": "dirty = 0", "CHK-007": "schema_score >= 70",
    "CHK-008": "true", "CHK-009": "home.viewport", "CHK-010": "technical_score >= 65 and milliseconds <= 1500 and heavy = 0", "CHK-012": "noindex = 0", "CHK-013": "ssr >= 60", "CHK-014": "no_title = 0 and odd_titles <= greatest(1, n // 4)", "CHK-015": "no_meta = 0 and odd_metas <= greatest(1, n // 3)",
    "CHK-016": "odd_h1 = 0", "CHK-017": "home.canonical is not null and other_canonical = 0", "CHK-018": "no_lang = 0", "CHK-019": "poor_alts = 0", "CHK-020": "ml >= 55", "CHK-021": "heavy = 0", "CHK-022": "home.lazy_ratio >= 0.5", "CHK-023": "content_score >= 65 and expertise_score >= 60",
    "CHK-024": "experience_score >= 60 and expertise_score >= 60 and authoritativeness_score >= 55 and trustworthiness_score >= 60", "CHK-025": "a_references and a_answer", "CHK-026": "visibility_score >= 60 and brand_score >= 50",
}


def _outcome(check: str) -> str:
    if check == "CHK-011":
        return "case when not home.hreflang and target_locale is null then 'na' when target_locale is null or home.hreflang then 'pass' else 'fail' end"
    return f"case when {_TESTS[check]} then 'pass' else 'fail' end"


CHECKS = f"""{SITES},
sc as ({" union all ".join(f"select site_id, {O.q(i)} as check_id, {O.q(g)} as category, {O.q(v)} as severity, {O.q(pr)} as priority, {_outcome(i)} as outcome from m" for i, g, v, pr in seo.CHECKS)})"""
ISSUES = f"""{CHECKS},
si as (select site_id, row_number() over (partition by site_id order by case severity when 'critical' then 0 when 'high' then 1 else 2 end, check_id) as k, check_id, category, severity, priority,
  case when priority = 'P0' then '0-30' when category in ('Schema', 'Content Quality', 'On-Page SEO') then '31-60' else '61-90' end as phase from sc where outcome = 'fail')"""
_W = sum(seo.WEIGHTS.values())
SEO = f"""{CHECKS},
q0 as (select site_id, technical_score, quality_score as content_quality_score, {O.score(O.points((25, "no_title = 0"), (20, "no_meta = 0"), (20, "odd_h1 = 0"), (15, "poor_alts = 0"), (20, "ml >= 55")))} as on_page_score, schema_score,
  {O.score("(case when milliseconds <= 300 then 100 when milliseconds <= 800 then 78 when milliseconds <= 1500 then 58 else 35 end)::double * 0.45::double + blocking::double * 0.25::double + home.lazy_ratio * 100.0::double * 0.15::double + (case when heavy = 0 then 100 else 55 end)::double * 0.15::double")} as performance_score,
  {O.score("visibility_score::double * 0.55::double + brand_score::double * 0.15::double + schema_score::double * 0.1::double + (case when a_answer then 100 else 45 end)::double * 0.1::double + (case when a_references then 100 else 40 end)::double * 0.1::double")} as ai_search_score from m),
q as (select *, {O.score("0.0::double + " + " + ".join(f"round_even({k}_score::double * {w / _W!r}::double, 2)" for k, w in seo.WEIGHTS.items()))} as seo_score from q0)"""
PERCEPTION = f"""{SITES},
x as (select site_id, greatest(visibility_score::double * 0.22::double + brand_score::double * 0.22::double + expertise_score::double * 0.12::double + authoritativeness_score::double * 0.12::double + trustworthiness_score::double * 0.12::double + technical_score::double * 0.08::double + schema_score::double * 0.06::double + platform_score::double * 0.06::double, 12.0::double) as a,
  greatest((100 - citability)::double * 0.18::double + (100 - presence_score)::double * 0.24::double + (100 - schema_score)::double * 0.18::double + (100 - content_score)::double * 0.2::double + (100 - brand_score)::double * 0.2::double, 10.0::double) as b,
  greatest((100 - trustworthiness_score)::double * 0.28::double + (100 - brand_score)::double * 0.22::double + (100 - technical_score)::double * 0.12::double + (100 - schema_score)::double * 0.16::double + (100 - authoritativeness_score)::double * 0.1::double + {O.points((12, "not same_domain_sitemap"), (10, "not named"), (8, "not same_as"), (4, "llms_length = 0"))}, 8.0::double) as c from m),
y as (select site_id, unnest([1, 2, 3]) as ord, unnest(['positive', 'neutral', 'controversial']) as part, unnest([a, b, c]) * 100.0::double / (a + b + c) as share from x),
z as (select *, floor(share)::int as whole from y), r as (select *, 100 - sum(whole) over (partition by site_id) as rest, row_number() over (partition by site_id order by share - whole desc, ord) as rank from z)"""
KEYWORDS = "list_filter([" + ", ".join(f"case when {rule} then {O.q(name)} end" for rule, name in zip(
    ("brand_score >= 75 and same_as", "schema_score >= 70 and technical_score >= 70", "expertise_score >= 72 and (article is not null or term_type)", "llms_score >= 70 and a_date", "experience_score >= 65 and a_numbers", "trustworthiness_score >= 70 and named and phone", "citability >= 70 and platform_score >= 70", "service is not null and (service_type or product_type)"), modules.KEYWORDS)) + "], lambda k: k is not null)"
GAPS = {p: " or ".join(f"{s} < {limit}" for s, limit in gaps.items()) for p, gaps in modules.PLATFORM_GAPS.items()}


# -- the structure graph ------------------------------------------------------

_key = lambda kind, name: f"sha256('{kind}|' || site_id || '|' || lower(trim({name})))"
_norm = f"lower(regexp_extract(target, {O.q(O.urls.PARTS)}, 1)) || '://' || lower(regexp_extract(target, {O.q(O.urls.PARTS)}, 2)) || case when regexp_extract(target, {O.q(O.urls.PARTS)}, 3) = '' then '/' else regexp_extract(target, {O.q(O.urls.PARTS)}, 3) end || case when regexp_extract(target, {O.q(O.urls.PARTS)}, 4) = '' then '' else '?' || regexp_extract(target, {O.q(O.urls.PARTS)}, 4) end"
_domain = "case when regexp_matches(h, '\\.(co|com|org|net|ac|gov|edu)\\.[a-z]{2}$') then array_to_string(string_split(h, '.')[-3:], '.') when regexp_matches(h, '^[0-9.]+$') then h else array_to_string(string_split(h, '.')[-2:], '.') end"
#: The tables hold no JSON-LD, so no external profiles.
GRAPH_BASE = f"""{O.PROFILES},
g as (select *, (length(page_url), page_url, page_id) as ord, coalesce(title, page_url) as tu, case when regexp_matches(title, '[|-]') then nullif(trim(string_split_regex(title, '[|-]')[-1]), '') end as company, scheme || '://' || auth as root, has_reference_section or has_inline_citations as cites,
  {_key('site', 'scope_root')} as k_site, {_key('organization', "scheme || '://' || auth")} as k_org, {_key('page', 'page_url')} as k_page, {_key('product', 'page_url')} as k_product, {_key('service', 'page_url')} as k_service from p),
gl as (select g.site_id, g.page_id, g.ord, g.k_page, g.cites, l.internal, {_norm} as t, nullif(trim(l.label), '') as label, row_number() over (partition by g.page_id, g.page_url, l.internal order by l.pos) as k from l join g on l.page_id = g.page_id and l.page_url = g.page_url),
gx as (select *, regexp_replace(regexp_extract(t, {O.q(O.urls.PARTS)}, 2), '^.*@|:\\d*$', '', 'g') as h, {_key('external_source', 't')} as k_target from gl where not internal and k <= 20)"""
GRAPH_ENTITIES = f"""{GRAPH_BASE},
gc as (select site_id, page_id, ord, k_site as entity_key, 'site' as entity_type, domain as name, scope_root as entity_url, 100.0 as confidence from g
  union all select site_id, page_id, ord, k_org, 'organization', coalesce(company, domain), root, case when company is not null then 88 else 72 end from g
  union all select site_id, page_id, ord, k_page, 'page', tu, page_url, 100 from g union all select site_id, page_id, ord, k_product, 'product', tu, page_url, 84 from g where url_type = 'product'
  union all select site_id, page_id, ord, k_service, 'service', tu, page_url, 82 from g where url_type = 'landing' union all select site_id, page_id, ord, k_target, 'external_source', {_domain}, t, 70 from gx),
entities as (select site_id, entity_key, entity_type, arg_min(name, (ord, name)) filter (where name <> '') as name, arg_min(entity_url, (ord, entity_url)) filter (where entity_url <> '') as entity_url, max(confidence)::double as confidence, count(distinct page_id) as pages from gc group by 1, 2, 3)"""
GRAPH_EDGES = f"""{GRAPH_BASE},
g0 as (select site_id, page_id, k_site as source_key, 'represents' as relation_type, k_org as target_key, 92 as confidence, 'site_signals' as evidence_field, coalesce(company, domain) as evidence_text, 80 as evidence_confidence from g
  union all select site_id, page_id, k_site, 'has_page', k_page, 100, 'url_type', url_type, 100 from g
  union all select site_id, page_id, k_page, case when url_type = 'homepage' then 'entity_home' else 'about' end, k_org, case when url_type = 'homepage' then 86 else 78 end, 'page_type', tu, 75 from g where url_type in ('homepage', 'about', 'contact')
  union all select site_id, page_id, k_org, 'offers', k_product, 82, 'url_type', tu, 82 from g where url_type = 'product' union all select site_id, page_id, k_page, 'about', k_product, 90, 'title', tu, 90 from g where url_type = 'product'
  union all select site_id, page_id, k_org, 'offers', k_service, 80, 'url_type', tu, 80 from g where url_type = 'landing' union all select site_id, page_id, k_page, 'about', k_service, 88, 'title', tu, 88 from g where url_type = 'landing'
  union all select site_id, page_id, k_page, case when cites then 'cites' else 'references' end, k_target, case when cites then 70 else 62 end, 'external_links', coalesce(label, t), case when cites then 70 else 62 end from gx
  union all select a.site_id, a.page_id, a.k_page, 'links_to', b.k_page, 72, 'internal_links', coalesce(a.label, a.t), 72 from (select * from gl where internal and k <= 30) a join (select distinct site_id, page_url, k_page from g) b on a.site_id = b.site_id and a.t = b.page_url and a.k_page <> b.k_page),
ge as (select site_id, sha256(source_key || '|' || relation_type || '|' || target_key) as edge_key, page_id, source_key, relation_type, target_key, confidence::double as confidence, evidence_field, evidence_text, evidence_confidence::double as evidence_confidence from g0),
edges as (select site_id, edge_key, source_key, relation_type, target_key, max(confidence) as confidence, count(*) as evidence_count, min(page_id) as first_page_id, max(page_id) as last_page_id from ge group by 1, 2, 3, 4, 5)"""
