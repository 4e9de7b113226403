"""DuckDB SQL with the meaning of the page columns, from which the queries' oracles are put together.

The fixed word lists and patterns are the library's; everything computed from them
is written again in SQL.
"""

from __future__ import annotations

from pagelens.functions import text as T
from pagelens.functions import urls
from pagelens.operators import rollup, scores, seo
from pagelens.sources.pages import ENTITIES, HIDDEN


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def shown(html: str) -> str:
    for pattern in [r"(?s)<!--.*?-->", *(rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>" for tag in HIDDEN)]:
        html = f"regexp_replace({html}, {q(pattern)}, ' ', 'g')"
    return html


def visible(html: str) -> str:
    html = f"regexp_replace({shown(html)}, '<[^>]*>', ' ', 'g')"
    for name, letter in ENTITIES.items():
        html = f"replace({html}, {q(name)}, {q(letter)})"
    return f"trim(regexp_replace({html}, '\\s+', ' ', 'g'))"


def found(text: str, table: dict[str, list[str]], locale: str | None = "locale") -> str:
    each = T.patterns(table)
    test = lambda p: f"regexp_matches(coalesce({text}, ''), {q('(?i)' + p)})"
    if locale is None or len(each) == 1:
        return test(each["default"])
    cases = " ".join(f"when {locale} = {q(n)} then {test(p)}" for n, p in each.items() if n != "default")
    return f"case {cases} else {test(each['default'])} end"


def signals(text: str, heads: str, locale: str = "locale") -> str:
    both = lambda t: f"concat_ws(' ', {t}, array_to_string({heads}, ' '))"
    tokens = f"regexp_extract_all(coalesce({text}, ''), '\\S+')"
    answer = f"(len({tokens}) >= 20 and {found(f'''lower(array_to_string({tokens}[1:80], ' '))''', T.ANSWERS, locale)})"
    parts = {
        "has_faq": found(both(text), T.FAQ, locale), "has_author": found(text, T.AUTHOR, locale), "has_publish_date": found(text, T.DATE, locale), "has_quantified_data": found(text, T.QUANTIFIED),
        "has_reference_section": found(both(text), T.REFERENCES, locale), "has_inline_citations": found(text, T.CITATIONS), "has_tldr": found(both(f"substr({text}, 1, 1200)"), T.SUMMARY, locale),
        "has_update_log": found(both(f"substr({text}, 1, 1600)"), T.UPDATES, locale), "answer_first": answer,
    }
    return ", ".join(f"{v} as {k}" for k, v in parts.items())


def words(text: str) -> str:
    return f"regexp_extract_all(coalesce({text}, ''), {q(T.WORDS)})"


def lexical(text: str) -> str:
    return f"(len(list_distinct(list_transform(list_filter({words(text)}, lambda w: length(w) > 2), lambda w: lower(w))))::double / greatest(len({words(text)}), 1))"


DENSITY = """least(100, case when word_count >= 180 then 30 when word_count >= 90 then 20 when word_count >= 40 then 10 else 0 end
 + case when lexical >= 0.45::double then 25 when lexical >= 0.30::double then 18 when lexical >= 0.20::double then 10 else 0 end
 + case when has_quantified_data then 25 else 0 end + case when heading_count >= 4 then 20 when heading_count >= 2 then 10 else 0 end)"""
CHUNKS = """case when heading_count = 0 then 20 else least(100, 30 + case when heading_count >= 4 then 30 when heading_count >= 2 then 20 else 0 end
 + case when word_count::double / (heading_count + 1) between 60 and 220 then 30 when word_count::double / (heading_count + 1) between 35 and 280 then 20 else 10 end
 + case when heading_levels[1] = 'h1' then 10 else 0 end) end"""
QUALITY = """case when heading_count = 0 then 0 else greatest(0, 100 - case when heading_levels[1] <> 'h1' then 25 else 0 end
 - case when len(list_filter(range(1, heading_count), lambda i: substr(heading_levels[i + 1], 2, 1)::int - substr(heading_levels[i], 2, 1)::int > 1)) > 0 then 20 else 0 end
 - case when heading_count < 3 then 20 else 0 end - case when len(list_distinct(list_transform(heading_texts, lambda t: lower(trim(t))))) <> heading_count then 10 else 0 end) end"""


def locale_of(segment: str) -> str:
    return rf"case when regexp_matches({segment}, '^\p{{L}}{{2}}([-_]\p{{L}}{{2}})?$') then replace({segment}, '_', '-') end"


def url_type(path: str) -> str:
    cases = " ".join(f"when regexp_matches(lower({path}), {q('|'.join(w))}) then {q(n)}" for n, w in urls.URL_TYPES.items())
    return f"case when len(segs) = 0 then 'homepage' {cases} else 'page' end"


URLS = rf"""
u0 as (select page_id, url, coalesce(html, '') as raw, case when regexp_matches(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://') then trim(url) else 'https://' || trim(url) end as f from pages),
u1 as (select *, lower(regexp_extract(f, {q(urls.PARTS)}, 1)) as scheme, lower(regexp_extract(f, {q(urls.PARTS)}, 2)) as auth,
       case when regexp_extract(f, {q(urls.PARTS)}, 3) = '' then '/' else regexp_extract(f, {q(urls.PARTS)}, 3) end as path, regexp_extract(f, {q(urls.PARTS)}, 4) as query from u0),
u2 as (select *, scheme || '://' || auth || path || case when query = '' then '' else '?' || query end as page_url, regexp_replace(auth, '^.*@|:\d*$', '', 'g') as host,
       list_filter(string_split(lower(path), '/'), lambda s: s <> '') as segs from u1),
u3 as (select *, {locale_of('segs[1]')} as path_locale, string_split(host, '.') as labels from u2),
u4 as (select *, case when path_locale is not null then '/' || segs[1] || '/' else '/' end as prefix, coalesce(path_locale, case when len(labels) >= 3 then {locale_of('labels[1]')} end) as url_locale,
       case when regexp_matches(host, '\.(co|com|org|net|ac|gov|edu)\.[a-z]{{2}}$') then array_to_string(labels[-3:], '.') when regexp_matches(host, '^[0-9.]+$') then host else array_to_string(labels[-2:], '.') end as domain from u3),
u as (select *, scheme || '://' || auth || prefix as scope_root, sha256(domain || '|' || scheme || '://' || auth || prefix) as site_id, {url_type('path')} as url_type from u4)
"""

_HREF = "(?is)\\bhref\\s*=\\s*(?:\"([^\"]*)\"|''([^'']*)''|([^\\s>\"'']+))"


def _absolute() -> str:
    href = "h"
    return f"""case when regexp_matches({href}, '^[A-Za-z][A-Za-z0-9+.-]*:') then {href} when starts_with({href}, '//') then scheme || ':' || {href}
      when starts_with({href}, '/') then scheme || '://' || auth || {href} when starts_with({href}, '?') or starts_with({href}, '#') or {href} = '' then regexp_replace(page_url, '[?#].*$', '') || {href}
      else scheme || '://' || auth || regexp_replace(path, '[^/]*$', '') || {href} end"""


FACTS = rf"""{URLS},
f0 as (select *, {shown('raw')} as html from u),
f1 as (select *, nullif({visible("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title\\s*>', 1)")}, '') as title,
       nullif(lower(regexp_extract(regexp_extract(html, '(?is)<html\b[^>]*>'), '(?is)\blang\s*=\s*"([^"]*)"', 1)), '') as lang,
       {visible('html')} as text,
       regexp_extract_all(html, '(?is)<h[1-6]\b[^>]*>.*?</h[1-6]\s*>') as heads,
       length(raw) as html_length from f0),
f as (select *, coalesce(string_split(lang, '-')[1], string_split(url_locale, '-')[1]) as locale,
      list_filter(list_transform(heads, lambda h: {visible('h')}), lambda t: t <> '') as heading_texts,
      list_transform(list_filter(heads, lambda h: {visible('h')} <> ''), lambda h: lower(substr(h, 2, 2))) as heading_levels from f1),
l0 as (select page_id, page_url, scheme, auth, path, host, prefix, locale, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*\bhref\b[^>]*>.*?</a\s*>')) as a, generate_subscripts(regexp_extract_all(html, '(?is)<a\b[^>]*\bhref\b[^>]*>.*?</a\s*>'), 1) as pos from f),
l1 as (select *, trim(replace(replace(regexp_extract(regexp_extract(a, '(?is)^<a\b[^>]*>'), '{_HREF}', 1), '&quot;', '"'), '&amp;', '&')) as h, {visible('a')} as label from l0),
l2 as (select *, {_absolute()} as target from l1),
l3 as (select *, row_number() over (partition by page_id, page_url, target order by pos) as rn from l2 where regexp_matches(target, '^https?://')),
l as (select *, regexp_replace(regexp_extract(target, {q(urls.PARTS)}, 2), '^.*@|:\d*$', '', 'g') = host and (prefix = '/' or starts_with(lower(regexp_extract(target, {q(urls.PARTS)}, 3)), prefix) or lower(regexp_extract(target, {q(urls.PARTS)}, 3)) || '/' = prefix) as internal from l3 where rn = 1)
"""


def _generic() -> str:
    lists = {n: "[" + ", ".join(map(q, T.GENERIC_ANCHORS["default"] + (T.GENERIC_ANCHORS[n] if n != "default" else []))) + "]" for n in T.GENERIC_ANCHORS}
    return f"case {' '.join(f'when locale = {q(n)} then {v}' for n, v in lists.items() if n != 'default')} else {lists['default']} end"


PROFILES = rf"""{FACTS},
k as (select page_id, page_url, internal, count(*) as n, count(*) filter (where trim(label) <> '') as labelled,
      count(*) filter (where trim(label) <> '' and not list_contains({_generic()}, trim(regexp_replace(lower(label), '\s+', ' ', 'g'))) and (len({words("trim(regexp_replace(lower(label), '\\s+', ' ', 'g'))")}) >= 2 or length(trim(regexp_replace(lower(label), '\s+', ' ', 'g'))) >= 12)) as good
      from l group by 1, 2, 3),
p0 as (select f.*, len({words('text')}) as word_count, {lexical('text')} as lexical, len(heading_texts) as heading_count, len(list_filter(heading_levels, lambda v: v = 'h1')) as h1_count, {signals('text', 'heading_texts')},
       coalesce(ki.n, 0) as internal_link_count, coalesce(ke.n, 0) as external_link_count, coalesce(ki.labelled, 0) as il, coalesce(ke.labelled, 0) as el,
       case when ki.labelled > 0 then ki.good::double / ki.labelled else 0::double end as ir, case when ke.labelled > 0 then ke.good::double / ke.labelled else 0::double end as er
       from f left join k ki on f.page_id = ki.page_id and f.page_url = ki.page_url and ki.internal left join k ke on f.page_id = ke.page_id and f.page_url = ke.page_url and not ke.internal),
p as (select *, round_even(lexical, 2) as lexical_ratio, {DENSITY} as information_density_score, {CHUNKS} as chunk_structure_score, {QUALITY} as heading_quality_score,
      round_even(ir, 2) as descriptive_internal_link_ratio, round_even(er, 2) as descriptive_external_link_ratio,
      least(100, round_even(ir * 45.0::double + er * 35.0::double + (least(il, 8) * 2)::double + least(el, 4)::double, 0)::int) as link_context_score from p0)
"""


def score(x: str) -> str:
    return f"greatest(0, least(100, round_even(({x})::double, 0)::int))"


def status(x: str) -> str:
    return f"case when {x} <= 24 then 'critical' when {x} <= 44 then 'poor' when {x} <= 64 then 'fair' when {x} <= 84 then 'good' else 'strong' end"


def points(*terms: tuple[int, str]) -> str:
    return " + ".join(f"case when {t} then {w} else 0 end" for w, t in terms)


CITABILITY = score("(" + points((8, "title is not null"), (8, "h1_count > 0 or heading_count >= 1"), (10, "heading_count >= 3"), (10, "word_count >= 250"), (15, "answer_first"), (8, "has_quantified_data"), (5, "has_faq"), (5, "has_author"), (5, "has_publish_date")) + ")::double + information_density_score::double * 0.1::double + chunk_structure_score::double * 0.1::double")
CONTENT = score("(case when word_count >= 700 then 25 when word_count >= 350 then 15 else 5 end + " + points((15, "has_faq"), (12, "has_author"), (10, "has_publish_date"), (15, "has_quantified_data"), (10, "has_reference_section"), (6, "has_inline_citations"), (6, "has_tldr"), (12, "answer_first")) + ")::double + information_density_score::double * 0.06::double + chunk_structure_score::double * 0.05::double + descriptive_internal_link_ratio * 6.0::double + descriptive_external_link_ratio * 4.0::double")
TECHNICAL = score(points((20, "title is not null"), (10, "lang is not null"), (10, "h1_count = 1")) + " + case when heading_count >= 3 then 20 when heading_count > 0 then 10 else 0 end + case when word_count >= 250 then 20 when word_count >= 100 then 10 else 0 end")
SUPPORT = points(*[(1, n) for n in ("answer_first", "has_quantified_data", "has_faq", "has_author", "has_publish_date")])

#: Pages of the tables have no description, canonical link or structured data; the SQL counts those as missing.
SCORED = f"""{PROFILES},
s0 as (select *, {CITABILITY} as citability_score, {CONTENT} as content_score, {TECHNICAL} as technical_score, 0 as schema_score from p),
s as (select *, {score('citability_score::double * 0.35::double + content_score::double * 0.3::double + technical_score::double * 0.2::double + schema_score::double * 0.15::double')} as overall_score,
      case when citability_score >= 75 and {SUPPORT} >= 2 then 'HIGH' when citability_score >= 55 then 'MEDIUM' else 'LOW' end as citation_probability from s0)
"""

_WORDS = lambda *kinds: "regexp_matches(lower(page_url), '" + "|".join(w for k in kinds for w in scores.EXTRA_TYPES[k]) + "')"
_EDITORIAL = f"(url_type not in ('homepage', 'about', 'contact', 'case_study') and not {_WORDS('product', 'faq')} and ({_WORDS('documentation')} or (url_type = 'blog' and not {_WORDS('comparison')})))"
#: The rules that pages without structured data can break: position in the rule list, category, condition.
RULES = (
    (0, "citability", "citability_score < 60"), (1, "content", "content_score < 60"), (2, "evidence", "not has_reference_section and has_quantified_data"), (3, "evidence", "not has_inline_citations and has_reference_section"),
    (4, "linking", "descriptive_internal_link_ratio < 0.5 or descriptive_external_link_ratio < 0.5"), (5, "technical", "technical_score < 60"), (6, "semantic_html", "h1_count <> 1"), (7, "schema", "schema_score < 50"),
    (10, "trust", f"not has_author and {_EDITORIAL}"), (11, "freshness", f"not has_publish_date and {_EDITORIAL}"), (12, "ux", "not has_tldr and citability_score < 75"),
)
ISSUE_COUNT = points(*[(1, f"({t})") for _, _, t in RULES])


def key_page(kind: str) -> str:
    hit = f"regexp_matches(lower(page_url), {q('|'.join(rollup.KEY_PAGES[kind]))})"
    return f"arg_min(page_url, (length(page_url), page_url)) filter (where {hit}) as {kind}_url"
