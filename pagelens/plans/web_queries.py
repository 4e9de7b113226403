"""Queries of what belongs to a site beside its pages: robots.txt, sitemaps, llms.txt, headers, backlink figures, suffixes of domains.

The tables hold none of these and their hosts few suffixes; all are drawn from hosts and page ids, for all rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelens.functions import suffixes, urls
from pagelens.functions import text as T
from pagelens.operators import robots, scores
from pagelens.operators.profiles import page_profiles as profiles_of
from pagelens.plans import oracle_parts as O
from pagelens.plans import oracle_site as S
from pagelens.plans import site_inputs
from pagelens.plans.catalogue import query
from pagelens.sources import html_tree, structured
from pagelens.sources.pages import read_pages

_N = "chr(10)"
#: A host's robots.txt from its name and seg, the first segment of one of its paths; one expression that Spark and DuckDB both read.
BODY = f"""case ascii(substr(md5(host), 1, 1)) % 6
 when 0 then concat('User-agent: *', {_N}, 'Disallow: /', {_N})
 when 1 then concat('User-agent: Google', {_N}, 'Disallow:', {_N}, {_N}, 'User-agent: *', {_N}, 'Disallow: /', seg, {_N}, 'Allow: /', seg, '/')
 when 2 then concat('User-agent: GPTBot', {_N}, 'User-agent: googlebot # both', {_N}, 'Allow: /', seg, '/', {_N}, 'Disallow: /', seg, {_N}, 'disallow : /%61', {_N}, {_N}, '# rest', {_N}, 'User-agent: *', {_N}, 'Disallow: /')
 when 3 then concat('Disallow: /', {_N}, 'User-agent: *', {_N}, {_N}, 'Disallow: /x', {_N}, 'Sitemap: https://a.example/s.xml', {_N}, 'User-agent: *', {_N}, 'Crawl-delay: 5', {_N}, 'Disallow: /', substr(seg, 1, 1), {_N}, 'Allow: /', substr(seg, 1, 2))
 when 4 then concat('User-agent: gptbot', {_N}, 'Disallow: /', substr(seg, 1, 1), {_N}, 'Allow: /', seg, {_N}, 'User-agent: *', {_N}, 'Allow: /', substr(seg, 1, 1), {_N}, 'Disallow: /', seg, {_N}, 'User-agent: GOOGLEBOT', {_N}, 'Disallow: /', substr(seg, 1, 3))
 else '' end"""

_SITES = f"""p as (select page_id, host, regexp_replace(page_url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', '') as rest from u),
h as (select host, coalesce(nullif(split_part(min(rest), '/', 2), ''), 'a') as seg from p group by host), b as (select host as site, {BODY} as body from h),
ln as (select site, unnest(string_split(body, chr(10))) as raw, generate_subscripts(string_split(body, chr(10)), 1) as pos from b),
sg as (select *, count(*) filter (raw = '') over (partition by site order by pos) as part, trim(split_part(raw, '#', 1)) as line from ln),
kv as (select site, part, pos, lower(trim(split_part(line, ':', 1))) as k, trim(substr(line, strpos(line, ':') + 1)) as v from sg where contains(line, ':'))"""
_FIRST = """e0 as (select *, coalesce(lag(k) over (partition by site, part order by pos), '') as before from kv where k in ('user-agent', 'allow', 'disallow', 'crawl-delay', 'request-rate')),
e1 as (select *, sum((k = 'user-agent' and before <> 'user-agent')::int) over (partition by site, part order by pos) as run from e0),
e2 as (select site, part, run, min(case when k = 'user-agent' and v <> '*' and contains('googlebot', lower(v)) then 0 when k = 'user-agent' and v = '*' then 1 end) as rank from e1 where run > 0 group by all having count(*) filter (k <> 'user-agent') > 0),
e3 as (select * from e2 where rank is not null qualify row_number() over (partition by site order by rank, part, run) = 1),
fr as (select e1.site, e1.pos, k = 'allow' or v = '' as allow, url_decode(v) as path from e1 join e3 on e1.site = e3.site and e1.part = e3.part and e1.run = e3.run where k in ('allow', 'disallow')),
t as (select page_id, host, rest, coalesce(nullif(url_decode(rest), ''), '/') as target from p),
fm as (select page_id, arg_min(allow, pos) as allow, arg_min(path, pos) as rule from t join fr on fr.site = t.host and starts_with(t.target, fr.path) group by page_id)"""
_LONGEST = """l0 as (select *, coalesce(lag(k) over (partition by site order by pos), '') as before from kv where k in ('user-agent', 'allow', 'disallow')),
l1 as (select *, sum((k = 'user-agent' and before <> 'user-agent')::int) over (partition by site order by pos) as run from l0),
ag as (select site, run, case when v = '' then '*' else lower(v) end as agent from l1 where k = 'user-agent'),
lr as (select l1.site, coalesce(ag.agent, '*') as agent, l1.k as directive, l1.v as path from l1 left join ag on l1.site = ag.site and l1.run = ag.run where l1.k <> 'user-agent'),
own as (select * from lr where agent = 'gptbot' union all select * from lr where agent = '*' and site not in (select site from lr where agent = 'gptbot')),
lm as (select page_id, coalesce(max(length(path)) filter (directive = 'allow'), -1) >= coalesce(max(length(path)) filter (directive = 'disallow'), -1) as allow from t join own on own.site = t.host and starts_with(coalesce(nullif(t.rest, ''), '/'), case when path = '' then '/' else path end) group by page_id)"""


def _bodies(pages):
    """site, body of pages (site, rest)."""
    named = pages.groupBy(F.col("site").alias("host")).agg(F.min("rest").alias("rest")).select("host", F.coalesce(F.nullif(F.split_part("rest", F.lit("/"), F.lit(2)), F.lit("")), F.lit("a")).alias("seg"))
    return named.select(F.col("host").alias("site"), F.expr(BODY).alias("body"))


def _addresses(spark, sf_dir):
    u = urls.normalize_url(F.col("url"))
    pages = read_pages(spark, sf_dir).select("page_id", u.alias("url")).where("url is not null")
    return pages.select("page_id", "url", urls.host(F.col("url")).alias("site"), F.regexp_replace("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "").alias("rest"))


@query(f"with {O.URLS}, {_SITES}, {_FIRST}, {_LONGEST} select page_id, coalesce(fm.allow, true) as googlebot_allowed, fm.rule as googlebot_rule, coalesce(lm.allow, true) as gptbot_allowed from t left join fm using (page_id) left join lm using (page_id)")
def robots_per_url(spark, sf_dir):
    """For every page whether its site's robots.txt lets two crawlers fetch it: by the first rule that matches, and by the longest."""
    pages = _addresses(spark, sf_dir)
    bodies = _bodies(pages)
    first = robots.first_match(pages.select("page_id", "site", robots.target(F.col("url")).alias("target")), bodies)
    raw = pages.select("page_id", "site", F.when(F.col("rest") == "", "/").otherwise(F.col("rest")).alias("target"))
    longest = robots.longest_match(raw, robots.agent_rules(structured.robots_rules(bodies), "GPTBot"))
    return first.select("page_id", F.col("allowed").alias("googlebot_allowed"), F.col("rule").alias("googlebot_rule")).join(longest.select("page_id", F.col("allowed").alias("gptbot_allowed")), "page_id")


#: Hosts of pages under drawn suffixes.
HOST = "concat(replace(host, '.example.com', ''), case page_id % 9 when 0 then '.co.uk' when 1 then '.github.io' when 2 then '.kawasaki.jp' when 3 then '.city.kawasaki.jp' when 4 then '.example.com' when 5 then '.shop.ck' when 6 then '.www.ck' when 7 then '.unknown' else '.b.com.br' end)"


@query(f"""with {O.URLS}, hosts as (select distinct case when page_id % 25 = 0 then '10.0.0.1' when page_id % 25 = 1 then 'co.uk' when page_id % 25 = 2 then 'kawasaki.jp' else {HOST} end as host from u),
rules as (select unnest([{', '.join(map(O.q, dict.fromkeys(suffixes.COMMON)))}]) as rule), r as (select *, string_split(ltrim(rule, '!'), '.') as parts, starts_with(rule, '!') as exempt from rules),
s as (select host, string_split(host, '.') as labels from hosts where not regexp_matches(host, '^[0-9.]+$')),
m as (select host, labels, exempt, case when exempt then len(parts) - 1 else len(parts) end as n from s join r on len(parts) <= len(labels) and array_to_string(labels[-len(parts):], '.') = array_to_string(list_transform(parts, lambda x, i: case when x = '*' then labels[len(labels) - len(parts) + i] else x end), '.')),
b as (select host, coalesce(max(n) filter (exempt), max(n)) as n from m group by host)
select hosts.host, coalesce(array_to_string(labels[-b.n:], '.'), '') as suffix, case when s.host is null then hosts.host when b.n is null then labels[-1] when len(labels) > b.n then array_to_string(labels[-(b.n + 1):], '.') else '' end as registered_domain
from hosts left join s on s.host = hosts.host left join b on b.host = hosts.host""")
def registered_domains(spark, sf_dir):
    """Suffix and registered domain of the hosts of all pages, moved under drawn suffixes."""
    pages = read_pages(spark, sf_dir).select("page_id", urls.host(urls.normalize_url(F.col("url"))).alias("host")).where("host is not null")
    odd = F.when(F.col("page_id") % 25 == 0, "10.0.0.1").when(F.col("page_id") % 25 == 1, "co.uk").when(F.col("page_id") % 25 == 2, "kawasaki.jp")
    return suffixes.registered_domains(pages.select(odd.otherwise(F.expr(HOST)).alias("host")), suffixes.common_rules(spark))


_BLANK = lambda value: f"trim(regexp_replace({value}, '\\s+', ' ', 'g'))"
_METAS = lambda kind, start: f"(select coalesce('{{' || string_agg('\"' || k || '\":\"' || v || '\"', ',' order by k) || '}}', '{{}}') from (select unnest(regexp_extract_all(html, '<meta {kind}=\"({start}[^\"]*)\" content=\"([^\"]*)\"', 1)) as k, unnest(regexp_extract_all(html, '<meta {kind}=\"({start}[^\"]*)\" content=\"([^\"]*)\"', 2)) as v))"


@query(f"""with {S.ELEMENTS_SQL} select page_id, title, lang, meta_description, canonical, first_h1 as h1, array_to_string(list_transform(heading_levels, lambda x, i: x || ':' || heading_texts[i]), chr(10)) as headings, internal_link_count as internal_links, external_link_count as external_links, imgs as images,
len(regexp_extract_all(raw, '(?i)<script\\b')) as scripts, sheets as stylesheets, len(regexp_extract_all(raw, 'application/ld\\+json')) as json_ld, {_METAS('property', 'og:')} as open_graph, {_METAS('name', 'twitter:')} as twitter_cards, case when hreflang then 'fr-FR' else '' end as hreflang, case when viewport then 'width=device-width' end as viewport,
{_BLANK('text')} as text from e""")
def page_tree(spark, sf_dir):
    """What the tree reader finds in every page with drawn elements; links to pages only, white space as one space."""
    base = F.col("page_url")
    pages = site_inputs.with_elements(read_pages(spark, sf_dir)).withColumn("page_url", urls.normalize_url(F.col("url")))
    pages = pages.withColumns({"host": urls.host(base), "prefix": urls.scope_prefix(base)})
    t = html_tree.with_tree(pages).select("page_id", "tree.*")
    blank = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    paged = lambda c: F.size(F.filter(c, lambda x: x["url"].rlike("^https?://")))
    as_json = lambda c: F.concat(F.lit("{"), F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":"'), e["value"], F.lit('"')))), ","), F.lit("}"))
    return t.select(
        "page_id", blank(F.col("title")).alias("title"), F.lower("lang").alias("lang"), "meta_description", "canonical", blank(F.col("h1")).alias("h1"), F.array_join(F.transform("headings", lambda h: F.concat(h["level"], F.lit(":"), blank(h["text"]))), "\n").alias("headings"),
        paged("internal_links").alias("internal_links"), paged("external_links").alias("external_links"), F.size("images").alias("images"), F.size("scripts").alias("scripts"), F.size("stylesheets").alias("stylesheets"), F.size("json_ld_blocks").alias("json_ld"),
        as_json("open_graph").alias("open_graph"), as_json("twitter_cards").alias("twitter_cards"), F.array_join("hreflang", ",").alias("hreflang"), "viewport", blank(F.col("text_content")).alias("text"),
    )


_CRAWLERS = ("GPTBot", "ClaudeBot")


@query(f"""with {O.URLS}, {_SITES}, {_LONGEST.partition("own as")[0].rstrip().rstrip(",")},
c as (select site, unnest([{', '.join(map(O.q, _CRAWLERS))}]) as crawler from b), m as (select c.*, case when exists (select 1 from lr where lr.site = c.site and lr.agent = lower(crawler)) then lower(crawler) else '*' end as matched_agent from c)
select m.site, crawler, matched_agent, coalesce(max(length(path)) filter (directive = 'allow' and path in ('', '/')), -1) >= coalesce(max(length(path)) filter (directive = 'disallow' and path in ('', '/')), -1) as allowed from m left join lr on lr.site = m.site and lr.agent = matched_agent group by 1, 2, 3""")
def robots_verdict(spark, sf_dir):
    """What each site's robots.txt says of its root to two crawlers of models."""
    return structured.robots_verdicts(_bodies(_addresses(spark, sf_dir)), _CRAWLERS)


#: A site's sitemap files by its pages: an index names an index, which names the first again, two lists and a file that is not there; a third of the sites have a broken first file.
_LOC = "concat('<url><loc>', replace(page_url, '&', '&amp;'), '</loc></url>')"
_INDEX = lambda *names: "concat('<sitemapindex xmlns=\"http://www.sitemaps.org/schemas/sitemap/0.9\">', " + ", ".join(f"'<sitemap><loc>', root, '/{n}</loc></sitemap>'" for n in names) + ", '</sitemapindex>')"
_FILES = {"sitemap.xml": f"case when ascii(substr(md5(root), 1, 1)) % 3 = 0 then '<urlset' else {_INDEX('s1.xml', 'nested.xml', 'missing.xml', 's2.xml')} end", "nested.xml": _INDEX("s2.xml", "sitemap.xml", "nested.xml", "s1.xml"), "sitemap_index.xml": _INDEX("s2.xml", "sitemap.xml")}
_LISTS = {"s1.xml": "page_id % 3 = 1", "s2.xml": "page_id % 3 <> 1"}


@query(f"""with recursive {O.URLS}, p as (select page_id, page_url, scheme || '://' || auth as root from u),
f as (select root as site, unnest([{', '.join(map(O.q, _FILES))}]) as name, unnest([{', '.join(_FILES.values())}]) as xml from (select distinct root from p)
 union all {' union all '.join(f"select root, {O.q(n)}, '<urlset>' || string_agg({_LOC}, '' order by page_url, page_id) || '</urlset>' from p where {c} group by root" for n, c in _LISTS.items())}),
g as (select site, site || '/' || name as url, case when contains(xml, '</sitemapindex>') then 'index' when contains(xml, '</urlset>') then 'list' end as kind, regexp_extract_all(xml, '<loc>([^<]*)</loc>', 1) as locs from f),
w(site, url, depth, way, above) as (select distinct site, site || '/sitemap.xml', 0, [1], [site || '/sitemap.xml'] from f union all select distinct site, site || '/sitemap_index.xml', 0, [2], [site || '/sitemap_index.xml'] from f
 union all select site, loc, depth + 1, list_append(way, i), list_append(above, loc) from (select w.site, w.depth, w.way, w.above, unnest(g.locs) as loc, generate_subscripts(g.locs, 1) as i from w join g on g.site = w.site and g.url = w.url and g.kind = 'index') where not list_contains(above, loc)),
o as (select site, url, min((depth, way)) as place from w group by site, url),
l as (select o.site, o.place, replace(unnest(g.locs), '&amp;', '&') as page, generate_subscripts(g.locs, 1) as i from o join g on g.site = o.site and g.url = o.url and g.kind = 'list'),
d as (select site, page, min((place, i)) as spot from l group by site, page)
select site, row_number() over (partition by site order by spot)::int as ord, page from d qualify ord <= {structured.MOST_URLS}""")
def sitemap_urls(spark, sf_dir):
    """The URLs that a walk through each site's sitemaps finds, in its order."""
    root = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    pages = _addresses(spark, sf_dir).select("page_id", F.col("url").alias("page_url"), root.alias("root"))
    roots = pages.select("root").distinct()
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.expr(x).alias("xml")) for n, x in _FILES.items()])).alias("f")
    files = roots.select(F.col("root").alias("site"), "root", named).select("site", F.concat("root", F.lit("/"), "f.name").alias("url"), "f.xml")
    which = F.expr("case " + " ".join(f"when {c} then '{n}'" for n, c in _LISTS.items()) + " end")
    items = F.array_sort(F.collect_list(F.struct("page_url", "page_id", F.expr(_LOC).alias("loc"))))
    lists = pages.groupBy("root", which.alias("name")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.transform(items, lambda x: x["loc"]), ""), F.lit("</urlset>")).alias("xml"))
    files = files.unionByName(lists.select(F.col("root").alias("site"), F.concat("root", F.lit("/"), "name").alias("url"), "xml"))
    starts = roots.select(F.col("root").alias("site"), F.posexplode(F.array(F.concat("root", F.lit("/sitemap.xml")), F.concat("root", F.lit("/sitemap_index.xml")))).alias("ord", "url"))
    return structured.sitemap_urls(files, starts)


@query(f"select page_id, ({' + '.join(f'20 * ((page_id >> {i}) & 1)' for i in range(5))})::int as score from pages")
def security_headers(spark, sf_dir):
    """Scores of headers drawn by the bits of page ids, their names in capitals for odd ids."""
    named = [F.when(F.shiftright("page_id", i).bitwiseAND(1) == 1, F.when(F.col("page_id") % 2 == 1, h.upper()).otherwise(h)) for i, h in enumerate(scores.SECURITY_HEADERS)]
    names = F.filter(F.array(*named, F.lit("server")), lambda n: n.isNotNull())
    pages = read_pages(spark, sf_dir).withColumn("headers", F.map_from_arrays(names, F.transform(names, lambda n: F.lit("x"))))
    return pages.select("page_id", scores.security_headers(F.col("headers")).cast("int").alias("score"))


#: A page's llms.txt by its id, title and text; one expression for both engines.
_LLMS = f"case page_id % 4 when 1 then concat('# ', coalesce(title, ''), {_N}, '## Services', {_N}, 'Platform. ', text) when 2 then concat(coalesce(title, ''), ' preferred citation: contact us') when 3 then substr(text, 1, 300) end"


@query(rf"""with {S.ELEMENTS_SQL}, b as (select page_id, company, {_LLMS} as body from e), v as (select page_id, coalesce(company, '') as brand, coalesce(substr(body, 1, 500), '') as preview, coalesce(length(body), 0) as n from b)
select page_id, n as length, (case when n > 0 then 20 else 0 end + case when n >= 250 then 20 else 0 end + case when n > 0 and length(brand) > 0 and contains(lower(preview), lower(brand)) then 20 else 0 end + case when regexp_matches(lower(preview), 'service|product|solution|platform') then 20 else 0 end
 + case when regexp_matches(lower(preview), 'citation|cite|canonical|contact|preferred') then 10 else 0 end + case when regexp_matches(preview, '(?m)^#') then 10 else 0 end)::int as score from v""")
def llms_quality(spark, sf_dir):
    """Scores of drawn llms.txt bodies, by their first 500 characters and whole length."""
    pages = profiles_of(site_inputs.with_elements(read_pages(spark, sf_dir))).withColumn("body", F.expr(_LLMS))
    preview, length = structured.llms_preview(F.col("body"))
    brand = F.coalesce(T.company_name(F.col("title")), F.lit(""))
    return pages.select("page_id", length.cast("int").alias("length"), scores.llms_effectiveness(preview, length, brand).cast("int").alias("score"))


#: A page's backlink payload by its id: CSV with ; or with , and quotes, JSON, or no payload at all.
_PAYLOAD = f"""case page_id % 4 when 0 then concat('ascore;backlinks_num;domains_num;ips_num;ipclass_c_num;follows_num;nofollows_num', {_N}, page_id % 101, ';', page_id, ';88;66;40;', page_id % 7, ';', page_id % 3)
 when 1 then concat('"domains_num","ascore",follows_num,backlinks_num,nofollows_num', chr(13), {_N}, '"', page_id % 9, ',', 100 + page_id % 900, '",', page_id % 50, ',6,"n/a, none",', page_id % 5)
 when 2 then concat('{{"ascore": "', page_id % 77, '", "follows_num": "n/a", "nofollows_num": 3, "domains_num": "1,', 100 + page_id % 900, '"}}') else 'not available' end"""


@query("""select page_id, case page_id % 4 when 0 then page_id % 101 when 1 then page_id % 50 when 2 then page_id % 77 end::bigint as ascore, case page_id % 4 when 0 then page_id end::bigint as backlinks_num,
case page_id % 4 when 0 then 88 when 1 then (page_id % 9) * 1000 + 100 + page_id % 900 when 2 then 1100 + page_id % 900 end::bigint as domains_num,
case page_id % 4 when 0 then case when page_id % 7 + page_id % 3 > 0 then round_even((page_id % 7)::double / (page_id % 7 + page_id % 3), 2) end when 1 then round_even(6::double / (6 + page_id % 5), 2) end as follow_ratio from pages""")
def backlink_figures(spark, sf_dir):
    """Figures read from drawn payloads of every page."""
    rows = read_pages(spark, sf_dir).select("page_id", structured.backlinks(F.expr(_PAYLOAD)).alias("b"))
    return rows.select("page_id", "b.ascore", "b.backlinks_num", "b.domains_num", "b.follow_ratio")


_HAS = lambda *names: "(" + " or ".join(f"list_contains(types, '{n}')" for n in names) + ")"


@query(f"""with {S.ELEMENTS_SQL} select page_id, ld as json_ld_present, {_HAS('Organization')} as has_organization, {_HAS('Article')} as has_article, {_HAS('Product')} as has_product, {_HAS('FAQPage')} as has_faq_page, {_HAS('WebSite')} as has_website, {_HAS('DefinedTerm')} as has_defined_term,
alignment::int as visible_alignment_score, relations::int as relation_count, ids::int as entity_id_count, (pub::int + mod::int)::int as date_signal_count, case when same_as then 'https://social.example/x' else '' end as same_as from e""")
def jsonld_summary(spark, sf_dir):
    """The structured data of every page with drawn elements."""
    pages = profiles_of(site_inputs.with_elements(read_pages(spark, sf_dir)))
    out = structured.with_summary(pages)
    return out.select("page_id", "json_ld_present", "has_organization", "has_article", "has_product", "has_faq_page", "has_website", "has_defined_term", "visible_alignment_score", "relation_count", "entity_id_count", "date_signal_count", F.array_join("same_as", ",").alias("same_as"))


@query()
def page_structured_data(spark, sf_dir):
    """All columns of the structured data of every page with drawn elements."""
    pages = profiles_of(site_inputs.with_elements(read_pages(spark, sf_dir)))
    return structured.with_summary(pages).select("page_id", *structured.summary_columns("text"))
