"""The entity graph over documents as pages, with its SQL.

Documents have no URL: a source is a site, doc_id modulo 4 draws the type of page (product, landing,
service, page), the first line is the heading.  Their invented prose names few features, so sentences with
pieces of each text are drawn by doc_id and added to it (DRAWN), for all rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelens.operators import entity_graph as E
from pagelens.operators import graph
from pagelens.plans import oracle_parts as O
from pagelens.plans import oracle_site as S
from pagelens.plans.catalogue import query, table
from pagelens.sources.pages import dealt


#: One expression that Spark and DuckDB both read.
DRAWN = """concat(coalesce(text, ''), case doc_id % 5 when 0 then concat(' Features: ', substring(text, 1, 90), '. Ideal for ', substring(text, 20, 70), '; great for  ', substring(text, 40, 9))
 when 1 then concat(' rated ', doc_id % 97, ' kWh and ', substring(text, 5, 12), ' ', doc_id % 50, '.5 GB, ', substring(text, 9, 6), doc_id % 7, 'kW, ', doc_id % 9, '%', substring(text, 3, 4), ' 12 minutes', substring(text, 1, 1))
 when 2 then concat(' Customers find it reliable. ', 'Users say: ', substring(text, 1, 200), '.') when 3 then concat(' supports ', substring(text, 30, 100), '! A Trusted (easy) way:') else '' end)"""


def _candidates(spark, sf_dir):
    c = F.col
    site, kind = F.coalesce("source", F.lit("none")), F.pmod("doc_id", F.lit(4))
    text = F.coalesce("text", F.lit(""))
    # a null text is an empty one before pieces of it are drawn: concat here is null where one of them is
    documents = dealt(table(spark, sf_dir, "documents")).withColumn("text", text).withColumn("text", F.expr(DRAWN))
    pages = documents.select(
        site.alias("site_id"), c("doc_id").alias("page_id"), F.struct("doc_id").alias("ord"), F.concat(F.lit("https://"), site, F.lit(".example/"), "doc_id").alias("page_url"),
        F.when(kind == 0, "product").when(kind == 1, "landing").when(kind == 2, "service").otherwise("page").alias("url_type"), F.concat(F.lit("document "), "doc_id").alias("title"), "lang", F.length(text).cast("long").alias("word_count"),
        "text", F.array(F.substring_index(text, "\n", 1)).alias("headings"), site.alias("brand_name"), F.concat(F.lit("https://"), site, F.lit(".example")).alias("brand_url"),
    )
    return E.candidates(pages)


def _clean(value: str) -> str:
    plain = f"trim(regexp_replace({value}, {O.q(_SPACE)}, ' ', 'g'))"
    return f"trim(regexp_replace(regexp_replace({plain}, {O.q(E.LEADING)}, ''), {O.q(E.TRAILING)}, ''), {O.q(E.STRIPPED)})"


def _phrases(found: str) -> str:
    return f"list_filter(list_transform({found}, lambda s: {_clean('s')}), lambda p: length(p) >= 3 and lower(p) not in ({', '.join(map(O.q, E.GENERIC))}))"


_SPACE = E.SPACE.replace(r"\x85", r"\x{85}")
#: An engine whose word edges know ASCII only gets _ for every other letter and digit; the finds have none of them.
_ASCII = r"regexp_replace(text, '[^\x00-\x7F\p{Z}\p{P}\p{S}\p{C}\p{M}]', '_', 'g')"
_key = lambda kind, name: f"sha256({kind} || '|' || lower(site_id) || '|' || lower(trim({name})))"
_KINDS = {"features": ("feature", 70, "has_feature", 76, "heading", "headings", "headings"), "specifications": ("specification", 74, "has_spec", 78, "text", "text_content", "page.text_content"), "uses": ("use_case", 68, "suited_for", 72, "text", "text_content", "page.text_content"), "claims": ("sentiment_claim", 66, "backed_by_claim", 64, "text", "text_content", "page.text_content")}
_BASE = f"""with drawn as (select doc_id, source, lang, {DRAWN} as text from documents),
d as (select coalesce(source, 'none') as site_id, doc_id as page_id, 'document ' || doc_id as title, lang, trim(regexp_replace(coalesce(text, ''), {O.q(_SPACE)}, ' ', 'g')) as text, split_part(coalesce(text, ''), chr(10), 1) as heading,
 ['product', 'landing', 'service', 'page'][1 + doc_id % 4] as url_type, [ 'product_model', 'service_offer', 'service_offer', null][1 + doc_id % 4] as offer, 'https://' || coalesce(source, 'none') || '.example/' || doc_id as page_url, 'https://' || coalesce(source, 'none') || '.example' as brand_url from drawn),
f as (select *, list_distinct(list_filter({_phrases('[heading]')}, lambda p: len(regexp_extract_all(p, '[A-Za-z0-9]+')) <= {E.HEADING_WORDS}) || {_phrases(f"regexp_extract_all(title || '. ' || text, {O.q('(?i)' + E.FEATURE)}, 1)")}) as features,
 list_distinct({_phrases(f"regexp_extract_all({_ASCII}, {O.q(chr(40) + '?i)' + chr(92) + 'b' + E.SPECIFICATION + chr(92) + 'b')})")}) as specifications, list_distinct({_phrases(f"regexp_extract_all(text, {O.q('(?i)' + E.USE)}, 1)")}) as uses,
 list_distinct(list_transform({_phrases(f"list_filter(string_split(regexp_replace(text, '([.!?]) ', concat(chr(92), '1', chr(31)), 'g'), chr(31)), lambda s: regexp_matches(lower(s), {O.q('|'.join(E.CLAIM_WORDS))}))")}, lambda p: substr(p, 1, {E.CLAIM_CHARS}))) as claims from d),
k as (select *, {_key("'brand'", 'brand_url')} as k_brand, {_key("'source_page'", 'page_url')} as k_page, {_key('offer', 'page_url')} as k_offer from f),
b as (select *, coalesce(k_offer, k_brand) as k_focus from k),
v as ({" union all ".join(f"select site_id, page_id, k_page, k_focus, '{name}' as kind, unnest({name}) as value from b" for name in _KINDS)}),
w as (select *, case kind {" ".join(f"when '{n}' then {_key(O.q(k[0]), 'value')}" for n, k in _KINDS.items())} end as k_value from v)"""
_of = lambda i, quote=True: "case kind " + " ".join(f"when '{n}' then {O.q(k[i]) if quote else k[i]}" for n, k in _KINDS.items()) + " end"


@query(f"""{_BASE},
e as (select site_id, page_id, k_brand as entity_key, 'brand' as entity_type, site_id as name, brand_url as entity_url, 92 as confidence from b union all select site_id, page_id, k_page, 'source_page', title, page_url, 100 from b
 union all select site_id, page_id, k_offer, offer, title, page_url, 84 from b where offer is not null union all select site_id, page_id, k_value, {_of(0)}, value, null, {_of(1, False)} from w)
select site_id, entity_key, entity_type, arg_min(name, (page_id, name)) as name, arg_min(entity_url, (page_id, entity_url)) filter (where entity_url <> '') as entity_url, max(confidence)::double as confidence, count(distinct page_id) as pages from e group by 1, 2, 3""")
def entity_graph_entities(spark, sf_dir):
    merged = graph.merge_entities(_candidates(spark, sf_dir)[0])
    return merged.withColumn("name", F.coalesce("name", F.lit("")))  # the merge keeps no empty names; the brand of an empty source has one


_EDGES = f"""{_BASE},
r0 as (select site_id, page_id, k_page as source_key, 'mentions' as relation_type, k_brand as target_key, 86 as confidence, 'text' as evidence_type, 'title' as evidence_field, 'page.title' as evidence_path, title as evidence_text from b
 union all select site_id, page_id, k_brand, 'offers', k_offer, 88, 'heuristic', 'url_type', url_type, title from b where offer is not null union all select site_id, page_id, k_page, 'describes', k_offer, 92, 'text', 'title', 'page.title', title from b where offer is not null
 union all select site_id, page_id, k_focus, {_of(2)}, k_value, {_of(3, False)}, {_of(4)}, {_of(5)}, {_of(6)}, value from w
 union all select site_id, page_id, k_page, 'mentions', k_value, 68, 'text', 'text_content', 'page.text_content', value from w where kind = 'claims'),
r as (select *, sha256(source_key || '|' || relation_type || '|' || target_key) as edge_key from r0)"""


@query(f"{_EDGES} select site_id, edge_key, source_key, relation_type, target_key, max(confidence)::double as confidence, count(*) as evidence_count, min(page_id) as first_page_id, max(page_id) as last_page_id from r group by 1, 2, 3, 4, 5")
def entity_graph_edges(spark, sf_dir):
    return graph.merge_edges(_candidates(spark, sf_dir)[1])


@query(f"{_EDGES} select site_id, target_key as entity_key, edge_key, page_id, evidence_type, evidence_field, evidence_path, evidence_text, confidence::double as confidence from r")
def entity_graph_evidence(spark, sf_dir):
    return graph.stored_evidence(_candidates(spark, sf_dir)[1]).drop("nth")
