"""Queries of the stored tables: graphs with attributes, refreshes, task graphs, the asset store.

The given tables hold no fetch dates and no record of earlier crawls; both are drawn from page
and site ids by the rules stated at each query, over all rows.  Stores are written to the
shared folder, a new one for each call.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions import text as T
from pagelens.functions import urls
from pagelens.operators import graph, page_content, rollup, store, task_graphs
from pagelens.operators.assets import AssetStore
from pagelens.operators.graph_store import GraphStore, projected
from pagelens.operators.profiles import page_profiles
from pagelens.operators.shared import cut, shared_folder
from pagelens.plans import oracle_parts as O
from pagelens.plans import oracle_site as S
from pagelens.plans import site_inputs
from pagelens.plans.catalogue import query, table
from pagelens.sources import structured
from pagelens.sources.pages import read_pages


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid4().hex[:12]}"


def _drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of the pages with drawn elements, fetched on a day of January 2024 by page id."""
    profiles = page_profiles(site_inputs.with_elements(read_pages(spark, sf_dir)))
    return profiles.withColumn("fetched_at", F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.pmod("page_id", F.lit(28)).cast("int")))


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """_drawn with its structured data, parsed once for queries that read it several times."""
    return cut(structured.with_summary(_drawn(spark, sf_dir)).drop("html", "raw", "json_ld"))


def _known(profiles: DataFrame) -> DataFrame:
    return profiles.where("page_url is not null").select("site_id", "page_url").distinct()


# -- SQL of graphs over drawn pages --------------------------------------------------------

_TAIL = S.GRAPH_BASE.replace(O.PROFILES + ",\n", "")
_BUSINESS = "case " + " ".join(f"when regexp_matches(b, {O.q('|'.join(words))}) then {O.q(name)}" for name, words in T.BUSINESS_TYPES.items()) + " else 'general_business' end"
_PROFILE_KEY = S._key("external_profile", "'https://social.example/x'")
_ENTITIES = S.GRAPH_ENTITIES.replace(S.GRAPH_BASE + ",\n", "").replace("from gx),", f"from gx union all select site_id, page_id, ord, {_PROFILE_KEY}, 'external_profile', 'social.example', 'https://social.example/x', 90 from g where contains(raw, '\"sameAs\"')),")
_EDGES = S.GRAPH_EDGES.replace(S.GRAPH_BASE + ",\n", "").replace("from gx\n", f"from gx\n  union all select site_id, page_id, k_org, 'same_as', {_PROFILE_KEY}, 94, 'sameAs', 'https://social.example/x', 94 from g where contains(raw, '\"sameAs\"')\n").replace("count(*) as evidence_count", "case when relation_type = 'represents' then 1 else count(*) end as evidence_count")


def graph_sql(condition: str = "true") -> str:
    """CTEs entities, ge and edges of the drawn pages that meet a condition; st has the sites' facts."""
    return f"{S.FACTS.replace('from pages), ', f'from pages where {condition}), ', 1)},\n{_TAIL},\n{_ENTITIES},\n{_EDGES}"


def _pairs(given: dict[str, str]) -> str:
    """Rows name, value of a candidate's attributes; values as JSON text."""
    return f"unnest([{', '.join(O.q(n) for n in given)}]) as name, unnest([{', '.join(f'''coalesce(to_json({v})::varchar, 'null')''' for v in given.values())}]) as value"


def merged_sql(source: str, keys: str, out: str) -> str:
    """CTEs that merge attributes (keys, ord, nth, name, value) of source into one JSON text a key: out (keys, attributes)."""
    filled = "value not in ('null', '\"\"', '[]', '{}')"
    return f"""{out}_n as (select {keys}, name, arg_max(value, (ord, nth)) filter (where {filled}) as last, min((ord, nth)) as start, arg_min(value, (ord, nth)) as first from {source} group by all),
{out}_s as (select {keys}, min((ord, nth)) as start from {source} group by all),
{out} as (select {", ".join(f"n.{k.strip()}" for k in keys.split(","))}, '{{' || string_agg('"' || name || '":' || coalesce(last, first), ',' order by '"' || name || '":' || coalesce(last, first)) || '}}' as attributes
 from {out}_n n join {out}_s s on {" and ".join(f"n.{k.strip()} = s.{k.strip()}" for k in keys.split(","))} where last is not null or n.start = s.start group by all)"""


_PAGE_FACTS = {"page_type": "url_type", "lang": "lang", "word_count": "word_count", **{n: n for n in ("has_faq", "has_author", "has_publish_date", "has_reference_section", "has_tldr")}, "schema_types": "list_sort(list_distinct(regexp_extract_all(raw, '\"@type\":\"([A-Za-z]+)\"', 1)))"}
_SIGNALS = {"company_name_detected": "named", "address_detected": "address", "phone_detected": "phone", "email_detected": "email", "awards_detected": "awards", "certifications_detected": "certificates", "same_as_detected": "same_as", "detected_company_name": "company", "homepage_brand_mentions": "mentions"}
_FIRST = "(-1, '', null)"


@query(f"""with {graph_sql()},
gb as (select site_id, arg_min({_BUSINESS.replace('regexp_matches(b,', "regexp_matches(lower(concat_ws(' ', title, meta_description, substr(text, 1, 1000))),")}, {S._ORDER}) as business, arg_min(scope_root, {S._ORDER}) as scope_root, arg_min(scheme || '://' || auth, {S._ORDER}) as root from e group by site_id),
gs as (select *, {S._key('site', 'scope_root')} as k_site, {S._key('organization', 'root')} as k_org from gb join st using (site_id)),
ga as (select site_id, k_page as entity_key, 'page' as entity_type, ord, 2 as nth, {_pairs(_PAGE_FACTS)} from g
 union all select site_id, k_product, 'product', ord, 3, {_pairs({'page_url': 'page_url'})} from g where url_type = 'product' union all select site_id, k_service, 'service', ord, 3, {_pairs({'page_url': 'page_url'})} from g where url_type = 'landing'
 union all select site_id, k_target, 'external_source', ord, 4 + k, {_pairs({'source': "'external_link'"})} from gx union all select site_id, {_PROFILE_KEY}, 'external_profile', ord, 99, {_pairs({'source': "'sameAs'"})} from g where contains(raw, '"sameAs"')
 union all select site_id, k_site, 'site', (-1, '', -1), 0, {_pairs({'business_type': 'business', 'scope_root_url': 'scope_root', 'site_root_url': 'root'})} from gs union all select site_id, k_org, 'organization', (-1, '', -1), 0, {_pairs(_SIGNALS)} from gs),
{merged_sql('ga', 'site_id, entity_key, entity_type', 'gm')}
select e.site_id, e.entity_key, e.entity_type, e.name, e.entity_url, e.confidence, coalesce(m.attributes, '{{}}') as attributes from entities e left join gm m on e.site_id = m.site_id and e.entity_key = m.entity_key and e.entity_type = m.entity_type""")
def structure_graph_entity_attributes(spark, sf_dir):
    """Entities of the pages with drawn elements, with their merged attributes."""
    profiles = _kept(spark, sf_dir)
    entities, _ = graph.structure_candidates(profiles, _known(profiles), full=True)
    out = graph.merge_entities_fully(entities, graph.site_candidates(rollup.site_signals(profiles)))
    return out.select("site_id", "entity_key", "entity_type", "name", "entity_url", "confidence", graph.attributes_json(F.col("attributes")).alias("attributes"))


_DAY = "(timestamp '2024-01-01' + to_days((page_id % 28)::int))"


@query(f"""with {graph_sql()},
gr as (select site_id, ord, page_id, k_site as source_key, 'represents' as relation_type, k_org as target_key, 0 as nth, {_pairs({'source': "'discovery'"})} from g
 union all select site_id, ord, page_id, k_site, 'has_page', k_page, 1, {_pairs({'url_type': 'url_type'})} from g
 union all select site_id, ord, page_id, k_page, case when url_type = 'homepage' then 'entity_home' else 'about' end, k_org, 2, {_pairs({'page_type': 'url_type'})} from g where url_type in ('homepage', 'about', 'contact')
 union all select site_id, ord, page_id, k_org, 'offers', case when url_type = 'product' then k_product else k_service end, 3, {_pairs({'source_page_type': 'url_type'})} from g where url_type in ('product', 'landing')
 union all select site_id, ord, page_id, k_page, 'about', case when url_type = 'product' then k_product else k_service end, 4, {_pairs({'source_page_type': 'url_type'})} from g where url_type in ('product', 'landing')
 union all select site_id, ord, page_id, k_page, case when cites then 'cites' else 'references' end, k_target, 10 + k, {_pairs({'anchor_text': 'label'})} from gx
 union all select a.site_id, a.ord, a.page_id, a.k_page, 'links_to', b.k_page, 10 + a.k, {_pairs({'anchor_text': 'a.label'})} from (select * from gl where internal and k <= 30) a join (select distinct site_id, page_url, k_page from g) b on a.site_id = b.site_id and a.t = b.page_url and a.k_page <> b.k_page),
gq as (select *, sha256(source_key || '|' || relation_type || '|' || target_key) as edge_key from gr),
{merged_sql('gq', 'site_id, edge_key', 'gm')},
seen as (select site_id, edge_key, min({_DAY}) as first_seen, max({_DAY}) as last_seen from ge group by all)
select r.site_id, r.edge_key, r.relation_type, r.confidence, r.evidence_count, coalesce(m.attributes, '{{}}') as attributes, strftime(first_seen, '%Y-%m-%d') as first_seen, strftime(last_seen, '%Y-%m-%d') as last_seen
from edges r join seen s on r.site_id = s.site_id and r.edge_key = s.edge_key left join gm m on r.site_id = m.site_id and r.edge_key = m.edge_key""")
def structure_graph_edge_attributes(spark, sf_dir):
    """Edges of the pages with drawn elements, with their merged attributes and when they were first and last seen."""
    profiles = _kept(spark, sf_dir).drop("text")
    _, edges = graph.structure_candidates(profiles, _known(profiles), full=True)
    day = lambda c: F.date_format(f"{c}_at", "yyyy-MM-dd").alias(c)
    return graph.merge_edges_fully(edges).select("site_id", "edge_key", "relation_type", "confidence", "evidence_count", graph.attributes_json(F.col("attributes")).alias("attributes"), day("first_seen"), day("last_seen"))


_FIRST_CRAWL, _SECOND_CRAWL, _RECRAWLED = "page_id % 5 <> 1", "page_id % 3 <> 0", "substr(site_id, 1, 1) < '8'"


@query(f"""with x1 as materialized (with {graph_sql(_FIRST_CRAWL)} select 'n' as kind, site_id, entity_key as key, name, null as source_key, null as relation_type, null as target_key, null as evidence_count from entities union all select 'e', site_id, edge_key, null, source_key, relation_type, target_key, evidence_count from edges),
x2 as materialized (with {graph_sql(_SECOND_CRAWL)} select 'n' as kind, site_id, entity_key as key, name, null as source_key, null as relation_type, null as target_key, null as evidence_count from entities union all select 'e', site_id, edge_key, null, source_key, relation_type, target_key, evidence_count from edges),
r2 as (select * from x2 where {_RECRAWLED}), recrawled as (select distinct site_id from r2),
i1 as (select kind, site_id, key, row_number() over (partition by kind order by site_id, key) as id from x1),
i2 as (select kind, site_id, key, row_number() over (partition by kind order by site_id, key) + (select count(*) from i1 where i1.kind = n.kind) as id from (select kind, site_id, key from r2 except select kind, site_id, key from x1) n),
ids as (select * from i1 union all select * from i2),
now as (select * from r2 union all select * from x1 where site_id not in (select site_id from recrawled)),
n as (select now.site_id, now.key, now.name, ids.id from now join ids on ids.kind = 'n' and now.kind = 'n' and ids.site_id = now.site_id and ids.key = now.key)
select r.site_id, i.id as edge_id, r.relation_type, a.id as from_entity_id, b.id as to_entity_id, a.name as from_entity_name, b.name as to_entity_name, r.evidence_count::bigint as evidence_count, r.evidence_count::bigint as evidence_rows
from now r join ids i on r.kind = 'e' and i.kind = 'e' and i.site_id = r.site_id and i.key = r.key join n a on a.site_id = r.site_id and a.key = r.source_key join n b on b.site_id = r.site_id and b.key = r.target_key""")
def structure_graph_refreshed(spark, sf_dir):
    """The stored edges after two refreshes: the first of all sites, by the pages whose id is not 1 mod 5; the second of the
    sites whose id begins below 8, by the pages whose id is not 0 mod 3.  evidence_rows counts the stored evidence of each edge."""
    profiles = _kept(spark, sf_dir)
    graphs = GraphStore(spark, new_folder(spark, "graphs"), buckets=8)
    for crawl in (profiles.where(_FIRST_CRAWL), profiles.where(_SECOND_CRAWL).where(_RECRAWLED)):
        graphs.refresh(projected(crawl, rollup.site_signals(crawl), _known(crawl)))
    rows = graphs.evidence_read().groupBy("edge_id").agg(F.count("*").alias("evidence_rows"))
    return graphs.edges_read().join(rows, "edge_id").select("site_id", "edge_id", "relation_type", "from_entity_id", "to_entity_id", "from_entity_name", "to_entity_name", "evidence_count", "evidence_rows")


# -- graphs of tasks -----------------------------------------------------------------------

#: Orders are tasks and customers sites; returned or accepted lines are snapshots of graphs (of several lines with one number the last), customers' own rows the current graphs.
_SQL_SNAPSHOTS = """s as (select l_orderkey * 8 + l_linenumber as graph_snapshot_id, o_custkey as site_id, case when l_returnflag = 'A' then l_orderkey end as task_id, l_shipdate as built_at, case when l_linenumber = 1 then '' else l_linestatus end as note,
 l_quantity::bigint as entity_count, (l_quantity * 2)::bigint as edge_count, l_linenumber::bigint as evidence_count, case when l_linenumber > 3 then l_partkey end as summary_entity_count,
 case when l_linestatus = 'F' and l_linenumber <> 2 then '["' || l_partkey || '"]' else '[]' end as entities, case when l_linenumber = 4 then null else '["' || l_suppkey || '"]' end as edges, case l_linenumber when 5 then null when 6 then '[]' else '["line"]' end as evidence 
 from (select * from lineitem where l_returnflag <> 'N' qualify row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, l_partkey desc, l_suppkey desc, l_quantity desc, l_returnflag desc, l_linestatus desc) = 1) join orders on l_orderkey = o_orderkey)"""


def _tasks(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("site_id"))
    c = F.col
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    lines = store.last_write(lines, ["l_orderkey", "l_linenumber"], "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus").join(orders.withColumnRenamed("task_id", "l_orderkey"), "l_orderkey")
    named = lambda v: F.concat(F.lit('["'), v.cast("string"), F.lit('"]'))
    none = F.lit(None).cast("long")
    n = c("l_linenumber")
    snapshots = lines.select(
        (c("l_orderkey") * 8 + n).alias("graph_snapshot_id"), "site_id", F.when(c("l_returnflag") == "A", c("l_orderkey")).alias("task_id"), F.lit(task_graphs.VERSION).alias("graph_version"),
        F.when(n == 1, "").otherwise(c("l_linestatus")).alias("note"), c("l_shipdate").cast("timestamp").alias("built_at"), c("l_quantity").cast("long").alias("entity_count"), (c("l_quantity") * 2).cast("long").alias("edge_count"), n.cast("long").alias("evidence_count"), F.lit(1).cast("long").alias("source_snapshot_count"),
        F.when((c("l_linestatus") == "F") & (n != 2), named(c("l_partkey"))).otherwise("[]").alias("entities"), F.when(n != 4, named(c("l_suppkey"))).alias("edges"), F.when(n == 6, "[]").when(n != 5, '["line"]').alias("evidence"), F.lit(None).cast("string").alias("source_pages"),
        F.when(n > 3, c("l_partkey").cast("long")).alias("summary_entity_count"), none.alias("summary_edge_count"), none.alias("summary_evidence_count"), none.alias("summary_source_snapshot_count"),
    )
    customers = table(spark, sf_dir, "customer")
    current = customers.select(c("c_custkey").alias("site_id"), named(c("c_name")).alias("entities"), named(c("c_nationkey")).alias("edges"), F.when(c("c_nationkey") % 2 == 0, '["now"]').otherwise("[]").alias("evidence"), named(c("c_mktsegment")).alias("source_pages"), F.lit(7).cast("long").alias("entity_count"), c("c_nationkey").cast("long").alias("edge_count"), F.lit(9).cast("long").alias("evidence_count"), F.lit(3).cast("long").alias("source_snapshot_count"))
    return orders, snapshots, current


_GRAPHS = f"""{_SQL_SNAPSHOTS},
bt as (select * from s where task_id is not null qualify row_number() over (partition by task_id order by built_at desc, graph_snapshot_id desc) = 1), bs as (select * from s qualify row_number() over (partition by site_id order by built_at desc, graph_snapshot_id desc) = 1),
j as (select o_orderkey as task, o_custkey as site, bt.graph_snapshot_id is not null as exact, case when bt.graph_snapshot_id is not null then bt else bs end as s from orders left join bt on bt.task_id = o_orderkey left join bs on bs.site_id = o_custkey)"""


@query(f"""with {_GRAPHS},
k as (select *, s.graph_snapshot_id is not null as built, coalesce(s.entities, '[]') = '[]' or s.edges is null or s.evidence is null as lacks, '["' || c_name || '"]' as ce, '["' || c_nationkey || '"]' as cr, case when c_nationkey % 2 = 0 then '["now"]' end as cv, '["' || c_mktsegment || '"]' as cp from j left join customer on c_custkey = site)
select task as task_id, s.task_id as snapshot_task_id, exact as exact_task_match, built, case when not built then 'Knowledge graph has not been built for this task yet.' when not exact and s.task_id is not null and s.task_id <> task then coalesce(nullif(s.note, ''), 'Using the latest site-level knowledge graph snapshot because no exact snapshot was stored for this task.') else s.note end as note,
site as site_id, s.graph_snapshot_id as graph_snapshot_id, coalesce(nullif(s.entities, '[]'), case when lacks then ce end, '[]') as entities, coalesce(nullif(s.edges, '[]'), case when lacks then cr end, '[]') as edges, coalesce(nullif(s.evidence, '[]'), case when lacks then cv end, '[]') as evidence, case when lacks then coalesce(cp, '[]') else '[]' end as source_pages,
coalesce(nullif(coalesce(s.summary_entity_count, case when lacks then 7 end), 0), nullif(s.entity_count, 0), 0)::bigint as entity_count, coalesce(nullif(case when lacks then c_nationkey end, 0), nullif(s.edge_count, 0), 0)::bigint as edge_count from k""")
def task_graph_read(spark, sf_dir):
    """The graph that answers for each order as a task, with fall-back to its customer's; see _SQL_SNAPSHOTS for what is drawn."""
    orders, snapshots, current = _tasks(spark, sf_dir)
    out = task_graphs.task_graphs(orders, orders, snapshots, current)
    return out.select("task_id", "snapshot_task_id", "exact_task_match", "built", "note", "site_id", "graph_snapshot_id", "entities", "edges", "evidence", "source_pages", "entity_count", "edge_count")


@query(f"""with {_GRAPHS} select task as task_id, site as site_id, (select max(graph_snapshot_id) from s) + row_number() over (order by task) as graph_snapshot_id, case when s.task_id is not null then 'Reused latest site knowledge graph snapshot from task ' || s.task_id || '.' else 'Reused latest site knowledge graph snapshot for this task.' end as note, s.entities as entities, s.entity_count as entity_count
from j where not exact and s.graph_snapshot_id is not null""")
def task_graph_reissued(spark, sf_dir):
    """Snapshots appended so that every order has one: its customer's latest under a new id."""
    orders, snapshots, _ = _tasks(spark, sf_dir)
    last = snapshots.agg(F.max("graph_snapshot_id")).first()[0] or 0
    new, _ = task_graphs.reissued(orders, snapshots, F.lit("2030-01-01").cast("timestamp"), last)
    return new.select("task_id", "site_id", "graph_snapshot_id", "note", "entities", "entity_count")


# -- the asset store -------------------------------------------------------------------------

_CLEARED = "substr(site_id, 1, 1) < '4'"


@query(f"""with {O.URLS},
k as (select site_id, sha256(page_url) as url_hash, min(url_type) as url_type, min(case url_type {' '.join(f'when {O.q(n)} then {v}' for n, v in urls.PRIORITY.items())} else 50 end) as priority, bool_or(page_id % 2 = 0) as second, bool_or(page_id % 7 = 0) as third, {_CLEARED} as cleared from u group by all)
select site_id, url_hash, url_type, case when third then least(priority, 5) else priority end as priority, case when third then 'recrawl' when second then 'crawl' else 'sitemap' end as discovery_source,
case when third or (second and not cleared) then 'success' when cleared then 'stale' else 'pending' end as fetch_status, case when third then '2024-08-01' when second and not cleared then '2024-06-01' end as fetched_on, case when third then 'third' when second and not cleared then 'second' end as stored from k""")
def asset_store_state(spark, sf_dir):
    """The URLs of all pages and their snapshots after four writes: a discovery of all, a crawl of even page ids in June, a delete of
    the sites whose id begins below 4 in July, a crawl of the page ids that 7 divides in August."""
    u = F.col("page_url")
    pages = read_pages(spark, sf_dir).select("page_id", urls.normalize_url(F.col("url")).alias("page_url")).where("page_url is not null")
    pages = cut(pages.select("page_id", "page_url", urls.site_id(u).alias("site_id"), F.sha2("page_url", 256).alias("url_hash"), urls.url_type(u).alias("url_type")))
    assets = AssetStore(spark, new_folder(spark, "assets"), buckets=8)

    def crawl(rows, source, day, priority):
        at = F.lit(day).cast("timestamp")
        assets.upsert_urls(rows.select("site_id", "url_hash", u.alias("final_url"), "url_type", F.lit(source).alias("discovery_source"), priority.alias("priority"), F.lit(None).cast("string").alias("fetch_status"), at.alias("fetched_at"), F.col("page_id").alias("ord")))
        return rows.select("site_id", "url_hash", u.alias("normalized_url"), u.alias("final_url"), "url_type", F.lit("third" if source == "recrawl" else "second").alias("profile_json"), F.lit("c").alias("content_hash"), at.alias("fetched_at"))

    own = urls.priority(F.col("url_type"))
    crawl(pages, "sitemap", None, own)
    assets.save_snapshots(crawl(pages.where("page_id % 2 = 0"), "crawl", "2024-06-01", own))
    assets.clear_sites(pages.where(_CLEARED).select("site_id"), F.lit("2024-07-01").cast("timestamp"))
    assets.save_snapshots(crawl(pages.where("page_id % 7 = 0"), "recrawl", "2024-08-01", F.least(own, F.lit(5))))
    stored = assets.snapshots().select("site_id", "url_hash", F.col("profile_json").alias("stored"))
    return assets.urls().join(stored, ["site_id", "url_hash"], "left").select("site_id", "url_hash", "url_type", "priority", "discovery_source", "fetch_status", F.date_format("fetched_at", "yyyy-MM-dd").alias("fetched_on"), "stored")


@query(f"""with {O.URLS}, g as (select site_id, page_url as url, 0 as g, page_id as pos, 'entry' as source from u where segs = [] union all select site_id, page_url, 1, -page_id, 'sitemap' from u where page_id % 3 = 0 union all select site_id, page_url, 2, page_id, 'internal_link' from u),
f as (select site_id, url, min((g, pos, source)) as f from g group by 1, 2) select site_id, url, f[3] as source, row_number() over (partition by site_id order by f[1], f[2], url) as ord from f""".replace("min((g, pos, source)) as f from g", "min({'g': g, 'p': pos, 's': source}) as f from g").replace("f[3]", "f.s").replace("f[1], f[2]", "f.g, f.p"))
def discovery_merge(spark, sf_dir):
    """Each site's URLs once, in order, by the source that named them first: homepages, a drawn sitemap (page ids that 3 divides, last first), links (all)."""
    u = F.col("page_url")
    pages = read_pages(spark, sf_dir).select("page_id", urls.normalize_url(F.col("url")).alias("page_url")).where("page_url is not null").withColumn("site_id", urls.site_id(u))
    group = lambda rows, source, pos: rows.select("site_id", pos.alias("pos"), u.alias("url"), F.lit(source).alias("source"))
    at = F.col("page_id")
    return page_content.merge_candidates(group(pages.where(F.size(urls.segments(u)) == 0), "entry", at), group(pages.where("page_id % 3 = 0"), "sitemap", -at), group(pages, "internal_link", at))


@query(f"""with {O.URLS}, s as (select page_id as snapshot_id, page_url as normalized_url, case when page_id % 2 = 0 then page_url || '?final' else page_url end as final_url, page_id % 28 as day from u where page_id % 3 <> 0),
l as (select normalized_url as url, snapshot_id, day from s union select final_url, snapshot_id, day from s), b as (select * from l qualify row_number() over (partition by url order by day desc, snapshot_id desc) = 1),
w as (select distinct page_url as url from u union select distinct page_url || '?final' from u)
select w.url, b.snapshot_id, b.snapshot_id is null as to_fetch from w left join b on w.url = b.url""")
def snapshot_reuse(spark, sf_dir):
    """Which of the URLs, as given and as redirected, have a stored snapshot: the latest under either of its URLs (page ids that 3 does not divide have one)."""
    u = F.col("page_url")
    pages = read_pages(spark, sf_dir).select("page_id", urls.normalize_url(F.col("url")).alias("page_url")).where("page_url is not null")
    final = F.concat(u, F.lit("?final"))
    snapshots = pages.where("page_id % 3 <> 0").select(F.col("page_id").alias("snapshot_id"), u.alias("normalized_url"), F.when(F.col("page_id") % 2 == 0, final).otherwise(u).alias("final_url"), (F.col("page_id") % 28).alias("fetched_at"))
    wanted = pages.select(F.explode(F.array(u, final)).alias("url")).distinct()
    return store.reuse_snapshots(wanted, snapshots).select("url", "snapshot_id", "to_fetch")
