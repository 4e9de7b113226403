"""Evidence graphs of sites: candidate rows per rule, merged by key.

Each rule projects entities, edges and evidence from the pages; the merge is one
aggregation per table (first name by page order, highest confidence, earliest and
latest sighting), so no site is held in memory.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions import text as T
from pagelens.functions import urls
from pagelens.sources import structured
from pagelens.sources.pages import fixed

lit, col = F.lit, F.col


def entity_key(kind: Column, site: Column, name: Column) -> Column:
    return urls.hash_key(kind, site, name)


def edge_key(source: Column, relation: Column, target: Column) -> Column:
    return urls.hash_key(source, relation, target)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _entity(rows: DataFrame, kind: str, name: Column, url: Column, confidence: Column | float) -> DataFrame:
    confidence = lit(confidence) if isinstance(confidence, (int, float)) else confidence
    return rows.select("site_id", "page_id", "ord", entity_key(lit(kind), col("site_id"), F.coalesce(url, name)).alias("entity_key"), lit(kind).alias("entity_type"), name.alias("name"), url.alias("entity_url"), confidence.cast("double").alias("confidence"))


def _edge(rows: DataFrame, source: Column, relation: Column | str, target: Column, confidence: Column | float, field: str, text: Column, evidence: float | Column) -> DataFrame:
    relation = lit(relation) if isinstance(relation, str) else relation
    confidence = lit(confidence) if isinstance(confidence, (int, float)) else confidence
    evidence = lit(evidence) if isinstance(evidence, (int, float)) else evidence
    return rows.select("site_id", "page_id", "ord", source.alias("source_key"), relation.alias("relation_type"), target.alias("target_key"), confidence.cast("double").alias("confidence"), lit(field).alias("evidence_field"), text.alias("evidence_text"), evidence.cast("double").alias("evidence_confidence")).withColumn("edge_key", edge_key(col("source_key"), col("relation_type"), col("target_key")))


def ordered(profiles: DataFrame) -> DataFrame:
    """The page order that merges follow: shortest URL, then URL, then id."""
    return profiles.where("page_url is not null").withColumn("ord", F.struct(F.length("page_url").alias("n"), col("page_url").alias("u"), col("page_id").alias("i")))


def json_text(value: Column) -> Column:
    """A value of any type as JSON text; null as null."""
    whole = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return F.substring(whole, lit(2), F.length(whole) - 2)


def structure_candidates(profiles: DataFrame, known: DataFrame | None = None, full: bool = False) -> tuple[DataFrame, DataFrame]:
    """Entity and edge candidates of the structure graph: sites, organizations, pages, products, services, external profiles and sources.

    known (site_id, page_url): the pages that links may lead to, those of profiles if not given.  A page's
    candidates are one array, so each table is one scan; only links are joined, with the pages they name.  Of
    a page the first 20 sameAs, 30 internal and 20 external links count, as the rules have it.

    full: candidates also have nth, their place among the page's, seen_at (the page's fetched_at, null without that
    column) and attributes (name -> JSON text); edges also what a stored piece of evidence has.  A
    site's and its organization's attributes come from site_candidates.
    """
    pages = ordered(structured.with_summary(profiles))
    seen = col("fetched_at") if "fetched_at" in profiles.columns else lit(None).cast("timestamp")
    known = pages.select("site_id", "page_url").distinct() if known is None else known
    domain, company = urls.registered_domain(col("page_url")), T.company_name(col("title"))
    key = lambda kind, name: entity_key(lit(kind), col("site_id"), name)
    cites = F.coalesce(col("has_reference_section"), lit(False)) | F.coalesce(col("has_inline_citations"), lit(False))
    pages = pages.withColumns({
        "title_or_url": F.coalesce("title", "page_url"), "domain": domain, "company": company, "root": urls.site_root(col("page_url")), "cites": cites,
        "inside": F.transform(F.slice("internal_links", 1, 30), lambda x: F.struct(urls.normalize_url(x["url"]).alias("url"), F.nullif(F.trim(x["text"]), lit("")).alias("text"))),
        "outside": F.filter(F.transform(F.slice("external_links", 1, 20), lambda x: F.struct(urls.normalize_url(x["url"]).alias("url"), F.nullif(F.trim(x["text"]), lit("")).alias("text"))), lambda x: x["url"].isNotNull()),
        "profiles": F.filter(F.transform(F.slice(F.coalesce("same_as", F.array().cast("array<string>")), 1, 20), urls.normalize_url), lambda u: u.isNotNull()),
    })
    facts = F.struct("lang", "word_count", "has_faq", "has_author", "has_publish_date", "has_reference_section", "has_tldr", F.coalesce("types", F.array().cast("array<string>")).alias("schema_types")) if full else lit(None)
    pages = fixed(pages.select("site_id", "page_id", "ord", "page_url", "scope_root", "url_type", "title_or_url", "domain", "company", "root", "cites", "inside", "outside", "profiles", seen.alias("seen_at"), facts.alias("facts")), "title_or_url", "domain", "company", "root", "cites", "inside", "outside", "profiles")
    name, url = F.coalesce("company", "domain"), col("page_url")
    pages = pages.withColumns({"site_key": key("site", col("scope_root")), "org_key": key("organization", col("root")), "page_key": key("page", url), "product_key": key("product", url), "service_key": key("service", url)})
    pages = fixed(pages, "site_key", "org_key", "page_key", "product_key", "service_key")
    kind = lambda k: col("url_type") == k

    def attributes(given: dict[str, Column]) -> list[Column]:
        pairs = [x for name, value in ((n.rstrip("_"), v) for n, v in given.items()) for x in (lit(name), json_text(value))]
        return [(F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("attributes")] if full else []

    def entity(kind_: str, key_: Column, name_: Column, url_: Column, confidence: Column | float, **given: Column) -> Column:
        return F.struct(key_.alias("entity_key"), lit(kind_).alias("entity_type"), name_.alias("name"), url_.alias("entity_url"), (lit(confidence) if isinstance(confidence, float) else confidence).cast("double").alias("confidence"), *attributes(given))

    fact = lambda name: col(f"facts.{name}") if full else lit(None)
    about_page = {"page_type": col("url_type")} | {n: fact(n) for n in ("lang", "word_count", "has_faq", "has_author", "has_publish_date", "has_reference_section", "has_tldr", "schema_types")}
    placed = [F.posexplode("listed").alias("nth", "x")] if full else [F.explode("listed").alias("x")]
    more = ["nth", "seen_at"] if full else []

    one = [
        entity("site", col("site_key"), col("domain"), col("scope_root"), 100.0),
        entity("organization", col("org_key"), name, col("root"), F.when(col("company").isNotNull(), 88.0).otherwise(72.0)),
        entity("page", col("page_key"), col("title_or_url"), url, 100.0, **about_page),
        F.when(kind("product"), entity("product", col("product_key"), col("title_or_url"), url, 84.0, page_url=url)),
        F.when(kind("landing"), entity("service", col("service_key"), col("title_or_url"), url, 82.0, page_url=url)),
    ]
    many = [
        F.transform("outside", lambda x: entity("external_source", entity_key(lit("external_source"), col("site_id"), x["url"]), urls.registered_domain(x["url"]), x["url"], 70.0, source=lit("external_link"))),
        F.transform("profiles", lambda u: entity("external_profile", entity_key(lit("external_profile"), col("site_id"), u), urls.registered_domain(u), u, 90.0, source=lit("sameAs"))),
    ]
    listed = F.filter(F.concat(F.array(*one), *many), lambda x: x.isNotNull())
    entities = pages.select("site_id", "page_id", "ord", "seen_at", listed.alias("listed")).select("site_id", "page_id", "ord", "seen_at", *placed).select("site_id", "page_id", "ord", *more, "x.*")

    def edge(source: Column, relation: Column | str, target: Column | None, confidence: Column | float, field: str, text: Column, evidence: Column | float, link: Column | None = None, by: tuple[str, str | Column] = ("", ""), **given: Column) -> Column:
        number = lambda v: (lit(v) if isinstance(v, float) else v).cast("double")
        null = lit(None).cast("string")
        return F.struct(source.alias("source_key"), (lit(relation) if isinstance(relation, str) else relation).alias("relation_type"), (null if target is None else target).alias("target_key"), number(confidence).alias("confidence"), lit(field).alias("evidence_field"), text.alias("evidence_text"), number(evidence).alias("evidence_confidence"), (null if link is None else link).alias("link"), *stored(by), *attributes(given))

    def stored(by: tuple[str, str | Column]) -> list[Column]:
        path = lit(by[1]) if isinstance(by[1], str) else by[1]
        return [lit(by[0]).alias("evidence_type"), path.alias("evidence_path")] if full else []

    level = F.when(col("cites"), 70.0).otherwise(62.0)
    is_home = kind("homepage")
    one = [
        edge(col("site_key"), "represents", col("org_key"), 92.0, "site_signals", name, 80.0, by=("heuristic", "discovery.site_signals"), source_=lit("discovery")),
        edge(col("site_key"), "has_page", col("page_key"), 100.0, "url_type", col("url_type"), 100.0, by=("inventory", "page_snapshots"), url_type=col("url_type")),
        F.when(col("url_type").isin("homepage", "about", "contact"), edge(col("page_key"), F.when(is_home, "entity_home").otherwise("about"), col("org_key"), F.when(is_home, 86.0).otherwise(78.0), "page_type", col("title_or_url"), 75.0, by=("heuristic", col("url_type")), page_type=col("url_type"))),
        F.when(kind("product"), edge(col("org_key"), "offers", col("product_key"), 82.0, "url_type", col("title_or_url"), 82.0, by=("heuristic", col("url_type")), source_page_type=col("url_type"))),
        F.when(kind("product"), edge(col("page_key"), "about", col("product_key"), 90.0, "title", col("title_or_url"), 90.0, by=("heuristic", "page.title"), source_page_type=col("url_type"))),
        F.when(kind("landing"), edge(col("org_key"), "offers", col("service_key"), 80.0, "url_type", col("title_or_url"), 80.0, by=("heuristic", col("url_type")), source_page_type=col("url_type"))),
        F.when(kind("landing"), edge(col("page_key"), "about", col("service_key"), 88.0, "title", col("title_or_url"), 88.0, by=("heuristic", "page.title"), source_page_type=col("url_type"))),
    ]
    many = [
        F.transform("outside", lambda x: edge(col("page_key"), F.when(col("cites"), "cites").otherwise("references"), entity_key(lit("external_source"), col("site_id"), x["url"]), level, "external_links", F.coalesce(x["text"], x["url"]), level, by=("anchor", "a[href]"), anchor_text=x["text"])),
        F.transform("profiles", lambda u: edge(col("org_key"), "same_as", entity_key(lit("external_profile"), col("site_id"), u), 94.0, "sameAs", u, 94.0, by=("json_ld", "page_profile.json_ld_summary.same_as"))),
        F.transform("inside", lambda x: edge(col("page_key"), "links_to", None, 72.0, "internal_links", F.coalesce(x["text"], x["url"]), 72.0, x["url"], by=("anchor", "a[href]"), anchor_text=x["text"])),
    ]
    listed = F.filter(F.concat(F.array(*one), *many), lambda x: x.isNotNull())
    edges = pages.select("site_id", "page_id", "ord", "seen_at", listed.alias("listed")).select("site_id", "page_id", "ord", "seen_at", *placed).select("site_id", "page_id", "ord", *more, "x.*")
    # links to pages that are known; edges of other kinds have their target and pass, each under a key of its own
    known = known.select(col("site_id").alias("of_site"), col("page_url").alias("known_url"))
    edges = edges.withColumn("asked", F.coalesce("link", F.concat(lit("-"), col("page_id").cast("string"))))
    joined = edges.join(known, (col("site_id") == col("of_site")) & (col("asked") == col("known_url")), "left")
    target = F.coalesce("target_key", F.when(col("known_url").isNotNull(), entity_key(lit("page"), col("site_id"), col("link"))))
    edges = joined.withColumn("target_key", target).where("target_key is not null and (relation_type <> 'links_to' or target_key <> source_key)").drop("of_site", "known_url", "asked", "link")
    return entities, edges.withColumn("edge_key", edge_key(col("source_key"), col("relation_type"), col("target_key")))


def merge_entities(candidates: DataFrame) -> DataFrame:
    """One row per key: the name and url of its first page (of several there the first in order), the highest confidence, how many pages show it."""
    first = lambda name: F.min(F.when(F.length(F.coalesce(col(name), lit(""))) > 0, F.struct("ord", col(name).alias("v"))))["v"].alias(name)
    return candidates.groupBy("site_id", "entity_key", "entity_type").agg(first("name"), first("entity_url"), F.max("confidence").alias("confidence"), F.count_distinct("page_id").alias("pages"))


def merge_edges(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("site_id", "edge_key", "source_key", "relation_type", "target_key").agg(F.max("confidence").alias("confidence"), F.count("*").alias("evidence_count"), F.min("page_id").alias("first_page_id"), F.max("page_id").alias("last_page_id"))


#: JSON texts of values that are empty.
EMPTY = ("null", '""', "[]", "{}")


def site_candidates(signals: DataFrame) -> DataFrame:
    """signals (rollup.site_signals with scope_root, root and same_as_detected) -> full candidates that give a site and its organization their attributes.

    They have the keys that structure_candidates gives, no name or confidence of their own, and come before every page.
    """
    names = ("company_name_detected", "address_detected", "phone_detected", "email_detected", "awards_detected", "certifications_detected", "same_as_detected", "detected_company_name", "homepage_brand_mentions")
    site = F.create_map(lit("business_type"), json_text(col("business_type")), lit("scope_root_url"), json_text(col("scope_root")), lit("site_root_url"), json_text(col("root")))
    organization = F.create_map(*[x for n in names for x in (lit(n), json_text(col(n)))])
    one = lambda kind, url, given: F.struct(entity_key(lit(kind), col("site_id"), url).alias("entity_key"), lit(kind).alias("entity_type"), given.alias("attributes"))
    listed = F.explode(F.array(one("site", col("scope_root"), site), one("organization", col("root"), organization)))
    none = F.struct(lit(-1).alias("n"), lit("").alias("u"), lit(None).cast("long").alias("i"))
    return signals.select("site_id", none.alias("ord"), lit(0).alias("nth"), listed.alias("x")).select("site_id", "ord", "nth", "x.*")


def merge_attributes(candidates: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """candidates (keys, attributes: name -> JSON text) -> keys and one map: of each name the last value that is not empty.

    An empty value (null, "", [] or {}) stays only if the key's first candidate had it and no later one filled it.  Two
    aggregations, by key and name and then by key, both combined before the shuffle, so no key is gathered.
    """
    each = candidates.select(*keys, order.alias("_order"), F.explode_outer("attributes").alias("_name", "_value"))
    filled = ~col("_value").isin(*EMPTY)
    named = each.groupBy(*keys, "_name").agg(F.max_by("_value", F.when(filled, col("_order"))).alias("_last"), F.min("_order").alias("_from"), F.min_by("_value", "_order").alias("_first"))
    listed = F.collect_list(F.struct("_name", F.coalesce("_last", "_first").alias("_value"), col("_last").isNotNull().alias("_filled"), "_from"))
    grouped = named.groupBy(*keys).agg(listed.alias("_listed"), F.min("_from").alias("_start"))
    kept = F.filter("_listed", lambda x: x["_name"].isNotNull() & (x["_filled"] | (x["_from"] == col("_start"))))
    return grouped.select(*keys, F.map_from_entries(F.transform(F.array_sort(kept), lambda x: F.struct(x["_name"], x["_value"]))).alias("attributes"))


def attributes_json(attributes: Column) -> Column:
    """A map of JSON texts as one JSON object, names in order."""
    pairs = F.array_sort(F.transform(F.map_entries(attributes), lambda e: F.concat(json_text(e["key"]), lit(":"), e["value"])))
    return F.concat(lit("{"), F.array_join(pairs, ","), lit("}"))


def merge_entities_fully(candidates: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """merge_entities of full candidates, with attributes and the page that showed each first; sites: see site_candidates."""
    keys = ["site_id", "entity_key", "entity_type"]
    own = candidates.select(*keys, "ord", "nth", "attributes")
    given = own if sites is None else own.unionByName(sites.select(*own.columns))
    first_page = candidates.groupBy(*keys).agg(F.min_by("page_id", F.when(~col("entity_type").isin("site", "organization"), col("ord"))).alias("source_page_id"))
    return merge_entities(candidates).join(first_page, keys).join(merge_attributes(given, keys, F.struct("ord", "nth")), keys)


def merge_edges_fully(candidates: DataFrame) -> DataFrame:
    """merge_edges of full candidates, with attributes and when each was first and last seen; what the site's signals show counts once."""
    keys = ["site_id", "edge_key", "source_key", "relation_type", "target_key"]
    seen = candidates.groupBy(*keys).agg(F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_seen_at"))
    merged = merge_edges(candidates).withColumn("evidence_count", F.when(col("relation_type") == "represents", 1).otherwise(col("evidence_count")))
    return merged.join(seen, keys).join(merge_attributes(candidates, keys, F.struct("ord", "nth")), keys)


def stored_evidence(candidates: DataFrame) -> DataFrame:
    """What shows each edge, from full candidates of edges: internal links show an edge only, the others its target too; the site's signals count once and name no page."""
    columns = ("evidence_type", "evidence_field", "evidence_path", "evidence_text")
    shown = F.when(col("relation_type") != "links_to", col("target_key")).alias("entity_key")
    by_page, of_site = col("evidence_field") != "site_signals", col("evidence_field") == "site_signals"
    pages = candidates.where(by_page).select("site_id", shown, "edge_key", "page_id", "nth", *columns, col("evidence_confidence").alias("confidence"))
    first = F.min(F.struct("ord", *columns, "evidence_confidence")).alias("x")
    sites = candidates.where(of_site).groupBy("site_id", shown, "edge_key").agg(first)
    return pages.unionByName(sites.select("site_id", "entity_key", "edge_key", lit(None).cast("long").alias("page_id"), lit(0).alias("nth"), *[f"x.{c}" for c in columns], col("x.evidence_confidence").alias("confidence")))


def evidence(candidates: DataFrame) -> DataFrame:
    return candidates.select("site_id", "edge_key", "target_key", "page_id", "evidence_field", "evidence_text", "evidence_confidence")


def read_graph(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the names of both ends; edges without either end drop out (both tables hold each key once)."""
    end = lambda side: entities.select(col("entity_key").alias(f"{side}_key"), col("name").alias(f"{side}_name"), col("entity_type").alias(f"{side}_type"))
    return edges.join(end("source"), "source_key").join(end("target"), "target_key").select("site_id", "edge_key", "source_type", "source_name", "relation_type", "target_type", "target_name", "confidence", "evidence_count")


def type_counts(entities: DataFrame, edges: DataFrame) -> DataFrame:
    one = lambda df, c, kind: df.groupBy(col(c).alias("type")).agg(F.count("*").alias("n")).withColumn("kind", lit(kind))
    return one(entities, "entity_type", "entity").unionByName(one(edges, "relation_type", "relation")).select("kind", "type", "n")


#: Rows of a site's graph in one document.
DOCUMENT_ROWS = 1000


def graph_documents(entities: DataFrame, edges: DataFrame, most: int = DOCUMENT_ROWS) -> DataFrame:
    """JSON documents of each site's graph, in parts of about `most` rows: site_id, part, parts, entity_count, edge_count, document.

    Rows are dealt to parts by their key, so no site is gathered in one task; a site has as many parts as its rows ask for.
    """
    counted = entities.groupBy("site_id").agg(F.count("*").alias("entity_count")).join(edges.groupBy("site_id").agg(F.count("*").alias("edge_count")), "site_id", "left").withColumn("edge_count", F.coalesce("edge_count", lit(0)))
    counted = counted.withColumn("parts", F.ceil((col("entity_count") + col("edge_count")) / most).cast("int"))
    item = lambda kind, key, names: F.struct(lit(kind).alias("kind"), col(key).alias("key"), F.to_json(F.struct(*names)).alias("json"))
    rows = entities.select("site_id", item("entity", "entity_key", ["entity_key", "entity_type", "name", "entity_url", "confidence"]).alias("x"))
    rows = rows.unionByName(edges.select("site_id", item("edge", "edge_key", ["edge_key", "source_key", "relation_type", "target_key", "confidence", "evidence_count"]).alias("x")))
    dealt = rows.join(counted, "site_id").withColumn("part", F.pmod(F.xxhash64("x.key"), col("parts")).cast("int"))
    each = dealt.groupBy("site_id", "part", "parts", "entity_count", "edge_count").agg(F.sort_array(F.collect_list("x")).alias("rows"))
    side = lambda kind: F.concat(lit("["), F.array_join(F.transform(F.filter("rows", lambda r: r["kind"] == kind), lambda r: r["json"]), ","), lit("]"))
    return each.select("site_id", "part", "parts", "entity_count", "edge_count", F.concat(lit('{"entities":'), side("entity"), lit(',"edges":'), side("edge"), lit("}")).alias("document"))
