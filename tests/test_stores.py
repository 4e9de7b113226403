"""The bucket store, the asset store and the stored graphs: touched buckets, tombstones, expiry, whole refreshes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pagelens.operators import graph, rollup, task_graphs
from pagelens.operators.assets import AssetStore
from pagelens.operators.bucket_store import BucketStore, Conflict
from pagelens.operators.graph_store import Graph, GraphStore, projected
from pagelens.operators.profiles import page_profiles
from pagelens.sources import schemas

DAY = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
KEYED = "site_id string, key string, v int, at int"


def newest(old, batch):
    from pagelens.operators.store import last_write

    return last_write(old.unionByName(batch), ["site_id", "key"], "at", "v").select(batch.columns)


def files(path):
    return {str(f.relative_to(path)) for f in path.rglob("*.parquet")}


def test_a_merge_rewrites_the_touched_buckets_only(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path), buckets=16, spread=2)
    rows = [(f"s{i % 40}", f"k{i}", i, 0) for i in range(400)]
    first = store.merge("t", spark.createDataFrame(rows, KEYED), "site_id", ["key"], newest)
    assert len(first.touched["t"]) > 12 and sorted(map(tuple, store.read("t").collect())) == sorted(rows)
    before, held = files(tmp_path), store.manifest().folders["t"]
    again = store.merge("t", spark.createDataFrame([("s1", "k1", -1, 5), ("s1", "k1", -2, 4), ("s1", "k41", -3, -1), ("s1", "new", 7, 0)], KEYED), "site_id", ["key"], newest)
    new = files(tmp_path) - before
    assert len(again.touched["t"]) <= 2 and before <= files(tmp_path)  # a site lies in two buckets
    assert {int(f.split("_bucket=")[1].split("/")[0]) for f in new} == set(again.touched["t"])
    want = {(s, k): (v, a) for s, k, v, a in rows} | {("s1", "k1"): (-1, 5), ("s1", "new"): (7, 0)}
    assert {(r.site_id, r.key): (r.v, r["at"]) for r in store.read("t").collect()} == want
    now = store.manifest().folders["t"]
    assert {b for b in now if now[b] != held[b]} == set(again.touched["t"])
    wanted = spark.createDataFrame([("s1", "new"), ("s2", "nowhere")], "site_id string, key string")
    assert [r.v for r in store.lookup("t", wanted, "site_id", ["key"]).collect()] == [7] and store.lookup("none", wanted, "site_id", ["key"]) is None
    assert sorted(map(tuple, store.read("t", manifest=store.manifest(1)).collect())) == sorted(rows)  # the version before
    gone = store.vacuum()
    assert len(gone) == 0 and store.manifest(1).version == 0  # its other buckets are still in use
    assert {(r.site_id, r.key): (r.v, r["at"]) for r in store.read("t").collect()} == want


def test_a_failed_or_late_write_changes_nothing(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path), buckets=4, spread=2)
    store.merge("t", spark.createDataFrame([("a", "1", 1, 1)], KEYED), "site_id", ["key"], newest)
    base = store.manifest()
    broken = lambda old, batch: batch.withColumn("v", F.raise_error(F.lit("no")).cast("int"))
    with pytest.raises(Exception, match="no"):
        store.merge("t", spark.createDataFrame([("a", "1", 2, 2)], KEYED), "site_id", ["key"], broken)
    assert store.manifest() == base and [r.v for r in store.read("t").collect()] == [1]
    bucket = store.bucket(F.col("site_id"), F.struct("key"))
    rows = spark.createDataFrame([("a", "1", 9, 9)], KEYED)
    store.merge("t", spark.createDataFrame([("a", "1", 3, 3)], KEYED), "site_id", ["key"], newest)
    with pytest.raises(Conflict):  # made from a version that another writer has replaced
        store.commit(base, {"t": (rows, bucket, [0, 1, 2, 3])})
    assert [r.v for r in store.read("t").collect()] == [3]
    with pytest.raises(ValueError, match="does not touch"):
        store.commit(store.manifest(), {"t": (rows, bucket, [])})
    assert [r.v for r in store.read("t").collect()] == [3] and len(store.vacuum()) >= 2


def test_assets(spark, tmp_path):
    store = AssetStore(spark, str(tmp_path), buckets=8, spread=2)
    url = "site_id string, url_hash string, final_url string, url_type string, discovery_source string, priority int, fetch_status string, fetched_at timestamp, ord int"
    store.upsert_urls(spark.createDataFrame([("a", "1", "u1", "unknown", "sitemap", 50, "pending", None, 0), ("a", "2", "u2", "product", "sitemap", 20, "pending", None, 1), ("b", "3", "u3", "page", "entry", 0, "success", DAY(0), 2)], url))
    store.upsert_urls(spark.createDataFrame([("a", "1", None, "blog", "link", 60, "success", DAY(1), 0), ("a", "2", "u2b", "blog", "link", 10, "error", None, 1)], url))
    got = {r.url_hash: (r.final_url, r.url_type, r.discovery_source, r.priority, r.fetch_status) for r in store.urls().collect()}
    assert got == {"1": ("u1", "blog", "link", 50, "success"), "2": ("u2b", "product", "link", 10, "pending"), "3": ("u3", "page", "entry", 0, "success")}

    snap = "site_id string, url_hash string, normalized_url string, final_url string, url_type string, profile_json string, content_hash string, fetched_at timestamp"
    row = lambda s, h, p, day, final=None: (s, h, f"n{h}", final or f"f{h}", "page", p, "c", DAY(day))
    store.save_snapshots(spark.createDataFrame([row("a", "1", "old", 1), row("a", "2", "two", 1, "n1"), row("b", "3", "three", 1), row("a", "9", "late", 9)], snap))
    store.save_snapshots(spark.createDataFrame([row("a", "1", "new", 3), row("a", "1", "older", 0)], snap))
    assert {(r.url_hash, r.profile_json) for r in store.snapshots().collect()} == {("1", "new"), ("2", "two"), ("3", "three"), ("9", "late")}
    assert {(r.lookup_url, r.profile_json) for r in store.snapshot_map(spark.createDataFrame([("a",)], "site_id string")).collect()} == {("n1", "new"), ("f1", "new"), ("n2", "two"), ("n9", "late"), ("f9", "late")}

    site = "site_id string, discovery_json string, profiled_page_count int, total_url_count int, snapshot_url_count int, last_discovered_at timestamp, last_snapshot_at timestamp"
    store.save_discoveries(spark.createDataFrame([("a", '{"x":1}', 5, 9, 4, DAY(1), DAY(1)), ("b", '{"y":1}', 5, 9, 1, DAY(1), DAY(1)), ("b", "", 5, 9, 1, DAY(0), DAY(1))], site))
    asks = spark.createDataFrame([("a", True, 6), ("b", True, 5), ("b", False, 20), ("c", False, 1)], "site_id string, full_audit boolean, max_pages int")
    served = {(r.site_id, r.max_pages): (r.reused_discovery, r.discovery_json, r.inventory_satisfied) for r in store.cached_discoveries(asks).collect()}
    assert served == {("a", 6): (False, None, None), ("b", 5): (True, '{"y":1}', True), ("b", 20): (True, '{"y":1}', False), ("c", 1): (False, None, None)}

    version = store.manifest().version
    commit = store.clear_sites(spark.createDataFrame([("a",), ("a",), (None,)], "site_id string"), F.lit(DAY(5)))
    assert commit.version == version + 1 and set(commit.touched) == {"snapshots", "urls", "sites"} and len(commit.touched["urls"]) == 2
    assert {(r.url_hash, r.profile_json) for r in store.snapshots().collect()} == {("3", "three"), ("9", "late")}  # what is later than the delete stays
    assert {(r.url_hash, r.fetch_status, r.fetched_at is None) for r in store.urls().collect()} == {("1", "stale", True), ("2", "stale", True), ("3", "success", False)}
    assert {r.site_id: r.reused_discovery for r in store.cached_discoveries(asks.where("not full_audit").withColumn("site_id", F.when(F.col("site_id") == "c", "a").otherwise(F.col("site_id")))).collect()} == {"a": False, "b": True}
    store.save_snapshots(spark.createDataFrame([row("a", "1", "too old", 4), row("a", "2", "fresh", 6)], snap))
    assert {(r.url_hash, r.profile_json) for r in store.snapshots().collect()} == {("2", "fresh"), ("3", "three"), ("9", "late")}
    assert store.read("snapshots").where("gone").count() == 1 and store.purge(F.lit(DAY(5))) is None
    store.purge(F.lit(DAY(6)))
    assert store.read("snapshots").where("gone").count() == 0 and store.snapshots().count() == 3

    result = "cache_key string, payload string, saved_at timestamp"
    store.put_results(spark.createDataFrame([("x", "1", DAY(0)), ("x", "2", DAY(1)), ("y", "3", DAY(5))], result))
    wanted = spark.createDataFrame([("x",), ("y",), ("z",)], "cache_key string")
    at = lambda n: {(r.cache_key, r.payload) for r in store.get_results(wanted, F.lit(DAY(n))).collect()}
    assert at(7) == {("x", "2"), ("y", "3")} and at(8) == {("y", "3")} and at(12) == set()
    store.put_results(spark.createDataFrame([("x", "4", DAY(20))], result))
    assert at(21) == {("x", "4")}


def test_empty_asset_store(spark, tmp_path):
    store = AssetStore(spark, str(tmp_path))
    sites = spark.createDataFrame([("a",)], "site_id string")
    assert store.urls().count() == store.snapshots(sites).count() == store.snapshot_map().count() == 0
    assert store.get_results(spark.createDataFrame([("x",)], "cache_key string"), F.lit(DAY(0))).count() == 0
    assert store.clear_sites(sites, F.lit(DAY(0))).version == 1 and store.urls().count() == 0


def candidates(spark, names):
    """Entities a, b, … of the named sites, an edge from a to each other, and evidence of it."""
    entities = [(site, f"{site}:{x}", "page", x, None, 50.0, {"n": '"1"'}, 1) for site, xs in names.items() for x in xs]
    edges = [(site, f"{site}:{x}", f"{site}:a", "r", f"{site}:{y}", 1.0, 1, {}, None, None) for site, xs in names.items() for x, y in [(y, y) for y in xs if y != "a"] + [("lost", "nowhere")]]
    evidence = [(site, k, site + ":" + x, 1, 0, "t", "f", "p", "text", 1.0) for site, xs in names.items() for x in xs if x != "a" for k in (f"{site}:{x}", None)]
    evidence += [(site, f"{site}:zz", f"{site}:lost", 1, 0, "t", "f", "p", "lost", 1.0) for site in names]
    return Graph(
        spark.createDataFrame(entities, "site_id string, entity_key string, entity_type string, name string, entity_url string, confidence double, attributes map<string,string>, source_page_id long"),
        spark.createDataFrame(edges, "site_id string, edge_key string, source_key string, relation_type string, target_key string, confidence double, evidence_count long, attributes map<string,string>, first_seen_at timestamp, last_seen_at timestamp"),
        spark.createDataFrame(evidence, "site_id string, entity_key string, edge_key string, page_id long, nth int, evidence_type string, evidence_field string, evidence_path string, evidence_text string, confidence double"),
        spark.createDataFrame([(s,) for s in names], "site_id string"),
    )


def state(store):
    entities = {(r.site_id, r.name): r.entity_id for r in store.table("entities").collect()}
    edges = {(r.from_entity_name, r.to_entity_name, r.site_id): r.edge_id for r in store.edges_read().collect()}
    evidence = sorted(((r.site_id, r.entity_key, r.edge_key) for r in store.evidence_read().collect()), key=str)
    return entities, edges, evidence


def test_refreshes_of_overlapping_sites(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path), buckets=4, spread=2)
    store.refresh(candidates(spark, {"s": "abc", "t": "abd", "u": "a"}))
    entities, edges, evidence = state(store)
    assert sorted(entities.values()) == list(range(1, 8)) and len(edges) == 4 and ("t", "t:d", "t:d") in evidence and len(evidence) == 8  # nothing of lost edges
    store.refresh(candidates(spark, {"t": "abe", "v": "a", "u": ""}))
    entities2, edges2, evidence2 = state(store)
    assert set(entities2) == {("s", x) for x in "abc"} | {("t", x) for x in "abe"} | {("v", "a")}
    assert all(entities2[k] == entities[k] for k in entities2 if k in entities) and all(edges2[k] == edges[k] for k in edges2 if k in edges)
    assert sorted(entities2[k] for k in entities2 if k not in entities) == [8, 9] and not [r for r in evidence2 if r[0] == "u" or "t:d" in r[1:]]
    assert store.table("evidence").count() == store.evidence_read().where("edge_key is not null").count() == 8  # no orphan
    store.refresh(candidates(spark, {"t": "ad"}))  # d comes back under its id
    assert state(store)[0][("t", "d")] == entities[("t", "d")]
    before = state(store)
    bad = candidates(spark, {"s": "ax", "t": "a"})
    with pytest.raises(Exception, match="no"):
        store.refresh(Graph(bad.entities, bad.edges, bad.evidence.withColumn("evidence_text", F.raise_error(F.lit("no")).cast("string")), bad.sites))
    assert state(store) == before
    none = candidates(spark, {})
    store.refresh(none)
    assert state(store) == before


def test_attributes_merge_in_order(spark):
    rows = [
        ("s", "k", 1, {"a": '"x"', "b": "null", "c": "[]", "f": "false"}), ("s", "k", 2, {"a": '"y"', "b": '"b"', "d": '""', "e": "1"}), ("s", "k", 3, {"a": '""', "e": "null", "c": "{}", "f": "null"}),
        ("s", "none", 1, {}), ("s", "none", 2, {"z": "null", "y": "0"}), ("s", "null", 1, None),
    ]
    frame = spark.createDataFrame(rows, "site_id string, entity_key string, nth int, attributes map<string,string>").repartition(3)
    got = {r.entity_key: r.json for r in graph.merge_attributes(frame, ["site_id", "entity_key"], F.col("nth")).select("*", graph.attributes_json(F.col("attributes")).alias("json")).collect()}
    assert got == {"k": '{"a":"y","b":"b","c":[],"e":1,"f":false}', "none": '{"y":0}', "null": "{}"}


def test_projected_graph(spark, tmp_path):
    from test_operators import pages

    profiles = page_profiles(pages(spark)).withColumn("fetched_at", F.lit(DAY(0)) + F.make_dt_interval(F.col("page_id").cast("int")))
    store = GraphStore(spark, str(tmp_path), buckets=4)
    store.refresh(projected(profiles, rollup.site_signals(profiles)))
    entities = {(r.entity_type, r.entity_url): r for r in store.table("entities").collect()}
    page = entities["page", "https://a.example/products/widget"]
    assert page.attributes["page_type"] == '"product"' and page.attributes["schema_types"] == '["Product"]' and page.attributes["lang"] == '"en-us"' and page.source_page_id == 1
    assert entities["site", "https://a.example/"].attributes["scope_root_url"] == '"https://a.example/"'
    organization = entities["organization", "https://a.example"].attributes
    assert organization["company_name_detected"] == "true" and organization["detected_company_name"] == '"Acme"' and organization["same_as_detected"] == "true"
    assert entities["external_profile", "https://social.example/acme"].confidence == 90 and entities["external_profile", "https://social.example/acme"].attributes == {"source": '"sameAs"'}
    edges = {(r.relation_type, r.to_entity_name): r for r in store.edges_read().collect()}
    assert edges["links_to", "About - Acme"].attributes == {"anchor_text": '"About us page"'} and edges["same_as", "social.example"].confidence == 94
    assert edges["represents", "Acme"].evidence_count == 1 and edges["links_to", "About - Acme"].first_seen_at == edges["links_to", "About - Acme"].last_seen_at == DAY(1)
    shown = store.evidence_read().groupBy("evidence_type").count().collect()
    assert {r.evidence_type for r in shown} == {"heuristic", "inventory", "anchor", "json_ld"} and store.evidence_read().where("evidence_type = 'anchor' and evidence_path = 'a[href]' and entity_key is null").count() >= 2


SNAPSHOT = "graph_snapshot_id long, site_id string, task_id string, graph_version string, note string, built_at timestamp, entity_count long, edge_count long, evidence_count long, source_snapshot_count long, entities string, edges string, evidence string, source_pages string, summary_entity_count long, summary_edge_count long, summary_evidence_count long, summary_source_snapshot_count long"


def test_task_graphs(spark):
    v = "site-graph-v1"
    snapshots = spark.createDataFrame([
        (1, "s", "t1", v, "built", DAY(1), 3, 2, 1, 1, '["e1"]', '["r1"]', "[]", None, 5, None, None, None),
        (2, "s", "t1", v, "built", DAY(0), 9, 9, 9, 9, '["old"]', '["old"]', "[]", None, None, None, None, None),
        (3, "s", "t2", v, "", DAY(2), 4, 0, 0, 1, "[]", "[]", None, "[]", 0, None, None, None),
        (4, "s", "t9", "other", "", DAY(9), 4, 0, 0, 1, "[]", "[]", None, "[]", 0, None, None, None),
        (5, "w", "", v, None, DAY(2), 1, 1, 1, 1, '["e"]', '["r"]', '["v"]', None, None, None, None, None),
    ], SNAPSHOT)
    tasks = spark.createDataFrame([("t1", "s"), ("t2", "s"), ("t3", "s"), ("t4", "z"), ("t5", "w"), ("t6", None)], "task_id string, site_id string")
    current = spark.createDataFrame([("s", '["ce"]', '["cr"]', '["cv"]', '["cp"]', 7, 8, 9, 10), ("z", '["z"]', "[]", "[]", "[]", 1, 0, 0, 0)], "site_id string, entities string, edges string, evidence string, source_pages string, entity_count long, edge_count long, evidence_count long, source_snapshot_count long")
    asked = spark.createDataFrame([("t1",), ("t2",), ("t3",), ("t4",), ("t5",), ("t6",), ("t7",), ("t9",), (None,)], "task_id string")
    got = {r.task_id: r for r in task_graphs.task_graphs(asked, tasks, snapshots, current).collect()}
    assert set(got) == {"t1", "t2", "t3", "t4", "t5", "t6"}  # t7 is unknown, t9's snapshot has another version
    assert tuple(got["t1"])[1:7] == ("t1", True, True, "built", "s", 1) and (got["t1"].entities, got["t1"].evidence, got["t1"].source_pages, got["t1"].entity_count, got["t1"].edge_count) == ('["e1"]', "[]", "[]", 5, 2)
    assert (got["t2"].entities, got["t2"].edges, got["t2"].evidence, got["t2"].source_pages) == ('["ce"]', '["cr"]', '["cv"]', '["cp"]') and (got["t2"].entity_count, got["t2"].edge_count, got["t2"].note) == (4, 8, "")
    assert got["t3"].snapshot_task_id == "t2" and not got["t3"].exact_task_match and got["t3"].note == task_graphs.OTHER_TASK_NOTE
    assert not got["t4"].built and got["t4"].entities == '["z"]' and got["t4"].entity_count == 1 and got["t4"].note == task_graphs.NOT_BUILT_NOTE
    assert got["t5"].built and got["t5"].note is None and not got["t6"].built and got["t6"].entities == "[]"

    new, last = task_graphs.reissued(spark.createDataFrame([("t1", "s"), ("t3", "s"), ("t5", "w"), ("t4", "z"), ("t3", "s")], "task_id string, site_id string"), snapshots, F.lit(DAY(30)), 5)
    rows = {r.task_id: r for r in new.collect()}
    assert set(rows) == {"t3", "t5"} and last == 7 and {r.graph_snapshot_id for r in rows.values()} == {6, 7}
    assert rows["t3"].note == "Reused latest site knowledge graph snapshot from task t2." and rows["t5"].note == task_graphs.REUSED_NOTE_NO_TASK and rows["t3"].entity_count == 4
    after = {r.task_id: r.exact_task_match for r in task_graphs.task_graphs(asked, tasks, snapshots.unionByName(new), current).collect()}
    assert after == {"t1": True, "t2": True, "t3": True, "t4": False, "t5": True, "t6": False}


def test_table_schemas(spark):
    assert len(schemas.TABLES) == 8 and {len(t) for t in schemas.TABLES.values()} == {14, 14, 22, 11, 13, 12, 19}
    assert spark.createDataFrame([], schemas.GRAPH_EDGES).columns[:3] == ["edge_id", "site_id", "edge_key"] and schemas.GRAPH_ENTITIES["confidence"].dataType.simpleString() == "decimal(5,2)"


def test_small_merges(spark):
    from pagelens.operators import crawler, page_content, store

    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    grown = store.ensure_rows(old, spark.createDataFrame([("b", 9), ("c", 3), ("c", 3)], "k string, v int"), ["k"])
    assert sorted(map(tuple, grown.collect())) == [("a", 1), ("b", 2), ("c", 3)]
    rows = spark.createDataFrame([("s", "success"), ("t", "success"), (None, "pending")], "site_id string, fetch_status string")
    marked = store.mark_stale(rows, spark.createDataFrame([("s",), ("s",), ("none",)], "site_id string"))
    assert sorted((r.site_id or "", r.fetch_status) for r in marked.collect()) == [("", "pending"), ("s", "stale"), ("t", "success")]
    group = lambda *r: spark.createDataFrame(list(r), "site_id string, pos int, url string, source string")
    merged = page_content.merge_candidates(group(("s", 5, "https://a.example/b", "one"), ("s", 2, "https://A.example/a", "one"), ("t", 1, None, "one")), group(("s", 0, "https://a.example/a", "two"), ("s", 9, "https://a.example/c#x", "two"), ("u", 1, "", "two"), (None, 1, "https://x.example", "two")))
    assert [(r.site_id, r.url, r.source, r.ord) for r in sorted(merged.collect(), key=lambda r: (r.site_id, r.ord))] == [("s", "https://a.example/a", "one", 1), ("s", "https://a.example/b", "one", 2), ("s", "https://a.example/c", "two", 3)]
    many = group(*[("hot", i, f"https://h.example/{i}", "one") for i in range(3000)], *[(f"s{i}", 0, f"https://x{i}.example", "one") for i in range(50)])
    got = page_content.merge_candidates(many.repartition(7)).collect()
    assert sorted(r.ord for r in got if r.site_id == "hot") == list(range(1, 3001)) and all(r.url.endswith(f"/{r.ord - 1}") for r in got if r.site_id == "hot") and all(r.ord == 1 for r in got if r.site_id != "hot")
    codes = spark.createDataFrame([(None,), (200,), (301,), (404,), (429,), (500,)], "status int")
    assert [r.o for r in codes.select(crawler.http_outcome(F.col("status")).alias("o")).collect()] == ["network_error", "success", "redirect", "http_error", "rate_limited", "http_error"]
