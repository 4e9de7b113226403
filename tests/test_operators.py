import datetime as dt
import json

from pyspark.sql import functions as F

from pagelens.operators import crawler, entity_graph, graph, modules, page_content, scores, seo, store
from pagelens.operators.bucket_store import BucketStore
from pagelens.operators.profiles import page_profiles, with_elements
from pagelens.plans import site_inputs
from pagelens.sources import structured
from pagelens.sources.pages import page_facts
from pagelens.streaming.ingest import fetch_counts, merge_into, merged_pages, page_stream

HTML = """<!DOCTYPE html><html lang="en-US"><head><title>Widget &amp; Co | Acme</title><meta name="Description" content="All about widgets"><link rel="canonical" href="https://a.example/products/widget">
<script type="application/ld+json">{"@type":"Product","name":"Widget of Acme","sameAs":["https://social.example/acme"],"datePublished":"2025-01-01"}</script><style>p{}</style></head>
<body><!-- no --><h1>Widget</h1><h2>Fast Charging</h2><p>The widget is a tool. Ideal for camping trips. 768Wh capacity. Customers find it reliable. Sources: see below. According to Acme, 2024-01-02.</p>
<a href="/about">About us page</a><a href="/about">again</a><a href="https://other.example/spec">Spec sheet of the widget</a><a href="mailto:x@y.z">mail</a><h2></h2></body></html>"""


def pages(spark):
    rows = [(1, "https://a.example/products/widget", HTML), (2, "https://a.example/about", "<html><title>About - Acme</title><h1>About</h1><a href='/products/widget'>The widget page</a></html>"), (3, None, None), (4, "", "<p>x")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_page_facts(spark):
    rows = {r.page_id: r for r in page_facts(pages(spark)).collect()}
    one = rows[1]
    assert one.title == "Widget & Co | Acme" and one.meta_description == "All about widgets" and one.canonical == "https://a.example/products/widget" and one.lang == "en-us" and one.locale == "en"
    assert [(h.level, h.text) for h in one.headings] == [("h1", "Widget"), ("h2", "Fast Charging")]
    assert [(x.url, x.text) for x in one.links] == [("https://a.example/about", "About us page"), ("https://other.example/spec", "Spec sheet of the widget")]
    assert "no" not in one.text.split() and "p{}" not in one.text and one.url_type == "product" and len(one.json_ld) == 1
    assert rows[3].text == "" and rows[3].page_url is None and rows[4].text == "x"


def test_structured_data_scores(spark):
    facts = page_facts(pages(spark))
    found = {r.page_id: r for r in structured.summarize(facts, "page_id").collect()}
    assert found[1].has_product and found[1].has_date_published and found[1].same_as == ["https://social.example/acme"] and found[1].relation_count == 1 and not found[2].json_ld_present
    joined = page_profiles(pages(spark)).join(structured.summarize(facts, "page_id"), "page_id")
    row = {r.page_id: r for r in scores.scored_pages(joined).collect()}[1]
    assert row.schema_score == 18 + 10 + 5 + 10 and 0 <= row.overall_score <= 100


def test_structured_data_reaches_the_scorers(spark):
    row = {r.page_id: r for r in scores.scored_pages(page_profiles(pages(spark))).collect()}
    assert row[1].schema_score == 18 + 10 + 5 + 10 and row[1].has_product and row[2].schema_score == 0
    facts = modules.site_facts(page_profiles(pages(spark)))
    sites = modules.audited(facts, site_inputs.site_inputs(facts.select("site_id")))
    checks = seo.seo_checks(sites)
    assert checks.count() == 26 * facts.count() and {r.outcome for r in checks.collect()} <= {"pass", "fail", "na"}
    support = {r.page_id: r.schema_support_score for r in page_content.page_content_audit(page_profiles(pages(spark))).collect()}
    assert support[1] >= 15 + 10 + 8 and support[2] == 0


def test_citability_example(spark):
    rows = [("homepage", "t", "m", "c", 1, 1, 180, False, False, False, False, False, 20, 25), ("service", "t", "m", "c", 1, 4, 900, True, True, True, True, True, 82, 88)]
    names = "page string, title string, meta_description string, canonical string, h1_count int, heading_count int, word_count int, answer_first boolean, has_quantified_data boolean, has_faq boolean, has_author boolean, has_publish_date boolean, information_density_score int, chunk_structure_score int"
    got = spark.createDataFrame(rows, names).withColumn("s", scores.citability()).select("page", "s", scores.citation_probability(F.col("s")).alias("p")).collect()
    assert [(r.s, r.p) for r in got] == [(36, "LOW"), (100, "HIGH")]
    assert spark.range(1).select(scores.score(F.lit(36) * 0.45 + F.lit(100) * 0.55)).first()[0] == 71


def test_issues_of_thin_article(spark):
    scored = scores.scored_pages(page_profiles(pages(spark)))
    for row in scored.select(scores.issues().alias("x")).collect():
        assert [i.ord for i in row.x] == sorted(i.ord for i in row.x)
    top = scores.worst_pages(scored, 1).groupBy("site_id").count().collect()
    assert all(r["count"] == 1 for r in top)


def test_percentages_sum_to_100(spark):
    rows = spark.createDataFrame([(1, 1, 1, 1), (2, 0, 0, 0), (3, 2, 5, 0)], "k int, a int, b int, c int")
    got = scores.percentages(rows, "k", ["a", "b", "c"]).groupBy("k").agg(F.sum("percentage").alias("s"), F.max(F.when(F.col("part") == "a", F.col("percentage"))).alias("a")).collect()
    assert all(r.s == 100 for r in got) and {r.k: r.a for r in got}[1] == 34


def test_brand_and_backlinks(spark):
    row = spark.range(1).select(scores.brand_authority(F.lit(100), F.lit(100), F.lit(70), F.lit(None)).alias("b"), scores.backlink_quality(F.lit(42), F.lit(88), F.lit(40), F.lit(0.6)).alias("q"), scores.backlink_quality(F.lit(None), F.lit(1), F.lit(1), F.lit(0.1)).alias("n")).first()
    assert row.b == 90 and row.q == 35 and row.n is None


def test_graph_ends_exist_and_merge_is_stable(spark):
    entities, edges = graph.structure_candidates(page_profiles(pages(spark)))
    results = []
    for n in (1, 7):
        e, r = graph.merge_entities(entities.repartition(n)), graph.merge_edges(edges.repartition(n))
        results.append((sorted(map(tuple, e.collect()), key=str), sorted(map(tuple, r.collect()), key=str)))
        assert graph.read_graph(e, r).count() == r.count()
    assert results[0] == results[1]
    assert {x[2] for x in results[0][0]} == {"site", "organization", "page", "product", "external_source", "external_profile"}
    assert {x[3] for x in results[0][1]} == {"represents", "has_page", "about", "offers", "links_to", "cites", "same_as"}


def test_graph_documents_hold_every_row_in_bounded_parts(spark):
    entities, edges = graph.structure_candidates(page_profiles(pages(spark)))
    entities, edges = graph.merge_entities(entities), graph.merge_edges(edges)
    parts = graph.graph_documents(entities, edges, 3).collect()
    found = [json.loads(r.document) for r in parts]
    assert sum(len(d["entities"]) for d in found) == entities.count() and sum(len(d["edges"]) for d in found) == edges.count() and len(parts) > 1


def test_page_elements(spark):
    html = """<html><head><meta name="viewport" content="width=1"><meta property="og:title" content="t"><meta name="Robots" content="NoIndex"><link rel="alternate" hreflang="de-AT" href="/de"><link rel="stylesheet" href="a.css">
    <script src="a.js"></script><script async src="b.js"></script><meta name="google-site-verification" content="x"><script>gtag('x')</script></head><body><h2>a</h2><h1>b</h1><img src="x" loading="lazy" alt=""><img src="y" alt="z" width="1" height="2"><a rel="nofollow" href="/q">q</a>"""
    row = with_elements(page_profiles(spark.createDataFrame([(1, "https://a.example/", html)], "page_id long, url string, html string"))).first()
    assert row.viewport and row.open_graph_present and not row.twitter_card_present and row.noindex and row.hreflangs == ["de"] and row.ga4 and row.gsc_verification and row.first_h1 == "b"
    assert (row.images_with_alt_ratio, row.lazy_ratio, row.image_score, row.sync_scripts, row.stylesheets, row.nofollow_links) == (0.5, 0.5, 50, 1, 1, 1)


def test_sites_without_inputs_are_scored(spark):
    none = site_inputs.site_inputs(spark.createDataFrame([], "site_id string"))
    rows = modules.audited(modules.site_facts(page_profiles(pages(spark))), none)
    got = rows.collect()
    assert got and all(r.composite_score is not None and r.backlink_score is None and r.visibility_score is not None for r in got)
    known = {r.check_id: r.outcome for r in seo.seo_checks(rows.where("host = 'a.example'")).collect()}
    assert known["CHK-001"] == "na" and known["CHK-009"] == "fail" and known["CHK-011"] == "na" and known["CHK-018"] == "fail"
    shares = modules.perception(rows).groupBy("site_id").agg(F.sum("percentage").alias("s")).collect()
    assert all(r.s == 100 for r in shares)


def entity_pages(spark, text, headings, title=None, url_type="product"):
    row = ("s", 1, "https://a.example/p", url_type, title, "en", 9, text, headings, "Acme", "https://a.example")
    names = "site_id string, page_id long, page_url string, url_type string, title string, lang string, word_count long, text string, headings array<string>, brand_name string, brand_url string"
    return spark.createDataFrame([row], names).withColumn("ord", F.struct("page_id"))


def test_entity_graph(spark):
    text = "768Wh capacity and 1200W output.\nIdeal for camping trips and home backup. Customers say it is easy to use and reliable. Features: quick start guide, and more. Charges 80% now. Only 90%x."
    entities, edges = entity_graph.candidates(entity_pages(spark, text, ["- Fast Charging:", "Overview", "a b c d e f g h i", "Fast Charging"]))
    found = {(r.entity_type, r.name) for r in graph.merge_entities(entities).collect()}
    assert {n for t, n in found if t == "feature"} == {"Fast Charging", "quick start guide"}
    assert {n for t, n in found if t == "specification"} == {"capacity and 1200W", "Only 90%"}  # a phrase loses the digits it begins with, a % counts where a letter follows
    assert {n for t, n in found if t == "use_case"} == {"camping trips and home backup"} and ("product_model", "https://a.example/p") in found
    assert {n for t, n in found if t == "sentiment_claim"} == {"Customers say it is easy to use and reliable"}
    merged = {(r.relation_type, r.confidence) for r in graph.merge_edges_fully(edges).collect()}
    assert merged == {("mentions", 86.0), ("mentions", 68.0), ("offers", 88.0), ("describes", 92.0), ("has_feature", 76.0), ("has_spec", 78.0), ("suited_for", 72.0), ("backed_by_claim", 64.0)}
    assert {r.evidence_type for r in graph.stored_evidence(edges).collect()} == {"text", "heuristic", "heading"}
    page = next(r for r in graph.merge_entities_fully(entities).collect() if r.entity_type == "source_page")
    assert page.attributes["text_excerpt"].startswith('"768Wh capacity and') and page.attributes["word_count"] == "9"
    plain, _ = entity_graph.candidates(entity_pages(spark, "Great for boats", None, "T", "service"))
    assert {(r.entity_type, r.name) for r in plain.collect()} == {("brand", "Acme"), ("source_page", "T"), ("service_offer", "T"), ("use_case", "boats")}


def test_entity_graph_reads_whole_texts(spark):
    text = "Word here. " * 1000 + "".join(f"Rated {i} Ah. Customers saw {i}. Great for trip number {i}. Supports charging mode {i}. " for i in range(20))
    rows = entity_pages(spark, text, [])
    found = {(r.entity_type, r.name) for r in entity_graph.candidates(rows)[0].collect()}
    for i in range(20):
        assert {("specification", f"Rated {i} Ah"), ("sentiment_claim", f"Customers saw {i}"), ("use_case", f"trip number {i}"), ("feature", f"charging mode {i}")} <= found
    short = entity_graph.candidates(entity_pages(spark, text[-1700:], []), entity_graph.AUDITED)[0].groupBy("entity_type").count().collect()
    assert {r.entity_type: r["count"] for r in short if r.entity_type not in ("brand", "source_page", "product_model")} == {"feature": 4, "specification": 10, "use_case": 8, "sentiment_claim": 6}


def test_upsert_rules_and_idempotence(spark):
    names = "site_id string, url_hash string, final_url string, url_type string, discovery_source string, priority int, fetch_status string, fetched_at timestamp"
    old = spark.createDataFrame([("s", "a", "u1", "page", "sitemap", 50, "pending", None, False), ("s", "b", "u2", "blog", "sitemap", 20, "fetched", None, True)], names + ", is_active boolean")
    day = dt.datetime(2024, 1, 1)
    batch = spark.createDataFrame([("s", "a", None, "product", "crawl", 10, "fetched", day, 1), ("s", "b", "u9", "docs", "crawl", 30, "error", None, 2), ("s", "c", "u3", "faq", "crawl", 20, "pending", None, 3)], names + ", ord int")
    once = store.upsert_urls(old, batch)
    rows = {r.url_hash: r for r in once.collect()}
    assert (rows["a"].final_url, rows["a"].url_type, rows["a"].priority, rows["a"].fetch_status, rows["a"].is_active) == ("u1", "product", 10, "fetched", True)
    assert (rows["b"].final_url, rows["b"].url_type, rows["b"].priority, rows["b"].fetch_status) == ("u9", "blog", 20, "fetched") and rows["c"].is_active
    assert sorted(map(tuple, store.upsert_urls(once, batch).collect()), key=str) == sorted(map(tuple, once.collect()), key=str)


def test_latest_graph_falls_back_to_the_site(spark):
    tasks = spark.createDataFrame([("t1", "s1"), ("t2", "s1"), ("t3", "s2")], "task_id string, site_id string")
    snapshots = spark.createDataFrame([("t1", "s1", 1, 5), ("t9", "s1", 2, 9)], "task_id string, site_id string, snapshot_id int, built_at int")
    got = {r.task_id: (r.snapshot_id, r.source) for r in store.latest_graph(tasks, snapshots).collect()}
    assert got == {"t1": (1, "task"), "t2": (2, "site"), "t3": (None, "none")}


def test_retry_after(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    row = spark.range(1).select(crawler.retry_after(F.lit("60"), now).alias("a"), crawler.retry_after(F.lit("Mon, 01 Jan 2024 00:01:00 GMT"), now).alias("b"), crawler.retry_after(F.lit("soon"), now).alias("c")).first()
    assert (row.a, row.b, row.c) == (60, 60, 0)


def test_streams(spark, tmp_path):
    rows = [("https://a.example/1", "x", dt.datetime(2024, 1, 1, 0, 1)), ("https://a.example/1", "x", dt.datetime(2024, 1, 1, 0, 2)), ("https://a.example/1", "y", dt.datetime(2024, 1, 1, 0, 3)), ("https://b.example/", None, dt.datetime(2024, 1, 1, 2, 0))]
    spark.createDataFrame(rows, "url string, html string, fetched_at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("url string, html string, fetched_at timestamp").parquet(str(tmp_path / "in"))
    writing = page_stream(stream).writeStream.foreachBatch(merge_into(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    writing.awaitTermination(120)
    table = merged_pages(spark, str(tmp_path / "out")).collect()
    assert sorted((r.url, r.fetched_at.minute) for r in table) == [("https://a.example/1", 3), ("https://b.example/", 0)]
    counts = fetch_counts(stream).writeStream.format("memory").queryName("fetches").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    counts.awaitTermination(120)
    assert {(r.host, r.fetches) for r in spark.sql("select host, fetches from fetches").collect()} == {("a.example", 3), ("b.example", 1)}


def test_batches_rewrite_the_buckets_they_touch(spark, tmp_path):
    names = "url_hash string, url string, content_hash string, fetched_at timestamp"
    day = lambda n: dt.datetime(2024, 1, n)
    write, store = merge_into(str(tmp_path), 16), BucketStore(spark, str(tmp_path), 16)
    write(spark.createDataFrame([(f"h{i}", f"u{i}", "a", day(1)) for i in range(60)], names), 0)
    first = store.manifest().folders["pages"]
    one = spark.createDataFrame([("h1", "u1", "b", day(2)), ("h1", "u1", "c", day(3)), ("h2", "u2", "old", dt.datetime(2023, 1, 1))], names)
    for _ in range(2):  # the second time the batch is known
        write(one, 1)
    second = store.manifest()
    assert second.version == 2 and second.counters == {"batch": 1} and 1 <= sum(second.folders["pages"][b] != first[b] for b in first) <= 2
    rows = {r.url_hash: r.content_hash for r in merged_pages(spark, str(tmp_path)).collect()}
    assert len(rows) == 60 and rows["h1"] == "c" and rows["h2"] == "a"


def test_only_small_tables_are_dealt(spark, tmp_path, monkeypatch):
    from pagelens.sources import pages as P

    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t"))
    table = lambda: spark.read.parquet(str(tmp_path / "t"))
    cores = spark.sparkContext.defaultParallelism
    assert P.dealt(table()).rdd.getNumPartitions() == 2 * cores and P.dealt(spark.range(0, 100, 1, cores)).rdd.getNumPartitions() == cores
    monkeypatch.setattr(P, "SMALL_SHARE", 0)
    assert P.dealt(table()).rdd.getNumPartitions() == 1
