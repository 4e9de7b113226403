import datetime as dt

from pyspark.sql import functions as F

from pagelens.operators import page_content, scores, site_audit
from pagelens.sources import structured

HTML = """<html lang="en"><head><meta name="robots" content="NoIndex, follow"><meta property="og:title" content="x"><link rel="canonical" href="/x"><link rel="alternate" hreflang="de-DE" href="/de/"><link rel="stylesheet" href="a.css">
<script src="a.js"></script><script async src="b.js"></script><script>gtag('G-ABCD12')</script></head><body><h1>T</h1><img src="a.png" alt="A" loading="lazy" width="1" height="2"><img src="b.png"><img alt="none">
<a href="/y" rel="nofollow">y</a><a href="https://else.example/" rel="nofollow">z</a><a href="/de/start">Deutsch</a></body></html>"""


def test_page_elements(spark):
    h, base = F.lit(HTML), F.lit("https://a.example/x")
    row = spark.range(1).select(
        site_audit.images(h).alias("images"), site_audit.alt_ratio(site_audit.images(h)).alias("alt"), site_audit.sync_scripts(h).alias("sync"), site_audit.stylesheets(h).alias("css"), site_audit.meta_robots(h).alias("robots"),
        site_audit.analytics(h).alias("analytics"), site_audit.nofollow_internal(h, base).alias("nofollow"), site_audit.hreflang_candidates(h, base, F.lit("de")).alias("hreflang"), site_audit.locale_link_candidates(h, base, F.lit("de")).alias("links"),
    ).first()
    assert len(row.images) == 2 and row.alt == 0.5 and row.sync == 1 and row.css == 1 and row.robots == "noindex, follow" and row.nofollow == 1
    assert row.analytics.ga4 and not row.analytics.gtm and row.hreflang == ["https://a.example/de/"] and row.links == ["https://a.example/de/start"]


def test_technical_audit(spark):
    rows = [("s", "https://a.example/x", HTML, {"ETag": "1", "X-Frame-Options": "DENY"}, 200, True, False, 30)]
    got = site_audit.technical_audit(spark.createDataFrame(rows, "site string, url string, html string, headers map<string,string>, milliseconds int, has_sitemap boolean, robots_has_sitemap boolean, word_count int")).first()
    # 8 https, 5 canonical, 4 lang, 4 h1, 8 sitemap, 5 og, 4 hreflang, 4 etag, 10*.2 rendering, 16*.2 headers, 4*.5 images, 8*.7 blocking, 8 speed
    assert got.technical_score == round(8 + 5 + 4 + 4 + 8 + 5 + 4 + 4 + 2 + 3.2 + 2 + 5.6 + 8) and got.status == "fair"


def test_indexability(spark):
    got = page_content.indexability(spark.createDataFrame([(1, "https://a.example/x", HTML), (2, "https://a.example/", None), (3, "https://a.example/", "<p>don't 漢字 two</p>")], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert got[0].directives == ["follow", "noindex"] and got[0].noindex and got[0].canonical == "https://a.example/x" and got[0].script_count == 3 and got[1].directives == [] and got[2].word_count == 4


def test_structured_data_of_a_site(spark):
    rows = [(1, "s", ['{"@type":"Organization","sameAs":["b","a"]}'], "x"), (2, "s", ['{"@type":"Article","sameAs":["a"],"datePublished":"2024-01-01"}'], "x")]
    pages = spark.createDataFrame(rows, "page_id long, site_id string, json_ld array<string>, text string")
    got = site_audit.site_structured_data(structured.summarize(pages, "page_id").join(pages.select("page_id", "site_id"), "page_id")).first()
    assert got.same_as == ["a", "b"] and got.has_organization and got.has_article and got.dated_pages == 1 and got.relation_count == 2 and got.structured_data_score == 8 + 12 + 9 + 8 + 4 + 3


def test_small_operators(spark):
    row = spark.range(1).select(site_audit.first_bytes(F.lit("aé日本"), 5).alias("cut"), site_audit.first_bytes(F.lit("abc"), 5).alias("all"), site_audit.projected_score(F.lit(50)).alias("p"), site_audit.projected_score(F.lit(95)).alias("q")).first()
    assert (row.cut, row.all, row.p, row.q) == ("aé", "abc", 70, 100)
    key = lambda **o: spark.range(1).select(site_audit.cache_key(F.lit("https://a.example/"), F.lit("t"), F.lit(o.get("mode", "standard")), F.lit(o.get("full", False)), F.lit(o.get("pages", 12)), F.lit("en"), F.lit(None).cast("string"))).first()[0]
    assert key() == key(pages=30) != key(mode="premium") and key(full=True) != key(full=True, pages=30)
    cache = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), 1), ("a", dt.datetime(2024, 1, 3), 2), ("b", dt.datetime(2023, 1, 1), 3)], "key string, saved_at timestamp, v int")
    assert [r.v for r in site_audit.live_results(cache, F.lit("2024-01-05").cast("timestamp")).collect()] == [2]
    rows = spark.createDataFrame([(1, "Yes"), (2, "Found 3 pages"), (3, None)], "id int, note string")
    done = site_audit.localize(rows, "note", spark.createDataFrame([("Yes", "Ja")], "source string, target string"), (("^Found (\\d+) pages$", "$1 Seiten"),))
    assert {r.id: r.note for r in done.collect()} == {1: "Ja", 2: "3 Seiten", 3: None}
    steps = spark.createDataFrame([("t", "completed"), ("t", "completed"), ("t", "running")], "task_id string, status string")
    assert site_audit.progress(steps).first().progress == 66


def test_entries_and_scopes(spark):
    sites = spark.createDataFrame([("s", "a.example")], "site string, url string")
    answers = spark.createDataFrame([("https://a.example/", 500, "https://a.example/"), ("https://www.a.example/", 200, "https://a.example/"), ("http://a.example/", 200, "https://a.example/")], "url string, status int, final_url string")
    assert site_audit.entry_responses(sites, answers).first().url == "https://www.a.example/"
    assert not site_audit.variant_checks(sites, answers).first().hosts_ok
    asked = spark.createDataFrame([("s", "https://a.example/x", HTML, "de"), ("t", "https://a.example/x", HTML, "en"), ("u", "https://a.example/x", "<p>", "fr"), ("v", "https://a.example/x", HTML, "it")], "site string, url string, html string, requested_locale string")
    assert {r.site: (r.rule, r.scope_url) for r in site_audit.target_scope(asked).collect()} == {"s": ("hreflang", "https://a.example/de/"), "t": ("same", "https://a.example/x"), "u": ("path", "https://a.example/fr/"), "v": ("conflict", None)}


def test_bounded_adjustments(spark):
    base = spark.createDataFrame([("a", 50), ("b", 95), ("c", 40)], "site_id string, score int")
    deltas = spark.createDataFrame([("a", "-99"), ("b", "8"), ("c", "n/a")], "site_id string, score_delta string")
    got = {r.site_id: r.score for r in page_content.bounded_adjustments(base, deltas, "site_id", {"score": 10}).collect()}
    assert got == {"a": 40, "b": 100, "c": 40}


def test_core_checks(spark):
    columns = "page_id long, page_url string, title string, answer_first boolean, has_faq boolean, has_faq_page boolean, has_tldr boolean, json_ld_present boolean, chunk_structure_score int, has_quantified_data boolean, information_density_score int, has_reference_section boolean, has_inline_citations boolean"
    rows = [(1, "u", "Pumps | Acme", True, True, True, True, True, 60, True, 60, True, False), (2, "v", "Pumps", False, True, False, False, True, 59, True, 59, False, False), (3, "w", *[None] * 11)]
    got = page_content.core_checks(spark.createDataFrame(rows, columns)).where("passed").groupBy("page_id").agg(F.sort_array(F.collect_list("check_id")).alias("ids")).collect()
    assert {r.page_id: r.ids for r in got} == {1: ["C02", "C09", "O02", "O05", "O06", "R01", "R02", "R04", "R07"], 2: ["O05"]}


def test_json_salvage(spark):
    texts = [' {"a": 1} ', 'Here it is:\n{"a": {"b": 2}}\nDone.', "[1]", "none", "{broken", "} {", "", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", structured.json_salvage(F.col("t")).alias("j")).orderBy("i").collect()
    assert [r.j for r in got] == ['{"a": 1}', '{"a": {"b": 2}}', "[1]", None, None, None, None, None]


def test_observed_sources(spark):
    rows = [("s", 0, "a", 5, 1, None), ("s", 1, "b", 9, 2, 0.5), ("s", 2, "c", 9, 3, None), ("t", 0, "d", None, 1, None), ("t", 1, "e", 0, 0, None)]
    sources = spark.createDataFrame(rows, "site string, pos int, platform string, sessions int, conversions int, conversion_rate double")
    assert [r.conversion_rate for r in scores.with_conversion_rates(sources).orderBy("site", "pos").collect()] == [0.2, 0.5, 0.3333, None, None]
    assert sorted(map(tuple, scores.top_sources(sources, "site").collect())) == [("s", "b", 9), ("t", "d", 0)]
