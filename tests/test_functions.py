from pyspark.sql import functions as F

from pagelens.functions import numbers, urls
from pagelens.functions import text as T


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_scores_round_half_even_and_clamp(spark):
    values = [0.5, 1.5, 2.5, 24.5, 25.5, -3.0, 120.0, None]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(numbers.score(F.col("v"))).collect()
    assert [r[0] for r in rows] == [0, 2, 2, 24, 26, 0, 100, None]
    bands = spark.createDataFrame([(v,) for v in (10, 24, 25, 44, 45, 64, 65, 84, 85)], "v int").select(numbers.status(F.col("v"))).collect()
    assert [r[0] for r in bands] == ["critical", "critical", "poor", "poor", "fair", "fair", "good", "good", "strong"]


def test_url_rules(spark):
    u = lambda s: F.lit(s)
    row = one(
        spark, a=urls.normalize_url(u(" Example.com ")), b=urls.normalize_url(u("HTTP://A.example/X?q=1#f")), c=urls.normalize_url(u("")), root=urls.scope_root(u("https://www.ecoflow.com/de/products/delta-2")),
        inside=urls.is_internal(u("https://www.ecoflow.com/de/products/delta-2"), u("https://www.ecoflow.com/de/")), outside=urls.is_internal(u("https://www.ecoflow.com/fr/x"), u("https://www.ecoflow.com/de/")),
        home=urls.is_likely_homepage(u("https://a.example/zh-cn/")), page=urls.is_likely_homepage(u("https://a.example/products/widget")), domain=urls.registered_domain(u("https://m.a.co.uk/x")),
        rel=urls.absolute(u("b/c"), u("https://a.example/x/y.html")), up=urls.absolute(u("../c"), u("https://a.example/x/y/z")), private=urls.is_public(u("http://192.168.0.1/")), public=urls.is_public(u("https://a.example/")),
    )
    assert (row.a, row.b, row.c) == ("https://example.com/", "http://a.example/X?q=1", None)
    assert row.root == "https://www.ecoflow.com/de/" and row.inside and not row.outside and row.home and not row.page
    assert row.domain == "a.co.uk" and row.rel == "https://a.example/x/b/c" and row.up == "https://a.example/x/c" and not row.private and row.public
    candidates = one(spark, x=urls.entry_candidates(u("https://idtcpack.com/"))).x
    assert candidates == ["https://idtcpack.com/", "https://www.idtcpack.com/", "http://idtcpack.com/", "http://www.idtcpack.com/"]


def test_dutch_signals(spark):
    text = "Geschreven door Berry Zhang. Bijgewerkt op 12 okt 2025. Wij helpen merken groeien met " + "woord " * 20
    heads = F.array(F.lit("Veelgestelde vragen"), F.lit("Samenvatting"))
    row = one(spark, **T.signals(F.lit(text), heads, F.lit("nl")))
    assert row.has_faq and row.has_author and row.has_publish_date and row.answer_first and row.has_tldr and row.has_update_log
    row = one(spark, **T.signals(F.lit(None).cast("string"), F.array().cast("array<string>"), F.lit(None).cast("string")))
    assert not any(row)


def test_words_with_accents_count_once(spark):
    assert one(spark, n=T.word_count(F.lit("éeaua, l'été ça_va 12"))).n == 5


def test_heading_quality(spark):
    strings = lambda *x: F.array(*map(F.lit, x))
    row = one(spark, good=T.heading_quality(strings("h1", "h2", "h3"), strings("a", "b", "c")), skip=T.heading_quality(strings("h1", "h3", "h3"), strings("a", "b", "b")), none=T.heading_quality(F.array().cast("array<string>"), F.array().cast("array<string>")))
    assert (row.good, row.skip, row.none) == (100, 70, 0)


def test_page_types_by_the_whole_url(spark):
    from pagelens.operators import scores

    rows = [("https://a.example/", "homepage", "homepage"), ("https://a.example/blog/x", "blog", "article"), ("https://a.example/blog/PRODUCT-news", "blog", "product"), ("https://a.example/x?help=1", "page", "faq"), ("https://guide.example/x", "page", "documentation"), ("https://a.example/docs/shop", "docs", "product"), ("https://a.example/a-vs-b", "page", "comparison"), ("https://a.example/about/docs", "about", "about"), ("https://a.example/x", "landing", "page")]
    frame = spark.createDataFrame(rows, "page_url string, url_type string, want string")
    assert [r.got for r in frame.withColumn("got", scores.page_type()).orderBy(*frame.columns).collect()] == [r[2] for r in sorted(rows)]
