"""The tree reader on markup as it is found."""

import time

import pytest
from pyspark.sql import functions as F

from pagelens.functions import urls
from pagelens.sources import html_tree


def read(page, url="https://h.example/d/p", prefix="/"):
    return html_tree.read_page(page, url, "h.example", prefix)


def test_whole_page():
    page = """<!DOCTYPE html><HTML LANG=" de-AT "><head><title>A &amp; B &rarr; &#x43;</title><meta NAME='Description' content=' &quot;Text&quot; '><meta name=description content=second>
    <meta name=viewport content="width=1"><meta property="og:title" content=T><meta property="og:title" content=T2><meta property="og:empty" content=""><meta name="twitter:card" content='s'>
    <link rel="nofollow Canonical" href=" /c "><link rel=stylesheet href="/s.css" media=print><link rel="alternate" hreflang="fr" href="/fr"><script async src=/a.js></script><script type="application/ld+json"> {"a":"</p>"} </script><style>p{}</style></head>
    <body><!-- <h1>no</h1> --><h1>One <b>bold</b></h1><h2> </h2><h3>Three</h3><a href="/x#f">X <img src="i.png" alt="" loading=lazy></a><a href="/x#f">again</a><a href="mailto:a@b.c">mail</a><a name=n>no link</a><a href="/https://o.example/y"></a><a href="https://h.example:8/z">port</a>tail</body></html>"""
    got = read(page)
    assert (got["title"], got["lang"], got["meta_description"], got["canonical"], got["viewport"], got["h1"]) == ("A & B → C", "de-AT", '"Text"', "/c", "width=1", "One bold")
    assert got["headings"] == [{"level": "h1", "text": "One bold"}, {"level": "h3", "text": "Three"}] and got["hreflang"] == ["fr"]
    assert got["open_graph"] == {"og:title": "T2"} and got["twitter_cards"] == {"twitter:card": "s"}
    assert got["internal_links"] == [{"url": "https://h.example/x#f", "text": "X"}, {"url": "https://h.example:8/z", "text": "port"}]
    assert got["external_links"] == [{"url": "mailto:a@b.c", "text": "mail"}, {"url": "https://o.example/y", "text": None}]
    assert got["images"] == [{"src": "https://h.example/d/i.png", "alt": "", "loading": "lazy", "width": None, "height": None}]
    assert [(s["src"], s["is_inline"], s["async_attr"]) for s in got["scripts"]] == [("https://h.example/a.js", False, True), (None, True, False)] and got["json_ld_blocks"] == ['{"a":"</p>"}']
    assert got["stylesheets"] == [{"href": "https://h.example/s.css", "media": "print"}] and got["html_length"] == len(page)
    assert got["text_content"] == "A & B → C One bold Three X again mail no link port tail"


def test_broken_markup():
    links = lambda page: [(x["url"][17:], x["text"]) for x in read(page)["internal_links"]]
    heads = lambda page: [(h["level"], h["text"]) for h in read(page)["headings"]]
    assert links("<a href=/a>one<a href=/b>two<p>more</a>") == [("/a", "one"), ("/b", "two more")]
    assert links("<ul><li><a href=/a>one<li><a href=/b>two</ul>after") == [("/a", "one"), ("/b", "two")]
    assert links("<table><tr><td><a href=/a>x</b></i></td><td>y</table>") == [("/a", "x")]
    assert heads("<h1>One<h2>Two</h2>three") == [("h1", "One"), ("h2", "Two")] and heads("<h1>no end <b>here") == [("h1", "no end here")]
    assert heads("<h2>a</h3>b</h2>") == [("h2", "a b")] and heads("<p>x<h2>y<p>z</h2>") == [("h2", "y z")]
    assert heads("<div><h1>a</div>b") == [("h1", "a")] and heads("<h1><div>a</h1>b</div></h1>") == [("h1", "a b")]  # a div is stronger than the heading's end
    assert read("<title>a <b>c")["title"] == "a c" and read("a < b > c <")["text_content"].startswith("a < b") and read("<script>x")["text_content"] == ""
    assert read('<a href="x"title=y>t</a><p class=">">u')["text_content"] == "t u" and read(None)["text_content"] == "" and read("")["h1"] is None
    assert read("<a href='http://[bad'>x</a>")["external_links"] == [{"url": "http://[bad", "text": "x"}]
    scoped = read("<a href=/de>r</a><a href=/de/x>i</a><a href=/dex>o</a>", prefix="/de/")
    assert [x["url"][17:] for x in scoped["internal_links"]] == ["/de", "/de/x"] and len(scoped["external_links"]) == 1


@pytest.mark.parametrize("piece", ["<a href=/x>y", "<h1>x", "<b><h2>x", "<div><b>x", "</b>x", "<p><i>x", "<!--", "<", "<a ", "<td>x</tr>", "<a href=/x>y</a>", '<div class="', "&amp"])
def test_linear_time(piece):
    took = []
    for n in (4_000, 32_000):
        began = time.process_time()
        read(piece * n)
        took.append(time.process_time() - began)
    assert took[1] < 8 * 3 * max(took[0], 0.05)


def test_column(spark):
    rows = spark.createDataFrame([(1, "https://a.example/de/x", "<h1>T</h1><a href=/de>r</a>"), (2, None, None), (3, "https://b.example/", "<a href='y'>z</a>")], "page_id long, url string, html string")
    base = F.col("page_url")
    pages = rows.withColumn("page_url", urls.normalize_url(F.col("url"))).withColumns({"host": urls.host(base), "prefix": urls.scope_prefix(base), "tree_": F.lit("x")})
    got = {r.page_id: r.tree for r in html_tree.with_tree(pages).collect()}
    assert got[1].h1 == "T" and got[1].internal_links[0].url == "https://a.example/de" and got[2].html_length == 0 and got[2].open_graph == {} and got[3].internal_links[0].url == "https://b.example/y"
