"""robots.txt per URL against the standard library's parser; registered domains by suffix rules."""

import random
import urllib.robotparser

import pytest
from pyspark.sql import functions as F

from pagelens.functions import suffixes
from pagelens.operators import robots
from pagelens.sources import structured


@pytest.fixture(scope="module")
def bodies():
    rng = random.Random(5)
    agents = ["*", "Googlebot", "google", "GPTBot", "gptbot/2", "Bing", ""]
    paths = ["", "/", "/a", "/a/b", "/a/bc", "/%61", "/é", "/a?x=1", "*", "/b+c", "/zzz"]
    lines = lambda: [rng.choice(["", "# note", "  ", "Sitemap: https://x/s.xml", "no colon", f"User-agent: {rng.choice(agents)}", f"user-agent : {rng.choice(agents)} # x", f"Disallow: {rng.choice(paths)}", f"Disallow:{rng.choice(paths)}", f"ALLOW: {rng.choice(paths)}", "Crawl-delay: 3"]) for _ in range(rng.randint(0, 14))]
    return [(f"s{i}", "\n".join(lines())) for i in range(150)]


URLS = ["https://h.example", "https://h.example/", "https://h.example/a", "https://h.example/a/b/c", "https://h.example/a/bcd", "https://h.example/a?x=1&y=2", "https://h.example/%C3%A9t%C3%A9", "https://h.example/b+c", "https://h.example/%61/b", "https://h.example/other"]


def test_first_match_equals_the_standard_parser(spark, bodies):
    pages = [(i * 1000 + k, site, url) for i, (site, _) in enumerate(bodies) for k, url in enumerate(URLS)]
    frame = spark.createDataFrame(pages, "page_id long, site string, url string").select("page_id", "site", robots.target(F.col("url")).alias("target"))
    table = spark.createDataFrame(bodies, "site string, body string")
    for crawler in ("Googlebot", "GPTBot/1.0"):
        got = {r.page_id: r.allowed for r in robots.first_match(frame, table, crawler).collect()}
        want = {}
        for (site, body), i in zip(bodies, range(len(bodies)), strict=True):
            parser = urllib.robotparser.RobotFileParser()
            parser.parse(body.splitlines())
            want |= {i * 1000 + k: parser.can_fetch(crawler, url) for k, url in enumerate(URLS)}
        assert got == want, crawler
        assert len(set(want.values())) == 2


def test_longest_match(spark):
    rules = spark.createDataFrame([("s", "allow", "/a/b"), ("s", "disallow", "/a"), ("s", "disallow", "/tie"), ("s", "allow", "/tie"), ("t", "disallow", ""), ("u", "disallow", "")] + [("u", "allow", "/x")], "site string, directive string, path string")
    pages = spark.createDataFrame([(1, "s", "/a"), (2, "s", "/a/bc"), (3, "s", "/tie/x"), (4, "s", "/free"), (5, "t", "/any"), (6, "u", "/xy"), (7, "none", "/a"), (8, "u", "/")], "page_id long, site string, target string")
    got = {r.page_id: r.allowed for r in robots.longest_match(pages, rules).collect()}
    assert got == {1: False, 2: True, 3: True, 4: True, 5: False, 6: True, 7: True, 8: False}
    every = spark.createDataFrame([("s", "gptbot", "disallow", "/"), ("s", "*", "allow", "/"), ("t", "*", "disallow", "/")], "site string, agent string, directive string, path string")
    assert sorted((r.site, r.agent) for r in robots.agent_rules(every, "GPTBot").collect()) == [("s", "gptbot"), ("t", "*")]
    none = structured.robots_rules(spark.createDataFrame([("s", None)], "site string, body string"))
    assert robots.longest_match(pages.where("page_id = 1"), robots.agent_rules(none, "GPTBot")).first().allowed


def test_registered_domains(spark):
    want = {
        "a.b.co.uk": ("co.uk", "b.co.uk"), "www.example.com": ("com", "example.com"), "x.github.io": ("io", "github.io"), "city.kawasaki.jp": ("kawasaki.jp", "city.kawasaki.jp"), "deep.city.kawasaki.jp": ("kawasaki.jp", "city.kawasaki.jp"),
        "a.b.kawasaki.jp": ("b.kawasaki.jp", "a.b.kawasaki.jp"), "b.kawasaki.jp": ("b.kawasaki.jp", ""), "kawasaki.jp": ("jp", "kawasaki.jp"), "www.ck": ("ck", "www.ck") , "a.www.ck": ("ck", "www.ck"), "a.b.ck": ("b.ck", "a.b.ck"),
        "co.uk": ("co.uk", ""), "127.0.0.1": ("", "127.0.0.1"), "[::1]": ("", "[::1]"), "localhost": ("", "localhost"), "a.unknown": ("", "unknown"), "WWW.Example.COM.": ("com", "example.com"), "com": ("com", ""),
    }
    hosts = spark.createDataFrame([(h,) for h in [*want, *want]] + [(None,)], "host string")
    rules = suffixes.common_rules(spark).unionByName(spark.createDataFrame([("ck",)], "rule string"))
    assert {r.host: (r.suffix, r.registered_domain) for r in suffixes.registered_domains(hosts, rules).collect()} == want
    private = suffixes.registered_domains(spark.createDataFrame([("x.github.io",), ("github.io",)], "host string"), suffixes.common_rules(spark, private=True)).collect()
    assert {(r.host, r.registered_domain) for r in private} == {("x.github.io", "x.github.io"), ("github.io", "")}


def test_robots_verdicts_of_small_bodies(spark):
    bodies = [("empty", ""), ("closed", "User-agent: *\nDisallow: /"), ("tie", "User-agent: *\nDisallow: /\nAllow: /"), ("blank", "User-agent: *\nDisallow:"), ("shared", "User-agent: gptbot\nUser-agent: claudebot\nDisallow: / # all\nSitemap: https://a.example/s.xml"), ("own", "User-agent: *\nDisallow: /\nUser-agent: GPTBot\nAllow: /")]
    got = {(r.site, r.crawler): (r.matched_agent, r.allowed) for r in structured.robots_verdicts(spark.createDataFrame(bodies, "site string, body string"), ("GPTBot", "Bingbot")).collect()}
    assert got["empty", "GPTBot"] == ("*", True) and got["closed", "Bingbot"] == ("*", False) and got["tie", "GPTBot"] == ("*", True) and got["blank", "GPTBot"] == ("*", False)
    assert got["shared", "GPTBot"] == ("gptbot", False) and got["shared", "Bingbot"] == ("*", True) and got["own", "GPTBot"] == ("gptbot", True) and got["own", "Bingbot"] == ("*", False)


def walk(files, starts, most_indexes, most_urls):
    """The walk of one site, file by file."""
    import xml.etree.ElementTree as ET
    from collections import deque

    pending, visited, found, indexes = deque(dict.fromkeys(starts)), set(), [], 0
    while pending and len(found) < most_urls:
        url = pending.popleft()
        if url in visited:
            continue
        visited.add(url)
        if url not in files:
            continue
        try:
            root = ET.fromstring(files[url])
        except ET.ParseError:
            continue
        locations = [x.text for x in root.iter() if x.tag == "loc" and x.text]
        if root.tag == "urlset":
            found += [u for u in dict.fromkeys(locations) if u not in found]
        elif locations and indexes < most_indexes:
            indexes += 1
            pending += [u for u in locations if u not in visited]
    return found[:most_urls]


def test_sitemap_walk_equals_a_queue(spark):
    rng = random.Random(9)
    files, starts, want = [], [], {}
    for site in (f"s{i}" for i in range(25)):
        own, names = {}, [f"f{i}" for i in range(12)]
        for name in names:
            if rng.random() < 0.85:
                locs = rng.choices(names, k=rng.randint(0, 5)) if (index := rng.random() < 0.6) else [f"u{rng.randrange(30)}" for _ in range(rng.randint(0, 9))]
                tag = "sitemapindex" if index else "urlset"
                own[name] = "<broken" if rng.random() < 0.1 else f"<{tag}>" + "".join(f"<x><loc>{u}</loc></x>" for u in locs) + f"</{tag}>"
        first = rng.choices(names, k=3)
        files += [(site, url, xml) for url, xml in own.items()]
        starts += [(site, url, i) for i, url in enumerate(first)]
        if expected := walk(own, first, 4, 7):
            want[site] = expected
    frame, begin = spark.createDataFrame(files, "site string, url string, xml string"), spark.createDataFrame(starts, "site string, url string, ord int")
    got = {}
    for r in sorted(structured.sitemap_urls(frame, begin, 4, 7).collect()):
        got.setdefault(r.site, []).append(r.page)
    assert got == want and len(want) > 8


def test_backlink_payloads(spark):
    rows = [
        (1, "ascore;backlinks_num;domains_num;ips_num;ipclass_c_num;follows_num;nofollows_num\n42;1200;88;66;40;720;480"), (2, '{"ascore": "10", "follows_num": "n/a"}'), (3, '"domains_num",ascore\r\n"1,234", 7 '), (4, ""), (5, None), (6, "ascore"),
        (7, 'ascore;domains_num\n"3";"4;5"'),
    ]
    got = {r.id: r.b for r in spark.createDataFrame(rows, "id int, body string").select("id", structured.backlinks(F.col("body")).alias("b")).collect()}
    assert (got[1].ascore, got[1].backlinks_num, got[1].follow_ratio) == (42, 1200, 0.6) and (got[2].ascore, got[2].backlinks_num, got[2].follow_ratio) == (10, None, None)
    assert (got[3].ascore, got[3].domains_num) == (7, 1234) and got[4].ascore is None and got[6].ascore is None and (got[7].ascore, got[7].domains_num) == (3, None)


def test_json_ld_of_small_blocks(spark):
    rows = [
        (1, ['{"@type":"Corporation","@id":"https://example.com/#org"}'], "Example"), (2, ['{"@type":"Article","headline":"Battery backup overview","description":"Battery backup overview","datePublished":"2025-01-10"}'], "Battery backup overview. Last updated."),
        (3, ["not-json", '{"@type":["https://schema.org/ProductModel","http://schema.org/Offer"]}'], ""), (4, ['{"@graph":[{"@type":"Organization","brand":{}}]}'], "x"), (5, ["not-json"], "x"),
    ]
    out = {r.id: r for r in structured.summarize(spark.createDataFrame(rows, "id int, json_ld array<string>, text string"), "id").collect()}
    assert [out[i].json_ld_present for i in range(1, 6)] == [True] * 4 + [False] and out[1].has_organization and out[2].has_article and out[3].has_product
    assert [out[i].visible_alignment_score for i in range(1, 6)] == [50, 100, 50, 50, 0] and out[4].relation_count == 2
