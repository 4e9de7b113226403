"""A page's elements by one pass of a tokenizer and a stack of open elements, for markup as it is found.

Patterns (sources.pages) read what is well formed; here missing, crossed and nested end
tags are repaired by rules: a start tag may end what cannot hold it, an end tag ends
what stands open above its element unless that is stronger.  References that end in ; are decoded by the whole
table.  Time and memory are linear in the page: a text goes to at most one open
heading, anchor and title, and elements are counted by name.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from html.entities import html5
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINK, HEADING = "struct<url:string,text:string>", "struct<level:string,text:string>"
PAGE = f"""title string, meta_description string, canonical string, lang string, viewport string, h1 string, headings array<{HEADING}>, hreflang array<string>, internal_links array<{LINK}>, external_links array<{LINK}>,
 images array<struct<src:string,alt:string,loading:string,width:string,height:string>>, scripts array<struct<src:string,is_inline:boolean,async_attr:boolean,defer_attr:boolean,type:string>>, stylesheets array<struct<href:string,media:string>>,
 json_ld_blocks array<string>, open_graph map<string,string>, twitter_cards map<string,string>, html_length int, text_content string"""

# Elements without content; what a start tag ends; how strong an open element is against an end tag (100 if not named).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS = {"a": {"a"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}, **{h: HEADINGS | {"p"} for h in HEADINGS}}
HOLDS = frozenset("ul ol dl menu table select body".split())
STRENGTH = {"div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180, "table": 190, "head": 200, "body": 200, "html": 220}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style)\b((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>(.*?)(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-z][a-z0-9:-]*+)([^>]*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]++)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]++)))?")


#: What may stand after the last > of a page: a comment or declaration that never ends.
UNENDED = re.compile(r"<!--.*\Z|<[!?/][^>]*+\Z", re.S)


def next_token(page: str, at: int, last: int, token: re.Pattern = TOKEN) -> re.Match | None:
    """The first token from a place on; last: where the page's last > is.  Beyond it no tag can end, so none is looked for there: time stays linear."""
    at = page.find("<", at)
    while 0 <= at <= last:
        if m := token.match(page, at):
            return m
        at = page.find("<", at + 1)
    return UNENDED.search(page, at) if at >= 0 else None


REFERENCE = re.compile(r"&(?:#(?:[0-9]+|[xX][0-9a-fA-F]+);?|[A-Za-z][A-Za-z0-9]*;)")


def unescaped(text: str) -> str:
    """Character references decoded: numbers, and names that a ; ends; a name cut off before it stays text."""
    return REFERENCE.sub(lambda m: html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0], text) if "&" in text else text


def attributes(text: str) -> dict[str, str]:
    """Names in lower case and decoded values; of a repeated name the first counts."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), unescaped(next((v for v in m.groups()[1:] if v is not None), "")))
    return out


class Reader:
    """Collects the parts of a page while its tokens pass."""

    def __init__(self, base: str):
        self.base, self.stack, self.open = base, [], Counter()
        self.texts: list[str] = []
        self.title: list[str] | None = None
        self.titled = False
        self.heading: tuple[str, list[str]] | None = None
        self.anchor: tuple[str, list[str]] | None = None
        self.links: list[tuple[str, str | None]] = []
        self.headings: list[dict] = []
        self.first_h1: list[str | None] = []
        self.found: dict = {k: [] for k in ("hreflang", "images", "scripts", "stylesheets", "json_ld_blocks")} | dict.fromkeys(("title", "meta_description", "canonical", "lang", "viewport")) | {"open_graph": {}, "twitter_cards": {}}

    def text(self, raw: str) -> None:
        plain = unescaped(raw).strip()
        if plain:
            self.texts.append(plain)
            for part in (self.title, self.heading and self.heading[1], self.anchor and self.anchor[1]):
                if part is not None:
                    part.append(plain)

    def end(self, tag: str) -> None:
        """The element closes: what it collected is complete."""
        if tag == "title" and self.title is not None:
            self.found["title"], self.title = " ".join(self.title) or None, None
        elif self.heading and tag == self.heading[0]:
            text = " ".join(self.heading[1])
            if tag == "h1":
                self.first_h1.append(text or None)
            if text:
                self.headings.append({"level": tag, "text": text})
            self.heading = None
        elif tag == "a" and self.anchor:
            self.links.append((self.anchor[0], " ".join(self.anchor[1]) or None))
            self.anchor = None

    def pop(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag = self.stack.pop()
            self.open[tag] -= 1
            self.end(tag)

    def start(self, tag: str, given: dict[str, str]) -> None:
        ended = ENDS.get(tag, set()) | ({"p"} if tag in BLOCKS else set())
        if any(self.open[t] for t in ended):
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i] in ended:
                    self.pop(i)
                    if not any(self.open[t] for t in ended):
                        break
                elif self.stack[i] in HOLDS and tag != "a":
                    break
        if tag not in VOID:
            self.stack.append(tag)
            self.open[tag] += 1
        self.element(tag, given)

    def close(self, tag: str) -> None:
        if self.open[tag]:
            strength = STRENGTH.get(tag, 100)
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i] == tag:
                    return self.pop(i)
                if STRENGTH.get(self.stack[i], 100) > strength:
                    return None
        return None

    def element(self, tag: str, given: dict[str, str]) -> None:
        found, value = self.found, lambda name: given.get(name, "").strip()
        if tag == "title" and not self.titled:
            self.title, self.titled = [], True
        elif tag in HEADINGS:
            self.heading = (tag, [])
        elif tag == "a" and "href" in given:
            self.anchor = (urljoined(self.base, given["href"]), [])
        elif tag == "html" and found["lang"] is None:
            found["lang"] = value("lang") or None
        elif tag == "meta":
            name, prop, content = value("name"), given.get("property", ""), value("content")
            for field, wanted in (("meta_description", "description"), ("viewport", "viewport")):
                if name.lower() == wanted and content and found[field] is None:
                    found[field] = content
            if content and prop.startswith("og:"):
                found["open_graph"][prop] = content
            if content and given.get("name", "").startswith("twitter:"):
                found["twitter_cards"][given["name"]] = content
        elif tag == "link":
            rel = given.get("rel", "").lower().split()
            if "canonical" in rel and found["canonical"] is None:
                found["canonical"] = value("href") or None
            if "stylesheet" in rel and "href" in given:
                found["stylesheets"].append({"href": urljoined(self.base, given["href"]), "media": given.get("media")})
            if "alternate" in rel and value("hreflang"):
                found["hreflang"].append(value("hreflang"))
        elif tag == "img" and "src" in given:
            found["images"].append({"src": urljoined(self.base, given["src"]), **{n: given.get(n) for n in ("alt", "loading", "width", "height")}})

    def script(self, given: dict[str, str], body: str) -> None:
        src = given.get("src")
        self.found["scripts"].append({"src": urljoined(self.base, src) if src else None, "is_inline": not src, "async_attr": "async" in given, "defer_attr": "defer" in given, "type": given.get("type")})
        if given.get("type") == "application/ld+json" and body.strip():
            self.found["json_ld_blocks"].append(body.strip())


def urljoined(base: str, href: str) -> str:
    """An absolute URL; one that stands behind a single / counts as it is."""
    href = href.strip()
    href = href.lstrip("/") if href.startswith(("/http://", "/https://")) else href
    try:
        return urljoin(base, href)
    except ValueError:
        return href


def inside(url: str, host: str, prefix: str) -> bool:
    """Same host, and under the scope's path if it has one."""
    try:
        parts = urlsplit(url)
    except ValueError:
        return False
    path = parts.path.lower() if parts.path.endswith("/") else f"{parts.path.lower()}/"
    return parts.scheme in ("http", "https") and parts.netloc.lower().rpartition("@")[2].partition(":")[0] == host and (prefix == "/" or path.startswith(prefix))


def read_page(page: str | None, base: str | None, host: str | None, prefix: str | None) -> dict:
    """All that PAGE names, of one page; a null page is an empty one."""
    page, reader, at = page or "", Reader(base or ""), 0
    last = page.rfind(">")
    while m := next_token(page, at, last):
        if m.start() > at:
            reader.text(page[at : m.start()])
        at = m.end()
        if m.re is UNENDED:
            continue
        if m[1]:
            if m[1].lower() == "script":
                reader.script(attributes(m[2]), m[3])
        elif tag := (m[5] or m[8] or "").lower():
            if m[4] or m[7]:
                reader.close(tag)
            else:
                reader.start(tag, attributes(m[6] if m[5] else m[9]))
    reader.text(page[at:])
    reader.pop(0)
    first: dict[str, str | None] = {}
    for url, text in reader.links:
        first.setdefault(url, text)
    sides: tuple[list, list] = ([], [])
    for url, text in first.items():
        sides[not inside(url, host or "", prefix or "/")].append({"url": url, "text": text})
    return reader.found | {"h1": next(iter(reader.first_h1), None), "headings": reader.headings, "internal_links": sides[0], "external_links": sides[1], "html_length": len(page), "text_content": " ".join(reader.texts)}


COLUMNS = [c.strip().split(" ")[0] for c in re.split(r",(?![^<]*>)", PAGE.replace("\n", " "))]


def with_tree(pages: DataFrame) -> DataFrame:
    """pages with page_url, html, host and prefix (the scope's path) -> the same rows with a struct ``tree`` of the columns of PAGE.

    Anchors stand for their URL's first; of headings and links without end tag the text ends where the
    next of their kind begins.  Links of other schemes are external.  Null html is an empty page, null URLs resolve nothing.
    """

    def read(html_: pd.Series, base: pd.Series, host: pd.Series, prefix: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_page(*row) for row in zip(html_, base, host, prefix, strict=True)], columns=COLUMNS)

    return pages.withColumn("tree", F.pandas_udf(read, PAGE)("html", "page_url", "host", "prefix"))
