"""From a page's html to its sequence of leaf blocks: text, tag path and share of linked text."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

from pagelens.sources.html_tree import next_token

# Elements that break a line of text, that have no content, whose content is never text, and that close an open one of their kind.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table div section article aside nav form main header footer blockquote".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style)\b[^>]*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-z][a-z0-9:-]*+)([^>]*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
# Elements left out with all they hold up to their end tag, paragraphs of a fallback too; without an end tag, or if closed in their own tag, only the tag is left out.
ENDS = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("svg", "object", "canvas", "title", "noscript", "template", "textarea", "iframe", "select")}
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PARTS = re.compile(r"[A-Za-z][a-z]+|[A-Z]+|[a-z]")
#: A block's path has the innermost elements that are open, and the first words of each.
DEPTH = 64
WORDS = 24


@dataclass
class Block:
    text: str
    path: tuple[str, ...]  # tags and the words of their class, id and role, outermost first
    linked: int  # code points inside links


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    words = [w.lower() for m in NAMED.finditer(attributes) for w in PARTS.findall(m[1] or m[2] or m[3] or "")][:WORDS]
    return (tag, *(f".{w}" for w in words))


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page in order; white space inside each is one space; blocks without text are left out.

    Time and memory are linear in the page: open elements are counted by name, and a path has at most DEPTH elements.
    """
    page = page or ""
    found: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[tuple[str, bool]] = []
    is_open, endless = Counter(), set()

    def flush() -> None:
        text = " ".join(html.unescape("".join(t for t, _ in held)).split())
        if text:
            linked = len(" ".join(html.unescape("".join(t for t, inside in held if inside)).split()))
            found.append(Block(text, tuple(w for _, names in stack[-DEPTH:] for w in names), linked))
        held.clear()

    def close(depth: int) -> None:
        is_open.subtract(name for name, _ in stack[depth:])
        del stack[depth:]

    at, last = 0, page.rfind(">")
    while m := next_token(page, at, last, TOKEN):
        if m.start() > at:
            held.append((page[at : m.start()], is_open["a"] > 0))
        at = m.end()
        if m.re is not TOKEN:
            continue
        tag = m[3] or m[6]
        if m[1]:
            held.append((" ", False))
        if not tag:
            continue
        tag, closing = tag.lower(), (m[2] or m[5]) == "/"
        if tag in ENDS and not closing:
            held.append((" ", False))
            if tag not in endless and not m[0].endswith("/>"):
                end = ENDS[tag].search(page, at)
                at = end.end() if end else at
                endless |= set() if end else {tag}
            continue
        if tag in BLOCK_TAGS:
            flush()
        elif tag == "br":
            held.append((" ", False))
        if closing:
            if is_open[tag]:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
        elif tag not in VOID_TAGS:
            if tag in BLOCK_TAGS and tag not in ("html", "body"):
                ends = CLOSES.get(tag, set()) | {"p"}
                for i in range(len(stack) - 1, -1, -1) if any(is_open[t] for t in ends) else ():
                    if stack[i][0] in ends:
                        close(i)
                    elif stack[i][0] in SCOPES:
                        break
            stack.append((tag, _names(tag, m[4] or m[7] or "")))
            is_open[tag] += 1
    held.append((page[at:], is_open["a"] > 0))
    flush()
    return found
