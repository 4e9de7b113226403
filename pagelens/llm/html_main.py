"""Main text by a recurrent block labeller.

A page is the sequence of its leaf blocks.  Each block is a vector of hashed tag-path
words, hashed text words and a few measures; a bidirectional LSTM in numpy reads the
whole sequence and labels every block as main text or not, so a block is judged with
the page around it.  The model is trained here, from a seed, on pages generated with
known labels (see `training_page`); nothing is read to train it.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.html_blocks import Block, blocks

PATH_CELLS, WORD_CELLS, MEASURES = 256, 32, 8
WIDTH = PATH_CELLS + WORD_CELLS + MEASURES
HIDDEN = 16
TRAINING_PAGES, EPOCHS, SEED = 1300, 16, 7
PAGES = 128  # labelled at a time


# -- features ---------------------------------------------------------------


@lru_cache(1 << 16)
def _cell(word: str, cells: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % cells


@lru_cache(1 << 14)
def _path_cells(path: tuple[str, ...]) -> np.ndarray:
    leaf = f"leaf:{path[-1]}" if path else "leaf:"
    return np.unique([_cell(w, PATH_CELLS) for w in (*path, leaf)])


def features(page: list[Block]) -> np.ndarray:
    """One row of WIDTH numbers per block; a block's text counts whole."""
    x = np.zeros((len(page), WIDTH), np.float32)
    for i, b in enumerate(page):
        x[i, _path_cells(b.path)] = 1
        words = b.text.split(" ")
        counts = np.bincount([PATH_CELLS + zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORD_CELLS for w in words], minlength=PATH_CELLS + WORD_CELLS)[PATH_CELLS:]
        x[i, PATH_CELLS : PATH_CELLS + WORD_CELLS] = counts / len(words)
        n = len(b.text)
        x[i, -MEASURES:] = (min(np.log1p(n) / 8, 2), min(np.log1p(len(words)) / 6, 2), b.linked / n, b.text[-1] in ".!?…\"”", "©" in b.text, sum(map(str.isdigit, b.text)) / n, i / max(len(page) - 1, 1), min(len(page), 100) / 100)
    return x


# -- bidirectional LSTM ------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def new_model(rng: np.random.Generator) -> dict[str, np.ndarray]:
    model = {}
    for side in ("f", "b"):
        model |= {f"x{side}": rng.normal(0, 0.1, (WIDTH, 4 * HIDDEN)), f"h{side}": rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)), f"c{side}": np.zeros(4 * HIDDEN)}
        model[f"c{side}"][HIDDEN : 2 * HIDDEN] = 1  # remember at first
    model |= {"out": rng.normal(0, 0.3, 2 * HIDDEN), "skip": np.zeros(WIDTH), "bias": np.zeros(1)}
    return {k: v.astype(np.float32) for k, v in model.items()}


def _run(model: dict[str, np.ndarray], side: str, x: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states of one direction over x (pages, steps, WIDTH); masked steps change nothing."""
    pages, steps, _ = x.shape
    pre = x @ model[f"x{side}"] + model[f"c{side}"]
    h, c, kept = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32), []
    out = np.zeros((pages, steps, HIDDEN), np.float32)
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        z = pre[:, t] + h @ model[f"h{side}"]
        i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g, on = np.tanh(z[:, 3 * HIDDEN :]), mask[:, t, None]
        c_new = f * c + i * g
        squashed = np.tanh(c_new)
        if keep:
            kept.append((t, h, c, i, f, o, g, squashed, on))
        h, c = on * (o * squashed) + (1 - on) * h, on * c_new + (1 - on) * c
        out[:, t] = h
    return out, kept


def probabilities(model: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    both = np.concatenate([_run(model, side, x, mask, False)[0] for side in ("f", "b")], axis=2)
    return _sigmoid(both @ model["out"] + x @ model["skip"] + model["bias"])


def _gradients(model: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    states, kept = zip(*(_run(model, side, x, mask, True) for side in ("f", "b")))
    both = np.concatenate(states, axis=2)
    error = (_sigmoid(both @ model["out"] + x @ model["skip"] + model["bias"]) - y) * mask / mask.sum()
    grad = {"out": np.einsum("pt,pth->h", error, both), "skip": np.einsum("pt,ptw->w", error, x), "bias": np.array([error.sum()])}
    for n, side in enumerate(("f", "b")):
        down = error[:, :, None] * model["out"][n * HIDDEN : (n + 1) * HIDDEN]
        dz = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
        dh, dc, g_h = np.zeros((len(x), HIDDEN), np.float32), np.zeros((len(x), HIDDEN), np.float32), np.zeros_like(model[f"h{side}"])
        for t, h, c, i, f, o, g, squashed, on in reversed(kept[n]):
            dh = dh + down[:, t]
            live, live_c = dh * on, dc * on
            live_c = live_c + live * o * (1 - squashed**2)
            dz[:, t] = np.concatenate([live_c * g * i * (1 - i), live_c * c * f * (1 - f), live * squashed * o * (1 - o), live_c * i * (1 - g**2)], axis=1)
            g_h += h.T @ dz[:, t]
            dh, dc = dh * (1 - on) + dz[:, t] @ model[f"h{side}"].T, dc * (1 - on) + live_c * f
        grad |= {f"x{side}": np.einsum("ptw,ptz->wz", x, dz, optimize=True), f"h{side}": g_h, f"c{side}": dz.sum(axis=(0, 1))}
    return grad


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((len(pages), steps, WIDTH), np.float32), np.zeros((len(pages), steps), np.float32)
    for i, p in enumerate(pages):
        x[i, : len(p)], mask[i, : len(p)] = p, 1
    return x, mask


# -- training pages ------------------------------------------------------------

# Names that sites give to the parts of a page.
MAIN_NAMES = "content post entry story article body text main page blog news".split()
OTHER_NAMES = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs toolbar tabs pagination pager topbar".split(),
    "header": "header masthead logo branding banner top hero".split(),
    "footer": "footer bottom copyright legal credits colophon".split(),
    "aside": "sidebar aside widget rail related recommended popular trending archive tags tagcloud toc".split(),
    "ad": "ad ads advert advertisement adsbygoogle sponsored sponsor promo promotion banner".split(),
    "notice": "cookie cookies consent notice alert popup modal overlay gdpr paywall newsletter subscribe signup message".split(),
    "share": "share social sharing follow buttons meta byline tools print".split(),
    "form": "form search login register contact subscribe feedback".split(),
    "comments": "comments comment commentlist reply replies respond disqus discussion responses reader thread".split(),
}
PLAIN_NAMES = "wrap wrapper container inner outer row col grid box block left right center site layout section item module".split()
SHORT = "Home|About us|Contact|Log in|Sign up|Read more|Share|Tweet|Subscribe|Next page|Previous|Search|Privacy policy|Terms of use|All rights reserved|Advertisement|Related articles|Menu|Follow us|Accept all cookies|Reply|Leave a comment|Newsletter|Sitemap|Careers".split("|")
MARK = "\x01"  # begins main text in a training page


def training_page(rng: random.Random) -> str:
    """A page with main text marked: parts before, inside and after the article, named the way sites name them or not at all."""
    syllables = rng.choice(("th er an in on re at en nd ou", "le de ré en ou eau que tion", "der sch ein ung keit lich ver", "os as ción ment ado que ie"))
    syllables = syllables.split()

    def word() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.choice((1, 1, 2, 2, 3))))

    def prose(low: int, high: int) -> str:
        words = [word() for _ in range(rng.randint(low, high))]
        words[0] = words[0].capitalize()
        return " ".join(w + rng.choice(("", "", "", "", ",", ".", " &amp;")) for w in words) + rng.choice((".", ".", ".", "", "!"))

    def inline(text: str) -> str:
        kind = rng.random()
        return f"<b>{text}" + rng.choice(("", "<br>", "</b>")) if kind < 0.1 else f'{text} <a href="/x">{word()}</a> {prose(1, 5)}' if kind < 0.2 else f"<em>{word()}</em> {text}" if kind < 0.25 else text

    def named(kind: str | None) -> str:
        names = OTHER_NAMES[kind] if kind in OTHER_NAMES else MAIN_NAMES if kind == "main" else PLAIN_NAMES
        name = rng.choice(names)
        if rng.random() < 0.3:
            name = rng.choice((f"{name}-{rng.choice(PLAIN_NAMES)}", f"{rng.choice(PLAIN_NAMES)}_{name}", f"{name} {word()}"))
        return f' {rng.choice(("class", "class", "id"))}="{name}"'

    def links() -> str:
        items = [f'<a href="/{word()}">{rng.choice(SHORT) if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randint(1, 4)))}</a>' for _ in range(rng.randint(2, 8))]
        return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if rng.random() < 0.7 else rng.choice((" | ", " ", "<br>")).join(items)

    def other(kind: str) -> str:
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": "section"}.get(kind, "div")
        if rng.random() < 0.5:
            tag = rng.choice(("div", "div", "section", "ul" if kind in ("nav", "share") else "div"))
        bare = tag in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.5
        if kind == "nav":
            body = links()
        elif kind == "header" and rng.random() < 0.3:
            body = f"<h{(n := rng.choice('112'))}>{prose(1, 5)}</h{n}>" + f"<p>{prose(2, 12)}</p>" * (rng.random() < 0.6)
        elif kind == "header":
            body = f"<div>{prose(1, 4)}</div>" + (links() if rng.random() < 0.5 else "") if rng.random() < 0.7 else prose(1, 6)
        elif kind == "footer":
            body = rng.choice((f"&copy; {word()}.example.com &middot; {prose(3, 25)}", f"<p>&copy; 2024 {word()}</p>{links()}", f"<p>{prose(4, 30)}</p>", links()))
        elif kind == "aside":
            body = f"<h3>{rng.choice(SHORT)}</h3>" * (rng.random() < 0.5) + rng.choice((links(), f"<p>{prose(5, 40)}</p>", f"<div>{prose(3, 20)}</div>{links()}"))
        elif kind == "form":
            body = f"<label>{prose(1, 4)}</label><input><p>{prose(2, 12)}</p><button>{rng.choice(SHORT)}</button>"
        elif kind == "comments":
            each = [f"<p>{prose(3, 60)}</p>" if rng.random() < 0.5 else f'<div{named("comments")}><b>{word()}</b><p>{prose(3, 60)}</p></div>' for _ in range(rng.randint(1, 5))]
            body = f"<h3>{rng.choice(SHORT)}</h3>" * (rng.random() < 0.5) + "".join(each)
        else:
            body = rng.choice((prose(3, 30), f"<p>{prose(3, 30)}</p>", f"{rng.choice(SHORT)} <a href='/x'>{word()}</a>", f"<span>{prose(1, 8)}</span><button>{rng.choice(SHORT)}</button>"))
        return f"<{tag}{'' if bare else named(kind)}>{body}</{tag}>"

    def main_block() -> str:
        kind = rng.random()
        if kind < 0.68:
            return f"<p>{MARK}{inline(prose(1, rng.choice((2, 12, 60, 150))))}" + ("</p>" if rng.random() < 0.85 else "")
        if kind < 0.8:
            tag = rng.choice(("h2", "h2", "h3", "h4"))
            return f"<{tag}>{MARK}{prose(1, 9)}</{tag}>"
        if kind < 0.88:
            return "<ul>" + "".join(f"<li>{MARK}{prose(1, 25)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if kind < 0.93:
            return f"<blockquote>{MARK}{prose(5, 50)}</blockquote>"
        if kind < 0.96:
            return f"<pre>{MARK}{prose(3, 20)}</pre>"
        return "<table>" + "".join(f"<tr><td>{MARK}{prose(1, 5)}</td><td>{MARK}{prose(1, 5)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>"

    inside = [f"<h1>{MARK}{prose(2, 14)}</h1>"] * (rng.random() < 0.85) + [main_block() for _ in range(rng.choice((1, 2, 3, 5, 8, 14)))]
    for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
        inside.insert(rng.randint(1, len(inside)), other(rng.choice(("ad", "share", "aside", "notice", "form", "nav"))))
    if rng.random() < 0.4:
        inside.insert(rng.randint(2, len(inside)) if len(inside) > 2 and rng.random() < 0.3 else len(inside), other("comments"))
    tag = rng.choice(("article", "article", "article", "main", "div", "section", "td"))
    article = f"<{tag}{named('main') if tag in ('div', 'section', 'td') or rng.random() < 0.3 else ''}>{''.join(inside)}</{tag}>"
    if tag == "td":
        article = f"<table><tr>{article}<td{named('aside')}>{links()}</td></tr></table>"
    for _ in range(rng.choice((0, 0, 1, 2))):
        article = f"<{(t := rng.choice(('div', 'main', 'section', 'div')))}{named(rng.choice(('main', None, None)))}>{article}</{t}>"
    before = [other(rng.choice(("nav", "nav", "header", "ad", "notice", "form", "aside"))) for _ in range(rng.randint(0, 4))]
    after = [other(rng.choice(("comments", "footer", "footer", "aside", "ad", "share", "notice", "nav"))) for _ in range(rng.randint(0, 4))]
    head = f"<!DOCTYPE html><html><head><title>{prose(2, 8)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
    return head + "".join([*before, article, *after]) + rng.choice(("</body></html>", ""))


def labelled_page(rng: random.Random) -> tuple[np.ndarray, np.ndarray]:
    found = blocks(training_page(rng))
    labels = np.array([MARK in b.text for b in found], np.float32)
    clean = [Block(b.text.replace(MARK, "").strip() or "-", b.path, b.linked) for b in found]
    return features(clean), labels


@lru_cache(2)
def trained(pages: int = TRAINING_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> dict[str, np.ndarray]:
    """The model: deterministic in its parameters, trained once a process."""
    rng, source = np.random.default_rng(seed), random.Random(seed)
    data = [labelled_page(source) for _ in range(pages)]
    data = sorted((d for d in data if len(d[0])), key=lambda d: len(d[0]))
    model = new_model(rng)
    first, second, n = {k: np.zeros_like(v) for k, v in model.items()}, {k: np.zeros_like(v) for k, v in model.items()}, 0
    batches = [data[i : i + 30] for i in range(0, len(data), 30)]
    for epoch in range(epochs):
        for k in rng.permutation(len(batches)):
            x, mask = padded([d[0] for d in batches[k]])
            # some path words go missing and some turn up by chance, so that no single name decides
            noise = rng.random((*x.shape[:2], PATH_CELLS)) if epoch < epochs - 2 else None
            if noise is not None:
                x[..., :PATH_CELLS] = np.where(noise < 0.04, 0, np.where(noise > 0.998, 1, x[..., :PATH_CELLS]))
            y = np.zeros(mask.shape, np.float32)
            for i, d in enumerate(batches[k]):
                y[i, : len(d[1])] = d[1]
            n += 1
            rate = 0.01 * (1 if epoch < epochs - 4 else 0.3)
            for name, g in _gradients(model, x, mask, y).items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g**2
                model[name] = (model[name] - rate * (first[name] / (1 - 0.9**n)) / (np.sqrt(second[name] / (1 - 0.999**n)) + 1e-8)).astype(np.float32)
    return model


# -- the operator --------------------------------------------------------------


def main_texts(model: dict[str, np.ndarray], pages: list[str | None]) -> list[str]:
    """Main blocks of each page, joined by line ends."""
    found = [blocks(p) for p in pages]
    texts = [""] * len(pages)
    order = sorted((i for i in range(len(pages)) if found[i]), key=lambda i: len(found[i]))
    at = 0
    while at < len(order):
        part = [order[at]]
        while at + len(part) < len(order) and len(part) < PAGES and len(found[order[at + len(part)]]) * (len(part) + 1) <= 20_000:
            part.append(order[at + len(part)])
        x, mask = padded([features(found[i]) for i in part])
        chosen = probabilities(model, x, mask) >= 0.5
        for row, i in enumerate(part):
            texts[i] = "\n".join(b.text for b, ok in zip(found[i], chosen[row]) if ok)
        at += len(part)
    return texts


def _extracted(model: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES):
                part = batch.slice(at, PAGES)
                texts = main_texts(model.value, part.column("html").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract_main_text(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars, one row per row.

    Null and empty html, and pages without main text, give the empty text.  Whole pages
    are read whatever their length.  Rows may repeat, ids and urls may be null; other
    columns are not read; an empty table gives no rows.
    """
    model = pages.sparkSession.sparkContext.broadcast(trained())
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return given.mapInArrow(_extracted(model), "page_id long, url string, text string, n_chars long")
