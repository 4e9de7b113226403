"""Texts with letters on which engines differ: the entity graph and the tree reader against their SQL."""

import duckdb
import pytest

from pagelens.plans.queries import ORACLES, QUERIES
from pagelens.sources import html_tree
from tests.test_queries import plain

TEXTS = [
    None, "", "\u039f\u0394\u039f\u03a3\nCustomers say \u039f\u0394\u039f\u03a3. \u0130zmir is easy.", "feature\u017f: \u017fafe and \u212aeen. Be\u017ft for \u212aings of all", ",0g9 rated 20mins\nrest", "x \U0001d51820mins \U0001d518AC/DC 10 GB \u037820 kg",
    "deta\u0130ls\nrev\u0130ew of it", "| Customers find it reliable: |", "\u00e920 kg and 5 GB. ideal for boats", None, "plain features: one two three.",
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("odd")
    duck = duckdb.connect()
    duck.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    sources = ["web", None, "\u03ba\u03a3", "Blog ", ""]
    duck.executemany("insert into documents values (?, ?, 'en', ?, 0)", [(i, TEXTS[i % len(TEXTS)], sources[i // 3 % 5]) for i in range(165)])
    duck.execute(f"copy documents to '{at}/documents.parquet' (format parquet)")
    duck.execute("create table pages (page_id bigint, url varchar, html varchar)")
    titles = ["a &amp", "b &amp; &ampc; &notit; &#65;", "c &eacute d &eacute;", "plain", "x &&&amp"]
    duck.executemany("insert into pages values (?, ?, ?)", [(i, f"https://h.example/{i}", f"<html lang=\"en\"><head><title>{t}</title></head><body><h1>{t}</h1><p>text</p></body></html>") for i, t in enumerate(t for t in titles if "&#" not in t and "eacute" not in t)])
    duck.execute(f"copy pages to '{at}/pages.parquet' (format parquet)")
    return str(at), duck


@pytest.mark.parametrize("name", ["entity_graph_edges", "entity_graph_entities", "entity_graph_evidence", "page_tree"])
def test_equals_sql(spark, folder, name):
    at, duck = folder
    (columns, got), (named, want) = plain(QUERIES[name](spark, at).toPandas()), plain(duck.execute(ORACLES[name]).df())
    assert columns == named and len(got) == len(want)
    assert sorted(set(map(str, got)) ^ set(map(str, want))) == []


def test_references():
    assert html_tree.unescaped("a &amp b &amp; &ampc; &notit; &#65;&#x42 &eacute; &eacute &&&amp") == "a &amp b & &ampc; &notit; AB \u00e9 &eacute &&&amp"
