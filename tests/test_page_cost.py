"""What saves searches of page texts changes no result, and the site queries read the pages once."""

import random

import pytest
from pyspark.sql import functions as F

from pagelens.functions import text as T
from pagelens.plans import site_inputs
from pagelens.plans.queries import QUERIES
from pagelens.sources import pages as P

TABLES = ("FAQ", "AUTHOR", "DATE", "QUANTIFIED", "REFERENCES", "SUMMARY", "UPDATES", "CITATIONS", "ANSWERS")
LIKE = ["author:", "by jane", "written by", "von müller", "door jan", "rédigé par x", "2024-01-02", "2024/01/02", "mar 3, 2024", "3. mär 2024", "3 mrt 2024", "3 août 2024", "12%x", "$5", "x€ 5", "5,000 eur", "42", "usd", "[12]", "(smith et al., 2020)", "source :x", "according to", "références", "résumé", "résumés", "mis à jour le", "dernière mise à jour", "us", "is a", "x"]
ODD = {"s": "\u017f", "k": "\u212a", "i": "\u0131", "I": "\u0130"}


@pytest.mark.parametrize("name", ["ai_perception", "site_action_plan", "seo_coverage", "seo_issues"])
def test_site_queries_read_the_pages_once(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1


def test_inputs_of_a_site_are_those_of_the_table(spark):
    ids = spark.range(300).select(F.sha2(F.col("id").cast("string"), 256).alias("site_id")).unionByName(spark.range(1).select(F.lit(None).cast("string").alias("site_id")))
    joined = ids.join(site_inputs.site_inputs(ids.where("site_id is not null")), "site_id", "left")
    assert sorted(joined.select("site_id", *site_inputs.INPUTS).collect(), key=str) == sorted(site_inputs.with_inputs(ids).select("site_id", *site_inputs.INPUTS).collect(), key=str)


def test_signals_are_the_same_with_and_without_looks(spark):
    draw = random.Random(5)
    plain = [p.replace(T.START, "").replace(T.END, "") for t in TABLES for each in getattr(T, t).values() for p in each if not set(p) & set("[\\")] + LIKE

    def one() -> str:
        words = [draw.choice(plain) if draw.random() < 0.15 else draw.choice(("lorem", "ipsum", "\U0001d400", "é", "—")) for _ in range(draw.randint(0, 30))]
        text = " ".join(draw.choice((str, str.upper, str.title))(w) for w in words)
        return "".join(ODD.get(ch, ch) if draw.random() < 0.1 else ch for ch in text)

    rows = [(one() if draw.random() < 0.8 else "frequently asked", [one(), "questions"][: draw.randint(0, 2)] if draw.random() < 0.7 else ["questions"], draw.choice(["de", "nl", "fr", "en", None])) for _ in range(1500)]
    df = P.fixed(spark.createDataFrame(rows, "text string, heads array<string>, locale string"), "text", "heads", "locale")
    known = T.looks(F.col("text"), F.col("heads"))
    df = P.fixed(df.withColumns(known), *known)
    args = F.col("text"), F.col("heads"), F.col("locale")
    head = F.regexp_replace(F.lower(F.regexp_extract("text", r"^\s*+((?:\S++\s*+){1,80})", 1)), r"\s+", " ")
    answer = F.col("text").rlike(r"^\s*+(?:\S++\s++){19}\S") & T.found(head, T.ANSWERS, F.col("locale"))
    both = {"plain": T.signals(*args) | {"answer_first": answer}, "saved": T.signals(*args, {k: F.col(k) for k in known})}
    got = df.select("text", *[F.struct(*[v.alias(n) for n, v in each.items()]).alias(k) for k, each in both.items()]).collect()
    for r in got:
        assert r["plain"] == r["saved"], r["text"]
    for signal in both["plain"]:
        assert 50 < sum(r["plain"][signal] for r in got) < 1450, signal


@pytest.mark.parametrize("table", TABLES)
def test_what_a_pattern_needs_is_known(table):
    assert sum(T.needed(p) != (False, []) for each in getattr(T, table).values() for p in each) == sum(map(len, getattr(T, table).values()))


def test_plain_words_and_references(spark):
    assert T.needed(r"a|b") == (False, []) and T.needed(r"x?\d*") == (False, []) and T.needed(r"[ab]+\$\d{2,}") == (True, ["$"])
    texts = ["a &amp;lt; b&nbsp;&copy;", "&amp;amp;", "a \t\n b", "  x ", "a\tb", "&mdash;&hellip;&euro;", "no"]
    old = F.col("t")
    for name, letter in P.ENTITIES.items():
        old = F.replace(old, F.lit(name), F.lit(letter))
    df = P.fixed(spark.createDataFrame([(t,) for t in texts], "t string"), "t")
    for r in df.select(P.decoded(F.col("t")).alias("a"), old.alias("b"), P.bare(F.col("t")).alias("c"), F.trim(F.regexp_replace(old, r"\s+", " ")).alias("d")).collect():
        assert r["a"] == r["b"] and r["c"] == r["d"]
