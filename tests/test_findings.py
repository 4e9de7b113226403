import pytest
from pyspark.sql import functions as F

from pagelens.operators import findings, modules
from pagelens.operators.findings import Rule
from pagelens.operators.profiles import page_profiles
from pagelens.plans import finding_queries, site_inputs
from pagelens.sources.pages import read_pages


@pytest.fixture(scope="module")
def sites(spark):
    pages = page_profiles(site_inputs.with_elements(read_pages(spark, "/root/testdata/sf0.001")))
    facts = modules.site_facts(pages)
    return modules.audited(facts, site_inputs.site_inputs(facts.select("site_id"))).cache()


def test_lists_keep_the_order_of_rules(spark):
    rules = [Rule("a", "n > 1", "A", "do a", "no a"), Rule("b", "n > 2", None, "do b"), Rule("c", "n > 0", "C", None, "no c", "n = 0"), Rule("d", "cast(null as boolean)", "D", "do d", "no d")]
    got = {r.n: (r.issues, r.strengths, r.recommendations) for r in spark.createDataFrame([(0,), (1,), (3,), (None,)], "n int").select("n", *[v.alias(k) for k, v in findings.lists(rules).items()]).collect()}
    assert got == {0: ([], ["no a", "no c", "no d"], []), 1: (["C"], ["no a", "no d"], []), 3: (["A", "C"], ["no d"], ["do a", "do b"]), None: ([], ["no a", "no d"], [])}
    parts = spark.range(1).select(findings.union_distinct(F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit("z"), F.lit("x")), most=2).alias("u")).first().u
    assert parts == ["x", "y"]


def test_findings_and_summary(sites):
    rows = findings.site_findings(sites).collect()
    assert {(r.module, r.kind) for r in rows} >= {(m, k) for m in findings.MODULES for k in ("issue", "strength", "recommendation")}
    per = {}
    for r in rows:
        per.setdefault((r.site_id, r.module, r.kind), []).append((r.pos, r.finding))
    assert all([p for p, _ in sorted(v)] == list(range(1, len(v) + 1)) for v in per.values())
    assert max(len(v) for (_, m, k), v in per.items() if (m, k) == ("schema", "recommendation")) == 5 and all(len(v) == 6 for (_, m, k), v in per.items() if (m, k) == ("platform", "recommendation"))
    for r in findings.site_summary(sites).collect():
        assert "currently scores" in r.summary and len(r.top_issues) <= 5 and len(set(r.quick_wins)) == len(r.quick_wins) <= 5
        assert [s.priority for s in r.plan][:1] == ["high"] and all(": " in i for i in r.top_issues) and len({s.module for s in r.plan}) == len(r.plan) <= 5
    assert findings.site_summary(sites.where("false")).count() == 0


def test_every_rule_has_a_condition_in_sql():
    for module, given in finding_queries.CONDITIONS.items():
        assert list(given) == [r.name for r in finding_queries._rules(module)], module
