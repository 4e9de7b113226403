"""The SEO checks of a site over its pages, and their dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions import urls
from pagelens.functions.numbers import blend, points, score, status
from pagelens.operators.scores import composite

# Check, category, severity, priority.
CHECKS = (
    ("CHK-001", "Technical SEO", "high", "P0"), ("CHK-002", "Technical SEO", "high", "P0"), ("CHK-003", "Measurement", "medium", "P1"), ("CHK-004", "Technical SEO", "critical", "P0"),
    ("CHK-005", "Technical SEO", "high", "P0"), ("CHK-006", "Technical SEO", "medium", "P1"), ("CHK-007", "Schema", "high", "P1"), ("CHK-008", "Technical SEO", "critical", "P0"),
    ("CHK-009", "Technical SEO", "high", "P1"), ("CHK-010", "Performance", "high", "P1"), ("CHK-011", "International SEO", "medium", "P1"), ("CHK-012", "Technical SEO", "critical", "P0"),
    ("CHK-013", "Technical SEO", "high", "P1"), ("CHK-014", "On-Page SEO", "high", "P1"), ("CHK-015", "On-Page SEO", "medium", "P1"), ("CHK-016", "On-Page SEO", "medium", "P1"),
    ("CHK-017", "Technical SEO", "high", "P0"), ("CHK-018", "International SEO", "medium", "P1"), ("CHK-019", "Image SEO", "medium", "P2"), ("CHK-020", "On-Page SEO", "medium", "P2"),
    ("CHK-021", "Performance", "medium", "P2"), ("CHK-022", "Performance", "medium", "P1"), ("CHK-023", "Content Quality", "high", "P1"), ("CHK-024", "Content Quality", "high", "P1"),
    ("CHK-025", "Content Quality", "medium", "P2"), ("CHK-026", "AI Search", "medium", "P2"),
)
# Raw weights of the dimensions (they sum to 0.95 and are divided by that).
WEIGHTS = {"technical": 0.22, "content_quality": 0.23, "on_page": 0.20, "schema": 0.10, "performance": 0.10, "ai_search": 0.10}

c = F.col


def check_columns() -> dict[str, Column]:
    """Pass columns of the 26 checks over a row of modules.audited; null where an input is not known, or a check does not apply."""
    third, quarter = F.greatest(F.lit(1), F.floor(c("n") / 3)), F.greatest(F.lit(1), F.floor(c("n") / 4))
    wanted = urls.base_locale(c("target_locale"))
    applies = c("home.hreflang_present") | wanted.isNotNull()
    return {
        "CHK-001": c("robots_exists") & c("robots_has_sitemap"), "CHK-002": c("sitemap_exists") & c("sitemap_https") & c("sitemap_clean"), "CHK-003": c("home.ga4") & c("home.gsc_verification"),
        "CHK-004": F.startswith(c("home.page_url"), F.lit("https://")) & c("https_ok"), "CHK-005": c("hosts_ok"), "CHK-006": c("dirty_urls") == 0, "CHK-007": c("schema_score") >= 70,
        "CHK-008": (c("errors") == 0) & (c("redirects") <= third), "CHK-009": c("home.viewport"), "CHK-010": (c("technical_score") >= 65) & (c("milliseconds") <= 1500) & (c("heavy") == 0),
        "CHK-011": F.when(applies, wanted.isNull() | F.array_contains("home.hreflangs", wanted)), "CHK-012": c("noindex") == 0, "CHK-013": c("ssr_score") >= 60,
        "CHK-014": (c("no_title") == 0) & (c("odd_titles") <= quarter), "CHK-015": (c("no_meta") == 0) & (c("odd_metas") <= third), "CHK-016": c("odd_h1") == 0,
        "CHK-017": c("home.canonical").isNotNull() & (c("other_canonical") == 0), "CHK-018": c("no_lang") == 0, "CHK-019": c("poor_alts") == 0, "CHK-020": (c("mean_links") >= 55) & (c("nofollow") == 0),
        "CHK-021": c("heavy") == 0, "CHK-022": c("home.lazy_ratio") >= 0.5, "CHK-023": (c("content_score") >= 65) & (c("expertise_score") >= 60),
        "CHK-024": (c("experience_score") >= 60) & (c("expertise_score") >= 60) & (c("authoritativeness_score") >= 55) & (c("trustworthiness_score") >= 60),
        "CHK-025": c("any_references") & c("any_answer"), "CHK-026": (c("visibility_score") >= 60) & (c("brand_score") >= 50),
    }


def seo_checks(sites: DataFrame) -> DataFrame:
    """modules.audited -> site_id, check_id, category, severity, priority, outcome (pass, fail, na): 26 rows a site."""
    decided = check_columns()
    rows = [F.struct(F.lit(i).alias("check_id"), F.lit(g).alias("category"), F.lit(s).alias("severity"), F.lit(p).alias("priority"), F.when(decided[i], "pass").when(~decided[i], "fail").otherwise("na").alias("outcome")) for i, g, s, p in CHECKS]
    return sites.select("site_id", F.explode(F.array(*rows)).alias("x")).select("site_id", "x.*")


def seo_coverage(checks: DataFrame) -> DataFrame:
    one = lambda v: F.count_if(c("outcome") == v)
    return checks.groupBy("category").agg(F.count("*").alias("total"), one("pass").alias("passed"), one("fail").alias("failed"), one("na").alias("not_applicable"))


def seo_issues(checks: DataFrame) -> DataFrame:
    """Failed checks of each site, numbered P-001… by severity and check (at most 26 a site)."""
    rank = F.when(c("severity") == "critical", 0).when(c("severity") == "high", 1).otherwise(2)
    order = Window.partitionBy("site_id").orderBy("rank", "check_id")
    failed = checks.where("outcome = 'fail'").withColumn("rank", rank)
    numbered = failed.withColumn("issue_id", F.format_string("P-%03d", F.row_number().over(order)))
    phase = F.when(c("priority") == "P0", "0-30").when(c("category").isin("Schema", "Content Quality", "On-Page SEO"), "31-60").otherwise("61-90")
    return numbered.select("site_id", "issue_id", "check_id", "category", "severity", "priority", phase.alias("phase"))


def seo_roadmap(issues: DataFrame, most: int = 12) -> DataFrame:
    """The first issues of each site as a roadmap (its length is part of the report): phase, priority, expected impact."""
    impact = F.when(c("phase") == "0-30", "Stop-loss: fix crawl, index, and canonical blockers.").when(c("phase") == "31-60", "Build stronger landing pages, metadata, and structured content coverage.").otherwise("Compound trust, AI visibility, and long-tail quality signals.")
    return issues.where(F.substring("issue_id", 3, 9).cast("int") <= most).select("site_id", "issue_id", "check_id", "phase", "priority", impact.alias("expected_impact"))


# The check categories of each dimension; Measurement counts for none.
CATEGORIES = {"technical": ("Technical SEO", "International SEO"), "content_quality": ("Content Quality",), "on_page": ("On-Page SEO", "Image SEO"), "schema": ("Schema",), "performance": ("Performance",), "ai_search": ("AI Search",)}


def seo_scores(sites: DataFrame) -> DataFrame:
    """modules.audited -> the six dimension scores of each site and their weighted score."""
    speed = F.when(c("milliseconds") <= 300, 100).when(c("milliseconds") <= 800, 78).when(c("milliseconds") <= 1500, 58).otherwise(35)
    performance = blend((0.45, speed), (0.25, c("blocking_score"))) + c("home.lazy_ratio") * 100.0 * 0.15 + blend((0.15, F.when(c("heavy") == 0, 100).otherwise(55)))
    ai = blend((0.55, c("visibility_score")), (0.15, c("brand_score")), (0.10, c("schema_score")), (0.10, F.when(c("any_answer"), 100).otherwise(45)), (0.10, F.when(c("any_references"), 100).otherwise(40)))
    out = sites.select("site_id", "technical_score", c("quality_score").alias("content_quality_score"), score(points((25, c("no_title") == 0), (20, c("no_meta") == 0), (20, c("odd_h1") == 0), (15, c("poor_alts") == 0), (20, c("mean_links") >= 55))).alias("on_page_score"), "schema_score", score(performance).alias("performance_score"), score(ai).alias("ai_search_score"))
    return out.withColumn("seo_score", seo_score({k: c(f"{k}_score") for k in WEIGHTS}))


def seo_cards(seo: DataFrame, checks: DataFrame) -> DataFrame:
    """seo_scores and seo_checks -> a card per site and dimension: weight, score, status, its first four failed checks."""
    of = F.create_map(*[F.lit(x) for d, names in CATEGORIES.items() for n in names for x in (n, d)])
    failed = checks.where("outcome = 'fail'").withColumn("dimension", of[c("category")]).where("dimension is not null").groupBy("site_id", "dimension").agg(F.sort_array(F.collect_list("check_id")).alias("ids"))  # at most 26
    each = F.array(*[F.struct(F.lit(d).alias("dimension"), F.lit(w).alias("weight"), c(f"{d}_score").alias("score")) for d, w in WEIGHTS.items()])
    cards = seo.select("site_id", F.explode(each).alias("x")).select("site_id", "x.*")
    return cards.join(failed, ["site_id", "dimension"], "left").select("site_id", "dimension", "weight", "score", status(c("score")).alias("status"), F.array_join(F.slice(F.coalesce("ids", F.array().cast("array<string>")), 1, 4), ",").alias("issues"))


def seo_score(columns: dict[str, Column]) -> Column:
    total = sum(WEIGHTS.values())
    return composite(columns, {k: w / total for k, w in WEIGHTS.items()})
