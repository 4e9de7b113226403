"""How a search crawler meets a page: the scores of its fetch and of its rendering, their issues, and the overview of both.

A row of results is one page as it was fetched and rendered (see FETCH and RENDER for its columns).
Each step adds columns to that row, so pages are never grouped or shuffled; issues are arrays of
at most nine structs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions.numbers import points

c = F.col

#: Columns of the fetch: null status is a failed request; allowed is the verdict of the rules in robots.txt.
FETCH = "status int, body string, content_type string, directives array<string>, robots_status int, robots_body string, allowed boolean, title string, h1 string, words int, truncated boolean, fallback_status int"
#: Columns of the rendering: without status and words it was skipped.
RENDER = "render_status int, by_browser boolean, rendered_title string, rendered_words int, page_errors int, console_errors int, failed_resources int, http_errors int, timed_out boolean, private_resources int"

# Statuses and markers of an access challenge.
CHALLENGES, MARKERS = (401, 403, 406, 429, 446), "captcha|cf-chl|challenge-platform|access denied|attention required|verify you are human"
# The title of each issue.
TITLES = {
    "challenge_passed": "模拟 Googlebot UA 被 WAF 拦截（浏览器对照成功）",
    "challenge_failed": "模拟 Googlebot 请求被 WAF 或反爬策略拦截",
    "robots_blocked": "Googlebot 被 robots.txt 阻止",
    "robots_unavailable": "robots.txt 状态不确定",
    "non_200": "页面返回 HTTP ",
    "noindex": "页面包含 noindex",
    "content_type": "响应不是 HTML",
    "missing_title": "缺少页面标题",
    "missing_h1": "缺少 H1",
    "thin_initial_html": "初始 HTML 可见内容过少",
    "html_truncated": "HTML 超过模拟抓取上限",
    "browser_fallback_mode": "渲染模式使用普通浏览器 UA 对照",
    "render_rate_limited": "模拟渲染请求被限流，无法判断页面状态",
    "render_http_status": "渲染导航未返回 HTTP 200",
    "rendered_title_missing": "渲染后仍缺少标题",
    "rendered_content_thin": "渲染后核心内容仍过少",
    "content_lost_after_render": "渲染后丢失大量正文",
    "javascript_errors": "渲染期间出现 JavaScript 错误",
    "resource_failures": "部分渲染资源加载失败",
    "network_idle_timeout": "页面未及时进入网络空闲",
    "private_resources": "页面引用了不可公开访问的资源",
}
# Severities, worst first; high issues that do not block.
SEVERITIES, HARMLESS = ("critical", "high", "medium", "low"), ("thin_initial_html", "googlebot_access_challenge", "render_rate_limited")
THIN = 50  # words of a page without content


def http_outcome(status: Column) -> Column:
    return F.when(status.isNull(), "network_error").when(status == 429, "rate_limited").when(status.between(200, 299), "success").when(status.between(300, 399), "redirect").otherwise("http_error")


def access_challenge(status: Column, body: Column) -> Column:
    return F.coalesce(status.isin(*CHALLENGES) | (status.isin(400, 503) & F.lower(body).rlike(MARKERS)), F.lit(False))


def retry_after(value: Column, now: Column) -> Column:
    """Seconds of a Retry-After header, whole seconds or an HTTP date; never negative."""
    date = F.try_to_timestamp(F.substring(value, 6, 64), F.lit("dd MMM yyyy HH:mm:ss z"))
    seconds = F.coalesce(value.try_cast("long"), F.unix_timestamp(date) - F.unix_timestamp(now))
    return F.greatest(F.lit(0).cast("long"), seconds)


def robots_state(status: Column, body: Column, allowed: Column) -> Column:
    """What robots.txt says by its status and its rules' verdict; not_found counts as allowed, the others but allowed and blocked as unknown."""
    return F.when(status.isNull(), "unavailable").when(access_challenge(status, body), "access_challenge").when(status.between(400, 499), "not_found").when(status >= 500, "server_error").when(allowed, "allowed").otherwise("blocked")


def _issues(*found: tuple[Column, str, Column | str, Column | str]) -> Column:
    """(condition, code, severity, title) -> array of those that hold, in order."""
    text = lambda v: F.lit(v) if isinstance(v, str) else v
    each = [F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(code).alias("code"), text(severity).alias("severity"), text(title).alias("title"))) for when, code, severity, title in found]
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def status_of(issues: Column, score: Column) -> Column:
    """failed, warning or passed by the worst issue and the score."""
    has = lambda *s: F.exists(issues, lambda x: x["severity"].isin(*s))
    return F.when(has("critical") | (score < 50), "failed").when(has("high", "medium") | (score < 80), "warning").otherwise("passed")


def _clamped(*deductions: tuple[int | Column, Column]) -> Column:
    return F.greatest(F.lit(0), 100 - points(*deductions))


def googlebot(results: DataFrame) -> DataFrame:
    """FETCH columns -> googlebot_score, googlebot_status, indexable (null: unknown), challenge, robots, googlebot_issues.

    A page behind a challenge is judged by a browser's answer where that is 200.
    """
    empty = lambda v: F.coalesce(F.trim(v), F.lit("")) == ""
    out = results.withColumns({
        "challenge": access_challenge(c("status"), c("body")), "robots": robots_state(c("robots_status"), c("robots_body"), c("allowed")),
        "noindex": F.exists(F.coalesce("directives", F.array().cast("array<string>")), lambda d: (F.lower(F.trim(d)) == "none") | F.startswith(F.lower(F.trim(d)), F.lit("noindex"))),
    })
    passed = F.coalesce(c("challenge") & (c("fallback_status") == 200), F.lit(False))
    blocked, unknown = c("robots") == "blocked", ~c("robots").isin("blocked", "allowed", "not_found")
    status, words = F.coalesce("status", F.lit(599)), F.coalesce("words", F.lit(0))
    answered = (status != 200) & ~c("challenge")
    no_html = ~F.contains(F.lower(F.coalesce("content_type", F.lit(""))), F.lit("text/html"))
    score = _clamped((5, passed), (15, c("challenge") & ~passed), (55, blocked), (15, unknown), (45, answered & (status >= 400)), (20, answered & (status < 400)), (45, c("noindex")), (20, no_html), (8, empty(c("title"))), (6, empty(c("h1"))), (12, words < THIN), (5, F.coalesce("truncated", F.lit(False))))
    found = _issues(
        (c("challenge"), "googlebot_access_challenge", F.when(passed, "medium").otherwise("high"), F.when(passed, TITLES["challenge_passed"]).otherwise(TITLES["challenge_failed"])),
        (blocked, "robots_blocked", "critical", TITLES["robots_blocked"]), (unknown, "robots_unavailable", "medium", TITLES["robots_unavailable"]),
        (answered, "non_200", F.when(status >= 400, "critical").otherwise("high"), F.concat(F.lit(TITLES["non_200"]), F.coalesce(c("status").cast("string"), F.lit("unknown")))),
        (c("noindex"), "noindex", "critical", TITLES["noindex"]), (no_html, "content_type", "high", TITLES["content_type"]), (empty(c("title")), "missing_title", "medium", TITLES["missing_title"]),
        (empty(c("h1")), "missing_h1", "medium", TITLES["missing_h1"]), (words < THIN, "thin_initial_html", "high", TITLES["thin_initial_html"]), (c("truncated"), "html_truncated", "medium", TITLES["html_truncated"]),
    )
    indexable = F.when(c("noindex") | blocked, False).when(c("challenge"), None).otherwise(status == 200)
    out = out.withColumns({"googlebot_score": score, "googlebot_issues": found, "indexable": indexable})
    return out.withColumn("googlebot_status", status_of(c("googlebot_issues"), c("googlebot_score")))


def render(results: DataFrame) -> DataFrame:
    """words and RENDER columns -> render_score, render_result (skipped without rendering), content_retention, render_issues."""
    n = lambda name: F.coalesce(c(name), F.lit(0))
    skipped, words, rendered = c("render_status").isNull() & c("rendered_words").isNull(), n("words"), n("rendered_words")
    limited, ok = F.coalesce(c("render_status") == 429, F.lit(False)), F.coalesce(c("render_status") == 200, F.lit(False))
    untitled, lost = F.coalesce(F.trim("rendered_title"), F.lit("")) == "", (words >= THIN) & (rendered < words.cast("double") * 0.6)
    scripts, resources = (n("page_errors") + n("console_errors")) > 0, n("failed_resources") + n("http_errors")
    script_part = F.least(F.lit(20), 5 + n("page_errors") * 5)
    resource_part = F.least(F.lit(15), F.greatest(F.lit(5), F.floor(resources / 2).cast("int")))
    slow, private = F.coalesce("timed_out", F.lit(False)), n("private_resources") > 0
    score = _clamped((30, limited), (45, ~limited & ~ok), (10, ok & untitled), (25, ok & (rendered < THIN)), (20, ok & lost), (script_part, ok & scripts), (resource_part, ok & (resources > 0)), (10, ok & slow), (5, ok & private))
    found = _issues(
        (c("by_browser"), "browser_fallback_mode", "medium", TITLES["browser_fallback_mode"]), (limited, "render_rate_limited", "high", TITLES["render_rate_limited"]), (~limited & ~ok, "render_http_status", "critical", TITLES["render_http_status"]),
        (ok & untitled, "rendered_title_missing", "high", TITLES["rendered_title_missing"]), (ok & (rendered < THIN), "rendered_content_thin", "high", TITLES["rendered_content_thin"]), (ok & lost, "content_lost_after_render", "high", TITLES["content_lost_after_render"]),
        (ok & scripts, "javascript_errors", F.when(n("page_errors") > 0, "high").otherwise("medium"), TITLES["javascript_errors"]), (ok & (resources > 0), "resource_failures", "medium", TITLES["resource_failures"]),
        (ok & slow, "network_idle_timeout", "medium", TITLES["network_idle_timeout"]), (ok & private, "private_resources", "medium", TITLES["private_resources"]),
    )
    out = results.withColumns({"render_score": F.when(~skipped, score), "render_issues": F.when(skipped, F.slice(found, 1, 0)).otherwise(found), "content_retention": F.when(c("rendered_words").isNotNull() & (words > 0), F.bround(rendered / words * 100.0, 0).cast("int"))})
    return out.withColumn("render_result", F.when(skipped, "skipped").otherwise(status_of(c("render_issues"), c("render_score"))))


def rendering_mode(render_status: Column, words: Column, rendered: Column) -> Column:
    """How much of a page only appears when it is rendered."""
    growth = F.greatest(F.lit(THIN), F.bround(words.cast("double") * 0.3, 0).cast("int"))
    mode = F.when((words < THIN) & (rendered >= THIN), "client_rendered").when(words < THIN, "thin_content").when(rendered < words.cast("double") * 0.6, "hydration_loss").when(rendered - words >= growth, "hybrid_rendered").otherwise("server_rendered")
    return F.when(F.coalesce(render_status == 429, F.lit(False)) | rendered.isNull(), "unknown").otherwise(mode)


def major_issues(most: int = 5) -> Column:
    """The worst issues of both, by severity and title (their number is part of the report)."""
    of = lambda name, source: F.transform(name, lambda x: F.struct((F.array_position(F.array(*map(F.lit, SEVERITIES)), x["severity"])).alias("rank"), x["title"].alias("title"), x["code"].alias("code"), x["severity"].alias("severity"), F.lit(source).alias("source")))
    return F.slice(F.array_sort(F.concat(of("googlebot_issues", "Googlebot"), of("render_issues", "Google Render"))), 1, most)


def overview(results: DataFrame) -> DataFrame:
    """results with googlebot and render -> rendering, verdict, crawl, indexing and major_issues besides their columns."""
    out = results.withColumns({"rendering": rendering_mode(c("render_status"), F.coalesce("words", F.lit(0)), c("rendered_words")), "major_issues": major_issues()})
    done, limited = c("render_result") != "skipped", F.coalesce(c("render_status") == 429, F.lit(False))
    blocked, http_ok = c("robots") == "blocked", F.coalesce(c("status") == 200, F.lit(False))
    render_ok = ~done | F.coalesce(c("render_status") == 200, F.lit(False)) | limited
    blocking = F.exists("major_issues", lambda x: (x["severity"] == "critical") | ((x["severity"] == "high") & ~x["code"].isin(*HARMLESS)))
    shut = blocked | F.coalesce(~c("indexable"), F.lit(False))
    verdict = (
        F.when(shut, "failed").when(c("challenge") | limited, "warning").when(~http_ok | ~render_ok, "failed").when(c("rendering").isin("thin_content", "hydration_loss") | blocking, "failed")
        .when(done & (c("googlebot_status") == "passed") & (c("render_result") == "passed"), "passed").otherwise("warning")
    )
    crawl = F.when(c("challenge"), "warning").when(c("robots").isin("allowed", "not_found") & http_ok, "passed").when(blocked | ~http_ok, "failed").otherwise("warning")
    indexing = F.when(c("indexable"), "passed").when(~c("indexable"), "failed").otherwise("warning")
    return out.withColumns({"verdict": verdict, "crawl": crawl, "indexing": indexing})
