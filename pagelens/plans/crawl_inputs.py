"""Fetch and render results that the tables do not hold, drawn from page ids, and the SQL of the crawler's verdicts."""

from __future__ import annotations

from pagelens.operators.crawler import TITLES
from pagelens.plans import oracle_parts as O

#: Expressions over page_id, title, word_count and h1_count that Spark and DuckDB both read.
INPUTS = {
    "status": "case page_id % 23 when 3 then 404 when 5 then 301 when 7 then 403 when 9 then 503 when 11 then null else 200 end",
    "body": "case when page_id % 23 = 9 and page_id % 2 = 0 then 'Attention Required' else '' end",
    "content_type": "case when page_id % 29 = 1 then 'application/pdf' else 'Text/HTML; charset=utf-8' end",
    "header": "case page_id % 17 when 1 then 'follow, NoIndex' when 2 then 'none' else '' end",
    "robots_status": "case page_id % 19 when 1 then 404 when 2 then 500 when 3 then null when 4 then 403 else 200 end",
    "robots_body": "''",
    "allowed": "page_id % 13 <> 0",
    "h1": "case when h1_count > 0 then 'h' else '' end",
    "words": "cast(case when page_id % 8 = 0 then 10 else word_count end as int)",
    "truncated": "page_id % 31 = 0",
    "fallback_status": "case when page_id % 2 = 0 then 200 else 403 end",
    "render_status": "case page_id % 7 when 1 then 429 when 2 then 500 when 3 then null else 200 end",
    "by_browser": "page_id % 5 = 1",
    "rendered_title": "case when page_id % 11 = 2 then '' else title end",
    "rendered_words": "cast(case when page_id % 7 = 3 then null when page_id % 6 = 0 then floor(word_count / 3) when page_id % 6 = 1 then word_count * 2 else word_count end as int)",
    "page_errors": "cast(case when page_id % 10 < 5 then page_id % 10 else 0 end as int)",
    "console_errors": "case when page_id % 10 = 6 then 2 else 0 end",
    "failed_resources": "case page_id % 9 when 1 then 40 when 2 then 9 else 0 end",
    "http_errors": "case when page_id % 9 = 2 then 5 else 0 end",
    "timed_out": "page_id % 14 = 0",
    "private_resources": "case when page_id % 16 = 5 then 1 else 0 end",
}


def codes(name: str) -> str:
    return f"array_to_string(list_transform({name}, lambda x: x.code || ':' || x.severity), ',') as {name}"


def _list(*found: tuple[str, str, str, str]) -> str:
    each = ", ".join(f"case when {when} then {{'code': '{code}', 'severity': {severity}, 'title': {title}}} end" for when, code, severity, title in found)
    return f"list_filter([{each}], lambda x: x is not null)"


def _t(code: str) -> str:
    return O.q(TITLES[code])


def _status(issues: str, score: str) -> str:
    has = lambda s: f"list_contains(list_transform({issues}, lambda x: x.severity), '{s}')"
    return f"case when {has('critical')} or {score} < 50 then 'failed' when {has('high')} or {has('medium')} or {score} < 80 then 'warning' else 'passed' end"


_FETCHED = _list(
    ("challenge", "googlebot_access_challenge", "case when passed then 'medium' else 'high' end", f"case when passed then {_t('challenge_passed')} else {_t('challenge_failed')} end"),
    ("robots = 'blocked'", "robots_blocked", "'critical'", _t("robots_blocked")), ("unknown", "robots_unavailable", "'medium'", _t("robots_unavailable")),
    ("odd", "non_200", "case when code >= 400 then 'critical' else 'high' end", f"{_t('non_200')} || coalesce(status::varchar, 'unknown')"), ("noindex", "noindex", "'critical'", _t("noindex")),
    ("page_id % 29 = 1", "content_type", "'high'", _t("content_type")), ("untitled", "missing_title", "'medium'", _t("missing_title")), ("h1 = ''", "missing_h1", "'medium'", _t("missing_h1")),
    ("words < 50", "thin_initial_html", "'high'", _t("thin_initial_html")), ("truncated", "html_truncated", "'medium'", _t("html_truncated")),
)
_RENDERED = _list(
    ("by_browser", "browser_fallback_mode", "'medium'", _t("browser_fallback_mode")), ("limited", "render_rate_limited", "'high'", _t("render_rate_limited")), ("not limited and not ok", "render_http_status", "'critical'", _t("render_http_status")),
    ("ok and trim(coalesce(rendered_title, '')) = ''", "rendered_title_missing", "'high'", _t("rendered_title_missing")), ("ok and shown < 50", "rendered_content_thin", "'high'", _t("rendered_content_thin")),
    ("ok and words >= 50 and shown < words * 0.6::double", "content_lost_after_render", "'high'", _t("content_lost_after_render")), ("ok and page_errors + console_errors > 0", "javascript_errors", "case when page_errors > 0 then 'high' else 'medium' end", _t("javascript_errors")),
    ("ok and failed_resources + http_errors > 0", "resource_failures", "'medium'", _t("resource_failures")), ("ok and timed_out", "network_idle_timeout", "'medium'", _t("network_idle_timeout")), ("ok and private_resources > 0", "private_resources", "'medium'", _t("private_resources")),
)
_RANKED = lambda issues, source: f"list_transform({issues}, lambda x: {{'rank': list_position(['critical', 'high', 'medium', 'low'], x.severity), 'title': x.title, 'code': x.code, 'severity': x.severity, 'source': '{source}'}})"

SQL = f"""{O.PROFILES}, crawl as (select page_id, title, {", ".join(f"{e} as {n}" for n, e in INPUTS.items())} from p),
fetched as (select *, coalesce(status in (401, 403, 406, 429, 446) or (status in (400, 503) and body = 'Attention Required'), false) as challenge, coalesce(status, 599) as code, trim(coalesce(title, '')) = '' as untitled,
 case when robots_status is null then 'unavailable' when robots_status = 403 then 'access_challenge' when robots_status = 404 then 'not_found' when robots_status = 500 then 'server_error' when allowed then 'allowed' else 'blocked' end as robots,
 header <> '' as noindex, coalesce(render_status = 429, false) as limited, coalesce(render_status = 200, false) as ok, coalesce(rendered_words, 0) as shown, render_status is null and rendered_words is null as skipped from crawl),
judged as (select *, challenge and fallback_status = 200 as passed, robots in ('unavailable', 'access_challenge', 'server_error') as unknown, code <> 200 and not challenge as odd from fetched),
scored as (select *, {_FETCHED} as googlebot_issues, case when skipped then [] else {_RENDERED} end as render_issues,
 greatest(0, 100 - case when passed then 5 when challenge then 15 else 0 end - case when robots = 'blocked' then 55 when unknown then 15 else 0 end - case when odd and code >= 400 then 45 when odd then 20 else 0 end - case when noindex then 45 else 0 end
  - case when page_id % 29 = 1 then 20 else 0 end - case when untitled then 8 else 0 end - case when h1 = '' then 6 else 0 end - case when words < 50 then 12 else 0 end - case when truncated then 5 else 0 end) as googlebot_score,
 case when not skipped then greatest(0, 100 - case when limited then 30 when not ok then 45 else case when trim(coalesce(rendered_title, '')) = '' then 10 else 0 end + case when shown < 50 then 25 else 0 end + case when words >= 50 and shown < words * 0.6::double then 20 else 0 end
  + case when page_errors + console_errors > 0 then least(20, 5 + 5 * page_errors) else 0 end + case when failed_resources + http_errors > 0 then least(15, greatest(5, (failed_resources + http_errors) // 2)) else 0 end + case when timed_out then 10 else 0 end + case when private_resources > 0 then 5 else 0 end end) end::int as render_score,
 case when rendered_words is not null and words > 0 then round_even(rendered_words::double / words * 100.0::double, 0)::int end as content_retention,
 case when noindex or robots = 'blocked' then false when not challenge then code = 200 end as indexable from judged),
audits as (select *, {_status('googlebot_issues', 'googlebot_score')} as googlebot_status, case when skipped then 'skipped' else {_status('render_issues', 'render_score')} end as render_result from scored),
ranked as (select * exclude (unknown), list_sort({_RANKED('googlebot_issues', 'Googlebot')} || {_RANKED('render_issues', 'Google Render')})[1:5] as major_issues,
 case when limited or rendered_words is null then 'unknown' when words < 50 and shown >= 50 then 'client_rendered' when words < 50 then 'thin_content' when shown < words * 0.6::double then 'hydration_loss'
  when shown - words >= greatest(50, round_even(words * 0.3::double, 0)) then 'hybrid_rendered' else 'server_rendered' end as rendering from audits),
overview as (select *, case when challenge then 'warning' when robots in ('allowed', 'not_found') and code = 200 then 'passed' when robots = 'blocked' or code <> 200 then 'failed' else 'warning' end as crawl, case when indexable then 'passed' when not indexable then 'failed' else 'warning' end as indexing,
 case when robots = 'blocked' or coalesce(not indexable, false) then 'failed' when challenge or limited then 'warning' when code <> 200 or not (skipped or ok or limited) then 'failed'
  when rendering in ('thin_content', 'hydration_loss') or len(list_filter(major_issues, lambda x: x.severity = 'critical' or (x.severity = 'high' and x.code not in ('thin_initial_html', 'googlebot_access_challenge', 'render_rate_limited')))) > 0 then 'failed'
  when not skipped and googlebot_status = 'passed' and render_result = 'passed' then 'passed' else 'warning' end as verdict from ranked)"""
