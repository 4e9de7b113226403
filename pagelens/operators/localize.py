"""Texts in another language, wherever they stand in nested columns.

A column's type is walked once, when the plan is built, and every text in structs, arrays
and map values becomes one expression: an exact phrase's translation, else the first
template that matches, else the text itself.  Keys of maps and other types stay.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

#: Phrases that a plan may hold; more belong in a table that is joined (site_audit.localize).
MOST_PHRASES = 5_000

# Translations of some findings, and templates with their groups; give a whole dictionary where there is one.
PHRASES = {
    "zh": {
        "robots.txt blocks one or more major AI crawlers.": "robots.txt 阻止了一个或多个主要 AI 爬虫。", "robots.txt appears open to major AI crawlers.": "robots.txt 看起来已对主要 AI 爬虫开放。", "Site does not expose llms.txt guidance.": "站点未提供 llms.txt 指引。",
        "Review robots.txt and allow GPTBot, OAI-SearchBot, PerplexityBot, and Google-Extended.": "检查 robots.txt，并放行 GPTBot、OAI-SearchBot、PerplexityBot 和 Google-Extended。", "Site resolves over HTTPS.": "站点已通过 HTTPS 访问。", "Site does not consistently enforce HTTPS.": "站点未持续强制使用 HTTPS。",
        "Redirect all traffic to HTTPS and preload HSTS once validated.": "将全部流量重定向到 HTTPS，并在验证后启用 HSTS 预加载。", "FAQ content is missing.": "缺少 FAQ 内容。", "BreadcrumbList schema is missing.": "缺少 BreadcrumbList Schema。", "No sameAs references found in structured data.": "结构化数据中未发现 sameAs 引用。",
        "Add sameAs links for official social, knowledge, and profile URLs.": "为官方社媒、知识库和资料页 URL 添加 sameAs 链接。", "Structured data exposes sameAs entity references.": "结构化数据已暴露 sameAs 实体引用。",
    }
}
TEMPLATES = {
    "zh": (
        (r"^([A-Za-z][A-Za-z0-9\s/-]+) schema detected\.$", "已检测到 $1 Schema。"), (r"^([A-Za-z][A-Za-z0-9\s/-]+) schema is missing\.$", "缺少 $1 Schema。"), (r"^(.+?) readiness is acceptable\.$", "$1 的 readiness 表现尚可。"),
        (r"^(.+?) is one of the weakest scoring dimensions and is constraining the composite GEO score\.$", "$1 是当前得分最弱的维度之一，正在拖累综合 GEO 分数。"),
    )
}


def holds_text(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return any(holds_text(f.dataType) for f in kind)
    if isinstance(kind, ArrayType):
        return holds_text(kind.elementType)
    return holds_text(kind.valueType) if isinstance(kind, MapType) else isinstance(kind, StringType)


def translated(text: Column, phrases: Mapping[str, str], templates: Sequence[tuple[str, str]]) -> Column:
    """One text: an exact phrase before templates, the first template that matches before later ones; null stays null."""
    out = text
    for pattern, replacement in reversed(templates):
        out = F.when(text.rlike(pattern), F.regexp_replace(text, pattern, replacement)).otherwise(out)
    if not phrases:
        return out
    known = F.map_from_arrays(F.lit(list(phrases)), F.lit(list(phrases.values())))
    return F.coalesce(F.try_element_at(known, text), out)


def walked(value: Column, kind: DataType, leaf) -> Column:
    """value with leaf(text) in place of every text in it."""
    if not holds_text(kind):
        return value
    if isinstance(kind, StructType):
        fields = [walked(value.getField(f.name), f.dataType, leaf).alias(f.name) for f in kind]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: walked(x, kind.elementType, leaf))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, v: walked(v, kind.valueType, leaf))
    return leaf(value)


def localized(rows: DataFrame, language: str, columns: Sequence[str] | None = None, phrases: Mapping[str, str] | None = None, templates: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """rows with the texts in the given columns (all if not given) in a language; English and languages without a dictionary change nothing.

    phrases and templates default to the built-in ones.  No join and no shuffle: the dictionary is part of the plan and at
    most MOST_PHRASES long.
    """
    phrases = PHRASES.get(language, {}) if phrases is None else phrases
    templates = TEMPLATES.get(language, ()) if templates is None else templates
    if len(phrases) > MOST_PHRASES:
        raise ValueError(f"{len(phrases)} phrases; join a table of them instead")
    if language == "en" or not (phrases or templates):
        return rows
    wanted = set(rows.columns if columns is None else columns)
    leaf = lambda text: translated(text, phrases, templates)
    return rows.select(*[walked(F.col(f"`{f.name}`"), f.dataType, leaf).alias(f.name) if f.name in wanted else F.col(f"`{f.name}`") for f in rows.schema])
