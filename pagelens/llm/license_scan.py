"""License scans over a positional rare-token index, with DataFrame functions only.

Licence templates are indexed by one word and its position: the word of the template's
key phrase with the highest inverse document frequency (over all files).  Every place of
such a word in a file proposes an alignment between file and template, which counts once
the key phrase stands there word for word.  A phrase cannot stand without its rarest
word, so no template is missed, however many other licence words a file has.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import cut

#: Words, once A-Z are lowered.
LOWER_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Label, licence text, key phrase.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("mit", "released under the mit license", "mit license"),
    ("apache", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
)
# Phrases that always label.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Template words that are common everywhere and never looked up.
COMMON = frozenset("a an and any are as by can for in is it may not of or that the this to use with you".split())

WORDS = sorted({w for _, text, _ in TEMPLATES for w in text.split()})
CODES = {w: i + 1 for i, w in enumerate(WORDS)}  # 0: no template word
VOCABULARY = [w for w in WORDS if w not in COMMON]


def _codes(words: Column) -> Column:
    """The code of every word of a file, in order."""
    return F.transform(words, lambda w: F.array_position(F.array(*map(F.lit, WORDS)), w).cast("short"))


def _base(words: Column, phrase: str) -> Column:
    """Places where the words of phrase stand consecutively."""
    parts = phrase.split()
    same = lambda i: F.forall(F.array(*[F.get(words, i + k) == F.lit(p) for k, p in enumerate(parts)]), lambda x: F.coalesce(x, F.lit(False)))
    starts = F.filter(F.transform(words, lambda w, i: F.when(w == parts[0], i)), lambda i: i.isNotNull())
    return F.filter(starts, same)


def _postings(idf: dict[str, float]) -> tuple[list[int], Column]:
    """The codes looked up, and each template with the code of its looked-up word and the words of its phrase and text, placed relative to that word."""
    short, rows = lambda v: F.lit(v).cast("short"), []
    for label, text, phrase in TEMPLATES:
        text, phrase = text.split(), phrase.split()
        first = next(i for i in range(len(text)) if text[i : i + len(phrase)] == phrase)
        place = max((i for i in range(first, first + len(phrase)) if text[i] not in COMMON), key=lambda i: (idf[text[i]], text[i]))
        weighed = [(i - place, w, idf[w]) for i, w in enumerate(text) if w not in COMMON]
        stands = F.array(*[F.struct(F.lit(first + i - place).alias("by"), short(CODES[w]).alias("code")) for i, w in enumerate(phrase)])
        mass = F.array(*[F.struct(F.lit(by).alias("by"), short(CODES[w]).alias("code"), F.lit(m / sum(m for _, _, m in weighed)).alias("share")) for by, w, m in weighed])
        rows.append((CODES[text[place]], F.struct(F.lit(label).alias("label"), short(CODES[text[place]]).alias("code"), stands.alias("phrase"), mass.alias("mass"))))
    return sorted({code for code, _ in rows}), F.array(*[row for _, row in rows])


def _aligned(codes: Column, idf: dict[str, float]) -> Column:
    """Label and share of every alignment whose key phrase stands in the file."""
    looked_up, postings = _postings(idf)
    here = lambda at, x: F.coalesce(F.get(codes, at + x["by"]) == x["code"], F.lit(False))
    share = lambda at, p: F.aggregate(p["mass"], F.lit(0.0), lambda sum_, x: sum_ + F.when(here(at, x), x["share"]).otherwise(0.0))
    places = F.filter(F.transform(codes, lambda c, i: F.when(F.array_contains(F.array(*[F.lit(c).cast("short") for c in looked_up]), c), i)), lambda i: i.isNotNull())
    stands = lambda at: F.filter(postings, lambda p: (p["code"] == F.get(codes, at)) & F.forall(p["phrase"], lambda x: here(at, x)))
    return F.flatten(F.transform(places, lambda at: F.transform(stands(at), lambda p: F.struct(p["label"].alias("label"), share(at, p).alias("share")))))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, one row per row.

    The base columns count every place of the phrases in BASE.  labels adds those of
    all templates whose key phrase stands in the file; score is the largest share of such
    a template's idf mass (over its places) that its aligned words carry, 0 without one.
    Null and empty texts have no words and no labels.  Rows alike in text get the same
    labels; doc_id may be null.  Other columns are not read.
    """
    # capitals beyond A-Z stay inside words, but two of them become a to z when lowered: such texts go letter by letter
    given = F.coalesce("text", F.lit(""))
    lowered = F.when(given.contains("\u0130") | given.contains("\u212a"), F.translate(given, UPPER, UPPER.lower())).otherwise(F.lower(given))
    words = docs.select("doc_id", F.regexp_extract_all(lowered, F.lit(LOWER_WORD), F.lit(0)).alias("words"))
    words = words.select("doc_id", "words", F.size("words").cast("long").alias("n_words"), F.array_intersect(F.array(*map(F.lit, VOCABULARY)), "words").alias("known"))
    base = F.when(F.array_contains("known", "license"), F.array(*[F.struct(F.lit(label).alias("label"), _base(F.col("words"), phrase).alias("at")) for phrase, label in BASE]))
    scanned = cut(words.select("doc_id", "n_words", "known", base.alias("base"), F.when(F.size("known") > 0, _codes(F.col("words"))).alias("codes")))

    n = scanned.count()
    found = {r["word"]: r["n"] for r in scanned.select(F.explode("known").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}  # at most the vocabulary
    idf = {w: math.log((n + 1) / (found.get(w, 0) + 1)) + 1 for w in VOCABULARY}

    places = F.flatten(F.transform(F.coalesce("base", F.array().cast("array<struct<label:string,at:array<int>>>")), lambda b: b["at"]))
    base_labels = F.array_sort(F.array_distinct(F.transform(F.filter("base", lambda b: F.size(b["at"]) > 0), lambda b: b["label"])))
    out = scanned.select("doc_id", "n_words", places.alias("places"), F.coalesce(base_labels, F.array().cast("array<string>")).alias("base_labels"), _aligned(F.col("codes"), idf).alias("aligned"))
    more = F.coalesce(F.transform("aligned", lambda a: a["label"]), F.array().cast("array<string>"))
    labels, score = F.array_sort(F.array_distinct(F.concat("base_labels", more))), F.array_max(F.transform("aligned", lambda a: a["share"]))
    return out.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"), F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), F.least(F.lit(1.0), F.coalesce(score, F.lit(0.0))).alias("score"))


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _sql_places(phrase: list[str]) -> str:
    return f"list_filter(range(1, len(w) - {len(phrase) - 2}), lambda p: w[p] = '{phrase[0]}' and w[p:p + {len(phrase) - 1}] = {_sql_list(phrase)})"


def _sql_template(label: str, text: list[str], phrase: list[str]) -> str:
    first = next(i for i in range(len(text)) if text[i : i + len(phrase)] == phrase)
    weighed = [(i - first, w) for i, w in enumerate(text) if w not in COMMON]
    mass = "list_reduce([0.0::double, " + ", ".join(f"m['{w}']" for _, w in weighed) + "], lambda a, b: a + b)"
    share = "list_reduce([0.0::double, " + ", ".join(f"case when p + {by} > 0 and w[p + {by}] = '{w}' then m['{w}'] / {mass} else 0.0::double end" for by, w in weighed) + "], lambda a, b: a + b)"
    return f"select r, '{label}' as label, {share} as share from (select r, w, unnest({_sql_places(phrase)}) as p from k), i"


ORACLE = f"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
k as (select * from d where len(list_intersect(w, {_sql_list(VOCABULARY)})) > 0),
f as (select x, count(*) as n from (select unnest(list_intersect(w, {_sql_list(VOCABULARY)})) as x from k) group by x),
v as (select x, ln((select count(*) + 1 from d)::double / (coalesce(f.n, 0) + 1)::double) + 1 as idf from (select unnest({_sql_list(VOCABULARY)}) as x) left join f using (x)),
i as (select map_from_entries(list((x, idf))) as m from v),
a as ({" union all ".join(_sql_template(label, text.split(), phrase.split()) for label, text, phrase in TEMPLATES)}),
b as ({" union all ".join(f"select r, '{label}' as label, unnest({_sql_places(phrase.split())}) - 1 as p from k" for phrase, label in BASE)}),
bb as (select r, count(*) as n_base, min(p) as first_word, max(p) as last_word, string_agg(distinct label, ',' order by label) as base_labels from b group by r),
l as (select r, string_agg(distinct label, ',' order by label) as labels from (select r, label from a union all select r, label from b) group by r),
s as (select r, max(share) as score from a group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, least(1.0::double, coalesce(score, 0.0::double)) as score
from d left join bb using (r) left join l using (r) left join s using (r)
"""
