"""Text signals: one alternation per signal and locale, so a signal is a single search.

Word edges are spelled out by classes, which reads the same in every regular
expression dialect: a word character is a letter, a digit or an underscore.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

W = r"\p{L}\p{N}_"
START, END = rf"(?:^|[^{W}])", rf"(?:$|[^{W}])"
WORDS = rf"[{W}]+"

# Phrases and patterns by locale; a locale adds its own to the default ones.
FAQ = {
    "default": ["faq", "frequently asked questions", "常见问题", "问答"],
    "de": ["häufig gestellte fragen", "fragen und antworten"],
    "nl": ["veelgestelde vragen", "vragen en antwoorden"],
    "fr": ["foire aux questions", "questions frequentes", "questions et reponses"],
}
AUTHOR = {
    "default": [rf"{START}by\s+[a-z][a-z]+", rf"{START}author{END}", rf"{START}written by{END}", rf"{START}编辑{END}", rf"{START}作者{END}"],
    "de": [rf"{START}von\s+[a-zäöü][{W}-]+", rf"{START}autor{END}", rf"{START}verfasst von{END}", rf"{START}redaktion{END}"],
    "nl": [rf"{START}door\s+[a-z][{W}-]+", rf"{START}auteur{END}", rf"{START}geschreven door{END}", rf"{START}redactie{END}"],
    "fr": [rf"{START}par\s+[a-zà-ÿ][{W}-]+", rf"{START}auteur{END}", rf"{START}r[ée]dig[ée] par{END}", rf"{START}r[ée]daction{END}"],
}
DATE = {
    "default": [rf"{START}\d{{4}}-\d{{2}}-\d{{2}}{END}", rf"{START}\d{{4}}/\d{{2}}/\d{{2}}{END}", rf"{START}(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{{1,2}},\s+\d{{4}}{END}"],
    "de": [rf"{START}\d{{1,2}}\.\s*(?:jan|feb|mär|mae|apr|mai|jun|jul|aug|sep|okt|nov|dez)[a-zäöü]*\s+\d{{4}}{END}"],
    "nl": [rf"{START}\d{{1,2}}\s+(?:jan|feb|mrt|apr|mei|jun|jul|aug|sep|okt|nov|dec)[a-z]*\s+\d{{4}}{END}"],
    "fr": [rf"{START}\d{{1,2}}\s+(?:jan|f[ée]v|mar|avr|mai|juin|juil|ao[uû]t|sept|oct|nov|d[ée]c)[a-zéû]*\s+\d{{4}}{END}"],
}
QUANTIFIED = {"default": [rf"{START}\d+(?:\.\d+)?%[{W}]", r"\$\d", rf"[{W}]€\s?\d", rf"{START}\d[\d.,]*\s?(?:eur|euro|euros|usd|rmb){END}", rf"{START}\d{{2,}}{END}", rf"{START}(?:usd|rmb){END}"]}
REFERENCES = {
    "default": ["references", "sources", "bibliography", "works cited", "citations", "参考资料", "参考文献", "资料来源"],
    "de": ["quellen", "literatur", "referenzen", "nachweise"],
    "nl": ["bronnen", "referenties", "literatuur"],
    "fr": ["r[ée]f[ée]rences", "bibliographie"],
}
SUMMARY = {
    "default": ["tl;dr", "summary", "key takeaways", "in brief", "quick answer", "overview", "摘要", "要点", "结论"],
    "de": ["kurzfassung", "zusammenfassung", "auf einen blick", "kurz gesagt"],
    "nl": ["samenvatting", "kort gezegd", "in het kort", "snel antwoord"],
    "fr": ["r[ée]sum[ée]", "en bref", "l'essentiel", "r[ée]ponse rapide"],
}
UPDATES = {
    "default": ["last updated", "updated on", "updated:", "revision history", "changelog", "最近更新", "更新记录", "修订"],
    "de": ["aktualisiert am", "zuletzt aktualisiert", "versionsverlauf", "änderungsprotokoll"],
    "nl": ["bijgewerkt op", "laatst bijgewerkt", "wijzigingslog", "revisiegeschiedenis"],
    "fr": ["mis [àa] jour le", "derni[èe]re mise [àa] jour", "historique des modifications"],
}
CITATIONS = {"default": [r"\[\d{1,3}\]", r"\([a-z][a-z]+(?:\s+et al\.)?,\s*\d{4}\)", rf"{START}source\s*:[{W}]", rf"{START}according to{END}", rf"{START}quelle:[{W}]", rf"{START}bron:[{W}]"]}
ANSWERS = {
    "default": ["we help", "we provide", "our service", "is a", "is an", "helps businesses", "can help"],
    "de": ["wir helfen", "wir bieten", "ist ein", "ist eine", "kann helfen"],
    "nl": ["wij helpen", "wij bieden", "is een", "kan helpen"],
    "fr": ["nous aidons", "nous proposons", "est un", "est une", "peut aider"],
}
GENERIC_ANCHORS = {
    "default": ["click here", "learn more", "read more", "more", "details", "here", "this link", "view more", "see more", "了解更多", "点击这里", "更多", "详情", "查看"],
    "de": ["hier", "mehr", "mehr erfahren", "weiterlesen", "details ansehen"],
    "nl": ["hier", "meer", "lees meer", "bekijk meer", "meer informatie"],
    "fr": ["ici", "en savoir plus", "lire la suite", "plus", "voir plus", "détails"],
}
# Keyword lists and patterns of the entity signals and business types, first match wins.
AWARDS = ["award", "certified", "top rated", "prix", "auszeichnung", "bekroond"]
CERTIFICATES = ["certification", "certified", "iso", "accredited", "google partner", "gecertificeerd", "certifie", "zertifiziert"]
ADDRESS = rf"{START}\d{{1,6}}\s+[a-z0-9.\s]+(?:street|st|road|rd|avenue|ave|boulevard|blvd|lane|ln){END}"
PHONE = r"\+?\d[\d\s().-]{7,}\d"
EMAIL = rf"{START}[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{{2,}}{END}"
BUSINESS_TYPES = {
    "agency": ["agency", "marketing", "seo", "growth", "bureau", "agentschap", "agentur"],
    "saas": ["platform", "software", "saas", "automation", "logiciel", "automatisering"],
    "ecommerce": ["shop", "store", "ecommerce", "product", "boutique", "winkel", "produit", "produkt"],
    "local_service": ["clinic", "law firm", "dentist", "repair", "consulting", "cabinet", "praktijk", "beratung"],
    "publisher": ["news", "blog", "media", "insights", "magazine", "actualites", "nieuws", "nachrichten"],
}


def alternation(each: list[str]) -> str:
    """One pattern for all; what begins at a word edge shares the test of that edge."""
    edged = [p.removeprefix(START) for p in each if p.startswith(START)]
    return "|".join([p for p in each if not p.startswith(START)] + ([f"{START}(?:{'|'.join(edged)})"] if edged else []))


def patterns(table: dict[str, list[str]]) -> dict[str, str]:
    """One case-insensitive alternation for each locale that adds something, and the default one."""
    return {locale: alternation(table["default"] + (extra if locale != "default" else [])) for locale, extra in table.items()}


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once, though then reads it several times."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def holds(text: Column, plain: Iterable[str]) -> Column:
    """Does the text hold one of these plain strings?  Bytes are compared, which is far cheaper than a pattern."""
    kept = [p for p in dict.fromkeys(plain) if not any(q in p for q in plain if q != p)]
    return reduce(lambda a, b: a | b, [text.contains(p) for p in kept])


#: Letters outside ASCII that match an ASCII letter when case is ignored and that lowering may leave or lengthen.
ODD = ["\u017f", "\u212a", "\u0131", "\u0130"]
_ATOMS = re.compile(r"(\(\?:(?:[^()\\]|\\.)*\)|\[[^\]]*\]|\\.|.)([?*+]|\{[^}]*\})?", re.S)


def needed(pattern: str) -> tuple[bool, list[str]]:
    """What each match of a pattern holds: whether a digit, and one of these lower-case strings (none: nothing is known)."""
    digit, runs, choices = False, [""], []
    for atom, times in _ATOMS.findall(pattern.replace(START, "[-]").replace(END, "[-]")):
        if atom == "|":
            return False, []
        if len(atom) == 1 and atom not in ".^$" or atom[0] == "\\" and not atom[1].isalnum():
            runs = runs + [""] if times else [*runs[:-1], runs[-1] + atom[-1]]
            continue
        digit |= atom == r"\d" and not times.startswith(("?", "*", "{0"))
        if atom.startswith("(?:") and not times and re.fullmatch(r"[\w|]+", atom[3:-1]):
            choices = choices or atom[3:-1].split("|")
        runs.append("")
    longest = max(runs, key=len).lower()
    return digit, [longest] if longest else choices


class Look(NamedTuple):
    """What is known of a text before patterns are searched: in lower case, whether it has an ASCII digit, whether it has a letter of ODD."""

    low: Column
    digits: Column
    odd: Column

    def may_match(self, each: list[str]) -> Column:
        """False only where no pattern matches, whatever the case."""
        tests, plain = [], []
        for digit, strings in map(needed, each):
            if not digit and not strings:
                return F.lit(True)
            if digit:
                tests.append(self.digits & holds(self.low, strings) if strings else self.digits)
            else:
                plain += strings
        return reduce(lambda a, b: a | b, [*([holds(self.low, plain)] if plain else []), *tests, self.odd])


def found(text: Column, table: dict[str, list[str]], locale: Column | None = None, look: Look | None = None) -> Column:
    """Does the text match the table's patterns of this locale?  One search, by the locale's pattern; none where look rules it out."""
    each = patterns(table)
    given = F.coalesce(text, F.lit(""))

    def search(name: str) -> Column:
        match = given.rlike(f"(?iu){each[name]}")
        return match if look is None else look.may_match(table["default"] + (table[name] if name != "default" else [])) & match

    own = [name for name in each if name != "default"] if locale is not None else []
    cases = None
    for name in own:
        cases = (F if cases is None else cases).when(locale == name, search(name))
    return search("default") if cases is None else cases.otherwise(search("default"))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("long")


def with_headings(text: Column, headings: Column) -> Column:
    return F.concat_ws(" ", text, F.array_join(headings, " "))


def answer_first(text: Column, locale: Column) -> Column:
    """At least 20 tokens, of which the first 80 hold an answering phrase."""
    given = F.coalesce(text, F.lit(""))
    head = F.regexp_replace(F.lower(F.regexp_extract(given, r"^\s*+((?:\S++\s*+){1,80})", 1)), r"\s+", " ")
    phrase = lambda h: found(h, ANSWERS, locale, Look(h, F.lit(True), holds(h, ODD)))
    return given.rlike(r"^\s*+(?:\S++\s++){19}\S") & once(head, phrase)


def looks(text: Column, headings: Column) -> dict[str, Column]:
    """Columns that signals reads where they are computed already; text is not null."""
    odd = holds(text, ODD) | holds(F.array_join(headings, " "), ODD)
    return {"low_text": F.lower(text), "low_headings": F.lower(F.array_join(headings, " ")), "has_digits": text.rlike("[0-9]"), "has_odd": odd}


def signals(text: Column, headings: Column, locale: Column, known: dict[str, Column] | None = None) -> dict[str, Column]:
    """The signal columns of a text with its heading texts; known: the columns of looks, by which most searches are saved."""
    both = with_headings(text, headings)
    look = None if known is None else Look(known["low_text"], known["has_digits"], known["has_odd"])
    # digits of headings are not known, and no pattern that headings are searched for needs one
    beside = lambda low: None if known is None else Look(F.concat_ws(" ", low, known["low_headings"]), F.lit(True), known["has_odd"])
    begin = lambda n: None if known is None else beside(F.substring(known["low_text"], 1, n))
    whole = None if known is None else beside(known["low_text"])
    return {
        "has_faq": found(both, FAQ, locale, whole),
        "has_author": found(text, AUTHOR, locale, look),
        "has_publish_date": found(text, DATE, locale, look),
        "has_quantified_data": found(text, QUANTIFIED, None, look),
        "has_reference_section": found(both, REFERENCES, locale, whole),
        "has_inline_citations": found(text, CITATIONS, None, look),
        "has_tldr": found(with_headings(F.substring(text, 1, 1200), headings), SUMMARY, locale, begin(1200)),
        "has_update_log": found(with_headings(F.substring(text, 1, 1600), headings), UPDATES, locale, begin(1600)),
        "answer_first": answer_first(text, locale),
    }


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORDS), F.lit(0))


def lexical_ratio(text: Column) -> Column:
    return variety(words(text))


def variety(words: Column) -> Column:
    """Different lower-case words of three characters or more over all words."""
    unlike = F.size(F.array_distinct(F.transform(F.array_distinct(F.filter(words, lambda w: F.length(w) > 2)), lambda w: F.lower(w))))
    return unlike.cast("double") / F.greatest(F.size(words), F.lit(1)).cast("double")


def information_density(words: Column, lexical: Column, quantified: Column, headings: Column) -> Column:
    by_words = F.when(words >= 180, 30).when(words >= 90, 20).when(words >= 40, 10).otherwise(0)
    by_variety = F.when(lexical >= 0.45, 25).when(lexical >= 0.30, 18).when(lexical >= 0.20, 10).otherwise(0)
    by_headings = F.when(headings >= 4, 20).when(headings >= 2, 10).otherwise(0)
    return F.least(F.lit(100), by_words + by_variety + F.when(quantified, 25).otherwise(0) + by_headings)


def chunk_structure(words: Column, headings: Column, first_level: Column) -> Column:
    average = words.cast("double") / (headings + 1).cast("double")
    by_size = F.when(average.between(60, 220), 30).when(average.between(35, 280), 20).otherwise(10)
    full = 30 + F.when(headings >= 4, 30).when(headings >= 2, 20).otherwise(0) + by_size + F.when(first_level == "h1", 10).otherwise(0)
    return F.when(headings == 0, 20).otherwise(F.least(F.lit(100), full))


def heading_quality(levels: Column, texts: Column) -> Column:
    """100 less 25 without h1 first, 20 for a skipped level, 20 under three headings, 10 for repeats; 0 without headings."""
    numbers = F.transform(levels, lambda v: F.substring(v, 2, 1).cast("int"))
    skips = F.exists(F.zip_with(F.slice(numbers, 2, 1 << 20), F.slice(numbers, 1, F.greatest(F.size(numbers) - 1, F.lit(0))), lambda b, a: b - a > 1), lambda x: F.coalesce(x, F.lit(False)))
    lowered = F.transform(texts, lambda t: F.lower(F.trim(t)))
    value = 100 - F.when(F.get(levels, F.lit(0)) != "h1", 25).otherwise(0) - F.when(skips, 20).otherwise(0) - F.when(F.size(levels) < 3, 20).otherwise(0) - F.when(F.size(F.array_distinct(lowered)) != F.size(levels), 10).otherwise(0)
    return F.when(F.size(levels) == 0, 0).otherwise(F.greatest(F.lit(0), value))


def descriptive(labels: Column, locale: Column) -> Column:
    """How many link labels are descriptive: not generic, and two words or 12 characters long."""
    plain = F.transform(labels, lambda t: F.trim(F.regexp_replace(F.lower(t), r"\s+", " ")))

    def counts(generic: list[str]) -> Column:
        known = F.array(*map(F.lit, generic))
        return F.size(F.filter(plain, lambda t: ~F.array_contains(known, t) & ((F.regexp_count(t, F.lit(WORDS)) >= 2) | (F.length(t) >= 12))))

    out = counts(GENERIC_ANCHORS["default"])
    for name in ("de", "nl", "fr"):
        out = F.when(locale == name, counts(GENERIC_ANCHORS["default"] + GENERIC_ANCHORS[name])).otherwise(out)
    return out


def link_score(internal: Column, internal_ratio: Column, external: Column, external_ratio: Column) -> Column:
    raw = internal_ratio * 45.0 + external_ratio * 35.0 + (F.least(internal, F.lit(8)) * 2).cast("double") + F.least(external, F.lit(4)).cast("double")
    return F.least(F.lit(100), F.bround(raw, 0).cast("int"))


def company_name(title: Column) -> Column:
    """What follows the last | or - of a title that has one."""
    last = F.trim(F.element_at(F.split(title, r"[|-]"), -1))
    return F.when(title.rlike(r"[|-]") & (last != ""), last)


def mentions(low: Column, name: Column) -> Column:
    """How often name stands in a lower-case text, case aside, without overlaps."""
    key = F.lower(name)
    return F.when(F.length(key) > 0, ((F.length(low) - F.length(F.replace(low, key, F.lit("")))) / F.length(key)).cast("long")).otherwise(0)


def business_type(text: Column) -> Column:
    low = F.lower(text)
    out = None
    for name, words in BUSINESS_TYPES.items():
        out = (F if out is None else out).when(holds(low, words), name)
    return out.otherwise("general_business")


def entity_signals(text: Column, title: Column, low: Column | None = None, digits: Column | None = None) -> dict[str, Column]:
    """low, digits: the text in lower case and whether it has an ASCII digit, where they are computed already."""
    low = F.lower(F.coalesce(text, F.lit(""))) if low is None else low
    digits = low.rlike("[0-9]") if digits is None else digits
    name = company_name(title)
    return {
        "detected_company_name": name,
        "company_name_detected": name.isNotNull(),
        "address_detected": digits & low.rlike(f"(?iu){ADDRESS}"),
        "phone_detected": digits & low.rlike(PHONE),
        "email_detected": low.contains("@") & low.rlike(f"(?iu){EMAIL}"),
        "awards_detected": holds(low, AWARDS),
        "certifications_detected": holds(low, CERTIFICATES),
        "homepage_brand_mentions": mentions(low, name),
    }
