"""URL and locale functions: Column -> Column, on strings only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelens.functions.text import holds

# Path keywords of the URL types, first match wins.
URL_TYPES = {
    "blog": ("blog", "news", "article", "insights", "posts", "actualites", "nieuws", "artikel", "artikelen"),
    "product": ("product", "products", "item", "sku", "shop", "pricing", "produit", "produits", "produkt", "winkel"),
    "docs": ("docs", "documentation", "guide", "manual", "kb", "knowledge-base", "gids", "handleiding", "dokumentation"),
    "faq": ("faq", "faqs", "help", "support", "vragen", "hilfe", "aide"),
    "about": ("about", "company", "team", "story", "关于", "uber-uns", "ueber-uns", "a-propos", "apropos", "over-ons"),
    "contact": ("contact", "联系我们", "联系", "kontakt", "contactez", "nous-contacter", "neem-contact"),
    "case_study": ("case", "study", "portfolio", "success", "案例", "fallstudie", "referenz", "etude-de-cas", "klantverhaal"),
    "category": ("category", "categories", "collections", "topics", "tag"),
    "landing": ("landing", "solution", "solutions", "service", "services", "dienst", "diensten", "leistung", "leistungen"),
}
# Discovery priority of the URL types.
PRIORITY = {"homepage": 0, "about": 10, "contact": 10, "landing": 10, "product": 20, "blog": 20, "docs": 20, "faq": 20, "case_study": 20}

PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def normalize_url(url: Column) -> Column:
    """Trimmed, https:// by default, scheme and host in lower case, no fragment, / for an empty path; empty gives null."""
    trimmed = F.trim(url)
    full = F.when(trimmed.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), trimmed).otherwise(F.concat(F.lit("https://"), trimmed))
    path = F.regexp_extract(full, PARTS, 3)
    query = F.regexp_extract(full, PARTS, 4)
    joined = F.concat(F.lower(F.regexp_extract(full, PARTS, 1)), F.lit("://"), F.lower(F.regexp_extract(full, PARTS, 2)), F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(trimmed != "", joined)


def scheme(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 1)


def host(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, PARTS, 2), r"^.*@|:\d*$", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 3)


def segments(url: Column) -> Column:
    return F.filter(F.split(F.lower(path(url)), "/"), lambda s: s != "")


def is_locale(segment: Column) -> Column:
    """Two letters, or two and two joined by - or _."""
    return segment.rlike(r"^\p{L}{2}([-_]\p{L}{2})?$")


def base_locale(locale: Column) -> Column:
    lowered = F.regexp_replace(F.lower(F.trim(locale)), "_", "-")
    return F.when(lowered != "", F.element_at(F.split(lowered, "-"), 1))


def path_locale(url: Column) -> Column:
    first = F.get(segments(url), F.lit(0))
    return F.when(is_locale(first), F.regexp_replace(first, "_", "-"))


def subdomain_locale(url: Column) -> Column:
    labels = F.split(host(url), r"\.")
    return F.when((F.size(labels) >= 3) & is_locale(labels[0]), F.regexp_replace(labels[0], "_", "-"))


def explicit_locale(url: Column) -> Column:
    return F.coalesce(path_locale(url), subdomain_locale(url))


def site_root(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), F.regexp_extract(url, PARTS, 2))


def scope_prefix(url: Column) -> Column:
    return F.when(path_locale(url).isNotNull(), F.concat(F.lit("/"), F.get(segments(url), F.lit(0)), F.lit("/"))).otherwise("/")


def scope_root(url: Column) -> Column:
    return F.concat(site_root(url), scope_prefix(url))


def registered_domain(url: Column) -> Column:
    """Last two labels, three under a two-part public suffix such as co.uk; IP addresses whole."""
    name = host(url)
    labels = F.split(name, r"\.")
    two_part = name.rlike(r"\.(co|com|org|net|ac|gov|edu)\.[a-z]{2}$")
    kept = F.when(two_part, F.lit(3)).otherwise(F.lit(2))
    tail = F.when(F.size(labels) <= kept, name).otherwise(F.array_join(F.slice(labels, -kept, kept), "."))
    return F.when(name.rlike(r"^[0-9.]+$"), name).otherwise(tail)


def site_id(url: Column) -> Column:
    return F.sha2(F.concat_ws("|", registered_domain(url), scope_root(url)), 256)


def hash_key(*parts: Column) -> Column:
    """SHA-256 of the trimmed lower-case parts that are not empty, joined by |."""
    kept = F.filter(F.array(*[F.lower(F.trim(p)) for p in parts]), lambda p: p.isNotNull() & (p != ""))
    return F.sha2(F.array_join(kept, "|"), 256)


def is_internal(url: Column, base: Column) -> Column:
    """Same host and, where the base has a locale path, under it."""
    return is_inside(url, host(base), scope_prefix(base))


def is_inside(url: Column, base_host: Column, prefix: Column) -> Column:
    """is_internal, of a base whose host and scope prefix are known; the scope's root counts with and without its last slash."""
    whole = F.lower(path(url))
    return (host(url) == base_host) & ((prefix == "/") | F.startswith(whole, prefix) | (F.concat(whole, F.lit("/")) == prefix))


def is_likely_homepage(url: Column) -> Column:
    found = segments(url)
    return (F.size(found) == 0) | ((F.size(found) == 1) & is_locale(F.get(found, F.lit(0))))


def url_type(url: Column) -> Column:
    whole = F.lower(path(url))
    out = F.when(F.size(segments(url)) == 0, "homepage")
    for name, words in URL_TYPES.items():
        out = out.when(holds(whole, words), name)
    return out.otherwise("page")


def priority(kind: Column) -> Column:
    out = F.lit(50)
    for value in sorted(set(PRIORITY.values()), reverse=True):
        out = F.when(kind.isin([k for k, v in PRIORITY.items() if v == value]), value).otherwise(out)
    return out


def entry_candidates(url: Column) -> Column:
    """Up to four scheme and www variants, the given first."""
    name, rest = F.regexp_extract(url, PARTS, 2), path(url)
    other = F.when(F.startswith(name, F.lit("www.")), F.substring(name, 5, 1 << 20)).otherwise(F.concat(F.lit("www."), name))
    other_scheme = F.when(scheme(url) == "https", "http").otherwise("https")
    make = lambda s, h: F.concat(s, F.lit("://"), h, rest)
    return F.array_distinct(F.array(make(scheme(url), name), make(scheme(url), other), make(other_scheme, name), make(other_scheme, other)))


def folder(url: Column) -> Column:
    """Scheme, host and path up to its last slash."""
    return F.concat(site_root(url), F.regexp_replace(path(url), r"[^/]*$", ""))


def absolute(href: Column, base: Column) -> Column:
    """href against base: absolute, //host, /path, ?query, #fragment and plain relative paths; dot segments are resolved for ./ and one ../ a step."""
    return resolved(href, base, site_root(base), folder(base))


def resolved(href: Column, url: Column, root: Column, under: Column) -> Column:
    """absolute, of a base whose root and folder are known."""
    joined = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(F.substring_index(root, "//", 1), href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, href))
        .when(F.startswith(href, F.lit("?")) | F.startswith(href, F.lit("#")) | (href == ""), F.concat(F.regexp_replace(url, r"[?#].*$", ""), href))
        .otherwise(F.concat(under, href))
    )
    return F.when(joined.contains("/."), F.regexp_replace(F.regexp_replace(joined, r"/\./", "/"), r"/[^/.]+/\.\./", "/")).otherwise(joined)


def is_public(url: Column) -> Column:
    """http(s), no credentials, not localhost and not a private address; names are not resolved."""
    name = host(url)
    private = name.rlike(r"^(localhost|.*\.localhost|0\..*|10\..*|127\..*|169\.254\..*|192\.168\..*|172\.(1[6-9]|2\d|3[01])\..*|\[?(::1|f[cd].*|fe80.*)\]?)$")
    return scheme(url).isin("http", "https") & ~F.regexp_extract(url, PARTS, 2).contains("@") & (name != "") & ~private
