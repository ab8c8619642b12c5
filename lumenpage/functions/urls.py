"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def site_host(url: Column) -> Column:
    """Host in lower case without credentials, port, final dot and one leading "www."; NULL where the URL is missing."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:\s]*)", 1)
    return F.nullif(F.regexp_replace(F.regexp_replace(host, r"\.$", ""), r"^www\.", ""), F.lit(""))


def hostname(url: Column) -> Column:
    """As site_host, with the empty text for a missing host."""
    return F.coalesce(site_host(url), F.lit(""))


def normalize_url(url: Column) -> Column:
    """Trimmed, https where no scheme is given, "/" where no path is, without fragment; the empty text stays empty."""
    u = F.trim(F.coalesce(url, F.lit("")))
    full = F.when(F.regexp_like(u, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*://")), u).otherwise(F.concat(F.lit("https://"), u))
    bare = F.regexp_replace(full, r"#.*$", "")
    rooted = F.regexp_replace(bare, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?]+)(\?|$)", "$1/$2")
    lowered = F.concat(F.lower(F.regexp_extract(rooted, r"^([A-Za-z][A-Za-z0-9+.\-]*)", 1)), F.regexp_replace(rooted, r"^[A-Za-z][A-Za-z0-9+.\-]*", ""))
    return F.when(u == "", u).otherwise(lowered)


def registrable_domain(url: Column) -> Column:
    from lumenpage.config.lexicons import TWO_PART_SUFFIXES

    parts = F.split(hostname(url), r"\.")
    last = lambda n: F.array_join(F.slice(parts, -n, n), ".")
    return F.when(F.size(parts) <= 2, hostname(url)).when(last(2).isin(TWO_PART_SUFFIXES), last(3)).otherwise(last(2))


def same_site(a: Column, b: Column) -> Column:
    return (registrable_domain(a) != "") & (registrable_domain(a) == registrable_domain(b))


def domain_stem(url: Column) -> Column:
    return F.split(registrable_domain(url), r"\.")[0]


def extract_urls(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"((?i:https?)://[^\s<>\")\]]+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:]+$", "")))


def link_domain(href: Column) -> Column:
    """Host part of an absolute link as written: lower case, one leading "www." dropped, port kept."""
    return F.regexp_replace(F.lower(F.get(F.split(href, "/"), F.lit(2))), r"^www\.", "")


def classify_source(url: Column, website: Column, rivals: Column) -> Column:
    """own_site, competitor_site, the first rule that matches the host, or other_web. `rivals` is an array of domains."""
    from lumenpage.config.lexicons import SOURCE_RULES

    host, dom = hostname(url), registrable_domain(url)
    padded = F.concat(F.lit("."), host, F.lit("."))
    known = F.when(host == "", "other_web").when(same_site(url, website), "own_site").when(F.exists(rivals, lambda r: registrable_domain(r) == dom), "competitor_site")
    for kind, needles in SOURCE_RULES:
        hit = None
        for n in needles:
            one = F.contains(padded if n.startswith(".") or n.endswith(".") else host, F.lit(n))
            hit = one if hit is None else hit | one
        known = known.when(hit, kind)
    return known.otherwise("other_web")
