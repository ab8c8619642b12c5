"""Text functions as Column expressions, all inside code generation. NULL counts as the empty text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenpage.config.lexicons import ABBREVIATIONS, STOPWORDS, SUFFIXES

WORD = r"[A-Za-z0-9][A-Za-z0-9'’\-]*"
DOT, CUT = "․", "\x01"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def normalize_ws(c: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(text_or_empty(c), r"(?U)\s+", " "))


def sentences(c: Column) -> Column:
    """Sentences in order. A stop ends one if a capital, digit, # or $ follows; known abbreviations and decimals don't."""
    t = normalize_ws(c)
    for a in ABBREVIATIONS:
        t = F.replace(t, F.lit(a), F.lit(a.replace(".", DOT)))
    t = F.regexp_replace(t, r"(\d)\.(\d)", f"$1{DOT}$2")
    t = F.regexp_replace(t, r"([.!?])[\"')\]]*\s+([\"'(\[]?[A-Z0-9#$])", f"$1{CUT}$2")
    parts = F.transform(F.split(t, CUT), lambda s: F.trim(F.replace(s, F.lit(DOT), F.lit("."))))
    return F.filter(parts, lambda s: s != "")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(text_or_empty(c), F.lit(f"({WORD})"), F.lit(1))


def word_count(c: Column) -> Column:
    return F.regexp_count(text_or_empty(c), F.lit(WORD))


def blank_words(c: Column) -> Column:
    """Words between white space."""
    t = normalize_ws(c)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def content_terms(c: Column) -> Column:
    return F.filter(F.transform(tokens(c), F.lower), lambda w: (F.length(w) > 2) & ~w.isin(STOPWORDS))


def light_stem(w: Column) -> Column:
    """The word in lower case without the first of the known suffixes that leaves four letters."""
    low = F.lower(w)
    out = None
    for s in SUFFIXES:
        hit = F.endswith(low, F.lit(s)) & (F.length(low) - len(s) >= 4)
        cut = F.substring(low, F.lit(1), F.length(low) - len(s))
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return out.otherwise(low)


def stem_set(c: Column) -> Column:
    return F.array_distinct(F.transform(content_terms(c), light_stem))


def truncate(c: Column, n: int = 160) -> Column:
    t = normalize_ws(c)
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, n - 3)), F.lit("...")))


def snippet_around(c: Column, needle: Column, radius: int = 140) -> Column:
    """The neighbourhood of the first occurrence of `needle`; NULL without one."""
    t = text_or_empty(c)
    at = F.call_function("instr", t, needle)
    low = F.greatest(at - 1 - radius, F.lit(0))
    high = F.least(at - 1 + F.length(needle) + radius, F.length(t))
    body = normalize_ws(F.substring(t, low + 1, high - low))
    return F.when(at > 0, F.concat(F.when(low > 0, "...").otherwise(""), body, F.when(high < F.length(t), "...").otherwise("")))


# Characters that user-facing text replaces.
UI_MARKS = {"—": ", ", "–": "-", "―": "-", "‒": "-", "→": "to", "←": "from", "⇒": "to", "➔": "to", "➜": "to", "⮕": "to", "⇔": "and", "↔": "and"}
PRINT_MARKS = {"‘": "'", "’": "'", "“": '"', "”": '"', "…": "...", " ": " ", "•": "-", "·": "-"}


def ui_clean(c: Column) -> Column:
    t = text_or_empty(c)
    for a, b in UI_MARKS.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def sanitize(c: Column, limit: int = 200_000) -> Column:
    return F.regexp_replace(F.substring(text_or_empty(c), 1, limit), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def slugify(c: Column, default: str = "entity") -> Column:
    s = F.regexp_replace(F.regexp_replace(text_or_empty(c), r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", "")
    return F.coalesce(F.nullif(F.substring(s, 1, 50), F.lit("")), F.lit(default))


def phrase_count(c: Column, phrase: str) -> Column:
    """Non-overlapping occurrences of a phrase in the lower-cased text."""
    low = F.lower(text_or_empty(c))
    return F.floor((F.length(low) - F.length(F.replace(low, F.lit(phrase), F.lit("")))) / len(phrase))


def type_token_ratio(c: Column, first: int = 1000) -> Column:
    t = F.slice(content_terms(c), 1, first)
    return F.when(F.size(t) > 0, F.size(F.array_distinct(t)) / F.size(t)).otherwise(0.0)
