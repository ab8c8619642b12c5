"""Pieces of the equivalent SQL that tests run on another engine."""

from __future__ import annotations

from lumenpage.config import lexicons as L

SPACE = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
WORD = r"[A-Za-z0-9][A-Za-z0-9''’\-]*"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strings(xs) -> str:
    return "[" + ", ".join(q(x) for x in xs) + "]"


def ws(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{SPACE}', ' ', 'g'))"


def sentences(x: str) -> str:
    t = ws(x)
    for a in L.ABBREVIATIONS:
        t = f"replace({t}, {q(a)}, {q(a.replace('.', '․'))})"
    t = rf"regexp_replace({t}, '(\d)\.(\d)', '\1․\2', 'g')"
    t = rf"""regexp_replace({t}, '([.!?])["'')\]]*\s+(["''(\[]?[A-Z0-9#$])', '\1' || chr(1) || '\2', 'g')"""
    return f"list_filter(list_transform(string_split({t}, chr(1)), lambda s: trim(replace(s, '․', '.'))), lambda s: s <> '')"


def tokens(x: str) -> str:
    return f"regexp_extract_all(coalesce({x}, ''), '{WORD}')"


def terms(x: str) -> str:
    return f"list_filter(list_transform({tokens(x)}, lambda w: lower(w)), lambda w: length(w) > 2 AND NOT list_contains({strings(L.STOPWORDS)}, w))"


def stem(w: str) -> str:
    cases = " ".join(f"WHEN ends_with(lower({w}), '{s}') AND length({w}) - {len(s)} >= 4 THEN left(lower({w}), length({w}) - {len(s)})" for s in L.SUFFIXES)
    return f"CASE {cases} ELSE lower({w}) END"


def stems(x: str) -> str:
    return f"list_distinct(list_transform({terms(x)}, lambda w: {stem('w')}))"


def like(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def one_of(patterns: list[str]) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


HOST = r"coalesce(nullif(regexp_replace(regexp_replace(regexp_extract(lower(trim({0})), '^(?:[a-z][a-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:\s]*)', 1), '\.$', ''), '^www\.', ''), ''), '')"


def host(x: str) -> str:
    return HOST.replace("{0}", x)


def domain(x: str) -> str:
    h = host(x)
    p = f"string_split({h}, '.')"
    two, three = f"array_to_string({p}[-2:], '.')", f"array_to_string({p}[-3:], '.')"
    return f"CASE WHEN len({p}) <= 2 THEN {h} WHEN list_contains({strings(L.TWO_PART_SUFFIXES)}, {two}) THEN {three} ELSE {two} END"


DOCS = "(SELECT DISTINCT * EXCLUDE (notes) FROM fx_document)"
