"""Predicates on sentences, headings and lines, by fixed patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenpage.config import lexicons as L


def one_of(patterns: list[str]) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def is_question(c: Column) -> Column:
    t = F.trim(c)
    return F.endswith(t, F.lit("?")) | F.regexp_like(t, F.lit("(?i)" + L.QUESTION_START))


def opens_dependent(c: Column) -> Column:
    return F.regexp_like(F.trim(c), F.lit("(?i)" + L.DEPENDENT_OPENER))


# What a sentence must hold for a kind of fact, found without backtracking; most sentences stop here.
HOLDS = {
    "currency": "[0-9]", "date": "[0-9][0-9]", "measurement": "[0-9]", "quantity": "[0-9]", "definition": r"\s(?:is|are|refers to|means|stands for)\s(?:a|an|the)\b", "comparison": "(?i)than|compared|versus|vs",
    "named_organisation": r"\s(?:" + "|".join(s.capitalize() for s in L.ORG_SUFFIXES) + r")\b",
}


def has_fact(c: Column, kind: str) -> Column:
    held = F.contains(c, F.lit("%")) if kind == "percentage" else F.regexp_like(c, F.lit(HOLDS[kind]))
    return held & F.regexp_like(c, F.lit(L.FACTS[kind]))


def fact_kinds(c: Column) -> Column:
    return F.array_compact(F.array(*[F.when(has_fact(c, k), F.lit(k)) for k in L.FACTS]))


def is_claim(c: Column) -> Column:
    hit = F.regexp_like(c, F.lit(one_of(L.SUPERLATIVES)))
    for k in L.CLAIM_FACTS:
        hit = hit | has_fact(c, k)
    return hit


def is_attributed(c: Column) -> Column:
    return F.regexp_like(c, F.lit(one_of(L.ATTRIBUTION)))


def is_recommending(c: Column) -> Column:
    return F.regexp_like(c, F.lit(one_of(L.RECOMMENDATION)))


def is_informative(c: Column) -> Column:
    return F.regexp_like(c, F.lit(r"[0-9]|[a-z,;] [A-Z][a-zA-Z]{2,}"))


def heads_references(c: Column) -> Column:
    return F.regexp_like(c, F.lit("(?i)" + L.REFERENCES_HEADING))


def has_marker(c: Column) -> Column:
    return F.regexp_like(c, F.lit("(?i)" + L.INLINE_MARKER))


def is_list_line(c: Column) -> Column:
    return F.regexp_like(c, F.lit(L.LIST_LINE))
