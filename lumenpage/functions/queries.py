"""Understanding of search queries, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenpage.config import lexicons as L
from lumenpage.functions.text import content_terms, light_stem, tokens

HOWTO = r"^(how (to|do|can|should)|steps to|guide to)\b"
LOCAL = r"\b(near me|nearby)\b|" + "|".join(rf"\bin {c}\b" for c in L.CITIES)
BUYING = r"\b(buy|pricing|price|cost|cheap|discount|coupon|order|subscribe|hire|quote|book)\b"
WEIGHING = r"\b(best|top|vs|versus|compare|comparison|reviews?|alternatives?|recommended|worth it|ranking)\b"


def detect_intent(query: Column, entity: Column) -> Column:
    q = F.lower(F.trim(F.coalesce(query, F.lit(""))))
    e = F.lower(F.coalesce(entity, F.lit("")))
    rest = F.regexp_replace(F.replace(q, e, F.lit("")), r"^[ \-:?]+|[ \-:?]+$", "")
    like = lambda p: F.regexp_like(q, F.lit(p))
    return (
        F.when(q == "", "informational").when((e != "") & (rest == ""), "navigational").when(like(HOWTO), "howto").when(like(LOCAL), "local")
        .when(like(BUYING), "transactional").when(like(WEIGHING), "commercial").otherwise("informational")
    )


def query_terms(query: Column) -> Column:
    """Content terms without words of purpose, the first of each stem."""
    terms = F.filter(content_terms(query), lambda w: ~w.isin(L.INTENT_WORDS))
    stems = F.transform(terms, light_stem)
    return F.filter(F.transform(terms, lambda w, i: F.when(F.array_position(stems, light_stem(w)) == i + 1, w)), lambda w: w.isNotNull())


def query_phrases(query: Column, limit: int = 3) -> Column:
    """Runs of words between stop words and words of purpose, the last three of each, the first `limit` runs."""
    breaks = sorted({*L.STOPWORDS, *L.INTENT_WORDS})
    marked = F.transform(tokens(query), lambda w: F.when(F.lower(w).isin(breaks), F.lit("|")).otherwise(F.lower(w)))
    runs = F.filter(F.transform(F.split(F.array_join(marked, " "), r"\|"), lambda r: F.trim(r)), lambda r: r != "")
    last = lambda r: F.array_join(F.slice(F.split(r, " "), F.greatest(F.size(F.split(r, " ")) - 2, F.lit(1)), 3), " ")
    return F.slice(F.transform(runs, last), 1, limit)
