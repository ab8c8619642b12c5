"""Queries of the text, URL, query and tagging functions over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenpage.config import lexicons as L
from lumenpage.functions import queries as qf
from lumenpage.functions import tags, text, urls
from lumenpage.plans import sql as S
from lumenpage.sources import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def over_documents(name: str, columns: Callable[[], dict[str, Column]], sql: dict[str, str] | None) -> None:
    """Register a query of expressions over every document record. Only results are shuffled to fold repeated rows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = read_table(spark, sf_dir, "fx_document")
        return d.select(F.col("doc_id"), *[c.alias(k) for k, c in columns().items()]).dropDuplicates(["doc_id"])

    QUERIES[name] = run
    if sql:
        SQL[name] = f"SELECT DISTINCT doc_id, {', '.join(f'{v} AS {k}' for k, v in sql.items())} FROM fx_document"


def over_queries(name: str, columns: Callable[[], dict[str, Column]], sql: dict[str, str] | None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return read_table(spark, sf_dir, "fx_query").select("query_id", *[c.alias(k) for k, c in columns().items()]).distinct()

    QUERIES[name] = run
    if sql:
        SQL[name] = f"SELECT DISTINCT query_id, {', '.join(f'{v} AS {k}' for k, v in sql.items())} FROM fx_query"


joined = lambda c: F.md5(F.array_join(c, "\n"))
sjoined = lambda x: f"md5(array_to_string({x}, chr(10)))"
n = lambda c: F.size(c).cast("bigint")

over_documents("t1_normalize_ws", lambda: {"norm": F.md5(text.normalize_ws(F.col("text"))), "chars": F.length(text.normalize_ws(F.col("text"))).cast("bigint")}, {"norm": f"md5({S.ws('text')})", "chars": f"length({S.ws('text')})"})
over_documents("t2_sentences", lambda: {"sentences": n(text.sentences(F.col("text"))), "digest": joined(text.sentences(F.col("text")))}, {"sentences": f"len({S.sentences('text')})", "digest": sjoined(S.sentences("text"))})
over_documents("t3_tokens", lambda: {"words": text.word_count(F.col("text")).cast("bigint"), "digest": joined(text.tokens(F.col("text")))}, {"words": f"len({S.tokens('text')})", "digest": sjoined(S.tokens("text"))})
over_documents(
    "t4_blank_words",
    lambda: {"words": n(text.blank_words(F.col("text"))), "first100": joined(F.slice(text.blank_words(F.col("text")), 1, 100))},
    {"words": f"CASE WHEN {S.ws('text')} = '' THEN 0 ELSE len(string_split({S.ws('text')}, ' ')) END", "first100": f"md5(CASE WHEN {S.ws('text')} = '' THEN '' ELSE array_to_string(string_split({S.ws('text')}, ' ')[1:100], chr(10)) END)"},
)
over_documents("t5_content_terms", lambda: {"terms": n(text.content_terms(F.col("text"))), "digest": joined(text.content_terms(F.col("text")))}, {"terms": f"len({S.terms('text')})", "digest": sjoined(S.terms("text"))})
over_documents("t7_stem_set", lambda: {"stems": n(text.stem_set(F.col("text"))), "digest": joined(F.sort_array(text.stem_set(F.col("text"))))}, {"stems": f"len({S.stems('text')})", "digest": sjoined(f"list_sort({S.stems('text')})")})
over_documents(
    "t8_truncate",
    lambda: {"short": text.truncate(F.col("title"), 30)},
    {"short": f"CASE WHEN length({S.ws('title')}) <= 30 THEN {S.ws('title')} ELSE rtrim(left({S.ws('title')}, 27)) || '...' END"},
)
_at = "instr(coalesce(text, ''), 'costs')"
_low, _high = f"greatest({_at} - 1 - 140, 0)", f"least({_at} - 1 + 5 + 140, length(text))"
over_documents(
    "t9_snippet",
    lambda: {"snippet": text.snippet_around(F.col("text"), F.lit("costs"))},
    {"snippet": f"CASE WHEN {_at} > 0 THEN CASE WHEN {_low} > 0 THEN '...' ELSE '' END || {S.ws(f'substring(text, {_low} + 1, {_high} - {_low})')} || CASE WHEN {_high} < length(text) THEN '...' ELSE '' END END"},
)
_ui = "coalesce(text, '')"
for _a, _b in text.UI_MARKS.items():
    _ui = f"replace({_ui}, '{_a}', '{_b}')"
over_documents("t10_ui_clean", lambda: {"digest": F.md5(text.ui_clean(F.col("text")))}, {"digest": f"md5({_ui})"})
over_documents(
    "t12_slugify", lambda: {"slug": text.slugify(F.col("title"))}, {"slug": "coalesce(nullif(left(regexp_replace(regexp_replace(coalesce(title, ''), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 50), ''), 'entity')"}
)
over_documents("t13_stable_hash", lambda: {"digest": F.sha1(F.concat(text.text_or_empty(F.col("title")), F.lit("\x00"), text.text_or_empty(F.col("url")), F.lit("\x00")))}, {"digest": r"sha1(encode(coalesce(title, '')) || '\x00'::BLOB || encode(coalesce(url, '')) || '\x00'::BLOB)"})
_fill = lambda: sum((text.phrase_count(F.col("text"), p) for p in L.FILLER_PHRASES[1:]), text.phrase_count(F.col("text"), L.FILLER_PHRASES[0]))
_sfill = " + ".join(f"(length(lower(coalesce(text, ''))) - length(replace(lower(coalesce(text, '')), {S.q(p)}, ''))) // {len(p)}" for p in L.FILLER_PHRASES)
over_documents("t14_phrase_counts", lambda: {"fillers": _fill().cast("bigint")}, {"fillers": f"CAST({_sfill} AS BIGINT)"})
_t1000 = f"({S.terms('text')})[1:1000]"
over_documents("t15_type_token_ratio", lambda: {"ttr": F.round(text.type_token_ratio(F.col("text")), 6)}, {"ttr": f"CASE WHEN len({_t1000}) > 0 THEN round(len(list_distinct({_t1000})) / len({_t1000}), 6) ELSE 0.0 END"})
over_documents("t18_keyword_pattern", lambda: {"hits": F.regexp_count(text.text_or_empty(F.col("text")), F.lit(r"(?i)\bprice")).cast("bigint")}, {"hits": r"len(regexp_extract_all(coalesce(text, ''), '(?i)\bprice'))"})
over_documents("h1_sanitize", lambda: {"digest": F.md5(text.sanitize(F.col("text")))}, {"digest": r"md5(regexp_replace(left(coalesce(text, ''), 200000), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'))"})

over_documents("u1_normalize_url", lambda: {"normal": urls.normalize_url(F.col("url"))}, {
    "normal": r"""CASE WHEN trim(coalesce(url, '')) = '' THEN '' ELSE lower(regexp_extract(regexp_replace(CASE WHEN regexp_matches(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://') THEN trim(url) ELSE 'https://' || trim(url) END, '#.*$', ''), '^([A-Za-z][A-Za-z0-9+.\-]*)', 1))
 || regexp_replace(regexp_replace(regexp_replace(CASE WHEN regexp_matches(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://') THEN trim(url) ELSE 'https://' || trim(url) END, '#.*$', ''), '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?]+)(\?|$)', '\1/\2'), '^[A-Za-z][A-Za-z0-9+.\-]*', '') END"""
})
over_documents(
    "u2_hosts",
    lambda: {"host": urls.hostname(F.col("url")), "domain": urls.registrable_domain(F.col("url")), "stem": urls.domain_stem(F.col("url"))},
    {"host": S.host("url"), "domain": S.domain("url"), "stem": f"string_split({S.domain('url')}, '.')[1]"},
)
over_documents("u8_link_domain", lambda: {"domain": urls.link_domain(F.col("url"))}, {"domain": r"regexp_replace(lower(string_split(url, '/')[3]), '^www\.', '')"})


def _source_sql(url: str, website: str, rivals: str) -> str:
    h, d = S.host(url), S.domain(url)
    out = f"CASE WHEN {h} = '' THEN 'other_web' WHEN {S.domain(website)} <> '' AND {d} = {S.domain(website)} THEN 'own_site' WHEN len(list_filter({rivals}, lambda r: {S.domain('r')} = {d})) > 0 THEN 'competitor_site'"
    for kind, needles in L.SOURCE_RULES:
        hits = " OR ".join(f"contains('.' || {h} || '.', '{x}')" if x[0] == "." or x[-1] == "." else f"contains({h}, '{x}')" for x in needles)
        out += f" WHEN {hits} THEN '{kind}'"
    return out + " ELSE 'other_web' END"


def u7_classify_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind of source of every document, by its URL and its project's sites. Projects are of fixed number, so their side is small."""
    docs = read_table(spark, sf_dir, "fx_document").select("doc_id", "project_id", "url").distinct()
    projects = read_table(spark, sf_dir, "fx_project").select("project_id", "website", F.transform(F.coalesce("competitors", F.expr("array()")), lambda c: c["domain"]).alias("rivals")).distinct()
    return docs.join(projects, "project_id").select("doc_id", urls.classify_source(F.col("url"), F.col("website"), F.col("rivals")).alias("kind"))


QUERIES["u7_classify_source"] = u7_classify_source
SQL["u7_classify_source"] = f"""WITH p AS (SELECT DISTINCT project_id, website, list_transform(competitors, lambda c: c.domain) AS rivals FROM fx_project),
d AS (SELECT DISTINCT doc_id, project_id, url FROM fx_document) SELECT doc_id, {_source_sql('url', 'website', 'rivals')} AS kind FROM d JOIN p USING (project_id)"""


def u6_extract_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct URLs in the citation lines of every answer."""
    a = read_table(spark, sf_dir, "fx_answer").select("answer_id", F.array_join(F.coalesce("citations", F.expr("array('')")), "\n").alias("lines")).distinct()
    return a.select("answer_id", F.explode(urls.extract_urls(F.col("lines"))).alias("url"))


QUERIES["u6_extract_urls"] = u6_extract_urls
SQL["u6_extract_urls"] = r"""SELECT DISTINCT answer_id, unnest(list_transform(regexp_extract_all(array_to_string(coalesce(citations, ['']), chr(10)), '(?i:https?)://[^\s<>")\]]+'), lambda u: regexp_replace(u, '[.,;:]+$', ''))) AS url FROM fx_answer"""

_qq, _e = "lower(trim(coalesce(query, '')))", "lower(coalesce(entity, ''))"
over_queries("q1_intent", lambda: {"intent": qf.detect_intent(F.col("query"), F.col("entity"))}, {
    "intent": f"CASE WHEN {_qq} = '' THEN 'informational' WHEN {_e} <> '' AND regexp_replace(replace({_qq}, {_e}, ''), '^[ \\-:?]+|[ \\-:?]+$', '', 'g') = '' THEN 'navigational'"
    f" WHEN {S.like(_qq, qf.HOWTO)} THEN 'howto' WHEN {S.like(_qq, qf.LOCAL)} THEN 'local' WHEN {S.like(_qq, qf.BUYING)} THEN 'transactional' WHEN {S.like(_qq, qf.WEIGHING)} THEN 'commercial' ELSE 'informational' END"
})
_brk = S.strings(sorted({*L.STOPWORDS, *L.INTENT_WORDS}))
_runs = f"list_filter(list_transform(string_split(array_to_string(list_transform({S.tokens('query')}, lambda w: CASE WHEN list_contains({_brk}, lower(w)) THEN '|' ELSE lower(w) END), ' '), '|'), lambda r: trim(r)), lambda r: r <> '')"
over_queries("q2_phrases", lambda: {"phrases": F.array_join(qf.query_phrases(F.col("query")), "; ")}, {"phrases": f"array_to_string(list_transform({_runs}, lambda r: array_to_string(string_split(r, ' ')[-3:], ' '))[1:3], '; ')"})
_kept = f"list_filter({S.terms('query')}, lambda w: NOT list_contains({S.strings(L.INTENT_WORDS)}, w))"
_stem_w, _stem_x = S.stem("w"), S.stem("x")
over_queries("q3_terms", lambda: {"terms": F.array_join(qf.query_terms(F.col("query")), " ")}, {
    "terms": f"array_to_string(list_filter({_kept}, lambda w, i: list_position(list_transform({_kept}, lambda x: {_stem_x}), {_stem_w}) = i), ' ')"
})


def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document, how many sentences carry each kind of tag."""
    d = read_table(spark, sf_dir, "fx_document").select("doc_id", text.sentences(F.col("text")).alias("s"))
    count = lambda f: F.size(F.filter("s", f)).cast("bigint")
    fact = lambda k: lambda s: tags.has_fact(s, k)
    cols = {f"fact_{k}": count(fact(k)) for k in L.FACTS}
    cols |= {"claims": count(tags.is_claim), "attributed": count(tags.is_attributed), "recommending": count(tags.is_recommending), "informative": count(tags.is_informative), "dependent": count(tags.opens_dependent), "questions": count(tags.is_question), "markers": count(tags.has_marker)}
    return d.select("doc_id", *[c.alias(k) for k, c in cols.items()]).dropDuplicates(["doc_id"])


def _tag_sql() -> str:
    claim = " OR ".join(S.like("s", p) for p in [S.one_of(L.SUPERLATIVES), *(L.FACTS[k] for k in L.CLAIM_FACTS)])
    conds = {f"fact_{k}": S.like("s", p) for k, p in L.FACTS.items()} | {
        "claims": claim, "attributed": S.like("s", S.one_of(L.ATTRIBUTION)), "recommending": S.like("s", S.one_of(L.RECOMMENDATION)), "informative": S.like("s", "[0-9]|[a-z,;] [A-Z][a-zA-Z]{2,}"),
        "dependent": S.like("trim(s)", "(?i)" + L.DEPENDENT_OPENER), "questions": f"ends_with(trim(s), '?') OR {S.like('trim(s)', '(?i)' + L.QUESTION_START)}", "markers": S.like("s", "(?i)" + L.INLINE_MARKER),
    }
    cols = ", ".join(f"len(list_filter(ss, lambda s: {c})) AS {k}" for k, c in conds.items())
    return f"WITH d AS (SELECT DISTINCT doc_id, {S.sentences('text')} AS ss FROM fx_document) SELECT doc_id, {cols} FROM d"


QUERIES["g_tag_counts"] = tag_counts
SQL["g_tag_counts"] = _tag_sql()


def t16_bigram_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document, the 12 most frequent pairs of neighbouring unequal content terms, those seen twice or more, at most 8; ties by the pair."""
    d = read_table(spark, sf_dir, "fx_document").select("doc_id", text.content_terms(F.col("text")).alias("w")).distinct()
    pairs = F.filter(F.transform(F.arrays_zip(F.slice("w", 1, 1_000_000).alias("a"), F.slice("w", 2, 1_000_000).alias("b")), lambda p: F.when(p["b"].isNotNull() & (p["a"] != p["b"]), F.concat_ws(" ", p["a"], p["b"]))), lambda p: p.isNotNull())
    c = d.select("doc_id", F.explode(pairs).alias("pair")).groupBy("doc_id", "pair").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    from pyspark.sql import Window

    ranked = c.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("n").desc(), "pair")))
    return ranked.where("rank <= 8").select("doc_id", "pair", "n", F.col("rank").cast("bigint"))


QUERIES["t16_bigram_topics"] = t16_bigram_topics
SQL["t16_bigram_topics"] = f"""WITH d AS (SELECT DISTINCT doc_id, {S.terms('text')} AS w FROM fx_document),
p AS (SELECT doc_id, unnest(list_filter(list_transform(w, lambda x, i: CASE WHEN i < len(w) AND x <> w[i + 1] THEN x || ' ' || w[i + 1] END), lambda x: x IS NOT NULL)) AS pair FROM d),
c AS (SELECT doc_id, pair, count(*) AS n FROM p GROUP BY ALL HAVING count(*) >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pair) AS rank FROM c) SELECT doc_id, pair, n, rank FROM r WHERE rank <= 8"""
