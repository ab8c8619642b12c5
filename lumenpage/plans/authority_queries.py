"""Queries over external pages and answers, the roll-up of scores, and what follows from it."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenpage.config import weights as W
from lumenpage.functions import queries as qf
from lumenpage.functions import tags, text, urls
from lumenpage.operators import blocks as B
from lumenpage.operators.entities import name_pattern
from lumenpage.operators.similarity import sim_to_score
from lumenpage.plans import entity_queries as E
from lumenpage.plans import page_queries as P
from lumenpage.plans import sql as S
from lumenpage.plans.entity_queries import BLOCKS, ENT, sql_hit, sql_pattern
from lumenpage.sources import read_table, release, stage

QUERIES: dict = {}
SQL: dict[str, str] = {}
rounded = P.rounded


def query(f):
    QUERIES[f.__name__] = f
    return f


def _f(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(answer_id, project_id, rank, url, title) of every citation line that is not blank; url is '' for a bare title."""
    a = read_table(spark, sf_dir, "fx_answer").select("answer_id", "project_id", "citations").distinct()
    lines = F.filter(F.transform(F.coalesce("citations", F.expr("array()")), lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", ""))), lambda c: c != "")
    x = a.select("answer_id", "project_id", F.posexplode(lines).alias("k", "raw"))
    url = F.coalesce(F.get(urls.extract_urls(F.col("raw")), F.lit(0)), F.lit(""))
    x = x.withColumn("url", url)
    rest = F.regexp_replace(F.regexp_replace(F.replace("raw", "url", F.lit("")), r"[\s\-:|,]+$", ""), r"^[ \-:|,\[\]()]+|[ \-:|,\[\]()]+$", "")
    return x.select("answer_id", "project_id", (F.col("k") + 1).cast("bigint").alias("rank"), "url", F.when(F.col("url") == "", F.col("raw")).otherwise(rest).alias("title"))


@query
def a1_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations(spark, sf_dir).select("answer_id", "rank", "url", "title", F.when(F.col("url") == "", "").otherwise(urls.registrable_domain(F.col("url"))).alias("domain"))


_LINES = r"list_filter(list_transform(coalesce(citations, []), lambda c: trim(regexp_replace(coalesce(c, ''), '^\s+|\s+$', '', 'g'))), lambda c: c <> '')"
CITES = rf"""cl AS (SELECT DISTINCT answer_id, project_id, {_LINES} AS l FROM fx_answer), cx AS (SELECT answer_id, project_id, unnest(l) AS raw, generate_subscripts(l, 1) AS rank FROM cl),
cu AS (SELECT *, coalesce(regexp_replace(regexp_extract_all(raw, '(?i:https?)://[^\s<>")\]]+')[1], '[.,;:]+$', ''), '') AS url FROM cx),
ct AS (SELECT answer_id, project_id, rank, url, CASE WHEN url = '' THEN raw ELSE regexp_replace(regexp_replace(replace(raw, url, ''), '[\s\-:|,]+$', ''), '^[ \-:|,\[\]()]+|[ \-:|,\[\]()]+$', '', 'g') END AS title FROM cu)"""
SQL["a1_citations"] = f"WITH {CITES} SELECT answer_id, rank, url, title, CASE WHEN url = '' THEN '' ELSE {S.domain('url')} END AS domain FROM ct"


def _judged_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations with is_target: on the entity's site, or a bare title that names it."""
    e = E.entities(spark, sf_dir).select("project_id", "website", "pattern")
    c = citations(spark, sf_dir).join(e, "project_id")
    site = (F.col("url") != "") & urls.same_site(F.col("url"), F.coalesce("website", F.lit("")))
    named = (F.col("url") == "") & F.rlike("title", F.col("pattern"))
    return c.withColumn("is_target", F.coalesce(site | named, F.lit(False)))


@query
def a2_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every answer that is not blank says of its project's entity: mentions, first place in percent, kind of mention, share of mentions with a
    source, citations, those of the target, and prominence, 1 over the first rank."""
    a = read_table(spark, sf_dir, "fx_answer").where("trim(coalesce(text, '')) <> ''").select("answer_id", "project_id", "text").distinct()
    a = a.join(E.entities(spark, sf_dir).select("project_id", "pattern"), "project_id")
    hit = lambda c: F.rlike(c, F.col("pattern"))
    own = F.filter(text.sentences(F.col("text")), hit)
    x = a.select("answer_id", "project_id", "text", "pattern", F.regexp_count("text", F.col("pattern")).alias("n"), own.alias("own"), F.exists(F.split("text", "\n"), lambda s: hit(s) & tags.is_list_line(s)).alias("listed"))
    kind = F.when(F.col("n") == 0, "absent").when(F.exists("own", tags.is_recommending), "recommended").when(F.col("listed"), "listed").otherwise("mentioned")
    first = F.when(F.col("n") > 0, F.round((F.regexp_instr("text", F.col("pattern")) - 1) / F.length("text") * 100, 1))
    marked = F.when(F.size("own") > 0, F.round(F.size(F.filter("own", tags.has_marker)) / F.size("own"), 2))
    cites = _judged_citations(spark, sf_dir).groupBy("answer_id").agg(F.count(F.lit(1)).alias("citations"), F.sum(F.col("is_target").cast("int")).alias("own_citations"), F.min(F.when(F.col("is_target"), F.col("rank"))).alias("best")).hint("merge")  # a row an answer, so never broadcast
    y = x.select("answer_id", "project_id", F.col("n").cast("bigint").alias("mentions"), first.alias("first_pct"), kind.alias("kind"), marked.alias("attributable")).join(cites, "answer_id", "left")
    return y.select("answer_id", "mentions", "first_pct", "kind", "attributable", F.coalesce("citations", F.lit(0)).alias("citations"), F.coalesce("own_citations", F.lit(0)).alias("own_citations"), F.coalesce(F.round(1.0 / F.col("best"), 3), F.lit(0.0)).alias("prominence"))


from lumenpage.config import lexicons as L  # noqa: E402

_JC = f"jc AS (SELECT ct.*, coalesce((url <> '' AND {S.domain(chr(39) * 0 + 'coalesce(website, {0})'.replace('{0}', chr(39) * 2))} <> '' AND {S.domain('url')} = {S.domain('coalesce(website, {0})'.replace('{0}', chr(39) * 2))}) OR (url = '' AND {sql_hit('title')}), FALSE) AS is_target FROM ct JOIN e USING (project_id))"
SQL["a2_answers"] = f"""WITH {ENT}, {CITES}, {_JC}, a AS (SELECT DISTINCT answer_id, project_id, text FROM fx_answer WHERE trim(coalesce(text, '')) <> ''),
x AS (SELECT answer_id, text, len({sql_hit('text', 'regexp_extract_all')}) AS n, list_filter({S.sentences('text')}, lambda s: {sql_hit('s')}) AS own, len(list_filter(string_split(text, chr(10)), lambda s: {sql_hit('s')} AND {S.like('s', L.LIST_LINE)})) > 0 AS listed,
 instr(regexp_replace(text, '{E.LETTERS}', 'q', 'g'), regexp_extract(regexp_replace(text, '{E.LETTERS}', 'q', 'g'), pat)) AS spot FROM a JOIN e USING (project_id)),
c AS (SELECT answer_id, count(*) AS citations, count(*) FILTER (WHERE is_target) AS own_citations, min(rank) FILTER (WHERE is_target) AS best FROM jc GROUP BY answer_id)
SELECT x.answer_id, n AS mentions, CASE WHEN n > 0 THEN round((spot - 1) / length(text) * 100, 1) END AS first_pct, CASE WHEN n = 0 THEN 'absent' WHEN len(list_filter(own, lambda s: {S.like('s', S.one_of(L.RECOMMENDATION))})) > 0 THEN 'recommended' WHEN listed THEN 'listed' ELSE 'mentioned' END AS kind,
CASE WHEN len(own) > 0 THEN round(len(list_filter(own, lambda s: {S.like('s', '(?i)' + L.INLINE_MARKER)})) / len(own), 2) END AS attributable, coalesce(citations, 0) AS citations, coalesce(own_citations, 0) AS own_citations, coalesce(round(1.0 / best, 3), 0.0) AS prominence
FROM x LEFT JOIN c ON x.answer_id = c.answer_id"""


def rival_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(answer_id, rivals): mentions of competitors. Competitors are of fixed number."""
    p = read_table(spark, sf_dir, "fx_project").select("project_id", "competitors").distinct().select("project_id", F.explode("competitors").alias("c"))
    pats = p.select("project_id", name_pattern(F.col("c.name"), F.col("c.domain")).alias("pattern")).where("pattern is not null")
    a = read_table(spark, sf_dir, "fx_answer").where("trim(coalesce(text, '')) <> ''").select("answer_id", "project_id", "text").distinct()
    return a.join(F.broadcast(pats), "project_id").groupBy("answer_id").agg(F.sum(F.regexp_count("text", F.col("pattern"))).alias("rivals")).hint("merge")


QUERIES["a4_rivals"] = rival_mentions
SQL["a4_rivals"] = f"""WITH p AS (SELECT DISTINCT project_id, competitors FROM fx_project), c AS (SELECT project_id, unnest(competitors) AS c FROM p), e AS (SELECT project_id, {sql_pattern('c.name', 'c.domain')} AS pat FROM c),
a AS (SELECT DISTINCT answer_id, project_id, text FROM fx_answer WHERE trim(coalesce(text, '')) <> '') SELECT answer_id, CAST(sum(len({sql_hit('text', 'regexp_extract_all')})) AS BIGINT) AS rivals FROM a JOIN e USING (project_id) WHERE pat IS NOT NULL GROUP BY answer_id"""


@query
def m15_citation_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the target among its answers' citations and mentions, of every project with answers; the weights of missing parts go to the others."""
    a = a2_answers(spark, sf_dir).join(rival_mentions(spark, sf_dir), "answer_id", "left")
    a = a.join(read_table(spark, sf_dir, "fx_answer").select("answer_id", "project_id").distinct().hint("merge"), "answer_id")
    g = a.groupBy("project_id").agg(F.count(F.lit(1)).alias("answers"), F.sum("citations").alias("c"), F.sum("own_citations").alias("t"), F.sum("mentions").alias("m"), F.sum("rivals").alias("r"))
    part = lambda num, den, ok: F.when(ok & (den > 0), F.least(F.lit(100.0), num / den / 0.4 * 100))
    cite, mention = part(F.col("t"), F.col("c"), F.lit(True)), part(F.col("m"), F.col("m") + F.col("r"), F.col("r").isNotNull())
    weight = F.when(cite.isNotNull(), 0.6).otherwise(0.0) + F.when(mention.isNotNull(), 0.4).otherwise(0.0)
    score = (F.coalesce(cite, F.lit(0.0)) * 0.6 + F.coalesce(mention, F.lit(0.0)) * 0.4) / F.nullif(weight, F.lit(0.0))
    return g.select("project_id", "answers", rounded(score).alias("score"))


SQL["m15_citation_share"] = f"""WITH a AS ({SQL['a2_answers']}), r AS ({SQL['a4_rivals']}), k AS (SELECT DISTINCT answer_id, project_id FROM fx_answer),
g AS (SELECT project_id, count(*) AS answers, sum(citations) AS c, sum(own_citations) AS t, sum(mentions) AS m, sum(rivals) AS r FROM a JOIN k USING (answer_id) LEFT JOIN r USING (answer_id) GROUP BY project_id),
s AS (SELECT *, CASE WHEN c > 0 THEN least(100.0, t / c / 0.4 * 100) END AS cs, CASE WHEN r IS NOT NULL AND m + r > 0 THEN least(100.0, m / (m + r) / 0.4 * 100) END AS ms FROM g)
SELECT project_id, answers, round((coalesce(cs, 0) * 0.6 + coalesce(ms, 0) * 0.4) / nullif(CASE WHEN cs IS NULL THEN 0.0 ELSE 0.6 END + CASE WHEN ms IS NULL THEN 0.0 ELSE 0.4 END, 0.0), 4) AS score FROM s"""


def external_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every readable external page: mentions of the entity, a link to its site in the text, and whether a mention stands in title, heading or first 100 words."""
    e = E.entities(spark, sf_dir).select("project_id", "pattern", F.coalesce("website", F.lit("")).alias("website"))
    d = read_table(spark, sf_dir, "fx_document").where("kind = 'external' and ok").join(e, "project_id")
    t = text.text_or_empty(F.col("text"))
    hit = lambda c: F.coalesce(F.rlike(c, F.col("pattern")), F.lit(False))
    x = d.select(
        "doc_id", "project_id", "pattern", F.regexp_count(t, F.col("pattern")).cast("bigint").alias("mentions"), F.exists(urls.extract_urls(t), lambda u: urls.same_site(u, F.col("website"))).alias("links"),
        (hit(text.text_or_empty(F.col("title"))) | hit(F.array_join(F.slice(text.blank_words(t), 1, 100), " "))).alias("p"), F.coalesce(F.nullif("source_type", F.lit("")), F.lit("other_web")).alias("source_type"), urls.registrable_domain(F.col("url")).alias("domain"),
    ).dropDuplicates(["doc_id"])
    h = B.block_table(spark, sf_dir).where("type = 'heading'").join(x.select("doc_id", "pattern"), "doc_id").groupBy("doc_id").agg(F.max(F.rlike("text", F.col("pattern"))).alias("h"))
    y = x.join(h, "doc_id", "left")
    return y.select("doc_id", "project_id", "mentions", "links", ((F.col("mentions") > 0) & (F.col("p") | F.coalesce("h", F.lit(False)))).alias("prominent"), "source_type", "domain")


_site = S.domain("coalesce(website, '')")
_MENTIONS = rf"""WITH {BLOCKS}, {ENT}, d AS (SELECT DISTINCT doc_id, project_id, url, title, text, source_type FROM fx_document WHERE kind = 'external' AND ok),
x AS (SELECT doc_id, project_id, pat, len({sql_hit("coalesce(text, '')", 'regexp_extract_all')}) AS mentions, len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i:https?)://[^\s<>")\]]+'), lambda u: {_site} <> '' AND {S.domain('u')} = {_site})) > 0 AS links,
{sql_hit("coalesce(title, '')")} OR {sql_hit("array_to_string(string_split(" + S.ws('text') + ", ' ')[1:100], ' ')")} AS p, coalesce(nullif(source_type, ''), 'other_web') AS source_type, {S.domain('url')} AS domain FROM d JOIN e USING (project_id)),
h AS (SELECT b.doc_id, bool_or({sql_hit('text')}) AS h FROM b JOIN x ON b.doc_id = x.doc_id WHERE type = 'heading' GROUP BY b.doc_id)
SELECT x.doc_id, project_id, mentions, links, mentions > 0 AND (p OR coalesce(h, FALSE)) AS prominent, source_type, domain FROM x LEFT JOIN h ON x.doc_id = h.doc_id"""


def external_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, relevance): the mean of the three passages closest to the project's query, of every readable external page with passages."""
    x, _ = E.passage_sims(spark, sf_dir, "kind = 'external' and ok")
    return x.groupBy("doc_id").agg(F.slice(F.sort_array(F.collect_list("sim"), asc=False), 1, 3).alias("top")).select("doc_id", F.round(F.aggregate("top", F.lit(0.0), lambda s, v: s + v) / F.size("top"), 3).alias("relevance")).hint("merge")


@query
def x_external_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions, links and prominence of the entity in every readable external page, the page's relevance to the query, NULL without passages or query, and its date."""
    dates = P.documents(spark, sf_dir, "published", "modified").select("doc_id", F.coalesce(F.nullif("published", F.lit("")), "modified", F.lit("")).alias("date"))
    return external_mentions(spark, sf_dir).join(external_relevance(spark, sf_dir), "doc_id", "left").join(dates, "doc_id")


_RELEVANCE = f"""rq AS (SELECT DISTINCT f.doc_id, p.query FROM fx_document f JOIN fx_project p USING (project_id) WHERE f.kind = 'external' AND f.ok AND trim(coalesce(p.query, '')) <> ''), {E._PASS},
tx AS (SELECT ps.doc_id, 'p' || pos AS tid, text FROM ps JOIN rq ON ps.doc_id = rq.doc_id UNION ALL SELECT doc_id, 'q0', query FROM rq WHERE doc_id IN (SELECT doc_id FROM ps)), {P.sql_tfidf('tx', 'doc_id')},
rk AS (SELECT ps.doc_id, round(coalesce(sim, 0.0), 6) AS sim, row_number() OVER (PARTITION BY ps.doc_id ORDER BY sim DESC NULLS LAST) AS k FROM ps JOIN rq ON ps.doc_id = rq.doc_id LEFT JOIN sims ON sims.doc_id = ps.doc_id AND sims.p = CAST(ps.pos AS VARCHAR)),
er AS (SELECT doc_id, round(avg(sim), 3) AS relevance FROM rk WHERE k <= 3 GROUP BY doc_id)"""
SQL["x_external_summary"] = f"""WITH {BLOCKS}, {_RELEVANCE}, m AS ({_MENTIONS}), dt AS (SELECT DISTINCT doc_id, coalesce(nullif(published, ''), modified, '') AS date FROM fx_document)
SELECT m.*, relevance, date FROM m LEFT JOIN er ON er.doc_id = m.doc_id JOIN dt ON dt.doc_id = m.doc_id"""


@query
def m13_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable external pages that mention the entity, of every project that has any."""
    hit = F.col("mentions") > 0
    g = external_mentions(spark, sf_dir).groupBy("project_id").agg(F.count(F.lit(1)).alias("pages"), F.sum(hit.cast("int")).alias("n"), F.avg(F.when(hit, _f(F.col("links")))).alias("l"), F.avg(F.when(hit, _f(F.col("prominent")))).alias("p"))
    return g.select("project_id", "pages", F.col("n").alias("mentioning"), rounded(60 * F.least(F.lit(1.0), F.col("n") / 5) + 20 * F.coalesce("l", F.lit(0.0)) + 20 * F.coalesce("p", F.lit(0.0))).alias("score"))


SQL["m13_mentions"] = f"""WITH x AS ({_MENTIONS}), g AS (SELECT project_id, count(*) AS pages, count(*) FILTER (WHERE mentions > 0) AS n, avg(CASE WHEN links THEN 1.0 ELSE 0.0 END) FILTER (WHERE mentions > 0) AS l, avg(CASE WHEN prominent THEN 1.0 ELSE 0.0 END) FILTER (WHERE mentions > 0) AS p FROM x GROUP BY project_id)
SELECT project_id, pages, n AS mentioning, round(60 * least(1.0, n / 5) + 20 * coalesce(l, 0) + 20 * coalesce(p, 0), 4) AS score FROM g"""


@query
def m14_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds and domains of independent external pages that mention the entity."""
    x = external_mentions(spark, sf_dir)
    free = (F.col("mentions") > 0) & ~F.col("source_type").isin("own_site", "competitor_site")
    g = x.groupBy("project_id").agg(F.count_distinct(F.when(free, F.col("source_type"))).alias("kinds"), F.count_distinct(F.when(free & (F.col("domain") != ""), F.col("domain"))).alias("domains"))
    return g.select("project_id", "kinds", "domains", rounded(50 * F.least(F.lit(1.0), F.col("kinds") / 4) + 50 * F.least(F.lit(1.0), F.col("domains") / 5)).alias("score"))


SQL["m14_diversity"] = f"""WITH x AS ({_MENTIONS}), g AS (SELECT project_id, count(DISTINCT source_type) FILTER (WHERE f) AS kinds, count(DISTINCT domain) FILTER (WHERE f AND domain <> '') AS domains
FROM (SELECT *, mentions > 0 AND source_type NOT IN ('own_site', 'competitor_site') AS f FROM x) GROUP BY project_id) SELECT project_id, kinds, domains, round(50 * least(1.0, kinds / 4) + 50 * least(1.0, domains / 5), 4) AS score FROM g"""


def project_worth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project_id, intent, worth, sources, prom) of every project with a query: the query's intent and its value, the mean relevance of the external pages
    as a score, and the best prominence in answers; NULL where there are none."""
    q = P.primary_queries(spark, sf_dir).withColumn("intent", qf.detect_intent(F.col("query"), F.col("entity")))
    value = F.create_map(*[F.lit(x) for kv in W.INTENT_VALUE.items() for x in kv])
    externals = P.documents(spark, sf_dir, "project_id").join(external_relevance(spark, sf_dir), "doc_id").groupBy("project_id").agg(F.avg(sim_to_score(F.col("relevance"), *W.SIM_RANGE)).alias("sources"))
    prom = a2_answers(spark, sf_dir).join(read_table(spark, sf_dir, "fx_answer").select("answer_id", "project_id").distinct().hint("merge"), "answer_id").groupBy("project_id").agg(F.max("prominence").alias("prom"))
    return q.select("project_id", "intent", F.element_at(value, F.col("intent")).alias("worth")).join(externals, "project_id", "left").join(prom, "project_id", "left")


def citation_value(near: Column) -> Column:
    """Weighted mean of what there is of intent, nearness to the entity, relevance of sources and prominence in answers."""
    some = lambda c, w: F.when(c.isNotNull(), w).otherwise(0.0)
    total = 40 * F.coalesce("worth", F.lit(0.6)) + 0.3 * F.coalesce(near, F.lit(0.0)) + 0.15 * F.coalesce("sources", F.lit(0.0)) + 15 * F.coalesce("prom", F.lit(0.0))
    return total / (0.4 + some(near, 0.3) + some(F.col("sources"), 0.15) + some(F.col("prom"), 0.15))


@query
def m16_citation_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value of a project's query: its intent, the mean of metrics 9 and 12 over its own pages, the relevance of its external pages, and the best prominence in
    answers, over the parts there are."""
    docs = P.documents(spark, sf_dir, "project_id", "kind").where("kind = 'target'").select("doc_id", "project_id")
    a, z = (f(spark, sf_dir).select("doc_id", F.round("score", 1).alias(n)) for f, n in ((E.m9_presence, "m9"), (E.m12_relevance, "m12")))
    near = F.coalesce((F.col("m9") + F.col("m12")) / 2, "m9", "m12")
    own = docs.join(a, "doc_id", "left").join(z, "doc_id", "left").groupBy("project_id").agg(F.avg(near).alias("own"))
    x = project_worth(spark, sf_dir).join(own, "project_id", "left")
    return x.select("project_id", "intent", F.round(citation_value(F.col("own")), 3).alias("score"))


def _intent_sql() -> str:
    from lumenpage.plans.text_queries import SQL as T

    return T["q1_intent"].split("SELECT DISTINCT query_id, ", 1)[1].rsplit(" AS intent FROM", 1)[0]


_val = "CASE intent " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in W.INTENT_VALUE.items()) + " END"
_WORTH = f"""iq AS (SELECT DISTINCT project_id, {_intent_sql()} AS intent FROM fx_project WHERE trim(coalesce(query, '')) <> ''), {_RELEVANCE},
so AS (SELECT project_id, avg({P.sscale('relevance', *W.SIM_RANGE)}) AS sources FROM er JOIN (SELECT DISTINCT doc_id, project_id FROM fx_document) USING (doc_id) GROUP BY project_id),
an AS ({SQL['a2_answers']}), ak AS (SELECT DISTINCT answer_id, project_id FROM fx_answer), pm AS (SELECT project_id, max(prominence) AS prom FROM an JOIN ak USING (answer_id) GROUP BY project_id),
wo AS (SELECT iq.project_id, intent, {_val} AS worth, sources, prom FROM iq LEFT JOIN so USING (project_id) LEFT JOIN pm USING (project_id))"""


def _value_sql(near: str) -> str:
    some = lambda c, w: f"CASE WHEN {c} IS NULL THEN 0.0 ELSE {w} END"
    return f"(40 * coalesce(worth, 0.6) + 0.3 * coalesce({near}, 0) + 0.15 * coalesce(sources, 0) + 15 * coalesce(prom, 0)) / (0.4 + {some(near, 0.3)} + {some('sources', 0.15)} + {some('prom', 0.15)})"


_near = "coalesce((m9 + m12) / 2, m9, m12)"
SQL["m16_citation_value"] = f"""WITH {BLOCKS}, {_WORTH}, m9 AS ({E.SQL['m9_presence']}), m12 AS ({E.SQL['m12_relevance']}), d AS (SELECT DISTINCT doc_id, project_id FROM fx_document WHERE kind = 'target'),
o AS (SELECT project_id, avg({_near}) AS own FROM (SELECT d.project_id, round(m9.score, 1) AS m9, round(m12.score, 1) AS m12 FROM d LEFT JOIN m9 ON m9.doc_id = d.doc_id LEFT JOIN m12 ON m12.doc_id = d.doc_id) GROUP BY project_id)
SELECT project_id, intent, round(CAST({_value_sql('own')} AS DOUBLE), 3) AS score FROM wo LEFT JOIN o USING (project_id)"""

PAGE_METRICS = {
    1: P.m1_direct_answer, 2: P.m2_headings, 3: P.m3_chunkability, 5: P.m5_information_density, 6: P.m6_fact_density, 7: P.m7_attribution, 8: E.m8_coverage, 9: E.m9_presence, 10: E.m10_clarity,
    11: E.m11_relationships, 12: E.m12_relevance,
}
AT_ONCE = 2  # metrics staged at a time; the driver holds plans, stages and broadcasts of all of them
PROJECT_METRICS = {13: m13_mentions, 14: m14_diversity, 15: m15_citation_share}


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, metric_id, score) of all 16 metrics of every page: 13 to 15 are its project's, and 16 takes the page's own 9 and 12. The score is NULL
    where a metric has none; 4 never has one, since the tables hold no markup. Each metric is staged by itself, since one plan of them all would
    outgrow the driver; several at a time, since each by itself leaves cores idle. What building and staging leave in the driver is freed each time."""
    jobs = {i: lambda i=i, f=f: f(spark, sf_dir).select("doc_id", F.lit(i).alias("i"), F.round("score", 1).alias("score")) for i, f in PAGE_METRICS.items()}
    jobs |= {i: lambda i=i, f=f: f(spark, sf_dir).select("project_id", F.round("score", 1).alias(f"m{i}")) for i, f in PROJECT_METRICS.items()}
    jobs[16] = lambda: project_worth(spark, sf_dir).drop("intent")

    def staged(job):
        df = job()
        release(spark)
        rows = stage(df, "metric")
        del df
        release(spark)
        return rows

    with ThreadPoolExecutor(AT_ONCE) as pool:
        done = dict(zip(jobs, pool.map(staged, jobs.values())))
    rows = None
    for i in PAGE_METRICS:
        rows = done[i] if rows is None else rows.unionByName(done[i])
    wide = P.documents(spark, sf_dir, "project_id").join(rows.groupBy("doc_id").agg(*[F.max(F.when(F.col("i") == i, F.col("score"))).alias(f"m{i}") for i in PAGE_METRICS]).hint("merge"), "doc_id", "left")
    for i in [*PROJECT_METRICS, 16]:
        wide = wide.join(done[i], "project_id", "left")
    near = F.coalesce((F.col("m9") + F.col("m12")) / 2, "m9", "m12")
    wide = wide.withColumns({"m16": F.round(citation_value(near), 1), "m4": F.lit(None).cast("double")})
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("metric_id"), F.col(f"m{i}").alias("score")) for i in W.METRICS]))
    metrics = stage(wide.select("doc_id", each.alias("m")).select("doc_id", "m.metric_id", "m.score"), "metrics")
    release(spark)
    return metrics


_pages = " UNION ALL ".join(f"SELECT doc_id, {i} AS i, round(score, 1) AS score FROM ({(E.SQL | P.SQL)[f.__name__]})" for i, f in PAGE_METRICS.items())
_wide = ", ".join(f"max(score) FILTER (WHERE i = {i}) AS m{i}" for i in PAGE_METRICS)
_own = " ".join(f"LEFT JOIN (SELECT project_id, round(score, 1) AS m{i} FROM ({SQL[f.__name__]})) x{i} ON x{i}.project_id = f.project_id" for i, f in PROJECT_METRICS.items())
_case = " ".join(f"WHEN {i} THEN {'round(CAST(' + _value_sql(_near) + ' AS DOUBLE), 1)' if i == 16 else f'm{i}'}" for i in W.METRICS if i != 4)
ROWS = f"""{BLOCKS}, {_WORTH}, pg AS MATERIALIZED (SELECT doc_id, {_wide} FROM ({_pages}) GROUP BY doc_id),
wi AS MATERIALIZED (SELECT f.doc_id, pg.* EXCLUDE (doc_id), m13, m14, m15, worth, sources, prom FROM (SELECT DISTINCT doc_id, project_id FROM fx_document) f LEFT JOIN pg ON pg.doc_id = f.doc_id {_own} LEFT JOIN wo ON wo.project_id = f.project_id),
m AS MATERIALIZED (SELECT doc_id, metric_id, CASE metric_id {_case} END AS score FROM wi, (SELECT unnest(range(1, 17)) AS metric_id))"""


EXACT = 1e-9  # so that halves are rounded up whatever the order of summing


def roll_up(rows: DataFrame, spark: SparkSession, by: str = "doc_id", pillar_weights: dict[str, float] | None = None) -> DataFrame:
    """(by, one column a pillar, overall, band, provisional, available): weighted means over the metrics that have a score; a pillar needs one that is
    measured or a proxy; pillars are rounded before the overall mean, and weights of missing parts go to the others."""
    dims = spark.createDataFrame([(i, p, w, s != "estimate") for i, (_, p, w, s, _) in W.METRICS.items()], "metric_id int, pillar string, weight double, firm boolean")
    x = rows.where("score is not null").join(F.broadcast(dims), "metric_id")
    pick = lambda p: F.when(F.col("pillar") == p, F.col("weight"))
    part = {p: F.when(F.sum(F.when((F.col("pillar") == p) & F.col("firm"), 1)) > 0, F.round(F.sum(pick(p) * F.col("score")) / F.sum(pick(p)) + EXACT, 1)) for p in W.PILLARS}
    g = x.groupBy(by).agg(*[c.alias(p) for p, c in part.items()], F.count(F.lit(1)).alias("available"))
    weights = {**W.PILLARS, **(pillar_weights or {})}
    top = sum((F.coalesce(F.col(p) * w, F.lit(0.0)) for p, w in weights.items()), F.lit(0.0))
    low = sum((F.when(F.col(p).isNotNull(), w).otherwise(0.0) for p, w in weights.items()), F.lit(0.0))
    g = g.withColumn("overall", F.when(F.coalesce(*W.PILLARS).isNotNull(), F.round(top / F.when(low == 0, 1.0).otherwise(low) + EXACT, 1)))
    band = F.when(F.col("overall").isNull(), "Not available")
    for least, name in W.BANDS:
        band = band.when(F.col("overall") >= least, name)
    missing = F.lit(False)
    for p in W.PILLARS:
        missing = missing | F.col(p).isNull()
    return g.select(by, *W.PILLARS, "overall", band.alias("band"), missing.alias("provisional"), "available")


@query
def r1_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pillar and overall scores of every page over all metrics."""
    return roll_up(metric_rows(spark, sf_dir), spark)


_dims = ", ".join(f"({i}, '{p}', {w}, {s != 'estimate'})" for i, (_, p, w, s, _) in W.METRICS.items())
_pillar = {p: f"CASE WHEN count(*) FILTER (WHERE pillar = '{p}' AND firm) > 0 THEN round(CAST(sum(weight * score) FILTER (WHERE pillar = '{p}') / sum(weight) FILTER (WHERE pillar = '{p}') AS DOUBLE) + 1e-9, 1) END" for p in W.PILLARS}
_band = "CASE WHEN overall IS NULL THEN 'Not available' " + " ".join(f"WHEN overall >= {b} THEN '{n}'" for b, n in W.BANDS) + " END"
SQL["r1_scores"] = f"""WITH {ROWS}, dm(metric_id, pillar, weight, firm) AS (VALUES {_dims}), g AS (SELECT doc_id, {', '.join(f'{s} AS {p}' for p, s in _pillar.items())}, count(*) AS available FROM m JOIN dm USING (metric_id) WHERE score IS NOT NULL GROUP BY doc_id),
o AS (SELECT *, CASE WHEN coalesce({', '.join(W.PILLARS)}) IS NOT NULL THEN round(CAST(({' + '.join(f'coalesce({p} * {w}, 0)' for p, w in W.PILLARS.items())}) / nullif({' + '.join(f'CASE WHEN {p} IS NULL THEN 0.0 ELSE {w} END' for p, w in W.PILLARS.items())}, 0) AS DOUBLE) + 1e-9, 1) END AS overall FROM g)
SELECT doc_id, {', '.join(W.PILLARS)}, overall, {_band} AS band, {' OR '.join(f'{p} IS NULL' for p in W.PILLARS)} AS provisional, available FROM o"""


@query
def k3_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics that a page has no score for, and what each has to have."""
    needs = F.create_map(*[F.lit(x) for kv in W.NEEDS.items() for x in kv])
    return metric_rows(spark, sf_dir).where("score is null").select("doc_id", "metric_id", F.element_at(needs, F.col("metric_id")).alias("needs"))


_needs = "CASE metric_id " + " ".join(f"WHEN {i} THEN {S.q(n)}" for i, n in W.NEEDS.items()) + " END"
SQL["k3_gaps"] = f"WITH {ROWS} SELECT doc_id, metric_id, {_needs} AS needs FROM m WHERE score IS NULL"


def extremes(rows: DataFrame) -> DataFrame:
    x = rows.where("score >= 75 or score < 60").withColumn("side", F.when(F.col("score") >= 75, "strength").otherwise("weakness"))
    w = Window.partitionBy("doc_id", "side").orderBy(F.when(F.col("side") == "strength", -F.col("score")).otherwise(F.col("score")), "metric_id")
    return x.select("doc_id", "side", F.row_number().over(w).cast("bigint").alias("rank"), "metric_id", "score")


@query
def k5_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every page, its strengths (75 and more) and weaknesses (under 60), each ranked; ties by metric."""
    return extremes(metric_rows(spark, sf_dir))


SQL["k5_extremes"] = f"""WITH {ROWS}, x AS (SELECT *, CASE WHEN score >= 75 THEN 'strength' ELSE 'weakness' END AS side FROM m WHERE score >= 75 OR score < 60)
SELECT doc_id, side, row_number() OVER (PARTITION BY doc_id, side ORDER BY CASE WHEN side = 'strength' THEN -score ELSE score END, metric_id) AS rank, metric_id, score FROM x"""


@query
def k4_cited_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every project, the five domains most cited in answers that don't cite the target, without the target's own and without citations of supplied pages known to
    mention the entity; ties by the domain. Of pages with one URL, the last counts."""
    key = lambda c: F.regexp_replace(urls.normalize_url(c), "/+$", "")
    c = _judged_citations(spark, sf_dir)
    said = read_table(spark, sf_dir, "fx_answer").where("trim(coalesce(text, '')) <> ''").select("answer_id")
    citing = c.where("is_target").select("answer_id")
    d = read_table(spark, sf_dir, "fx_document").where("kind = 'external' and coalesce(url, '') <> ''").join(E.entities(spark, sf_dir).select("project_id", "pattern"), "project_id")
    known = d.select("project_id", key(F.col("url")).alias("page"), "doc_id", (F.col("ok") & F.rlike(text.text_or_empty(F.col("text")), F.col("pattern"))).alias("names"))
    known = known.groupBy("project_id", "page").agg(F.max_by("names", "doc_id").alias("names")).where("names")
    x = c.where("url <> ''").join(said, "answer_id", "left_semi").join(citing, "answer_id", "left_anti")
    x = x.select("project_id", key(F.col("url")).alias("page"), urls.registrable_domain(F.col("url")).alias("domain")).where("domain <> ''").join(known, ["project_id", "page"], "left_anti")
    n = x.groupBy("project_id", "domain").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("project_id").orderBy(F.col("n").desc(), "domain")).cast("bigint")).where("rank <= 5")


def _normal_sql(u: str) -> str:
    from lumenpage.plans.text_queries import SQL as T

    return T["u1_normalize_url"].split("SELECT DISTINCT doc_id, ", 1)[1].rsplit(" AS normal FROM", 1)[0].replace("url", u)


def _page_sql(u: str) -> str:
    return f"regexp_replace({_normal_sql(u)}, '/+$', '')"


SQL["k4_cited_domains"] = f"""WITH {ENT}, {CITES}, {_JC}, kd AS (SELECT project_id, {_page_sql('url')} AS page, arg_max(coalesce(ok, FALSE) AND {sql_hit("coalesce(text, '')")}, doc_id) AS names FROM fx_document JOIN e USING (project_id) WHERE kind = 'external' AND coalesce(url, '') <> '' GROUP BY ALL),
c AS (SELECT project_id, {S.domain('url')} AS domain, count(*) AS n FROM jc WHERE url <> '' AND {S.domain('url')} <> '' AND answer_id IN (SELECT answer_id FROM fx_answer WHERE trim(coalesce(text, '')) <> '') AND answer_id NOT IN (SELECT answer_id FROM jc WHERE is_target)
 AND NOT EXISTS (SELECT 1 FROM kd WHERE kd.project_id = jc.project_id AND kd.page = {_page_sql('jc.url')} AND kd.names) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY n DESC, domain) AS rank FROM c) SELECT * FROM r WHERE rank <= 5"""


def a6_answers_for_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers that belong to each of a project's queries: those with the same query, whatever its case and blanks at its ends, and those without a query for the
    main one."""
    from lumenpage.plans.source_queries import q_all_queries

    q = q_all_queries(spark, sf_dir).select("project_id", F.lower("query").alias("k"), "pos")
    a = read_table(spark, sf_dir, "fx_answer").where("trim(coalesce(text, '')) <> ''").select("project_id", "answer_id", F.lower(F.trim(F.coalesce("query", F.lit("")))).alias("k")).distinct()
    same = a.where("k <> ''").join(q, ["project_id", "k"]).select("project_id", "pos", "answer_id")
    first = q.groupBy("project_id").agg(F.min("pos").alias("pos"))
    return same.unionByName(a.where("k = ''").join(first, "project_id").select("project_id", "pos", "answer_id"))


QUERIES["a6_answers_for_query"] = a6_answers_for_query
SQL["a6_answers_for_query"] = """WITH p AS (SELECT DISTINCT project_id, list_concat([query], coalesce(extra_queries, [])) AS qs FROM fx_project), x AS (SELECT project_id, trim(unnest(qs)) AS q, generate_subscripts(qs, 1) - 1 AS pos FROM p),
q AS (SELECT project_id, lower(q) AS k, min(pos) AS pos FROM x WHERE coalesce(q, '') <> '' GROUP BY ALL), a AS (SELECT DISTINCT project_id, answer_id, lower(trim(coalesce(query, ''))) AS k FROM fx_answer WHERE trim(coalesce(text, '')) <> '')
SELECT project_id, pos, answer_id FROM a JOIN q USING (project_id, k) WHERE k <> '' UNION ALL SELECT project_id, f.pos, answer_id FROM a JOIN (SELECT project_id, min(pos) AS pos FROM q GROUP BY project_id) f USING (project_id) WHERE k = ''"""
