"""Queries over pages: views, structure and facts, scored per page or per page and query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenpage.config import lexicons as L
from lumenpage.config import weights as W
from lumenpage.functions import queries as qf
from lumenpage.functions import tags, text, urls
from lumenpage.operators import blocks as B
from lumenpage.operators.similarity import cosine, sim_to_score, tfidf_similarity
from lumenpage.plans import sql as S
from lumenpage.sources import read_table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))


def scale(c: Column, low: float, high: float) -> Column:
    return clamp((c - low) / (high - low) * 100)


def sscale(x: str, low: float, high: float) -> str:
    return f"greatest(0.0, least(100.0, ({x} - {low}) / ({high} - {low}) * 100))"


def rounded(c: Column, places: int = 4) -> Column:
    return F.round(c, places)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return read_table(spark, sf_dir, "fx_document").select("doc_id", *columns).dropDuplicates(["doc_id"])


def primary_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project_id, query, entity) with a query; projects are of fixed number."""
    p = read_table(spark, sf_dir, "fx_project").where("trim(coalesce(query, '')) <> ''")
    return p.select("project_id", "query", F.coalesce("entity", F.lit("")).alias("entity"), F.coalesce("website", F.lit("")).alias("website")).distinct()


BLOCKS = "b AS (SELECT DISTINCT doc_id, pos, type, level, coalesce(text, '') AS text, items, ext_links FROM fx_block)"
WORDS = lambda x: f"len({S.tokens(x)})"


@query
def b_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = B.sections(B.block_table(spark, sf_dir))
    return s.select("doc_id", "section_id", F.md5("heading").alias("heading"), F.col("level").cast("bigint").alias("level"), F.size("paragraphs").cast("bigint").alias("paragraphs"), F.size("lists").cast("bigint").alias("lists"), F.md5(F.array_join("paragraphs", "\n")).alias("digest"))


SQL["b_sections"] = f"""WITH {BLOCKS}, m AS (SELECT *, sum(CASE WHEN type = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS section_id FROM b)
SELECT doc_id, CAST(section_id AS BIGINT) AS section_id, md5(coalesce(max(text) FILTER (WHERE type = 'heading'), '')) AS heading, CAST(coalesce(max(level) FILTER (WHERE type = 'heading'), 0) AS BIGINT) AS level,
count(*) FILTER (WHERE type = 'p') AS paragraphs, count(*) FILTER (WHERE type = 'list') AS lists, md5(coalesce(string_agg(text, chr(10) ORDER BY pos) FILTER (WHERE type = 'p'), '')) AS digest
FROM m GROUP BY doc_id, section_id HAVING count(*) FILTER (WHERE type IN ('p', 'list')) > 0"""


@query
def b_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.passages(B.block_table(spark, sf_dir)).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "type", F.md5("heading").alias("heading"), F.md5("text").alias("digest"))


SQL["b_passages"] = f"""WITH {BLOCKS}, h AS (SELECT *, last_value(CASE WHEN type = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS heading FROM b)
SELECT doc_id, CAST(pos AS BIGINT) AS pos, type, md5(coalesce(heading, '')) AS heading, md5(text) AS digest FROM h
WHERE type <> 'heading' AND CASE WHEN {S.ws('text')} = '' THEN 0 ELSE len(string_split({S.ws('text')}, ' ')) END >= 8"""


@query
def t17_median_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper median of paragraph lengths in words, of pages with paragraphs."""
    b = B.block_table(spark, sf_dir).where("type = 'p'").select("doc_id", text.word_count(F.col("text")).alias("n"))
    return b.groupBy("doc_id").agg(F.expr("element_at(sort_array(collect_list(n)), cast(count(n) div 2 as int) + 1)").cast("bigint").alias("median"))


SQL["t17_median_paragraph"] = f"WITH {BLOCKS} SELECT doc_id, list_sort(list({WORDS('text')}))[CAST(count(*) // 2 AS BIGINT) + 1] AS median FROM b WHERE type = 'p' GROUP BY doc_id"


def _outline(b: DataFrame) -> DataFrame:
    h = b.where("type = 'heading'")
    jump = F.col("level") - F.lag("level").over(B.page())
    n = text.word_count(F.col("text"))
    return h.withColumns({"jump": jump, "n": n}).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("headings"), F.sum(F.when(F.col("level") == 1, 1).otherwise(0)).alias("h1"), F.sum(F.when(F.col("jump") > 1, 1).otherwise(0)).alias("skips"),
        F.avg("n").alias("mean_len"), F.count_distinct(F.lower("text")).alias("unique"),
    )


@query
def m2_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading hierarchy of every page against its project's query."""
    b = B.block_table(spark, sf_dir)
    sec = B.sections(b).where("heading <> ''").select("doc_id", text.word_count(F.array_join("paragraphs", " ")).alias("w")).groupBy("doc_id").agg(F.avg("w").alias("mean_section"))
    qs = primary_queries(spark, sf_dir).select("project_id", F.transform(qf.query_terms(F.col("query")), text.light_stem).alias("a"), text.stem_set(F.col("query")).alias("z"))
    qs = qs.select("project_id", F.when(F.size("a") > 0, F.col("a")).otherwise(F.col("z")).alias("terms"))
    docs = documents(spark, sf_dir, "project_id").join(qs, "project_id", "left")
    rel = b.where("type = 'heading'").select("doc_id", text.stem_set(F.col("text")).alias("s")).join(docs, "doc_id").groupBy("doc_id").agg(F.avg(F.when(F.arrays_overlap("s", "terms"), 1.0).otherwise(0.0)).alias("related"))
    x = docs.select("doc_id").join(_outline(b), "doc_id", "left").join(sec, "doc_id", "left").join(rel, "doc_id", "left")
    c = F.col
    h1 = F.when(c("h1") == 1, 100.0).when(c("h1") > 1, 40.0).otherwise(10.0)
    bal = F.when(c("mean_section").isNull(), 0.0).when(c("mean_section").between(60, 350), 100.0).when(c("mean_section") > 350, F.greatest(F.lit(0.0), 100 - (c("mean_section") - 350) / 5)).otherwise(c("mean_section") / 60 * 100)
    desc = F.when(c("mean_len").between(2, 10), 100.0).when(c("mean_len") < 2, 40.0).otherwise(60.0) * (0.5 + 0.5 * c("unique") / c("headings"))
    score = 0.25 * h1 + 0.2 * F.greatest(F.lit(0.0), 100.0 - 25 * c("skips")) + 0.2 * bal + 0.15 * desc + 0.2 * F.least(F.lit(100.0), c("related") / 0.4 * 100)
    return x.select("doc_id", F.coalesce("headings", F.lit(0)).alias("headings"), F.coalesce("h1", F.lit(0)).cast("bigint").alias("h1"), F.coalesce("skips", F.lit(0)).cast("bigint").alias("skips"), rounded(F.when(c("headings") > 0, clamp(score)).otherwise(0.0)).alias("score"))


_qt = f"list_transform(list_filter({S.terms('query')}, lambda w: NOT list_contains({S.strings(L.INTENT_WORDS)}, w)), lambda w: {S.stem('w')})"
SQL["m2_headings"] = f"""WITH {BLOCKS}, q AS (SELECT DISTINCT project_id, CASE WHEN len({_qt}) > 0 THEN {_qt} ELSE {S.stems('query')} END AS terms FROM fx_project WHERE trim(coalesce(query, '')) <> ''),
d AS (SELECT DISTINCT f.doc_id, q.terms FROM fx_document f LEFT JOIN q ON f.project_id = q.project_id),
h AS (SELECT doc_id, level, text, {WORDS('text')} AS n, level - lag(level) OVER (PARTITION BY doc_id ORDER BY pos) AS jump, {S.stems('text')} AS s FROM b WHERE type = 'heading'),
o AS (SELECT h.doc_id, count(*) AS headings, count(*) FILTER (WHERE level = 1) AS h1, count(*) FILTER (WHERE jump > 1) AS skips, avg(n) AS mean_len, count(DISTINCT lower(text)) AS uniq,
  avg(CASE WHEN list_has_any(s, d.terms) THEN 1.0 ELSE 0.0 END) AS related FROM h JOIN d ON h.doc_id = d.doc_id GROUP BY h.doc_id),
m AS (SELECT *, sum(CASE WHEN type = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS sid FROM b),
s AS (SELECT doc_id, sid, coalesce(sum({WORDS('text')}) FILTER (WHERE type = 'p'), 0) AS w FROM m GROUP BY doc_id, sid HAVING count(*) FILTER (WHERE type IN ('p', 'list')) > 0 AND coalesce(max(text) FILTER (WHERE type = 'heading'), '') <> ''),
a AS (SELECT doc_id, avg(w) AS ms FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(headings, 0) AS headings, coalesce(h1, 0) AS h1, coalesce(skips, 0) AS skips, round(CASE WHEN headings > 0 THEN greatest(0.0, least(100.0, 0.25 * CASE WHEN h1 = 1 THEN 100.0 WHEN h1 > 1 THEN 40.0 ELSE 10.0 END
 + 0.2 * greatest(0.0, 100.0 - 25 * skips) + 0.2 * CASE WHEN ms IS NULL THEN 0.0 WHEN ms BETWEEN 60 AND 350 THEN 100.0 WHEN ms > 350 THEN greatest(0.0, 100 - (ms - 350) / 5) ELSE ms / 60 * 100 END
 + 0.15 * CASE WHEN mean_len BETWEEN 2 AND 10 THEN 100.0 WHEN mean_len < 2 THEN 40.0 ELSE 60.0 END * (0.5 + 0.5 * uniq / headings) + 0.2 * least(100.0, related / 0.4 * 100))) ELSE 0.0 END, 4) AS score
FROM d LEFT JOIN o ON d.doc_id = o.doc_id LEFT JOIN a ON d.doc_id = a.doc_id"""


@query
def m3_chunkability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a page's paragraphs stand alone; NULL without a paragraph of five words."""
    b = B.block_table(spark, sf_dir)
    n = text.word_count(F.col("text"))
    p = b.where("type = 'p'").withColumn("n", n).where("n >= 5").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("paragraphs"), F.avg(F.when(F.col("n").between(25, 150), 1.0).otherwise(0.0)).alias("ideal"), F.avg(F.when(F.col("n") > 200, 1.0).otherwise(0.0)).alias("overlong"),
        F.avg(F.when((F.col("n") >= 15) & tags.opens_dependent(F.col("text")), 1.0).otherwise(0.0)).alias("dependent"),
    )
    long = F.exists(F.concat("paragraphs", "lists"), lambda x: text.word_count(x) >= 25)
    sec = B.sections(b).where("heading <> ''").select("doc_id", F.when(long, 1.0).otherwise(0.0).alias("good")).groupBy("doc_id").agg(F.avg("good").alias("good"))
    x = documents(spark, sf_dir).join(p, "doc_id", "left").join(sec, "doc_id", "left")
    c = F.col
    score = 0.3 * F.least(F.lit(100.0), c("ideal") / 0.6 * 100) + 0.25 * scale(1 - c("dependent"), 0.6, 1.0) + 0.25 * F.coalesce("good", F.lit(0.0)) * 100 + 0.2 * (100 - c("overlong") * 100)
    return x.select("doc_id", F.coalesce("paragraphs", F.lit(0)).alias("paragraphs"), rounded(c("ideal")).alias("ideal"), rounded(c("dependent")).alias("dependent"), rounded(F.when(c("ideal").isNotNull(), clamp(score))).alias("score"))


SQL["m3_chunkability"] = f"""WITH {BLOCKS}, p AS (SELECT doc_id, count(*) AS paragraphs, avg(CASE WHEN n BETWEEN 25 AND 150 THEN 1.0 ELSE 0.0 END) AS ideal, avg(CASE WHEN n > 200 THEN 1.0 ELSE 0.0 END) AS overlong,
avg(CASE WHEN n >= 15 AND {S.like('trim(text)', '(?i)' + L.DEPENDENT_OPENER)} THEN 1.0 ELSE 0.0 END) AS dependent FROM (SELECT *, {WORDS('text')} AS n FROM b WHERE type = 'p') WHERE n >= 5 GROUP BY doc_id),
m AS (SELECT *, sum(CASE WHEN type = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS sid FROM b),
s AS (SELECT doc_id, sid, max(CASE WHEN type IN ('p', 'list') AND {WORDS('text')} >= 25 THEN 1.0 ELSE 0.0 END) AS good FROM m GROUP BY doc_id, sid HAVING count(*) FILTER (WHERE type IN ('p', 'list')) > 0 AND coalesce(max(text) FILTER (WHERE type = 'heading'), '') <> ''),
a AS (SELECT doc_id, avg(good) AS good FROM s GROUP BY doc_id), d AS (SELECT DISTINCT doc_id FROM fx_document)
SELECT d.doc_id, coalesce(paragraphs, 0) AS paragraphs, round(ideal, 4) AS ideal, round(dependent, 4) AS dependent, round(CASE WHEN ideal IS NOT NULL THEN greatest(0.0, least(100.0, 0.3 * least(100.0, ideal / 0.6 * 100) + 0.25 * {sscale('(1 - dependent)', 0.6, 1.0)} + 0.25 * coalesce(good, 0.0) * 100 + 0.2 * (100 - overlong * 100))) END, 4) AS score
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN a ON d.doc_id = a.doc_id"""


@query
def m6_fact_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (sentence, kind) facts per 100 words; NULL under 30 words. Kinds are counted within each row, so nothing is exploded."""
    d = read_table(spark, sf_dir, "fx_document").select("doc_id", text.sentences(F.col("text")).alias("s"), text.word_count(F.col("text")).alias("w"))
    count = lambda k: F.size(F.filter("s", lambda s: tags.has_fact(s, k)))
    d = d.select("doc_id", "w", *[count(k).alias(k) for k in L.FACTS]).dropDuplicates(["doc_id"])
    items = sum((F.col(k) for k in list(L.FACTS)[1:]), F.col("percentage"))
    kinds = sum((F.when(F.col(k) > 0, 1).otherwise(0) for k in list(L.FACTS)[1:]), F.when(F.col("percentage") > 0, 1).otherwise(0))
    per = items / F.col("w") * 100
    score = 0.8 * F.least(F.lit(100.0), per / W.FACT_TARGET * 100) + 0.2 * F.least(F.lit(1.0), kinds / 5) * 100
    return d.select("doc_id", items.cast("bigint").alias("items"), kinds.cast("bigint").alias("kinds"), rounded(F.when(F.col("w") >= 30, clamp(score))).alias("score"))


_fc = {k: f"len(list_filter(ss, lambda s: {S.like('s', p)}))" for k, p in L.FACTS.items()}
SQL["m6_fact_density"] = f"""WITH d AS (SELECT DISTINCT doc_id, {S.sentences('text')} AS ss, {WORDS('text')} AS w FROM fx_document),
c AS (SELECT doc_id, w, {' + '.join(_fc.values())} AS items, {' + '.join(f'CASE WHEN {x} > 0 THEN 1 ELSE 0 END' for x in _fc.values())} AS kinds FROM d)
SELECT doc_id, CAST(items AS BIGINT) AS items, CAST(kinds AS BIGINT) AS kinds, round(CASE WHEN w >= 30 THEN greatest(0.0, least(100.0, 0.8 * least(100.0, items / w * 100 / {W.FACT_TARGET} * 100) + 0.2 * least(1.0, kinds / 5) * 100)) END, 4) AS score FROM c"""


def _outside(t: Column, url: Column) -> Column:
    """Distinct hosts of the URLs in a text that are not the page's own."""
    hosts = F.transform(urls.extract_urls(t), urls.link_domain)
    return F.array_distinct(F.filter(hosts, lambda h: (h != "") & (h != urls.hostname(F.coalesce(url, F.lit(""))))))


@query
def m7_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a page's claims with a source, distinct hosts of other sites, and a heading for references; NULL without claims. The tables hold no links,
    so hosts are those of URLs written in the text."""
    b = B.block_table(spark, sf_dir)
    p = b.where("type = 'p'").select("doc_id", F.col("ext_links") > 0, text.sentences(F.col("text")).alias("s")).toDF("doc_id", "linked", "s")
    claims = F.filter("s", tags.is_claim)
    counted = p.select("doc_id", F.size(claims).alias("c"), F.when(F.coalesce("linked", F.lit(False)), F.size(claims)).otherwise(F.size(F.filter(claims, tags.is_attributed))).alias("a"))
    counted = counted.groupBy("doc_id").agg(F.sum("c").alias("claims"), F.sum("a").alias("attributed"))
    refs = b.where("type = 'heading'").groupBy("doc_id").agg(F.max(tags.heads_references(F.col("text")).cast("int")).alias("refs"))
    docs = read_table(spark, sf_dir, "fx_document").select("doc_id", F.size(_outside(F.col("text"), F.col("url"))).alias("domains")).dropDuplicates(["doc_id"])
    x = docs.join(counted, "doc_id", "left").join(refs, "doc_id", "left")
    score = 60.0 * F.col("attributed") / F.col("claims") + 25.0 * F.least(F.lit(1.0), F.col("domains") / 5) + 15.0 * F.coalesce("refs", F.lit(0))
    return x.select("doc_id", F.coalesce("claims", F.lit(0)).alias("claims"), F.coalesce("attributed", F.lit(0)).alias("attributed"), F.col("domains").cast("bigint").alias("domains"), rounded(F.when(F.col("claims") > 0, clamp(score))).alias("score"))


_claim = " OR ".join(S.like("s", p) for p in [S.one_of(L.SUPERLATIVES), *(L.FACTS[k] for k in L.CLAIM_FACTS)])
SQL["m7_attribution"] = rf"""WITH {BLOCKS}, p AS (SELECT doc_id, ext_links > 0 AS linked, list_filter({S.sentences('text')}, lambda s: {_claim}) AS cl FROM b WHERE type = 'p'),
c AS (SELECT doc_id, sum(len(cl)) AS claims, sum(CASE WHEN linked THEN len(cl) ELSE len(list_filter(cl, lambda s: {S.like('s', S.one_of(L.ATTRIBUTION))})) END) AS attributed FROM p GROUP BY doc_id),
r AS (SELECT doc_id, max(CASE WHEN {S.like('text', '(?i)' + L.REFERENCES_HEADING)} THEN 1 ELSE 0 END) AS refs FROM b WHERE type = 'heading' GROUP BY doc_id), d AS (SELECT DISTINCT doc_id, len(list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '(?i:https?)://[^\s<>")\]]+'), lambda u: regexp_replace(lower(string_split(regexp_replace(u, '[.,;:]+$', ''), '/')[3]), '^www\.', '')), lambda h: h <> '' AND h <> {S.host("coalesce(url, '')")}))) AS domains FROM fx_document)
SELECT d.doc_id, CAST(coalesce(claims, 0) AS BIGINT) AS claims, CAST(coalesce(attributed, 0) AS BIGINT) AS attributed, domains, round(CASE WHEN claims > 0 THEN greatest(0.0, least(100.0, 60.0 * attributed / claims + 25.0 * least(1.0, domains / 5) + 15.0 * coalesce(refs, 0))) END, 4) AS score
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN r ON d.doc_id = r.doc_id"""


@query
def m1_question_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question headings of every page, and how many of them are answered by one of the two blocks that follow."""
    b = B.block_table(spark, sf_dir)
    n = text.word_count(F.col("text"))
    good = F.when(F.col("type") == "p", n.between(8, 80)).when(F.col("type") == "list", F.size("items") >= 2)
    ahead = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(1, 2)
    h = b.withColumn("ok", F.first(good, ignorenulls=True).over(ahead)).where((F.col("type") == "heading") & tags.is_question(F.col("text")))
    return h.groupBy("doc_id").agg(F.count(F.lit(1)).alias("questions"), F.sum(F.coalesce("ok", F.lit(False)).cast("int")).alias("answered"))


SQL["m1_question_answers"] = f"""WITH {BLOCKS}, w AS (SELECT *, CASE WHEN type = 'p' THEN {WORDS('text')} BETWEEN 8 AND 80 WHEN type = 'list' THEN len(items) >= 2 END AS good FROM b),
h AS (SELECT *, first_value(good IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS ok FROM w)
SELECT doc_id, count(*) AS questions, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS answered FROM h WHERE type = 'heading' AND (ends_with(trim(text), '?') OR {S.like('trim(text)', '(?i)' + L.QUESTION_START)}) GROUP BY doc_id"""


def _opening(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The opening paragraphs of every page, up to the one that completes 150 words, and its project's query."""
    b = B.block_table(spark, sf_dir).where("type = 'p'").withColumn("n", text.word_count(F.col("text"))).where("n >= 8")
    before = F.coalesce(F.sum("n").over(B.page().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    window = b.withColumn("before", before).where("before < 150").select("doc_id", "pos", "n", "text")
    docs = documents(spark, sf_dir, "project_id").join(primary_queries(spark, sf_dir), "project_id").select("doc_id", F.lit(0).alias("probe"), F.col("query").alias("text"))
    return window, docs.join(window.select("doc_id").distinct(), "doc_id", "left_semi")


@query
def m1_opening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The opening paragraph closest to the query, the first on ties, and its score."""
    window, probes = _opening(spark, sf_dir)
    sims = tfidf_similarity(window, probes, ["doc_id"], "pos", "probe").select("doc_id", "pos", "sim")
    x = window.join(probes.select("doc_id"), "doc_id", "left_semi").join(sims, ["doc_id", "pos"], "left").withColumn("sim", F.round(F.coalesce("sim", F.lit(0.0)), 6))
    best = x.groupBy("doc_id").agg(F.max(F.struct("sim", -F.col("pos"), "n")).alias("m")).select("doc_id", F.col("m.sim").alias("sim"), F.col("m.n").alias("n"))
    fit = F.when(F.col("n").between(15, 80), 100.0).when(F.col("n").between(81, 120), 60.0).when(F.col("n") < 15, 40.0).otherwise(20.0)
    return best.select("doc_id", F.col("n").cast("bigint").alias("words"), F.round("sim", 4).alias("sim"), rounded(0.35 * fit + 0.65 * sim_to_score(F.col("sim"), *W.SIM_RANGE), 3).alias("opening"))


@query
def m1_direct_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the opening's score and half the share of question headings that are answered, 25 without any; pages without a query or an opening are left out."""
    x = m1_opening(spark, sf_dir).join(m1_question_answers(spark, sf_dir), "doc_id", "left")
    return x.select("doc_id", rounded(0.5 * F.col("opening") + 0.5 * F.coalesce(F.col("answered") / F.col("questions") * 100, F.lit(25.0))).alias("score"))


def sql_grams(x: str) -> str:
    w = f"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: NOT list_contains({S.strings(L.STOPWORDS)}, w))"
    return f"list_concat({w}, list_transform(range(1, len({w})), lambda i: ({w})[i] || ' ' || ({w})[i + 1]))"


def sql_tfidf(texts: str, call: str) -> str:
    """CTEs from `texts`(call, tid, text), tids beginning with p or q, to sims(call, p, q, sim)."""
    on = lambda a, b, *more: " AND ".join(f"{a}.{c} = {b}.{c}" for c in [*call.split(", "), *more])
    return f"""gr AS (SELECT {call}, tid, unnest(g) AS gram FROM (SELECT {call}, tid, {sql_grams('text')} AS g FROM {texts})), sz AS (SELECT {call}, count(*) AS n FROM {texts} GROUP BY {call}),
tf AS (SELECT {call}, tid, gram, count(*) AS c FROM gr GROUP BY {call}, tid, gram), df AS (SELECT {call}, gram, count(*) AS df FROM tf GROUP BY {call}, gram),
wt AS (SELECT {', '.join('tf.' + c for c in call.split(', '))}, tf.tid, tf.gram, (1 + ln(c)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df ON {on('tf', 'df', 'gram')} JOIN sz ON {on('tf', 'sz')}),
nm AS (SELECT {call}, tid, sqrt(sum(w * w)) AS nrm FROM wt GROUP BY {call}, tid), un AS (SELECT {', '.join('wt.' + c for c in call.split(', '))}, wt.tid, gram, w / nrm AS u FROM wt JOIN nm ON {on('wt', 'nm', 'tid')}),
sims AS (SELECT {', '.join('a.' + c for c in call.split(', '))}, substring(a.tid, 2) AS p, substring(z.tid, 2) AS q, least(1.0, sum(a.u * z.u)) AS sim FROM un a JOIN un z ON {on('a', 'z', 'gram')} AND a.tid LIKE 'p%' AND z.tid LIKE 'q%' GROUP BY ALL)"""


SQL["m1_opening"] = f"""WITH {BLOCKS}, pw AS (SELECT doc_id, pos, text, {WORDS('text')} AS n FROM b WHERE type = 'p'), pn AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pw WHERE n >= 8),
op AS (SELECT * FROM pn WHERE before < 150), qs AS (SELECT DISTINCT f.doc_id, p.query FROM fx_document f JOIN fx_project p USING (project_id) WHERE trim(coalesce(p.query, '')) <> '' AND f.doc_id IN (SELECT doc_id FROM op)),
tx AS (SELECT doc_id, 'p' || pos AS tid, text FROM op UNION ALL SELECT doc_id, 'q0', query FROM qs), {sql_tfidf('tx', 'doc_id')},
j AS (SELECT op.doc_id, op.pos, op.n, round(coalesce(sim, 0.0), 6) AS sim FROM op JOIN qs ON op.doc_id = qs.doc_id LEFT JOIN sims ON sims.doc_id = op.doc_id AND sims.p = CAST(op.pos AS VARCHAR)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, pos) AS k FROM j)
SELECT doc_id, n AS words, round(sim, 4) AS sim, round(0.35 * CASE WHEN n BETWEEN 15 AND 80 THEN 100.0 WHEN n BETWEEN 81 AND 120 THEN 60.0 WHEN n < 15 THEN 40.0 ELSE 20.0 END + 0.65 * {sscale('sim', *W.SIM_RANGE)}, 3) AS opening FROM r WHERE k = 1"""


@query
def m5_information_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with a figure or name, relevance of sentences to the query, stock phrases and variety of words; NULL under 30 words or without sentences."""
    d = documents(spark, sf_dir, "project_id", "text")
    s = d.select("doc_id", F.posexplode(F.filter(text.sentences(F.col("text")), lambda x: text.word_count(x) >= 4)).alias("sid", "text"))
    probes = d.select("doc_id", "project_id").join(primary_queries(spark, sf_dir), "project_id").select("doc_id", F.lit(0).alias("probe"), F.col("query").alias("text"))
    sims = tfidf_similarity(s, probes, ["doc_id"], "sid", "probe").where(F.round("sim", 6) >= W.RELEVANT).groupBy("doc_id").agg(F.count(F.lit(1)).alias("near"))
    counts = s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(tags.is_informative(F.col("text")), 1.0).otherwise(0.0)).alias("inf"))
    fill = sum((text.phrase_count(F.col("text"), p) for p in L.FILLER_PHRASES[1:]), text.phrase_count(F.col("text"), L.FILLER_PHRASES[0]))
    base = d.select("doc_id", text.word_count(F.col("text")).alias("w"), fill.alias("fill"), text.type_token_ratio(F.col("text")).alias("ttr"))
    x = base.join(counts, "doc_id").join(sims, "doc_id", "left").join(probes.select("doc_id", F.lit(1).alias("asked")), "doc_id", "left").where("w >= 30")
    sem = F.when(F.col("asked").isNull(), 50.0).otherwise(scale(F.coalesce("near", F.lit(0)) / F.col("n"), 0.1, 0.6))
    score = 0.4 * scale(F.col("inf"), 0.15, 0.6) + 0.25 * sem + 0.2 * (100 - F.least(F.lit(100.0), F.col("fill") / F.col("w") * 1000 * 25)) + 0.15 * scale(F.col("ttr"), 0.35, 0.7)
    return x.select("doc_id", F.col("n").alias("sentences"), F.coalesce("near", F.lit(0)).alias("relevant"), rounded(clamp(score), 3).alias("score"))


from lumenpage.plans.text_queries import _sfill as _FILL  # noqa: E402

SQL["m5_information_density"] = f"""WITH d AS (SELECT DISTINCT doc_id, project_id, text FROM fx_document), sn AS (SELECT doc_id, list_filter({S.sentences('text')}, lambda x: {WORDS('x')} >= 4) AS ss FROM d),
s AS (SELECT doc_id, unnest(ss) AS text, generate_subscripts(ss, 1) - 1 AS sid FROM sn), qs AS (SELECT DISTINCT d.doc_id, p.query FROM d JOIN fx_project p USING (project_id) WHERE trim(coalesce(p.query, '')) <> ''),
tx AS (SELECT doc_id, 'p' || sid AS tid, text FROM s UNION ALL SELECT doc_id, 'q0', query FROM qs), {sql_tfidf('tx', 'doc_id')},
nr AS (SELECT doc_id, count(*) AS near FROM sims WHERE round(sim, 6) >= {W.RELEVANT} GROUP BY doc_id), ct AS (SELECT doc_id, count(*) AS n, avg(CASE WHEN {S.like('text', '[0-9]|[a-z,;] [A-Z][a-zA-Z]{2,}')} THEN 1.0 ELSE 0.0 END) AS inf FROM s GROUP BY doc_id),
bs AS (SELECT doc_id, {WORDS('text')} AS w, {_FILL} AS fill, CASE WHEN len(({S.terms('text')})[1:1000]) > 0 THEN len(list_distinct(({S.terms('text')})[1:1000])) / len(({S.terms('text')})[1:1000]) ELSE 0.0 END AS ttr FROM d)
SELECT bs.doc_id, n AS sentences, coalesce(near, 0) AS relevant, round(greatest(0.0, least(100.0, 0.4 * {sscale('inf', 0.15, 0.6)} + 0.25 * CASE WHEN qs.doc_id IS NULL THEN 50.0 ELSE {sscale('(coalesce(near, 0) / n)', 0.1, 0.6)} END + 0.2 * (100 - least(100.0, fill / w * 1000 * 25)) + 0.15 * {sscale('ttr', 0.35, 0.7)})), 3) AS score
FROM bs JOIN ct ON bs.doc_id = ct.doc_id LEFT JOIN nr ON bs.doc_id = nr.doc_id LEFT JOIN qs ON bs.doc_id = qs.doc_id WHERE w >= 30"""


@query
def v1_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each probe, every hundredth vector, its five nearest vectors by cosine among all. The probes are a stated query set; their side is the small one."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding").distinct()
    probes = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("probe"), F.col("embedding").alias("v"))
    sims = e.join(probes, F.col("vec_id") != F.col("probe")).select("probe", "vec_id", F.round(cosine(F.col("embedding"), F.col("v")), 5).alias("sim"))
    best = sims.withColumn("rank", F.row_number().over(Window.partitionBy("probe").orderBy(F.col("sim").desc(), "vec_id"))).where("rank <= 5")
    return best.select("probe", "vec_id", "sim", F.col("rank").cast("bigint").alias("rank"))


SQL["v1_cosine"] = """WITH e AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT p.vec_id AS probe, e.vec_id, round(list_dot_product(e.v, p.v) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(p.v, p.v))), 5) AS sim FROM e JOIN e p ON p.vec_id % 100 = 0 AND p.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY sim DESC, vec_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 5"""

SQL["m1_direct_answer"] = f"""WITH o AS ({SQL['m1_opening']}), a AS ({SQL['m1_question_answers']})
SELECT o.doc_id, round(0.5 * opening + 0.5 * coalesce(answered / questions * 100, 25.0), 4) AS score FROM o LEFT JOIN a ON a.doc_id = o.doc_id"""
