"""Queries of scans, edges and sinks: pasted text, HTML pages, safe URLs, priorities and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenpage.config import weights as W
from lumenpage.functions import queries as qf
from lumenpage.functions import text
from lumenpage.operators import answers_io as io
from lumenpage.operators import blocks as B
from lumenpage.operators.html import extract_documents
from lumenpage.plans import authority_queries as A
from lumenpage.plans import page_queries as P
from lumenpage.plans import sql as S
from lumenpage.sources import read_table, ship_package

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def s5_pasted_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of answers read as pasted pages."""
    a = read_table(spark, sf_dir, "fx_answer").select("answer_id", "text").distinct()
    b = B.pasted_blocks(a, "answer_id", "text")
    return b.select("answer_id", F.col("pos").cast("bigint").alias("pos"), "type", F.coalesce("level", F.lit(0)).cast("bigint").alias("level"), F.md5("text").alias("digest"), F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("items"))


_bullet = r"^(?:[-*•]|\d+[.)])\s+"
SQL["s5_pasted_blocks"] = rf"""WITH a AS (SELECT DISTINCT answer_id, text FROM fx_answer), sp AS (SELECT answer_id, string_split_regex(coalesce(text, ''), '\n[ \t]*\n') AS cs FROM a),
c0 AS (SELECT answer_id, trim(unnest(cs)) AS chunk, generate_subscripts(cs, 1) AS cn FROM sp), c AS (SELECT *, list_filter(list_transform(string_split(chunk, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM c0 WHERE chunk <> ''),
k AS (SELECT *, CASE WHEN regexp_matches(chunk, '^#{{1,6}}\s+\S') AND len(ls) = 1 THEN 'heading' WHEN len(ls) >= 2 AND len(list_filter(ls, lambda x: NOT regexp_matches(x, '{_bullet}'))) = 0 THEN 'list' ELSE 'p' END AS type FROM c),
t AS (SELECT *, CASE type WHEN 'heading' THEN [regexp_replace(chunk, '^#{{1,6}}\s+', '')] WHEN 'list' THEN [array_to_string(list_transform(ls, lambda x: regexp_replace(x, '{_bullet}', '')), ' ; ')] ELSE ls END AS ts FROM k),
u AS (SELECT answer_id, cn, type, CASE WHEN type = 'heading' THEN length(regexp_extract(chunk, '^(#{{1,6}})', 1)) ELSE 0 END AS level, CASE WHEN type = 'list' THEN len(ls) ELSE 0 END AS items, unnest(ts) AS text, generate_subscripts(ts, 1) AS ln FROM t)
SELECT answer_id, row_number() OVER (PARTITION BY answer_id ORDER BY cn, ln) - 1 AS pos, type, CAST(level AS BIGINT) AS level, md5({S.ws('text')}) AS digest, CAST(items AS BIGINT) AS items FROM u"""


@query
def s3_unsafe_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each document's URL must not be fetched; '' if it may."""
    ship_package(spark)
    d = read_table(spark, sf_dir, "fx_document").select("doc_id", "url").distinct()
    return d.select("doc_id", io.arrow_column(io.unsafe_reason, F.coalesce("url", F.lit(""))).alias("reason"))


@query
def t11_printable(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    d = read_table(spark, sf_dir, "fx_document").select("doc_id", "title").distinct()
    return d.select("doc_id", io.arrow_column(io.printable, text.text_or_empty(F.col("title"))).alias("title"))


@query
def s11_url_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct URLs of every project's websites and competitors, read as pasted lines."""
    p = read_table(spark, sf_dir, "fx_project").select("project_id", F.concat_ws("\n", F.coalesce("website", F.lit("")), F.array_join(F.transform("competitors", lambda c: c["domain"]), ", ")).alias("lines")).distinct()
    return p.select("project_id", F.explode(io.url_lines(F.col("lines"))).alias("url"))


@query
def s4_html_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's blocks written as an HTML page and read again: title, words and blocks of the result."""
    b = B.block_table(spark, sf_dir).where("text <> ''")
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tag = F.when(F.col("type") == "heading", F.concat(F.lit("h"), F.coalesce("level", F.lit(2)).cast("string"))).otherwise("p")
    item = F.concat(F.lit("<ul>"), F.array_join(F.transform("items", lambda i: F.concat(F.lit("<li>"), esc(i))), ""), F.lit("</ul>"))
    line = F.when(F.col("type") == "list", item).otherwise(F.concat(F.lit("<"), tag, F.lit(">"), esc(F.col("text"))))
    pages = b.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", line.alias("l")))), lambda x: x["l"]), "\n").alias("body"))
    docs = P.documents(spark, sf_dir, "title", "url")
    html = F.concat(F.lit("<html><head><title>"), esc(text.text_or_empty(F.col("title"))), F.lit("</title></head><body><nav>Log in</nav><main>"), F.col("body"), F.lit("</main><footer>Copyright</footer></body></html>"))
    made = docs.join(pages, "doc_id").select("doc_id", html.alias("html"), "url")
    return extract_documents(made, "doc_id", "html", "url").select("doc_id", "ok", "title", F.col("word_count").cast("bigint").alias("words"), F.size("blocks").cast("bigint").alias("blocks"))


def priorities(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near the entity is the mean of those of metrics 9 and 12 that have a score."""
    dims = spark.createDataFrame([(i, w / 0.3, {1: 1.0, 2: 0.6, 3: 0.3}[e], W.EVIDENCE_STRENGTH[s]) for i, (_, _, w, s, e) in W.METRICS.items()], "metric_id int, impact double, ease double, sure double")
    value = F.create_map(*[F.lit(x) for kv in W.INTENT_VALUE.items() for x in kv])
    worth = P.documents(spark, sf_dir, "project_id").join(P.primary_queries(spark, sf_dir).select("project_id", F.element_at(value, qf.detect_intent(F.col("query"), F.col("entity"))).alias("worth")), "project_id", "left").select("doc_id", F.coalesce("worth", F.lit(0.6)).alias("worth")).hint("merge")
    near = rows.where("metric_id in (9, 12)").groupBy("doc_id").agg(F.avg("score").alias("near")).hint("merge")  # a row a page, so never broadcast
    x = rows.where(F.col("score") < W.THRESHOLD).join(F.broadcast(dims), "metric_id").join(worth, "doc_id").join(near, "doc_id", "left")
    w = W.PRIORITY
    p = w["weakness"] * (100 - F.col("score")) / 100 + w["impact"] * F.col("impact") + w["query"] * F.col("worth") + w["entity"] * F.coalesce("near", F.lit(50.0)) / 100 + w["effort"] * F.col("ease") + w["evidence"] * F.col("sure")
    sure = p + 1e-9
    return x.select("doc_id", "metric_id", F.round(sure, 3).alias("priority"), F.when(sure >= 0.72, "High").when(sure >= 0.55, "Medium").otherwise("Low").alias("label"))


@query
def k1_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak metrics of every page by priority: how weak, how heavy, how much the query is worth, how near the entity, how easy, how sure."""
    return priorities(A.metric_rows(spark, sf_dir), spark, sf_dir)


_dims = ", ".join(f"({i}, {w / 0.3!r}, {({1: 1.0, 2: 0.6, 3: 0.3})[e]}, {W.EVIDENCE_STRENGTH[s]})" for i, (_, _, w, s, e) in W.METRICS.items())
_w = W.PRIORITY
SQL["k1_priorities"] = f"""WITH {A.ROWS}, dm(metric_id, impact, ease, sure) AS (VALUES {_dims}), n AS (SELECT doc_id, avg(score) AS near FROM m WHERE metric_id IN (9, 12) GROUP BY doc_id)
SELECT doc_id, metric_id, round(p, 3) AS priority, CASE WHEN p >= 0.72 THEN 'High' WHEN p >= 0.55 THEN 'Medium' ELSE 'Low' END AS label FROM (SELECT m.doc_id, m.metric_id, CAST({_w['weakness']} * (100 - score) / 100 + {_w['impact']} * impact + {_w['query']} * coalesce(worth, 0.6) + {_w['entity']} * coalesce(near, 50.0) / 100 + {_w['effort']} * ease + {_w['evidence']} * sure AS DOUBLE) + 1e-9 AS p
FROM m JOIN dm USING (metric_id) JOIN wi ON wi.doc_id = m.doc_id LEFT JOIN n ON n.doc_id = m.doc_id WHERE score < {W.THRESHOLD})"""


def report_lines(r: DataFrame) -> DataFrame:
    show = lambda c: F.coalesce(F.format_string("%.1f", F.col(c)), F.lit("-"))
    return r.select("doc_id", F.concat(F.lit("| "), F.col("doc_id").cast("string"), F.lit(" | "), show("overall"), F.lit(" | "), F.col("band"), F.lit(" |")).alias("line"))


@query
def o2_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Markdown line for every page, ready for a text sink."""
    return report_lines(A.r1_scores(spark, sf_dir))


@query
def s7_collected_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of every project: all its own pages and pasted ones, and the first 15 external pages by id."""
    from pyspark.sql import Window

    d = read_table(spark, sf_dir, "fx_document").select("doc_id", "project_id", "kind", "origin").distinct()
    capped = (F.col("kind") == "external") & (F.coalesce("origin", F.lit("")) == "url")
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy("doc_id"))  # the limit goes below the shuffle, so no project fills a task
    first = d.where(capped).withColumn("r", rank).where("r <= 15").drop("r")
    return d.where(~capped).unionByName(first).select("doc_id", "project_id", "kind")


SQL["s7_collected_sources"] = """WITH d AS (SELECT DISTINCT doc_id, project_id, kind, kind = 'external' AND coalesce(origin, '') = 'url' AS capped FROM fx_document),
r AS (SELECT *, row_number() OVER (PARTITION BY project_id, capped ORDER BY doc_id) AS r FROM d) SELECT doc_id, project_id, kind FROM r WHERE NOT capped OR r <= 15"""


@query
def q_all_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries of every project, trimmed, each once whatever its case, the main one first."""
    p = read_table(spark, sf_dir, "fx_project").select("project_id", F.concat(F.array("query"), F.coalesce("extra_queries", F.array().cast("array<string>"))).alias("qs")).distinct()
    x = p.select("project_id", F.posexplode("qs").alias("pos", "q")).withColumn("q", F.trim("q")).where(F.coalesce("q", F.lit("")) != "")
    first = x.groupBy("project_id", F.lower("q").alias("k")).agg(F.min(F.struct("pos", "q")).alias("m"))
    return first.select("project_id", F.col("m.q").alias("query"), F.col("m.pos").cast("bigint").alias("pos"))


SQL["q_all_queries"] = """WITH p AS (SELECT DISTINCT project_id, list_concat([query], coalesce(extra_queries, [])) AS qs FROM fx_project), x AS (SELECT project_id, trim(unnest(qs)) AS q, generate_subscripts(qs, 1) - 1 AS pos FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY project_id, lower(q) ORDER BY pos) AS k FROM x WHERE coalesce(q, '') <> '') SELECT project_id, q AS query, pos FROM r WHERE k = 1"""


# Schema types that describe a page, and those that describe an entity.
PAGE_TYPES = "Organization Corporation LocalBusiness Product SoftwareApplication Service Article NewsArticle BlogPosting FAQPage HowTo WebPage WebSite BreadcrumbList Review AggregateRating Person Brand ItemList Offer QAPage".split()
ENTITY_TYPES = "Organization Corporation LocalBusiness Brand Product SoftwareApplication Service".split()


def structured_data(docs: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, score) of parsed pages: JSON-LD, its types, whether it names the entity, and page metadata. `pattern` names the entity's pattern column."""
    nodes = F.transform("jsonld", lambda j: F.struct(F.get_json_object(j, "$.@type").alias("type"), F.coalesce(F.get_json_object(j, "$.name"), F.lit("")).alias("name"), F.get_json_object(j, "$.sameAs").alias("same")))
    d = docs.withColumn("nodes", nodes)
    entity = F.filter("nodes", lambda n: F.exists(F.array(*map(F.lit, ENTITY_TYPES)), lambda t: F.contains(F.coalesce(n["type"], F.lit("")), t)))
    named = F.exists(entity, lambda n: F.coalesce(F.rlike(n["name"], F.col(pattern)), F.lit(False)))
    related = F.size(F.array_intersect("schema_types", F.array(*map(F.lit, PAGE_TYPES))))
    pts = lambda cond, n: F.when(cond, float(n)).otherwise(0.0)
    span = lambda c, low, high: F.when(F.length(c).between(low, high), 10.0).when(F.length(c) > 0, 5.0).otherwise(0.0)
    score = pts(F.size("jsonld") > 0, 25) + 20 * F.least(F.lit(1.0), related / 3) + F.when(named, 10.0).when(F.size(entity) > 0, 5.0).otherwise(0.0) + pts(F.exists("nodes", lambda n: n["same"].isNotNull()), 5)
    score = score + span(F.col("description"), 70, 170) + span(F.col("title"), 20, 70) + pts(F.length("canonical") > 0, 5) + pts((F.length("og_title") > 0) & (F.length("og_description") > 0), 5)
    score = score + pts(F.exists("blocks", lambda b: b["type"].isin("list", "table")), 5) + pts((F.length("published") > 0) | (F.length("modified") > 0), 5)
    return d.select("doc_id", F.round(score, 4).alias("score"))


@query
def v5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the embeddings by k-means, k the number of labels but at most half of the vectors; fewer than three vectors are one cluster. Labels of clusters have no fixed meaning."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    e = read_table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features")).dropDuplicates(["vec_id"])
    n = e.count()
    if n < 3:
        return e.select("vec_id", F.lit(0).alias("cluster"))
    return KMeans(k=max(2, min(10, n // 2)), seed=0, maxIter=20).fit(e).transform(e).select("vec_id", F.col("prediction").alias("cluster"))


def action_plan(ranked: DataFrame, spark: SparkSession) -> DataFrame:
    dims = spark.createDataFrame([(i, k, e) for i, (k, _, _, _, e) in W.METRICS.items()], "metric_id int, key string, effort int")
    x = ranked.join(F.broadcast(dims), "metric_id")
    horizon = F.when((F.col("effort") == 1) & (F.col("priority") >= 0.55), "immediate").when(F.col("effort") == 3, "strategic").otherwise("near_term")
    rows = x.select("doc_id", horizon.alias("horizon"), F.struct((-F.col("priority")).alias("p"), "metric_id", "key").alias("m"))
    return rows.groupBy("doc_id", "horizon").agg(F.array_join(F.transform(F.sort_array(F.collect_list("m")), lambda m: m["key"]), ", ").alias("plan"))


@query
def k6_action_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak metrics of every page by horizon, in order of priority."""
    return action_plan(k1_priorities(spark, sf_dir), spark)


_keys = ", ".join(f"({i}, '{k}', {e})" for i, (k, _, _, _, e) in W.METRICS.items())
SQL["k6_action_plan"] = f"""WITH k AS ({SQL['k1_priorities']}), kd(metric_id, key, effort) AS (VALUES {_keys}), h AS (SELECT doc_id, priority, k.metric_id, key, CASE WHEN effort = 1 AND priority >= 0.55 THEN 'immediate' WHEN effort = 3 THEN 'strategic' ELSE 'near_term' END AS horizon FROM k JOIN kd USING (metric_id))
SELECT doc_id, horizon, string_agg(key, ', ' ORDER BY priority DESC, metric_id) AS plan FROM h GROUP BY doc_id, horizon"""


def json_rows(r: DataFrame) -> DataFrame:
    return r.select("doc_id", F.to_json(F.struct("overall", "band", "provisional", *W.PILLARS), {"ignoreNullFields": "false"}).alias("json"))


@query
def o2_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every page as one JSON object, for a JSON sink."""
    return json_rows(A.r1_scores(spark, sf_dir))


_pillars = ", ".join(f"'{p}': {p}" for p in W.PILLARS)
SQL["o2_json"] = f"WITH r AS ({A.SQL['r1_scores']}) SELECT doc_id, CAST(to_json({{'overall': overall, 'band': band, 'provisional': provisional, {_pillars}}}) AS VARCHAR) AS json FROM r"
SQL["o2_report_lines"] = f"WITH r AS ({A.SQL['r1_scores']}) SELECT doc_id, '| ' || doc_id || ' | ' || coalesce(printf('%.1f', overall), '-') || ' | ' || band || ' |' AS line FROM r"
SQL["s11_url_lines"] = f"""WITH p AS (SELECT DISTINCT project_id, coalesce(website, '') || chr(10) || coalesce(array_to_string(list_transform(competitors, lambda c: c.domain), ', '), '') AS lines FROM fx_project),
x AS (SELECT project_id, unnest(string_split_regex(lines, '[\\s,]+')) AS u FROM p) SELECT DISTINCT project_id, {A._normal_sql('u')} AS url FROM x WHERE u <> ''"""
