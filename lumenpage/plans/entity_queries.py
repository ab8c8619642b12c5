"""Queries about the target entity of each page's project, and coverage of the query's subtopics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenpage.config import lexicons as L
from lumenpage.config import weights as W
from lumenpage.functions import queries as qf
from lumenpage.functions import text
from lumenpage.operators import blocks as B
from lumenpage.operators.entities import CAPITALS, FORMS, any_variant, entity_table, name_pattern, name_variants, relation_table
from lumenpage.operators.similarity import sim_to_score, tfidf_similarity
from lumenpage.plans import sql as S
from lumenpage.plans.page_queries import BLOCKS, WORDS, _qt, clamp, documents, primary_queries, rounded, scale, sql_tfidf, sscale
from lumenpage.sources import read_table, stage

QUERIES: dict = {}
SQL: dict[str, str] = {}

# What is said of an entity in a sentence about it.
OFFER = r"(?i)\b(?:provides?|offers?|helps?|enables?|specialis\w+ in|delivers?|builds?|makes?|sells?|supplies|automates?|lets? you|allows?|designed to|used to)\b"
IDENTITY = r"(?i)\b(?:founded|established|launched|headquartered|based in|located in|operates in|since (?:19|20)\d{2}|offices? in)\b"
AUDIENCE = r"(?i)\b(?:for (?:small|medium|large|growing|enterprise|freelance|local|busy|teams|businesses|companies|individuals|people|organisations|organizations|[a-z]+s\b)|designed for|built for|aimed at|suited to|ideal for|made for|used by)\b"
DEFINES = r"(?:\W+\w+){0,3}?\s+(?:is|are|was)\s+(?:a|an|the|one of)\b"


# Letters beyond ASCII, which the SQL engine's word boundaries would not count as letters.
LETTERS = r"[\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2FF}\x{370}-\x{1FFF}\x{3041}-\x{9FFF}\x{AC00}-\x{D7A3}]"


def sql_hit(x: str, how: str = "regexp_matches") -> str:
    return f"{how}(regexp_replace({x}, '{LETTERS}', 'q', 'g'), pat)"


def query(f):
    QUERIES[f.__name__] = f
    return f


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project_id, entity, website, pattern, variants) of projects with an entity."""
    p = read_table(spark, sf_dir, "fx_project").select("project_id", "entity", "website").distinct()
    known = any_variant(name_variants(F.col("entity"), F.col("website")))
    return p.withColumns({"pattern": name_pattern(F.col("entity"), F.col("website")), "variants": known}).where("pattern is not null")


def rivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project_id, rivals): the competitors of each project with their patterns, in order; projects are of fixed number."""
    p = read_table(spark, sf_dir, "fx_project").select("project_id", "competitors").distinct()
    named = F.filter("competitors", lambda c: F.trim(F.coalesce(c["name"], F.lit(""))) != "")
    return p.select("project_id", F.transform(named, lambda c: F.struct(c["name"].alias("name"), name_pattern(c["name"], c["domain"]).alias("pattern"))).alias("rivals"))


def sql_variants(name: str, website: str) -> str:
    full = f"trim(coalesce({name}, ''))"
    stem = f"string_split({S.domain(f'coalesce({website}, {chr(39)*2})')}, '.')[1]"
    parts = f"list_distinct(list_filter([{full}, trim(regexp_replace({full}, {S.q(FORMS)}, '')), CASE WHEN length({stem}) >= 4 THEN {stem} ELSE '' END], lambda v: v <> ''))"
    return f"list_transform(list_sort(list_transform({parts}, lambda v: {{'n': -length(v), 'v': v}})), lambda s: s.v)"


def sql_alternatives(variants: str, edges: bool) -> str:
    """The variants, each between word boundaries if its end is a word character, and between their opposites if not: the engine has no lookaround."""
    esc = r"regexp_replace(regexp_replace(v, '([.^$|()\[\]{}*+?\\-])', '\\\1', 'g'), ' ', '[\\s-]+', 'g')"
    edge = lambda at: f"CASE WHEN regexp_matches(v, '{at}') THEN '\\b' ELSE '\\B' END"
    one = f"{edge('^[0-9A-Za-z_]')} || {esc} || {edge('[0-9A-Za-z_]$')}" if edges else esc
    plain = f"list_transform({variants}, lambda v: regexp_replace(v, '{LETTERS}', 'q', 'g'))"
    return f"array_to_string(list_transform({plain}, lambda v: {one}), '|')"


def sql_pattern(name: str, website: str) -> str:
    v = sql_variants(name, website)
    return f"CASE WHEN trim(coalesce({name}, '')) <> '' THEN CASE WHEN len(list_filter({v}, lambda v: length(v) <= 3)) > 0 THEN '' ELSE '(?i)' END || '(?:' || {sql_alternatives(v, True)} || ')' END"


ENT = f"e AS (SELECT * FROM (SELECT DISTINCT project_id, query, entity, website, competitors, {sql_pattern('entity', 'website')} AS pat, {sql_alternatives(sql_variants('entity', 'website'), False)} AS variants FROM fx_project) WHERE pat IS NOT NULL)"


@query
def e1_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of its project's entity in every document."""
    d = read_table(spark, sf_dir, "fx_document").join(entities(spark, sf_dir), "project_id")
    return d.select("doc_id", F.regexp_count(text.text_or_empty(F.col("text")), F.col("pattern")).cast("bigint").alias("mentions"), F.coalesce(F.rlike(text.text_or_empty(F.col("title")), F.col("pattern")), F.lit(False)).alias("in_title")).dropDuplicates(["doc_id"])


SQL["e1_mentions"] = f"WITH {ENT} SELECT DISTINCT doc_id, len({sql_hit("coalesce(text, '')", 'regexp_extract_all')}) AS mentions, {sql_hit("coalesce(title, '')")} AS in_title FROM fx_document JOIN e USING (project_id)"


def _f(c):
    return F.when(c, 1.0).otherwise(0.0)


@query
def m9_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where and how often a page names its project's entity; 0 without a mention. The tables hold no page metadata, so that part counts as absent."""
    ents = entities(spark, sf_dir).select("project_id", "pattern")
    d = read_table(spark, sf_dir, "fx_document").join(ents, "project_id")
    t = text.text_or_empty(F.col("text"))
    hit = lambda c: F.rlike(c, F.col("pattern"))
    docs = d.select("doc_id", "pattern", F.regexp_count(t, F.col("pattern")).alias("n"), text.word_count(t).alias("w"), _f(hit(text.text_or_empty(F.col("title")))).alias("title"), _f(hit(F.array_join(F.slice(text.blank_words(t), 1, 100), " "))).alias("first")).dropDuplicates(["doc_id"])
    b = B.block_table(spark, sf_dir)
    keys = docs.select("doc_id", "pattern")
    heads = b.where("type = 'heading'").join(keys, "doc_id").groupBy("doc_id").agg(F.max(F.when(F.col("level") == 1, _f(hit(F.col("text")))).otherwise(0.0)).alias("h1"), F.max(_f(hit(F.col("text")))).alias("head"))
    secs = B.sections(b).join(keys, "doc_id").groupBy("doc_id").agg(F.sum(_f(hit(F.concat_ws(" ", F.array_join("paragraphs", " "), "heading")))).alias("secs"))
    x = docs.join(heads, "doc_id", "left").join(secs, "doc_id", "left").na.fill(0.0, ["h1", "head", "secs"])
    per = F.col("n") / F.greatest(F.lit(1), F.col("w")) * 1000
    dens = F.when(per.between(3, 20), 1.0).when(per < 3, F.least(F.lit(1.0), per / 3)).otherwise(F.greatest(F.lit(0.4), 1 - (per - 20) / 40))
    score = 20 * F.col("title") + 15 * F.col("h1") + 15 * F.col("first") + 20 * dens + 10 * F.col("head") + 10 * F.least(F.lit(1.0), F.col("secs") / 3)
    return x.select("doc_id", F.col("n").cast("bigint").alias("mentions"), rounded(F.when(F.col("n") > 0, score).otherwise(0.0)).alias("score"))


_T = "coalesce(text, '')"
SQL["m9_presence"] = f"""WITH {BLOCKS}, {ENT}, d AS (SELECT DISTINCT doc_id, pat, len({sql_hit(_T, 'regexp_extract_all')}) AS n, {WORDS('text')} AS w, CASE WHEN {sql_hit("coalesce(title, '')")} THEN 1.0 ELSE 0.0 END AS title,
CASE WHEN {sql_hit("array_to_string(string_split(" + S.ws('text') + ", ' ')[1:100], ' ')")} THEN 1.0 ELSE 0.0 END AS first FROM fx_document JOIN e USING (project_id)),
h AS (SELECT b.doc_id, max(CASE WHEN level = 1 AND {sql_hit('text')} THEN 1.0 ELSE 0.0 END) AS h1, max(CASE WHEN {sql_hit('text')} THEN 1.0 ELSE 0.0 END) AS head FROM b JOIN d ON b.doc_id = d.doc_id WHERE type = 'heading' GROUP BY b.doc_id),
m AS (SELECT *, sum(CASE WHEN type = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS sid FROM b),
s AS (SELECT doc_id, sid, coalesce(string_agg(text, ' ' ORDER BY pos) FILTER (WHERE type = 'p'), '') || ' ' || coalesce(max(text) FILTER (WHERE type = 'heading'), '') AS body FROM m GROUP BY doc_id, sid HAVING count(*) FILTER (WHERE type IN ('p', 'list')) > 0),
c AS (SELECT s.doc_id, sum(CASE WHEN {sql_hit('body')} THEN 1.0 ELSE 0.0 END) AS secs FROM s JOIN d ON s.doc_id = d.doc_id GROUP BY s.doc_id), x AS (SELECT *, n / greatest(1, w) * 1000 AS per FROM d)
SELECT x.doc_id, n AS mentions, round(CASE WHEN n > 0 THEN 20 * title + 15 * coalesce(h1, 0) + 15 * first + 20 * CASE WHEN per BETWEEN 3 AND 20 THEN 1.0 WHEN per < 3 THEN least(1.0, per / 3) ELSE greatest(0.4, 1 - (per - 20) / 40) END + 10 * coalesce(head, 0) + 10 * least(1.0, coalesce(secs, 0) / 3) ELSE 0.0 END, 4) AS score
FROM x LEFT JOIN h ON x.doc_id = h.doc_id LEFT JOIN c ON x.doc_id = c.doc_id"""


@query
def m10_clarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page defines its entity, says what it offers, where it is, and for whom; 0 without a sentence about it."""
    d = read_table(spark, sf_dir, "fx_document").join(entities(spark, sf_dir).select("project_id", "pattern", "variants"), "project_id")
    d = d.select("doc_id", "pattern", "variants", text.sentences(F.col("text")).alias("s")).dropDuplicates(["doc_id"])
    own = F.filter(F.transform("s", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda y: F.rlike(y["x"], F.col("pattern")))
    d = d.select("doc_id", "variants", F.size("s").alias("n"), own.alias("own"))
    define = F.concat(F.lit("(?i)"), F.col("variants"), F.lit(DEFINES))
    pick = lambda p: F.filter("own", lambda y: F.rlike(y["x"], p))
    d = d.select("doc_id", "n", F.size("own").alias("own"), pick(define).alias("defs"), pick(F.lit(OFFER)).alias("offers"), F.size(pick(F.lit(IDENTITY))).alias("ids"), F.size(pick(F.lit(AUDIENCE))).alias("aud"))
    cut = F.greatest(F.lit(5), F.floor(F.col("n") * 0.2))
    early = F.exists(F.concat("defs", "offers"), lambda y: y["i"] < cut)
    score = F.when(F.size("defs") > 0, 35.0).when(F.size("offers") > 0, 15.0).otherwise(0.0) + F.when(F.size("offers") >= 2, 25.0).when(F.size("offers") == 1, 15.0).otherwise(0.0)
    score = score + 15 * _f(F.col("ids") > 0) + 15 * _f(F.col("aud") > 0) + 10 * _f(early)
    return d.select("doc_id", F.col("own").cast("bigint").alias("sentences"), F.size("defs").cast("bigint").alias("definitions"), F.size("offers").cast("bigint").alias("offers"), F.when(F.col("own") > 0, score).otherwise(0.0).alias("score"))


_L = lambda p: f"len(list_filter(own, lambda y: {S.like('y.x', p)}))"
_DEF = "'(?i)(?:' || variants || ')' || " + S.q(DEFINES)
SQL["m10_clarity"] = f"""WITH {ENT}, d0 AS (SELECT DISTINCT doc_id, pat, variants, {S.sentences('text')} AS s FROM fx_document JOIN e USING (project_id)),
d AS (SELECT doc_id, variants, len(s) AS n, list_filter(list_transform(s, lambda x, i: {{'i': i - 1, 'x': x}}), lambda y: {sql_hit('y.x')}) AS own FROM d0),
x AS (SELECT doc_id, n, len(own) AS own_n, list_filter(own, lambda y: regexp_matches(regexp_replace(y.x, '{LETTERS}', 'q', 'g'), {_DEF})) AS defs, list_filter(own, lambda y: {S.like('y.x', OFFER)}) AS offers, {_L(IDENTITY)} AS ids, {_L(AUDIENCE)} AS aud FROM d)
SELECT doc_id, own_n AS sentences, len(defs) AS definitions, len(offers) AS offers, CASE WHEN own_n > 0 THEN CASE WHEN len(defs) > 0 THEN 35.0 WHEN len(offers) > 0 THEN 15.0 ELSE 0.0 END + CASE WHEN len(offers) >= 2 THEN 25.0 WHEN len(offers) = 1 THEN 15.0 ELSE 0.0 END
 + CASE WHEN ids > 0 THEN 15.0 ELSE 0.0 END + CASE WHEN aud > 0 THEN 15.0 ELSE 0.0 END + CASE WHEN len(list_filter(list_concat(defs, offers), lambda y: y.i < greatest(5, floor(n * 0.2)))) > 0 THEN 10.0 ELSE 0.0 END ELSE 0.0 END::DOUBLE AS score FROM x"""


@query
def e3_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in every document by count, the 80 most frequent."""
    d = read_table(spark, sf_dir, "fx_document").select("doc_id", "text").dropDuplicates(["doc_id"]).select("doc_id", text.sentences(F.col("text")).alias("s"))
    return entity_table(d, "doc_id", "s").select("doc_id", "name", "kind", F.col("n").cast("bigint").alias("n"), F.col("rank").cast("bigint").alias("rank"))


_lead = r"regexp_matches(m, '^(?:[;:|.] |[A-Z])')"
_titles = "(?:" + "|".join(L.PERSON_TITLES) + ")"
_cased = "name = upper(name) AND regexp_matches(name, '[A-Z]')"
_kind = f"""CASE WHEN list_contains({S.strings(L.COUNTRIES + L.CITIES)}, lower(name)) THEN 'LOCATION' WHEN list_contains({S.strings(L.ORG_SUFFIXES)}, trim(lower(string_split(name, ' ')[-1]), '.')) THEN 'ORGANISATION'
WHEN (regexp_matches(trim(f.before), '{_titles}$') OR regexp_matches(' ' || f.before || ' ', ' {_titles} ') OR regexp_matches(f.after, '^(said|says|told)')) AND (contains(name, ' ') OR trim(f.before) <> '') THEN 'PERSON'
WHEN regexp_matches(name, '[0-9]|[a-z][A-Z]') THEN 'PRODUCT' WHEN {_cased} AND length(name) BETWEEN 2 AND 6 THEN 'TECHNOLOGY' WHEN regexp_matches(name, '^[A-Z][A-Za-z]* [A-Z][A-Za-z]*$') AND regexp_matches(trim(f.before), '(by|founder|ceo)$') THEN 'PERSON' ELSE 'BRAND_OR_PRODUCT' END"""
NAMES = rf"""st AS (SELECT DISTINCT doc_id, {S.sentences('text')} AS ss FROM fx_document), sx AS (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS sid FROM st),
rr AS (SELECT *, regexp_extract_all(s, {S.q('(?:[;:|.] |[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]|^)' + CAPITALS)}) AS r FROM sx), rx AS (SELECT doc_id, sid, s, unnest(r) AS m, generate_subscripts(r, 1) - 1 AS k FROM rr),
rw AS (SELECT doc_id, sid, s, k, {_lead} AS leads, regexp_replace(m, '^(?:[;:|.] |[^A-Z])', '') AS raw FROM rx), wd AS (SELECT *, string_split_regex(regexp_replace(raw, '[ \-''’&]+$', ''), '\s+') AS w FROM rw),
ix AS (SELECT *, list_filter(range(1, len(w) + 1), lambda i: NOT list_contains({S.strings(L.NON_NAMES)}, lower(w[i]))) AS ok FROM wd), nm AS (SELECT doc_id, sid, s, k, leads, raw, array_to_string(w[ok[1]:ok[-1]], ' ') AS name FROM ix WHERE len(ok) > 0),
fl AS (SELECT *, max(CASE WHEN NOT leads AND lower(raw) = lower(name) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, lower(name)) AS inside FROM nm WHERE length(name) >= 2),
kp AS (SELECT *, instr(s, name) AS spot FROM fl WHERE contains(name, ' ') OR NOT (list_contains({S.strings(L.NON_ACRONYMS)}, upper(name)) OR (leads AND NOT contains(raw, ' ') AND inside = 0 AND NOT ({_cased})))),
gn AS (SELECT doc_id, name, count(*) AS n, list_sort(list(sid))[1:8] AS sids, min({{'sid': sid, 'k': k, 'before': CASE WHEN spot > 0 THEN lower(s[greatest(spot - 30, 1):spot - 1]) ELSE '' END, 'after': CASE WHEN spot > 0 THEN trim(lower(substring(s, spot + length(name), 20))) ELSE '' END}}) AS f FROM kp GROUP BY doc_id, name),
en AS (SELECT * FROM (SELECT doc_id, name, {_kind} AS kind, n, sids, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f.sid, f.k) AS rank FROM gn) WHERE rank <= 80)"""
SQL["e3_entities"] = f"WITH {NAMES} SELECT doc_id, name, kind, n, rank FROM en"


def named_roles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(about, roles): about has (doc_id, sid, s), every sentence about the target; roles has (doc_id, name, kind, n, rank, role), every name with its role. A
    target named in the text that no name stands for comes first, and a competitor so named last."""
    ents = entities(spark, sf_dir).select("project_id", "entity", "pattern").join(rivals(spark, sf_dir), "project_id", "left")
    d = read_table(spark, sf_dir, "fx_document").select("doc_id", "project_id", "text").dropDuplicates(["doc_id"]).join(F.broadcast(ents), "project_id")  # one row a project
    known = F.coalesce("rivals", F.expr("array()"))
    d = d.withColumns({"s": text.sentences(F.col("text")), "target_n": F.regexp_count(text.text_or_empty(F.col("text")), F.col("pattern"))})
    counts = F.transform(known, lambda r, i: F.struct((i + 1000).alias("i"), r["name"].alias("name"), F.regexp_count(text.text_or_empty(F.col("text")), r["pattern"]).alias("n")))
    about = F.filter(F.transform("s", lambda x, i: F.struct(i.alias("sid"), x.alias("s"))), lambda y: F.rlike(y["s"], F.col("pattern")))
    d = stage(d.select("doc_id", F.trim("entity").alias("entity"), "pattern", known.alias("rivals"), "s", about.alias("about"), "target_n", F.filter(counts, lambda c: c["n"] > 0).alias("counts")), "named").hint("merge")  # as names repeat, files are far smaller than rows, and would be broadcast
    e = entity_table(d, "doc_id", "s").join(d.select("doc_id", "entity", "pattern", "rivals", F.transform("about", lambda y: y["sid"]).alias("about")), "doc_id")
    target = F.rlike("name", F.col("pattern")) | (F.lower("name") == F.lower("entity"))
    rival = F.exists("rivals", lambda r: F.rlike(F.col("name"), r["pattern"]))
    role = F.when(target, "target").when(rival, "competitor").when(F.arrays_overlap("sentences", "about"), "related").when(F.col("n") >= 2, "supporting").otherwise("unknown")
    e = stage(e.select("doc_id", "name", "kind", "n", "rank", role.alias("role")), "roles").hint("merge")
    plain = F.lit("BRAND_OR_PRODUCT").alias("kind")
    first = d.where("target_n > 0").join(e.where("role = 'target'"), "doc_id", "left_anti").select("doc_id", F.col("entity").alias("name"), plain, F.col("target_n").alias("n"), F.lit(0).alias("rank"), F.lit("target").alias("role"))
    seen = e.unionByName(first).select("doc_id", F.lower("name").alias("low"))
    last = d.select("doc_id", F.explode("counts").alias("c")).select("doc_id", F.col("c.name").alias("name"), plain, F.col("c.n").alias("n"), F.col("c.i").alias("rank"), F.lit("competitor").alias("role"))
    last = last.withColumn("low", F.lower("name")).join(seen, ["doc_id", "low"], "left_anti").drop("low")
    return d.select("doc_id", F.explode("about").alias("a")).select("doc_id", "a.*"), e.unionByName(first).unionByName(last)


@query
def e5_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role of every name: target, competitor, related (in a sentence with the target), supporting (twice or more), else unknown."""
    return named_roles(spark, sf_dir)[1].select("doc_id", "name", "kind", F.col("n").cast("bigint").alias("n"), "role")


ROLES = rf"""{NAMES}, rv AS (SELECT project_id, unnest(competitors) AS c, generate_subscripts(competitors, 1) AS i FROM (SELECT DISTINCT project_id, competitors FROM fx_project)),
rp AS (SELECT project_id, c.name AS name, i, {sql_pattern('c.name', 'c.domain')} AS pat FROM rv WHERE trim(coalesce(c.name, '')) <> ''), dt AS (SELECT DISTINCT doc_id, project_id, coalesce(text, '') AS text FROM fx_document),
dd AS (SELECT doc_id, project_id, text, trim(entity) AS entity, pat, len({sql_hit('text', 'regexp_extract_all')}) AS tn FROM dt JOIN e USING (project_id)), ab AS (SELECT sx.doc_id, sid, s FROM sx JOIN dd ON sx.doc_id = dd.doc_id WHERE {sql_hit('s')}),
al AS (SELECT doc_id, list(sid) AS sids FROM ab GROUP BY doc_id), rn AS (SELECT DISTINCT en.doc_id, en.name FROM en JOIN dd ON en.doc_id = dd.doc_id JOIN rp ON rp.project_id = dd.project_id WHERE {sql_hit('en.name').replace('pat)', 'rp.pat)')}),
r0 AS (SELECT en.doc_id, en.name, kind, n, rank, CASE WHEN {sql_hit('en.name')} OR lower(en.name) = lower(entity) THEN 'target' WHEN rn.name IS NOT NULL THEN 'competitor' WHEN list_has_any(en.sids, coalesce(al.sids, [])) THEN 'related' WHEN n >= 2 THEN 'supporting' ELSE 'unknown' END AS role
 FROM en JOIN dd ON en.doc_id = dd.doc_id LEFT JOIN al ON al.doc_id = en.doc_id LEFT JOIN rn ON rn.doc_id = en.doc_id AND rn.name = en.name),
r1 AS (SELECT * FROM r0 UNION ALL SELECT doc_id, entity, 'BRAND_OR_PRODUCT', tn, 0, 'target' FROM dd WHERE tn > 0 AND doc_id NOT IN (SELECT doc_id FROM r0 WHERE role = 'target')),
rc AS (SELECT doc_id, rp.name, len({sql_hit('text', 'regexp_extract_all').replace('pat)', 'rp.pat)')}) AS n, i FROM dd JOIN rp ON dd.project_id = rp.project_id),
ro AS (SELECT * FROM r1 UNION ALL SELECT doc_id, name, 'BRAND_OR_PRODUCT', n, 1000 + i, 'competitor' FROM rc WHERE n > 0 AND NOT EXISTS (SELECT 1 FROM r1 WHERE r1.doc_id = rc.doc_id AND lower(r1.name) = lower(rc.name)))"""
SQL["e5_roles"] = f"WITH {ENT}, {ROLES} SELECT doc_id, name, kind, n, role FROM ro"


def told_relations(about: DataFrame, roles: DataFrame) -> DataFrame:
    others = roles.where("role <> 'target'").groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "name", "kind"))), lambda x: F.struct(x["name"].alias("name"), x["kind"].alias("kind"))).alias("names"))
    return relation_table(about.join(others, "doc_id"), "doc_id", "sid", "s", "names")


@query
def e8_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of every document's target with other names."""
    return told_relations(*named_roles(spark, sf_dir))


_verb = " UNION ALL ".join(f"SELECT doc_id, sid, {i} AS vi, '{r}' AS relation, string_split(regexp_replace(s, {S.q('(?i)(' + p + ')')}, chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS ps FROM ab" for i, (r, p) in enumerate(L.RELATIONSHIPS.items()))
TOLD = rf"""hs AS (SELECT ab.doc_id, sid, instr(s, name) AS spot, rank, name, kind FROM ab JOIN ro ON ab.doc_id = ro.doc_id WHERE role <> 'target' AND contains(s, name)), vb AS ({_verb}),
vx AS (SELECT doc_id, sid, vi, relation, j, string_split(ps[j], chr(2))[1] AS verb, length(replace(array_to_string(ps[1:j - 1], ''), chr(2), '')) + length(string_split(ps[j], chr(2))[1]) AS ends FROM (SELECT *, unnest(range(2, len(ps) + 1)) AS j FROM vb)),
va AS (SELECT vx.*, spot, rank, name, kind, max(CASE WHEN kind = 'LOCATION' THEN 1 ELSE 0 END) OVER (PARTITION BY vx.doc_id, vx.sid, vi, j) AS places FROM vx JOIN hs ON vx.doc_id = hs.doc_id AND vx.sid = hs.sid WHERE spot >= ends AND NOT contains(verb, name)),
vr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sid, vi, j ORDER BY spot, rank) AS o FROM va WHERE relation <> 'location' OR places = 0 OR kind = 'LOCATION'),
cm AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sid ORDER BY rank) AS o FROM hs WHERE NOT EXISTS (SELECT 1 FROM vx WHERE vx.doc_id = hs.doc_id AND vx.sid = hs.sid)),
tl AS (SELECT doc_id, sid, vi, j, o, relation, name, kind FROM vr WHERE o <= 2 UNION ALL SELECT doc_id, sid, 0, 0, o, 'co-mentioned', name, kind FROM cm WHERE o <= 2),
rl AS (SELECT doc_id, relation, name AS object, kind FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, relation, lower(name) ORDER BY sid, vi, j, o) AS first FROM tl) WHERE first = 1)"""
SQL["e8_relations"] = f"WITH {ENT}, {ROLES}, {TOLD} SELECT doc_id, relation, object, kind FROM rl"


@query
def m11_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Related names and competitors, typed relations, and kinds of the names; 0 without a sentence about the entity. Schema properties aren't in the tables
    and count as absent."""
    about, roles = named_roles(spark, sf_dir)
    near = F.col("role").isin("related", "competitor")
    r = roles.groupBy("doc_id").agg(F.sum(_f(near)).alias("related"), F.count_distinct(F.when(near, F.col("kind"))).alias("kinds"))
    rel = told_relations(about, roles).where("relation <> 'co-mentioned'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("typed"))
    docs = documents(spark, sf_dir, "project_id").join(entities(spark, sf_dir).select("project_id"), "project_id").select("doc_id")
    x = docs.join(about.select("doc_id", F.lit(1).alias("said")).distinct(), "doc_id", "left").join(r, "doc_id", "left").join(rel, "doc_id", "left").na.fill(0)
    score = 40 * F.least(F.lit(1.0), F.col("related") / 8) + 30 * F.least(F.lit(1.0), F.col("typed") / 4) + 15 * F.least(F.lit(1.0), F.col("kinds") / 3)
    return x.select("doc_id", F.col("related").cast("bigint").alias("related"), "typed", rounded(F.when(F.col("said") > 0, score).otherwise(0.0)).alias("score"))


SQL["m11_relationships"] = f"""WITH {ENT}, {ROLES}, {TOLD}, rg AS (SELECT doc_id, count(*) AS related, count(DISTINCT kind) AS kinds FROM ro WHERE role IN ('related', 'competitor') GROUP BY doc_id), rt AS (SELECT doc_id, count(*) AS typed FROM rl WHERE relation <> 'co-mentioned' GROUP BY doc_id)
SELECT dd.doc_id, coalesce(related, 0) AS related, coalesce(typed, 0) AS typed, round(CASE WHEN dd.doc_id IN (SELECT doc_id FROM ab) THEN 40 * least(1.0, coalesce(related, 0) / 8) + 30 * least(1.0, coalesce(typed, 0) / 4) + 15 * least(1.0, coalesce(kinds, 0) / 3) ELSE 0.0 END, 4) AS score
FROM dd LEFT JOIN rg ON rg.doc_id = dd.doc_id LEFT JOIN rt ON rt.doc_id = dd.doc_id"""


def passage_sims(spark: SparkSession, sf_dir: str, only: str = "true") -> tuple[DataFrame, DataFrame]:
    """(passages, probes): the passages of the documents that meet `only`, with the similarity of each to its project's query."""
    p = B.passages(B.block_table(spark, sf_dir))
    probes = documents(spark, sf_dir, "project_id", "kind", "ok").where(only).join(primary_queries(spark, sf_dir), "project_id")
    probes = probes.join(p.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "project_id", F.lit(0).alias("probe"), F.col("query").alias("text"))
    sims = tfidf_similarity(p, probes.drop("project_id"), ["doc_id"], "pos", "probe").select("doc_id", "pos", "sim")
    x = p.join(probes.select("doc_id", "project_id", F.col("text").alias("query")), "doc_id").join(sims, ["doc_id", "pos"], "left").withColumn("sim", F.round(F.coalesce("sim", F.lit(0.0)), 6))
    return x, probes


@query
def m12_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance of a page's passages, and of those about the entity, to the query; NULL without passages."""
    x, probes = passage_sims(spark, sf_dir)
    pats = entities(spark, sf_dir).select("project_id", "pattern")
    qs = primary_queries(spark, sf_dir).select("project_id", F.transform(qf.query_terms(F.col("query")), text.light_stem).alias("a"), text.stem_set(F.col("query")).alias("z"))
    qs = qs.select("project_id", F.when(F.size("a") > 0, F.col("a")).otherwise(F.col("z")).alias("terms"))
    share = lambda c: F.when(F.size("terms") > 0, F.size(F.array_intersect("terms", text.stem_set(c))) / F.size("terms")).otherwise(0.0)
    x = x.join(qs, "project_id").join(pats, "project_id", "left")
    x = x.withColumns({"own": F.coalesce(F.rlike("text", F.col("pattern")), F.lit(False)), "has": share(F.col("text"))})
    top = F.row_number().over(Window.partitionBy("doc_id", "own").orderBy(F.col("sim").desc(), "pos"))
    a = x.withColumn("k", top).groupBy("doc_id").agg(
        F.avg(_f(F.col("sim") >= W.RELEVANT)).alias("rel"), F.coalesce(F.avg(F.when(F.col("own") & (F.col("k") <= 5), F.col("sim"))), F.lit(0.0)).alias("ent"),
        F.coalesce(F.avg(F.when(F.col("own"), _f(F.col("has") >= 0.5))), F.lit(0.0)).alias("co"),
    )
    docs = documents(spark, sf_dir, "project_id", "title").join(qs, "project_id").select("doc_id", "terms", _f(share(text.text_or_empty(F.col("title"))) >= 0.5).alias("title"))
    h = B.block_table(spark, sf_dir).where("type = 'heading'").join(docs.select("doc_id", "terms"), "doc_id").groupBy("doc_id").agg(F.sum(_f((F.col("level") == 1) & (share(F.col("text")) >= 0.5))).alias("h1"), F.avg(_f(share(F.col("text")) > 0)).alias("heads"))
    y = a.join(docs.drop("terms"), "doc_id").join(h, "doc_id", "left").na.fill(0.0, ["h1", "heads"])
    place = 50 * F.least(F.lit(1.0), (F.col("title") + F.col("h1")) / 2) + 50 * F.least(F.lit(1.0), F.col("heads") / 0.4)
    score = 0.35 * sim_to_score(F.col("ent"), *W.SIM_RANGE) + 0.25 * scale(F.col("rel"), 0.0, 0.6) + 0.2 * place + 20 * F.col("co")
    return y.select("doc_id", rounded(F.col("rel")).alias("relevant_share"), rounded(clamp(score), 3).alias("score"))


_has = lambda x: f"CASE WHEN len(terms) > 0 THEN len(list_intersect(terms, {S.stems(x)})) / len(terms) ELSE 0.0 END"
_PASS = f"""ph AS (SELECT *, last_value(CASE WHEN type = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS heading FROM b),
ps AS (SELECT doc_id, pos, text, coalesce(heading, '') AS heading FROM ph WHERE type <> 'heading' AND CASE WHEN {S.ws('text')} = '' THEN 0 ELSE len(string_split({S.ws('text')}, ' ')) END >= 8)"""
_Q = f"q AS (SELECT DISTINCT project_id, query, CASE WHEN len({_qt}) > 0 THEN {_qt} ELSE {S.stems('query')} END AS terms FROM fx_project WHERE trim(coalesce(query, '')) <> '')"
SQL["m12_relevance"] = f"""WITH {BLOCKS}, {ENT}, {_Q}, {_PASS}, f AS (SELECT DISTINCT doc_id, project_id, title FROM fx_document), qd AS (SELECT f.doc_id, f.title, q.query, q.terms, e.pat FROM f JOIN q USING (project_id) LEFT JOIN e USING (project_id)),
tx AS (SELECT doc_id, 'p' || pos AS tid, text FROM ps UNION ALL SELECT doc_id, 'q0', query FROM qd WHERE doc_id IN (SELECT doc_id FROM ps)), {sql_tfidf('tx', 'doc_id')},
x AS (SELECT ps.doc_id, ps.pos, round(coalesce(sim, 0.0), 6) AS sim, coalesce({sql_hit('text')}, FALSE) AS own, {_has('text')} AS has FROM ps JOIN qd ON ps.doc_id = qd.doc_id LEFT JOIN sims ON sims.doc_id = ps.doc_id AND sims.p = CAST(ps.pos AS VARCHAR)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, own ORDER BY sim DESC, pos) AS k FROM x),
a AS (SELECT doc_id, avg(CASE WHEN sim >= {W.RELEVANT} THEN 1.0 ELSE 0.0 END) AS rel, coalesce(avg(CASE WHEN own AND k <= 5 THEN sim END), 0.0) AS ent, coalesce(avg(CASE WHEN own THEN CASE WHEN has >= 0.5 THEN 1.0 ELSE 0.0 END END), 0.0) AS co FROM k GROUP BY doc_id),
hd AS (SELECT b.doc_id, sum(CASE WHEN level = 1 AND {_has('text')} >= 0.5 THEN 1.0 ELSE 0.0 END) AS h1, avg(CASE WHEN {_has('text')} > 0 THEN 1.0 ELSE 0.0 END) AS heads FROM b JOIN qd ON b.doc_id = qd.doc_id WHERE type = 'heading' GROUP BY b.doc_id),
t AS (SELECT doc_id, CASE WHEN {_has('title')} >= 0.5 THEN 1.0 ELSE 0.0 END AS title FROM qd)
SELECT a.doc_id, round(rel, 4) AS relevant_share, round(greatest(0.0, least(100.0, 0.35 * {sscale('ent', *W.SIM_RANGE)} + 0.25 * {sscale('rel', 0.0, 0.6)} + 0.2 * (50 * least(1.0, (t.title + coalesce(h1, 0)) / 2) + 50 * least(1.0, coalesce(heads, 0) / 0.4)) + 20 * co)), 3) AS score
FROM a JOIN t ON a.doc_id = t.doc_id LEFT JOIN hd ON a.doc_id = hd.doc_id"""


def _facet_rows() -> list[tuple[str, int, str, list[str]]]:
    return [(intent, i, label, words) for intent, sets in L.FACETS.items() for i, (label, words) in enumerate(sets.items())]


def _escaped(word: str) -> str:
    e = "".join("\\" + c if not (c.isalnum() or c == " ") else c for c in word.lower())
    return (r"\b" if word[:1].isalnum() else "") + e


def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project_id, facet, pattern, probe): subtopics of each project's query, by its intent and by its phrases; of fixed number."""
    qs = primary_queries(spark, sf_dir).withColumn("intent", qf.detect_intent(F.col("query"), F.col("entity")))
    fixed = spark.createDataFrame([(a, i, n, "(?i)" + "|".join(map(_escaped, k)), " ".join(k[:4])) for a, i, n, k in _facet_rows()], "intent string, i int, name string, pattern string, words string")
    base = qs.join(F.broadcast(fixed), "intent").select("project_id", "query", "i", "name", "pattern", "words")
    c = qs.select("project_id", "query", F.posexplode(qf.query_phrases(F.col("query"))).alias("k", "phrase"))
    last = F.element_at(F.split("phrase", " "), -1)
    stem = F.trim(F.concat_ws(" ", F.array_join(F.slice(F.split("phrase", " "), 1, F.size(F.split("phrase", " ")) - 1), " "), text.light_stem(last)))
    c = c.select("project_id", "query", (F.col("k") + 100).alias("i"), F.col("phrase").alias("name"), F.concat(F.lit(r"(?i)\b"), F.regexp_replace(stem, r"([^\p{L}\p{N} ])", r"\\$1")).alias("pattern"), stem.alias("words"))
    return base.unionByName(c).select("project_id", F.col("i").alias("facet"), "pattern", F.concat_ws(" ", "query", "name", "words").alias("probe"))


QUERIES["q4_facets"] = lambda spark, sf_dir: facets(spark, sf_dir).select("project_id", F.col("facet").cast("bigint").alias("facet"), "pattern", "probe")


def _facet_sql() -> str:
    from lumenpage.plans.text_queries import SQL as TEXT_SQL

    intent = TEXT_SQL["q1_intent"].split("SELECT DISTINCT query_id, ", 1)[1].rsplit(" AS intent FROM", 1)[0]
    phrases = TEXT_SQL["q2_phrases"].split("SELECT DISTINCT query_id, array_to_string(", 1)[1].rsplit(", '; ') AS phrases", 1)[0]
    rows = ", ".join(f"({S.q(a)}, {i}, {S.q(n)}, {S.q('(?i)' + '|'.join(map(_escaped, k)))}, {S.q(' '.join(k[:4]))})" for a, i, n, k in _facet_rows())
    last = S.stem("string_split(phrase, ' ')[-1]")
    return f"""fs(intent, i, name, pattern, words) AS (VALUES {rows}), fq AS (SELECT DISTINCT project_id, query, {intent} AS intent, {phrases} AS phrases FROM fx_project WHERE trim(coalesce(query, '')) <> ''),
fc AS (SELECT project_id, query, unnest(phrases) AS phrase, generate_subscripts(phrases, 1) - 1 AS k FROM fq), fw AS (SELECT *, trim(array_to_string(string_split(phrase, ' ')[1:-2], ' ') || ' ' || {last}) AS words FROM fc),
facets AS (SELECT project_id, CAST(i AS BIGINT) AS facet, pattern, query || ' ' || name || ' ' || words AS probe FROM fq JOIN fs USING (intent)
 UNION ALL SELECT project_id, k + 100, '(?i)\\b' || regexp_replace(words, '([^\\p{{L}}\\p{{N}} ])', '\\\\\\1', 'g'), query || ' ' || phrase || ' ' || words FROM fw)"""


SQL["q4_facets"] = f"WITH {_facet_sql()} SELECT project_id, facet, pattern, probe FROM facets"


@query
def m8_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtopics of the query that a page covers in full, in part, or not at all; pages without passages are left out."""
    b = B.block_table(spark, sf_dir)
    p = B.passages(b).withColumn("text", F.concat_ws(". ", "heading", "text"))
    asked = documents(spark, sf_dir, "project_id").join(p.select("doc_id").distinct(), "doc_id", "left_semi")
    asked = stage(asked, "asked").hint("merge")  # a row a page: its file is so small that it would be broadcast
    known = F.broadcast(stage(facets(spark, sf_dir), "facets"))  # joined last, so that no table has a subtopic's texts for every page
    probes = asked.join(known, "project_id").select("doc_id", "facet", F.col("probe").alias("text"))
    sims = tfidf_similarity(p.select("doc_id", "pos", "text"), probes, ["doc_id"], "pos", "facet")
    pairs = p.select("doc_id", "pos", "text").join(asked, "doc_id").join(known, "project_id").select("doc_id", "facet", "pos", F.rlike("text", F.col("pattern")).alias("kw"))
    x = pairs.join(sims, ["doc_id", "pos", "facet"], "left").withColumn("sim", F.round(F.coalesce("sim", F.lit(0.0)), 6))
    a = x.groupBy("doc_id", "facet").agg(F.max("sim").alias("best"), F.sum(_f(F.col("kw"))).alias("hits"), F.coalesce(F.max(F.when(F.col("kw"), F.col("sim"))), F.lit(0.0)).alias("kw_sim"))
    heads = b.where("type = 'heading'").select("doc_id", F.lower("text").alias("h")).join(asked, "doc_id").join(known, "project_id").groupBy("doc_id", "facet").agg(F.max(_f(F.rlike("h", F.col("pattern")))).alias("head"))
    a = a.join(heads, ["doc_id", "facet"], "left").na.fill(0.0, ["head"])
    full = ((F.col("hits") > 0) & (F.col("head") > 0)) | ((F.col("hits") >= 2) & (F.col("kw_sim") >= W.COVER_LOW)) | (F.col("best") >= W.COVER_HIGH)
    part = (F.col("hits") > 0) | (F.col("head") > 0) | (F.col("best") >= W.COVER_LOW)
    a = a.withColumn("level", F.when(full, 1.0).when(part, 0.5).otherwise(0.0))
    return a.groupBy("doc_id").agg(F.count(F.lit(1)).alias("facets"), F.sum((F.col("level") == 1.0).cast("int")).alias("full"), F.round(F.avg("level") * 100, 3).alias("score"))


SQL["m8_coverage"] = f"""WITH {BLOCKS}, {_PASS}, {_facet_sql()}, pt AS (SELECT doc_id, pos, concat_ws('. ', heading, text) AS text FROM ps), f AS (SELECT DISTINCT doc_id, project_id FROM fx_document),
pr AS (SELECT f.doc_id, facet, pattern, probe FROM f JOIN facets USING (project_id) WHERE f.doc_id IN (SELECT doc_id FROM pt)),
tx AS (SELECT doc_id, 'p' || pos AS tid, text FROM pt UNION ALL SELECT doc_id, 'q' || facet, probe FROM pr), {sql_tfidf('tx', 'doc_id')},
x AS (SELECT pt.doc_id, pr.facet, regexp_matches(pt.text, pr.pattern) AS kw, round(coalesce(sim, 0.0), 6) AS sim FROM pt JOIN pr ON pt.doc_id = pr.doc_id LEFT JOIN sims ON sims.doc_id = pt.doc_id AND sims.p = CAST(pt.pos AS VARCHAR) AND sims.q = CAST(pr.facet AS VARCHAR)),
a AS (SELECT doc_id, facet, max(sim) AS best, count(*) FILTER (WHERE kw) AS hits, coalesce(max(sim) FILTER (WHERE kw), 0.0) AS kw_sim FROM x GROUP BY doc_id, facet),
hd AS (SELECT b.doc_id, facet, max(CASE WHEN regexp_matches(lower(text), pattern) THEN 1 ELSE 0 END) AS head FROM b JOIN pr ON b.doc_id = pr.doc_id WHERE type = 'heading' GROUP BY b.doc_id, facet),
l AS (SELECT a.doc_id, CASE WHEN (hits > 0 AND coalesce(head, 0) > 0) OR (hits >= 2 AND kw_sim >= {W.COVER_LOW}) OR best >= {W.COVER_HIGH} THEN 1.0 WHEN hits > 0 OR coalesce(head, 0) > 0 OR best >= {W.COVER_LOW} THEN 0.5 ELSE 0.0 END AS level FROM a LEFT JOIN hd ON a.doc_id = hd.doc_id AND a.facet = hd.facet)
SELECT doc_id, count(*) AS facets, count(*) FILTER (WHERE level = 1.0) AS full, round(avg(level) * 100, 3) AS score FROM l GROUP BY doc_id"""
