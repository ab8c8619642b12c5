"""Queries of the training-data problems, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenpage.llm import boilerplate, garbled, near_copies, packing, pieces, residue, site_lines, tokens
from lumenpage.functions.urls import site_host
from lumenpage.sources import read_table, stage


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, answers = read_table(spark, sf_dir, "fx_document"), read_table(spark, sf_dir, "fx_answer")
    return docs.select(F.lit("fx_document").alias("tbl"), F.col("doc_id").cast("bigint").alias("rec_id"), site_host(F.col("url")).alias("origin"), "text").unionByName(
        answers.select(F.lit("fx_answer").alias("tbl"), F.col("answer_id").cast("bigint").alias("rec_id"), F.col("label").alias("origin"), "text")
    )


KEYS = ["tbl", "rec_id"]


def _garbled(texts: DataFrame) -> tuple[DataFrame, garbled.Model, DataFrame]:
    """(records, model, ciphers) of the garbled records among the texts."""
    found = stage(garbled.stretches(texts, KEYS, F.col("origin"), "text"), "found")
    model = garbled.learn(found)
    weighed = garbled.weigh_records(found, KEYS, model)
    ciphers = garbled.learn_ciphers(weighed, model)
    return garbled.judge(weighed, KEYS, model, ciphers), model, ciphers


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, rec_id) of every record whose text holds a stretch decoded with a wrong encoding."""
    return _garbled(_texts(spark, sf_dir))[0]


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, rec_id, restored) of every record that holds a garbled stretch, with its text after they are undone."""
    texts = _texts(spark, sf_dir)
    bad, model, ciphers = _garbled(texts)
    wanted = texts.join(bad, KEYS, "left_semi").dropDuplicates(KEYS)
    return garbled.restore(wanted, KEYS, "text", model, source=F.col("origin"), ciphers=ciphers)


P2 = {"words": 3, "similarity": 0.5, "least_words": 50}


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id_a, doc_id_b) of every pair of records of 50 words or more whose resemblance is at least 0.5."""
    docs = read_table(spark, sf_dir, "fx_document").select("doc_id", "title", "text")
    return near_copies.similar_pairs(docs, "doc_id", "title", "text", **P2).select(F.col("a").cast("bigint").alias("doc_id_a"), F.col("b").cast("bigint").alias("doc_id_b"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of 50 words or more with its class of equal texts and its group of records alike beyond the problem's threshold."""
    docs = read_table(spark, sf_dir, "fx_document").select("doc_id", "title", "text")
    return near_copies.similar_groups(docs, "doc_id", "title", "text", **P2)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id) of every record with template residue, filler, an error message or a script notice."""
    docs = read_table(spark, sf_dir, "fx_document").select("doc_id", "title", "text", "error", "ok", "url")
    return residue.find_residue(docs, "doc_id", residue.fit_model(docs)).select(F.col("doc_id").cast("bigint"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos) of every block outside its page's main body."""
    blocks, docs = read_table(spark, sf_dir, "fx_block"), read_table(spark, sf_dir, "fx_document")
    return boilerplate.find_furniture(blocks, docs.select("doc_id", "url")).select(F.col("doc_id").cast("bigint"), F.col("pos").cast("bigint"))


def p5_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, main_text) of every page."""
    blocks, docs = read_table(spark, sf_dir, "fx_block"), read_table(spark, sf_dir, "fx_document")
    return boilerplate.main_text(blocks, boilerplate.find_furniture(blocks, docs.select("doc_id", "url")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no) of every occurrence of a line repeated within its host."""
    docs = read_table(spark, sf_dir, "fx_document").select("doc_id", "text", "url")
    return site_lines.find_repeated(docs, "doc_id", "text", "url").select(F.col("doc_id").cast("bigint"), F.col("line_no").cast("bigint"))


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines repeated within its host, in two different documents and on two days at least, so that a republished article keeps
    its lines."""
    docs = read_table(spark, sf_dir, "fx_document").select("doc_id", "text", "url", "published", "page_lang")
    days = site_lines.publication_days(docs, "published", read_table(spark, sf_dir, "locale_zone"), "page_lang", "day")
    return site_lines.strip_repeated(days, "doc_id", "text", "url", "day", min_clusters=2, min_days=2).select("doc_id", "clean_text").dropDuplicates(["doc_id"])


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids) of every text of documents."""
    return tokens.encode_corpus(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text").select(F.col("doc_id").cast("bigint"), "ids")


def p7_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) of every text of documents, encoded and decoded again."""
    return tokens.decode_corpus(stage(p7_ids(spark, sf_dir), "ids"), "doc_id", "ids")


def p8_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents, or part of one over the capacity, with its container."""
    sizes = packing.item_sizes(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return packing.pack(packing.as_items(sizes, "doc_id", packing.CAPACITY, packing.LOSS), "doc_id")


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents as ordered pieces within the limit."""
    return pieces.cut_pieces(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


QUERIES = {"p1_found": p1_found, "p1_restored": p1_restored, "p2_found": p2_found, "p2_groups": p2_groups, "p3_found": p3_found, "p5_found": p5_found, "p5_main": p5_main, "p6_found": p6_found, "p6_clean": p6_clean, "p7_ids": p7_ids, "p7_decode": p7_decode, "p8_bins": p8_bins, "p9_pieces": p9_pieces}

HOST_SQL = r"nullif(regexp_replace(regexp_replace(regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:\s]*)', 1), '\.$', ''), '^www\.', ''), '')"
LINE_SQL = r"regexp_replace(trim(regexp_replace(lower(line), '[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')), '[0-9]+', '0', 'g')"
LINES_SQL = f"""
docs AS (SELECT DISTINCT doc_id, {HOST_SQL} AS host, text FROM fx_document WHERE url IS NOT NULL AND length(text) > 0),
lines AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM docs WHERE host IS NOT NULL),
folded AS (SELECT doc_id, host, line_no, line AS raw, {LINE_SQL} AS k FROM lines),
sizes AS (SELECT host, count(DISTINCT doc_id) AS n FROM docs GROUP BY host),
often AS (SELECT f.host, k FROM folded f JOIN sizes s ON f.host = s.host WHERE k <> '' GROUP BY f.host, k, s.n
          HAVING count(DISTINCT doc_id) >= 5 AND count(DISTINCT doc_id) >= 0.15 * s.n)
"""

SQL = {
    "p2_found": r"""WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM fx_document),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM d WHERE len(w) >= 50),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL)
SELECT a AS doc_id_a, b AS doc_id_b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE k >= 0.5 * (p.n + q.n - k)""",
    "p6_found": f"WITH {LINES_SQL} SELECT DISTINCT doc_id, CAST(line_no AS BIGINT) AS line_no FROM folded f JOIN often o ON f.host = o.host AND f.k = o.k",
    "p7_decode": "SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents",
}
