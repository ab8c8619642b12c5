"""Views of pages' block tables: outline, sections, passages. Windows are by page, which bounds a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenpage.functions import text
from lumenpage.sources import read_table

def page():
    """A page's blocks in order."""
    return Window.partitionBy("doc_id").orderBy("pos")


def block_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block once; NULL texts as empty ones."""
    b = read_table(spark, sf_dir, "fx_block")
    return b.dropDuplicates(["doc_id", "pos"]).withColumn("text", F.coalesce("text", F.lit("")))


def pasted_blocks(df: DataFrame, rec_id: str, body: str) -> DataFrame:
    """(rec_id, pos, type, level, text, items, ext_links) of pasted plain text: chunks between blank lines; a chunk that starts with # marks is a
    heading, one of two or more bulleted lines is a list, any other gives a paragraph for each line. NULL and blank texts give none."""
    chunks = F.posexplode(F.split(F.coalesce(body, F.lit("")), r"\n[ \t]*\n"))
    c = df.select(rec_id, chunks.alias("chunk_no", "chunk")).withColumn("chunk", F.trim(F.col("chunk"))).where("chunk <> ''")
    lines = F.filter(F.transform(F.split("chunk", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    bullet = r"^(?:[-*•]|\d+[.)])\s+"
    c = c.withColumn("lines", lines)
    heading = F.regexp_like(F.col("chunk"), F.lit(r"^#{1,6}\s+\S")) & (F.size("lines") == 1)
    listed = (F.size("lines") >= 2) & F.forall("lines", lambda x: F.regexp_like(x, F.lit(bullet)))
    kind = F.when(heading, "heading").when(listed, "list").otherwise("p")
    items = F.transform("lines", lambda x: F.regexp_replace(x, bullet, ""))
    one = F.when(heading, F.array(F.regexp_replace("chunk", r"^#{1,6}\s+", ""))).when(listed, F.array(F.array_join(items, " ; "))).otherwise(F.col("lines"))
    level = F.when(heading, F.length(F.regexp_extract("chunk", r"^(#{1,6})", 1)))
    rows = c.select(rec_id, "chunk_no", kind.alias("type"), level.cast("int").alias("level"), F.when(listed, items).alias("items"), F.posexplode(one).alias("line_no", "text"))
    pos = F.row_number().over(Window.partitionBy(rec_id).orderBy("chunk_no", "line_no")) - 1
    return rows.select(rec_id, pos.alias("pos"), "type", "level", text.normalize_ws(F.col("text")).alias("text"), "items", F.regexp_count("text", F.lit("https?://")).alias("ext_links"))


def sections(blocks: DataFrame) -> DataFrame:
    """(doc_id, section_id, heading, level, paragraphs, lists): text between headings; the part before the first has heading '' and level 0.
    Tables don't count; sections without paragraph and list are dropped."""
    n = F.sum(F.when(F.col("type") == "heading", 1).otherwise(0)).over(page())
    marked = blocks.withColumn("section_id", n)
    pick = lambda t: F.transform(F.sort_array(F.collect_list(F.when(F.col("type") == t, F.struct("pos", "text")))), lambda x: x["text"])
    grouped = marked.groupBy("doc_id", "section_id").agg(
        F.coalesce(F.max(F.when(F.col("type") == "heading", F.col("text"))), F.lit("")).alias("heading"),
        F.coalesce(F.max(F.when(F.col("type") == "heading", F.col("level"))), F.lit(0)).alias("level"),
        pick("p").alias("paragraphs"),
        pick("list").alias("lists"),
    )
    return grouped.where((F.size("paragraphs") > 0) | (F.size("lists") > 0))


def passages(blocks: DataFrame, min_words: int = 8) -> DataFrame:
    """(doc_id, pos, heading, type, text) of paragraphs, lists and tables of at least min_words words between blanks, with the last heading before."""
    heading = F.coalesce(F.last(F.when(F.col("type") == "heading", F.col("text")), ignorenulls=True).over(page()), F.lit(""))
    return blocks.withColumn("heading", heading).where((F.col("type") != "heading") & (F.size(text.blank_words(F.col("text"))) >= min_words)).select("doc_id", "pos", "heading", "type", "text")
