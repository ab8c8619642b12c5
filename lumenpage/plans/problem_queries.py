"""Queries of the general data problems: timestamps."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenpage.operators.timestamps import normalise_timestamps
from lumenpage.sources import read_table

TIME_FIELDS = ("published", "modified", "fetched_at")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, field_name, utc_us) of every time field that names a definite instant or day."""
    docs = read_table(spark, sf_dir, "fx_document").select("doc_id", "page_lang", *TIME_FIELDS).dropDuplicates()
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("value")) for c in TIME_FIELDS])).alias("f")
    long = docs.select("doc_id", "page_lang", fields).select("doc_id", "page_lang", "f.*").where(F.regexp_like("value", F.lit("[0-9]")))
    out = normalise_timestamps(long, "value", read_table(spark, sf_dir, "locale_zone"), "page_lang")
    return out.where("utc_us is not null").select(F.col("doc_id").cast("bigint"), "field_name", "utc_us")


QUERIES = {"p4_found": p4_found}

SQL: dict[str, str] = {}
