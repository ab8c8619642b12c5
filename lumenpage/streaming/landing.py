"""An extension beyond batch: pages that arrive in a folder are parsed and appended, late repeats folded by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenpage.operators.html import extract_documents

PAGE_SCHEMA = "doc_id bigint, url string, html string, arrived timestamp"


def landing_pages(spark: SparkSession, folder: str, delay: str = "2 hours", files: int = 1000) -> DataFrame:
    """Parsed pages of a folder of Parquet files. A page that comes again within `delay` of event time counts once; state is bounded by the watermark."""
    raw = spark.readStream.schema(PAGE_SCHEMA).option("maxFilesPerTrigger", files).parquet(folder)
    once = raw.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["doc_id", "url"])
    return extract_documents(once, "doc_id", "html", "url")


def hourly_counts(pages: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Arrivals by hour of event time and host."""
    from lumenpage.functions.urls import site_host

    return pages.withWatermark("arrived", delay).groupBy(F.window("arrived", "1 hour"), site_host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("pages"))


def append_to(pages: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    return pages.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
