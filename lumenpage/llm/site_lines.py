"""Problem 6: lines repeated across the documents of one site.

Duplicate documents of a site collapse first: one cluster for each (host, text), carrying the number
of its records and its earliest publication value. Lines are then counted over clusters, publication
days and records in one aggregation with map-side combine, so a republished article costs one row. A day is that of the
normalised publication time; a cluster without one counts as a day of its own.
Texts are read once: hashes of hosts, texts and lines are staged, and only they are shuffled.

A line that is in at least `min_share` of a host's records is one of at most
(mean lines of a record) / min_share lines, so the set of repeated lines of a host is a small array
and joins the documents as one row per host. A hot host's documents are split by AQE's skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenpage.functions.urls import site_host
from lumenpage.operators.timestamps import normalise_timestamps
from lumenpage.sources import stage

MIN_RECORDS, MIN_SHARE = 5, 0.15


def line_key(line: Column) -> Column:
    """64-bit key of a line after folding case, white space and digit runs; NULL for a line that is then empty."""
    folded = F.regexp_replace(F.trim(F.regexp_replace(F.lower(line), r"(?U)\s+", " ")), "[0-9]+", "0")
    return F.when(folded != "", F.xxhash64(folded))


def publication_days(df: DataFrame, date: str, locales: DataFrame, locale: str, out: str) -> DataFrame:
    """df with `out`: the UTC day, counted from 1970, that `date` names in whatever spelling; NULL if it names none."""
    timed = normalise_timestamps(df, date, locales, locale, "published_us")
    return timed.withColumn(out, F.floor(F.col("published_us") / 86_400_000_000).cast("bigint")).drop("published_us")


def keyed_lines(df: DataFrame, rec_id: str, text: str, url: str, day: str | None = None) -> DataFrame:
    """(rec, hk, tk, day, lines) of every row with URL, host and text: hashes of host, text and lines. `day` names a column of whole numbers."""
    host, tk = site_host(F.col(url)), F.xxhash64(text)
    days = F.coalesce(F.col(day), tk) if day else tk
    cols = df.where(F.col(url).isNotNull() & (F.length(text) > 0) & host.isNotNull())
    return stage(cols.select(F.col(rec_id).alias("rec"), F.xxhash64(host).alias("hk"), tk.alias("tk"), days.alias("day"), F.transform(F.split(text, "\n"), line_key).alias("lines")), "lines")


def line_statistics(keyed: DataFrame) -> DataFrame:
    """(hk, lk, n_records, n_clusters, n_days, host_records) of every line of every host, of a result of keyed_lines().

    Repeated rows of a record count once. A cluster's day is the least of its records' days.
    """
    clusters = (
        keyed.groupBy("hk", "tk")
        .agg(F.count_distinct("rec").alias("n"), F.min("day").alias("day"), F.first("lines").alias("lines"))
    )
    per_date = (
        clusters.select("hk", "n", "day", F.explode(F.array_compact(F.array_distinct("lines"))).alias("lk"))
        .groupBy("hk", "lk", "day")
        .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("c"))
    )
    counted = per_date.groupBy("hk", "lk").agg(F.sum("n").alias("n_records"), F.sum("c").alias("n_clusters"), F.count(F.lit(1)).alias("n_days"))
    hosts = clusters.groupBy("hk").agg(F.sum("n").alias("host_records"))
    return counted.join(hosts, "hk")


def repeated_lines(keyed: DataFrame, min_records: int = MIN_RECORDS, min_share: float = MIN_SHARE, min_clusters: int = 1, min_days: int = 1) -> DataFrame:
    """(hk, repeated): for each host with repeated lines, the array of their keys. Lines must be in so many records, in such a share of the host's
    records, in so many clusters of equal documents, and on so many days."""
    s = line_statistics(keyed).where(F.col("n_records") >= min_records)
    s = s.where((F.col("n_records") >= min_share * F.col("host_records")) & (F.col("n_clusters") >= min_clusters) & (F.col("n_days") >= min_days))
    return s.groupBy("hk").agg(F.collect_list("lk").alias("repeated"))


def find_repeated(df: DataFrame, rec_id: str, text: str, url: str, day: str | None = None, **limits) -> DataFrame:
    """(rec_id, line_no) of every occurrence of a repeated line, each once. NULL, empty or URL-less records give none."""
    keyed = keyed_lines(df, rec_id, text, url, day)
    hosts = repeated_lines(keyed, **limits)
    docs = keyed.select("rec", "hk", "lines").dropDuplicates(["rec", "hk"])
    hits = F.filter(F.transform("lines", lambda x, i: F.when(F.array_contains("repeated", x), i)), lambda i: i.isNotNull())
    return docs.join(hosts, "hk").select(F.col("rec").alias(rec_id), F.explode(hits).alias("line_no"))


def strip_repeated(df: DataFrame, rec_id: str, text: str, url: str, day: str | None = None, out: str = "clean_text", **limits) -> DataFrame:
    """df with `out`: the text without its host's repeated lines. Every row is kept; text that is NULL stays NULL."""
    hosts = repeated_lines(keyed_lines(df, rec_id, text, url, day), **limits).select(F.col("hk").alias("__hk"), F.col("repeated").alias("__rep"))
    kept = F.filter(F.split(text, "\n"), lambda x: ~F.coalesce(F.array_contains("__rep", line_key(x)), F.lit(False)))
    keyed = df.withColumn("__key", F.xxhash64(site_host(F.col(url))))
    joined = keyed.join(hosts, F.when(F.col(url).isNotNull(), F.col("__key")) == F.col("__hk"), "left")
    return joined.withColumn(out, F.when(F.col("__rep").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).drop("__key", "__hk", "__rep")
