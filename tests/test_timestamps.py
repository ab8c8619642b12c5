"""Timestamps against the standard library's zones, and by hand for each format."""

import datetime as dt
import zoneinfo

import pytest
from lumenpage.operators.timestamps import normalise_timestamps

UTC = dt.timezone.utc


def us(*a, zone=UTC, fold=0):
    z = zoneinfo.ZoneInfo(zone) if isinstance(zone, str) else zone
    return round((dt.datetime(*a, tzinfo=z, fold=fold) - dt.datetime(1970, 1, 1, tzinfo=UTC)) / dt.timedelta(microseconds=1))


CASES = [
    ("2023-12-11 16:08:52 UTC", "en-US", us(2023, 12, 11, 16, 8, 52)),
    (" 2024-10-22T14:32:17z\n", None, us(2024, 10, 22, 14, 32, 17)),
    ("2024-04-07 21:18:45", "de-DE", us(2024, 4, 7, 21, 18, 45, zone="Europe/Berlin")),
    ("2024-04-07 21:18:45", "xx", us(2024, 4, 7, 21, 18, 45)),
    ("2023-10-02T09:01:49+05:45", "en-US", us(2023, 10, 2, 3, 16, 49)),
    ("2022-02-27T01:29:35−05:00", None, us(2022, 2, 27, 6, 29, 35)),
    ("2024-11-05T06:29:07.594453684+00", None, us(2024, 11, 5, 6, 29, 7, 594453)),
    ("20221128T062941Z", None, us(2022, 11, 28, 6, 29, 41)),
    ("06/05/2024", "en-US", us(2024, 6, 5, zone="America/New_York")),
    ("06/05/2024 7:49 PM", "en-GB", us(2024, 5, 6, 19, 49, zone="Europe/London")),
    ("03/27/2023 12:40 AM", "en-CA", us(2023, 3, 27, 0, 40, zone="America/Toronto")),
    ("06/21/2022 02:06", "en-GB", None),
    ("31.10.2024", "de-DE", us(2024, 10, 31, zone="Europe/Berlin")),
    ("2023/03/06 17:08", None, us(2023, 3, 6, 17, 8)),
    ("Wed, 24 Sep 2025 04:54:56 -0400", "en-US", us(2025, 9, 24, 8, 54, 56)),
    ("Tue, 08 Jul 2025 01:03:28 CEST", None, us(2025, 7, 7, 23, 3, 28)),
    ("Sat Apr  5 19:00:39 2025", None, us(2025, 4, 5, 19, 0, 39)),
    ("Apr 16, 2025 7:42 AM CEST", "en-US", us(2025, 4, 16, 5, 42)),
    ("21. März 2025", "de-DE", us(2025, 3, 21, zone="Europe/Berlin")),
    ("11 de octubre de 2024", "es-ES", us(2024, 10, 11, zone="Europe/Madrid")),
    ("1er", None, None),
    ("2023年12月31日 05:22", "ja-JP", us(2023, 12, 31, 5, 22, zone="Asia/Tokyo")),
    ("2024-05-18 14:24 Europe/London", "en-US", us(2024, 5, 18, 13, 24)),
    ("2025-08-21 02:37 America/Toronto", None, us(2025, 8, 21, 6, 37)),
    ("1717708933", None, 1717708933 * 10**6),
    ("1762132067767", None, 1762132067767 * 10**3),
    ("1643180995391222", None, 1643180995391222),
    ("1715908804.748", None, 1715908804748000),
    ("20231105", None, us(2023, 11, 5)),
    ("2024-11-03 01:30:00", "en-US", us(2024, 11, 3, 1, 30, zone="America/New_York", fold=0)),
    ("2024-03-10 02:30:00", "en-US", us(2024, 3, 10, 7, 30)),
    ("2023-02-30", None, None), ("25:61", None, None), ("2024-13-45T10:00:00Z", None, None), ("0000-00-00 00:00:00", None, None), ("3 days ago", None, None),
    ("yesterday", None, None), ("TBD", None, None), ("", None, None), (None, "en-US", None), ("2024-05-05 24:00:00", None, None), ("2024-05-05 13:00 PM", None, None),
]


@pytest.fixture(scope="module")
def locales(spark):
    return spark.createDataFrame([("en-US", "America/New_York", "mdy"), ("en-CA", "America/Toronto", "mdy"), ("de-DE", "Europe/Berlin", "dmy"), ("en-GB", "Europe/London", "dmy"), ("es-ES", "Europe/Madrid", "dmy"), ("ja-JP", "Asia/Tokyo", "dmy")], "page_lang string, zone_name string, date_order string")


def test_formats(spark, locales):
    df = spark.createDataFrame([(i, v, p) for i, (v, p, _) in enumerate(CASES)], "id int, v string, page_lang string")
    got = {r.id: r.utc_us for r in normalise_timestamps(df, "v", locales, "page_lang").collect()}
    assert [(c[0], got[i]) for i, c in enumerate(CASES)] == [(c[0], c[2]) for c in CASES]


def test_clashing_names_repeats_and_empty(spark, locales):
    df = spark.createDataFrame([(1, "2024-01-01", None, "keep"), (1, "2024-01-01", None, "keep")], "id int, v string, page_lang string, zone string").withColumnRenamed("id", "span_year")
    rows = normalise_timestamps(df, "v", locales, "page_lang").collect()
    assert len(rows) == 2 and rows[0].zone == "keep" and rows[0].span_year == 1 and rows[0].utc_us == us(2024, 1, 1)
    assert normalise_timestamps(df.limit(0), "v", locales, "page_lang").count() == 0
    assert normalise_timestamps(df, "v", locales.limit(0), "page_lang").count() == 2


def test_every_hour_of_a_change(spark, locales):
    rows = [dt.datetime(2024, 10, 27, 0, 0) + dt.timedelta(minutes=15 * i) for i in range(24)]
    df = spark.createDataFrame([(i, r.strftime("%Y-%m-%d %H:%M:%S"), "de-DE") for i, r in enumerate(rows)], "id int, v string, page_lang string")
    got = {r.id: r.utc_us for r in normalise_timestamps(df, "v", locales, "page_lang").collect()}
    for i, r in enumerate(rows):
        assert got[i] == us(*r.timetuple()[:6], zone="Europe/Berlin"), r
