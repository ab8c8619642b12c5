"""Repeated lines against counting by hand, and against SQL."""

import re
from collections import defaultdict

import duckdb
from lumenpage.llm import queries as Q
from lumenpage.llm import site_lines as L

ROWS = [(i, f"http://www.Site.example:80/{i}", f"Menu\nArticle {i} text\nAll rights 20{i:02d}\n\n  MENU  \nShared by four" if i < 4 else f"Menu\nArticle {'abcdefghij'[i]}\nall   rights 1999", "2024") for i in range(10)]
ROWS += [(100 + i, "https://site.example/copy", "Menu\nOnly copies say this", "2024") for i in range(6)] + [(200, None, "Menu", None), (201, "", "Menu", None), (202, "https://site.example/e", "", None), (203, "https://site.example/n", None, None), (204, "https://other.example", "Menu", "x")]


def frame(spark):
    return spark.createDataFrame([(*r, "clash") for r in ROWS + ROWS[:5]], "doc_id long, url string, text string, published string, hk string")


def brute(least=5, share=0.15):
    fold = lambda s: re.sub("[0-9]+", "0", " ".join(s.lower().split()))
    hosts, lines = defaultdict(set), defaultdict(set)
    docs = [r for r in ROWS if r[1] and r[2]]
    host = lambda u: re.sub(r"^www\.", "", re.match(r"https?://([^/:]*)", u.lower()).group(1))
    for i, u, t, _ in docs:
        hosts[host(u)].add(i)
        for s in t.split("\n"):
            if fold(s):
                lines[host(u), fold(s)].add(i)
    bad = {k for k, v in lines.items() if len(v) >= least and len(v) >= share * len(hosts[k[0]])}
    return {(i, n) for i, u, t, _ in docs for n, s in enumerate(t.split("\n")) if (host(u), fold(s)) in bad}


def test_found(spark):
    got = [(r.doc_id, r.line_no) for r in L.find_repeated(frame(spark), "doc_id", "text", "url").collect()]
    assert set(got) == brute() and len(got) == len(set(got))


def test_clusters_tell_copies_apart(spark):
    s = L.find_repeated(frame(spark), "doc_id", "text", "url", min_clusters=2).collect()
    assert {r.doc_id for r in s if r.doc_id >= 100 and r.line_no == 1} == set()
    stats = L.line_statistics(L.keyed_lines(frame(spark), "doc_id", "text", "url")).where("n_records = 6 and n_clusters = 1").count()
    assert stats == 1


def test_strip(spark):
    rows = L.strip_repeated(frame(spark), "doc_id", "text", "url").collect()
    assert len(rows) == len(ROWS) + 5
    by = {r.doc_id: r.clean_text for r in rows}
    assert by[5] == "Article f" and by[203] is None and by[202] == "" and by[200] == "Menu" and by[204] == "Menu"
    assert L.find_repeated(frame(spark).limit(0), "doc_id", "text", "url").count() == 0


def test_days(spark):
    """One day in several spellings is one day; a document without a date has a day of its own."""
    when = ["2024-03-05", "5 March 2024", "2024-03-05T10:00:00Z", None, "2024-03-06", "soon"]
    rows = [(i, "https://a.example/x", f"Standing line\nText {'abcdef'[i]}", w, "en-GB") for i, w in enumerate(when)]
    df = spark.createDataFrame(rows, "doc_id long, url string, text string, published string, page_lang string")
    zones = spark.createDataFrame([("en-GB", "Europe/London", "dmy")], "page_lang string, zone_name string, date_order string")
    keyed = L.keyed_lines(L.publication_days(df, "published", zones, "page_lang", "day"), "doc_id", "text", "url", "day")
    assert L.line_statistics(keyed).where("n_records = 6").first().n_days == 4
    same = L.publication_days(df.where("doc_id < 3"), "published", zones, "page_lang", "day")
    assert L.repeated_lines(L.keyed_lines(same, "doc_id", "text", "url", "day"), min_records=3, min_days=2).count() == 0


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW fx_document AS SELECT * FROM '{sf_dir}/fx_document.parquet'")
    for name in ("p6_found", "p2_found"):
        df = Q.QUERIES[name](spark, sf_dir)
        cols = sorted(df.columns)
        assert sorted(map(str, df.select(*cols).collect())) == sorted(map(str, [_row(df, cols, r) for r in con.execute(f"SELECT {', '.join(cols)} FROM ({Q.SQL[name]})").fetchall()]))


def _row(df, cols, values):
    from pyspark.sql import Row

    return Row(**dict(zip(cols, values)))
