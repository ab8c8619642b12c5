"""Operators by hand-made cases."""

import pytest
from lumenpage.functions import queries as qf
from lumenpage.functions import text, urls
from lumenpage.operators import blocks as B
from lumenpage.operators.answers_io import competitor_lines, first_json, printable, unsafe_reason, url_lines
from lumenpage.operators.entities import entity_table, name_pattern, relation_table
from lumenpage.operators.html import extract_documents, parse_page
from lumenpage.operators.similarity import cosine, tfidf_similarity
from lumenpage.plans.authority_queries import roll_up
from pyspark.sql import functions as F

PAGE = """<html lang="en"><head><title>Ledgers for small bakeries</title><meta name="description" content="A guide"><meta property="article:published_time" content="2026-03-02T10:00:00Z and more than thirty-two characters">
<link rel="canonical" href="https://ovenbook.example/guide"><script type="application/ld+json">{"@graph": [{"@type": "Organization", "name": "Ovenbook"}, {"@type": ["Article"], "datePublished": "2026-03-01"}]}</script>
<script type="application/ld+json">{broken</script></head><body><nav><ul><li>Log in</li></ul></nav><main><h1>Ledgers for small bakeries</h1><p>Ovenbook keeps the books of bakeries in three towns<p>Second paragraph without an end tag here
<ul><li>Flour and yeast <li>Salt from <a href="https://salt.example/x">Salt</a></ul><table><tr><th>Item</th><th>Price</th></tr><tr><td>Bun</td><td>2</td></tr></table><p>no</p>
<div class="cookie-banner"><p>We use cookies on this page</p></div><a href="#top">up</a><a href="mailto:a@b.example">mail</a></main><footer><p>Copyright notice of the site</p></footer></body></html>"""


def test_html_page():
    d = parse_page(PAGE, "https://www.ovenbook.example/guide")
    assert [(b["type"], b["text"]) for b in d["blocks"]] == [
        ("heading", "Ledgers for small bakeries"), ("p", "Ovenbook keeps the books of bakeries in three towns"), ("p", "Second paragraph without an end tag here"),
        ("list", "Flour and yeast ; Salt from Salt"), ("table", "Item: Bun; Price: 2."),
    ]
    assert d["blocks"][3]["ext_links"] == 1 and d["published"] == "2026-03-02T10:00:00Z and more th" and d["schema_types"] == ["Article", "Organization"] and len(d["jsonld"]) == 3
    assert d["links"] == [{"href": "https://salt.example/x", "text": "Salt", "external": True}] and d["canonical"] == "https://ovenbook.example/guide" and d["lang"] == "en"


def test_html_fidelity():
    """Order of JSON-LD, the first of several metadata tags, names of columns, the list around an item, what is marked as furniture, and pages of little text."""
    long = "The baker weighs flour, salt and water for the rye loaf and waits an hour. " * 9
    html = f"""<html><head><meta property="article:published_time" content=""><meta property="article:published_time" content="2001"><meta itemprop="datePublished" content="2002"><meta name="robots" content="noindex">
    <script type="application/ld+json">[{{"@type": "A", "@graph": [{{"@type": "B"}}, {{"@type": ["C", "A"]}}]}}, {{"@type": "D"}}]</script></head><body><div class="top footer"><p>Footer by its class is dropped</p></div>
    <div class="navigation related"><p>This part stays in the page</p></div><p>{long}</p><p>One<b>two</b>three parts</p><table><tr><td>Loaf</td><td>Price</td></tr><tr><td>Rye</td><td>4</td></tr></table><ul><div><li>first</li></div><li>second</li></ul></body></html>"""
    d = parse_page(html, "https://loaf.example/")
    assert d["schema_types"] == ["D", "A", "C", "B"] and d["published"] == "2002" and d["robots"] == "noindex" and d["notes"] == []
    assert [(b["type"], b["text"]) for b in d["blocks"]] == [("p", "This part stays in the page"), ("p", long.strip()), ("p", "One two three parts"), ("table", "Rye: 4".replace("Rye", "Loaf: Rye; Price") + "."), ("list", "first ; second")]
    few = parse_page("<body><main><h1>Hi</h1></main><div>Some bare words that stand in no block at all here</div></body>", "")
    assert few["blocks"][0]["text"].startswith("Hi Some bare words") and few["notes"] and not few["ok"]


def test_html_rows_never_fail(spark):
    df = spark.createDataFrame([(1, PAGE, "https://ovenbook.example"), (2, None, None), (3, "", "x"), (4, "<p>short", None), (5, "<" * 5000, "http://[bad"), (6, "<div>" * 3000 + "deep", "")], "id int, html string, url string")
    rows = {r.id: r for r in extract_documents(df, "id", "html", "url").collect()}
    assert rows[2].error and not rows[2].ok and not rows[4].ok and len(rows) == 6
    assert extract_documents(df.limit(0), "id", "html", "url").count() == 0


def test_pasted(spark):
    df = spark.createDataFrame([(1, "# Title\n\nOne paragraph here.\n\n- first\n- second\n\n## Section\n\nLast one http://a.example\nand its line"), (2, " \n \n"), (3, None)], "id int, body string")
    rows = [(r.type, r.level, r.text, r.ext_links) for r in B.pasted_blocks(df, "id", "body").orderBy("pos").collect()]
    assert rows == [("heading", 1, "Title", 0), ("p", None, "One paragraph here.", 0), ("list", None, "first ; second", 0), ("heading", 2, "Section", 0), ("p", None, "Last one http://a.example", 1), ("p", None, "and its line", 0)]


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(text.sentences(F.lit("Dr. Oby paid 3.5 kg. Then (quoted.) \"Next\" came! ok? No"))) == ["Dr. Oby paid 3.5 kg.", "Then (quoted.", '"Next" came! ok?', "No"]
    assert [one(text.light_stem(F.lit(w))) for w in ("businesses", "business", "pricing", "bakers", "used", "cities")] == ["business", "busines", "pric", "baker", "used", "citi"]
    assert one(text.truncate(F.lit("  a  b " * 30), 20)).endswith("...") and one(text.slugify(F.lit("  "))) == "entity"
    assert one(text.word_count(F.lit(None).cast("string"))) == 0 and one(text.sentences(F.lit(None).cast("string"))) == []
    assert one(urls.registrable_domain(F.lit("https://www.news.bbc.co.uk/x"))) == "bbc.co.uk" and one(urls.normalize_url(F.lit("example.com/a#frag"))) == "https://example.com/a"
    assert one(urls.normalize_url(F.lit("https://example.com"))) == "https://example.com/"
    assert [one(qf.detect_intent(F.lit(q), F.lit("Acme"))) for q in ("best crm", "how to bake", "buy flour", "acme", "dentist near me", "what is flour", "")] == ["commercial", "howto", "transactional", "navigational", "local", "informational", "informational"]


def test_edges(spark):
    assert first_json('Sure: ```json\n{"a": [1, 2]}\n``` done') == '{"a": [1, 2]}' and first_json("none { at all") is None and first_json(None) is None
    bad = ["", "ftp://a.example", "http://localhost/", "http://127.0.0.1/", "http://10.1.1.1", "http://a.example:22/", "http://u:p@a.example/", "http://x.internal/", "http://[::1]/", "http://169.254.169.254/x", None]
    assert all(unsafe_reason(u) for u in bad) and not unsafe_reason("https://ovenbook.example/a")
    assert printable("“naïve” → 5 €") == '"nai' + "ve" + '" to 5 '
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(url_lines(F.lit("a.example, b.example\n a.example"))) == ["https://a.example/", "https://b.example/"]
    assert [tuple(x) for x in one(competitor_lines(F.lit("Acme, acme.example\n\nBolt")))] == [("Acme", "acme.example"), ("Bolt", "")]


def test_name_patterns(spark):
    """Names that end in marks, names inside longer words, spellings of blanks, and case for short names."""
    names = [("Yahoo!", ""), ("C++", ""), ("Acme Ltd", "https://www.acmeworks.example"), ("", "x"), (None, None)]
    said = "Yahoo! and Yahoo!Mail, C++ or c++x; Acme-Ltd, acmeworks' site, ACME, Acmed, éAcme, _acme"
    rows = spark.createDataFrame([(i, *r, said) for i, r in enumerate(names)], "i int, n string, w string, s string")
    got = rows.select("i", name_pattern(F.col("n"), F.col("w")).alias("p"), "s").select("i", F.regexp_count("s", F.col("p")).alias("c")).orderBy("i").collect()
    assert [r.c for r in got] == [1, 1, 3, None, None]


def test_entities(spark):
    told = [
        ["The Orrin Group met Dana Reed in Auckland.", "Orrin sells IBM and NASA parts.", "However Bolt left.", "They met Bolt.", "Mira fell; Mira rose.", "Bread by Tova Lund. We met the ceo Karo Venn."],
        ["We use Lumo2 and SnapKit."], [], None,
    ]
    df = spark.createDataFrame(list(enumerate(told)), "id int, s array<string>")
    rows = {(r.id, r.name): r for r in entity_table(df, "id", "s").collect()}
    kinds = {n: r.kind for (i, n), r in rows.items() if i == 0}
    assert kinds["Orrin Group"] == "ORGANISATION" and kinds["Dana Reed"] == "BRAND_OR_PRODUCT" and kinds["Auckland"] == "LOCATION" and kinds["IBM"] == "TECHNOLOGY" and kinds["Tova Lund"] == "PERSON" and kinds["Karo Venn"] == "PERSON"
    assert "However" not in kinds and "Mira" not in kinds and rows[0, "Bolt"].n == 2 and rows[0, "Bolt"].sentences == [2, 3] and rows[0, "Bolt"]["rank"] == 1
    assert {n: r.kind for (i, n), r in rows.items() if i == 1} == {"Lumo2": "PRODUCT", "SnapKit": "PRODUCT"} and {i for i, _ in rows} == {0, 1}
    assert entity_table(df.limit(0), "id", "s").count() == 0


def test_relations(spark):
    names = [("Bolt", "BRAND_OR_PRODUCT"), ("Paris", "LOCATION"), ("Vex", "PRODUCT")]
    df = spark.createDataFrame(
        [(1, 0, "Orrin partnered with Bolt and is based in Paris.", names), (1, 1, "Vex beside Orrin and Paris.", names), (1, 2, "Orrin partners with Bolt again.", names), (2, 0, "Orrin alone.", names), (3, 0, None, None)],
        "id int, sid int, s string, names array<struct<name:string,kind:string>>",
    )
    rows = sorted((r.id, r.relation, r.object, r.kind) for r in relation_table(df, "id", "sid", "s", "names").collect())
    assert rows == [
        (1, "co-mentioned", "Paris", "LOCATION"), (1, "co-mentioned", "Vex", "PRODUCT"), (1, "location", "Paris", "LOCATION"),
        (1, "partnership", "Bolt", "BRAND_OR_PRODUCT"), (1, "partnership", "Paris", "LOCATION"),
    ]


def test_similarity(spark):
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r.c, 6) for r in v.select(cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 0.0, round(0.5**0.5, 6), 0.0]
    p = spark.createDataFrame([(1, 0, "bakery ledger software for towns"), (1, 1, "rain in the hills"), (1, 2, None)], "call int, pid int, text string")
    q = spark.createDataFrame([(1, 0, "ledger software")], "call int, qid int, text string")
    rows = {r.pid: r.sim for r in tfidf_similarity(p, q, ["call"], "pid", "qid").collect()}
    assert set(rows) == {0} and 0 < rows[0] <= 1
    assert tfidf_similarity(p.limit(0), q, ["call"], "pid", "qid").count() == 0


@pytest.mark.parametrize("scores,weights,want", [
    ({i: 80.0 for i in range(1, 17)}, None, (80.0, "Good", False, 16)),
    ({i: (100.0 if i <= 4 else 0.0) for i in range(1, 17)}, None, (25.0, "Very weak", False, 16)),
    ({i: (100.0 if i <= 4 else 0.0) for i in range(1, 17)}, {"structural": 1.0, "information": 0.0, "entity": 0.0, "authority": 0.0}, (100.0, "Strong", False, 16)),
    ({i: (None if i == 3 else 60.0) for i in range(1, 17)}, None, (60.0, "Developing", False, 15)),
    ({**{i: 70.0 for i in range(1, 13)}, 16: 10.0}, None, (70.0, "Good", True, 13)),
])
def test_roll_up(spark, scores, weights, want):
    rows = spark.createDataFrame([(1, i, s) for i, s in scores.items()], "doc_id int, metric_id int, score double")
    r = roll_up(rows, spark, pillar_weights=weights).first()
    assert (r.overall, r.band, r.provisional, r.available) == want


def test_streaming(spark, tmp_path):
    import datetime as dt

    from lumenpage.streaming.landing import PAGE_SCHEMA, append_to, landing_pages

    t = dt.datetime(2024, 5, 1, 12)
    spark.createDataFrame([(1, "https://a.example/", PAGE, t), (1, "https://a.example/", PAGE, t), (2, "https://b.example/", None, t)], PAGE_SCHEMA).write.parquet(str(tmp_path / "in"))
    append_to(landing_pages(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_structured_data(spark):
    from lumenpage.plans.source_queries import structured_data

    df = spark.createDataFrame([(1, PAGE, "https://ovenbook.example"), (2, None, None)], "doc_id int, html string, url string")
    docs = extract_documents(df, "doc_id", "html", "url").withColumn("p", F.lit(r"(?i)\b(?:Ovenbook)\b"))
    rows = {r.doc_id: r.score for r in structured_data(docs, "p").collect()}
    assert rows[1] == round(25 + 20 * 2 / 3 + 10 + 5 + 10 + 5 + 5 + 5, 4) and rows[2] == 0.0
