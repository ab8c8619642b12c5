"""Garbled text by garbling clean text; residue on unseen hosts; page furniture on a made site."""

import random

import pytest
from lumenpage.llm import boilerplate as B
from lumenpage.llm import garbled as G
from lumenpage.llm import residue as R
from lumenpage.llm.queries import _texts
from pyspark.sql import functions as F

CLEAN = [
    "Die größere Straße führt über Köln und kühlt täglich 20 Räume.", "La société élève la façade à côté de la forêt, déjà prévue.", "Наша кухня возит товар, а старая крыша ищет ещё 28 заказов.", "A educação não está próxima; SEM ATENÇÃO: a maçã é média.",
    "Η στενή αποθήκη ψάχνει κάθε βαριά βάρκα και μετρά 30 πόρτες.", "At the café it’s “naïve” – about 20 °C and ±5 mm, costs €30 or £20.", "El niño midió la compañía española según la señal última.",
]
LEGIT = ["├── docs └── notes │ plan", "√2 ≈ 1,414 and π × r² ≥ 3", "Þórun and Ðaníel", "Tiếng Ân và Ễnh", "Łódka, żółw, ćma", "ВНИМАНИЕ ТОВАР", "安い屋根を守ります。", "👩‍🔧 ☕"]


def swap(text, written, read):
    return text.encode(written, "ignore").decode(read, "ignore" if read != "latin-1" else "strict")


@pytest.fixture(scope="module")
def garbling(spark):
    rng = random.Random(2)
    rows, bad, right = [], set(), {}
    swaps = [("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("koi8-r", "cp1251"), ("cp1251", "latin-1")]
    for i in range(1400):
        t = rng.choice(CLEAN) + " " + rng.choice(LEGIT if i % 3 == 0 else CLEAN)
        if i % 20 == 0:
            w, r = swaps[(i // 20) % len(swaps)]
            part = CLEAN[2] if w in ("koi8-r", "cp1251") else rng.choice([CLEAN[0], CLEAN[1], CLEAN[6]])
            t = t + "\n" + swap(part, w, r)
            bad.add(i)
            right[i] = part
        if i % 97 == 5:
            t += " fa�ade"
            bad.add(i)
        rows.append((i, f"host{i % 7}", t, "x"))
    rows += [(5000, "h", None, "x"), (5001, None, "", "x"), (5002, None, "plain ascii", "x")]
    df = spark.createDataFrame(rows + rows[:9], "rec_id long, origin string, text string, chunks string")
    found = G.stage(G.stretches(df, ["rec_id"], F.col("origin"), "text"), "test")
    model = G.learn(found)
    weighed = G.weigh_records(found, ["rec_id"], model)
    return df, weighed, model, bad, right


def test_garbled_found(garbling):
    _, weighed, model, bad, _ = garbling
    ciphers = G.learn_ciphers(weighed, model)
    assert ciphers.count() == 0
    got = [r.rec_id for r in G.judge(weighed, ["rec_id"], model, ciphers).collect()]
    assert len(got) == len(set(got)) and set(got) == bad


def test_garbled_restored(garbling):
    df, _, model, bad, right = garbling
    out = {r.rec_id: r.restored for r in G.restore(df, ["rec_id"], "text", model).collect()}
    lost = [out[i].split("\n")[-1] for i in right if right[i] not in out[i]]
    assert len(lost) <= 0.1 * len(right), lost
    assert out[5000] is None and out[5001] == "" and all(out[r.rec_id] == r.text for r in df.collect() if r.rec_id not in bad)


def test_garbled_empty(spark, garbling):
    df = garbling[0].limit(0)
    found = G.stage(G.stretches(df, ["rec_id"], F.col("origin"), "text"), "test")
    model = G.learn(found)
    weighed = G.weigh_records(found, ["rec_id"], model)
    assert G.judge(weighed, ["rec_id"], model, G.learn_ciphers(weighed, model)).count() == 0


GERMAN = """Straße größer schön über Köln früher Grüße Mühle Bäcker Brötchen Käse süß heiß weiß groß Tür Schlüssel Möbel Löffel Küche Bücher Häuser Gärten Wälder Flüsse Füße Hände Zähne Vögel Äpfel Öfen Übung
müde kühl grün blöd böse fröhlich täglich nächste ähnlich älter jünger höher länger stärker wärmer kälter Länge Höhe Größe Stärke Wärme Kälte Lösung Öffnung Führung Prüfung Gebühr Gefühl Geschäft Gerät Gespräch Getränk
Frühstück Rückgabe Stück Glück Brücke Lücke Mücke Rücken drücken schicken schützen nützen stürzen kürzen würzen setzen""".split()
RUSSIAN = """дорога большая красивая через раньше мельница пекарь хлеб сыр сладкий горячий белый высокая дверь ключ мебель ложка кухня книги дома сады леса реки ноги руки зубы птицы яблоки печи усталый холодный зелёный злой весёлый
ежедневно следующий похожий старше моложе выше длиннее сильнее теплее холоднее длина высота размер сила тепло холод решение открытие проверка плата чувство магазин прибор разговор напиток завтрак возврат кусок счастье мост""".split()


@pytest.mark.parametrize("words,page", [(GERMAN, "hp_roman8"), (RUSSIAN, "cp855")])
def test_unlisted_code_page(spark, words, page):
    """A source in a code page that no table lists: its letters are learned from the other sources' language, and nothing else is touched."""
    assert page not in G.READ_AS + G.WRITTEN_IN
    rng = random.Random(9)
    say = lambda: " ".join(rng.choice(words) for _ in range(9)) + "."
    rows = [(i, f"host{i % 9}", say()) for i in range(900)]
    lost = {i: say() for i in range(5000, 5120)}
    rows += [(i, "odd.example", t.encode(page, "replace").decode("cp1252", "replace").replace("�", "?")) for i, t in lost.items()]
    df = spark.createDataFrame(rows, "rec_id long, origin string, text string")
    found = G.stage(G.stretches(df, ["rec_id"], F.col("origin"), "text"), "test")
    model = G.learn(found)
    weighed = G.weigh_records(found, ["rec_id"], model)
    ciphers = G.learn_ciphers(weighed, model)
    assert [r.source for r in ciphers.collect()] == ["odd.example"]
    got = {r.rec_id for r in G.judge(weighed, ["rec_id"], model, ciphers).collect()}
    assert got <= set(lost) and len(got) > 0.9 * len(lost)
    out = {r.rec_id: r.restored for r in G.restore(df, ["rec_id"], "text", model, source=F.col("origin"), ciphers=ciphers).collect()}
    assert all(out[i] == t for i, _, t in rows if i < 5000)
    pairs = [(a.lower(), b.lower()) for i, t in lost.items() for a, b in zip(out[i].split(), t.split())]
    assert sum(a == b for a, b in pairs) > 0.75 * len(pairs)


DOC = "doc_id long, title string, text string, error string, ok boolean, url string"


def test_what_phrases_hold():
    """The test that spares records without a cue misses none."""
    said = [
        "Lorem Ipsum dolor", "Filler copy", "Your TITLE goes here", "Add a subheading", "Add your text", "asdf asdf", "Xxxxx xxxx", "Click edit to change", "Insert the name of a town here", "TODO: x", "Page not found", "/a was not found on this server",
        "This page is no longer available", "This page isn't available", "ACCESS DENIED", "Too many requests", "Service temporarily unavailable", "Internal Server Error", "Bad gateway", "Something went wrong", "A database connection", "Fatal error: x",
        "Uncaught TypeError", "Traceback (most recent", "Exception in thread", "Undefined index", "line 12, in render", "at com.shop.Cart(Cart.java:41)", "enable JavaScript", "requires scripts", "turn on javascript", "JavaScript is disabled", "Hello None,",
    ]
    marks = R.phrase_pattern()
    assert all((marks.search(s) or R.NOTHING.search(s)) and R.may_hold(s) for s in said)


def test_residue_on_unseen_hosts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/fx_document.parquet").select("doc_id", "title", "text", "error", "ok", "url")
    q = R.held_out_quality(docs)
    assert q["marked"] > 100 and q["precision"] > 0.97 and q["recall"] > 0.9
    q = R.held_out_quality(docs, ("missing", "refused", "scripts"))  # phrases that marked nothing in fitting are found by the company they keep
    assert q["marked"] > 10 and q["recall"] > 0.8
    model = R.fit_model(docs)
    cases = [
        (1, "Hello {{first_name}}", "Real text about bread.", None, True, None), (2, "T", "Bread.\nPlease enable JavaScript to view this page.\nMore.", "", True, None), (3, "T", "Lorem ipsum dolor sit amet consectetur tempor.", None, True, None),
        (4, "Lorem ipsum and other dummy text for bakers", "Designers drop lorem ipsum into a draft so that bakers judge the oven and not the words.", None, True, None), (5, "Bread", "In a mail merge, write {{first_name}} where the name should appear.", "HTTP 404", False, None),
        (6, None, None, None, None, None), (7, "", "", "timed out after 15 s", False, ""), (8, "T", "404 - Page not found. The address you typed leads nowhere.", None, False, None), (9, "T", "word " * 20000, None, True, None), (10, "T", "Bread.\nAn oven\n" + "The baker weighs flour and salt for the loaf, then waits an hour. " * 20 + "Hello {{first_name}}, the rye is ready.", None, True, None),
    ]
    df = spark.createDataFrame(cases + cases[:3], DOC)
    assert sorted(r.doc_id for r in R.find_residue(df, "doc_id", model).collect()) == [1, 2, 3, 8, 10]
    empty = df.limit(0)
    assert R.find_residue(empty, "doc_id", R.fit_model(empty)).count() == 0


def test_furniture(spark):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("and", "ent", "olo", "uri", "ema")]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    blocks, docs, want = [], [], set()
    nav = ["Home", "Shop", "Help centre", "Contact", "Basket"]
    for i in range(400):
        site = f"sellmore{i % 40}a"
        rows = [("list", " ; ".join(nav), nav, True), ("heading", say(4).capitalize(), None, False), ("p", f"By Dana {say(1).capitalize()}", None, False)]
        rows += [("p", ". ".join(say(9) for _ in range(5)) + ".", None, False) for _ in range(4)] + [("heading", "Key facts", None, False), ("p", say(8) + ".", None, False)]
        rows += [("heading", "Popular now", None, True), ("list", "x", [say(4), say(5)], True), ("p", f"All rights reserved by {site.capitalize()} for 2024.", None, True)]
        docs.append((i, f"https://www.{site}.example/{i}" if i % 9 else None))
        for pos, (kind, t, items, cut) in enumerate(rows):
            blocks.append((i, pos, kind, " ; ".join(items) if items else t, items, "x"))
            if cut and (i % 9 or kind != "p"):
                want.add((i, pos))
    blocks += [(9000, 0, "p", None, None, "x"), (9000, 1, "list", None, None, "x"), (9001, 0, "table", "a: 1.", None, "x")]
    b = spark.createDataFrame(blocks + blocks[:20], "doc_id long, pos int, type string, text string, items array<string>, nodes string")
    d = spark.createDataFrame([*docs, (9000, None)], "doc_id long, url string")
    got = [(r.doc_id, r.pos) for r in B.find_furniture(b, d).collect()]
    assert len(got) == len(set(got)) and want <= set(got) and not {x for x in set(got) - want if x[1] != len(rows) - 1}
    text = {r.doc_id: r.main_text for r in B.main_text(b, B.find_furniture(b, d)).collect()}
    assert text[9000] == "" and "Key facts" in text[1] and "Popular now" not in text[1] and text[1].startswith(next(x[3] for x in blocks if x[:2] == (1, 1)))
    assert B.find_furniture(b.limit(0), d.limit(0)).count() == 0


def test_trees(spark, sf_dir):
    """Most of what is cut on the driver's pages is owed to the hosts' own trees."""
    read = lambda n: spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet")
    cut = {k: {tuple(r) for r in B.find_furniture(read("fx_block"), read("fx_document").select("doc_id", "url"), corpus_tree=k == "both").collect()} for k in ("both", "host")}
    assert cut["host"] <= cut["both"] and len(cut["host"]) > 0.8 * len(cut["both"])


def test_texts_of_both_tables(spark, sf_dir):
    assert {r.tbl for r in _texts(spark, sf_dir).select("tbl").distinct().collect()} == {"fx_document", "fx_answer"}


def test_long_list(spark):
    """Every entry of a list counts, however many."""
    blocks = spark.createDataFrame([(1, 0, "list", "x", [f"entry {'abcdefghij'[i % 10] * (i // 10 + 1)}" for i in range(250)])], "doc_id long, pos int, type string, text string, items array<string>")
    page = B.keyed_pages(blocks, spark.createDataFrame([(1, "h.example")], "doc_id long, host string"), frozenset()).collect()[0]
    assert len(page.nodes[0].leaves) == 250
