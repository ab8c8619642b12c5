"""Domains cited where the target isn't, on made-up tables."""

import __spark_entry__ as entry


def test_cited_domains(spark, sf_dir, tmp_path):
    made = {
        "fx_project": [{"project_id": 1, "query": "best lamp", "entity": "Zorbital", "website": "https://zorbital.example"}],
        "fx_document": [{"doc_id": i, "project_id": 1, "kind": "external", "ok": ok, "url": u, "text": t} for i, (u, ok, t) in enumerate([
            ("https://b.example/known/", True, "A word on Zorbital."), ("https://c.example/silent", True, "Nothing here."), ("https://d.example/failed", False, "Zorbital, but not read."),
        ])],
        "fx_answer": [{"project_id": 1, "answer_id": i, "text": t, "citations": c} for i, (t, c) in enumerate([
            ("One.", ["https://zorbital.example/x", "https://a.example/1"]),
            ("Two.", ["https://b.example/known", "https://b.example/other", "https://c.example/silent", "https://d.example/failed"]),
            ("Three.", ["https://c.example/silent"]), (" ", ["https://e.example/"]),
        ])],
    }
    for name, rows in made.items():
        schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
        spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {(r.domain, r.n, r["rank"]) for r in entry.queries()["k4_cited_domains"](spark, str(tmp_path)).collect()}
    assert got == {("c.example", 2, 1), ("b.example", 1, 2), ("d.example", 1, 3)}
