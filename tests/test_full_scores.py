"""Scores over all metrics, against the metrics' own queries and a roll-up in Python."""

from collections import defaultdict

import __spark_entry__ as entry
import pytest
from lumenpage.config import weights as W
from lumenpage.plans import authority_queries as A


def by(df, key):
    return {r[key]: r.score for r in df.select(key, "score").collect()}


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return {(r.doc_id, r.metric_id): r.score for r in A.metric_rows(spark, sf_dir).collect()}


def test_all_metrics(spark, sf_dir, rows):
    project = {r.doc_id: r.project_id for r in spark.read.parquet(f"{sf_dir}/fx_document.parquet").select("doc_id", "project_id").collect()}
    assert set(rows) == {(d, i) for d in project for i in range(1, 17)}
    q = entry.queries()
    for i, name in {5: "m5_information_density", 8: "m8_coverage", 11: "m11_relationships", 12: "m12_relevance"}.items():
        own = by(q[name](spark, sf_dir), "doc_id")
        assert any(own.values()) and all(rows[d, i] == pytest.approx(own[d], abs=0.051) if own.get(d) is not None else rows[d, i] is None for d in project)
    for i, name in {13: "m13_mentions", 14: "m14_diversity", 15: "m15_citation_share"}.items():
        own = by(q[name](spark, sf_dir), "project_id")
        assert any(own.values()) and all(rows[d, i] == pytest.approx(own[p], abs=0.051) if own.get(p) is not None else rows[d, i] is None for d, p in project.items())
    opening = {r.doc_id: r.opening for r in q["m1_opening"](spark, sf_dir).collect()}
    asked = {r.doc_id: r.answered / r.questions * 100 for r in q["m1_question_answers"](spark, sf_dir).collect()}
    assert {d for d in project if rows[d, 1] is not None} == set(opening)
    assert all(rows[d, 1] == pytest.approx((o + asked.get(d, 25)) / 2, abs=0.051) for d, o in opening.items())
    assert all(rows[d, 16] is not None and rows[d, 4] is None for d in project)


def test_roll_up(spark, sf_dir, rows):
    want = defaultdict(dict)
    for (d, i), s in rows.items():
        if s is not None:
            want[d][i] = s
    got = {r.doc_id: r for r in entry.queries()["r1_scores"](spark, sf_dir).collect()}
    assert set(got) == set(want) and any(r.authority is not None and not r.provisional for r in got.values())
    for d, have in want.items():
        pillars = {}
        for p in W.PILLARS:
            part = [(s, W.METRICS[i][2]) for i, s in have.items() if W.METRICS[i][1] == p]
            if any(W.METRICS[i][1] == p and W.METRICS[i][3] != "estimate" for i in have):
                pillars[p] = sum(s * w for s, w in part) / sum(w for _, w in part)
        assert got[d].available == len(have) and got[d].provisional == (len(pillars) < 4)
        for p in W.PILLARS:
            assert got[d][p] == (pytest.approx(pillars[p], abs=0.051) if p in pillars else None)
        assert got[d].overall == pytest.approx(sum(pillars.values()) / len(pillars), abs=0.11)


def test_near_the_entity(spark, sf_dir, rows):
    """Relevance of the entity is the mean of metrics 9 and 12, in 16 and in the priorities."""
    from lumenpage.plans import source_queries as Q

    made = spark.createDataFrame([(d, i, s) for (d, i), s in rows.items()], "doc_id long, metric_id int, score double")
    cut = made.where("metric_id <> 12")
    both = {(r.doc_id, r.metric_id): r.priority for r in Q.priorities(made, spark, sf_dir).collect()}
    one = {(r.doc_id, r.metric_id): r.priority for r in Q.priorities(cut, spark, sf_dir).collect()}
    moved = [(both[d, i] - one[d, i], rows[d, 9], rows[d, 12]) for d, i in one if rows[d, 9] is not None and rows[d, 12] is not None]
    assert any(a != b for _, a, b in moved) and all(x == pytest.approx(W.PRIORITY["entity"] * ((a + b) / 2 - a) / 100, abs=0.0011) for x, a, b in moved)
