"""What is broadcast of staged tables: their Parquet files are far smaller than their rows in the driver, so the engine takes them for small."""

import re

import __spark_entry__ as entry
import pytest
from lumenpage.plans import authority_queries as A
from lumenpage.plans import entity_queries as E
from lumenpage.sources import tables


def staged_and_broadcast(df):
    """Names of the staged tables that a broadcast join of the planned query builds from as they are; sums are shuffled first, which shows their size."""
    found = set()

    def walk(node):
        if node.nodeName().startswith("BroadcastHashJoin"):
            side = node.left() if node.buildSide().toString() == "BuildLeft" else node.right()
            if "Aggregate" not in side.toString():
                found.update(re.findall(r"lumenpage-([a-z]+)-", side.toString()))
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().sparkPlan())
    return found


def test_coverage_broadcasts_no_pages(spark, sf_dir):
    assert staged_and_broadcast(entry.queries()["m8_coverage"](spark, sf_dir)) <= {"facets"}


@pytest.fixture(scope="module")
def metrics(spark, sf_dir):
    """The rows of all metrics, and what is broadcast on the way to them."""
    found = set()

    def watched(df, name):
        found.update(staged_and_broadcast(df))
        return stage(df, name)

    stage = A.stage
    with pytest.MonkeyPatch.context() as m:
        m.setattr(A, "stage", watched)
        m.setattr(E, "stage", watched)
        rows = A.metric_rows(spark, sf_dir)
    return rows, found


@pytest.mark.parametrize("name", ["k1_priorities", "k5_extremes", "k3_gaps", "k6_action_plan", "o2_report_lines", "o2_json"])
def test_scores_broadcast_no_pages(spark, sf_dir, metrics, monkeypatch, name):
    """Of staged tables, only the subtopics and the metrics of projects."""
    rows, found = metrics
    monkeypatch.setattr(A, "metric_rows", lambda *_: rows)
    assert found | staged_and_broadcast(entry.queries()[name](spark, sf_dir)) <= {"facets", "metric"}


def similarities_and_answers_broadcast(df):
    """Joins by page or answer that broadcast similarities, answers or metrics: these have as many rows as there are pages or answers, whatever their files' size."""
    found = []

    def walk(node):
        if node.nodeName().startswith("BroadcastHashJoin"):
            side = (node.left() if node.buildSide().toString() == "BuildLeft" else node.right()).toString()
            keys = node.leftKeys().toString()
            if re.search("doc_id|answer_id", keys) and re.search("MapInArrow|fx_answer|lumenpage-metric", side):
                found.append(keys)
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().sparkPlan())
    return found


@pytest.fixture(scope="module")
def joined(spark, sf_dir):
    """The rows of all metrics, what is broadcast by page or answer on the way to them, and the most tables that were staged at a time."""
    found, now, most, stage = [], [], [0], A.stage

    def watched(df, name):
        found.extend(similarities_and_answers_broadcast(df))
        now.append(name)
        most[0] = max(most[0], len(now))
        try:
            return stage(df, name)
        finally:
            now.pop()

    with pytest.MonkeyPatch.context() as m:
        m.setattr(A, "stage", watched)
        rows = A.metric_rows(spark, sf_dir)
    return rows, found, most[0]


@pytest.mark.parametrize("name", ["k5_extremes", "o2_report_lines", "k3_gaps", "o2_json", "k6_action_plan"])
def test_driver_holds_few_metrics(spark, sf_dir, joined, monkeypatch, name):
    rows, found, most = joined
    monkeypatch.setattr(A, "metric_rows", lambda *_: rows)
    assert found + similarities_and_answers_broadcast(entry.queries()[name](spark, sf_dir)) == []
    assert most <= 3


@pytest.mark.parametrize("name", ["o2_report_lines", "k3_gaps", "k6_action_plan", "o2_json"])
def test_finished_metrics_leave_no_plans(spark, sf_dir, monkeypatch, name):
    """The driver's memory: few metrics are staged at a time, and the plans of those staged are gone when later ones begin."""
    plans, now, most, held, stage = [], [], [0], [], A.stage
    weak = spark.sparkContext._jvm.java.lang.ref.WeakReference

    def watched(df, name):
        now.append(name)
        most[0] = max(most[0], len(now))
        held.append(sum(r.get() is not None for r in plans))
        try:
            return stage(df, name)
        finally:
            plans.append(weak(df._jdf.queryExecution()))
            now.pop()

    page = lambda spark, sf_dir: A.P.documents(spark, sf_dir, "word_count").selectExpr("doc_id", "double(word_count) as score")
    project = lambda spark, sf_dir: A.P.primary_queries(spark, sf_dir).selectExpr("project_id", "50D as score")
    monkeypatch.setattr(A, "stage", watched)
    monkeypatch.setattr(A, "PAGE_METRICS", dict.fromkeys(A.PAGE_METRICS, page))
    monkeypatch.setattr(A, "PROJECT_METRICS", dict.fromkeys(A.PROJECT_METRICS, project))
    monkeypatch.setattr(A, "project_worth", lambda spark, sf_dir: A.P.primary_queries(spark, sf_dir).selectExpr("project_id", "'a' as intent", "1D as worth", "1D as sources", "1D as prom"))
    entry.queries()[name](spark, sf_dir)
    assert most[0] <= 3 and len(held) == 16 and max(held) <= 3


@pytest.mark.parametrize("name", ["k3_gaps", "k6_action_plan", "o2_json"])
def test_native_memory_is_given_back(spark, sf_dir, monkeypatch, name):
    """The driver's memory beyond its heap: two metrics at most are staged at a time, and freed native memory goes back to the system before and after each and after their union."""
    now, most, said, stage, trim = [], [0], [], A.stage, tables.trim_native

    def watched(df, name):
        now.append(name)
        most[0] = max(most[0], len(now))
        try:
            return stage(df, name)
        finally:
            now.pop()

    page = lambda spark, sf_dir: A.P.documents(spark, sf_dir, "word_count").selectExpr("doc_id", "double(word_count) as score")
    project = lambda spark, sf_dir: A.P.primary_queries(spark, sf_dir).selectExpr("project_id", "50D as score")
    monkeypatch.setattr(A, "stage", watched)
    monkeypatch.setattr(tables, "trim_native", lambda spark: said.append(trim(spark)))
    monkeypatch.setattr(A, "PAGE_METRICS", dict.fromkeys(A.PAGE_METRICS, page))
    monkeypatch.setattr(A, "PROJECT_METRICS", dict.fromkeys(A.PROJECT_METRICS, project))
    monkeypatch.setattr(A, "project_worth", lambda spark, sf_dir: A.P.primary_queries(spark, sf_dir).selectExpr("project_id", "'a' as intent", "1D as worth", "1D as sources", "1D as prom"))
    entry.queries()[name](spark, sf_dir)
    assert most[0] <= 2 and len(said) == 31 and all("native heap" in x for x in said)
