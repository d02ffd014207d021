"""Readers and streams on small files written here."""

import json
import shutil

from pyspark.sql import functions as F

from factloom.scratch import Scratch
from factloom.sources import documents, reports
from factloom.streaming import incremental


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_documents(spark, tmp_path):
    put(tmp_path / "wiki/a.md", "---\nid: wiki/alpha\ntitle: 'The first'\nversion: 3\nlastmodified: 2025-01-02T03:04:05+01:00\n---\n\n# Big Heading!\n\ntext\n\n## Second\n")
    put(tmp_path / "docs/b.md", "no header here\n")
    put(tmp_path / "tickets/T-1.json", json.dumps({"id": "ticket/T-1", "key": "T-1", "summary": "s", "status": "Done", "type": "bug", "updated": "2025-02-03T00:00:00Z", "labels": ["x", "y"], "description": "",
        "comments": [{"id": "c1", "author": "ann", "created": "2025-02-01", "body": "hello"}]}))
    put(tmp_path / "pulls/7.json", json.dumps({"number": 7, "title": "t", "state": "merged", "opened": "2025-01-01T00:00:00Z", "closed": None, "body": "b", "files": ["f"], "comments": [{"id": "k", "author": "bo", "created": "2025-03-01T00:00:00Z", "body": "x"}]}))
    rows = {r.id: r for r in documents.read_all(spark, str(tmp_path)).collect()}
    assert set(rows) == {"wiki/alpha", "doc/b", "ticket/T-1", "pull/7"}
    w = rows["wiki/alpha"]
    assert (w.version, w.title, w.anchors, w.text.startswith("# Big")) == ("3", "The first", ["big-heading", "second"], True)
    assert str(w.lastmodified) == "2025-01-02 02:04:05" or w.lastmodified.hour in (2, 3)
    assert rows["doc/b"].text == "no header here\n" and rows["doc/b"].version is None
    t = rows["ticket/T-1"]
    assert t.anchors == ["description", "c1"] and "(empty)" in t.text and "[c1] ann at 2025-02-01:\nhello" in t.text
    assert rows["pull/7"].version.startswith("2025-03-01T00:00:00")


def test_reports(spark, tmp_path):
    meta = {"metadata": {"commit": "abc", "step": "c1"}}
    put(tmp_path / "pytest-c1.json", json.dumps({"tests": [{"nodeid": "t::a", "outcome": "passed"}, {"nodeid": "t::b", "outcome": "failed"}], **meta}))
    put(tmp_path / "pytest-c1-rerun.json", json.dumps({"tests": [{"nodeid": "t::b", "outcome": "passed"}], **meta}))
    got = {(r.node_id, r.attempt, r.outcome, r.step, r.commit) for r in reports.read_pytest_json(spark, f"{tmp_path}/pytest-*.json").collect()}
    assert got == {("t::a", 1, "passed", "c1", "abc"), ("t::b", 1, "failed", "c1", "abc"), ("t::b", 2, "passed", "c1", "abc")}
    put(tmp_path / "v.json", json.dumps({"testResults": [{"assertionResults": [{"ancestorTitles": ["A", "B"], "title": "c", "status": "passed"}]}], **meta}))
    assert [r.node_id for r in reports.read_vitest_json(spark, f"{tmp_path}/v.json").collect()] == ["A > B > c"]
    lines = [{"$report_type": "TestReport", "nodeid": "n", "when": "setup", "outcome": "passed"}, {"$report_type": "TestReport", "nodeid": "n", "when": "call", "outcome": "failed"},
             {"$report_type": "TestReport", "nodeid": "s", "when": "setup", "outcome": "skipped"}, {"$report_type": "SessionStart"}]
    put(tmp_path / "log.jsonl", "\n".join(map(json.dumps, lines)))
    assert {(r.node_id, r.outcome) for r in reports.read_reportlog(spark, f"{tmp_path}/log.jsonl").collect()} == {("n", "failed"), ("s", "skipped")}
    put(tmp_path / "j.xml", '<testsuites><testsuite><testcase name="a" classname="m"/><testcase name="b" classname="m"><failure message="x">y</failure></testcase>'
        '<testcase name="c"><skipped/></testcase><testcase name="d"><error message="e"/></testcase></testsuite></testsuites>')  # fmt: skip
    assert {(r.node_id, r.outcome) for r in reports.read_junit(spark, f"{tmp_path}/j.xml").collect()} >= {("m::a", "passed"), ("m::b", "failed"), ("d", "error")}
    suite = {"title": "f.ts", "suites": [{"title": "group", "specs": [{"title": "works", "tests": [{"projectName": "mock", "results": [{"status": "failed"}, {"status": "passed"}]}]}]}], "specs": []}
    put(tmp_path / "pw.json", json.dumps({"suites": [suite]}))
    assert [(r.node_id, r.outcome) for r in reports.read_playwright_json(spark, f"{tmp_path}/pw.json").collect()] == [("[mock] › group › works", "passed")]
    deep = {"title": "deep", "specs": [{"title": "end", "tests": [{"projectName": "mock", "results": [{"status": "passed"}]}]}, {"title": "none", "tests": [{"projectName": "mock", "results": []}]}]}
    for n in range(12):
        deep = {"title": f"s{n}", "suites": [deep]}
    put(tmp_path / "deep.json", json.dumps({"suites": [deep]}))
    got = {(r.node_id, r.outcome) for r in reports.read_playwright_json(spark, f"{tmp_path}/deep.json").collect()}
    path = " › ".join([f"s{n}" for n in range(10, -1, -1)] + ["deep"])
    assert got == {(f"[mock] › {path} › end", "passed"), (f"[mock] › {path} › none", None)}
    assert {r.path.rsplit("/", 1)[1]: r["shape"] for r in reports.report_shapes(spark, f"{tmp_path}/*.json").collect()} == {
        "pytest-c1.json": "pytest", "pytest-c1-rerun.json": "pytest", "v.json": "vitest", "pw.json": "playwright", "deep.json": "playwright"}
    assert {r.node_id for r in reports.read_runs(spark, f"{tmp_path}/*.json").collect()} >= {"t::a", "A > B > c", "[mock] › group › works"}
    a, b = spark.createDataFrame([("x",), ("y",)], "node_id string"), spark.createDataFrame([("y",), ("z",)], "node_id string")
    assert {tuple(r) for r in reports.cross_check(a, b).collect()} == {("x", "collected"), ("z", "reported")}


def test_streams(spark, tmp_path):
    from datetime import datetime as dt

    rows = [(n, dt(2025, 1, 1 + n // 4, n % 4), n % 3, "click", 1.0, None) for n in range(20)] + [(99, None, 1, "click", 1.0, None)]
    spark.createDataFrame(rows, incremental.EVENTS).repartition(3).write.parquet(f"{tmp_path}/events")
    source = incremental.read_events(spark, f"{tmp_path}/events", files_per_batch=1)
    state = f"file://{tmp_path}/state"
    run = lambda: {(r.user_id, r.event_id) for r in incremental.latest_by_key(incremental.read_events(spark, f"{tmp_path}/events", files_per_batch=1).select("user_id", "ts", "event_id"), state, ["user_id"], ["ts", "event_id"], compact=2).collect()}
    assert run() == {(0, 18), (1, 19), (2, 17)}
    assert run() == {(0, 18), (1, 19), (2, 17)}  # nothing new, nothing lost
    spark.createDataFrame([(50, dt(2026, 1, 1), 1, "click", 1.0, None), (51, dt(2020, 1, 1), 2, "click", 1.0, None)], incremental.EVENTS).write.mode("append").parquet(f"{tmp_path}/events")
    assert run() == {(0, 18), (1, 50), (2, 17)}
    # A batch that was written but not committed runs again.
    last = max((tmp_path / "state/checkpoint/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    assert run() == {(0, 18), (1, 50), (2, 17)}
    shutil.rmtree(tmp_path / "events")
    spark.createDataFrame(rows, incremental.EVENTS).repartition(3).write.parquet(f"{tmp_path}/events")
    daily = incremental.tumbling(incremental.read_events(spark, f"{tmp_path}/events", files_per_batch=10)).drop("total")
    assert {r.n for r in incremental.drain(daily, daily.schema, Scratch(spark, "t"), "d").collect()} == {4}
