"""Configuration, reports and streams."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from seamline import config
from seamline.plans import reports
from seamline.streaming import watch


def test_config(tmp_path):
    assert config.load(str(tmp_path)) == config.ProjectConfig()
    (tmp_path / ".repolens.yml").write_text("languages: [Python, python]\nignore: ['gen/*', '']\nrules:\n  suppressions:\n    - {rule: shell-true, path: 'x/*'}\n  severity: {shell-true: LOW}\nui: {node_budget: -5, edge_contrast: 500}\ncache: {ttl_seconds: x}\nclassification: {owned_prefixes: [Shop]}\n")
    got = config.load(str(tmp_path))
    assert (got.languages, got.ignore, got.suppressions, got.severity) == (("python",), ("gen/*",), (("shell-true", "x/*"),), (("shell-true", "low"),))
    assert (got.node_budget, got.edge_contrast, got.ttl_seconds, got.classification.owned_prefixes) == (0, 100, 300, ("Shop",))
    assert got.fingerprint() != config.ProjectConfig().fingerprint() and len(got.fingerprint()) == 12


@pytest.fixture(scope="module")
def commit_files(spark):
    rows = [("s1", "Alice", "2024", "app/auth.py", "auth.py"), ("s2", "Bob", "2025", "app/auth.py", "auth.py"), ("s2", "Bob", "2025", "docs/adr.md", "docs"), ("s3", "Bob", "2025", "app/auth.py", "auth.py")]
    return spark.createDataFrame(rows, "sha string, author string, ts string, path string, component string").cache()


def test_impact_and_verification(spark, commit_files):
    changed = spark.createDataFrame([("app/auth.py", "D"), ("new.py", "A")], "path string, status string")
    got = {r.path: r for r in reports.impact_report(changed, commit_files).collect()}
    assert (got["app/auth.py"].risk, got["app/auth.py"].owner, got["app/auth.py"].owners, got["app/auth.py"].related) == ("high", "Bob", 2, 1)
    assert got["new.py"].risk == "low" and "no historical owner found" in got["new.py"].reasons
    plan = {r.path: r for r in reports.verification_plan(changed, spark.createDataFrame([("tests/test_auth.py",)], "path string")).collect()}
    assert plan["app/auth.py"].tests == ["tests/test_auth.py"] and plan["app/auth.py"].reason.startswith("Deleted") and plan["new.py"].tests == []


def test_evidence(spark):
    rows = [("commit", "s1", "", "Add Redis cache", "timeout", "2024"), ("document", "d1", "docs/adr/1.md", "Use queues", "redis cluster", "2025"), ("commit", "s2", "", "prefixcaching", "", "2025")]
    evidence = spark.createDataFrame(rows, "source_type string, source_id string, path string, title string, snippet string, ts string")
    assert [r.source_id for r in reports.decisions(evidence, "redis cluster").collect()] == ["d1", "s1"]
    assert [r.title for r in reports.decisions(evidence, "nothing").collect()] == [reports.NO_DECISION]
    assert {r.source_id for r in reports.search_evidence(evidence, "redis").collect()} == {"s1", "d1"}
    assert [r.source_id for r in reports.search_evidence(evidence, "refixcach").collect()] == ["s2"]
    pack = {"evidence": evidence}
    assert "source_id: s1" in reports.render(pack) and json.loads(reports.render(pack, "json"))["evidence"][0]["source_id"] == "s1" and "<source_id>d1</source_id>" in reports.render(pack, "xml")


def test_debounce(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [{"tree": "t", "path": f"{i}.py", "seconds": s} for i, s in enumerate([0.0, 0.1, 0.35, 0.4, 1.0])]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, lines)))
    events = spark.readStream.schema("tree string, path string, seconds double").json(str(tmp_path / "in"))
    seen = []
    watch.watch(watch.debounced(events), lambda batch, n: seen.extend(r.seconds for r in batch.collect()), str(tmp_path / "ck"), once=True).awaitTermination(90)
    assert sorted(seen) == [0.0, 0.35, 1.0]


def test_sessions(spark):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    events = spark.createDataFrame([(1, at(0)), (1, at(10)), (1, at(50)), (2, at(5))], "user_id long, ts timestamp")
    got = sorted((r.user_id, r.events) for r in watch.sessions(events).collect())
    assert got == [(1, 1), (1, 2), (2, 1)]
    assert events.where(F.col("user_id") == 3).count() == 0
