"""Readers, parsers and sinks on small files."""

import json

from pyspark.sql import functions as F

from siltscope.sources import files as sf
from siltscope.sources import quality as sq
from siltscope.sources import scanners as sn
from siltscope.sources import sinks


def test_read_files(spark, tmp_path):
    for p, t in {"app/src/a b.ts": "one\ntwo\n", "app/node_modules/x.ts": "no", "app/b.md": "no", "lib/c.py": "x", "lib/big.py": "y" * 500}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    got = {(r["repo_id"], r["path"], r["content"]) for r in sf.read_files(spark, str(tmp_path), max_bytes=100).collect()}
    assert got == {("app", "src/a b.ts", "one\ntwo\n"), ("lib", "c.py", "x")}


def test_sarif_vulns_and_secret_hits(spark, tmp_path):
    sarif = {"runs": [{"results": [
        {"ruleId": "a", "properties": {"severity": "error"}, "message": {"text": "m"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "x.ts"}}}]},
        {"ruleId": "b", "level": "note"}, {"ruleId": "c"}]}]}
    (tmp_path / "repo1.sarif").write_text(json.dumps(sarif, indent=1))
    got = [(r["repo_id"], r["rule"], r["severity"], r["path"], r["confidence"]) for r in sn.read_sarif(spark, str(tmp_path / "repo1.sarif")).collect()]
    assert got == [("repo1", "a", "ERROR", "x.ts", 0.9), ("repo1", "b", "NOTE", "", 0.3), ("repo1", "c", "WARNING", "", 0.6)]
    (tmp_path / "repo2.json").write_text(json.dumps({"Results": [{"Vulnerabilities": [{"VulnerabilityID": "v1", "PkgName": "p", "Severity": "HIGH"}]}, {}]}))
    assert [(r["repo_id"], r["vuln_id"], r["package"]) for r in sn.read_vulns(spark, str(tmp_path / "repo2.json")).collect()] == [("repo2", "v1", "p")]
    (tmp_path / "repo3.jsonl").write_text('{"DetectorName": "aws", "Verified": true, "Raw": "' + "r" * 40 + '"}\nnot json\n{"Raw": "s"}\n')
    got = sorted((r["detector"], r["verified"], len(r["raw"])) for r in sn.read_secret_hits(spark, str(tmp_path / "repo3.jsonl")).collect())
    assert got == [("aws", True, 20), ("unknown", False, 1)]


def test_quality_profile_xml(spark, tmp_path):
    xml = """<?xml version="1.0"?><profile><name>n</name><language>ts</language><rules>
    <rule><repositoryKey>my-bugs</repositoryKey><key>S1</key><priority>MAJOR</priority><parameters><parameter><key>max</key><value>3</value></parameter></parameters></rule>
    <rule><repositoryKey>security</repositoryKey><key>S2</key><priority>critical</priority></rule>
    <rule><repositoryKey>x</repositoryKey><key>S3</key></rule></rules></profile>"""
    (tmp_path / "p.xml").write_text(xml)
    rules = sq.read_profile(spark, str(tmp_path / "p.xml"))
    got = sorted((r["rule_key"], r["severity"], r["weight"], r["category"], r["parameters"]) for r in rules.collect())
    assert got == [("S1", "MAJOR", 0.7, "reliability", {"max": "3"}), ("S2", "CRITICAL", 0.85, "security", {}), ("S3", "MAJOR", 0.7, "unknown", {})]
    cov = sq.migration_coverage(rules).collect()[0]
    assert (cov["total"], cov["mapped"], cov["unmapped"]) == (3, 2, ["x"])
    assert {r["category"] for r in sq.category_gaps(rules).collect()} == {"maintainability", "hygiene", "performance", "architecture"}


def test_issues_and_gate(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps({"total": 2, "issues": [{"rule": "a", "severity": "odd", "line": "12 x", "type": "BUG"}, {"rule": "b", "severity": "info", "line": 3}]}))
    got = sorted((r["rule"], r["severity"], r["category"], r["line"]) for r in sq.read_issues(spark, str(tmp_path / "i.json")).collect())
    assert got == [("a", "MAJOR", "reliability", 12), ("b", "INFO", "unknown", 3)]
    (tmp_path / "g.json").write_text(json.dumps({"name": "g", "conditions": [{"metric": "coverage", "op": "LT", "error": "80"}, {"id": "other", "warning": "x"}]}))
    got = [(r["metric"], r["operator"], r["error_threshold"], r["warning_threshold"]) for r in sq.read_gate(spark, str(tmp_path / "g.json")).collect()]
    assert got == [("test_coverage", "LT", 80.0, None), ("other", "LT", None, None)]


def test_responses(spark):
    raw = ['{"findings": []}', 'x ```json\n{"issues": [{"description": "d"}]}\n``` y', 'see {"problems": [{"description": "a } b", "line": 2, "confidence": 7}]} end', "no", "{broken"]
    df = spark.createDataFrame([(i, r, 10) for i, r in enumerate(raw)], "id int, raw string, start int")
    out = sn.normalize_findings(sn.parse_responses(df, "raw", sn.RESPONSE), ["id"], "start").orderBy("id")
    assert [(r["id"], r["line"], r["type"], r["confidence"], r["severity"]) for r in out.collect()] == [(1, 0, "quality-d", 0.7, "medium"), (2, 11, "quality-a-b", 1.0, "medium")]


def test_manifests(files):
    f = files(
        ("package.json", '{"dependencies": {"@s/a": "1"}, "peerDependencies": {"p": "2"}, "workspaces": ["packages/*"]}'), ("go.mod", "module x\nrequire (\n\tgithub.com/a/b v1.2.3\n)"),
        ("Cargo.toml", '[dependencies]\nserde = "1.0"\n'), ("Gemfile", "gem 'rails'\n"), ("x/requirements-dev.txt", "Flask==1\n# c\n"), ("pyproject.toml", 'Req = { version = "1" }'))
    got = {(r["manifest_path"], r["kind"], r["name"]) for r in sf.extract_deps(f).collect()}
    assert got == {("package.json", "prod", "@s/a"), ("package.json", "alias", "a"), ("package.json", "peer", "p"), ("package.json", "workspace", "packages/*"),
                   ("go.mod", "prod", "github.com/a/b"), ("Cargo.toml", "prod", "serde"), ("Gemfile", "prod", "rails"), ("x/requirements-dev.txt", "prod", "flask"), ("pyproject.toml", "prod", "req")}


def test_sarif_documents_hold_every_finding_once(spark):
    f = spark.range(2500).selectExpr("'r' AS repo_id", "concat('p', id) AS path", "1 AS line", "'x' AS rule", "'high' AS severity", "'d' AS detail")
    docs = [json.loads(r["document"]) for r in sinks.to_sarif(f, per_document=1000).collect()]
    uris = [x["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] for d in docs for x in d["runs"][0]["results"]]
    assert len(docs) == 3 and sorted(uris) == sorted(f"p{i}" for i in range(2500)) and docs[0]["version"] == "2.1.0"


def test_review_rows(spark):
    f = spark.createDataFrame([("r", None, "HIGH", 0, "a|b", "x" * 200), ("r", "p", None, 3, "", "two\nlines | bar")], "repo_id string, path string, severity string, line int, rule string, detail string")
    got = [tuple(r)[1:] for r in sinks.review_rows(f).collect()]
    assert got == [("<file>", "high", "-", "a\\|b", "x" * 100), ("p", "info", "L3", "unknown", "two lines \\| bar")]


def test_stratified_sample_round_robin(files):
    f = files(*[(f"{d}/{i}.ts", "x" * 20) for d in ("a", "b") for i in range(8)], ("root.ts", "y"))
    got = [r["path"] for r in sf.stratified_sample(f, max_total=4, max_per_dir=5, cut=3).orderBy("path").collect()]
    assert got == ["a/0.ts", "a/1.ts", "b/0.ts", "root.ts"]
    assert sf.stratified_sample(f, 4, 5, cut=3).select(F.max(F.length("content"))).collect()[0][0] == 3
