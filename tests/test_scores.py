"""Hand-derived golden cases for scores, scope, graph, delta and sessions."""

from pyspark.sql import functions as F

from siltscope.functions import numbers as nm
from siltscope.functions import text as tx
from siltscope.operators import delta as dl
from siltscope.operators import dependencies as dp
from siltscope.operators import graph as gr
from siltscope.operators import impact as im
from siltscope.operators import scope as sc
from siltscope.operators import sessions as ss
from siltscope.operators import history as hs


def test_rounding(spark):
    df = spark.createDataFrame([(-2.5,), (2.5,), (0.49,)], "x double")
    assert [r[0] for r in df.select(nm.js_round("x")).collect()] == [-2, 3, 0]


def test_trust_bounds(spark):
    df = spark.createDataFrame(
        [(1, 30, 80, 3, 5, 10, 20, None, None, None), (2, 90, 15, 0, 0, 1, 3, 90, "## Security\n" + "x\n" * 12, 400)],
        "scan_id int, overall_score int, vibe_index int, critical int, high int, medium int, low int, readability int, agents_content string, agents_tokens int")
    t = {r["scan_id"]: r["trust"] for r in im.trust_score(df).collect()}
    assert t[1] < 40 and t[2] >= 75


def test_scope(spark):
    b = spark.createDataFrame(
        [(1, "r", ["User login"], [], []), (2, "r", ["Quantum widget"], [], []), (3, "r", ["User login"], ["Payment checkout"], [])],
        "brief_id int, repo_id string, deliverables array<string>, exclusions array<string>, promised array<string>").withColumn("constraints", F.array(F.lit("none")))
    only_login = spark.createDataFrame([("r", "src/login.ts")], "repo_id string, text string")
    m = sc.scope_match(b, only_login)
    got = {r["brief_id"]: r["status"] for r in sc.drift_status(m, b).collect()}
    assert got[1] == "on-scope" and got[2] == "blocked"
    both = spark.createDataFrame([("r", "src/login.ts"), ("r", "src/stripe.ts")], "repo_id string, text string")
    out = {r["brief_id"]: r["out_of_scope"] for r in sc.scope_match(b, both).collect()}
    assert "payment:excluded" in out[3] and "payment:unplanned" in out[1]


def test_import_graph(files):
    f = files(
        ("src/a.ts", "import { b } from './b';\nimport { b } from './b';"), ("src/b.ts", "import { a } from './a';"), ("src/c/index.ts", "export const c = 1;"),
        ("src/d.ts", "import c from './c';"), ("src/lonely.ts", "const x = 1;"), ("src/components/Ui.tsx", "import q from '../db/query';"), ("src/db/query.ts", "export const q = 1;"), ("main.ts", "import './src/d.ts';"))
    e = gr.imports(f).persist()
    assert [(r["file_a"], r["file_b"]) for r in gr.circular_imports(e).collect()] == [("src/a.ts", "src/b.ts")]
    assert {r["path"] for r in gr.orphans(f, e).collect()} == {"src/lonely.ts", "main.ts"}
    assert [(r["path"], r["severity"]) for r in gr.layer_violations(e).collect()] == [("src/components/Ui.tsx", "high")]
    assert {r["resolved"] for r in e.filter("src = 'src/d.ts'").collect()} == {"src/c"}


def test_delta_states(files, spark):
    cur = files(("new", "n"), ("changed", "c2"), ("same", "s"), ("forced", "f"))
    old = dl.hashed(files(("changed", "c1"), ("same", "s"), ("forced", "f"), ("gone", "g"))).drop("content")
    vcs = spark.createDataFrame([("r", "forced")], "repo_id string, path string")
    got = {r["path"]: r["status"] for r in dl.delta(cur, old, vcs).collect()}
    assert got == {"new": "new", "changed": "changed", "same": "unchanged", "forced": "changed", "gone": "deleted"}
    assert dl.delta(cur.limit(0), old).filter("status <> 'deleted'").count() == 0
    assert dl.delta(cur, old.limit(0)).filter("status <> 'new'").count() == 0


def test_upper_median_and_trend(spark):
    rows = [(i, "o", f"u{i % 2}", "complete", s, "A", 0, f"2024-01-0{d} 00:00:0{i}") for i, (d, s) in enumerate([(1, 10), (1, 30), (1, 20), (1, 40), (2, 7), (3, None)])]
    s = spark.createDataFrame(rows, "scan_id int, org_id string, repo_url string, status string, overall_score int, grade string, vibe_score int, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    got = {str(r["day"]): (r["median_score"], r["avg_score"]) for r in hs.health_trend(s).collect()}
    assert got == {"2024-01-01": (30, 25), "2024-01-02": (7, 7)}
    t = {r["scan_id"]: (r["previous_score"], r["direction"]) for r in hs.score_trend(s).collect()}
    assert t[0] == (None, None) and t[2] == (10, "up") and t[4] == (20, "down")


def test_session(spark):
    turns = [(1, "user", q, False) for q in ("why does it fail?", "I want a map instead", "explain the concept", "I need a fix")] + [(1, "assistant", "code", True)] * 4 + [(2, "user", "make it", False)] * 3
    df = spark.createDataFrame(turns, "conv_id int, role string, text string, produced_code boolean")
    r = {x["conv_id"]: x for x in ss.session_scores(df).collect()}
    assert (r[1]["follow_ups"], r[1]["specific"], r[1]["conceptual"]) == (2, 2, 2)
    assert r[1]["red_flags"] == ["code-in-most-turns"] and r[1]["understanding"] == 30 + 16 + 12
    assert r[2]["red_flags"] == ["mostly-generic-requests", "no-follow-ups"] and r[2]["autonomy"] == 35


def test_phantoms(files, spark):
    f = files(("a.ts", "import e from 'expres';\nimport fs from 'fs';\nimport q from './q';\nimport n from 'nowhere-pkg';\nimport x from 'express';"), ("b.py", "import cv2\nimport os\nfrom sklearn.x import y"))
    deps = spark.createDataFrame([("r", "express")], "repo_id string, name string")
    got = {(r["name"], r["category"], r["nearest"]) for r in dp.phantom_imports(dp.import_statements(f), deps).collect()}
    assert got == {("expres", "typo", "express"), ("nowhere-pkg", "missing-dependency", None), ("cv2", "deprecated-api", None), ("sklearn", "deprecated-api", None)}


def test_pr_impact(spark):
    ch = spark.createDataFrame(
        [("p", "gone.ts", "removed", None, "x\n" * 199 + "x", None, None), ("p", "a.test.ts", "added", "ok\n" * 19 + "ok", None, 20, 0), ("p", "bad.ts", "modified", "async function f() { eval(x); }", None, None, None)],
        "pr_id string, path string, kind string, content string, previous_content string, lines_added int, lines_removed int")
    d = {r["path"]: r["score_delta"] for r in im.pr_file_impact(ch).collect()}
    assert d["gone.ts"] == 1.5 and d["a.test.ts"] == 1.0 and d["bad.ts"] == -(4 + 2.5 + 1.5)
    cur = spark.createDataFrame([("p", 50), ("none", 70)], "pr_id string, current_score int")
    out = {r["pr_id"]: r for r in im.pr_impact(im.pr_file_impact(ch), ch, cur).collect()}
    assert out["p"]["predicted_score"] == 45 and out["none"]["total_delta"] == 0 and out["none"]["vibe_direction"] == "insufficient-data"


def test_pr_impact_of_a_path_listed_twice(spark):
    """Each row's reasons count once: under another kind as a file of its own, under the same kind added up."""
    bad = "async function f() { eval(x); }"
    ch = spark.createDataFrame(
        [("p", "a.ts", "removed", None, "x", None, None), ("p", "a.ts", "added", bad, None, None, None), ("p", "b.ts", "modified", bad, None, None, None), ("p", "b.ts", "modified", "eval(y)", None, None, None), ("p", "c.ts", "added", "ok", None, 1, 0)],
        "pr_id string, path string, kind string, content string, previous_content string, lines_added int, lines_removed int")
    r = im.pr_reasons(ch)
    f = im.pr_file_impact(ch, r)
    got = {(x["path"], x["kind"]): (x["score_delta"], x["n_reasons"]) for x in f.collect()}
    assert f.count() == 4
    assert got == {("a.ts", "removed"): (0.2, 1), ("a.ts", "added"): (-8.0, 3), ("b.ts", "modified"): (-12.0, 4), ("c.ts", "added"): (0.0, 0)}
    fixes = sorted((x["path"], x["reason"], x["points_saved"]) for x in im.fix_recommendations(f, r).collect())
    assert fixes == [("a.ts", "async-unguarded", 5.6), ("a.ts", "missing-error-boundary", 5.6), ("a.ts", "security-naivety", 6.8),
                     ("b.ts", "async-unguarded", 8.4), ("b.ts", "missing-error-boundary", 8.4), ("b.ts", "security-naivety", 10.2), ("b.ts", "security-naivety", 10.2)]
    assert {x["category"]: x["delta"] for x in im.impact_breakdown(f, r).collect()}["code-removal"] == 0.2


def test_path_helpers(spark):
    df = spark.createDataFrame([("src/a.b/c.test.ts",), ("README",), ("x/.env",)], "p string")
    got = [tuple(r) for r in df.select(tx.base_name("p"), tx.extension("p"), tx.directory("p"), tx.stem("p")).collect()]
    assert got == [("c.test.ts", ".ts", "src/a.b", "c.test"), ("README", "", "", "README"), (".env", "", "x", ".env")]
