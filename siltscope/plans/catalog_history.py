"""Registered queries: findings roll-ups, scan history, deltas, commits."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltscope.functions import numbers as nm
from siltscope.functions import text as tx
from siltscope.operators import commits as cm
from siltscope.operators import delta as dl
from siltscope.operators import evaluate as ev
from siltscope.operators import findings as fd
from siltscope.operators import history as hs
from siltscope.operators import matching
from siltscope.plans import driver_tables as dt
from siltscope.plans import oracle as o
from siltscope.plans.catalog_text import PROSE_RULES
from siltscope.plans.registry import lit, query
from siltscope.rules import tables as rt

W30 = "CASE severity WHEN 'critical' THEN 30.0 WHEN 'high' THEN 15.0 WHEN 'medium' THEN 5.0 WHEN 'low' THEN 1.0 ELSE 0.0 END"
W8 = "CASE severity WHEN 'critical' THEN 8.0 WHEN 'high' THEN 4.0 WHEN 'medium' THEN 2.0 WHEN 'low' THEN 0.5 ELSE 0.0 END"
W10 = "CASE severity WHEN 'critical' THEN 10.0 WHEN 'high' THEN 5.0 WHEN 'medium' THEN 2.0 WHEN 'low' THEN 1.0 ELSE 0.0 END"
HOURS = "CASE severity WHEN 'critical' THEN 4.0 WHEN 'high' THEN 2.0 WHEN 'medium' THEN 0.5 WHEN 'low' THEN 0.1 ELSE 0.5 END"


# --- flagship ---------------------------------------------------------------------------------

def document_findings(spark, sf):
    files = dt.doc_files(spark, sf)
    prose = matching.match_lines(files, PROSE_RULES)
    secrets = matching.secret_scan(files).select("repo_id", "path", "line", "rule", "severity")
    inj = matching.injection_scan(files, "content").filter("is_injection").select(
        "repo_id", "path", F.lit(0).alias("line"), F.lit("prompt-injection").alias("rule"), F.lit("high").alias("severity"))
    return fd.union_findings(prose, secrets, inj)


def worst_documents(spark, sf, k: int = 10):
    return fd.worst_files(fd.file_scores(document_findings(spark, sf)), k)


_INJ = " OR ".join(o.matches("content", r.pattern) for r in rt.INJECTION_RULES[:5]) + " OR regexp_matches(content, '[' || chr(8203) || chr(8204) || chr(8205) || chr(65279) || ']')"
_SEC = " UNION ALL ".join(
    f"SELECT repo_id, path, 'critical' AS severity FROM (SELECT repo_id, path, unnest(regexp_extract_all(text, {lit(r.pattern)})) AS m FROM doc_lines) WHERE NOT contains(m, 'test') AND NOT contains(m, 'example')"
    for r in rt.SECRET_RULES)
DOC_FINDINGS = f"""{dt.DOC_LINES}, df AS (
  SELECT repo_id, path, severity FROM ({o.line_hits(PROSE_RULES, 'doc_lines')})
  UNION ALL {_SEC}
  UNION ALL SELECT repo_id, path, 'high' FROM doc_files WHERE {_INJ})"""


@query("flagship_worst_documents", f"""WITH {DOC_FINDINGS} SELECT repo_id, path, CAST(sum({W30}) AS DOUBLE) AS score, count(*) AS n_findings FROM df GROUP BY 1, 2
HAVING sum({W30}) > 0 ORDER BY score DESC, repo_id, path LIMIT 10""")
def flagship(spark, sf):
    return worst_documents(spark, sf)


@query("u1_union_findings", f"WITH {DOC_FINDINGS} SELECT repo_id, severity, count(*) AS n FROM df GROUP BY 1, 2")
def u1(spark, sf):
    return document_findings(spark, sf).groupBy("repo_id", "severity").agg(F.count("*").alias("n"))


# --- findings -----------------------------------------------------------------------------------

@query("a1_file_scores", f"WITH {dt.FINDINGS} SELECT repo_id, path, CAST(sum({W30}) AS DOUBLE) AS score, count(*) AS n_findings FROM findings GROUP BY 1, 2")
def a1(spark, sf):
    return fd.file_scores(dt.findings(spark, sf))


@query("t1_worst_files", f"""WITH {dt.FINDINGS} SELECT repo_id, path, CAST(sum({W30}) AS DOUBLE) AS score, count(*) AS n_findings FROM findings GROUP BY 1, 2
QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY sum({W30}) DESC, path) <= 10""")
def t1(spark, sf):
    return fd.worst_files(fd.file_scores(dt.findings(spark, sf)), 10, per_repo=True)


@query("a1_file_reasons", f"""WITH {dt.FINDINGS}, w AS (SELECT repo_id, path FROM findings GROUP BY 1, 2 ORDER BY sum({W30}) DESC, repo_id, path LIMIT 10)
SELECT f.repo_id, f.path, f.line, f.rule, f.detail FROM findings f JOIN w ON f.repo_id = w.repo_id AND f.path = w.path
QUALIFY row_number() OVER (PARTITION BY f.repo_id, f.path ORDER BY ordinal, line, rule) <= 5""")
def a1_reasons(spark, sf):
    f = dt.findings(spark, sf)
    return fd.file_reasons(f, fd.worst_files(fd.file_scores(f), 10), 5).select("repo_id", "path", "line", "rule", "detail")


@query("a2_static_score", f"""WITH {dt.FINDINGS} SELECT CAST(s_suppkey AS VARCHAR) AS repo_id, CAST(coalesce(sum({W8}), 0) AS DOUBLE) AS penalty,
CAST(floor(100 - least(coalesce(sum({W8}), 0), 100) + 0.5) AS INTEGER) AS score FROM supplier LEFT JOIN findings ON repo_id = CAST(s_suppkey AS VARCHAR) GROUP BY s_suppkey""")
def a2(spark, sf):
    repos = dt.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("repo_id"))
    return fd.static_score(dt.findings(spark, sf), repos)


@query("a3_quality_score", f"""WITH {dt.FINDINGS}, p AS (SELECT repo_id, sum({W10}) AS penalty FROM findings GROUP BY 1),
ph AS (SELECT repo_id, sum({W10}) AS phantom_points FROM findings WHERE rule = 't1' GROUP BY 1),
n AS (SELECT repo_id, count(*) AS files FROM (SELECT DISTINCT repo_id, path FROM findings) GROUP BY 1),
j AS (SELECT n.repo_id, files, coalesce(penalty, 0) AS penalty, coalesce(phantom_points, 0) AS phantom_points FROM n LEFT JOIN p ON n.repo_id = p.repo_id LEFT JOIN ph ON n.repo_id = ph.repo_id)
SELECT repo_id, files, CAST(penalty AS DOUBLE) AS penalty, CAST(phantom_points AS DOUBLE) AS phantom_points,
 CAST(greatest(0, greatest(0, floor(100 - penalty / greatest(1.0, sqrt(files)) + 0.5)) - phantom_points) AS INTEGER) AS score,
 greatest(0, greatest(0, floor(100 - penalty / greatest(1.0, sqrt(files)) + 0.5)) - phantom_points) >= 90 AS passed FROM j""")
def a3(spark, sf):
    f = dt.findings(spark, sf)
    return fd.quality_score(f, f.filter("rule = 't1'"), f.select("repo_id", "path").distinct(), threshold=90)


@query("a4_finding_rollup", f"WITH {dt.FINDINGS} SELECT repo_id, severity, category, count(*) AS n FROM findings GROUP BY ROLLUP (repo_id, severity, category)")
def a4(spark, sf):
    return fd.finding_rollup(dt.findings(spark, sf))


@query("a4_finding_cube", f"WITH {dt.FINDINGS} SELECT severity, category, count(*) AS n FROM findings GROUP BY CUBE (severity, category)")
def a4b(spark, sf):
    return fd.finding_cube(dt.findings(spark, sf))


@query("w6_first_n", f"""WITH {dt.FINDINGS} SELECT repo_id, path, line, rule, ordinal FROM findings QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY ordinal, line, path) <= 5""")
def w6(spark, sf):
    from siltscope.operators.ordered import first_n

    return first_n(dt.findings(spark, sf), ["repo_id"], ["ordinal", "line", "path"], 5).select("repo_id", "path", "line", "rule", "ordinal")


@query("w7_cap_findings", f"""WITH {dt.FINDINGS} SELECT repo_id, path, category, rule, line, confidence, detail FROM findings
QUALIFY row_number() OVER (PARTITION BY repo_id, path, category, rule ORDER BY confidence DESC, line, ordinal, detail) <= 1""")
def w7(spark, sf):
    return fd.cap_findings(dt.findings(spark, sf)).select("repo_id", "path", "category", "rule", "line", "confidence", "detail")


@query("w8_best_confidence", f"""WITH {dt.FINDINGS} SELECT repo_id, path, rule, line, severity, confidence, detail FROM findings
QUALIFY row_number() OVER (PARTITION BY repo_id, path, rule, line ORDER BY confidence DESC, ordinal) = 1""")
def w8(spark, sf):
    return fd.best_confidence(dt.findings(spark, sf)).select("repo_id", "path", "rule", "line", "severity", "confidence", "detail")


@query("a23_debt_ratio", f"""WITH {dt.FINDINGS}, a AS (SELECT repo_id, count(*) AS fixable, sum({HOURS}) AS fix_hours, count(DISTINCT path) * 100 AS lines FROM findings GROUP BY 1)
SELECT repo_id, lines, fixable, round(CAST(fix_hours AS DOUBLE), 4) AS fix_hours, CAST(floor(fix_hours / (lines / 50) * 100 + 0.5) AS INTEGER) AS debt_ratio FROM a""")
def a23(spark, sf):
    f = dt.findings(spark, sf)
    lines = f.groupBy("repo_id").agg((F.countDistinct("path") * 100).alias("lines"))
    return fd.debt_ratio(f, lines).withColumn("fix_hours", F.round("fix_hours", 4))


def _facts(spark, sf):
    f = dt.findings(spark, sf)
    n = lambda c: F.sum(F.expr(f"IF({c}, 1, 0)")).cast("long")
    return f.groupBy("repo_id").agg(
        n("rule = 't0' AND line = 1").alias("null_safety"), n("rule = 't1' AND line = 7").alias("loose_equality"), n("rule = 't2' AND line = 7 AND severity = 'low'").alias("console_left"),
        n("rule = 't3' AND line = 7 AND severity = 'low'").alias("missing_timeout"), n("rule = 't4' AND line = 7 AND severity = 'low'").alias("memory_leak"),
        n("rule = 't5' AND line = 7 AND severity = 'low'").alias("unhandled_rejection"), n("rule = 't6' AND line = 7 AND severity = 'low'").alias("secrets"),
        (F.min("ordinal") % 101).cast("int").alias("overall_score"))


_FACTS = f"""{dt.FINDINGS}, facts AS (SELECT repo_id, count(*) FILTER (WHERE rule = 't0' AND line = 1) AS null_safety, count(*) FILTER (WHERE rule = 't1' AND line = 7) AS loose_equality,
 count(*) FILTER (WHERE rule = 't2' AND line = 7 AND severity = 'low') AS console_left, count(*) FILTER (WHERE rule = 't3' AND line = 7 AND severity = 'low') AS missing_timeout,
 count(*) FILTER (WHERE rule = 't4' AND line = 7 AND severity = 'low') AS memory_leak, count(*) FILTER (WHERE rule = 't5' AND line = 7 AND severity = 'low') AS unhandled_rejection,
 count(*) FILTER (WHERE rule = 't6' AND line = 7 AND severity = 'low') AS secrets, CAST(min(ordinal) % 101 AS INTEGER) AS overall_score FROM findings GROUP BY 1)"""
_DEBT = f"""{_FACTS}, items AS (
  SELECT repo_id, 0 AS item_no, 'null-guards' AS issue, 'Reliability' AS category, 'high' AS severity, CAST(ceil(null_safety / 3) * 6 AS BIGINT) AS hours_per_month FROM facts WHERE null_safety > 0
  UNION ALL SELECT repo_id, 1, 'loose-equality', 'Correctness', 'medium', CAST(ceil(loose_equality / 10) * 4 AS BIGINT) FROM facts WHERE loose_equality > 0
  UNION ALL SELECT repo_id, 2, 'console-output', 'Observability', 'medium', 1 FROM facts WHERE console_left > 0
  UNION ALL SELECT repo_id, 3, 'missing-timeouts', 'Reliability', 'high', 2 FROM facts WHERE missing_timeout > 0
  UNION ALL SELECT repo_id, 4, 'memory-leaks', 'Performance', 'high', 3 FROM facts WHERE memory_leak > 0
  UNION ALL SELECT repo_id, 5, 'unhandled-rejections', 'Reliability', 'critical', 4 FROM facts WHERE unhandled_rejection > 0
  UNION ALL SELECT repo_id, 6, 'exposed-secrets', 'Security', 'critical', 8 FROM facts WHERE secrets > 0
  UNION ALL SELECT repo_id, 7, 'low-quality', 'Productivity', 'medium', CAST(floor((60 - overall_score) * 0.5 + 0.5) AS BIGINT) FROM facts WHERE overall_score < 60)"""


@query("a22_debt_interest", f"WITH {_DEBT} SELECT repo_id, item_no, issue, category, severity, hours_per_month, hours_per_month * 1200 AS cost_per_year FROM items")
def a22(spark, sf):
    return fd.debt_interest(_facts(spark, sf))


@query("a22_top_debt", f"WITH {_DEBT} SELECT repo_id, issue, hours_per_month FROM items QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY hours_per_month DESC, item_no) <= 3")
def a22b(spark, sf):
    return fd.top_debt(fd.debt_interest(_facts(spark, sf)), 3).select("repo_id", "issue", "hours_per_month")


_RECO = {
    "worst_files": "null_safety % 2", "critical_dependencies": "loose_equality % 2", "deploy_blockers": "secrets", "layer_violations": "memory_leak", "xlarge_files": "console_left",
    "critical_hygiene": "missing_timeout", "enterprise_blockers": "null_safety % 3", "unhandled_rejection": "unhandled_rejection", "dependency_score": "overall_score",
    "god_files": "loose_equality % 3", "naming_mixes": "null_safety % 5",
}
_READY = "CASE WHEN secrets > 0 THEN 'not-ready' ELSE 'ready' END"


@query("t2_top_recommendations", f"WITH {_FACTS}, r AS (SELECT repo_id, {', '.join(f'{e} AS {n}' for n, e in _RECO.items())}, {_READY} AS readiness FROM facts), x AS ("
       + " UNION ALL ".join(f"SELECT repo_id, {p} AS priority, {lit(n)} AS action FROM r WHERE {c}" for p, n, c in fd.RECOMMENDATIONS)
       + ") SELECT repo_id, priority, action FROM x QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY priority) <= 10")
def t2(spark, sf):
    f = _facts(spark, sf).selectExpr("repo_id", *[f"{e} AS {n}" for n, e in _RECO.items()], f"{_READY} AS readiness")
    return fd.top_recommendations(f)


_BLK = {"has_license": "null_safety % 2 = 0", "secrets": "secrets", "bugs": "loose_equality % 3", "mixed_files": "null_safety % 3", "vibe_recommendations": "memory_leak", "unbuilt_features": "console_left",
        "vibe_score": "overall_score", "has_ci": "null_safety % 5 > 1", "has_dockerfile": "null_safety % 7 > 2"}
_BLK_ROWS = " UNION ALL ".join(f"SELECT repo_id, {p} AS priority, {i} AS ord, {lit(n)} AS blocker, {lit(k)} AS kind, {lit(e)} AS effort FROM b WHERE {c}" for i, (p, n, c, k, e) in enumerate(fd.BLOCKERS))


@query("t6_blocker_plan", f"""WITH {_FACTS}, b AS (SELECT repo_id, {', '.join(f'{e} AS {n}' for n, e in _BLK.items())} FROM facts), x AS ({_BLK_ROWS})
SELECT b.repo_id, coalesce(string_agg(blocker, ',' ORDER BY priority, ord), '') AS blockers, arg_min(blocker, priority * 100 + ord) AS top_priority,
 arg_min(blocker, priority * 100 + ord) FILTER (WHERE effort IN ('minutes', 'hours')) AS quickest_win,
 arg_min(blocker, priority * 100 + ord) FILTER (WHERE kind IN ('safety-risk', 'deploy-blocker')) AS biggest_risk FROM b LEFT JOIN x ON b.repo_id = x.repo_id GROUP BY 1""")
def t6(spark, sf):
    f = _facts(spark, sf).selectExpr("repo_id", *[f"{e} AS {n}" for n, e in _BLK.items()])
    return fd.blocker_plan(f).withColumn("blockers", F.array_join("blockers", ","))


_SUG = {"security_issues": "secrets", "ai_patterns": "null_safety % 10", "has_tests": "null_safety % 3 > 0", "has_license": "null_safety % 2 = 0", "error_handling_gaps": "unhandled_rejection"}


@query("a46_suggest_rules", f"WITH {_FACTS}, a AS (SELECT repo_id, {', '.join(f'{e} AS {n}' for n, e in _SUG.items())} FROM facts) "
       + " UNION ALL ".join(f"SELECT repo_id, {i} AS rule_no, {lit(r)} AS rule, {lit(s)} AS severity, CAST({c} AS DOUBLE) AS confidence FROM a WHERE {cond}" for i, (r, s, c, cond) in enumerate(fd.RULE_SUGGESTIONS)))
def a46(spark, sf):
    return fd.suggest_rules(_facts(spark, sf).selectExpr("repo_id", *[f"{e} AS {n}" for n, e in _SUG.items()]))


@query("a41_quality_gate", f"""WITH {_FACTS} SELECT repo_id, overall_score AS vibe_index, secrets, null_safety % 3 AS test_files,
 concat_ws(',', CASE WHEN overall_score > 40 THEN 'vibe' END, CASE WHEN secrets > 0 THEN 'secrets' END, CASE WHEN null_safety % 3 = 0 THEN 'tests' END) AS failures,
 NOT (overall_score > 40 OR secrets > 0 OR null_safety % 3 = 0) AS passed FROM facts""")
def a41(spark, sf):
    a = _facts(spark, sf).selectExpr("repo_id", "overall_score AS vibe_index", "secrets", "null_safety % 3 AS test_files")
    return fd.quality_gate(a).withColumn("failures", F.array_join("failures", ","))


@query("a45_feedback_summary", "SELECT rule, count(*) AS total, count(*) FILTER (WHERE accepted) AS accepted, count(*) FILTER (WHERE NOT accepted) AS rejected FROM (SELECT 'r' || CAST(user_id % 7 AS VARCHAR) AS rule, value > 50 AS accepted FROM events) GROUP BY ROLLUP (rule)")
def a45(spark, sf):
    e = dt.table(spark, sf, "events")
    return fd.feedback_summary(e.select(F.concat(F.lit("r"), (F.col("user_id") % 7).cast("string")).alias("rule"), (F.col("value") > 50).alias("accepted")))


_EV = "CASE WHEN confidence IS NOT NULL THEN (CASE WHEN confidence >= 70 THEN 'verified' ELSE 'inferred' END) WHEN coalesce(path, '') <> '' AND coalesce(action, '') <> '' THEN 'verified' WHEN severity = 'critical' AND coalesce(path, '') = '' THEN 'inferred' WHEN coalesce(description, '') = '' THEN 'human-needed' ELSE 'inferred' END"


@query("p35_evidence_counts", f"""WITH {dt.FINDINGS}, q AS (SELECT repo_id, CASE WHEN line % 3 = 0 THEN path END AS path, severity, CASE WHEN line % 2 = 0 THEN rule END AS action,
 CASE WHEN line > 2 THEN detail END AS description, CASE WHEN line = 7 THEN confidence * 100 END AS confidence FROM findings), l AS (SELECT repo_id, {_EV} AS lv FROM q)
SELECT repo_id, count(*) FILTER (WHERE lv = 'verified') AS verified, count(*) FILTER (WHERE lv = 'inferred') AS inferred, count(*) FILTER (WHERE lv = 'missing-proof') AS missing_proof, count(*) FILTER (WHERE lv = 'human-needed') AS human_needed FROM l GROUP BY 1""")
def p35(spark, sf):
    q = dt.findings(spark, sf).selectExpr(
        "repo_id", "CASE WHEN line % 3 = 0 THEN path END AS path", "severity", "CASE WHEN line % 2 = 0 THEN rule END AS action",
        "CASE WHEN line > 2 THEN detail END AS description", "CASE WHEN line = 7 THEN confidence * 100 END AS confidence")
    return fd.evidence_counts(fd.label_evidence(q))


_WINS = """wins AS (SELECT 'q' || CAST(o_custkey % 50 AS VARCHAR) AS repo_id, o_orderkey AS win_no, CASE CAST(left(o_orderpriority, 1) AS INTEGER) WHEN 1 THEN 'critical' WHEN 2 THEN 'high' WHEN 3 THEN 'medium' WHEN 4 THEN 'low' ELSE 'info' END AS severity,
 CASE WHEN o_orderkey % 2 = 0 THEN 'Security' ELSE 'Quality' END AS category, 'task ' || CAST(o_orderkey AS VARCHAR) AS title, CASE WHEN o_orderkey % 3 = 0 THEN 'minutes' ELSE 'days' END AS effort FROM orders)"""


@query("w11_roadmap", f"""WITH {_WINS}, p AS (SELECT *, CASE WHEN severity IN ('critical', 'high') THEN 'now' WHEN severity = 'medium' THEN 'next' WHEN severity = 'low' THEN 'later' END AS phase FROM wins),
s AS (SELECT 'q' || CAST(i AS VARCHAR) AS repo_id, CASE WHEN i * 2 < 50 THEN 'now' WHEN i * 2 < 70 THEN 'next' END AS phase FROM range(50) t(i)),
c AS (SELECT repo_id, phase, count(*) AS n FROM p WHERE phase IS NOT NULL GROUP BY 1, 2)
SELECT repo_id, phase, row_number() OVER (PARTITION BY repo_id, phase ORDER BY win_no) AS priority, category, title AS task, CASE WHEN effort = 'minutes' THEN 'hours' ELSE effort END AS effort FROM p WHERE phase IS NOT NULL
UNION ALL SELECT s.repo_id, s.phase, coalesce(n, 0) + 1, CASE WHEN s.phase = 'now' THEN 'Architecture' ELSE 'Testing' END, CASE WHEN s.phase = 'now' THEN 'fix critical structure first' ELSE 'add tests for core modules' END, 'days'
FROM s LEFT JOIN c ON s.repo_id = c.repo_id AND s.phase = c.phase WHERE s.phase IS NOT NULL""")
def w11(spark, sf):
    oo = dt.table(spark, sf, "orders")
    wins = oo.selectExpr(
        "concat('q', cast(o_custkey % 50 as string)) AS repo_id", "o_orderkey AS win_no",
        "CASE cast(left(o_orderpriority, 1) as int) WHEN 1 THEN 'critical' WHEN 2 THEN 'high' WHEN 3 THEN 'medium' WHEN 4 THEN 'low' ELSE 'info' END AS severity",
        "CASE WHEN o_orderkey % 2 = 0 THEN 'Security' ELSE 'Quality' END AS category", "concat('task ', cast(o_orderkey as string)) AS title",
        "CASE WHEN o_orderkey % 3 = 0 THEN 'minutes' ELSE 'days' END AS effort")
    scores = oo.selectExpr("o_custkey % 50 AS i").distinct().selectExpr("concat('q', cast(i as string)) AS repo_id", "i * 2 AS overall_score")
    return fd.roadmap(wins, scores)


# --- history ---------------------------------------------------------------------------------------------

_DONE = f"{dt.SCANS}, done AS (SELECT * FROM scans WHERE status = 'complete')"


@query("w1_latest_scan", f"WITH {dt.SCANS} SELECT scan_id, repo_url, overall_score, grade, status FROM scans QUALIFY row_number() OVER (PARTITION BY repo_url ORDER BY created_at DESC, scan_id DESC) = 1")
def w1(spark, sf):
    return hs.latest_scan(dt.scans(spark, sf)).select("scan_id", "repo_url", "overall_score", "grade", "status")


@query("w2_score_trend", f"""WITH {_DONE}, p AS (SELECT scan_id, overall_score, lag(overall_score) OVER w AS previous_score, lag(scan_id) OVER w AS previous_scan_id FROM done WINDOW w AS (PARTITION BY repo_url ORDER BY created_at, scan_id))
SELECT *, overall_score - previous_score AS delta, CASE WHEN overall_score > previous_score THEN 'up' WHEN overall_score < previous_score THEN 'down' WHEN overall_score = previous_score THEN 'same' END AS direction FROM p""")
def w2(spark, sf):
    return hs.score_trend(dt.scans(spark, sf)).select("scan_id", "overall_score", "previous_score", "previous_scan_id", "delta", "direction")


@query("w2_score_trend_newest_other", f"""WITH {_DONE}, r AS (SELECT repo_url, scan_id, overall_score, row_number() OVER (PARTITION BY repo_url ORDER BY created_at DESC, scan_id DESC) AS rn FROM done),
p AS (SELECT d.scan_id, d.overall_score, r.overall_score AS previous_score, r.scan_id AS previous_scan_id FROM done d LEFT JOIN r ON d.repo_url = r.repo_url AND r.scan_id <> d.scan_id AND r.rn <= 2 QUALIFY row_number() OVER (PARTITION BY d.scan_id ORDER BY r.rn) = 1)
SELECT *, overall_score - previous_score AS delta, CASE WHEN overall_score > previous_score THEN 'up' WHEN overall_score < previous_score THEN 'down' WHEN overall_score = previous_score THEN 'same' END AS direction FROM p""")
def w2b(spark, sf):
    return hs.score_trend(dt.scans(spark, sf), "newest_other").select("scan_id", "overall_score", "previous_score", "previous_scan_id", "delta", "direction")


@query("w3_score_band_trend", f"""WITH {_DONE}, p AS (SELECT scan_id, coalesce(overall_score - lag(overall_score) OVER (PARTITION BY repo_url ORDER BY created_at, scan_id), 0) AS score_change FROM done)
SELECT scan_id, score_change, CASE WHEN score_change > 2 THEN 'improving' WHEN score_change < -2 THEN 'degrading' ELSE 'stable' END AS trend FROM p""")
def w3(spark, sf):
    return hs.score_band_trend(dt.scans(spark, sf)).select("scan_id", "score_change", "trend")


def _vibe_sql(most: str = "") -> str:
    return f"""WITH {_DONE}, h AS (SELECT * FROM done{most}),
a AS (SELECT repo_url, arg_min(vibe_score, created_at) AS first_vibe, arg_max(vibe_score, created_at) AS current_vibe, count(*) AS scans FROM h GROUP BY 1)
SELECT *, CASE WHEN scans < 2 THEN 'insufficient-data' WHEN current_vibe - first_vibe > 5 THEN 'rising' WHEN current_vibe - first_vibe < -5 THEN 'falling' ELSE 'stable' END AS trend FROM a"""


@query("w4_vibe_history", _vibe_sql())
def w4(spark, sf):
    return hs.vibe_history(dt.scans(spark, sf))


@query("w4_vibe_history_latest", _vibe_sql(" QUALIFY row_number() OVER (PARTITION BY repo_url ORDER BY created_at DESC, scan_id DESC) <= 20"))
def w4b(spark, sf):
    return hs.vibe_history(dt.scans(spark, sf), limit=20, keep="latest")


@query("w5_scan_timeseries", f"""WITH {_DONE}, t AS (SELECT * FROM done)
SELECT repo_url, scan_id, created_at, overall_score, grade, vibe_score, CAST(row_number() OVER (PARTITION BY repo_url ORDER BY created_at, scan_id) AS INTEGER) AS position FROM t""")
def w5(spark, sf):
    return hs.scan_timeseries(dt.scans(spark, sf))


@query("w5_scan_timeseries_latest", f"""WITH {_DONE}, t AS (SELECT * FROM done QUALIFY row_number() OVER (PARTITION BY repo_url ORDER BY created_at DESC, scan_id DESC) <= 30)
SELECT repo_url, scan_id, created_at, overall_score, grade, vibe_score, CAST(row_number() OVER (PARTITION BY repo_url ORDER BY created_at, scan_id) AS INTEGER) AS position FROM t""")
def w5b(spark, sf):
    return hs.scan_timeseries(dt.scans(spark, sf), 30, "latest")


def scans_with_report(spark, sf):
    """Scans plus drift status, security score and dimension scores derived from the event."""
    k = F.get_json_object("props", "$.k").cast("int")
    s = dt.scans(spark, sf).withColumn("k", k)
    return (
        s.withColumn("drift_status", F.element_at(F.lit(list(hs.DRIFT)), F.col("k") % 4 + 1))
        .withColumn("security_score", F.col("k"))
        .withColumn("dimension_scores", F.when(F.col("k") % 2 == 0, F.create_map(F.lit("security"), F.col("k"), F.lit("quality"), F.col("overall_score"))).otherwise(F.create_map(F.lit("security"), F.col("k"), F.lit("vibe"), F.col("vibe_score"))))
    )


_REPORT = dt.SCANS + """, rep AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
  list_extract(['on-scope', 'at-risk', 'drifting', 'blocked'], CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 + 1) AS drift_status FROM scans),
lat AS (SELECT * FROM rep WHERE status = 'complete' QUALIFY row_number() OVER (PARTITION BY repo_url ORDER BY created_at DESC, scan_id DESC) = 1)"""


@query("a30_org_summary", f"""WITH {_REPORT} SELECT org_id, count(*) AS repos, CAST(floor(avg(overall_score) + 0.5) AS BIGINT) AS avg_score,
 {', '.join(f"count(*) FILTER (WHERE grade = '{g}') AS grade_{g.replace('+', '_plus').lower()}" for g in hs.GRADES)},
 {', '.join(f"count(*) FILTER (WHERE drift_status = '{d}') AS drift_{d.replace('-', '_')}" for d in hs.DRIFT)} FROM lat GROUP BY 1""")
def a30(spark, sf):
    return hs.org_summary(scans_with_report(spark, sf))


@query("a31_health_trend", f"""WITH {_DONE} SELECT org_id, CAST(created_at AS DATE) AS day, count(*) AS scans, CAST(floor(avg(overall_score) + 0.5) AS BIGINT) AS avg_score,
 list_extract(list(overall_score ORDER BY overall_score), CAST(floor(count(*) / 2) AS INTEGER) + 1) AS median_score,
 {', '.join(f"count(*) FILTER (WHERE grade = '{g}') AS grade_{g.replace('+', '_plus').lower()}" for g in hs.GRADES)} FROM done GROUP BY 1, 2""")
def a31(spark, sf):
    return hs.health_trend(dt.scans(spark, sf))


@query("t3_risk_hotspots", f"""WITH {_REPORT} SELECT repo_url, scan_id, overall_score, drift_status, greatest(0.0, least(100.0, 100 - (k + overall_score) / 2 + CASE drift_status WHEN 'drifting' THEN 30 WHEN 'at-risk' THEN 15 ELSE 0 END)) AS risk_score
FROM lat ORDER BY risk_score DESC, repo_url LIMIT 10""")
def t3(spark, sf):
    return hs.risk_hotspots(scans_with_report(spark, sf), 10)


@query("t7_recent_scans", f"WITH {dt.SCANS} SELECT user_id, scan_id, status FROM scans QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, scan_id DESC) <= 50")
def t7(spark, sf):
    return hs.recent(dt.scans(spark, sf), [F.desc("created_at"), F.desc("scan_id")], 50, ["user_id"]).select("user_id", "scan_id", "status")


@query("t7_recent_overall", f"WITH {dt.SCANS} SELECT scan_id, repo_url, status FROM scans ORDER BY created_at DESC, scan_id DESC LIMIT 50")
def t7b(spark, sf):
    return hs.recent(dt.scans(spark, sf), [F.desc("created_at"), F.desc("scan_id")], 50).select("scan_id", "repo_url", "status")


@query("a43_quota_usage", f"""WITH {dt.SCANS}, u AS (SELECT DISTINCT user_id, CASE user_id % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'pro' ELSE 'enterprise' END AS tier FROM scans),
n AS (SELECT user_id, count(*) AS used FROM scans WHERE created_at >= TIMESTAMP '2024-01-01' AND created_at <= TIMESTAMP '2024-01-20' GROUP BY 1)
SELECT u.user_id, tier, coalesce(used, 0) AS used, CASE tier WHEN 'free' THEN 3 WHEN 'pro' THEN 150 ELSE -1 END AS plan_limit,
 CASE tier WHEN 'free' THEN coalesce(used, 0) >= 3 WHEN 'pro' THEN coalesce(used, 0) >= 150 ELSE FALSE END AS exceeded FROM u LEFT JOIN n ON u.user_id = n.user_id""")
def a43(spark, sf):
    s = dt.scans(spark, sf)
    users = s.select("user_id").distinct().withColumn("tier", F.element_at(F.lit(["free", "pro", "enterprise"]), (F.col("user_id") % 3 + 1).cast("int")))
    return hs.quota_usage(s, users, F.lit("2024-01-20").cast("timestamp"))


@query("j20_compare_scans", f"""WITH {_REPORT}, dims AS (SELECT scan_id, overall_score, 'security' AS dimension, k AS v FROM rep UNION ALL SELECT scan_id, overall_score, CASE WHEN k % 2 = 0 THEN 'quality' ELSE 'vibe' END, CASE WHEN k % 2 = 0 THEN overall_score ELSE vibe_score END FROM rep),
pairs AS (SELECT event_id AS first_id, event_id + 1 AS second_id FROM events WHERE event_id + 1 IN (SELECT event_id FROM events))
SELECT first_id, second_id, s.overall_score - a.overall_score AS overall_delta, a.dimension, coalesce(b.v, 0) - a.v AS dimension_delta
FROM pairs JOIN dims a ON a.scan_id = first_id JOIN (SELECT DISTINCT scan_id, overall_score FROM rep) s ON s.scan_id = second_id LEFT JOIN dims b ON b.scan_id = second_id AND b.dimension = a.dimension""")
def j20(spark, sf):
    s = scans_with_report(spark, sf)
    return hs.compare_scans(s, s.select(F.col("scan_id").alias("first_id"), (F.col("scan_id") + 1).alias("second_id")))


def _milestones(spark, sf):
    c = dt.table(spark, sf, "orders")
    return c.selectExpr("o_orderkey AS milestone_id", "o_custkey % 150 AS user_id", "concat('https://host.example/o', cast(o_custkey % 150 % 5 as string), '/r', cast(o_custkey % 150 as string)) AS repo_url",
                        "CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 5000 END AS scan_id")


_MILE = """mile AS (SELECT o_orderkey AS milestone_id, o_custkey % 150 AS user_id, 'https://host.example/o' || CAST(o_custkey % 150 % 5 AS VARCHAR) || '/r' || CAST(o_custkey % 150 AS VARCHAR) AS repo_url,
  CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 5000 END AS scan_id FROM orders)"""


@query("j24_promote", f"""WITH {_DONE}, {_MILE}, l AS (SELECT user_id, repo_url, arg_max(scan_id, created_at) AS latest FROM done GROUP BY 1, 2)
SELECT milestone_id, mile.user_id, mile.repo_url, coalesce(scan_id, latest) AS scan_id FROM mile LEFT JOIN l ON l.user_id = mile.user_id AND l.repo_url = mile.repo_url""")
def j24(spark, sf):
    return hs.promote(_milestones(spark, sf), dt.scans(spark, sf)).select("milestone_id", "user_id", "repo_url", "scan_id")


@query("j21_compare_milestones", f"""WITH {_REPORT}, {_MILE}, pr AS (SELECT milestone_id AS first_milestone, milestone_id + 1 AS second_milestone FROM mile),
l AS (SELECT pr.*, a.scan_id AS first_id, b.scan_id AS second_id FROM pr JOIN mile a ON a.milestone_id = first_milestone JOIN mile b ON b.milestone_id = second_milestone WHERE a.scan_id IS NOT NULL AND b.scan_id IS NOT NULL),
dims AS (SELECT scan_id, 'security' AS dimension, k AS v FROM rep UNION ALL SELECT scan_id, CASE WHEN k % 2 = 0 THEN 'quality' ELSE 'vibe' END, CASE WHEN k % 2 = 0 THEN overall_score ELSE vibe_score END FROM rep)
SELECT first_milestone, second_milestone, s2.overall_score - s1.overall_score AS overall_delta, a.dimension, coalesce(b.v, 0) - a.v AS dimension_delta
FROM l JOIN rep s1 ON s1.scan_id = first_id JOIN rep s2 ON s2.scan_id = second_id JOIN dims a ON a.scan_id = first_id LEFT JOIN dims b ON b.scan_id = second_id AND b.dimension = a.dimension""")
def j21(spark, sf):
    m = _milestones(spark, sf)
    pairs = m.select(F.col("milestone_id").alias("first_milestone"), (F.col("milestone_id") + 1).alias("second_milestone"))
    return hs.compare_milestones(pairs, m, scans_with_report(spark, sf)).select("first_milestone", "second_milestone", "overall_delta", "dimension", "dimension_delta")


@query("j31_visible_scans", f"WITH {dt.SCANS} SELECT scan_id, org_id, user_id FROM scans WHERE user_id = 7 OR org_id IN (SELECT r_regionkey FROM region WHERE r_regionkey IN (1, 3))")
def j31(spark, sf):
    members = dt.table(spark, sf, "region").filter("r_regionkey IN (1, 3)").select(F.col("r_regionkey").cast("long").alias("org_id"), F.lit(7).alias("user_id"))
    return hs.visible_scans(dt.scans(spark, sf), members, 7).select("scan_id", "org_id", "user_id")


_BRIEF_SCANS = """bs AS (SELECT user_id % 40 AS brief_id, scan_id, created_at, status, CASE WHEN k % 5 > 0 THEN list_transform(range(1, k % 5 + 1), lambda i: 'd' || CAST(i AS VARCHAR)) END AS implemented FROM rep),
br AS (SELECT i AS brief_id, list_transform(range(1, i % 6 + 1), lambda x: 'd' || CAST(x AS VARCHAR)) AS deliverables FROM range(40) t(i))"""


def _brief_scans(spark, sf):
    s = scans_with_report(spark, sf)
    return s.selectExpr("user_id % 40 AS brief_id", "scan_id", "created_at", "status",
                        "CASE WHEN k % 5 > 0 THEN transform(sequence(1, k % 5), i -> concat('d', cast(i as string))) END AS implemented")


def _briefs(spark, sf):
    ids = dt.table(spark, sf, "events").selectExpr("user_id % 40 AS brief_id").distinct()
    return ids.selectExpr("brief_id", "CASE WHEN brief_id % 6 = 0 THEN cast(array() as array<string>) ELSE transform(sequence(1, cast(brief_id % 6 as int)), i -> concat('d', cast(i as string))) END AS deliverables")


@query("a40_scope_compliance", f"""WITH {_REPORT}, {_BRIEF_SCANS} SELECT bs.brief_id, scan_id, created_at, CAST(len(deliverables) AS INTEGER) AS planned, CAST(coalesce(len(implemented), 0) AS INTEGER) AS implemented,
 CAST(CASE WHEN len(deliverables) > 0 THEN floor(coalesce(len(implemented), 0) / len(deliverables) * 100 + 0.5) ELSE 0 END AS INTEGER) AS compliance_percent FROM bs JOIN br ON bs.brief_id = br.brief_id WHERE status = 'complete'""")
def a40(spark, sf):
    return hs.scope_compliance(_briefs(spark, sf), _brief_scans(spark, sf))


@query("a40_current_compliance", f"""WITH {_REPORT}, {_BRIEF_SCANS} SELECT bs.brief_id, scan_id, created_at, CAST(len(deliverables) AS INTEGER) AS planned, CAST(coalesce(len(implemented), 0) AS INTEGER) AS implemented,
 CAST(CASE WHEN len(deliverables) > 0 THEN floor(coalesce(len(implemented), 0) / len(deliverables) * 100 + 0.5) ELSE 0 END AS INTEGER) AS compliance_percent FROM bs JOIN br ON bs.brief_id = br.brief_id WHERE status = 'complete'
 QUALIFY row_number() OVER (PARTITION BY bs.brief_id ORDER BY created_at DESC, scan_id DESC) = 1""")
def a40b(spark, sf):
    return hs.current_compliance(hs.scope_compliance(_briefs(spark, sf), _brief_scans(spark, sf)))


@query("w10_approval_versions", "SELECT o_custkey AS brief_id, o_orderkey AS approval_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM orders")
def w10(spark, sf):
    a = dt.table(spark, sf, "orders").selectExpr("o_custkey AS brief_id", "o_orderkey AS approval_id", "o_orderdate AS approved_at")
    return hs.approval_versions(a).select("brief_id", "approval_id", "version")


@query("a42_brief_overview", """WITH a AS (SELECT o_custkey AS brief_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest_approval, count(*) AS approvals FROM orders GROUP BY 1),
m AS (SELECT o_custkey AS brief_id, count(*) AS milestones FROM orders GROUP BY 1), s AS (SELECT user_id AS brief_id, count(*) AS scans FROM events GROUP BY 1)
SELECT c_custkey AS brief_id, c_name AS name, latest_approval, coalesce(approvals, 0) AS approvals, coalesce(milestones, 0) AS milestones, coalesce(scans, 0) AS scans
FROM customer LEFT JOIN a ON a.brief_id = c_custkey LEFT JOIN m ON m.brief_id = c_custkey LEFT JOIN s ON s.brief_id = c_custkey""")
def a42(spark, sf):
    oo = dt.table(spark, sf, "orders")
    return hs.brief_overview(
        dt.table(spark, sf, "customer").selectExpr("c_custkey AS brief_id", "c_name AS name"),
        oo.selectExpr("o_custkey AS brief_id", "o_orderkey AS approval_id", "o_orderdate AS approved_at"),
        oo.selectExpr("o_custkey AS brief_id"),
        dt.table(spark, sf, "events").selectExpr("user_id AS brief_id"))


_LISTS = ("CASE c_custkey % 4 WHEN 0 THEN '[\"a\"]' WHEN 1 THEN '[]' WHEN 2 THEN '[\"x\",\"y\"]' ELSE 'not json' END", "CASE WHEN c_custkey % 3 = 0 THEN '[]' ELSE '[\"no\"]' END", "CASE WHEN c_custkey % 5 = 0 THEN 'null' ELSE '[\"ok\"]' END")


@query("a47_brief_readiness", f"""WITH b AS (SELECT c_custkey AS brief_id, {_LISTS[0]} AS d, {_LISTS[1]} AS e, {_LISTS[2]} AS c FROM customer)
SELECT brief_id, concat_ws(',', CASE WHEN d = 'not json' THEN 'deliverables: not a list' WHEN d = '[]' THEN 'deliverables: empty' END, CASE WHEN e = '[]' THEN 'exclusions: empty' END,
 CASE WHEN c = 'null' THEN 'acceptance_criteria: not a list' END) AS reasons, d NOT IN ('not json', '[]') AND e <> '[]' AND c <> 'null' AS ready FROM b""")
def a47(spark, sf):
    b = dt.table(spark, sf, "customer").selectExpr("c_custkey AS brief_id", f"{_LISTS[0]} AS deliverables", f"{_LISTS[1]} AS exclusions", f"{_LISTS[2]} AS acceptance_criteria")
    return hs.brief_readiness(b).select("brief_id", F.array_join("reasons", ",").alias("reasons"), "ready")


@query("a48_apply_changes", """WITH l AS (SELECT o_custkey AS brief_id, arg_max(CASE WHEN o_orderkey % 2 = 0 THEN 'g' || CAST(o_orderkey AS VARCHAR) ELSE '' END, (o_orderdate, o_orderkey)) AS goal,
   arg_max(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'n' || CAST(o_orderkey AS VARCHAR) END, (o_orderdate, o_orderkey)) AS name FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT c_custkey AS brief_id, coalesce(nullif(l.name, ''), c_name) AS name, coalesce(nullif(l.goal, ''), c_mktsegment) AS goal FROM customer LEFT JOIN l ON l.brief_id = c_custkey""")
def a48(spark, sf):
    ch = dt.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS change_id", "o_custkey AS brief_id", "CASE WHEN o_orderstatus = 'F' THEN 'approved' ELSE 'pending' END AS status", "o_orderdate AS approved_at",
        "CASE WHEN o_orderkey % 2 = 0 THEN concat('g', cast(o_orderkey as string)) END AS goal", "CASE WHEN o_orderkey % 3 > 0 THEN concat('n', cast(o_orderkey as string)) END AS name")
    return hs.apply_changes(dt.table(spark, sf, "customer").selectExpr("c_custkey AS brief_id", "c_name AS name", "c_mktsegment AS goal"), ch)


# --- delta ------------------------------------------------------------------------------------------------

def _state(spark, sf):
    """Last snapshot: every 5th document missing, every 7th with another text, some paths gone since."""
    d = dt.table(spark, sf, "documents").filter("doc_id % 5 > 0")
    old = d.selectExpr("source AS repo_id", "concat(lang, '/', cast(doc_id as string)) AS path", "sha2(CASE WHEN doc_id % 7 = 0 THEN concat(text, 'x') ELSE text END, 256) AS content_hash")
    gone = d.filter("doc_id % 11 = 0").selectExpr("source AS repo_id", "concat('old/', cast(doc_id as string)) AS path", "sha2(text, 256) AS content_hash")
    return old.unionByName(gone)


_DELTA = dt.DOC_FILES + """, st AS (SELECT source AS repo_id, lang || '/' || CAST(doc_id AS VARCHAR) AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END) AS h FROM documents WHERE doc_id % 5 > 0
  UNION ALL SELECT source, 'old/' || CAST(doc_id AS VARCHAR), sha256(text) FROM documents WHERE doc_id % 5 > 0 AND doc_id % 11 = 0),
vcs AS (SELECT source AS repo_id, lang || '/' || CAST(doc_id AS VARCHAR) AS path FROM documents WHERE doc_id % 13 = 0),
d AS (SELECT coalesce(f.repo_id, s.repo_id) AS repo_id, coalesce(f.path, s.path) AS path, CASE WHEN f.path IS NULL THEN 'deleted' WHEN s.path IS NULL THEN 'new' WHEN s.h <> sha256(f.content) THEN 'changed' WHEN v.path IS NOT NULL THEN 'changed' ELSE 'unchanged' END AS status
  FROM doc_files f FULL OUTER JOIN st s ON s.repo_id = f.repo_id AND s.path = f.path LEFT JOIN vcs v ON v.repo_id = f.repo_id AND v.path = f.path)"""


def _vcs(spark, sf):
    return dt.table(spark, sf, "documents").filter("doc_id % 13 = 0").selectExpr("source AS repo_id", "concat(lang, '/', cast(doc_id as string)) AS path")


@query("j17_delta", f"WITH {_DELTA} SELECT * FROM d")
def j17(spark, sf):
    return dl.delta(dt.doc_files(spark, sf), _state(spark, sf), _vcs(spark, sf)).select("repo_id", "path", "status")


@query("j17_delta_summary", f"""WITH {_DELTA}, n AS (SELECT repo_id, count(*) FILTER (WHERE status = 'new') AS "new", count(*) FILTER (WHERE status = 'changed') AS changed, count(*) FILTER (WHERE status = 'unchanged') AS unchanged, count(*) FILTER (WHERE status = 'deleted') AS deleted FROM d GROUP BY 1)
SELECT *, unchanged / ("new" + changed + unchanged) AS hit_rate FROM n""")
def j17b(spark, sf):
    return dl.delta_summary(dl.delta(dt.doc_files(spark, sf), _state(spark, sf), _vcs(spark, sf)))


@query("j18_incremental_scan", f"""WITH {dt.DOC_LINES}, {_DELTA.split(', st AS')[1].join(['st AS', '']) if False else _DELTA.replace(dt.DOC_FILES + ', ', '')}, h AS ({o.line_hits(PROSE_RULES, 'doc_lines')})
SELECT h.repo_id, h.path, line, rule, severity FROM h JOIN d ON d.repo_id = h.repo_id AND d.path = h.path WHERE status IN ('new', 'changed')
UNION ALL SELECT repo_id, path, 1, 'kept', 'low' FROM d WHERE status = 'unchanged'""")
def j18(spark, sf):
    st = _state(spark, sf)
    old = st.select("repo_id", "path", F.lit(1).alias("line"), F.lit("kept").alias("rule"), F.lit("low").alias("severity"))
    found, _ = dl.incremental_scan(dt.doc_files(spark, sf), st, old, lambda f: matching.match_lines(f, PROSE_RULES), _vcs(spark, sf))
    return found.select("repo_id", "path", "line", "rule", "severity")


@query("j19_restrict_to_diff", f"WITH {dt.DOC_FILES} SELECT f.repo_id, f.path, length(content) AS n FROM doc_files f JOIN (SELECT source AS repo_id, lang || '/' || CAST(doc_id AS VARCHAR) AS path FROM documents WHERE doc_id % 13 = 0) v ON v.repo_id = f.repo_id AND v.path = f.path")
def j19(spark, sf):
    return dl.restrict_to_diff(dt.doc_files(spark, sf), _vcs(spark, sf)).select("repo_id", "path", F.length("content").cast("long").alias("n"))


@query("f4_duplicate_contents", f"WITH {dt.DOC_FILES} SELECT sha256(content) AS content_hash, count(*) AS copies, min(path) AS first_path FROM doc_files GROUP BY 1 HAVING count(*) > 1")
def f4(spark, sf):
    return dl.duplicate_contents(dt.doc_files(spark, sf))


@query("u6_append_versions", """WITH n AS (SELECT DISTINCT 'u' || CAST(doc_id % 20 AS VARCHAR) AS user_id, source AS repo_url, sha256(text) AS content_hash, CASE WHEN length(text) > 10000 THEN 'content-too-long' END AS reason FROM documents),
e AS (SELECT 'u' || CAST(doc_id % 20 AS VARCHAR) AS user_id, source AS repo_url, sha256(text) AS content_hash FROM documents WHERE doc_id % 4 = 0)
SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.user_id = n.user_id AND e.repo_url = n.repo_url AND e.content_hash = n.content_hash)""")
def u6(spark, sf):
    d = dt.table(spark, sf, "documents").selectExpr("doc_id", "concat('u', cast(doc_id % 20 as string)) AS user_id", "source AS repo_url", "text AS content")
    existing = d.filter("doc_id % 4 = 0").withColumn("content_hash", tx.content_hash("content"))
    return dl.append_versions(d, existing, 10_000).select("user_id", "repo_url", "content_hash", "reason")


@query("p40_validate_upload", """WITH u AS (SELECT 'up' || CAST(o_custkey % 200 AS VARCHAR) AS upload_id, o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '../etc' WHEN 1 THEN '/abs/x' WHEN 2 THEN 'C:\\x' WHEN 3 THEN 'a' || chr(7) || 'b' WHEN 4 THEN repeat('p', 501) ELSE 'src/ok.ts' END AS path,
  CASE WHEN o_orderkey % 17 = 0 THEN repeat('z', 500001) ELSE 'c' END AS content FROM orders), s AS (SELECT upload_id, count(*) AS n FROM u GROUP BY 1)
SELECT u.upload_id, o_orderkey AS file_no, CASE WHEN n > 90 THEN 'too-many-files' WHEN length(path) > 500 THEN 'path-too-long' WHEN contains(path, '..') THEN 'parent-path' WHEN starts_with(path, '/') OR regexp_matches(path, '^[A-Za-z]:') THEN 'absolute-path'
  WHEN contains(path, chr(7)) THEN 'control-character' WHEN length(content) > 500000 THEN 'content-too-long' END AS reason FROM u JOIN s ON s.upload_id = u.upload_id""")
def p40(spark, sf):
    u = dt.table(spark, sf, "orders").select(
        F.concat(F.lit("up"), (F.col("o_custkey") % 200).cast("string")).alias("upload_id"), F.col("o_orderkey").alias("file_no"),
        F.element_at(F.array(F.lit("../etc"), F.lit("/abs/x"), F.lit("C:\\x"), F.lit("a\x07b"), F.lit("p" * 501), F.lit("src/ok.ts")), (F.col("o_orderkey") % 6 + 1).cast("int")).alias("path"),
        F.when(F.col("o_orderkey") % 17 == 0, F.repeat(F.lit("z"), F.lit(500001))).otherwise("c").alias("content"))
    return dl.validate_upload(u, max_files=90).select("upload_id", "file_no", "reason")


# --- commits -----------------------------------------------------------------------------------------------------

@query("a20_commit_fitness", f"""WITH {dt.COMMITS} SELECT repo_id, sha, authored_at, CAST(greatest(0, least(100, 50 + CASE WHEN message LIKE '%fix%' OR message LIKE '%bug%' THEN 20 ELSE 0 END + CASE WHEN message LIKE '%test%' THEN 15 ELSE 0 END
 + CASE WHEN message LIKE '%refactor%' THEN 15 ELSE 0 END - CASE WHEN message LIKE '%wip%' OR message LIKE '%hack%' THEN 20 ELSE 0 END)) AS INTEGER) AS score FROM commits""")
def a20(spark, sf):
    return cm.commit_fitness(dt.commits(spark, sf))


_OWN = """own AS (SELECT f.repo_id, f.path, min(author_email) AS owner, max(authored_at) AS last_modified FROM commit_files f JOIN c2 c ON c.repo_id = f.repo_id AND c.sha = f.sha GROUP BY 1, 2 HAVING count(DISTINCT author_email) = 1),
bf AS (SELECT *, CAST(floor(epoch(TIMESTAMP '2003-01-01' - last_modified) / 2592000) AS INTEGER) AS months_old FROM own)"""


def _few_commits(spark, sf):
    c = dt.commits(spark, sf)
    return c.withColumn("author_email", F.concat(F.lit("dev"), (F.length("message") % 2).cast("string")))


_C2 = dt.COMMITS + ", c2 AS (SELECT repo_id, sha, authored_at, 'dev' || CAST(length(message) % 2 AS VARCHAR) AS author_email FROM commits)"


@query("a19_bus_factor", f"""WITH {_C2}, {_OWN} SELECT *, CASE WHEN months_old > 6 THEN 'critical' WHEN months_old > 3 THEN 'high' ELSE 'medium' END AS risk FROM bf""")
def a19(spark, sf):
    return cm.bus_factor(_few_commits(spark, sf), dt.commit_files(spark, sf), F.lit("2003-01-01").cast("timestamp"))


@query("a19_bus_score", f"""WITH {_C2}, {_OWN}, t AS (SELECT *, CASE WHEN months_old > 6 THEN 5 WHEN months_old > 3 THEN 3 ELSE 1 END AS p FROM bf)
SELECT r.repo_id, count(t.path) AS single_owner_files, CAST(greatest(0, 100 - coalesce(sum(p), 0)) AS INTEGER) AS score FROM (SELECT DISTINCT repo_id FROM commits) r LEFT JOIN t ON t.repo_id = r.repo_id GROUP BY 1""")
def a19b(spark, sf):
    c = _few_commits(spark, sf)
    return cm.bus_score(cm.bus_factor(c, dt.commit_files(spark, sf), F.lit("2003-01-01").cast("timestamp")), c)


@query("a18_history_insights", f"""WITH {dt.COMMITS}, c AS (SELECT repo_id, count(*) AS commits, count(DISTINCT author_email) AS authors FROM commits GROUP BY 1),
w AS (SELECT repo_id, sha FROM commits QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY authored_at DESC, sha DESC) <= 20),
t AS (SELECT f.repo_id, count(DISTINCT path) AS recently_modified FROM commit_files f JOIN w ON w.repo_id = f.repo_id AND w.sha = f.sha WHERE change_kind = 'M' GROUP BY 1), n AS (SELECT repo_id, count(DISTINCT path) AS files FROM commit_files GROUP BY 1)
SELECT c.repo_id, commits, authors, files, coalesce(recently_modified, 0) AS recently_modified, coalesce(recently_modified, 0) < files * 0.3 AS stale, CASE WHEN coalesce(recently_modified, 0) < files * 0.3 THEN files - coalesce(recently_modified, 0) ELSE 0 END AS stale_files
FROM c JOIN n ON n.repo_id = c.repo_id LEFT JOIN t ON t.repo_id = c.repo_id""")
def a18(spark, sf):
    cf = dt.commit_files(spark, sf)
    return cm.history_insights(dt.commits(spark, sf), cf, cf.select("repo_id", "path"), recent=20)


_MULTI = """w AS (SELECT repo_id, sha FROM commits),
m AS (SELECT DISTINCT f.repo_id, f.sha, f.path FROM commit_files f JOIN w ON w.repo_id = f.repo_id AND w.sha = f.sha),
mm AS (SELECT * FROM m QUALIFY count(*) OVER (PARTITION BY repo_id, sha) >= 2)"""


@query("j15_co_change_counts", f"WITH {dt.COMMITS}, {_MULTI} SELECT repo_id, path, count(*) AS shared_commits FROM mm GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY count(*) DESC, path) <= 20")
def j15(spark, sf):
    return cm.co_change_counts(dt.commits(spark, sf), dt.commit_files(spark, sf), k=20)


@query("j15_co_change_pairs", f"WITH {dt.COMMITS}, {_MULTI} SELECT a.repo_id, a.path AS file_a, b.path AS file_b, count(*) AS shared_commits FROM mm a JOIN mm b ON a.repo_id = b.repo_id AND a.sha = b.sha AND a.path < b.path GROUP BY 1, 2, 3 HAVING count(*) >= 2")
def j15b(spark, sf):
    return cm.co_change(dt.commits(spark, sf), dt.commit_files(spark, sf))


# orders as files and shipping months as commits: commits touch thousands of files, and many files have the same months
_MONTHS = """mf AS (SELECT DISTINCT 'r' || CAST(l_orderkey % 11 AS VARCHAR) AS repo_id, strftime(l_shipdate, '%Y-%m') AS sha, 'f' || CAST(l_orderkey AS VARCHAR) AS path FROM lineitem),
mm AS (SELECT * FROM mf QUALIFY count(*) OVER (PARTITION BY repo_id, sha) >= 2),
sets AS (SELECT repo_id, path, list(sha ORDER BY sha) AS s FROM mm GROUP BY 1, 2),
cls AS (SELECT repo_id, s, min(path) AS class, count(*) AS files FROM sets GROUP BY 1, 2)"""


def _months(spark, sf):
    files = dt.table(spark, sf, "lineitem").select(F.concat(F.lit("r"), (F.col("l_orderkey") % 11).cast("string")).alias("repo_id"), F.date_format("l_shipdate", "yyyy-MM").alias("sha"), F.concat(F.lit("f"), F.col("l_orderkey").cast("string")).alias("path"))
    return files.select("repo_id", "sha").distinct().withColumn("authored_at", F.to_timestamp("sha", "yyyy-MM")), files


@query("j15_co_change_classes", f"""WITH {_MONTHS}, cm AS (SELECT repo_id, class, files, unnest(s) AS sha FROM cls)
SELECT a.repo_id, a.class AS class_a, b.class AS class_b, a.files AS files_a, b.files AS files_b, count(*) AS shared_commits FROM cm a JOIN cm b ON a.repo_id = b.repo_id AND a.sha = b.sha AND (a.class < b.class OR (a.class = b.class AND a.files > 1)) GROUP BY 1, 2, 3, 4, 5 HAVING count(*) >= 2""")
def j15c(spark, sf):
    return cm.co_change_classes(*_months(spark, sf))[0]


@query("j15_change_class_members", f"WITH {_MONTHS} SELECT repo_id, class, path FROM sets JOIN cls USING (repo_id, s)")
def j15d(spark, sf):
    return cm.co_change_members(*_months(spark, sf))
