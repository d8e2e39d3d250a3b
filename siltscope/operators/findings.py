"""Roll-ups, caps, scores and plans over the findings table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltscope.functions import numbers as nm
from siltscope.operators.ordered import first_n

SEVERITIES = ("critical", "high", "medium", "low")


def union_findings(*dfs: DataFrame) -> DataFrame:
    """One findings table out of several sources; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def distinct_values(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()


def _count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def file_scores(findings: DataFrame) -> DataFrame:
    """Risk per file: sum of 30/15/5/1 and number of findings.

    The reasons are the finding rows themselves (see file_reasons); they are not collected into
    arrays because one file may own any share of the table.
    """
    w = nm.severity_weight("severity", "file_risk")
    return findings.groupBy("repo_id", "path").agg(F.sum(w).alias("score"), F.count("*").alias("n_findings"))


def worst_files(scores: DataFrame, k: int | None = None, per_repo: bool = False) -> DataFrame:
    """Highest risk first, only files above zero."""
    live = scores.filter(F.col("score") > 0)
    order = [F.desc("score"), F.asc("repo_id"), F.asc("path")]
    return first_n(live, ["repo_id"], order, k) if per_repo or k is None else live.orderBy(*order).limit(k)


def file_reasons(findings: DataFrame, files: DataFrame, k: int | None = None) -> DataFrame:
    """First ``k`` finding details of the given files, in finding order."""
    keyed = findings.join(files.select("repo_id", "path"), ["repo_id", "path"], "left_semi")
    return first_n(keyed, ["repo_id", "path"], [F.asc("ordinal"), F.asc("line"), F.asc("rule")], k)


def static_score(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """100 minus the sum of 8/4/2/0.5 points (at most 100), for every repository."""
    pen = findings.groupBy("repo_id").agg(F.sum(nm.severity_weight("severity", "static")).alias("penalty"))
    out = repos.select("repo_id").distinct().join(pen, "repo_id", "left").na.fill(0.0, ["penalty"])
    return out.withColumn("score", nm.js_round(100 - F.least(F.col("penalty"), F.lit(100.0))).cast("int"))


def quality_score(findings: DataFrame, phantoms: DataFrame, files: DataFrame, threshold: int = 60) -> DataFrame:
    """100 minus 10/5/2/1 points over sqrt(files), minus phantom import points; pass at the threshold."""
    pen = findings.groupBy("repo_id").agg(F.sum(nm.severity_weight("severity", "verify")).alias("penalty"))
    ph = phantoms.groupBy("repo_id").agg(F.sum(nm.severity_weight("severity", "verify")).alias("phantom_points"))
    n = files.groupBy("repo_id").agg(F.count("*").alias("files"))
    out = n.join(pen, "repo_id", "left").join(ph, "repo_id", "left").na.fill(0, ["penalty", "phantom_points"])
    base = F.greatest(F.lit(0), nm.js_round(100 - F.col("penalty") / F.greatest(F.lit(1.0), F.sqrt("files"))))
    out = out.withColumn("score", F.greatest(F.lit(0), base - F.col("phantom_points")).cast("int"))
    return out.withColumn("passed", F.col("score") >= threshold)


def finding_rollup(findings: DataFrame, by: Sequence[str] = ("repo_id", "severity", "category")) -> DataFrame:
    """Counts for every prefix of ``by``; the totals rows carry nulls."""
    return findings.rollup(*by).agg(F.count("*").alias("n"))


def finding_cube(findings: DataFrame, by: Sequence[str] = ("severity", "category")) -> DataFrame:
    return findings.cube(*by).agg(F.count("*").alias("n"))


def cap_findings(findings: DataFrame, max_per_type: int = 1) -> DataFrame:
    """At most ``max_per_type`` per file, category and type, the most confident first."""
    order = [F.desc("confidence"), F.asc("line"), F.asc("ordinal"), F.asc("detail")]
    return first_n(findings, ["repo_id", "path", "category", "rule"], order, max_per_type)


def best_confidence(findings: DataFrame) -> DataFrame:
    """Most confident finding per (file, type, line); partial aggregation, no window."""
    rest = [c for c in findings.columns if c not in ("repo_id", "path", "rule", "line")]
    best = F.max_by(F.struct(*rest), F.struct(F.col("confidence"), -F.col("ordinal")))
    return findings.groupBy("repo_id", "path", "rule", "line").agg(best.alias("b")).select("repo_id", "path", "rule", "line", "b.*")


# --- debt ----------------------------------------------------------------------------------------

def debt_ratio(findings: DataFrame, lines_per_repo: DataFrame) -> DataFrame:
    """Fix hours (4/2/0.5/0.1) over build hours (50 lines an hour), in percent."""
    agg = findings.groupBy("repo_id").agg(
        # tenths of an hour as integers: the sum does not depend on row order
        F.count("*").alias("fixable"),
        (F.sum((nm.severity_weight("severity", "fix_hours", 0.5) * 10).cast("int")) / 10).alias("fix_hours"),
    )
    out = lines_per_repo.select("repo_id", "lines").join(agg, "repo_id", "left").na.fill(0, ["fixable", "fix_hours"])
    ratio = F.when(F.col("lines") > 0, nm.js_round(F.col("fix_hours") / (F.col("lines") / 50) * 100)).otherwise(0)
    return out.withColumn("debt_ratio", ratio.cast("int"))


def debt_interest(facts: DataFrame) -> DataFrame:
    """Monthly hours and yearly cost of what stays unfixed, one row per repository and issue.

    ``facts`` has one row per repository: null_safety, loose_equality, console_left, missing_timeout,
    memory_leak, unhandled_rejection, secrets (counts) and overall_score.
    """
    c = F.col
    tax = nm.js_round((60 - c("overall_score")) * 0.5)
    items = [
        (c("null_safety") > 0, "null-guards", "Reliability", "high", F.ceil(c("null_safety") / 3) * 6),
        (c("loose_equality") > 0, "loose-equality", "Correctness", "medium", F.ceil(c("loose_equality") / 10) * 4),
        (c("console_left") > 0, "console-output", "Observability", "medium", F.lit(1)),
        (c("missing_timeout") > 0, "missing-timeouts", "Reliability", "high", F.lit(2)),
        (c("memory_leak") > 0, "memory-leaks", "Performance", "high", F.lit(3)),
        (c("unhandled_rejection") > 0, "unhandled-rejections", "Reliability", "critical", F.lit(4)),
        (c("secrets") > 0, "exposed-secrets", "Security", "critical", F.lit(8)),
        (c("overall_score") < 60, "low-quality", "Productivity", "medium", tax),
    ]
    rows = F.array_compact(F.array(*[
        F.when(cond, F.struct(F.lit(i).alias("item_no"), F.lit(name).alias("issue"), F.lit(cat).alias("category"),
                              F.lit(sev).alias("severity"), hours.cast("long").alias("hours_per_month")))
        for i, (cond, name, cat, sev, hours) in enumerate(items)
    ]))
    out = facts.select("repo_id", F.explode(rows).alias("i")).select("repo_id", "i.*")
    return out.withColumn("cost_per_year", F.col("hours_per_month") * 12 * 100)


def top_debt(items: DataFrame, k: int | None = None) -> DataFrame:
    return first_n(items, ["repo_id"], [F.desc("cost_per_year"), F.asc("item_no")], k)


# --- plans ---------------------------------------------------------------------------------------------

# condition names over one row of repository facts, by priority (fixed values)
RECOMMENDATIONS = (
    (1, "refactor-worst-file", "worst_files > 0"),
    (2, "update-critical-dependencies", "critical_dependencies > 0"),
    (3, "fix-deploy-blockers", "deploy_blockers > 0"),
    (4, "restructure-layers", "layer_violations > 0"),
    (5, "split-oversized-files", "xlarge_files > 0"),
    (6, "fix-critical-hygiene", "critical_hygiene > 0"),
    (7, "fix-enterprise-blockers", "enterprise_blockers > 0"),
    (8, "catch-rejections", "unhandled_rejection > 0"),
    (9, "clean-dependencies", "dependency_score < 60"),
    (10, "decompose-god-files", "god_files > 0"),
    (11, "standardize-naming", "naming_mixes > 0"),
    (12, "deploy-blocking", "readiness <> 'ready'"),
)


def _condition_rows(facts: DataFrame, rules: Sequence[tuple], keys: Sequence[str]) -> DataFrame:
    rows = F.array_compact(F.array(*[
        F.when(F.expr(cond), F.struct(F.lit(prio).alias("priority"), F.lit(name).alias("action"))) for prio, name, cond in rules
    ]))
    return facts.select(*keys, rows.alias("_r"))


def top_recommendations(facts: DataFrame, k: int = 10) -> DataFrame:
    """Prioritised actions whose condition holds, first ``k`` per repository (inside the row)."""
    r = _condition_rows(facts, RECOMMENDATIONS, ["repo_id"])
    return r.select("repo_id", F.explode(F.slice("_r", 1, k)).alias("r")).select("repo_id", "r.*")


def roadmap(quick_wins: DataFrame, scores: DataFrame) -> DataFrame:
    """Phase now/next/later by severity, priority counted within a phase in ``win_no`` order.

    A repository below 50 gets one more "now" row, one from 50 to below 70 one more "next" row.
    """
    from siltscope.operators.ordered import row_number_in_key

    phase = F.when(F.col("severity").isin("critical", "high"), "now").when(F.col("severity") == "medium", "next").when(F.col("severity") == "low", "later")
    q = quick_wins.withColumn("phase", phase).filter(F.col("phase").isNotNull())
    numbered = row_number_in_key(q, ["repo_id", "phase"], F.floor(F.col("win_no") / 4096), ["win_no"], "priority")
    effort = F.when(F.col("effort") == "minutes", "hours").otherwise(F.col("effort"))
    rows = numbered.select("repo_id", "phase", "priority", "category", F.col("title").alias("task"), effort.alias("effort"))
    extra = scores.select(
        "repo_id",
        F.when(F.col("overall_score") < 50, "now").when(F.col("overall_score") < 70, "next").alias("phase"),
    ).filter(F.col("phase").isNotNull())
    sizes = q.groupBy("repo_id", "phase").agg(F.count("*").alias("n"))
    now = F.col("phase") == "now"
    closing = extra.join(sizes, ["repo_id", "phase"], "left").select(
        "repo_id",
        "phase",
        (F.coalesce("n", F.lit(0)) + 1).alias("priority"),
        F.when(now, "Architecture").otherwise("Testing").alias("category"),
        F.when(now, "fix critical structure first").otherwise("add tests for core modules").alias("task"),
        F.lit("days").alias("effort"),
    )
    return rows.unionByName(closing)


# condition, kind, priority and effort of what can block a project (fixed values)
BLOCKERS = (
    (1, "no-license", "NOT has_license", "deploy-blocker", "minutes"),
    (1, "exposed-secrets", "secrets > 0", "safety-risk", "hours"),
    (2, "known-bugs", "bugs > 0", "safety-risk", "days"),
    (2, "mixed-concern-files", "mixed_files > 0", "refactor-prerequisite", "days"),
    (3, "quality-issues", "vibe_recommendations > 0", "velocity-drag", "sprint"),
    (3, "unbuilt-features", "unbuilt_features > 0", "architecture-trap", "sprint"),
    (4, "low-consistency", "vibe_score < 50", "knowledge-gap", "sprint"),
    (2, "no-ci", "NOT has_ci", "deploy-blocker", "hours"),
    (2, "manual-deploy", "NOT has_dockerfile AND NOT has_ci", "deploy-blocker", "days"),
)


def blocker_plan(facts: DataFrame) -> DataFrame:
    """Blockers per repository by priority, with the top one, the quickest win and the biggest risk."""
    rows = F.array_compact(F.array(*[
        F.when(F.expr(cond), F.struct(F.lit(p).alias("priority"), F.lit(i).alias("ord"), F.lit(n).alias("blocker"), F.lit(k).alias("kind"), F.lit(e).alias("effort")))
        for i, (p, n, cond, k, e) in enumerate(BLOCKERS)
    ]))
    first = lambda a: F.get(a, F.lit(0))["blocker"]
    plan = facts.select("repo_id", F.array_sort(rows).alias("b"))
    return plan.select(
        "repo_id",
        F.transform("b", lambda x: x["blocker"]).alias("blockers"),
        first(F.col("b")).alias("top_priority"),
        first(F.filter("b", lambda x: x["effort"].isin("minutes", "hours"))).alias("quickest_win"),
        first(F.filter("b", lambda x: x["kind"].isin("safety-risk", "deploy-blocker"))).alias("biggest_risk"),
    )


# condition per suggested house rule (fixed values)
RULE_SUGGESTIONS = (
    ("no-secrets-in-code", "must", 0.95, "security_issues > 0"),
    ("review-ai-generated-code", "should", 0.8, "ai_patterns > 5"),
    ("write-tests-for-core-logic", "must", 0.9, "NOT has_tests"),
    ("include-license-file", "should", 0.85, "NOT has_license"),
    ("handle-async-errors", "must", 0.85, "error_handling_gaps > 0"),
)


def suggest_rules(analysis: DataFrame) -> DataFrame:
    """House rules whose condition holds, one row per repository and rule."""
    rows = F.array_compact(F.array(*[
        F.when(F.expr(cond), F.struct(F.lit(i).alias("rule_no"), F.lit(rid).alias("rule"), F.lit(sev).alias("severity"), F.lit(conf).alias("confidence")))
        for i, (rid, sev, conf, cond) in enumerate(RULE_SUGGESTIONS)
    ]))
    return analysis.select("repo_id", F.explode(rows).alias("r")).select("repo_id", "r.*")


# --- evidence -------------------------------------------------------------------------------------------

def label_evidence(findings: DataFrame) -> DataFrame:
    """Evidence level of a finding with optional path, action, description and confidence (0..100).

    A path with an action is verified; a critical one without path is inferred; one without any
    description needs a human; a measured confidence of 70 or more is verified; the rest is inferred.
    """
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    level = (
        F.when(F.col("confidence").isNotNull(), F.when(F.col("confidence") >= 70, "verified").otherwise("inferred"))
        .when(filled("path") & filled("action"), "verified")
        .when((F.col("severity") == "critical") & ~filled("path"), "inferred")
        .when(~filled("description"), "human-needed")
        .otherwise("inferred")
    )
    return findings.withColumn("evidence_level", level)


def evidence_counts(labelled: DataFrame) -> DataFrame:
    levels = ("verified", "inferred", "missing-proof", "human-needed")
    return labelled.groupBy("repo_id").agg(
        *[_count_if(F.col("evidence_level") == s).alias(s.replace("-", "_")) for s in levels]
    )


def quality_gate(analysis: DataFrame, max_vibe: int = 40, max_secrets: int = 0, require_tests: bool = True) -> DataFrame:
    """Pass flag and failing reasons of one analysis row per repository."""
    reasons = F.array_compact(F.array(
        F.when(F.col("vibe_index") > max_vibe, F.lit("vibe")),
        F.when(F.col("secrets") > max_secrets, F.lit("secrets")),
        F.when(F.lit(require_tests) & (F.col("test_files") == 0), F.lit("tests")),
    ))
    return analysis.withColumn("failures", reasons).withColumn("passed", F.size("failures") == 0)


def feedback_summary(feedback: DataFrame) -> DataFrame:
    """Accepted and rejected suggestions per rule; the row with a null rule is the total."""
    return feedback.rollup("rule").agg(
        F.count("*").alias("total"), _count_if(F.col("accepted")).alias("accepted"), _count_if(~F.col("accepted")).alias("rejected")
    )
