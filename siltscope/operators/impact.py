"""Pull-request impact, trust and overall scores, and the plans derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltscope.functions import numbers as nm
from siltscope.functions import text as tx
from siltscope.operators.ai_patterns import ai_pattern_scan, vibe_index
from siltscope.operators.ordered import first_n
from siltscope.session import stored

# reason -> (category, fix, effort, share of the loss a fix recovers) (fixed values)
REASONS = {
    "spaghetti-nesting": ("file-size", "extract-function", "medium", 0.55),
    "over-engineering": ("complexity", "reduce-abstraction", "medium", 0.4),
    "hallucinated-import": ("security", "fix-security", "small", 0.85),
    "missing-error-boundary": ("error-handling", "add-error-handling", "small", 0.7),
    "security-naivety": ("security", "fix-security", "small", 0.85),
    "inconsistent-pattern": ("vibe", None, None, None),
    "any-abuse": ("complexity", "add-types", "small", 0.5),
    "hardcoded-everything": ("complexity", None, None, None),
    "promise-garden": ("complexity", None, None, None),
    "infinite-loop-risk": ("complexity", None, None, None),
    "test-file": ("test-coverage", "add-tests", "small", 0.5),
    "large-file": ("file-size", "split-file", "large", 0.3),
    "async-unguarded": ("error-handling", "add-error-handling", "small", 0.7),
    "removed": ("code-removal", None, None, None),
    "no-content": ("complexity", None, None, None),
}
EFFORT_RANK = {"trivial": 0, "small": 1, "medium": 2, "large": 3}
#: what names a changed file
CHANGE = ("pr_id", "path", "kind")


def _lookup(pos: int) -> Column:
    pairs = [x for k, v in REASONS.items() if v[pos] is not None for x in (F.lit(k), F.lit(v[pos]))]
    return F.create_map(*pairs)[F.col("reason")]


def pr_reasons(changes: DataFrame) -> DataFrame:
    """One row per reason a changed file gains or loses points.

    changes(pr_id, path, kind, content, previous_content, lines_added, lines_removed).  Reasons come out of the row of
    their change: nothing is joined back, and a path listed twice has the reasons of each of its rows once.
    """
    c = F.coalesce("content", F.lit(""))
    f = ai_pattern_scan(changes.filter((F.col("kind") != "removed") & (c != "")), CHANGE)
    loss = nm.severity_weight("severity", "impact", 0.5) * F.col("occurrences")
    found = f.select(*CHANGE, F.col("rule").alias("reason"), (-loss).alias("points"), loss.alias("vibe_points"))
    n = tx.line_count("content")
    live = (F.col("kind") != "removed") & (c != "")
    removed_lines = F.coalesce("lines_removed", F.when(F.col("previous_content").isNotNull(), tx.line_count("previous_content")), F.lit(0))
    item = lambda name, pts: F.struct(F.lit(name).alias("reason"), pts.cast("double").alias("points"))
    items = F.array_compact(F.array(
        F.when(F.col("kind") == "removed", item("removed", F.least(F.lit(2.0), F.log2(1 + removed_lines) * 0.2))),
        F.when((F.col("kind") != "removed") & (c == ""), item("no-content", F.lit(0.0))),
        F.when(live & F.col("path").rlike(r"\.(?:test|spec)\.[jt]sx?$"), item("test-file", F.least(F.lit(3.0), n * 0.05))),
        F.when(live & (n > 600), item("large-file", -F.least(F.lit(3.0), (n - 600) / 200))),
        F.when(live & c.rlike(r"async\s+function|async\s*\(") & ~c.rlike(r"try\s*\{|\.catch\("), item("async-unguarded", F.lit(-1.5))),
    ))
    other = changes.select(*CHANGE, F.explode(items).alias("i")).select(*CHANGE, "i.reason", "i.points", F.lit(0.0).alias("vibe_points"))
    return found.unionByName(other)


def pr_file_impact(changes: DataFrame, reasons: DataFrame | None = None) -> DataFrame:
    """Points per changed file (pr_id, path, kind), clamped to [-15, 10] and rounded to one decimal.

    Changes without a reason come in as rows without one, so that one aggregation gives all files.
    """
    r = pr_reasons(changes) if reasons is None else reasons
    # sums in ten-thousandths do not depend on the order of the rows
    total = lambda c: F.sum(nm.js_round(F.col(c) * 10000)) / 10000
    bare = changes.select(*CHANGE, F.lit(None).cast("string").alias("reason"), F.lit(0.0).alias("points"), F.lit(0.0).alias("vibe_points"))
    out = r.unionByName(bare).groupBy(*CHANGE).agg(total("points").alias("_p"), total("vibe_points").alias("_v"), F.count("reason").alias("n_reasons"))
    return out.select(
        "pr_id", "path", "kind", nm.js_round(nm.clamp("_p", -15.0, 10.0), 1).alias("score_delta"), nm.js_round("_v", 1).alias("vibe_contribution"), "n_reasons"
    )


def pr_reasons_and_impact(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reasons and the points per file made of them; reasons are stored, so that contents are searched once for both."""
    r = stored(pr_reasons(changes), "pr-reasons")
    return r, pr_file_impact(changes, r)


def pr_impact(file_impact: DataFrame, changes: DataFrame, current: DataFrame) -> DataFrame:
    """Predicted score, confidence by changed lines, and the index trend of the new code per PR.

    current(pr_id, current_score).
    """
    lines = F.coalesce("lines_added", F.lit(0)) + F.coalesce("lines_removed", F.lit(0))
    guess = F.ceil(F.length(F.coalesce("content", F.lit(""))) / 50)
    size = changes.groupBy("pr_id").agg(F.sum(F.when(lines > 0, lines).otherwise(guess)).alias("lines"))
    tot = file_impact.groupBy("pr_id").agg((F.sum(nm.js_round(F.col("score_delta") * 10)) / 10).alias("_d"), F.count("*").alias("files"))
    live = changes.filter((F.col("kind") != "removed") & (F.coalesce("content", F.lit("")) != "")).select(F.col("pr_id").alias("repo_id"), "path", "content")
    v = vibe_index(ai_pattern_scan(live), live).select(F.col("repo_id").alias("pr_id"), "vibe_index")
    j = current.join(tot, "pr_id", "left").join(size, "pr_id", "left").join(v, "pr_id", "left").na.fill(0, ["_d", "files", "lines"])
    pred = nm.clamp(nm.js_round(F.col("current_score") + F.col("_d")), 0, 100).cast("int")
    direction = F.when(F.col("vibe_index").isNull(), "insufficient-data").when(F.col("vibe_index") >= 60, "rising").when(F.col("vibe_index") <= 30, "falling").otherwise("stable")
    return j.select(
        "pr_id", "current_score", pred.alias("predicted_score"), (pred - F.col("current_score")).cast("int").alias("total_delta"), "files", F.col("lines").cast("long").alias("lines"),
        F.when(F.col("lines") < 200, "high").when(F.col("lines") < 1000, "medium").otherwise("low").alias("confidence"), "vibe_index", direction.alias("vibe_direction"),
    )


def top_changes(file_impact: DataFrame, k: int | None = None) -> DataFrame:
    """Largest gains and losses per PR.  Gains are listed from the smallest up, as published."""
    wins = first_n(file_impact.filter("score_delta > 0"), ["pr_id"], [F.asc("score_delta"), F.asc("path")], k).withColumn("kind_of", F.lit("win"))
    risks = first_n(file_impact.filter("score_delta < 0"), ["pr_id"], [F.desc("score_delta"), F.asc("path")], k).withColumn("kind_of", F.lit("risk"))
    return wins.unionByName(risks)


def impact_breakdown(file_impact: DataFrame, reasons: DataFrame) -> DataFrame:
    """Delta and files per category; a file's delta is divided evenly over its reasons."""
    j = reasons.select(*CHANGE, "reason").join(file_impact.filter("n_reasons > 0").select(*CHANGE, "score_delta", "n_reasons"), [*CHANGE])
    j = j.withColumn("category", _lookup(0)).withColumn("_s", nm.js_round(F.col("score_delta") / F.col("n_reasons") * 1000000))
    g = j.groupBy("pr_id", "category").agg((F.sum("_s") / 1000000).alias("_d"), F.countDistinct("path").alias("files"))
    return g.select("pr_id", "category", nm.js_round("_d", 1).alias("delta"), "files")


def fix_recommendations(file_impact: DataFrame, reasons: DataFrame) -> DataFrame:
    """Fixes for files that lose points: type, effort, points saved, rank by points over effort."""
    bad = file_impact.filter((F.col("score_delta") < 0) & (F.col("kind") != "removed")).select(*CHANGE, "score_delta")
    j = reasons.select(*CHANGE, "reason").join(bad, [*CHANGE])
    j = j.withColumn("fix", _lookup(1)).filter(F.col("fix").isNotNull()).withColumn("effort", _lookup(2))
    saved = nm.js_round(F.abs(F.col("score_delta")) * _lookup(3), 1)
    rank = F.create_map(*[x for k, v in EFFORT_RANK.items() for x in (F.lit(k), F.lit(v))])[F.col("effort")]
    return j.select("pr_id", "path", "reason", "fix", "effort", saved.alias("points_saved"), (saved / (rank + 1)).alias("value"))


def fix_shortlists(recs: DataFrame, k: int | None = None) -> DataFrame:
    """Quick wins (trivial or small) and major refactors (medium or large), best ``k`` of each per PR."""
    r = recs.withColumn("bucket", F.when(F.col("effort").isin("trivial", "small"), "quick-win").otherwise("refactor"))
    return first_n(r, ["pr_id", "bucket"], [F.desc("value"), F.asc("path"), F.asc("reason")], k)


# --- trust ---------------------------------------------------------------------------------------------------

# fixed values
TRUST_WEIGHTS = {"code_health": 40, "vibe": 20, "readability": 15, "security": 15, "agents": 10}
DIMENSION_WEIGHTS = {"security": 25, "quality": 20, "vibe": 15, "architecture": 15, "deployment": 10, "documentation": 5, "license": 5, "market": 5}


def trust_score(scans: DataFrame) -> DataFrame:
    """Components, weighted sum and grade.

    scans(..., overall_score, vibe_index, readability, critical, high, medium, low, agents_content,
    agents_tokens); null severity counts mean no security data, null content no guideline file.
    """
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    a = F.col("agents_content")
    tokens = F.col("agents_tokens")
    agents = (
        F.lit(50) + F.when(tokens < 800, 25).when(tokens > 2000, -20).otherwise(0)
        + F.when(a.contains("\U0001F534") | a.rlike("(?i)security"), 10).otherwise(0)
        + F.when(a.contains("\U0001F7E1") | a.contains("## "), 5).otherwise(0)
        - F.when(tx.line_count("agents_content") < 10, 15).otherwise(0)
    )
    out = (
        scans.withColumn("t_code_health", nm.clamp(z("overall_score"), 0, 100))
        .withColumn("t_vibe", nm.clamp(100 - z("vibe_index"), 0, 100))
        .withColumn("t_readability", z("readability"))
        .withColumn("t_security", nm.clamp(100 - (z("critical") * 20 + z("high") * 8 + z("medium") * 3 + z("low")), 0, 100))
        .withColumn("t_agents", F.when(F.coalesce(a, F.lit("")) == "", 0).otherwise(nm.clamp(agents, 0, 100)))
    )
    total = sum((F.col("t_" + n) * w for n, w in TRUST_WEIGHTS.items()), F.lit(0))
    out = out.withColumn("trust", nm.js_round(total / 100).cast("int"))
    return out.withColumn("trust_grade", nm.grade("trust", "trust"))


def trust_recommendations(trust: DataFrame, key: str = "scan_id", k: int = 3) -> DataFrame:
    """Actions with the largest gain, at most ``k``, sorted inside the row."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    none = F.coalesce("agents_content", F.lit("")) == ""
    item = lambda i, n, gain, effort: F.struct((-gain).cast("int").alias("neg"), F.lit(i).alias("ord"), F.lit(n).alias("action"), F.lit(effort).alias("effort"))
    items = F.array_compact(F.array(
        F.when(none, item(0, "write-guidelines", F.lit(10), "trivial")).when(z("agents_tokens") > 2000, item(0, "trim-guidelines", F.lit(6), "small")),
        F.when(z("vibe_index") >= 50, item(1, "reduce-generated-patterns", nm.js_round(z("vibe_index") * 0.15), "medium")),
        F.when(z("critical") > 0, item(2, "fix-critical-security", z("critical") * 8, "small")),
        F.when((z("readability") < 60) & F.col("readability").isNotNull(), item(3, "split-files-and-test", F.lit(6), "medium")),
        F.when(z("overall_score") < 60, item(4, "improve-code-health", F.lit(12), "large")),
    ))
    top = F.slice(F.array_sort(items), 1, k)
    return trust.select(key, F.posexplode(top).alias("rank", "r")).select(
        key, (F.col("rank") + 1).alias("rank"), "r.action", (-F.col("r.neg")).alias("gain"), "r.effort"
    )


def overall_score(scans: DataFrame) -> DataFrame:
    """Weighted sum of the eight dimension scores; missing ones count as 0."""
    total = sum((F.coalesce(F.col(n), F.lit(0)) * w for n, w in DIMENSION_WEIGHTS.items()), F.lit(0))
    return scans.withColumn("overall", nm.js_round(total / 100).cast("int"))


def private_report(vibe: DataFrame, secrets: DataFrame, sizes: DataFrame) -> DataFrame:
    """Deterministic report of a repository: score, grade, maturity, security and architecture scores.

    vibe(repo_id, overall), secrets(repo_id, secrets), sizes(repo_id, xlarge).
    """
    j = vibe.select("repo_id", "overall").join(secrets, "repo_id", "left").join(sizes.select("repo_id", "xlarge"), "repo_id", "left").na.fill(0)
    v = F.col("overall")
    return j.select(
        "repo_id", v.alias("overall_score"), nm.grade(v, "private").alias("grade"),
        F.when(v >= 80, "Production").when(v >= 60, "Beta").otherwise("MVP").alias("maturity"),
        F.greatest(F.lit(0), 100 - F.col("secrets") * 10).cast("int").alias("security"),
        F.when(F.col("xlarge") > 0, 40).otherwise(70).alias("architecture"),
    )
