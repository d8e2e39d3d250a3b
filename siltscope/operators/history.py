"""Scan history: latest and previous scans, trends, dashboards, comparisons.

``scans`` needs scan_id, repo_url, status, overall_score, grade, vibe_score, created_at; some
operators read org_id, user_id, drift_status, security_score or dimension_scores (a map).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltscope.functions import numbers as nm
from siltscope.operators.ordered import first_n, lag_in_key, row_number_in_key

GRADES = ("A+", "A", "B+", "B", "C", "D", "F")
DRIFT = ("on-scope", "at-risk", "drifting", "blocked")


def complete(scans: DataFrame) -> DataFrame:
    return scans.filter(F.col("status") == "complete")


def latest_scan(scans: DataFrame, key: str = "repo_url") -> DataFrame:
    """Newest scan per repository; on equal times the larger scan_id wins.

    max_by keeps one row per key and task before the shuffle, so a repository with any share of all
    scans costs the same as a small one.
    """
    rest = [c for c in scans.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct("created_at", "scan_id"))
    return scans.groupBy(key).agg(best.alias("b")).select(key, "b.*").select(*scans.columns)


def score_trend(scans: DataFrame, mode: str = "previous") -> DataFrame:
    """Previous score, delta and up/down/same.

    ``previous``      the scan before this one
    ``newest_other``  the newest other scan of the repository, whichever side it lies on
    """
    s = complete(scans).filter(F.col("overall_score").isNotNull())
    if mode == "previous":
        out = lag_in_key(s, ["repo_url"], None, ["created_at", "scan_id"], F.struct("overall_score", "scan_id"), "_p")
        out = out.withColumn("previous_score", F.col("_p.overall_score")).withColumn("previous_scan_id", F.col("_p.scan_id")).drop("_p")
    elif mode == "newest_other":
        two = first_n(s.select("repo_url", "scan_id", "overall_score", "created_at"), ["repo_url"], [F.desc("created_at"), F.desc("scan_id")], 2)
        # two rows per repository, bounded by construction
        heads = two.groupBy("repo_url").agg(
            F.max_by(F.struct("scan_id", "overall_score"), F.struct("created_at", "scan_id")).alias("_a"),
            F.min_by(F.struct("scan_id", "overall_score"), F.struct("created_at", "scan_id")).alias("_b"),
            F.count("*").alias("_n"),
        )
        j = s.join(heads, "repo_url")
        other = F.when(F.col("scan_id") != F.col("_a.scan_id"), F.col("_a")).when(F.col("_n") > 1, F.col("_b"))
        out = j.withColumn("_p", other).withColumn("previous_score", F.col("_p.overall_score")).withColumn("previous_scan_id", F.col("_p.scan_id")).drop("_p", "_a", "_b", "_n")
    else:
        raise ValueError(mode)
    d = F.col("overall_score") - F.col("previous_score")
    return out.withColumn("delta", d).withColumn("direction", F.when(d > 0, "up").when(d < 0, "down").when(d == 0, "same"))


def score_band_trend(scans: DataFrame, band: int = 2) -> DataFrame:
    """improving / degrading / stable against the previous scan, with a dead band."""
    t = score_trend(scans)
    change = F.coalesce("delta", F.lit(0))
    return t.withColumn("score_change", change).withColumn(
        "trend", F.when(change > band, "improving").when(change < -band, "degrading").otherwise("stable")
    )


def scan_timeseries(scans: DataFrame, limit: int | None = None, keep: str = "oldest") -> DataFrame:
    """All scans (or ``limit``) per repository with defaults for missing values; position counts in time order."""
    order = [F.asc("created_at"), F.asc("scan_id")] if keep == "oldest" else [F.desc("created_at"), F.desc("scan_id")]
    s = row_number_in_key(first_n(complete(scans), ["repo_url"], order, limit), ["repo_url"], None, ["created_at", "scan_id"], "position")
    return s.select(
        "repo_url", "scan_id", "created_at",
        F.coalesce("overall_score", F.lit(0)).alias("overall_score"),
        F.coalesce("grade", F.lit("F")).alias("grade"),
        F.coalesce("vibe_score", F.lit(0)).alias("vibe_score"),
        F.col("position").cast("int").alias("position"),
    )


def vibe_history(scans: DataFrame, limit: int | None = None, band: int = 5, keep: str = "oldest") -> DataFrame:
    """First and last index of a repository's history and its direction."""
    order = [F.asc("created_at"), F.asc("scan_id")] if keep == "oldest" else [F.desc("created_at"), F.desc("scan_id")]
    s = first_n(complete(scans), ["repo_url"], order, limit).filter(F.col("vibe_score").isNotNull())
    at = F.struct("created_at", "scan_id")
    h = s.groupBy("repo_url").agg(
        F.min_by("vibe_score", at).alias("first_vibe"), F.max_by("vibe_score", at).alias("current_vibe"), F.count("*").alias("scans")
    )
    d = F.col("current_vibe") - F.col("first_vibe")
    return h.withColumn(
        "trend", F.when(F.col("scans") < 2, "insufficient-data").when(d > band, "rising").when(d < -band, "falling").otherwise("stable")
    )


def org_summary(scans: DataFrame) -> DataFrame:
    """Latest complete scan per repository rolled up per organisation."""
    latest = latest_scan(complete(scans))
    score = F.coalesce("overall_score", F.lit(0))
    grade = F.coalesce("grade", F.lit("F"))
    drift = F.coalesce("drift_status", F.lit("on-scope"))
    name = lambda p, x: p + x.replace("+", "_plus").replace("-", "_").lower()
    return latest.groupBy("org_id").agg(
        F.count("*").alias("repos"),
        nm.js_round(F.avg(score)).alias("avg_score"),
        *[F.sum((grade == g).cast("long")).alias(name("grade_", g)) for g in GRADES],
        *[F.sum((drift == d).cast("long")).alias(name("drift_", d)) for d in DRIFT],
    )


def health_trend(scans: DataFrame) -> DataFrame:
    """Per organisation and UTC day: rounded mean, upper median and scans per grade.

    Scores are integers from 0 to 100, so a day is first reduced to its histogram; the median is read
    off the running counts of at most 101 rows however many scans the day has.
    """
    s = complete(scans).filter(F.col("overall_score").isNotNull())
    hist = s.groupBy("org_id", nm.utc_day("created_at").alias("day"), "overall_score").agg(
        F.count("*").alias("n"),
        *[F.sum((F.coalesce("grade", F.lit("F")) == g).cast("long")).alias("g" + str(i)) for i, g in enumerate(GRADES)],
    )
    w = W.partitionBy("org_id", "day")
    cum = hist.withColumn("_cum", F.sum("n").over(w.orderBy("overall_score").rowsBetween(W.unboundedPreceding, 0))).withColumn("_all", F.sum("n").over(w))
    name = lambda x: "grade_" + x.replace("+", "_plus").lower()
    return cum.groupBy("org_id", "day").agg(
        F.sum("n").alias("scans"),
        nm.js_round(F.sum(F.col("overall_score") * F.col("n")) / F.sum("n")).alias("avg_score"),
        F.min(F.when(F.col("_cum") > F.floor(F.col("_all") / 2), F.col("overall_score"))).alias("median_score"),
        *[F.sum("g" + str(i)).alias(name(g)) for i, g in enumerate(GRADES)],
    )


def risk_hotspots(scans: DataFrame, k: int | None = None) -> DataFrame:
    """Riskiest repositories by ``100 - (security + quality) / 2`` plus 30 (drifting) or 15 (at risk)."""
    latest = latest_scan(complete(scans))
    drift = F.when(F.col("drift_status") == "drifting", 30).when(F.col("drift_status") == "at-risk", 15).otherwise(0)
    raw = 100 - (F.coalesce("security_score", F.lit(0)) + F.coalesce("overall_score", F.lit(0))) / 2 + drift
    out = latest.select("repo_url", "scan_id", "overall_score", "drift_status", nm.clamp(raw, 0.0, 100.0).alias("risk_score"))
    return out.orderBy(F.desc("risk_score"), F.asc("repo_url")).limit(k)


def recent(df: DataFrame, order: list, k: int, keys: list[str] | None = None) -> DataFrame:
    """Newest ``k`` rows, overall or per key."""
    return first_n(df, keys, order, k) if keys else df.orderBy(*order).limit(k)


# scans per month by plan, -1 is unlimited (fixed values)
PLAN_SCANS = {"free": 3, "pro": 150, "enterprise": -1}


def quota_usage(scans: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    """Scans of the current month per user against the plan's limit."""
    limit = F.create_map(*[x for k, v in PLAN_SCANS.items() for x in (F.lit(k), F.lit(v))])[F.col("tier")]
    used = scans.filter((F.col("created_at") >= nm.month_start(as_of)) & (F.col("created_at") <= as_of)).groupBy("user_id").agg(F.count("*").alias("used"))
    out = users.join(used, "user_id", "left").na.fill(0, ["used"]).withColumn("plan_limit", limit)
    return out.withColumn("exceeded", (F.col("plan_limit") >= 0) & (F.col("used") >= F.col("plan_limit")))


def compare_scans(scans: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(first_id, second_id) -> overall delta and one row per dimension of the first scan.

    The overall delta is null when either score is; a dimension the second scan lacks counts as 0.
    """
    cols = lambda p: scans.select(
        F.col("scan_id").alias(f"{p}_id"), F.col("overall_score").alias(f"{p}_score"), F.col("dimension_scores").alias(f"{p}_dims")
    )
    j = pairs.join(cols("first"), "first_id").join(cols("second"), "second_id")
    long = j.select("first_id", "second_id", (F.col("second_score") - F.col("first_score")).alias("overall_delta"), "second_dims", F.explode("first_dims").alias("dimension", "v"))
    other = F.coalesce(F.try_element_at("second_dims", F.col("dimension")), F.lit(0))
    return long.select("first_id", "second_id", "overall_delta", "dimension", (other - F.coalesce("v", F.lit(0))).alias("dimension_delta"))


def compare_milestones(milestone_pairs: DataFrame, milestones: DataFrame, scans: DataFrame) -> DataFrame:
    """pairs(first_milestone, second_milestone) compared through their linked scans."""
    link = lambda p: milestones.select(F.col("milestone_id").alias(f"{p}_milestone"), F.col("scan_id").alias(f"{p}_id"))
    linked = milestone_pairs.join(link("first"), "first_milestone").join(link("second"), "second_milestone")
    linked = linked.filter(F.col("first_id").isNotNull() & F.col("second_id").isNotNull())
    delta = compare_scans(scans, linked.select("first_id", "second_id").distinct())
    return linked.join(delta, ["first_id", "second_id"])


def promote(milestones: DataFrame, scans: DataFrame) -> DataFrame:
    """Milestones without a scan get the newest complete scan of their user and repository."""
    s = complete(scans).withColumn("_k", F.struct("user_id", "repo_url"))
    newest = s.groupBy("user_id", "repo_url").agg(F.max_by("scan_id", F.struct("created_at", "scan_id")).alias("_latest"))
    return milestones.join(newest, ["user_id", "repo_url"], "left").withColumn("scan_id", F.coalesce("scan_id", "_latest")).drop("_latest")


def visible_scans(scans: DataFrame, members: DataFrame, user_id) -> DataFrame:
    """Scans a user may see: the own ones and those of organisations the user belongs to."""
    orgs = members.filter(F.col("user_id") == user_id).select("org_id").distinct().withColumn("_m", F.lit(True))
    return scans.join(orgs, "org_id", "left").filter((F.col("user_id") == user_id) | F.col("_m")).drop("_m").select(*scans.columns)


def scope_compliance(briefs: DataFrame, scans: DataFrame) -> DataFrame:
    """Timeline of implemented over planned deliverables per brief and scan.

    briefs(brief_id, deliverables array), scans(brief_id, scan_id, created_at, implemented array, missing array).
    """
    planned = F.size("deliverables")
    done = F.coalesce(F.size("implemented"), F.lit(0))
    done = F.when(F.col("implemented").isNull(), 0).otherwise(done)
    pct = F.when(planned > 0, nm.js_round(done / planned * 100)).otherwise(0)
    return complete(scans).join(briefs, "brief_id").select(
        "brief_id", "scan_id", "created_at", planned.alias("planned"), done.alias("implemented"), pct.cast("int").alias("compliance_percent")
    )


def current_compliance(timeline: DataFrame) -> DataFrame:
    rest = [c for c in timeline.columns if c != "brief_id"]
    return timeline.groupBy("brief_id").agg(F.max_by(F.struct(*rest), F.struct("created_at", "scan_id")).alias("b")).select("brief_id", "b.*")


def approval_versions(approvals: DataFrame) -> DataFrame:
    """Version number of each approval: position in its brief."""
    return row_number_in_key(approvals, ["brief_id"], None, ["approved_at", "approval_id"], "version")


def brief_overview(briefs: DataFrame, approvals: DataFrame, milestones: DataFrame, scans: DataFrame) -> DataFrame:
    """Latest approval, milestone and scan counts per brief."""
    a = approvals.groupBy("brief_id").agg(
        F.max_by("approval_id", F.struct("approved_at", "approval_id")).alias("latest_approval"), F.count("*").alias("approvals")
    )
    m = milestones.groupBy("brief_id").agg(F.count("*").alias("milestones"))
    s = scans.groupBy("brief_id").agg(F.count("*").alias("scans"))
    out = briefs
    for part in (a, m, s):
        out = out.join(part, "brief_id", "left")
    return out.na.fill(0, ["approvals", "milestones", "scans"])


def brief_readiness(briefs: DataFrame) -> DataFrame:
    """Reasons why a brief cannot be approved; its lists are JSON text."""
    cols = ("deliverables", "exclusions", "acceptance_criteria")
    parsed = {c: F.from_json(F.col(c), "array<string>") for c in cols}
    reasons = F.array_compact(F.array(*[
        F.when(parsed[c].isNull(), F.lit(f"{c}: not a list")).when(F.size(parsed[c]) == 0, F.lit(f"{c}: empty")) for c in cols
    ]))
    return briefs.withColumn("reasons", reasons).withColumn("ready", F.size("reasons") == 0)


# fields an approved change may set
BRIEF_FIELDS = ("name", "goal", "target_user", "deliverables", "exclusions", "constraints", "assumptions", "deadline", "budget", "acceptance_criteria")


def apply_changes(briefs: DataFrame, changes: DataFrame, fields: tuple[str, ...] = BRIEF_FIELDS) -> DataFrame:
    """Latest approved change per brief applied to the allowed fields; nulls leave the brief as is."""
    fields = tuple(f for f in fields if f in changes.columns and f in briefs.columns)
    last = changes.filter(F.col("status") == "approved").groupBy("brief_id").agg(
        F.max_by(F.struct(*fields), F.struct("approved_at", "change_id")).alias("_c")
    )
    out = briefs.join(last, "brief_id", "left")
    for f in fields:
        out = out.withColumn(f, F.coalesce(F.col("_c")[f], F.col(f)))
    return out.drop("_c")
