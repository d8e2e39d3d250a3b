"""Quality profiles, issue reports and gates of a third-party analyzer, and their migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltscope.functions import numbers as nm

# fixed values
SEVERITIES = ("BLOCKER", "CRITICAL", "MAJOR", "MINOR", "INFO")
BUILTIN_CATEGORIES = ("security", "reliability", "maintainability", "hygiene", "performance", "architecture")
METRICS = {
    "blocker_violations": "blockers", "critical_violations": "critical_issues", "major_violations": "major_issues", "minor_violations": "minor_issues",
    "info_violations": "info_issues", "code_smells": "code_smells", "bugs": "bugs", "vulnerabilities": "vulnerabilities", "coverage": "test_coverage",
    "duplicated_lines_density": "duplication", "sqale_rating": "maintainability_rating", "reliability_rating": "reliability_rating",
    "security_rating": "security_rating", "security_hotspots_reviewed": "security_hotspots",
}
RULE_XML = (
    "repositoryKey string, key string, priority string, severity string, "
    "parameters struct<parameter:array<struct<key:string,value:string>>>"
)
ISSUE = "rule string, severity string, component string, message string, line string, type string, effort string, debt string, tags array<string>"


def rule_category(rule_type: Column, repo_key: Column) -> Column:
    """Category by issue type, or by the repository key where no type is given."""
    t = F.upper(rule_type)
    k = F.lower(F.coalesce(repo_key, F.lit("")))
    by_type = F.when(t == "BUG", "reliability").when(t.isin("VULNERABILITY", "SECURITY_HOTSPOT"), "security").when(t == "CODE_SMELL", "maintainability").otherwise("unknown")
    by_key = (
        F.when(k.contains("bug") & ~k.contains("debug"), "reliability").when(k.contains("vulnerability") | k.contains("security"), "security")
        .when(k.contains("code_smell") | k.contains("code-smell") | k.contains("sqale"), "maintainability").when(k.contains("performance"), "performance")
        .when(k.contains("architecture") | k.contains("design"), "architecture").otherwise("unknown")
    )
    return F.when(F.coalesce(rule_type, F.lit("")) == "", by_key).otherwise(by_type)


def profile_rules(rules: DataFrame) -> DataFrame:
    """Raw rule rows -> mapped rules with weight, category and a parameter map."""
    prio = F.upper(F.coalesce("priority", "severity"))
    prio = F.when(prio.isin(*SEVERITIES), prio)
    sev = F.coalesce(prio, F.lit("MAJOR"))
    params = F.filter(F.coalesce("parameters.parameter", F.array().cast("array<struct<key:string,value:string>>")), lambda p: F.coalesce(p["key"], F.lit("")) != "")
    entries = F.transform(params, lambda p: F.struct(p["key"].alias("key"), F.coalesce(p["value"], F.lit("")).alias("value")))
    repo = F.coalesce("repositoryKey", F.lit(""))
    return rules.select(
        repo.alias("repository_key"), F.coalesce("key", F.lit("")).alias("rule_key"), sev.alias("severity"), nm.severity_weight(sev, "quality_profile", 0.5).alias("weight"),
        rule_category(F.lit(None).cast("string"), repo).alias("category"), F.map_from_entries(entries).alias("parameters"),
    )


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """Rules of an XML quality profile.  The schema is explicit: a lone parameter stays an array."""
    return profile_rules(spark.read.schema(RULE_XML).format("xml").option("rowTag", "rule").load(path))


def issues_of(reports: DataFrame, col: str = "value") -> DataFrame:
    """Issue rows of JSON texts that hold a bare array or an object with ``issues``."""
    bare = F.from_json(F.col(col), f"array<struct<{_ddl(ISSUE)}>>")
    wrapped = F.from_json(F.get_json_object(col, "$.issues"), f"array<struct<{_ddl(ISSUE)}>>")
    rows = F.when(F.trim(col).startswith("["), bare).otherwise(wrapped)
    i = reports.select(F.explode(rows).alias("i")).select("i.*")
    up = F.upper(F.coalesce("severity", F.lit("")))
    sev = F.when(up.isin(*SEVERITIES), up).otherwise("MAJOR")
    return i.select(
        F.coalesce("rule", F.lit("")).alias("rule"), sev.alias("severity"), nm.severity_weight(sev, "quality_profile", 0.5).alias("weight"),
        rule_category(F.col("type"), F.lit("")).alias("category"), F.coalesce("component", F.lit("")).alias("component"), F.coalesce("message", F.lit("")).alias("message"),
        F.expr("try_cast(regexp_extract(line, '^([0-9]+)', 1) AS int)").alias("line"), "type", "effort",
    )


def _ddl(fields: str) -> str:
    return ",".join(f.strip().replace(" ", ":", 1) for f in fields.split(", "))


def read_issues(spark: SparkSession, path: str) -> DataFrame:
    return issues_of(spark.read.format("text").option("wholetext", True).load(path))


def gate_thresholds(reports: DataFrame, col: str = "value") -> DataFrame:
    """Conditions of a quality gate with renamed metrics and numeric thresholds."""
    ddl = "array<struct<metric:string,id:string,op:string,error:string,warning:string,level:string>>"
    c = reports.select(F.explode(F.from_json(F.get_json_object(col, "$.conditions"), ddl)).alias("c")).select("c.*")
    metric = F.coalesce("metric", "id", F.lit(""))
    rename = F.create_map(*[x for k, v in METRICS.items() for x in (F.lit(k), F.lit(v))])
    number = lambda n: F.expr(f"try_cast(regexp_extract({n}, '^\\\\s*(-?[0-9]+(?:[.][0-9]+)?)', 1) AS double)")
    return c.select(
        F.coalesce(F.try_element_at(rename, metric), metric).alias("metric"), F.coalesce("op", F.lit("LT")).alias("operator"),
        number("error").alias("error_threshold"), number("warning").alias("warning_threshold"), "level",
    )


def read_gate(spark: SparkSession, path: str) -> DataFrame:
    return gate_thresholds(spark.read.format("text").option("wholetext", True).load(path))


def migration_coverage(rules: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rules, mapped rules, share mapped (100 without rules) and repositories that did not map."""
    mapped = F.col("category") != "unknown"
    out = rules.groupBy(*(keys or [])).agg(
        F.count("*").alias("total"), F.sum(F.when(mapped, 1).otherwise(0)).alias("mapped"),
        F.array_sort(F.collect_set(F.when(~mapped, F.col("repository_key")))).alias("unmapped"),
    )
    return out.na.fill(0, ["mapped"]).withColumn("percent", F.when(F.col("total") > 0, F.col("mapped") / F.col("total") * 100).otherwise(100.0))


def category_gaps(rules: DataFrame, builtin: tuple[str, ...] = BUILTIN_CATEGORIES, keys: list[str] | None = None) -> DataFrame:
    """Built-in categories no rule maps to (per key)."""
    keys = keys or []
    have = rules.select(*keys, "category").distinct()
    base = rules.select(*keys).distinct() if keys else rules.sparkSession.range(1).select()
    want = base.select(*keys, F.explode(F.lit(list(builtin))).alias("category"))
    return want.join(have, [*keys, "category"], "left_anti")


def migration_config(rules: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Rows of a migration configuration as JSON text: one per rule, one per threshold.

    Written as JSON lines; nothing is collected into one document.
    """
    r = rules.select(
        F.lit("rule").alias("section"), F.col("rule_key").alias("key"),
        F.to_json(F.struct(F.col("rule_key").alias("ruleKey"), F.concat(F.lit("profile:"), F.col("repository_key")).alias("source"), "weight", "category", "parameters")).alias("value"),
    )
    t = thresholds.select(
        F.lit("threshold").alias("section"), F.col("metric").alias("key"),
        F.to_json(F.struct("operator", F.col("error_threshold").alias("error"), F.col("warning_threshold").alias("warning"))).alias("value"),
    )
    return r.unionByName(t)
