"""External scanner outputs as findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SARIF = (
    "runs array<struct<results:array<struct<ruleId:string,level:string,message:struct<text:string>,properties:struct<severity:string>,"
    "locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>>>>>"
)
VULNS = "Results array<struct<Vulnerabilities:array<struct<VulnerabilityID:string,PkgName:string,Severity:string,Title:string,InstalledVersion:string,FixedVersion:string>>>>"


def scanner_weight(severity: Column) -> Column:
    return F.when(severity == "ERROR", 0.9).when(severity == "WARNING", 0.6).otherwise(0.3)


def sarif_findings(reports: DataFrame) -> DataFrame:
    """reports(repo_id, runs) in the SARIF shape -> one row per result."""
    r = reports.select("repo_id", F.explode("runs").alias("run")).select("repo_id", F.explode("run.results").alias("r"))
    sev = F.upper(F.coalesce(F.col("r.properties.severity"), F.col("r.level"), F.lit("WARNING")))
    loc = F.get(F.col("r.locations"), F.lit(0))["physicalLocation"]
    return r.select(
        "repo_id", F.col("r.ruleId").alias("rule"), sev.alias("severity"), F.coalesce(loc["artifactLocation"]["uri"], F.lit("")).alias("path"),
        F.coalesce(F.col("r.message.text"), F.lit("")).alias("detail"), scanner_weight(sev).alias("confidence"),
    )


def read_sarif(spark: SparkSession, path: str) -> DataFrame:
    """SARIF files; the repository is the file's base name without extension."""
    raw = spark.read.schema(SARIF).option("multiLine", True).json(path)
    return sarif_findings(raw.select(_stem().alias("repo_id"), "runs"))


def _stem() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)


def parse_reports(df: DataFrame, col: str, ddl: str) -> DataFrame:
    """JSON report text in a column -> struct columns; text that does not parse yields nulls."""
    fields = F.from_json(F.col(col), ddl)
    return df.withColumn("_r", fields).select(*[c for c in df.columns if c != col], "_r.*")


def vuln_findings(reports: DataFrame) -> DataFrame:
    v = reports.select("repo_id", F.explode("Results").alias("r")).select("repo_id", F.explode("r.Vulnerabilities").alias("v"))
    return v.select(
        "repo_id", F.col("v.VulnerabilityID").alias("vuln_id"), F.col("v.PkgName").alias("package"), F.col("v.Severity").alias("severity"),
        F.col("v.Title").alias("title"), F.col("v.InstalledVersion").alias("installed"), F.col("v.FixedVersion").alias("fixed"),
    )


def read_vulns(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(VULNS).option("multiLine", True).json(path)
    return vuln_findings(raw.select(_stem().alias("repo_id"), "Results"))


def read_secret_hits(spark: SparkSession, path: str, cut: int | None = 20) -> DataFrame:
    """One JSON object per line; lines that do not parse are dropped. Raw values are cut to ``cut`` characters for the report, or whole without it."""
    raw = spark.read.schema("DetectorName string, Verified boolean, Raw string").option("mode", "DROPMALFORMED").json(path)
    value = F.coalesce("Raw", F.lit(""))
    return raw.select(
        _stem().alias("repo_id"), F.coalesce("DetectorName", F.lit("unknown")).alias("detector"), F.coalesce("Verified", F.lit(False)).alias("verified"),
        (value if cut is None else F.substring(value, 1, cut)).alias("raw"),
    )


def dockerfile_score(violations: DataFrame, repos: DataFrame) -> DataFrame:
    """100 - 10 per error - 3 per warning, floored at 0; 0 without a Dockerfile, 50 where the tool failed.

    violations(repo_id, level); repos(repo_id, has_dockerfile, tool_failed).
    """
    n = violations.groupBy("repo_id").agg(
        F.sum(F.when(F.col("level") == "error", 10).when(F.col("level") == "warning", 3).otherwise(0)).alias("_lost"), F.count("*").alias("violations")
    )
    out = repos.join(n, "repo_id", "left").na.fill(0, ["_lost", "violations"])
    score = F.when(~F.col("has_dockerfile"), 0).when(F.col("tool_failed"), 50).otherwise(F.greatest(F.lit(0), 100 - F.col("_lost")))
    return out.select("repo_id", "has_dockerfile", "violations", score.cast("int").alias("score"))


# --- model responses ------------------------------------------------------------------------------------------

# an escaped character, a quote, a brace, or a run of anything else
_JSON_TOKEN = r'\\[\s\S]|["{}]|[^\\"{}]++|\\'


def first_object(raw: Column) -> Column:
    """First balanced {...} of a text, quotes and escapes respected, else null: a fold over quotes, braces and escapes.

    The fold carries how far it has come, so the object is cut from the text once, at its end.
    """
    body = F.regexp_extract(raw, r"(?s)\{.*", 0)
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, token: Column) -> Column:
        open_, close = ~s["quoted"] & (token == "{"), ~s["quoted"] & (token == "}")
        at = s["at"] + F.length(token)
        return F.when(s["end"] > 0, s).otherwise(F.struct(
            (s["depth"] + F.when(open_, 1).when(close, -1).otherwise(0)).alias("depth"),
            (s["quoted"] != (token == '"')).alias("quoted"),
            at.alias("at"),
            F.when(close & (s["depth"] == 1), at).otherwise(0).alias("end"),
        ))

    end = F.aggregate(F.regexp_extract_all(body, F.lit(_JSON_TOKEN), F.lit(0)), start, step, lambda s: s["end"])
    return F.get(F.transform(F.array(end), lambda n: F.when(n > 0, F.substring(body, F.lit(1), n))), 0)


def parse_responses(df: DataFrame, col: str, ddl: str) -> DataFrame:
    """Adds ``parsed``: the whole text, else its fenced block, else the first balanced object.

    Only texts that the parsers cannot read whole are searched for an object.
    """
    raw = F.trim(F.regexp_replace(F.col(col), r"^\s+|\s+$", ""))
    fence = F.regexp_extract(raw, r"```(?:json)?\s*([\s\S]+?)\s*```", 1)
    ok = lambda c: F.when(F.try_parse_json(c).isNotNull() & c.rlike(r"^[\[{]"), c)
    text = F.coalesce(ok(raw), ok(fence))
    out = df.withColumn("_json", text)
    rest = F.when(F.col("_json").isNull() & F.col(col).contains("{"), F.col(col))
    out = out.withColumn("_obj", first_object(rest))
    return out.withColumn("parsed", F.from_json(F.coalesce(F.col("_json"), ok(F.col("_obj"))), ddl)).drop("_json", "_obj")


RESPONSE = (
    "findings array<struct<line:double,severity:string,category:string,type:string,description:string,recommendation:string,confidence:double>>, "
    "issues array<struct<line:double,severity:string,category:string,type:string,description:string,recommendation:string,confidence:double>>, "
    "problems array<struct<line:double,severity:string,category:string,type:string,description:string,recommendation:string,confidence:double>>"
)

# severity aliases (fixed values)
SEVERITY_ALIASES = {
    "critical": ("critical", "crit", "blocker"), "high": ("high", "error"), "medium": ("medium", "moderate", "warn", "warning"),
    "low": ("low", "minor"), "info": ("info", "informational", "note"),
}


def normal_severity(c: Column) -> Column:
    low = F.lower(c)
    out = None
    for name, names in SEVERITY_ALIASES.items():
        out = F.when(low.isin(*names), name) if out is None else out.when(low.isin(*names), name)
    return out.otherwise(F.lit("medium"))


def normalize_findings(df: DataFrame, keys: list[str], chunk_start: str | None = None) -> DataFrame:
    """Findings of ``parsed`` responses: shifted lines, folded severities, slugs for missing types,
    confidence within [0, 1] with default 0.7; rows without description are dropped."""
    from siltscope.functions import text as tx

    items = F.coalesce("parsed.findings", "parsed.issues", "parsed.problems")
    r = df.select(*keys, (F.col(chunk_start) if chunk_start else F.lit(1)).alias("_s"), F.explode(items).alias("r"))
    desc = F.coalesce("r.description", F.lit(""))
    cat = F.coalesce("r.category", F.lit("quality"))
    typ = F.when(F.coalesce("r.type", F.lit("")) != "", F.col("r.type")).otherwise(F.substring(tx.slug(F.concat_ws(" ", cat, desc)), 1, 64))
    return r.filter(desc != "").select(
        *keys, cat.alias("category"), normal_severity(F.coalesce("r.severity", F.lit("medium"))).alias("severity"),
        F.when(F.col("r.line") > 0, F.col("r.line").cast("int") + F.col("_s") - 1).otherwise(0).alias("line"), typ.alias("type"), desc.alias("description"),
        F.coalesce("r.recommendation", F.lit("")).alias("recommendation"),
        F.when(F.col("r.confidence").isNull(), 0.7).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("r.confidence")))).alias("confidence"),
    )
