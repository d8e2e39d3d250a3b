"""Findings as SARIF results, review tables and patch proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltscope.functions import text as tx

TOOL = "siltscope"


def sarif_results(findings: DataFrame) -> DataFrame:
    """One SARIF 2.1.0 result object per finding as JSON text (repo_id, result)."""
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    res = F.struct(
        F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.col("detail").alias("text")).alias("message"),
        F.array(F.struct(F.struct(
            F.struct(F.when(F.coalesce("path", F.lit("")) == "", "unknown").otherwise(F.col("path")).alias("uri")).alias("artifactLocation"),
            F.struct(F.greatest(F.lit(1), F.coalesce("line", F.lit(1))).alias("startLine")).alias("region"),
        ).alias("physicalLocation"))).alias("locations"),
    )
    return findings.select("repo_id", F.to_json(res).alias("result"))


def to_sarif(findings: DataFrame, per_document: int = 5000) -> DataFrame:
    """SARIF documents (repo_id, part, document) of at most about ``per_document`` results each.

    A repository with more findings gets several parts, which the format allows as separate files.
    Equal results are counted first and then spread in groups of at most ``per_document`` copies, so
    neither a large repository nor a mass of copies makes a large document.
    """
    r = sarif_results(findings).groupBy("repo_id", "result").agg(F.count("*").alias("_c"))
    n = r.groupBy("repo_id").agg(F.ceil(F.sum("_c") / per_document).cast("int").alias("_parts"))
    piece = F.explode(F.sequence(F.lit(0), F.floor((F.col("_c") - 1) / per_document).cast("int"))).alias("_i")
    spread = r.join(n, "repo_id").select("repo_id", "result", "_c", "_parts", piece)
    copies = F.least(F.lit(per_document), F.col("_c") - F.col("_i") * per_document).cast("int")
    part = F.pmod(F.xxhash64("result", "_i"), F.col("_parts")).cast("int")
    text = F.array_join(F.array_repeat("result", copies), ",")
    docs = spread.select("repo_id", part.alias("part"), text.alias("_t")).groupBy("repo_id", "part").agg(F.array_join(F.array_sort(F.collect_list("_t")), ",").alias("_r"))
    head = f'{{"version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"{TOOL}","rules":[]}}}},"results":['
    return docs.select("repo_id", "part", F.concat(F.lit(head), F.col("_r"), F.lit("]}]}")).alias("document"))


def cell(c: Column) -> Column:
    """Text of a table cell: one line, escaped bars, single blanks."""
    return F.trim(F.regexp_replace(F.replace(F.regexp_replace(c, "\r?\n", " "), F.lit("|"), F.lit("\\|")), r"\s+", " "))


def review_rows(findings: DataFrame) -> DataFrame:
    """Rows of a review table per file: severity, line, type and description of at most 100 characters."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    return findings.select(
        "repo_id",
        F.when(blank("path"), "<file>").otherwise(F.col("path")).alias("path"),
        F.lower(F.coalesce("severity", F.lit("info"))).alias("severity"),
        F.when(F.col("line") > 0, F.concat(F.lit("L"), F.col("line").cast("string"))).otherwise("-").alias("line"),
        F.when(blank("rule"), "unknown").otherwise(cell(F.col("rule"))).alias("type"),
        F.substring(F.when(blank("detail"), "No description provided.").otherwise(cell(F.col("detail"))), 1, 100).alias("description"),
    )


# --- patch proposals -------------------------------------------------------------------------------------

AUTO_FIXABLE = ("any-type-abuse", "debug-code", "TASK-comment", "hardcoded-secret")


def propose_patches(findings: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Old and new text of the cited line for the four fixable types.

    Findings are reduced to the fixable ones and to one row per (path, line, type). Those that bring their line along (``old_text``, see
    ``matching.match_lines``) need no files; others meet the contents in a merge join, as contents must never be broadcast, whatever
    size the planner guesses for texts that are computed.
    """
    f = findings.filter(F.col("rule").isin(*AUTO_FIXABLE) & (F.col("line") >= 1))
    if "old_text" in findings.columns:
        j = f.select("repo_id", "path", "line", "rule", "old_text").distinct()
    else:
        f = f.select("repo_id", "path", "line", "rule").distinct()
        j = f.join(files.select("repo_id", "path", "content").hint("merge"), ["repo_id", "path"])
        j = j.select("repo_id", "path", "line", "rule", F.get(tx.split_lines("content"), F.col("line") - 1).alias("old_text"))
    j = j.filter(F.col("old_text").isNotNull())
    old, indent = F.col("old_text"), F.regexp_extract("old_text", r"^(\s*)", 1)
    new = (
        F.when((F.col("rule") == "any-type-abuse") & old.contains(": any"), F.regexp_replace("old_text", tx.java(": any" + tx.BR), ": unknown"))
        .when((F.col("rule") == "debug-code") & tx.has(old, "console.log", "console.debug"), F.concat(F.lit("// removed debug output\n"), indent, F.lit("// use a logger")))
        .when((F.col("rule") == "TASK-comment") & tx.rx(old, r"(?i)//\s*(?:TASK|FIX_NOW|HACK|XXX)" + tx.BR), F.concat(old, F.lit(" (tracked: see issue tracker)")))
        .when(F.col("rule") == "hardcoded-secret", F.concat(indent, F.lit("// secret removed: read it from process.env")))
    )
    return j.withColumn("new_text", new).filter(F.col("new_text").isNotNull())


# --- generated samples --------------------------------------------------------------------------------------

# stems that stand for a required word (fixed values)
STEMS = {
    "validation": ("validat", "valid", "invalid", "regex", "format", "check"), "validat": ("validat", "valid", "invalid", "regex", "format", "check"),
    "validate": ("validat", "valid", "invalid", "regex", "format", "check"), "error": ("error", "err", "fail", "throw", "except"),
    "submit": ("submit", "prevent", "disabled", "loading"), "email": ("email", "mail"), "password": ("password", "pass"),
    "loading": ("loading", "load", "spinner"), "delete": ("delete", "delet", "remove"), "filter": ("filter", "filt"), "next": ("settimeout", "timer", "delay"),
    "debounce": ("debounce", "bounce", "timer", "timeout", "delay"), "increment": ("increment", "incre", "plus", "add"), "decrement": ("decrement", "decre", "minus", "subtract"),
}


def sample_checks(samples: DataFrame, tasks: DataFrame) -> DataFrame:
    """Checks of generated samples(task_id, sample_id, code) against tasks(task_id, required, banned, names).

    Export, typing, error handling, required words (or a stem of them), banned words, required names;
    a sample passes when all hold.
    """
    j = samples.join(tasks, "task_id")
    c, low = F.col("code"), F.lower("code")
    stems = F.create_map(*[x for k, v in STEMS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    none = F.array().cast("array<string>")
    word = lambda text, w: F.array_contains(F.regexp_extract_all(text, F.lit(r"\w+"), F.lit(0)), w)

    def covered(kw):
        k = F.lower(kw)
        return low.contains(k) | F.exists(F.coalesce(F.try_element_at(stems, k), none), lambda s: low.contains(s))

    is_async = tx.has(c, "async ", "await ", "fetch(", "Promise")
    checks = {
        "has_export": c.rlike(r"export\s+(?:default|const|function|class|\{)"),
        "has_typing": c.rlike(r":\s*[\w.]+(?:\[\])?\s*[=),]|interface\s+\w+|type\s+\w+\s*[<=]|<[A-Z]\w*>"),
        "handles_errors": ~is_async | c.rlike(r"try\s*\{|\.catch\s*\("),
        "has_required": F.forall(F.coalesce("required", none), covered),
        "avoids_banned": ~F.exists(F.coalesce("banned", none), lambda b: word(low, F.lower(b))),
        "has_names": F.forall(F.coalesce("names", none), lambda n: word(c, n)),
    }
    out = j.select("task_id", "sample_id", *[v.alias(k) for k, v in checks.items()])
    passed = None
    for k in checks:
        passed = F.col(k) if passed is None else passed & F.col(k)
    return out.withColumn("passed", passed)


def pass_rate(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count("*").alias("samples"), F.sum(F.col("passed").cast("long")).alias("passed"), F.avg(F.col("passed").cast("int")).alias("pass_rate"))
