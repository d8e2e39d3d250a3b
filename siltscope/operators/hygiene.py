"""Hygiene rules: line rules, block rules, file rules, de-duplication and score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltscope.functions import numbers as nm
from siltscope.functions import text as tx
from siltscope.operators.emit import emit, first_index, spec
from siltscope.operators.matching import FINDING_COLUMNS, match_lines
from siltscope.rules import tables as rt

# literals that are never reported as repeated magic strings (fixed values)
LITERAL_EXEMPT = ("true", "false", "null", "undefined", "GET", "POST", "PUT", "DELETE", "PATCH", "localhost")
_BLOCK_ORDINAL = 100
_FILE_ORDINAL = 200


def _scannable(files: DataFrame) -> DataFrame:
    return files.filter(~tx.ends_with_any("path", *rt.HYGIENE_SKIP_EXT))


def hygiene_lines(files: DataFrame) -> DataFrame:
    """Line-scope hygiene rules, loose equality included."""
    return match_lines(_scannable(files), rt.HYGIENE_LINE_RULES)


def loose_equality(files: DataFrame) -> DataFrame:
    """A bare ``==``; the null and undefined comparisons stay allowed."""
    return match_lines(_scannable(files), [r for r in rt.HYGIENE_LINE_RULES if r.name == "loose-equality"])


def hygiene_blocks(files: DataFrame) -> DataFrame:
    """Rules that look at neighbouring lines; evaluated inside the file's own line array."""
    src = _scannable(files).filter(tx.has("content", "catch", "switch", "function(", "=> {"))
    df = src.select("repo_id", "path", tx.split_lines("content").alias("ls"))
    ls = F.col("ls")

    def item(rule: str, category: str, severity: str, pos, detail):
        return F.struct(
            (pos + 1).cast("int").alias("line"), F.lit(rule).alias("rule"), F.lit(category).alias("category"),
            F.lit(severity).alias("severity"), detail.alias("detail"),
        )

    def empty_catch(x, i):
        t = tx.strip(x)
        later = F.filter(F.slice(ls, i + 2, F.size(ls)), lambda y: tx.strip(y) != "")
        first = F.get(later, F.lit(0))
        opens = t.startswith("catch") & t.endswith("{")
        return F.when(opens, F.when(first.isNull() | tx.strip(first).startswith("}"), item("empty-catch", "error-handling", "critical", i, F.lit(""))))

    def param_reassigned(x, i):
        prev = F.get(ls, i - 1)
        name = F.regexp_extract(x, r"^\s*(\w+)\s*=\s", 1)
        head = prev.contains("function(") | prev.contains("=> {")
        known = F.exists(
            F.slice(ls, F.lit(1), F.greatest(i, F.lit(0))),
            lambda y: y.contains(F.concat(F.lit("("), name)) | y.contains(F.concat(F.lit(", "), name)) | y.contains(F.concat(name, F.lit(":"))),
        )
        return F.when((i > 0) & head & x.rlike(r"^\s*\w+\s*=\s*[^=]") & (name != ""), F.when(known, item("param-reassigned", "mutation-bug", "medium", i, name)))

    def switch_no_default(x, i):
        t = tx.strip(x)
        rest = F.slice(ls, i + 1, F.size(ls))
        end = first_index(rest, lambda y: tx.strip(y) == "}")
        block = F.array_join(F.slice(rest, F.lit(1), F.when(end > 0, end).otherwise(F.size(rest))), "\n")
        return F.when(
            t.startswith("switch(") | t.startswith("switch ("),
            F.when(block.contains("case ") & ~block.contains("default:"), item("switch-no-default", "switch-missing-default", "medium", i, F.lit(""))),
        )

    hits = F.array_compact(
        F.concat(F.transform(ls, empty_catch), F.transform(ls, param_reassigned), F.transform(ls, switch_no_default))
    )
    out = df.select("repo_id", "path", F.explode(hits).alias("h")).select("repo_id", "path", "h.*")
    ordinal = F.when(F.col("rule") == "empty-catch", 0).when(F.col("rule") == "param-reassigned", 1).otherwise(2) + _BLOCK_ORDINAL
    return out.withColumn("confidence", F.lit(1.0)).withColumn("ordinal", ordinal).select(*FINDING_COLUMNS)


def hygiene_files(files: DataFrame) -> DataFrame:
    """File-scope hygiene rules from counts on the content."""
    c = F.col("content")
    df = _scannable(files).select(
        "repo_id",
        "path",
        "content",
        tx.rx_count(c, r"\.then\(").alias("thens"),
        tx.rx_count(c, tx.word("await")).alias("awaits"),
        (tx.rx_count(c, r"setInterval\(") - tx.rx_count(c, r"clearInterval\(")).alias("intervals"),
        tx.rx_count(c, r"addEventListener\(").alias("adds"),
        tx.rx_count(c, r"removeEventListener\(").alias("removes"),
        tx.rx_all(c, r"""["']([a-zA-Z][a-zA-Z0-9_-]{3,})["']""", 1).alias("lits"),
        F.when(c.contains("function"), tx.rx_all(c, r"function\s+\w+\s*\([^)]+\)")).otherwise(F.array().cast("array<string>")).alias("fns"),
        F.when(c.contains("await ") & ~tx.has(c, "async ", "async(", "async ("), first_index(tx.split_lines(c), lambda x: tx.strip(x).contains("await "))).otherwise(0).alias("await_line"),
    ).drop("content")
    not_test = ~F.col("path").contains(".test.")
    ordered = F.array_sort("lits")
    often = F.array_distinct(F.filter(ordered, lambda x, i: x == F.get(ordered, i + 3)))
    often = F.array_except(often, F.lit(list(LITERAL_EXEMPT)))
    df = df.withColumn("often", often).withColumn(
        "magic", F.get(F.filter(F.array_distinct("lits"), lambda x: F.array_contains(F.col("often"), x)), F.lit(0))
    )
    one = emit(
        df,
        [
            spec(F.col("await_line") > 0, "await-outside-async", "high", category="async-hygiene", line=F.col("await_line")),
            spec(not_test & (F.col("thens") > 2) & (F.col("awaits") > 2), "mixed-promise-style", "medium",
                 F.concat_ws("/", F.col("thens").cast("string"), F.col("awaits").cast("string")), category="async-hygiene"),
            spec(not_test & (F.col("intervals") > 0), "interval-not-cleared", "high", F.col("intervals"), category="memory-leak"),
            spec(not_test & (F.col("adds") > F.col("removes")) & (F.col("adds") > 2), "listener-not-removed", "high",
                 F.col("adds") - F.col("removes"), category="memory-leak"),
            spec(F.col("magic").isNotNull(), "magic-string", "low", F.col("magic")),
        ],
    ).drop("points")
    wide = (
        df.select("repo_id", "path", F.explode("fns").alias("fn"))
        .withColumn("n", F.size(F.filter(F.split(F.regexp_extract("fn", r"\(([^)]+)\)", 1), ","), lambda p: p != "")))
        .filter(F.col("n") > 6)
    )
    bloat = emit(
        wide,
        [spec(F.lit(True), "parameter-bloat", "medium",
              F.concat_ws(":", F.regexp_extract("fn", r"function\s+(\w+)", 1), F.col("n").cast("string")))],
    ).drop("points").withColumn("ordinal", F.lit(9))
    return one.unionByName(bloat).withColumn("ordinal", F.col("ordinal") + _FILE_ORDINAL).select(*FINDING_COLUMNS)


# rules whose findings differ by what they matched; the others count once per file
_KEEP_DETAIL = ("null-safety", "bool-literal-compare", "parse-int-radix", "broken-marker", "task-marker",
                "single-letter-name", "param-reassigned", "parameter-bloat", "magic-string")


def hygiene_findings(files: DataFrame) -> DataFrame:
    """All hygiene findings; per file, category and detail only the first one stays."""
    allf = hygiene_lines(files).unionByName(hygiene_blocks(files)).unionByName(hygiene_files(files))
    return dedupe_hygiene(allf)


def dedupe_hygiene(findings: DataFrame) -> DataFrame:
    key = F.when(F.col("rule").isin(*_KEEP_DETAIL), F.concat_ws("|", "rule", "detail")).otherwise(F.col("rule"))
    rest = [c for c in FINDING_COLUMNS if c not in ("repo_id", "path", "category")]
    first = F.min_by(F.struct(*rest), F.struct("ordinal", "line"))
    return (
        findings.withColumn("_k", key).groupBy("repo_id", "path", "category", "_k").agg(first.alias("b"))
        .select("repo_id", "path", "category", "b.*").select(*FINDING_COLUMNS)
    )


def hygiene_report(files: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """Per repository: findings, counts by severity and the score per 100 lines."""
    f = hygiene_findings(files) if findings is None else findings
    sev = {s: F.sum((F.col("severity") == s).cast("long")).alias(s) for s in ("critical", "high", "medium", "low")}
    counts = f.groupBy("repo_id").agg(F.count("*").alias("total"), *sev.values(), F.countDistinct("category").alias("categories"))
    size = files.groupBy("repo_id").agg(F.sum(tx.line_count("content").cast("long")).alias("lines"))
    filled = size.join(counts, "repo_id", "left").na.fill(0, ["total", "critical", "high", "medium", "low", "categories"])
    score = nm.js_round(nm.clamp(100 - F.col("total") / F.greatest(F.col("lines"), F.lit(1)) * 100 * 10, 0.0, 100.0))
    return filled.withColumn("score", score.cast("int"))
