"""Modernity, comment hygiene and naming, and the score made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltscope.functions import numbers as nm
from siltscope.functions import text as tx
from siltscope.operators.emit import flag_any
from siltscope.operators.matching import _bind

REACT_IMPORT = tx.BL + r"""from\s+["']react["']|""" + tx.BL + r"""require\s*\(\s*["']react["']\s*\)|<\s*[A-Z][A-Za-z0-9]*"""
WARNING = r"(?i)" + tx.word("(?:TODO|FIXME|HACK|TASK|FIX_NOW)")
COMMENTED_CODE = (
    r"^(?://|/\*+|\*+)\s*(?:const|let|var|function|class|interface|type|enum|if|else|for|while|switch|try|catch|return|import|export"
    r"|async\s+function|\w+\s*=|.*[;{}])\s*$"
)
CONSOLE = tx.BL + r"console\.(?:log|warn|error|debug)\s*\("


def modernity(files: DataFrame) -> DataFrame:
    """async 30, no callback chains 20, hooks (or no React) 25, TypeScript 25."""
    c, p = F.col("content"), F.col("path")
    f = files.select(
        "repo_id",
        p.rlike(r"(?i)\.tsx?$").alias("typescript"),
        (p.rlike(r"(?i)\.[jt]sx$") | tx.rx(c, REACT_IMPORT)).alias("react"),
        (tx.rx(c, tx.word("await")) | tx.rx(c, tx.word("async"))).alias("uses_async"),
        tx.rx_count(c, r"\.(?:then|catch|finally)\s*\(\s*function" + tx.BR).alias("callbacks"),
        tx.rx_count(c, tx.BL + r"use[A-Z][a-zA-Z0-9]*\s*\(").alias("hooks"),
    ).groupBy("repo_id").agg(
        flag_any(F.col("typescript"), "typescript"), flag_any(F.col("react"), "react"), flag_any(F.col("uses_async"), "uses_async"),
        F.sum("callbacks").alias("callbacks"), F.sum("hooks").alias("hooks"),
    )
    k = F.col
    score = (
        F.when(k("uses_async"), 30).otherwise(0) + F.when(k("callbacks") == 0, 20).otherwise(0)
        + F.when(~k("react") | (k("hooks") > 0), 25).otherwise(0) + F.when(k("typescript"), 25).otherwise(0)
    )
    return f.withColumn("score", score.cast("int"))


def comment_counts(files: DataFrame) -> DataFrame:
    """Per file: commented-out code lines, warning comments, console calls.

    Whether a line lies in a block comment depends on the lines before it, so one fold walks the
    row's own lines; nothing is exploded or shuffled.
    """
    zero = F.struct(F.lit(False).alias("block"), F.lit(0).alias("code"), F.lit(0).alias("warn"), F.lit(0).alias("con"))

    def portion(raw):
        start = F.instr(raw, "/*")
        tail = F.substring(raw, start, F.length(raw))
        end = F.call_function("locate", F.lit("*/"), tail, F.lit(3))
        return tx.strip(F.when(start == 0, raw).when(end == 0, tail).otherwise(F.substring(tail, F.lit(1), end + 1)))

    def line_of(acc, raw, line):
        inside = acc["block"]
        line_comment = ~inside & line.startswith("//")
        opens = ~inside & line.startswith("/*")
        code = ~inside & ~line_comment & ~opens & (line != "")
        at = F.instr(raw, "/*")
        unclosed = (at > 0) & (F.call_function("locate", F.lit("*/"), raw, at + 2) == 0)
        note = F.when(inside | opens, portion(raw)).when(line_comment, line).when(code & unclosed, tx.strip(F.substring(raw, at, F.length(raw))))
        block = F.when(inside | opens, ~raw.contains("*/")).when(code, unclosed).otherwise(F.lit(False))
        plain = F.regexp_replace(F.regexp_replace(raw, r"/\*.*?\*/", " "), "//.*$", "")
        console = F.when(code & raw.contains("console."), tx.rx_count(plain, CONSOLE)).otherwise(0)
        return _bind(F.when((line != "") & note.isNotNull(), note), lambda n: F.struct(
            block.alias("block"),
            (acc["code"] + F.when(n.rlike(tx.java(COMMENTED_CODE)), 1).otherwise(0)).alias("code"),
            (acc["warn"] + F.when(tx.rx(n, WARNING), 1).otherwise(0)).alias("warn"),
            (acc["con"] + console).alias("con"),
        ))

    def step(acc, raw):
        # a line outside of comments that has none of these changes nothing
        plain_line = ~acc["block"] & ~tx.has(raw, *marks)
        return F.when(plain_line, acc).otherwise(_bind(tx.strip(raw), lambda line: line_of(acc, raw, line)))

    marks = ("/*", "//", "console.")
    # lambda bodies are evaluated as written, so what is used twice is bound once
    raws = F.transform(tx.split_lines("content"), lambda x: F.when(x.contains("\r"), F.regexp_replace(x, "\r$", "")).otherwise(x))
    r = F.when(tx.has("content", *marks), F.aggregate(raws, zero, step)).otherwise(F.when(F.col("content").isNotNull(), zero))
    return files.select("repo_id", "path", r.alias("r")).select(
        "repo_id", "path", F.col("r.code").alias("commented_code"), F.col("r.warn").alias("warning_comments"), F.col("r.con").alias("console_calls")
    )


def comment_hygiene(files: DataFrame) -> DataFrame:
    """Per repository: 100 minus 30/10, 15/5 and 15/5 by how often each habit occurs."""
    s = comment_counts(files).groupBy("repo_id").agg(*[F.sum(c).alias(c) for c in ("commented_code", "warning_comments", "console_calls")])

    def lost(c, many, hi, lo):
        return F.when(F.col(c) > many, hi).when(F.col(c) > 0, lo).otherwise(0)

    return s.withColumn("score", (100 - lost("commented_code", 10, 30, 10) - lost("warning_comments", 5, 15, 5) - lost("console_calls", 5, 15, 5)).cast("int"))


CONVENTIONS = ("camelCase", "snake_case", "kebab-case", "PascalCase", "unknown")


def naming_score(file_tree: DataFrame) -> DataFrame:
    """Dominant convention of file stems, its share and the score ladder 100/85/70/45/20."""
    conv = file_tree.select("repo_id", tx.stem_convention(tx.strip(tx.stem("path"))).alias("c"))
    n = conv.groupBy("repo_id").agg(
        F.count("*").alias("total"), *[F.sum((F.col("c") == c).cast("long")).alias(f"_{i}") for i, c in enumerate(CONVENTIONS)]
    )
    top = F.greatest(*[F.col(f"_{i}") for i in range(5)])
    dominant = F.lit(CONVENTIONS[-1])
    for i in reversed(range(5)):
        dominant = F.when(F.col(f"_{i}") == top, CONVENTIONS[i]).otherwise(dominant)
    out = n.withColumn("dominant", dominant).withColumn("_pct", top / F.col("total") * 100).withColumn("_unk", F.col("_4") / F.col("total") * 100)
    p, u = F.col("_pct"), F.col("_unk")
    score = F.when((p >= 90) & (u == 0), 100).when((p >= 80) & (u <= 10), 85).when((p >= 70) & (u <= 20), 70).when(p >= 50, 45).otherwise(20)
    return out.select("repo_id", "total", "dominant", nm.js_round("_pct", 1).alias("consistency"), F.col("_4").alias("unknown"), score.alias("score"))


def vibe_score(files: DataFrame, file_tree: DataFrame) -> DataFrame:
    """0.25 naming + 0.25 modernity + 0.20 hygiene + 0.15 x 75 + 0.15 x 65."""
    j = (
        naming_score(file_tree).select("repo_id", F.col("score").alias("naming"))
        .join(modernity(files).select("repo_id", F.col("score").alias("modernity")), "repo_id")
        .join(comment_hygiene(files).select("repo_id", F.col("score").alias("hygiene")), "repo_id")
    )
    # hundredths as integers keep the rounding exact
    total = F.col("naming") * 25 + F.col("modernity") * 25 + F.col("hygiene") * 20 + 15 * 75 + 15 * 65
    return j.withColumn("overall", nm.js_round(total / 100).cast("int"))
