"""Content-hash deltas and incremental scans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltscope.functions import text as tx


def hashed(files: DataFrame) -> DataFrame:
    return files.withColumn("content_hash", tx.content_hash("content"))


def delta(current: DataFrame, state: DataFrame, vcs_changed: DataFrame | None = None) -> DataFrame:
    """new / changed / unchanged / deleted per (repo_id, path).

    Only keys and hashes are shuffled, never contents.  Paths in ``vcs_changed`` count as changed
    whatever their hash says.
    """
    cur = current if "content_hash" in current.columns else hashed(current)
    a = cur.select("repo_id", "path", F.col("content_hash").alias("new_hash"))
    b = state.select("repo_id", "path", F.col("content_hash").alias("old_hash"))
    j = a.join(b, ["repo_id", "path"], "full_outer")
    status = (
        F.when(F.col("new_hash").isNull(), "deleted")
        .when(F.col("old_hash").isNull(), "new")
        .when(F.col("new_hash") != F.col("old_hash"), "changed")
        .otherwise("unchanged")
    )
    out = j.withColumn("status", status)
    if vcs_changed is not None:
        flag = vcs_changed.select("repo_id", "path").distinct().withColumn("_v", F.lit(True))
        out = out.join(flag, ["repo_id", "path"], "left")
        out = out.withColumn("status", F.when((F.col("status") == "unchanged") & F.col("_v"), "changed").otherwise(F.col("status"))).drop("_v")
    return out


def delta_summary(d: DataFrame) -> DataFrame:
    """Counts per status and the share of current files whose findings can be reused."""
    n = {s: F.sum((F.col("status") == s).cast("long")).alias(s) for s in ("new", "changed", "unchanged", "deleted")}
    out = d.groupBy("repo_id").agg(*n.values())
    total = F.col("new") + F.col("changed") + F.col("unchanged")
    return out.withColumn("hit_rate", F.when(total > 0, F.col("unchanged") / total).otherwise(0.0))


def incremental_scan(
    files: DataFrame,
    state: DataFrame,
    state_findings: DataFrame,
    scan_fn: Callable[[DataFrame], DataFrame],
    vcs_changed: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Findings and new state after a scan that reads only what changed.

    Returns (findings, state).  Unchanged files keep their findings, deleted ones lose them; the
    caller writes both as the next snapshot.
    """
    cur = hashed(files)
    d = delta(cur, state, vcs_changed)
    todo = d.filter(F.col("status").isin("new", "changed")).select("repo_id", "path")
    keep = d.filter(F.col("status") == "unchanged").select("repo_id", "path")
    fresh = scan_fn(files.join(todo, ["repo_id", "path"], "left_semi"))
    reused = state_findings.join(keep, ["repo_id", "path"], "left_semi")
    return reused.unionByName(fresh, allowMissingColumns=True), cur.select("repo_id", "path", "content_hash")


def restrict_to_diff(files: DataFrame, diff_files: DataFrame) -> DataFrame:
    return files.join(diff_files.select("repo_id", "path"), ["repo_id", "path"], "left_semi")


def append_versions(new: DataFrame, existing: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Versions to append, keyed by (user_id, repo_url, content hash); ``reason`` is null, or says why one is refused."""
    long = F.lit(False) if max_chars is None else F.length("content") > max_chars
    n = new.withColumn("content_hash", tx.content_hash("content")).withColumn("reason", F.when(long, "content-too-long"))
    n = n.dropDuplicates(["user_id", "repo_url", "content_hash"])
    return n.join(existing.select("user_id", "repo_url", "content_hash"), ["user_id", "repo_url", "content_hash"], "left_anti")


def validate_upload(files: DataFrame, max_files: int = 500) -> DataFrame:
    """Adds ``reason`` (null when valid) to files(upload_id, path, content)."""
    p = F.col("path")
    reason = (
        F.when(p.isNull() | (p == ""), "empty-path")
        .when(F.length(p) > 500, "path-too-long")
        .when(p.contains(".."), "parent-path")
        .when(p.startswith("/") | p.startswith("\\") | p.rlike("^[A-Za-z]:"), "absolute-path")
        .when(p.rlike(r"[\x00-\x1f]"), "control-character")
        .when(F.length("content") > 500_000, "content-too-long")
    )
    sizes = files.groupBy("upload_id").agg(F.count("*").alias("_n"))
    return (
        files.join(sizes, "upload_id")
        .withColumn("reason", F.when(F.col("_n") > max_files, "too-many-files").otherwise(reason))
        .drop("_n")
    )


def duplicate_contents(files: DataFrame) -> DataFrame:
    """Groups of files with equal content: size and first path per hash."""
    return (
        hashed(files).groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("path").alias("first_path"))
        .filter(F.col("copies") > 1)
    )
