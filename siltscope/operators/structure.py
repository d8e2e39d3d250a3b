"""Repository structure: directories, archetype, naming, languages, comments, long functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltscope.functions import numbers as nm
from siltscope.functions import text as tx
from siltscope.operators.emit import flag_any
from siltscope.operators.ordered import first_n
from siltscope.rules import tables as rt

# substring -> label of a directory, first hit wins (fixed values)
DIRECTORY_LABELS = (
    (("components",), "UI components"), (("routes",), "API route handlers"), (("middleware",), "Express middleware"), (("services",), "Business logic services"),
    (("db", "database"), "Database access layer"), (("hooks",), "React hooks"), (("contexts", "context"), "React context providers"),
    (("lib", "utils"), "Utility/helper functions"), (("types",), "TypeScript type definitions"), (("pages",), "Page components / routing"), (("config",), "Configuration"),
    (("modules",), "Feature modules"), (("public",), "Static assets"), (("tests", "__tests__"), "Test files"), (("docs",), "Documentation"), (("api",), "API endpoints"),
    (("schemas",), "Data schemas / validation"),
)

# expected directories per archetype (fixed values)
ARCHETYPES = {
    "react-app": ("src/components", "src/pages", "src/hooks", "src/contexts", "src/lib", "src/types", "public"),
    "express-api": ("src/routes", "src/middleware", "src/services", "src/db", "src/config", "src/types", "src/utils"),
    "next-app": ("app", "components", "lib", "public", "styles", "types"),
    "npm-package": ("src", "dist", "tests", "examples"),
    "agent-sdk": ("src/modules", "src/types", "src/utils", "tests"),
    "generic": ("src", "tests", "docs", "scripts"),
}


def directory_label(d: Column) -> Column:
    out = None
    for needles, label in DIRECTORY_LABELS:
        cond = tx.has(d, *needles)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(F.lit("Other"))


def ancestors(path: Column | str) -> Column:
    """Every directory above a path, shortest first."""
    parts = F.split(path if isinstance(path, Column) else F.col(path), "/")
    n = F.size(parts) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def directory_counts(file_tree: DataFrame) -> DataFrame:
    return file_tree.select("repo_id", F.explode(ancestors("path")).alias("dir")).groupBy("repo_id", "dir").agg(F.count("*").alias("files"))


def directory_breakdown(file_tree: DataFrame, k: int | None = None) -> DataFrame:
    """Largest directories per repository, every ancestor counted, with a label."""
    top = first_n(directory_counts(file_tree), ["repo_id"], [F.desc("files"), F.asc("dir")], k)
    return top.withColumn("label", directory_label(F.col("dir")))


def archetype(file_tree: DataFrame) -> DataFrame:
    p = F.col("path")
    sub = lambda n: flag_any(p.contains(n), "_" + n.strip("/").replace("/", "_").replace(".", "_"))
    f = file_tree.groupBy("repo_id").agg(
        sub("src/components/"), sub("src/pages/"), sub("src/routes/"), sub("src/middleware/"), sub("app/"), sub("next.config"), sub("src/modules/"),
        flag_any(p.startswith("src/modules/"), "_dir_modules"), flag_any(p.startswith("dist/"), "_dir_dist"),
    )
    k = F.col
    kind = (
        F.when(k("_src_components") & k("_src_pages"), "react-app").when(k("_src_routes") & k("_src_middleware"), "express-api")
        .when(k("_app") & k("_next_config"), "next-app").when(k("_src_modules") & k("_dir_modules"), "agent-sdk").when(k("_dir_dist"), "npm-package").otherwise("generic")
    )
    return f.select("repo_id", kind.alias("archetype"))


def missing_directories(file_tree: DataFrame) -> DataFrame:
    """Expected directories of the archetype that no directory name starts with."""
    expected = sorted({d for dirs in ARCHETYPES.values() for d in dirs})
    p = F.col("path")
    # a directory starting with the expected text exists when some path continues it down to a slash
    seen = file_tree.select("repo_id", F.explode(F.array_compact(F.array(*[F.when(p.rlike("^" + d + "[^/]*/"), F.lit(d)) for d in expected]))).alias("dir")).distinct()
    want = F.create_map(*[x for a, dirs in ARCHETYPES.items() for x in (F.lit(a), F.array(*[F.lit(d) for d in dirs]))])
    a = archetype(file_tree)
    need = a.select("repo_id", "archetype", F.explode(want[F.col("archetype")]).alias("dir"))
    return need.join(seen, ["repo_id", "dir"], "left_anti").select("repo_id", "archetype", "dir")


def naming_mix(files: DataFrame) -> DataFrame:
    """Directories of more than three files with more than one naming convention."""
    c = files.select("repo_id", tx.directory("path").alias("dir"), tx.naming_convention(tx.base_name("path")).alias("convention"))
    g = c.groupBy("repo_id", "dir").agg(F.count("*").alias("files"), F.array_sort(F.collect_set("convention")).alias("conventions"))
    return g.filter((F.col("files") > 3) & (F.size("conventions") > 1))


def language_breakdown(files: DataFrame) -> DataFrame:
    """Files, lines and share of lines (one decimal) per language and repository."""
    ext = F.regexp_extract("path", r"(\.[^.]+)$", 1)
    lang = None
    for e, name in rt.LANGUAGE_BY_EXT.items():
        lang = F.when(ext == e, name) if lang is None else lang.when(ext == e, name)
    g = files.select("repo_id", lang.otherwise("Other").alias("language"), tx.line_count("content").cast("long").alias("n"))
    g = g.groupBy("repo_id", "language").agg(F.count("*").alias("files"), F.sum("n").alias("lines"))
    total = g.groupBy("repo_id").agg(F.sum("lines").alias("_t"))
    pct = F.when(F.col("_t") > 0, nm.js_round(F.col("lines") / F.col("_t") * 1000) / 10).otherwise(0.0)
    return g.join(total, "repo_id").withColumn("percent", pct).drop("_t")


def comment_ratio(files: DataFrame, k: int | None = 10) -> DataFrame:
    """Comment lines over code lines per file, highest ``k`` per repository."""
    m = files.select(
        "repo_id", "path", tx.line_count("content").alias("lines"), tx.comment_lines("content").alias("comments"), tx.blank_lines("content").alias("blank")
    )
    code = F.col("lines") - F.col("comments") - F.col("blank")
    out = m.withColumn("ratio", F.when(code > 0, F.col("comments") / code).otherwise(0.0)).select("repo_id", "path", "lines", "ratio")
    return first_n(out, ["repo_id"], [F.desc("ratio"), F.asc("path")], k) if k else out


def marker_density(files: DataFrame, k: int | None = 10) -> DataFrame:
    """Work markers per 100 lines, densest ``k`` files per repository."""
    n = tx.rx_count("content", r"(?i)//\s*(?:TASK|FIX_NOW|HACK)")
    m = files.filter(F.col("content").contains("//")).select("repo_id", "path", n.alias("markers"), tx.line_count("content").alias("lines")).filter(F.col("markers") > 0)
    out = m.withColumn("density", F.col("markers") / F.greatest(F.lit(1), F.col("lines")) * 100)
    return first_n(out, ["repo_id"], [F.desc("density"), F.asc("path")], k) if k else out


def structure_findings(files: DataFrame) -> DataFrame:
    """Functions over 50 lines, repeated import lines, mixed module systems."""
    c = F.col("content")
    fn = tx.rx_all(c, r"(?:async\s+)?function\s+\w+\s*\([\s\S]*?(?=\n\})")
    long_fn = (
        files.filter(c.contains("function") & (tx.line_count(c) > 50)).select("repo_id", "path", F.explode(fn).alias("m"))  # no longer than its file
        .withColumn("n", tx.line_count("m")).filter(F.col("n") > 50)
        .select("repo_id", "path", F.lit("large-function").alias("rule"), F.lit("medium").alias("severity"), F.concat_ws(":", F.regexp_extract("m", r"function\s+(\w+)", 1), F.col("n").cast("string")).alias("detail"))
    )
    imp = F.filter(tx.split_lines(c), lambda x: x.startswith("import") & x.rlike(r"""^import\s.*from\s['"].*['"]"""))
    stmt = F.transform(imp, lambda x: F.regexp_extract(x, r"""^import\s.*from\s['"].*['"]""", 0))
    # the second and later copies of a statement in the file's own array, which is bound once
    dup = F.flatten(F.transform(F.array(stmt), lambda s: F.filter(s, lambda x, i: F.array_contains(F.slice(s, F.lit(1), i), x))))
    dups = (
        files.filter(c.contains("import")).select("repo_id", "path", F.explode(dup).alias("m"))
        .select("repo_id", "path", F.lit("duplicate-import").alias("rule"), F.lit("low").alias("severity"), F.substring("m", 1, 60).alias("detail"))
    )
    mixed = files.filter(c.contains("require(") & c.rlike(r"^import\s")).select(
        "repo_id", "path", F.lit("mixed-import-styles").alias("rule"), F.lit("low").alias("severity"), F.lit("").alias("detail")
    )
    return long_fn.unionByName(dups).unionByName(mixed)


def machine_readability(files: DataFrame, test_files: DataFrame | None = None) -> DataFrame:
    """How well tools can edit a repository: size mix 0.35, comment density 0.20, import clarity 0.20, test share 0.25."""
    m = files.select(
        "repo_id", tx.line_count("content").alias("lines"),
        tx.lines_opening_with("content", r"//|#|/\*|\*").alias("comments"),
        F.col("content").rlike(r"""from\s+['"][^'"]+\.css['"]|from\s+['"]!['"]""").alias("odd"),
        F.col("path").rlike(r"\.(?:test|spec)\.[jt]sx?$").alias("is_test"),
    )
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    a = m.groupBy("repo_id").agg(
        F.count("*").alias("files"), F.sum("lines").alias("lines"), F.sum("comments").alias("comments"),
        n(F.col("lines") < 200).alias("small"), n((F.col("lines") >= 200) & (F.col("lines") < 400)).alias("medium"), n(F.col("lines") >= 400).alias("large"),
        n(F.col("odd")).alias("odd"), n(F.col("is_test")).alias("tests"),
    )
    if test_files is not None:
        t = test_files.groupBy("repo_id").agg(F.countDistinct("path").alias("_t"))
        a = a.join(t, "repo_id", "left").withColumn("tests", F.coalesce("_t", F.lit(0))).drop("_t")
    k = F.col
    size = nm.js_round((k("small") * 10 + k("medium") * 6 + k("large") * 2) * 10 / k("files"))
    r = k("comments") / k("lines")
    density = F.when(r < 0.02, 30).when(r < 0.05, 60).when(r <= 0.15, 100).when(r <= 0.25, 80).otherwise(60)
    a = (
        a.withColumn("size_score", size.cast("int")).withColumn("comment_score", density)
        .withColumn("import_score", F.greatest(F.lit(0), 100 - k("odd") * 10).cast("int"))
        .withColumn("test_score", nm.js_round(F.least(F.lit(1.0), k("tests") / k("files")) * 100).cast("int"))
    )
    total = k("size_score") * 35 + k("comment_score") * 20 + k("import_score") * 20 + k("test_score") * 25
    return a.select("repo_id", "files", "size_score", "comment_score", "import_score", "test_score", nm.js_round(total / 100).cast("int").alias("overall"))
