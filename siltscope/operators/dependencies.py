"""Declared dependencies against imports and known packages.

deps(repo_id, manifest_path, kind, name, version) with kind ``prod`` or ``dev``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltscope.functions import text as tx

# --- fixed values ---------------------------------------------------------------------------
DEPRECATED = (
    "request", "moment", "underscore", "chalk", "express-validator", "body-parser", "bluebird", "gulp", "jade",
    "node-sass", "react-helmet", "recompose", "material-ui",
)
LATEST_MAJOR = {
    "react": 19, "react-dom": 19, "next": 15, "vue": 3, "angular": 19, "express": 5, "typescript": 5.9, "prisma": 6, "@prisma/client": 6,
    "vite": 7, "webpack": 6, "tailwindcss": 4, "postcss": 9, "eslint": 9, "prettier": 4, "jest": 30, "vitest": 3,
}
USED_BUT_NOT_IMPORTED = (
    "typescript", "prisma", "@prisma/client", "vite", "@vitejs/plugin-react", "vitest", "tailwindcss", "postcss", "autoprefixer", "tsx",
    "electron", "electron-builder", "dotenv", "turbo", "prettier", "eslint", "@tailwindcss/vite", "happy-dom", "@testing-library/jest-dom",
    "@testing-library/react", "@vitest/coverage-v8", "tw-animate-css", "tailwind-merge",
)
KNOWN_PHANTOMS = (
    "python-binance", "discord.py", "beautifulsoup", "sklearn", "PIL", "cv2", "axios-fetch", "react-native-vector-icons", "github.com/golang/dep",
)
BUILTINS = {
    "ts": ("fs", "path", "os", "http", "https", "url", "querystring", "crypto", "zlib", "stream", "buffer", "child_process", "cluster", "net", "tls",
           "fs/promises", "util", "events", "assert", "async_hooks", "perf_hooks", "worker_threads", "diagnostics_channel"),
    "js": (),
    "py": ("os", "sys", "io", "re", "math", "json", "datetime", "time", "random", "collections", "functools", "itertools", "pathlib", "typing", "abc",
           "asyncio", "contextlib", "logging", "unittest", "pytest", "string", "textwrap", "struct", "enum", "dataclasses"),
    "go": ("fmt", "errors", "io", "os", "strings", "strconv", "time", "context", "sync", "testing", "net/http", "encoding/json", "encoding/xml",
           "crypto/sha256", "path/filepath", "sort", "math", "regexp"),
    "rs": ("std", "core", "alloc", "collections", "vec"),
}
LANGUAGE = {".ts": "ts", ".tsx": "ts", ".js": "js", ".jsx": "js", ".py": "py", ".go": "go", ".rs": "rs"}
SPECIFIER = r"""(?:from|require)\s*\(?\s*["']([^"'.][^"'/]*)["']"""

FINDING = ("repo_id", "package", "version", "rule", "severity", "detail")


def _finding(df: DataFrame, rule: str, severity: Column | str, detail: Column | str = "") -> DataFrame:
    sev = severity if isinstance(severity, Column) else F.lit(severity)
    det = detail if isinstance(detail, Column) else F.lit(detail)
    return df.select("repo_id", F.col("name").alias("package"), "version", F.lit(rule).alias("rule"), sev.alias("severity"), det.cast("string").alias("detail"))


def effective_deps(deps: DataFrame) -> DataFrame:
    """One version per package: the dev entry wins where both exist."""
    return deps.groupBy("repo_id", "name").agg(F.max_by("version", F.when(F.col("kind") == "dev", 1).otherwise(0)).alias("version"))


def deprecated_deps(deps: DataFrame) -> DataFrame:
    return _finding(effective_deps(deps).filter(F.col("name").isin(*DEPRECATED)), "deprecated", "high")


def outdated_deps(deps: DataFrame) -> DataFrame:
    """Whole majors behind: three or more critical, two high, one medium (fractions count as such)."""
    latest = F.create_map(*[x for k, v in LATEST_MAJOR.items() for x in (F.lit(k), F.lit(float(v)))])
    d = effective_deps(deps).filter(F.col("name").isin(*LATEST_MAJOR)).withColumn("latest", latest[F.col("name")])
    d = d.withColumn("current", F.expr("try_cast(regexp_extract(version, '(\\\\d+)', 1) AS int)")).filter(F.col("current").isNotNull())
    gap = F.col("latest") - F.col("current")
    d = d.filter(gap >= 1)
    return _finding(d, "outdated", F.when(gap >= 3, "critical").when(gap >= 2, "high").otherwise("medium"), F.round(gap, 1))


def mismatched_deps(deps: DataFrame) -> DataFrame:
    """Packages declared for production and for development."""
    d = deps.groupBy("repo_id", "name").agg(
        F.max(F.when(F.col("kind") == "prod", F.col("version"))).alias("p"), F.max(F.when(F.col("kind") == "dev", F.col("version"))).alias("d")
    ).filter(F.col("p").isNotNull() & F.col("d").isNotNull())
    return _finding(d.withColumn("version", F.concat_ws(" / ", "p", "d")), "mismatched", "high")


def imported_packages(files: DataFrame) -> DataFrame:
    return files.filter(tx.has("content", "from", "require")).select(
        "repo_id", F.explode(F.array_distinct(tx.rx_all("content", SPECIFIER, 1))).alias("name")
    ).distinct()


def unused_deps(deps: DataFrame, packages: DataFrame) -> DataFrame:
    """Declared, never imported: tools, type packages and radix primitives are exempt.

    A scoped import whose text starts with ``@name`` counts as a use of ``name``; it is matched by an
    equi-join on the scope without its sign.
    """
    d = effective_deps(deps)
    live = d.filter(~F.col("name").isin(*USED_BUT_NOT_IMPORTED) & ~F.col("name").startswith("@types/") & ~F.col("name").startswith("@radix-ui/"))
    # every prefix of a scoped name is a name it may stand for
    scoped = F.when(F.col("name").startswith("@"), F.transform(F.sequence(F.lit(2), F.length("name")), lambda i: F.substring("name", F.lit(2), i - 1)))
    used = packages.select("repo_id", F.explode(F.concat(F.array("name"), F.coalesce(scoped, F.array().cast("array<string>")))).alias("name")).distinct()
    return _finding(live.join(used, ["repo_id", "name"], "left_anti"), "unused", "low")


def dependency_findings(deps: DataFrame, packages: DataFrame) -> DataFrame:
    totals = dependency_totals(deps)
    many = totals.filter(F.col("prod") > 50).select(
        "repo_id", F.lit("all").alias("name"), F.concat_ws("+", F.col("prod").cast("string"), F.col("dev").cast("string")).alias("version")
    )
    out = deprecated_deps(deps)
    for f in (outdated_deps(deps), unused_deps(deps, packages), mismatched_deps(deps), _finding(many, "excessive", "medium")):
        out = out.unionByName(f)
    return out


def dependency_totals(deps: DataFrame) -> DataFrame:
    n = lambda k: F.countDistinct(F.when(F.col("kind") == k, F.col("name")))
    return deps.groupBy("repo_id").agg(n("prod").alias("prod"), n("dev").alias("dev"))


def dependency_health(deps: DataFrame, findings: DataFrame) -> DataFrame:
    """Totals, findings and the score 100 - 20/10/5/2 per finding."""
    pts = F.when(F.col("severity") == "critical", 20).when(F.col("severity") == "high", 10).when(F.col("severity") == "medium", 5).otherwise(2)
    f = findings.groupBy("repo_id").agg(F.sum(pts).alias("lost"), F.count("*").alias("findings"), F.sum((F.col("rule") == "unused").cast("long")).alias("unused"))
    out = dependency_totals(deps).join(f, "repo_id", "left").na.fill(0)
    return out.select("repo_id", "prod", "dev", "findings", "unused", (F.col("prod") > 50).alias("excessive"), F.greatest(F.lit(0), 100 - F.col("lost")).cast("int").alias("score"))


# --- phantom imports --------------------------------------------------------------------------------

def import_statements(files: DataFrame) -> DataFrame:
    """(repo_id, path, line, name, language) of imports of packages, by the language's own syntax."""
    lang_map = F.create_map(*[x for k, v in LANGUAGE.items() for x in (F.lit(k), F.lit(v))])
    src = files.withColumn("language", lang_map[F.lower(tx.extension("path"))]).filter(F.col("language").isNotNull())
    src = src.filter(tx.has("content", "import", "require", "use ", '"'))
    ln = src.select("repo_id", "path", "language", F.posexplode(tx.split_lines("content")).alias("pos", "text"))
    ln = ln.filter(tx.has("text", "import", "require", "use ") | (F.col("language") == "go"))
    t = F.col("text")
    g = lambda p: F.regexp_extract(t, p, 1)
    static = g(r"""^\s*import\s+(?:[\w*${},\s]+\s+from\s+)?["']([^"']+)["']""")
    dynamic = g(r"""import\s*\(\s*["']([^"']+)["']""")
    required = g(r"""require\s*\(\s*["']([^"']+)["']""")
    node = F.regexp_replace(F.when(static != "", static).when((dynamic != "") & ~dynamic.startswith("."), dynamic).otherwise(required), "^node:", "")
    py_from, py_import = g(r"^\s*from\s+([\w.]+)\s+import"), g(r"^\s*import\s+([\w.]+)")
    py = F.element_at(F.split(F.when(py_from != "", py_from).otherwise(py_import), r"\."), 1)
    go_one, go_block = g(r'^\s*import\s+"([^"]+)"'), g(r'^\s*"([^"]+)"\s*$')
    go = F.when(go_one != "", go_one).otherwise(go_block)
    rs = g(r"^\s*use\s+([\w:]+)(?:\s*as\s+\w+)?\s*;")
    lang = F.col("language")
    name = F.when(lang.isin("ts", "js"), node).when(lang == "py", py).when(lang == "go", go).otherwise(rs)
    return ln.select("repo_id", "path", (F.col("pos") + 1).alias("line"), name.alias("name"), "language").filter(
        (F.col("name") != "") & ~F.col("name").startswith(".") & ~F.col("name").contains("${")
    )


def _builtin(name: Column, lang: Column) -> Column:
    out = F.lit(False)
    for k, names in BUILTINS.items():
        if names:
            out = out | ((lang == k) & name.isin(*names))
    return out


def _cut(length: Column, part: int, parts: int) -> Column:
    return F.floor(length * part / parts).cast("int")


def nearest_names(missing: DataFrame, known: DataFrame, limit: int = 2) -> DataFrame:
    """Nearest known name per missing name within ``limit`` edits, ignoring case; ties go to the smaller name.

    A known name is cut into ``limit + 1`` segments.  Edits can touch at most ``limit`` of them, so one stands unchanged in the
    other name, moved by at most ``limit`` places: candidates come from an equality join on (length, segment, text), with as
    many rows per name whatever its length, and are then measured.
    """
    parts = limit + 1
    low = F.lower("known")
    n = F.length(low)
    segments = [F.struct(n.alias("len"), F.lit(i).alias("i"), F.substring(low, _cut(n, i, parts) + 1, _cut(n, i + 1, parts) - _cut(n, i, parts)).alias("seg")) for i in range(parts)]
    b = known.select("repo_id", F.col("name").alias("known")).distinct().select("repo_id", "known", F.explode(F.array(*segments)).alias("v"))
    name = F.lower("name")
    size = F.length(name)

    def windows(length: Column) -> Column:
        out = []
        for i in range(parts):
            start, width = _cut(length, i, parts), _cut(length, i + 1, parts) - _cut(length, i, parts)
            for move in range(-limit, limit + 1):
                fits = (start + move >= 0) & (start + move + width <= size)
                out.append(F.when(fits, F.struct(length.alias("len"), F.lit(i).alias("i"), F.substring(name, start + move + 1, width).alias("seg"))))
        return F.array_compact(F.array(*out))

    lengths = F.sequence(F.greatest(size - limit, F.lit(0)), size + limit)
    a = missing.select("repo_id", "name").distinct().select("repo_id", "name", F.explode(F.array_distinct(F.flatten(F.transform(lengths, windows)))).alias("v"))
    pairs = a.join(b, ["repo_id", "v"]).select("repo_id", "name", "known").distinct()
    d = F.levenshtein(F.lower("name"), F.lower("known"), limit)
    scored = pairs.withColumn("distance", d).filter(F.col("distance") >= 0)
    return scored.groupBy("repo_id", "name").agg(
        F.min_by("known", F.struct("distance", "known")).alias("nearest"), F.min("distance").alias("distance")
    )


def phantom_imports(statements: DataFrame, deps: DataFrame, workspace: DataFrame | None = None) -> DataFrame:
    """Imports of packages that no manifest declares.

    Known phantom names are high; a declared name within two edits makes it a typo (medium), anything
    else a missing dependency (high).  ``deps`` (repo_id, name); ``workspace`` (repo_id, name) lists
    packages the repository itself defines.
    """
    s = statements.filter(~_builtin(F.col("name"), F.col("language"))).withColumn("lname", F.lower("name"))
    if workspace is not None:
        s = s.join(workspace.select("repo_id", "name").distinct(), ["repo_id", "name"], "left_anti")
    known_phantom = F.col("name").isin(*KNOWN_PHANTOMS) | F.col("lname").isin(*KNOWN_PHANTOMS)
    declared = deps.select("repo_id", "name").distinct()
    phantom = s.filter(known_phantom).withColumn("category", F.lit("deprecated-api")).withColumn("severity", F.lit("high")).withColumn("nearest", F.lit(None).cast("string"))
    rest = s.filter(~known_phantom).join(declared, ["repo_id", "name"], "left_anti")
    rest = rest.join(declared.withColumnRenamed("name", "lname"), ["repo_id", "lname"], "left_anti")
    near = nearest_names(rest, declared).select("repo_id", "name", "nearest")
    rest = rest.join(near, ["repo_id", "name"], "left")
    rest = rest.withColumn("category", F.when(F.col("nearest").isNotNull(), "typo").otherwise("missing-dependency"))
    rest = rest.withColumn("severity", F.when(F.col("nearest").isNotNull(), "medium").otherwise("high"))
    cols = ["repo_id", "path", "line", "name", "category", "severity", "nearest"]
    return phantom.select(*cols).unionByName(rest.select(*cols))
