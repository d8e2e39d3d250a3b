"""Production readiness, repository-level rules and portability.

Repository rules are flags over all files of a repository: each file contributes booleans and counts,
and one partial aggregation per repository combines them, so a repository of any size shuffles one
row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltscope.functions import numbers as nm
from siltscope.functions import text as tx
from siltscope.operators.emit import emit, first_index, flag_any, spec
from siltscope.operators.ordered import first_n
from siltscope.rules import tables as rt

FINDING = ("repo_id", "path", "line", "rule", "category", "severity", "confidence", "detail", "ordinal")
SYNC_CALLS = ("execSync", "readFileSync", "writeFileSync", "existsSync", "mkdirSync", "rmSync")


def _find(df: DataFrame, specs: list[tuple]) -> DataFrame:
    return emit(df, specs).select(*FINDING, "points")


def repo_flags(files: DataFrame) -> DataFrame:
    """All content-derived repository facts of this module, in one pass over the files."""
    c = F.col("content")
    health = tx.rx(c, rt.HEALTH_ROUTE) | tx.has(c, "healthcheck", "healthCheck")
    ci = tx.has("path", ".github/workflows/", "gitlab-ci", ".drone.yml", "circleci")
    consoles = F.when(c.contains("console."), tx.lines_containing(c, rt.CONSOLE_CALL)).otherwise(0)
    f = files.select(
        "repo_id",
        tx.has(c, "SIGTERM", "SIGINT", "graceful", "shutdown").alias("shutdown"),
        health.alias("health"),
        (health & tx.has(c, "db", "database", "redis", "status")).alias("health_detail"),
        tx.rx(c, rt.STRUCTURED_LOGGERS).alias("logger"),
        consoles.alias("consoles"),
        tx.has(c, "console.log", "console.error").cast("int").alias("console_file"),
        tx.has(c, "correlationId", "correlation-id", "requestId", "x-request-id").alias("correlation"),
        tx.has(c, "Sentry", "bugsnag", "datadog", "airbrake", "rollbar").alias("tracking"),
        ci.alias("ci"),
        (ci & tx.has(c, "lint", "eslint", "tsc")).alias("ci_lint"),
        (ci & tx.has(c, "test", "jest", "vitest", "pytest")).alias("ci_test"),
        (ci & tx.has(c, "semgrep", "trivy", "codeql", "gitleaks", "snyk", "trufflehog")).alias("ci_security"),
        ((F.col("path") == "package.json") & F.coalesce(F.get_json_object("content", "$.name"), F.get_json_object("content", "$.version"), F.get_json_object("content", "$.dependencies")).isNotNull()
         & (F.coalesce(F.get_json_object("content", "$.license"), F.lit("")) == "")).alias("manifest_no_license"),
        tx.has(c, "prisma.", "pg.", "knex(", "mongodb.").alias("direct_db"),
        tx.has(c, "Repository", "repository").alias("repository_layer"),
        tx.rx(c, r"(?i)mock\s*=\s*true|useMockData|MOCK_MODE|isDev.*mock").alias("mock"),
    )
    flags = ["shutdown", "health", "health_detail", "logger", "correlation", "tracking", "ci", "ci_lint", "ci_test", "ci_security", "manifest_no_license", "direct_db", "repository_layer", "mock"]
    return f.groupBy("repo_id").agg(
        *[flag_any(F.col(x), x) for x in flags], F.sum("consoles").cast("long").alias("console_calls"), F.sum("console_file").cast("long").alias("console_files")
    )


def tree_flags(file_tree: DataFrame) -> DataFrame:
    """All path-derived repository facts of this module."""
    p = F.col("path")
    low = F.lower(p)
    named = lambda n: (p == n) | p.endswith("/" + n)
    cols = {
        "env_example": tx.has(p, "env.example"),
        "env_template": tx.has(p, ".env.example", ".env.sample"),
        "env_actual": named(".env"),
        "package_lock": p.contains("package-lock.json"),
        "pnpm_lock": p.contains("pnpm-lock.yaml"),
        "yarn_lock": p.contains("yarn.lock"),
        "pnpm_workspace": p.contains("pnpm-workspace.yaml"),
        "changelog": tx.has(p, "changelog", "CHANGELOG"),
        "contributing": tx.has(p, "CONTRIBUTING.md", "contributing"),
        "license": tx.has(p, "LICENSE", "LICENCE"),
        "conduct": p.contains("CODE_OF_CONDUCT.md"),
        "dockerfile": named("Dockerfile"),
        "ci_config": tx.has(p, ".github/workflows", ".gitlab-ci", "Jenkinsfile"),
        "ci_any": tx.has(p, ".github/workflows", ".gitlab-ci", "Jenkinsfile", ".circleci"),
        "package_json": named("package.json"),
        "gitignore": named(".gitignore"),
        "vendored": p.contains("node_modules/"),
        "api_routes": tx.has(p, "api/", "routes/", "controllers/", "server."),
        "api_types": tx.has(p, "openapi", "swagger", "types.ts", "schema.ts"),
        "orm": tx.has(p, "schema.prisma", "drizzle.config"),
        "migrations": tx.has(p, "migrations/", "prisma/migrations"),
        "migration_any": tx.has(p, "migrations/", "migration/", "prisma/migrations"),
        "readme": (low == "readme.md") | low.endswith("/readme.md"),
    }
    ui = tx.ends_with_any(p, ".tsx", ".jsx", ".css", ".svg", ".png")
    backend = tx.ends_with_any(p, ".ts", ".js", ".py", ".go", ".rs", ".java")
    tests = p.rlike(r"(?i)\.(?:test|spec)\.[a-z]+$") | p.contains("__tests__")
    n = lambda c: F.sum(c.cast("long"))
    return file_tree.groupBy("repo_id").agg(
        *[flag_any(v, k) for k, v in cols.items()],
        F.count("*").alias("n_files"), n(ui).alias("n_ui"), n(backend).alias("n_backend"), n(tests).alias("n_tests"),
    )


# --- production readiness ---------------------------------------------------------------------------

def production_files(files: DataFrame, rejections: int | None = None, timeouts: int | None = None) -> DataFrame:
    """File rules: await without any try, blocking calls, network calls without timeout, long literals that look like
    credentials.  ``rejections`` and ``timeouts`` cut the listing of a repository to the first files by path."""
    c = F.col("content")
    ls = tx.split_lines(c)
    base = files.select(
        "repo_id", "path",
        F.when(c.contains("await ") & ~tx.has(c, "try", ".catch(", ".catch ("), first_index(ls, lambda x: tx.strip(x).contains("await "))).otherwise(0).alias("await_line"),
        F.when(tx.has(c, *SYNC_CALLS), first_index(ls, lambda x: tx.has(x, *SYNC_CALLS))).otherwise(0).alias("sync_line"),
        (tx.has(c, "fetch(", "axios(", "http.") & ~tx.has(c, "timeout", "AbortController", "signal")).alias("no_timeout"),
        (c.rlike(r"""['"][A-Za-z0-9+/=]{40,}['"]""") & ~tx.has(c, "example", "test", ".env")).alias("exposed"),
    )
    f = _find(base, [
        spec(F.col("await_line") > 0, "unhandled-rejection", "high", line=F.col("await_line"), category="production"),
        spec(F.col("sync_line") > 0, "sync-blocking", "medium", line=F.col("sync_line"), category="production"),
        spec(F.col("no_timeout"), "missing-timeout", "high", category="production"),
        spec(F.col("exposed"), "config-exposure", "critical", category="production"),
    ]).drop("points")
    if rejections is None and timeouts is None:
        return f
    # one rank per (repository, rule); the rank filter runs before the shuffle
    out = f.filter(~F.col("rule").isin("unhandled-rejection", "missing-timeout"))
    for rule, n in (("unhandled-rejection", rejections), ("missing-timeout", timeouts)):
        out = out.unionByName(first_n(f.filter(F.col("rule") == rule), ["repo_id"], [F.asc("path")], n))
    return out


def production_readiness(files: DataFrame, file_tree: DataFrame) -> DataFrame:
    """File rules plus what a repository lacks: shutdown handler, health route, logger, env template."""
    flags = repo_flags(files).select("repo_id", "shutdown", "health", "logger", "console_files")
    tree = tree_flags(file_tree).select("repo_id", "env_example")
    j = flags.join(tree, "repo_id", "full_outer").na.fill(False).na.fill(0).withColumn("path", F.lit(""))
    lack = _find(j, [
        spec(~F.col("shutdown"), "no-graceful-shutdown", "high", category="production"),
        spec(~F.col("health"), "missing-healthcheck", "high", category="production"),
        spec(~F.col("logger") & (F.col("console_files") > 5), "insufficient-logging", "low", F.col("console_files"), category="production"),
        spec(~F.col("env_example"), "missing-env", "medium", category="production"),
    ]).drop("points").withColumn("ordinal", F.col("ordinal") + 10)
    return production_files(files).select(*FINDING).unionByName(lack)


def readiness(findings: DataFrame) -> DataFrame:
    """not-ready with any critical finding, needs-work above three high ones, else ready."""
    n = lambda s: F.sum((F.col("severity") == s).cast("long"))
    out = findings.groupBy("repo_id").agg(n("critical").alias("blockers"), n("high").alias("high"), F.count("*").alias("findings"))
    return out.withColumn("readiness", F.when(F.col("blockers") > 0, "not-ready").when(F.col("high") > 3, "needs-work").otherwise("ready"))


# --- enterprise dimensions ---------------------------------------------------------------------------

ROUTE = r"""router\.(get|post|put|patch|delete|options)\(["']([^"']+)["']"""


def api_surface(files: DataFrame) -> DataFrame:
    """Routes (method, route) of route files."""
    routes = files.filter(tx.has("path", "routes/", "router.", "api/") & F.col("content").contains("router."))
    hit = F.explode(tx.rx_all("content", ROUTE, 0))
    return routes.select("repo_id", "path", hit.alias("m")).select(
        "repo_id", "path", F.upper(F.regexp_extract("m", ROUTE, 1)).alias("method"), F.regexp_extract("m", ROUTE, 2).alias("route")
    )


def api_contracts(files: DataFrame) -> DataFrame:
    """Contract findings of route files and of the files that mount them; ``points`` is the deduction."""
    c, p = F.col("content"), F.col("path")
    route = tx.has(p, "routes/", "router.", "api/")
    base = files.select(
        "repo_id", "path",
        (route & (tx.rx_count(c, r"\.json\(\{") > 2) & (tx.rx_count(c, r"\{.*error.*\}") == 0)).alias("no_error_schema"),
        (route & c.contains("req.body") & ~tx.has(c, "zod", "yup", "validate", "Joi", "ajv")).alias("raw_body"),
        (route & c.contains("router.") & c.contains("function(") & ~c.contains("async")).alias("sync_handler"),
        (tx.ends_with_any(p, "app.ts", "index.ts") & c.contains("app.use(") & c.contains("/api/") & ~tx.has(c, "/v1/", "/v2/")).alias("no_version"),
    )
    k = F.col
    return _find(base, [
        spec(k("no_error_schema"), "inconsistent-error-schema", "high", category="api", points=10),
        spec(k("raw_body"), "untyped-request", "high", category="api", points=15),
        spec(k("sync_handler"), "synchronous-handler", "medium", category="api", points=5),
        spec(k("no_version"), "missing-versioning", "medium", category="api", points=8),
    ])


def _repo_findings(flags: DataFrame, specs: list[tuple]) -> DataFrame:
    return _find(flags.withColumn("path", F.lit("")), specs)


def observability(flags: DataFrame) -> DataFrame:
    k = F.col
    return _repo_findings(flags, [
        spec(~k("logger"), "no-structured-logging", "high", k("console_calls"), category="observability", points=20),
        spec(~k("logger") & (k("console_calls") > 5), "console-log-in-production", "high", k("console_calls"), category="observability", points=10),
        spec(k("health") & ~k("health_detail"), "no-health-check-detail", "medium", category="observability", points=10),
        spec(~k("correlation"), "no-correlation-ids", "high", category="observability", points=15),
        spec(~k("tracking"), "no-error-tracking", "medium", category="observability", points=8),
    ])


def build_ci(tree: DataFrame, flags: DataFrame) -> DataFrame:
    k = F.col
    j = tree.join(flags.select("repo_id", "ci", "ci_lint", "ci_test", "ci_security"), "repo_id", "full_outer").na.fill(False)
    return _repo_findings(j, [
        spec(~(k("package_lock") | k("pnpm_lock") | k("yarn_lock")), "no-lockfile", "critical", category="build", points=30),
        spec(k("package_lock") & k("pnpm_workspace"), "mixed-package-managers", "high", category="build", points=15),
        spec(~k("ci"), "no-lint-in-ci", "high", "no workflow files", category="build", points=20),
        spec(k("ci") & ~k("ci_lint"), "no-lint-in-ci", "high", category="build", points=10),
        spec(k("ci") & ~k("ci_test"), "no-test-in-ci", "critical", category="build", points=25),
        spec(k("ci") & ~k("ci_security"), "no-security-scan-in-ci", "high", category="build", points=15),
        spec(~k("changelog"), "no-changelog", "medium", category="build", points=5),
        spec(~k("contributing"), "no-contributing", "low", category="build", points=3),
    ])


def license_rules(tree: DataFrame, flags: DataFrame) -> DataFrame:
    k = F.col
    j = tree.join(flags.select("repo_id", "manifest_no_license"), "repo_id", "full_outer").na.fill(False)
    return _repo_findings(j, [
        spec(~k("license"), "no-license", "critical", category="license", points=40),
        spec(~k("conduct"), "no-code-of-conduct", "low", category="license", points=3),
        spec(k("manifest_no_license"), "no-license", "high", "package.json", category="license", points=15),
    ])


def legacy_patterns(files: DataFrame, minimum: int = 5) -> DataFrame:
    """Uses of legacy constructs per repository above ``minimum``; deduction at most 8 (high) or 4."""
    counts = [
        F.when(F.col("content").contains(needle), tx.rx_count("content", p)).otherwise(0).alias(f"n{i}")
        for i, ((p, _, _), needle) in enumerate(zip(rt.LEGACY_PATTERNS, rt.LEGACY_NEEDLES))
    ]
    sums = files.select("repo_id", *counts).groupBy("repo_id").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(counts))])
    rows = F.array(*[
        F.struct(F.lit(label).alias("rule"), F.lit(sev).alias("severity"), F.col(f"n{i}").alias("uses"), F.least(F.lit(8 if sev == "high" else 4), F.col(f"n{i}")).cast("int").alias("deduction"))
        for i, (_, sev, label) in enumerate(rt.LEGACY_PATTERNS)
    ])
    return sums.select("repo_id", F.explode(F.filter(rows, lambda r: r["uses"] > minimum)).alias("r")).select("repo_id", "r.*")


def db_abstraction(flags: DataFrame) -> DataFrame:
    """Direct database use without a repository layer."""
    return _repo_findings(flags, [spec(F.col("direct_db") & ~F.col("repository_layer"), "no-strangler-fig", "medium", category="debt", points=10)])


# fixed values
ENTERPRISE_WEIGHTS = {"api": 0.15, "observability": 0.20, "build": 0.20, "coupling": 0.10, "license": 0.20, "debt": 0.15}


def enterprise_score(files: DataFrame, file_tree: DataFrame, coupling_findings: DataFrame) -> DataFrame:
    """Six dimension scores, their weighted sum and the number of critical blockers per repository."""
    from siltscope.operators.matching import repeated_hardcoded_urls

    flags, tree = repo_flags(files), tree_flags(file_tree)
    repos = file_tree.select("repo_id").union(files.select("repo_id")).distinct()
    api, obs, ci, lic = api_contracts(files), observability(flags), build_ci(tree, flags), license_rules(tree, flags)
    debt = (
        legacy_patterns(files).select("repo_id", F.col("deduction").cast("double").alias("points"))
        .unionByName(repeated_hardcoded_urls(files).select("repo_id", F.col("deduction").cast("double").alias("points")))
        .unionByName(db_abstraction(flags).select("repo_id", "points"))
    )
    parts = {"api": api, "observability": obs, "build": ci, "coupling": coupling_findings, "license": lic, "debt": debt}
    lost = None
    for name, f in parts.items():
        one = f.select("repo_id", F.lit(name).alias("dim"), F.col("points").cast("double").alias("points"))
        lost = one if lost is None else lost.unionByName(one)
    wide = lost.groupBy("repo_id").pivot("dim", list(parts)).agg(F.sum("points"))
    crit = None
    for f in (api, obs, ci, lic):
        one = f.filter("severity = 'critical'").select("repo_id")
        crit = one if crit is None else crit.union(one)
    blockers = crit.groupBy("repo_id").agg(F.count("*").alias("critical_blockers"))
    out = repos.join(wide, "repo_id", "left").join(blockers, "repo_id", "left")
    scores = [F.greatest(F.lit(0), 100 - F.coalesce(F.col(n), F.lit(0.0))).cast("int").alias(n) for n in parts]
    out = out.select("repo_id", *scores, F.coalesce("critical_blockers", F.lit(0)).alias("critical_blockers"))
    total = sum((F.col(n) * w for n, w in ENTERPRISE_WEIGHTS.items()), F.lit(0.0))
    return out.withColumn("overall", nm.js_round(F.round(total, 6)).cast("int"))


# --- portability and builder signals ---------------------------------------------------------------------

def portability(file_tree: DataFrame, secrets: DataFrame) -> DataFrame:
    """Five checks per repository as rows; ``secrets`` is hardcoded_secret()'s result."""
    t = tree_flags(file_tree).join(secrets, "repo_id", "left").na.fill(False, ["hardcoded_secret"])
    k = F.col
    checks = {
        "secrets-externalized": k("env_template") & ~k("hardcoded_secret"),
        "deploy-reproducible": k("dockerfile") | k("ci_config"),
        "git-history-usable": k("gitignore") & ~k("vendored"),
        "apis-in-code": k("api_routes") & (k("api_types") | k("package_json")),
        "migrations-present": ~k("orm") | k("migrations"),
    }
    rows = F.array(*[F.struct(F.lit(n).alias("check"), c.alias("passed")) for n, c in checks.items()])
    return t.select("repo_id", F.explode(rows).alias("c")).select("repo_id", "c.*")


def portability_score(checks: DataFrame) -> DataFrame:
    return checks.groupBy("repo_id").agg(
        F.sum(F.col("passed").cast("int")).cast("int").alias("passed"), nm.js_round(F.avg(F.col("passed").cast("int")) * 100).cast("int").alias("score")
    )


def builder_signals(file_tree: DataFrame, files: DataFrame) -> DataFrame:
    """Signals of generated projects: UI-heavy, few tests, no readme, no migrations, no env template, mocks, no CI."""
    t = tree_flags(file_tree).join(repo_flags(files).select("repo_id", "mock"), "repo_id", "left").na.fill(False, ["mock"])
    k = F.col
    return _repo_findings(t, [
        spec((k("n_ui") > 0) & (k("n_backend") > 0) & (k("n_ui") / (k("n_backend") + 1) > 3), "ui-heavy", "info"),
        spec(k("n_tests") == 0, "no-tests", "warning"),
        spec((k("n_tests") > 0) & (k("n_tests") < 3) & (k("n_files") > 20), "sparse-tests", "warning", k("n_tests")),
        spec(~k("readme"), "no-readme", "warning"),
        spec(~k("migration_any") & k("orm"), "no-migrations", "critical"),
        spec(~k("env_template") & k("env_actual"), "missing-env-strategy", "critical"),
        spec(k("mock"), "mock-data-detected", "warning"),
        spec(~k("ci_any"), "no-ci", "info"),
    ]).select("repo_id", "rule", "severity", "detail")


# marker substrings per technology (fixed values)
STACK_MARKERS = {
    "Vite": ("vite.config.ts", "vite.config.js"),
    "Next.js": ("next.config.js", "next.config.ts", "next.config.mjs"),
    "React": ("react", "jsx", "tsx"),
    "Supabase": ("supabase", "@supabase/supabase-js"),
    "Stripe": ("stripe", "@stripe/stripe-js"),
    "Tailwind": ("tailwind.config.js", "tailwind.config.ts"),
    "Prisma": ("prisma/schema.prisma", "schema.prisma"),
    "Drizzle": ("drizzle.config.ts", "drizzle.config.js"),
    "Express": ("express",),
    "Fastify": ("fastify",),
    "tRPC": ("trpc", "@trpc/server"),
    "Shadcn": ("components/ui", "shadcn"),
    "Clerk": ("@clerk/nextjs", "@clerk/clerk-sdk"),
    "Resend": ("resend", "@resend/node"),
    "Vercel": ("vercel.json", ".vercel"),
    "Railway": ("railway.json",),
    "Docker": ("dockerfile", "docker-compose.yml"),
}


def detect_stack(file_tree: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """(repo_id, technology) whose marker occurs in a path or a package manifest (repo_id, content)."""
    def names(col: Column) -> Column:
        low = F.lower(col)
        return F.array_compact(F.array(*[F.when(tx.has(low, *m), F.lit(n)) for n, m in STACK_MARKERS.items()]))

    hits = file_tree.select("repo_id", F.explode(names(F.col("path"))).alias("technology"))
    if manifests is not None:
        hits = hits.union(manifests.select("repo_id", F.explode(names(F.col("content"))).alias("technology")))
    return hits.distinct()


def project_stack(manifests: DataFrame) -> DataFrame:
    """Language and tools per repository from root manifests(repo_id, path, content).

    A package.json must be a JSON object; a pyproject.toml wins over a requirements.txt.
    """
    node_deps = F.array_union(
        F.coalesce(F.map_keys(F.from_json(F.get_json_object("content", "$.dependencies"), "map<string,string>")), F.array().cast("array<string>")),
        F.coalesce(F.map_keys(F.from_json(F.get_json_object("content", "$.devDependencies"), "map<string,string>")), F.array().cast("array<string>")),
    )
    is_node = (F.col("path") == "package.json") & F.get_json_object("content", "$").startswith("{")
    rank = F.when(F.col("path") == "pyproject.toml", 2).when(F.col("path") == "requirements.txt", 1).otherwise(0)
    m = manifests.select("repo_id", "content", is_node.alias("node"), F.when(is_node, node_deps).alias("deps"), rank.alias("rank"))
    text = lambda t: F.max_by(F.col("content").contains(t), F.col("rank"))
    has_dep = lambda d: flag_any(F.array_contains("deps", d), d)
    out = m.groupBy("repo_id").agg(
        flag_any(F.col("node"), "node"), has_dep("eslint"), has_dep("vitest"), has_dep("jest"), has_dep("typescript"),
        (F.max("rank") > 0).alias("python"), text("pytest").alias("_p"), text("ruff").alias("_r"), text("flake8").alias("_f"),
    )
    k = F.col
    for name, col in (("pytest", "_p"), ("ruff", "_r"), ("flake8", "_f")):
        out = out.withColumn(name, k("python") & k(col)).drop(col)
    node = F.when(k("typescript"), "typescript/node").otherwise("javascript/node")
    language = F.when(k("node") & k("python"), "mixed").when(k("node"), node).when(k("python"), "python").otherwise("unknown")
    tools = F.array_compact(F.array(F.when(k("eslint"), F.lit("eslint")), F.when(k("vitest"), F.lit("vitest")), F.when(k("pytest"), F.lit("pytest"))))
    return out.withColumn("language", language).withColumn("tools", tools)


# languages whose rule pack carries their own name, and the ones that differ (fixed values)
OWN_PACKS = (
    "typescript", "javascript", "python", "java", "kotlin", "golang", "ruby", "php", "c", "cpp", "csharp", "rust", "swift", "scala", "lua", "elixir",
    "clojure", "haskell", "ocaml", "dart", "terraform", "yaml", "json", "html", "css", "scss", "bash", "sql", "r", "apex", "solidity",
)
OTHER_PACKS = {
    "tsx": ("typescript",), "jsx": ("javascript",), "go": ("golang",), "c++": ("cpp",), "c#": ("csharp",), "dockerfile": ("dockerfile", "docker"),
    "docker": ("dockerfile", "docker"), "hcl": ("terraform",), "yml": ("yaml",), "shell": ("bash",),
}
GENERIC_PACKS = ("p/secrets", "p/owasp-top-ten", "p/generic", "p/security-audit")


def rule_packs(repo_langs: DataFrame, generic: tuple[str, ...] = GENERIC_PACKS) -> DataFrame:
    """(repo_id, pack) for repo_langs(repo_id, language): the language's packs plus the generic ones."""
    low = F.lower(tx.strip("language"))
    own = F.when(low.isin(*OWN_PACKS), F.array(F.concat(F.lit("p/"), low)))
    for lang, packs in OTHER_PACKS.items():
        own = own.when(low == lang, F.array(*[F.lit("p/" + p) for p in packs]))
    packs = F.array_union(F.coalesce(own, F.array().cast("array<string>")), F.array(*[F.lit(g) for g in generic]))
    return repo_langs.select("repo_id", F.explode(packs).alias("pack")).distinct()


def missing_artifacts(file_tree: DataFrame) -> DataFrame:
    """Templates a repository lacks: env example, Dockerfile, CI workflow."""
    t = tree_flags(file_tree)
    rows = F.array_compact(F.array(
        F.when(~F.col("env_example"), F.lit(".env.example")), F.when(~F.col("dockerfile"), F.lit("Dockerfile")), F.when(~F.col("ci_any"), F.lit(".github/workflows/ci.yml"))
    ))
    return t.select("repo_id", F.explode(rows).alias("artifact"))
