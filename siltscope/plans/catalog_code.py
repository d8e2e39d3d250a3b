"""Registered queries: analyzers over the derived source files."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltscope.operators import ai_patterns as ai
from siltscope.operators import invisible, production, structure, vibe
from siltscope.operators import dependencies as dp
from siltscope.operators import graph as gr
from siltscope.operators import matching
from siltscope.operators import sessions as ss
from siltscope.plans import driver_tables as dt
from siltscope.plans import oracle as o
from siltscope.plans.registry import lit, query
from siltscope.rules import tables as rt

C = "content"
cnt = lambda p: o.count(C, p)
has = lambda *n: o.contains(C, *n)
LINES = "len(string_split(content, chr(10)))"
T = o.trim("x")

# --- AI patterns ----------------------------------------------------------------------------------------

_DEPTH = f"""dep AS (SELECT repo_id, path, max(d) AS depth FROM (SELECT repo_id, path, ss - least(0, min(ss) OVER w) AS d FROM (
   SELECT repo_id, path, line, sum((CASE WHEN suffix(t, '{{') OR suffix(t, '(') OR suffix(t, '=>') THEN 1 ELSE 0 END) - (CASE WHEN left(t, 1) IN ('}}', ')', ']') THEN 1 ELSE 0 END)) OVER w AS ss
   FROM (SELECT repo_id, path, line, {o.trim('text')} AS t FROM code_lines) WINDOW w AS (PARTITION BY repo_id, path ORDER BY line)) WINDOW w AS (PARTITION BY repo_id, path ORDER BY line)) GROUP BY 1, 2)"""
_AI = f"""{_DEPTH}, m AS (SELECT f.repo_id, f.path, greatest(0, depth) AS depth, {cnt(r'abstract\s+class\s+\w+')} AS abstracts, {cnt(r'@<@interface\s+\w+')} + {cnt(r'@<@type\s+\w+\s*=')} AS types, {cnt(r'@<@function\s+\w+')} AS functions,
   list_filter(list_distinct(list_transform(list_filter(regexp_extract_all(content, {lit(rt.IMPORT_SPECIFIER)}, 1), lambda s: NOT starts_with(s, '.')),
     lambda s: CASE WHEN starts_with(s, '@') THEN array_to_string(string_split(s, '/')[1:2], '/') ELSE string_split(s, '/')[1] END)), lambda s: regexp_matches(string_split(s, '/')[-1], '^[A-Z][a-z]+$') AND NOT contains(s, '.')) AS odd,
   CASE WHEN contains(content, 'async ') AND NOT {has('try {', 'try{', '.catch(', '.catch (')} THEN list_position(list_transform(string_split(content, chr(10)), lambda x: contains(x, 'async ')), true) ELSE 0 END AS async_line,
   {has('innerHTML')} AS inner_html, {has('eval(')} AS evals, contains(content, 'require(') AND regexp_matches(content, '^import\\s') AS mixed, {cnt('@<@any@>@')} AS anys,
   len(list_filter(string_split(content, chr(10)), lambda x: {T} <> '' AND NOT starts_with({T}, '//') AND NOT starts_with({T}, '*'))) AS code_lines,
   {cnt('''["'][A-Z_]{3,}["']''')} AS constants, {has('process.env', '.env', 'config.')} AS env, {cnt(r'new\s+Promise\(')} AS promises, {has('.resolve(', '.reject(')} AS settled, {cnt(r'while\s*\(\s*true\s*\)')} AS loops
   FROM code_files f JOIN dep d ON d.repo_id = f.repo_id AND d.path = f.path),
ai AS (SELECT repo_id, path, unnest(list_filter([
   CASE WHEN depth >= 8 THEN {{'rule': 'spaghetti-nesting', 'severity': 'critical', 'line': 0, 'points': 15, 'n': 1}} END,
   CASE WHEN depth >= 5 AND depth < 8 THEN {{'rule': 'spaghetti-nesting', 'severity': 'medium', 'line': 0, 'points': 5, 'n': 1}} END,
   CASE WHEN types > functions * 2 AND types > 5 THEN {{'rule': 'over-engineering', 'severity': 'high', 'line': 0, 'points': 10, 'n': 1}} END,
   CASE WHEN abstracts > 0 AND functions < 10 THEN {{'rule': 'over-engineering', 'severity': 'medium', 'line': 0, 'points': 8, 'n': 1}} END,
   CASE WHEN len(odd) > 0 THEN {{'rule': 'hallucinated-import', 'severity': 'high', 'line': 0, 'points': 0, 'n': len(odd)}} END,
   CASE WHEN async_line > 0 THEN {{'rule': 'missing-error-boundary', 'severity': 'high', 'line': async_line, 'points': 3, 'n': 1}} END,
   CASE WHEN inner_html THEN {{'rule': 'security-naivety', 'severity': 'high', 'line': 0, 'points': 0, 'n': 1}} END,
   CASE WHEN evals THEN {{'rule': 'security-naivety', 'severity': 'critical', 'line': 0, 'points': 0, 'n': 1}} END,
   CASE WHEN mixed THEN {{'rule': 'inconsistent-pattern', 'severity': 'medium', 'line': 0, 'points': 0, 'n': 1}} END,
   CASE WHEN anys > 10 AND code_lines > 0 AND anys > code_lines * 0.05 THEN {{'rule': 'any-abuse', 'severity': 'medium', 'line': 0, 'points': 5, 'n': 1}} END,
   CASE WHEN constants > 5 AND NOT env THEN {{'rule': 'hardcoded-everything', 'severity': 'medium', 'line': 0, 'points': 3, 'n': 1}} END,
   CASE WHEN promises > 0 AND NOT settled THEN {{'rule': 'promise-garden', 'severity': 'high', 'line': 0, 'points': 0, 'n': 1}} END,
   CASE WHEN loops > 0 THEN {{'rule': 'infinite-loop-risk', 'severity': 'critical', 'line': 0, 'points': 0, 'n': 1}} END], lambda x: x IS NOT NULL)) AS h FROM m)"""
_WEIGHT = "CASE h.rule " + " ".join(f"WHEN {lit(k)} THEN {v}" for k, v in rt.SIGNAL_WEIGHTS.items()) + " ELSE 5 END * h.n"


@query("p18_ai_pattern_scan", f"WITH {dt.CODE_LINES}, {_AI} SELECT repo_id, path, h.rule AS rule, h.severity AS severity, CAST(h.line AS INTEGER) AS line, CAST(h.points AS DOUBLE) AS points, CAST(h.n AS INTEGER) AS occurrences FROM ai")
def p18(spark, sf):
    return ai.ai_pattern_scan(dt.code_files(spark, sf)).select("repo_id", "path", "rule", "severity", "line", "points", "occurrences")


@query("a11_vibe_file_scores", f"WITH {dt.CODE_LINES}, {_AI} SELECT repo_id, path, CAST(least(100, sum({_WEIGHT})) AS INTEGER) AS score, string_agg(DISTINCT h.rule, ',' ORDER BY h.rule) AS signals FROM ai GROUP BY 1, 2")
def a11_files(spark, sf):
    return ai.vibe_file_scores(ai.ai_pattern_scan(dt.code_files(spark, sf))).withColumn("signals", F.array_join("signals", ","))


_SIG = ", ".join(f"CAST(coalesce(sum(h.n) FILTER (WHERE h.rule = {lit(s)}), 0) AS BIGINT) AS {s.replace('-', '_')}" for s in rt.SIGNAL_BREAKDOWN)
_VIBE = f"""{_AI}, vg AS (SELECT repo_id, CAST(sum({_WEIGHT}) AS BIGINT) AS weight, CAST(least(100, sum(h.points)) AS DOUBLE) AS spaghetti, {_SIG} FROM ai GROUP BY 1),
vx AS (SELECT n.repo_id, n.files, coalesce(weight, 0) AS weight, coalesce(spaghetti, 0) AS spaghetti, {', '.join(f"coalesce({s.replace('-', '_')}, 0) AS {s.replace('-', '_')}" for s in rt.SIGNAL_BREAKDOWN)},
  CAST(least(100, floor(coalesce(weight, 0) / files * 2 + coalesce(spaghetti, 0) * 0.3 + 0.5)) AS INTEGER) AS vibe_index
  FROM (SELECT repo_id, count(*) AS files FROM code_files GROUP BY 1) n LEFT JOIN vg ON vg.repo_id = n.repo_id)"""


@query("a11_vibe_index", f"WITH {dt.CODE_LINES}, {_VIBE} SELECT *, CAST(CASE WHEN vibe_index > 0 THEN 100 - vibe_index ELSE 0 END AS INTEGER) AS human_score FROM vx")
def a11(spark, sf):
    files = dt.code_files(spark, sf)
    return ai.vibe_index(ai.ai_pattern_scan(files), files)


@query("j6_duplicate_functions", f"""WITH {dt.CODE_FILES}, f AS (SELECT repo_id, path, unnest(regexp_extract_all(content, '(?:async\\s+)?function\\s+\\w+\\s*\\([^{{]*\\{{[\\s\\S]*?\\n\\}}')) AS fn FROM code_files),
b AS (SELECT repo_id, path, regexp_extract(fn, 'function\\s+(\\w+)', 1) AS name, length({o.trim("regexp_extract(fn, '(?s)\\{(.*)\\}', 1)")}) AS n FROM f)
SELECT repo_id, name, count(*) AS implementations, count(DISTINCT path) AS files FROM b WHERE n > 5 GROUP BY 1, 2 HAVING count(*) > 1""")
def j6(spark, sf):
    return ai.duplicate_functions(dt.code_files(spark, sf), min_body=5)


# --- production and enterprise -------------------------------------------------------------------------------

_ALL = f"{dt.CODE_FILES}, {dt.ROOTS}, allf AS (SELECT * FROM code_files UNION ALL SELECT * FROM root_files)"


def _all(spark, sf):
    return dt.code_files(spark, sf).unionByName(dt.root_files(spark, sf))


_SYNC = production.SYNC_CALLS
_PROD_FILES = f"""pb AS (SELECT repo_id, path,
  CASE WHEN contains(content, 'await ') AND NOT {has('try', '.catch(', '.catch (')} THEN list_position(list_transform(string_split(content, chr(10)), lambda x: contains({T}, 'await ')), true) ELSE 0 END AS aw,
  CASE WHEN {has(*_SYNC)} THEN list_position(list_transform(string_split(content, chr(10)), lambda x: {o.contains('x', *_SYNC)}), true) ELSE 0 END AS sy,
  {has('fetch(', 'axios(', 'http.')} AND NOT {has('timeout', 'AbortController', 'signal')} AS nt,
  regexp_matches(content, '[''"][A-Za-z0-9+/=]{{40,}}[''"]') AND NOT {has('example', 'test', '.env')} AS ex FROM allf),
pf AS (SELECT repo_id, path, aw AS line, 'unhandled-rejection' AS rule, 'high' AS severity FROM pb WHERE aw > 0
  UNION ALL SELECT repo_id, path, 0, 'missing-timeout', 'high' FROM pb WHERE nt
  UNION ALL SELECT repo_id, path, sy, 'sync-blocking', 'medium' FROM pb WHERE sy > 0
  UNION ALL SELECT repo_id, path, 0, 'config-exposure', 'critical' FROM pb WHERE ex)"""
_FLAGS = f"""fl AS (SELECT repo_id, bool_or({has('SIGTERM', 'SIGINT', 'graceful', 'shutdown')}) AS shutdown, bool_or({o.matches(C, rt.HEALTH_ROUTE)} OR {has('healthcheck', 'healthCheck')}) AS health,
  bool_or(({o.matches(C, rt.HEALTH_ROUTE)} OR {has('healthcheck', 'healthCheck')}) AND {has('db', 'database', 'redis', 'status')}) AS health_detail, bool_or({o.matches(C, rt.STRUCTURED_LOGGERS)}) AS logger,
  CAST(sum(len(list_filter(string_split(content, chr(10)), lambda x: {o.matches('x', rt.CONSOLE_CALL)}))) AS BIGINT) AS console_calls, count(*) FILTER (WHERE {has('console.log', 'console.error')}) AS console_files,
  bool_or({has('correlationId', 'correlation-id', 'requestId', 'x-request-id')}) AS correlation, bool_or({has('Sentry', 'bugsnag', 'datadog', 'airbrake', 'rollbar')}) AS tracking,
  bool_or({o.contains('path', '.github/workflows/', 'gitlab-ci', '.drone.yml', 'circleci')}) AS ci,
  bool_or({o.contains('path', '.github/workflows/', 'gitlab-ci', '.drone.yml', 'circleci')} AND {has('lint', 'eslint', 'tsc')}) AS ci_lint,
  bool_or({o.contains('path', '.github/workflows/', 'gitlab-ci', '.drone.yml', 'circleci')} AND {has('test', 'jest', 'vitest', 'pytest')}) AS ci_test,
  bool_or({o.contains('path', '.github/workflows/', 'gitlab-ci', '.drone.yml', 'circleci')} AND {has('semgrep', 'trivy', 'codeql', 'gitleaks', 'snyk', 'trufflehog')}) AS ci_security,
  bool_or(path = 'package.json' AND json_valid(content) AND NOT contains(content, '"license"')) AS manifest_no_license,
  bool_or({has('prisma.', 'pg.', 'knex(', 'mongodb.')}) AS direct_db, bool_or({has('Repository', 'repository')}) AS repository_layer,
  bool_or(regexp_matches(content, '(?i)mock\\s*=\\s*true|useMockData|MOCK_MODE|isDev.*mock')) AS mock FROM allf GROUP BY 1)"""
_p = lambda *n: "bool_or(" + o.contains("path", *n) + ")"
_n = lambda n: f"bool_or(path = {lit(n)} OR suffix(path, {lit('/' + n)}))"
_TREE = f"""tr AS (SELECT repo_id, {_p('env.example')} AS env_example, {_p('.env.example', '.env.sample')} AS env_template, {_n('.env')} AS env_actual, {_p('package-lock.json')} AS package_lock, {_p('pnpm-lock.yaml')} AS pnpm_lock,
  {_p('yarn.lock')} AS yarn_lock, {_p('pnpm-workspace.yaml')} AS pnpm_workspace, {_p('changelog', 'CHANGELOG')} AS changelog, {_p('CONTRIBUTING.md', 'contributing')} AS contributing, {_p('LICENSE', 'LICENCE')} AS license,
  {_p('CODE_OF_CONDUCT.md')} AS conduct, {_n('Dockerfile')} AS dockerfile, {_p('.github/workflows', '.gitlab-ci', 'Jenkinsfile')} AS ci_config, {_p('.github/workflows', '.gitlab-ci', 'Jenkinsfile', '.circleci')} AS ci_any,
  {_n('package.json')} AS package_json, {_n('.gitignore')} AS gitignore, {_p('node_modules/')} AS vendored, {_p('api/', 'routes/', 'controllers/', 'server.')} AS api_routes, {_p('openapi', 'swagger', 'types.ts', 'schema.ts')} AS api_types,
  {_p('schema.prisma', 'drizzle.config')} AS orm, {_p('migrations/')} AS migrations, {_p('migrations/', 'migration/')} AS migration_any, bool_or(lower(path) = 'readme.md' OR suffix(lower(path), '/readme.md')) AS readme,
  count(*) AS n_files, count(*) FILTER (WHERE regexp_matches(path, '\\.(tsx|jsx|css|svg|png)$')) AS n_ui, count(*) FILTER (WHERE regexp_matches(path, '\\.(ts|js|py|go|rs|java)$')) AS n_backend,
  count(*) FILTER (WHERE regexp_matches(path, '(?i)\\.(test|spec)\\.[a-z]+$') OR contains(path, '__tests__')) AS n_tests FROM allf GROUP BY 1)"""
_PROD = f"""{_ALL}, {_PROD_FILES}, {_FLAGS}, {_TREE}, pr AS (SELECT * FROM pf
  UNION ALL SELECT repo_id, '', 0, 'no-graceful-shutdown', 'high' FROM fl WHERE NOT shutdown UNION ALL SELECT repo_id, '', 0, 'missing-healthcheck', 'high' FROM fl WHERE NOT health
  UNION ALL SELECT repo_id, '', 0, 'insufficient-logging', 'low' FROM fl WHERE NOT logger AND console_files > 5 UNION ALL SELECT repo_id, '', 0, 'missing-env', 'medium' FROM tr WHERE NOT env_example)"""


@query("p19_production_readiness", f"WITH {_PROD} SELECT repo_id, path, CAST(line AS INTEGER) AS line, rule, severity FROM pr")
def p19(spark, sf):
    f = _all(spark, sf)
    return production.production_readiness(f, f.select("repo_id", "path")).select("repo_id", "path", "line", "rule", "severity")


@query("p20_readiness", f"""WITH {_PROD}, g AS (SELECT repo_id, count(*) FILTER (WHERE severity = 'critical') AS blockers, count(*) FILTER (WHERE severity = 'high') AS high, count(*) AS findings FROM pr GROUP BY 1)
SELECT *, CASE WHEN blockers > 0 THEN 'not-ready' WHEN high > 3 THEN 'needs-work' ELSE 'ready' END AS readiness FROM g""")
def p20(spark, sf):
    f = _all(spark, sf)
    return production.readiness(production.production_readiness(f, f.select("repo_id", "path")))


_ROUTE_SQL = lit(production.ROUTE)


@query("p24_api_surface", f"""WITH {_ALL} SELECT repo_id, path, upper(regexp_extract(m, {_ROUTE_SQL}, 1)) AS method, regexp_extract(m, {_ROUTE_SQL}, 2) AS route FROM (
SELECT repo_id, path, unnest(regexp_extract_all(content, {_ROUTE_SQL})) AS m FROM allf WHERE {o.contains('path', 'routes/', 'router.', 'api/')})""")
def p24s(spark, sf):
    return production.api_surface(_all(spark, sf))


_RT = o.contains("path", "routes/", "router.", "api/")
_API = f"""api AS (SELECT repo_id, path, 'inconsistent-error-schema' AS rule, 'high' AS severity, 10 AS points FROM allf WHERE {_RT} AND {cnt(r'\.json\(\{')} > 2 AND {cnt(r'\{.*error.*\}')} = 0
  UNION ALL SELECT repo_id, path, 'untyped-request', 'high', 15 FROM allf WHERE {_RT} AND contains(content, 'req.body') AND NOT {has('zod', 'yup', 'validate', 'Joi', 'ajv')}
  UNION ALL SELECT repo_id, path, 'synchronous-handler', 'medium', 5 FROM allf WHERE {_RT} AND contains(content, 'router.') AND contains(content, 'function(') AND NOT contains(content, 'async')
  UNION ALL SELECT repo_id, path, 'missing-versioning', 'medium', 8 FROM allf WHERE (suffix(path, 'app.ts') OR suffix(path, 'index.ts')) AND contains(content, 'app.use(') AND contains(content, '/api/') AND NOT {has('/v1/', '/v2/')})"""


@query("p24_api_contracts", f"WITH {_ALL}, {_API} SELECT repo_id, path, rule, severity, CAST(points AS DOUBLE) AS points FROM api")
def p24(spark, sf):
    return production.api_contracts(_all(spark, sf)).select("repo_id", "path", "rule", "severity", "points")


_OBS = """obs AS (SELECT repo_id, 'no-structured-logging' AS rule, 'high' AS severity, 20 AS points FROM fl WHERE NOT logger UNION ALL SELECT repo_id, 'console-log-in-production', 'high', 10 FROM fl WHERE NOT logger AND console_calls > 5
  UNION ALL SELECT repo_id, 'no-health-check-detail', 'medium', 10 FROM fl WHERE health AND NOT health_detail UNION ALL SELECT repo_id, 'no-correlation-ids', 'high', 15 FROM fl WHERE NOT correlation
  UNION ALL SELECT repo_id, 'no-error-tracking', 'medium', 8 FROM fl WHERE NOT tracking)"""


@query("p25_observability", f"WITH {_ALL}, {_FLAGS}, {_OBS} SELECT repo_id, rule, severity, CAST(points AS DOUBLE) AS points FROM obs")
def p25(spark, sf):
    return production.observability(production.repo_flags(_all(spark, sf))).select("repo_id", "rule", "severity", "points")


_CI = """ci AS (SELECT repo_id, 'no-lockfile' AS rule, 'critical' AS severity, 30 AS points FROM tr WHERE NOT (package_lock OR pnpm_lock OR yarn_lock) UNION ALL SELECT repo_id, 'mixed-package-managers', 'high', 15 FROM tr WHERE package_lock AND pnpm_workspace
  UNION ALL SELECT repo_id, 'no-lint-in-ci', 'high', 20 FROM fl WHERE NOT ci UNION ALL SELECT repo_id, 'no-lint-in-ci', 'high', 10 FROM fl WHERE ci AND NOT ci_lint UNION ALL SELECT repo_id, 'no-test-in-ci', 'critical', 25 FROM fl WHERE ci AND NOT ci_test
  UNION ALL SELECT repo_id, 'no-security-scan-in-ci', 'high', 15 FROM fl WHERE ci AND NOT ci_security UNION ALL SELECT repo_id, 'no-changelog', 'medium', 5 FROM tr WHERE NOT changelog UNION ALL SELECT repo_id, 'no-contributing', 'low', 3 FROM tr WHERE NOT contributing)"""
_LIC = """lic AS (SELECT repo_id, 'no-license' AS rule, 'critical' AS severity, 40 AS points FROM tr WHERE NOT license UNION ALL SELECT repo_id, 'no-code-of-conduct', 'low', 3 FROM tr WHERE NOT conduct
  UNION ALL SELECT repo_id, 'no-license', 'high', 15 FROM fl WHERE manifest_no_license)"""


@query("p26_build_ci", f"WITH {_ALL}, {_FLAGS}, {_TREE}, {_CI} SELECT repo_id, rule, severity, CAST(points AS DOUBLE) AS points FROM ci")
def p26(spark, sf):
    f = _all(spark, sf)
    return production.build_ci(production.tree_flags(f.select("repo_id", "path")), production.repo_flags(f)).select("repo_id", "rule", "severity", "points")


@query("p27_license_rules", f"WITH {_ALL}, {_FLAGS}, {_TREE}, {_LIC} SELECT repo_id, rule, severity, CAST(points AS DOUBLE) AS points FROM lic")
def p27(spark, sf):
    f = _all(spark, sf)
    return production.license_rules(production.tree_flags(f.select("repo_id", "path")), production.repo_flags(f)).select("repo_id", "rule", "severity", "points")


_LEGACY = "leg AS (" + " UNION ALL ".join(
    f"SELECT repo_id, {lit(label)} AS rule, {lit(sev)} AS severity, CAST(sum({cnt(p)}) AS BIGINT) AS uses, CAST(least({8 if sev == 'high' else 4}, sum({cnt(p)})) AS INTEGER) AS deduction FROM allf GROUP BY 1 HAVING sum({cnt(p)}) > 5"
    for p, sev, label in rt.LEGACY_PATTERNS) + ")"


@query("p23_legacy_patterns", f"WITH {_ALL}, {_LEGACY} SELECT * FROM leg")
def p23(spark, sf):
    return production.legacy_patterns(_all(spark, sf))


@query("p28_db_abstraction", f"WITH {_ALL}, {_FLAGS} SELECT repo_id, 'no-strangler-fig' AS rule, CAST(10 AS DOUBLE) AS points FROM fl WHERE direct_db AND NOT repository_layer")
def p28(spark, sf):
    return production.db_abstraction(production.repo_flags(_all(spark, sf))).select("repo_id", "rule", "points")


_IMP = f"""imp AS (SELECT repo_id, path AS src, unnest(regexp_extract_all(content, {lit(rt.IMPORT_SPECIFIER)}, 1)) AS specifier FROM allf)"""
_COUP = f"""{_IMP}, coup AS (SELECT repo_id, specifier AS path, 'high-fan-in' AS rule, 'high' AS severity, count(*) AS n, 8 AS points FROM imp WHERE NOT starts_with(specifier, '@types/') GROUP BY 1, 2 HAVING count(*) > 10
  UNION ALL SELECT repo_id, src, 'high-fan-out', 'medium', count(*), 5 FROM imp WHERE NOT starts_with(specifier, '@types/') GROUP BY 1, 2 HAVING count(*) > 20)"""


@query("a12_coupling", f"WITH {_ALL}, {_COUP} SELECT repo_id, path, rule, severity, n, CAST(points AS INTEGER) AS points FROM coup")
def a12(spark, sf):
    return gr.coupling(gr.imports(_all(spark, sf)))


_URLS = " UNION ALL ".join(f"SELECT repo_id, 5 AS points FROM (SELECT repo_id, sum(len(list_filter(string_split(content, chr(10)), lambda x: {o.matches('x', r.pattern)}))) AS n FROM allf GROUP BY 1) WHERE n > 2" for r in rt.URL_RULES)


@query("a13_enterprise_score", f"""WITH {_ALL}, {_FLAGS}, {_TREE}, {_API}, {_OBS}, {_CI}, {_LIC}, {_LEGACY}, {_COUP}, lost AS (
  SELECT repo_id, 'api' AS dim, points, severity FROM api UNION ALL SELECT repo_id, 'observability', points, severity FROM obs UNION ALL SELECT repo_id, 'build', points, severity FROM ci UNION ALL SELECT repo_id, 'license', points, severity FROM lic
  UNION ALL SELECT repo_id, 'coupling', points, 'x' FROM coup UNION ALL SELECT repo_id, 'debt', deduction, 'x' FROM leg UNION ALL SELECT repo_id, 'debt', points, 'x' FROM ({_URLS}) UNION ALL SELECT repo_id, 'debt', 10, 'x' FROM fl WHERE direct_db AND NOT repository_layer),
s AS (SELECT r.repo_id, {', '.join(f"CAST(greatest(0, 100 - coalesce(sum(points) FILTER (WHERE dim = '{d}'), 0)) AS INTEGER) AS {d}" for d in production.ENTERPRISE_WEIGHTS)},
  count(*) FILTER (WHERE severity = 'critical') AS critical_blockers FROM (SELECT DISTINCT repo_id FROM allf) r LEFT JOIN lost ON lost.repo_id = r.repo_id GROUP BY 1)
SELECT *, CAST(floor(round(CAST({' + '.join(f'{d} * {w}' for d, w in production.ENTERPRISE_WEIGHTS.items())} AS DOUBLE), 6) + 0.5) AS INTEGER) AS overall FROM s""")
def a13(spark, sf):
    f = _all(spark, sf)
    return production.enterprise_score(f, f.select("repo_id", "path"), gr.coupling(gr.imports(f)).select("repo_id", "points"))


_SECRET = f"""sec AS (SELECT repo_id, bool_or({o.matches(C, rt.HARDCODED_SECRET)}) AS secret FROM allf WHERE NOT {o.matches('path', rt.SECRET_SKIP_EXT)} AND NOT {o.matches('path', rt.SECRET_SKIP_PATH)} AND (NOT contains(path, '.env') OR contains(path, '.env.example')) GROUP BY 1)"""
_PORT = f"""{_ALL}, {_TREE}, {_SECRET}, pc AS (SELECT tr.repo_id, unnest([{{'k': 'secrets-externalized', 'v': env_template AND NOT coalesce(secret, false)}}, {{'k': 'deploy-reproducible', 'v': dockerfile OR ci_config}}, {{'k': 'git-history-usable', 'v': gitignore AND NOT vendored}},
  {{'k': 'apis-in-code', 'v': api_routes AND (api_types OR package_json)}}, {{'k': 'migrations-present', 'v': NOT orm OR migrations}}]) AS c FROM tr LEFT JOIN sec ON sec.repo_id = tr.repo_id)"""


def _portability(spark, sf):
    f = _all(spark, sf)
    return production.portability(f.select("repo_id", "path"), matching.hardcoded_secret(f))


@query("p29_portability", f"WITH {_PORT} SELECT repo_id, c.k AS \"check\", c.v AS passed FROM pc")
def p29(spark, sf):
    return _portability(spark, sf)


@query("p29_portability_score", f"WITH {_PORT} SELECT repo_id, CAST(count(*) FILTER (WHERE c.v) AS INTEGER) AS passed, CAST(floor(count(*) FILTER (WHERE c.v) / 5 * 100 + 0.5) AS INTEGER) AS score FROM pc GROUP BY 1")
def p29b(spark, sf):
    return production.portability_score(_portability(spark, sf))


@query("p30_builder_signals", f"""WITH {_ALL}, {_TREE}, {_FLAGS}, j AS (SELECT tr.*, mock FROM tr JOIN fl ON fl.repo_id = tr.repo_id)
SELECT repo_id, 'ui-heavy' AS rule, 'info' AS severity FROM j WHERE n_ui > 0 AND n_backend > 0 AND n_ui / (n_backend + 1) > 3 UNION ALL SELECT repo_id, 'no-tests', 'warning' FROM j WHERE n_tests = 0
UNION ALL SELECT repo_id, 'sparse-tests', 'warning' FROM j WHERE n_tests > 0 AND n_tests < 3 AND n_files > 20 UNION ALL SELECT repo_id, 'no-readme', 'warning' FROM j WHERE NOT readme
UNION ALL SELECT repo_id, 'no-migrations', 'critical' FROM j WHERE NOT migration_any AND orm UNION ALL SELECT repo_id, 'missing-env-strategy', 'critical' FROM j WHERE NOT env_template AND env_actual
UNION ALL SELECT repo_id, 'mock-data-detected', 'warning' FROM j WHERE mock UNION ALL SELECT repo_id, 'no-ci', 'info' FROM j WHERE NOT ci_any""")
def p30(spark, sf):
    f = _all(spark, sf)
    return production.builder_signals(f.select("repo_id", "path"), f).drop("detail")


_STACK = "[" + ", ".join(f"CASE WHEN {o.contains('t', *m)} THEN {lit(n)} END" for n, m in production.STACK_MARKERS.items()) + "]"


@query("p30_detect_stack", f"""WITH {_ALL} SELECT DISTINCT repo_id, technology FROM (SELECT repo_id, unnest({_STACK}) AS technology FROM (
SELECT repo_id, lower(path) AS t FROM allf UNION ALL SELECT repo_id, lower(content) FROM allf WHERE path = 'package.json')) WHERE technology IS NOT NULL""")
def p30b(spark, sf):
    f = _all(spark, sf)
    return production.detect_stack(f.select("repo_id", "path"), f.filter("path = 'package.json'"))


_J = "CASE WHEN path = 'package.json' AND json_valid(content) AND starts_with(content, '{') THEN content END"


@query("p31_project_stack", f"""WITH {dt.ROOTS}, m AS (SELECT repo_id, path, content, {_J} AS js FROM root_files), d AS (SELECT repo_id, path, js, content,
  list_concat(coalesce(json_keys(js, '$.dependencies'), []), coalesce(json_keys(js, '$.devDependencies'), [])) AS deps FROM m),
g AS (SELECT repo_id, bool_or(js IS NOT NULL) AS node, {", ".join(f"coalesce(bool_or(list_contains(deps, '{t}')) FILTER (WHERE js IS NOT NULL), false) AS {t}" for t in ("eslint", "vitest", "jest", "typescript"))},
  bool_or(path IN ('pyproject.toml', 'requirements.txt')) AS python, arg_max(content, path = 'pyproject.toml') FILTER (WHERE path IN ('pyproject.toml', 'requirements.txt')) AS py FROM d GROUP BY 1)
SELECT repo_id, CASE WHEN node AND python THEN 'mixed' WHEN node AND typescript THEN 'typescript/node' WHEN node THEN 'javascript/node' WHEN python THEN 'python' ELSE 'unknown' END AS language,
  concat_ws(',', CASE WHEN eslint THEN 'eslint' END, CASE WHEN vitest THEN 'vitest' END, CASE WHEN coalesce(contains(py, 'pytest'), false) THEN 'pytest' END) AS tools FROM g""")
def p31(spark, sf):
    return production.project_stack(dt.root_files(spark, sf)).select("repo_id", "language", F.array_join("tools", ",").alias("tools"))


_LANGS = ("TypeScript", "tsx", "python", "Go", "dockerfile", "c++", "cobol", "yml")


@query("p32_rule_packs", f"""WITH l AS (SELECT 'n' || CAST(c_nationkey AS VARCHAR) AS repo_id, list_extract({list(_LANGS)}, CAST(c_custkey % 8 AS INTEGER) + 1) AS language FROM customer)
SELECT DISTINCT repo_id, unnest(list_concat(CASE lower(language) WHEN 'typescript' THEN ['p/typescript'] WHEN 'tsx' THEN ['p/typescript'] WHEN 'python' THEN ['p/python'] WHEN 'go' THEN ['p/golang'] WHEN 'dockerfile' THEN ['p/dockerfile', 'p/docker']
 WHEN 'c++' THEN ['p/cpp'] WHEN 'yml' THEN ['p/yaml'] ELSE [] END, ['p/secrets', 'p/owasp-top-ten', 'p/generic', 'p/security-audit'])) AS pack FROM l""")
def p32(spark, sf):
    c = dt.table(spark, sf, "customer")
    return production.rule_packs(c.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("repo_id"), F.element_at(F.lit(list(_LANGS)), (F.col("c_custkey") % 8 + 1).cast("int")).alias("language")))


@query("p39_missing_artifacts", f"""WITH {_ALL}, {_TREE} SELECT repo_id, '.env.example' AS artifact FROM tr WHERE NOT env_example UNION ALL SELECT repo_id, 'Dockerfile' FROM tr WHERE NOT dockerfile UNION ALL SELECT repo_id, '.github/workflows/ci.yml' FROM tr WHERE NOT ci_any""")
def p39(spark, sf):
    return production.missing_artifacts(_all(spark, sf).select("repo_id", "path"))


# --- invisible bugs -----------------------------------------------------------------------------------------------

@query("p21_invisible_lines", f"""WITH {dt.CODE_LINES}, a AS (
  SELECT repo_id, path, line, text, unnest(regexp_extract_all(text, '\\w+\\.\\w+!')) AS m FROM code_lines), c AS (SELECT repo_id, path, line, unnest(regexp_extract_all(text, '\\(?\\w+\\)?\\s+as\\s+\\w+')) AS m FROM code_lines)
SELECT repo_id, path, line, 'non-null-crash' AS category, 'high' AS severity, 85 AS confidence, m AS detail FROM a WHERE NOT contains(text, '?.' || regexp_extract(m, '\\.(\\w+)!', 1))
UNION ALL SELECT repo_id, path, line, 'non-null-crash', 'medium', 60, m FROM c WHERE NOT starts_with(regexp_extract(m, '^\\(?(\\w+)', 1), 'this') AND NOT starts_with(regexp_extract(m, '^\\(?(\\w+)', 1), 'e') AND length(regexp_extract(m, '^\\(?(\\w+)', 1)) > 1
UNION ALL SELECT repo_id, path, line, 'error-blindspot', 'medium', 55, 'generic' FROM code_lines WHERE contains(text, 'catch') AND contains(text, 'Error') AND NOT contains(text, 'instanceof') AND NOT contains(text, 'type')
UNION ALL SELECT repo_id, path, line, 'timing-bomb', 'high', 80, CAST(CAST(d AS INTEGER) AS VARCHAR) FROM (SELECT *, regexp_extract(text, 'setTimeout\\(.{{0,100}},\\s*(\\d+)\\)', 1) AS d FROM code_lines) WHERE d <> '' AND CAST(d AS INTEGER) BETWEEN 1 AND 499
UNION ALL SELECT repo_id, path, line, 'side-effect-ordering', 'critical', 90, '' FROM code_lines WHERE line <= 5 AND {o.contains('text', 'setInterval(', 'setTimeout(', '.listen(', 'connect(')}""")
def p21a(spark, sf):
    return invisible.invisible_lines(dt.code_files(spark, sf))


@query("p21_invisible_context", f"""WITH {dt.CODE_LINES}, fc AS (SELECT repo_id, path, {cnt(r'(?:async\s+)?function\s+\w+|\w+\s*=\s*async\s*\(')} AS fns FROM code_files),
ff AS (SELECT repo_id, path, min(line) AS first_fn FROM code_lines WHERE regexp_matches(text, 'function \\w') GROUP BY 1, 2),
lv AS (SELECT repo_id, path, line, text, regexp_extract(text, '^\\s*(?:let|var)\\s+(\\w+)', 1) AS name FROM code_lines),
pa AS (SELECT repo_id, path, line, regexp_extract(text, '^\\s*(\\w+)\\s*=\\s*[^=]', 1) AS name FROM code_lines),
ca AS (SELECT c.repo_id, c.path, c.line, string_agg(n.text, chr(10) ORDER BY n.line) AS block FROM (SELECT * FROM code_lines WHERE regexp_matches(text, 'catch\\s*\\(')) c JOIN code_lines n ON n.repo_id = c.repo_id AND n.path = c.path AND n.line BETWEEN c.line AND c.line + 14 GROUP BY 1, 2, 3)
SELECT l.repo_id, l.path, l.line, 'race-condition' AS category, 'critical' AS severity, 70 AS confidence, l.name AS detail FROM lv l JOIN fc ON fc.repo_id = l.repo_id AND fc.path = l.path AND fns >= 2 JOIN ff ON ff.repo_id = l.repo_id AND ff.path = l.path
  WHERE l.name <> '' AND NOT contains(l.text, 'const ') AND EXISTS (SELECT 1 FROM code_lines n WHERE n.repo_id = l.repo_id AND n.path = l.path AND n.line > l.line AND n.line > first_fn AND (contains(n.text, l.name || ' =') OR contains(n.text, l.name || '.push') OR contains(n.text, l.name || '.add')))
UNION ALL SELECT p.repo_id, p.path, p.line, 'implicit-coupling', 'high', 80, p.name FROM pa p WHERE p.name <> '' AND EXISTS (SELECT 1 FROM code_lines n WHERE n.repo_id = p.repo_id AND n.path = p.path AND n.line BETWEEN p.line - 20 AND p.line - 1
  AND ({o.contains('n.text', 'function(', 'function (', '=>')} OR contains(n.text, '(' || p.name) OR contains(n.text, ',' || p.name)))
UNION ALL SELECT repo_id, path, line, 'error-blindspot', 'high', 75, 'log-only' FROM ca WHERE contains(block, 'console.') AND NOT {o.contains('block', 'throw', 'return', 'reject')} AND length(block) < 200""")
def p21b(spark, sf):
    return invisible.invisible_context(dt.code_files(spark, sf))


@query("p21_invisible_files", f"""WITH {dt.CODE_LINES}, fn AS (SELECT repo_id, path, min(line) AS f FROM code_lines WHERE contains(text, 'function') GROUP BY 1, 2),
pu AS (SELECT l.repo_id, l.path, count(*) AS n FROM code_lines l JOIN fn ON fn.repo_id = l.repo_id AND fn.path = l.path WHERE contains(text, '.push(') AND line >= f GROUP BY 1, 2),
mu AS (SELECT repo_id, path, count(*) AS n, min(line) AS f FROM code_lines WHERE regexp_matches(text, {lit(invisible.MUTATION)}) AND NOT {o.contains('text', 'this.', 'const ', 'let ')} GROUP BY 1, 2)
SELECT f.repo_id, f.path, 0 AS line, 'memory-leak' AS category, 'high' AS severity, 65 AS confidence, CAST(n AS VARCHAR) AS detail FROM code_files f JOIN pu ON pu.repo_id = f.repo_id AND pu.path = f.path WHERE {cnt(r'\.push\(')} > 3 AND NOT contains(f.path, '.test.') AND n > 2
UNION ALL SELECT repo_id, path, 0, 'memory-leak', 'critical', 90, '' FROM code_files WHERE {has('on(', 'addListener')} AND NOT {has('off(', 'removeListener')}
UNION ALL SELECT repo_id, path, 0, 'data-corruption', 'medium', 50, '' FROM code_files WHERE regexp_matches(content, '\\{{[\\s\\S]{{0,200}}\\.\\.\\.\\w+[\\s\\S]{{0,200}},\\s*\\w+\\s*:')
UNION ALL SELECT repo_id, path, f, 'data-corruption', 'high', 60, CAST(n AS VARCHAR) FROM mu WHERE n > 3""")
def p21c(spark, sf):
    return invisible.invisible_files(dt.code_files(spark, sf))


# --- vibe ---------------------------------------------------------------------------------------------------------------

_MOD = f"""md AS (SELECT repo_id, bool_or(regexp_matches(path, '(?i)\\.tsx?$')) AS typescript, bool_or(regexp_matches(path, '(?i)\\.[jt]sx$') OR {o.matches(C, vibe.REACT_IMPORT)}) AS react, bool_or({o.matches(C, '@<@await@>@')} OR {o.matches(C, '@<@async@>@')}) AS uses_async,
  CAST(sum({cnt(r'\.(then|catch|finally)\s*\(\s*function@>@')}) AS BIGINT) AS callbacks, CAST(sum({cnt(r'@<@use[A-Z][a-zA-Z0-9]*\s*\(')}) AS BIGINT) AS hooks FROM allf GROUP BY 1),
mdx AS (SELECT *, CAST((CASE WHEN uses_async THEN 30 ELSE 0 END) + (CASE WHEN callbacks = 0 THEN 20 ELSE 0 END) + (CASE WHEN NOT react OR hooks > 0 THEN 25 ELSE 0 END) + (CASE WHEN typescript THEN 25 ELSE 0 END) AS INTEGER) AS score FROM md)"""


@query("p36_modernity", f"WITH {_ALL}, {_MOD} SELECT * FROM mdx")
def p36(spark, sf):
    return vibe.modernity(_all(spark, sf))


@query("p37_comment_hygiene")
def p37(spark, sf):
    """Block-comment state is a fold; checked against a plain Python walk in the tests."""
    return vibe.comment_hygiene(_all(spark, sf))


_NAMING = f"""nm0 AS (SELECT repo_id, regexp_replace(regexp_extract(path, '[^/]*$'), '^(.+)\\.[^.]*$', '\\1') AS s FROM allf),
nm1 AS (SELECT repo_id, CASE WHEN regexp_matches(s, '^[a-z]+(?:[A-Z][a-z0-9]*)*$') THEN 'camelCase' WHEN regexp_matches(s, '^[a-z0-9]+(?:_[a-z0-9]+)*$') THEN 'snake_case' WHEN regexp_matches(s, '^[a-z0-9]+(?:-[a-z0-9]+)*$') THEN 'kebab-case' WHEN regexp_matches(s, '^[A-Z][a-zA-Z0-9]*$') THEN 'PascalCase' ELSE 'unknown' END AS c FROM nm0),
nm2 AS (SELECT repo_id, c, count(*) AS n, list_position(['camelCase', 'snake_case', 'kebab-case', 'PascalCase', 'unknown'], c) AS i FROM nm1 GROUP BY 1, 2),
nm3 AS (SELECT repo_id, CAST(sum(n) AS BIGINT) AS total, arg_max(c, n * 10 - i) AS dominant, max(n) / sum(n) * 100 AS pct, CAST(coalesce(sum(n) FILTER (WHERE c = 'unknown'), 0) AS BIGINT) AS unknown FROM nm2 GROUP BY 1)"""
_NSCORE = "CASE WHEN pct >= 90 AND unknown = 0 THEN 100 WHEN pct >= 80 AND unknown / total * 100 <= 10 THEN 85 WHEN pct >= 70 AND unknown / total * 100 <= 20 THEN 70 WHEN pct >= 50 THEN 45 ELSE 20 END"


@query("a9_naming_score", f"WITH {_ALL}, {_NAMING} SELECT repo_id, total, dominant, floor(pct * 10 + 0.5) / 10 AS consistency, unknown, CAST({_NSCORE} AS INTEGER) AS score FROM nm3")
def a9(spark, sf):
    return vibe.naming_score(_all(spark, sf).select("repo_id", "path"))


@query("a10_vibe_score")
def a10(spark, sf):
    f = _all(spark, sf)
    return vibe.vibe_score(f, f.select("repo_id", "path"))


# --- graph ----------------------------------------------------------------------------------------------------------------

_KEY = lambda p: f"regexp_replace(regexp_replace({p}, '\\.(tsx|ts|jsx|js|mjs|cjs)$', ''), '/index$', '')"
# the derived files only use ./, ../ and one level deep specifiers
_RES = f"""{_IMP}, edge AS (SELECT repo_id, src, specifier, starts_with(specifier, '.') AS is_relative, regexp_replace(src, '/?[^/]*$', '') AS dir FROM imp),
edges AS (SELECT repo_id, src, specifier, is_relative, CASE WHEN starts_with(specifier, './') THEN {_KEY("dir || '/' || substr(specifier, 3)")} WHEN starts_with(specifier, '../') THEN {_KEY("ltrim(regexp_replace(dir, '/?[^/]*$', '') || '/' || substr(specifier, 4), '/')")} ELSE specifier END AS resolved FROM edge)"""


@query("j1_imports", f"WITH {_ALL}, {_RES} SELECT * FROM edges")
def j1(spark, sf):
    return gr.imports(_all(spark, sf)).drop("occurrence")


@query("j2_orphans", f"""WITH {_ALL}, {_RES} SELECT repo_id, path FROM allf f WHERE NOT contains(path, 'index.') AND NOT regexp_matches(path, '(index\\.ts|index\\.tsx|main\\.tsx|app\\.ts|server\\.ts)$')
AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.repo_id = f.repo_id AND e.src = f.path) AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.repo_id = f.repo_id AND e.resolved = {_KEY('f.path')})""")
def j2(spark, sf):
    f = _all(spark, sf)
    return gr.orphans(f, gr.imports(f))


@query("j3_layer_violations", f"""WITH {_ALL}, {_RES}, d AS (SELECT *, regexp_replace(src, '/?[^/]*$', '') AS dir FROM edges)
SELECT repo_id, src AS path, resolved, 'high' AS severity FROM d WHERE {o.contains('dir', 'components', 'pages')} AND {o.contains('resolved', 'db/', 'database')}
UNION ALL SELECT repo_id, src, resolved, 'medium' FROM d WHERE contains(dir, 'routes') AND contains(resolved, 'components') AND NOT contains(resolved, 'layouts')""")
def j3(spark, sf):
    return gr.layer_violations(gr.imports(_all(spark, sf)))


@query("j4_circular_imports", f"""WITH {_ALL}, {_RES}, e AS (SELECT DISTINCT repo_id, src, {_KEY('src')} AS a, resolved AS b FROM edges WHERE is_relative)
SELECT DISTINCT x.repo_id, x.src AS file_a, y.src AS file_b FROM e x JOIN e y ON x.repo_id = y.repo_id AND x.a = y.b AND x.b = y.a WHERE x.src < y.src""")
def j4(spark, sf):
    return gr.circular_imports(gr.imports(_all(spark, sf)))


# five function headers per part, drawn from small overlapping pools
def _sig_files(spark, sf):
    p = dt.spread(dt.table(spark, sf, "part").select("p_partkey"), "p_partkey")
    k = F.col("p_partkey")
    fns = [F.concat(F.lit("export function f"), ((k * m) % n).cast("string"), F.lit("(a) {\n  return a;\n}\n"), F.repeat(F.lit("// pad pad pad pad\n"), F.lit(3))) for m, n in ((1, 211), (3, 97), (7, 389), (11, 53), (2, 601))]
    return p.select(F.concat(F.lit("m"), (k % 3).cast("string")).alias("repo_id"), F.concat(F.lit("src/p"), k.cast("string"), F.lit(".ts")).alias("path"), F.concat(*fns).alias("content"))


_SIGF = """sf AS (SELECT 'm' || CAST(p_partkey % 3 AS VARCHAR) AS repo_id, 'src/p' || CAST(p_partkey AS VARCHAR) || '.ts' AS path, list_distinct(['f' || CAST(p_partkey % 211 AS VARCHAR), 'f' || CAST(p_partkey * 3 % 97 AS VARCHAR), 'f' || CAST(p_partkey * 7 % 389 AS VARCHAR),
  'f' || CAST(p_partkey * 11 % 53 AS VARCHAR), 'f' || CAST(p_partkey * 2 % 601 AS VARCHAR)]) AS sigs FROM part),
sx AS (SELECT repo_id, path, unnest(sigs) AS s FROM sf WHERE len(sigs) >= 3), pr AS (SELECT a.repo_id, a.path, b.path AS other FROM sx a JOIN sx b ON a.repo_id = b.repo_id AND a.s = b.s AND a.path <> b.path GROUP BY 1, 2, 3 HAVING count(*) >= 3)"""


@query("j5_copy_paste", f"WITH {_SIGF} SELECT repo_id, path, min(other) AS partner FROM pr GROUP BY 1, 2")
def j5(spark, sf):
    return gr.copy_paste(_sig_files(spark, sf))


_EXPORT = f"""xl AS (SELECT repo_id, path, line, text, unnest([{{'s': regexp_extract(text, 'export\\s+(?:async\\s+)?function\\s+(\\w+)', 1), 'r': 100}}, {{'s': regexp_extract(text, 'export\\s+(?:const|let|var)\\s+(\\w+)', 1), 'r': 0}},
   {{'s': regexp_extract(text, 'export\\s+(?:default\\s+)?class\\s+(\\w+)', 1), 'r': 200}}]) AS e FROM code_lines WHERE contains(text, 'export')),
xs AS (SELECT repo_id, path, line, e.s AS symbol, e.r AS reach FROM xl WHERE e.s <> ''), cl AS (SELECT repo_id, path, line FROM code_lines WHERE {o.trim('text')} = '}}'), ln AS (SELECT repo_id, path, max(line) AS last FROM code_lines GROUP BY 1, 2),
xe AS (SELECT xs.repo_id, xs.path, xs.line, symbol, reach, last, min(cl.line) AS stop FROM xs JOIN ln ON ln.repo_id = xs.repo_id AND ln.path = xs.path LEFT JOIN cl ON cl.repo_id = xs.repo_id AND cl.path = xs.path AND cl.line > xs.line AND cl.line < xs.line + reach GROUP BY 1, 2, 3, 4, 5, 6),
ex AS (SELECT repo_id, path, line, symbol, CAST(CASE WHEN reach = 0 THEN 1 WHEN stop IS NOT NULL THEN stop - line + 1 ELSE least(last - line, reach - 1) + 1 END AS INTEGER) AS loc FROM xe)"""


@query("w12_declaration_length", f"WITH {dt.CODE_LINES}, {_EXPORT} SELECT * FROM ex")
def w12(spark, sf):
    return gr.declaration_length(dt.code_files(spark, sf))


_CRES = _RES.replace("FROM allf", "FROM code_files")


@query("j7_dead_exports", f"""WITH {dt.CODE_LINES}, {_EXPORT}, {_CRES}, one AS (SELECT repo_id, path, symbol, arg_max(loc, line) AS loc FROM ex GROUP BY 1, 2, 3), many AS (SELECT repo_id, path FROM one GROUP BY 1, 2 HAVING count(*) > 1),
w AS (SELECT repo_id, symbol, min(path) AS lo, max(path) AS hi FROM (SELECT repo_id, path, unnest(regexp_extract_all(content, '\\w+')) AS symbol FROM code_files) GROUP BY 1, 2),
d AS (SELECT o.repo_id, o.path, o.symbol, loc, CASE WHEN regexp_matches(o.path, 'index\\.tsx?$') THEN 'moderate' ELSE 'safe' END AS risk FROM one o JOIN many m ON m.repo_id = o.repo_id AND m.path = o.path JOIN w ON w.repo_id = o.repo_id AND w.symbol = o.symbol AND lo = hi
  WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.repo_id = o.repo_id AND e.is_relative AND e.resolved = {_KEY('o.path')}))
SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY path, symbol) <= 20""")
def j7(spark, sf):
    f = dt.code_files(spark, sf)
    return gr.dead_exports(f, gr.imports(f), 20)


@query("j8_dead_modules", f"""WITH {dt.CODE_FILES}, {_CRES}, x AS (SELECT repo_id, path, {cnt(r'@<@export\s+(?:function|const|class|interface|type)\s+\w+')} AS exports FROM code_files)
SELECT repo_id, path, exports FROM x WHERE exports > 1 AND regexp_extract(path, '[^/]*$') NOT IN ('index.ts', 'index.tsx', 'index.js') AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.repo_id = x.repo_id AND e.is_relative AND e.resolved = {_KEY('x.path')})""")
def j8(spark, sf):
    f = dt.code_files(spark, sf)
    return gr.dead_modules(f, gr.imports(f), minimum=1)


@query("a12_coupling_resolved", f"""WITH {_ALL}, {_RES} SELECT repo_id, resolved AS path, 'high-fan-in' AS rule, count(DISTINCT src) AS n FROM edges WHERE NOT starts_with(specifier, '@types/') GROUP BY 1, 2 HAVING count(DISTINCT src) > 10
UNION ALL SELECT repo_id, src, 'high-fan-out', count(*) FROM edges WHERE NOT starts_with(specifier, '@types/') GROUP BY 1, 2 HAVING count(*) > 20""")
def a12b(spark, sf):
    return gr.coupling(gr.imports(_all(spark, sf)), mode="resolved").select("repo_id", "path", "rule", "n")


_MODOF = lambda p: f"CASE WHEN string_split({p}, '/')[1] = 'src' AND len(string_split({p}, '/')) > 1 THEN 'src/' || string_split({p}, '/')[2] ELSE string_split({p}, '/')[1] END"
_MODE = f"""me AS (SELECT DISTINCT repo_id, {_MODOF('src')} AS source, {_MODOF('resolved')} AS target FROM edges WHERE is_relative), mo AS (SELECT DISTINCT repo_id, {_MODOF('path')} AS m FROM allf),
mx AS (SELECT me.* FROM me JOIN mo ON mo.repo_id = me.repo_id AND mo.m = me.target WHERE source <> target AND target <> '' AND NOT regexp_matches(target, '^[.@]'))"""


@query("a14_module_edges", f"WITH {_ALL}, {_RES}, {_MODE} SELECT * FROM mx")
def a14(spark, sf):
    f = _all(spark, sf)
    return gr.module_edges(f, gr.imports(f))


@query("a14_module_summary", f"""WITH {_ALL}, {_RES}, {_MODE}, dg AS (SELECT repo_id, source, count(*) AS n FROM mx GROUP BY 1, 2), s AS (SELECT repo_id, CAST(sum(n) AS BIGINT) AS dependencies FROM dg GROUP BY 1),
t AS (SELECT repo_id, source AS most_coupled FROM dg QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, source) = 1)
SELECT m.repo_id, modules, coalesce(dependencies, 0) AS dependencies, most_coupled FROM (SELECT repo_id, count(*) AS modules FROM mo GROUP BY 1) m LEFT JOIN s ON s.repo_id = m.repo_id LEFT JOIN t ON t.repo_id = m.repo_id""")
def a14b(spark, sf):
    f = _all(spark, sf)
    return gr.module_summary(f, gr.imports(f))


_SYMS = ("LIMIT", "compute", "router", "token", "legacy16", "Store26", "React", "save")
_DEF = "(?:function|class|const|let|var|def|interface|type|export)\\s+"
_BLAST = f"""sy AS (SELECT unnest({list(_SYMS)}) AS symbol), bl AS (SELECT symbol, repo_id, path, count(*) AS mentions, CAST(CASE WHEN bool_or(regexp_matches(text, '\\b{_DEF}' || symbol || '\\b')) THEN 1 ELSE 2 END AS INTEGER) AS depth,
  bool_or({o.contains('path', '.test.', '.spec.', '__tests__', 'tests/')}) AS is_test FROM code_lines JOIN sy ON contains(text, symbol) AND regexp_matches(text, '\\b' || symbol || '\\b') GROUP BY 1, 2, 3)"""


@query("j16_blast_radius", f"WITH {dt.CODE_LINES}, {_BLAST} SELECT * FROM bl")
def j16(spark, sf):
    return gr.blast_radius(dt.code_files(spark, sf), spark.createDataFrame([(s,) for s in _SYMS], "symbol string"))


@query("j16_blast_summary", f"""WITH {dt.CODE_LINES}, {_BLAST}, g AS (SELECT symbol, CAST(sum(mentions) AS BIGINT) AS mentions, count(*) FILTER (WHERE NOT is_test) AS production_files, count(*) FILTER (WHERE is_test) AS test_files FROM bl GROUP BY 1)
SELECT *, CASE WHEN mentions > 50 THEN 'high' WHEN mentions > 10 THEN 'medium' ELSE 'low' END AS risk FROM g""")
def j16b(spark, sf):
    return gr.blast_summary(gr.blast_radius(dt.code_files(spark, sf), spark.createDataFrame([(s,) for s in _SYMS], "symbol string")))


@query("j14_test_gaps", f"""WITH {dt.CODE_FILES}, ts AS (SELECT DISTINCT repo_id, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.(?:test|spec)\\.(?:ts|tsx|js|jsx)$', '') AS base FROM code_files WHERE {o.contains('path', '.test.', '.spec.', '__tests__')}),
g AS (SELECT repo_id, path, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.(?:ts|tsx|js|jsx)$', '') AS base, {cnt(r'@<@(?:if|for|while|switch|catch)\s')} AS flow, CAST({LINES} AS INTEGER) AS lines FROM code_files WHERE regexp_matches(path, '\\.(?:ts|tsx|js|jsx)$') AND NOT {o.contains('path', '.test.', '.spec.', '__tests__', 'node_modules')})
SELECT g.repo_id, path, lines, CASE WHEN flow > 30 THEN 'high' WHEN flow > 15 THEN 'medium' ELSE 'low' END AS complexity, CASE WHEN flow > 30 THEN 'high' ELSE 'medium' END AS priority FROM g
WHERE lines > 50 AND NOT EXISTS (SELECT 1 FROM ts WHERE ts.repo_id = g.repo_id AND ts.base = g.base)""")
def j14(spark, sf):
    return gr.gaps_in_tests(dt.code_files(spark, sf))


@query("a21_risk_heatmap", f"""WITH {dt.CODE_FILES}, m AS (SELECT repo_id, path, {LINES} AS lines, {cnt(r'@<@(?:if|for|while|switch|catch|try)\s')} AS flow, {cnt(r'@<@function\s+\w+')} AS functions FROM code_files),
c AS (SELECT *, CASE WHEN flow > 30 THEN 'high' WHEN flow > 15 THEN 'medium' ELSE 'low' END AS complexity, CAST(floor(least(lines / 200, 3.0) * 10 + functions / lines * 100 + 0.5) AS INTEGER) AS churn FROM m),
r AS (SELECT repo_id, path, complexity, churn, CAST(floor(CASE complexity WHEN 'high' THEN 3.0 WHEN 'medium' THEN 1.5 ELSE 0.5 END * churn + 0.5) AS INTEGER) AS risk FROM c)
SELECT * FROM r WHERE risk > 15 QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY risk DESC, path) <= 15""")
def a21(spark, sf):
    return gr.risk_heatmap(dt.code_files(spark, sf), 15)


# --- structure --------------------------------------------------------------------------------------------------------------

_LABEL = "CASE " + " ".join(f"WHEN {o.contains('dir', *n)} THEN {lit(label)}" for n, label in structure.DIRECTORY_LABELS) + " ELSE 'Other' END"


@query("a6_directory_breakdown", f"""WITH {_ALL}, d AS (SELECT repo_id, unnest(list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS dir FROM allf),
c AS (SELECT repo_id, dir, count(*) AS files FROM d GROUP BY 1, 2) SELECT *, {_LABEL} AS label FROM c QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY files DESC, dir) <= 10""")
def a6(spark, sf):
    return structure.directory_breakdown(_all(spark, sf).select("repo_id", "path"), 10)


_ARCH = f"""ar AS (SELECT repo_id, CASE WHEN {_p('src/components/')} AND {_p('src/pages/')} THEN 'react-app' WHEN {_p('src/routes/')} AND {_p('src/middleware/')} THEN 'express-api' WHEN {_p('app/')} AND {_p('next.config')} THEN 'next-app'
  WHEN {_p('src/modules/')} AND bool_or(starts_with(path, 'src/modules/')) THEN 'agent-sdk' WHEN bool_or(starts_with(path, 'dist/')) THEN 'npm-package' ELSE 'generic' END AS archetype FROM allf GROUP BY 1)"""
_EXPDIR = "CASE archetype " + " ".join(f"WHEN {lit(a)} THEN {list(d)}" for a, d in structure.ARCHETYPES.items()) + " END"


@query("a7_archetype", f"WITH {_ALL}, {_ARCH} SELECT * FROM ar")
def a7(spark, sf):
    return structure.archetype(_all(spark, sf).select("repo_id", "path"))


@query("a7_missing_directories", f"""WITH {_ALL}, {_ARCH}, e AS (SELECT repo_id, archetype, unnest({_EXPDIR}) AS dir FROM ar) SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM allf f WHERE f.repo_id = e.repo_id AND regexp_matches(f.path, '^' || e.dir || '[^/]*/'))""")
def a7b(spark, sf):
    return structure.missing_directories(_all(spark, sf).select("repo_id", "path"))


@query("a8_naming_mix", f"""WITH {_ALL}, n AS (SELECT repo_id, regexp_replace(path, '/?[^/]*$', '') AS dir, regexp_extract(path, '[^/]*$') AS b FROM allf), c AS (SELECT repo_id, dir, CASE WHEN contains(b, '-') THEN 'kebab-case' WHEN contains(b, '_') THEN 'snake_case'
  WHEN regexp_matches(b, '^[a-z]') AND regexp_matches(b, '[A-Z]') THEN 'camelCase' WHEN regexp_matches(b, '^[A-Z]') THEN 'PascalCase' ELSE 'other' END AS v FROM n)
SELECT repo_id, dir, count(*) AS files, string_agg(DISTINCT v, ',' ORDER BY v) AS conventions FROM c GROUP BY 1, 2 HAVING count(*) > 3 AND count(DISTINCT v) > 1""")
def a8(spark, sf):
    return structure.naming_mix(_all(spark, sf)).withColumn("conventions", F.array_join("conventions", ","))


_LANG = "CASE regexp_extract(path, '(\\.[^.]+)$', 1) " + " ".join(f"WHEN {lit(e)} THEN {lit(n)}" for e, n in rt.LANGUAGE_BY_EXT.items()) + " ELSE 'Other' END"


@query("a15_language_breakdown", f"""WITH {_ALL}, g AS (SELECT repo_id, {_LANG} AS language, count(*) AS files, CAST(sum({LINES}) AS BIGINT) AS lines FROM allf GROUP BY 1, 2)
SELECT *, floor(lines / (sum(lines) OVER (PARTITION BY repo_id)) * 1000 + 0.5) / 10 AS percent FROM g""")
def a15(spark, sf):
    return structure.language_breakdown(_all(spark, sf))


_CM = f"len(list_filter(string_split(content, chr(10)), lambda x: starts_with({T}, '//') OR starts_with({T}, '*') OR starts_with({T}, '/**')))"
_BL = f"len(list_filter(string_split(content, chr(10)), lambda x: {T} = ''))"


@query("a16_comment_ratio", f"""WITH {dt.CODE_FILES}, m AS (SELECT repo_id, path, CAST({LINES} AS INTEGER) AS lines, {_CM} AS c, {_BL} AS b FROM code_files)
SELECT repo_id, path, lines, CASE WHEN lines - c - b > 0 THEN c / (lines - c - b) ELSE 0 END AS ratio FROM m QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY CASE WHEN lines - c - b > 0 THEN c / (lines - c - b) ELSE 0 END DESC, path) <= 10""")
def a16(spark, sf):
    return structure.comment_ratio(dt.code_files(spark, sf))


@query("a16_marker_density", f"""WITH {dt.CODE_FILES}, m AS (SELECT repo_id, path, {cnt(r'(?i)//\s*(?:TASK|FIX_NOW|HACK)')} AS markers, CAST({LINES} AS INTEGER) AS lines FROM code_files)
SELECT repo_id, path, markers, lines, markers / lines * 100 AS density FROM m WHERE markers > 0 QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY markers / lines * 100 DESC, path) <= 10""")
def a16b(spark, sf):
    return structure.marker_density(dt.code_files(spark, sf))


@query("a17_structure_findings", f"""WITH {_ALL}, fn AS (SELECT repo_id, path, unnest(regexp_extract_all(content, '(?:async\\s+)?function\\s+\\w+\\s*\\([\\s\\S]*?\\n\\}}')) AS m FROM allf),
im AS (SELECT repo_id, path, unnest(list_filter(list_transform(string_split(content, chr(10)), lambda x: regexp_extract(x, '^import\\s.*from\\s[''"].*[''"]')), lambda x: x <> '')) AS s FROM allf)
SELECT repo_id, path, 'large-function' AS rule, 'medium' AS severity, regexp_extract(m, 'function\\s+(\\w+)', 1) || ':' || CAST(len(string_split(m, chr(10))) - 1 AS VARCHAR) AS detail FROM fn WHERE len(string_split(m, chr(10))) - 1 > 50
UNION ALL SELECT repo_id, path, 'duplicate-import', 'low', substr(s, 1, 60) FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, path, s) AS rn FROM im) WHERE rn > 1
UNION ALL SELECT repo_id, path, 'mixed-import-styles', 'low', '' FROM allf WHERE contains(content, 'require(') AND regexp_matches(content, '^import\\s')""")
def a17(spark, sf):
    return structure.structure_findings(_all(spark, sf))


_READ = f"""rd AS (SELECT repo_id, {LINES} AS n, len(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '^\\s*(?://|#|/\\*|\\*)'))) AS c, regexp_matches(content, 'from\\s+[''"][^''"]+\\.css[''"]|from\\s+[''"]![''"]') AS odd, regexp_matches(path, '\\.(?:test|spec)\\.[jt]sx?$') AS t FROM allf),
rg AS (SELECT repo_id, count(*) AS files, CAST(floor((count(*) FILTER (WHERE n < 200) * 10 + count(*) FILTER (WHERE n >= 200 AND n < 400) * 6 + count(*) FILTER (WHERE n >= 400) * 2) * 10 / count(*) + 0.5) AS INTEGER) AS size_score, sum(c) / sum(n) AS r,
  CAST(greatest(0, 100 - count(*) FILTER (WHERE odd) * 10) AS INTEGER) AS import_score, CAST(floor(least(1.0, count(*) FILTER (WHERE t) / count(*)) * 100 + 0.5) AS INTEGER) AS test_score FROM rd GROUP BY 1),
rs AS (SELECT repo_id, files, size_score, CAST(CASE WHEN r < 0.02 THEN 30 WHEN r < 0.05 THEN 60 WHEN r <= 0.15 THEN 100 WHEN r <= 0.25 THEN 80 ELSE 60 END AS INTEGER) AS comment_score, import_score, test_score FROM rg)"""


@query("a24_machine_readability", f"WITH {_ALL}, {_READ} SELECT *, CAST(floor((size_score * 35 + comment_score * 20 + import_score * 20 + test_score * 25) / 100 + 0.5) AS INTEGER) AS overall FROM rs")
def a24(spark, sf):
    return structure.machine_readability(_all(spark, sf))


# --- dependencies -------------------------------------------------------------------------------------------------------------

_EFF = "eff AS (SELECT repo_id, name, arg_max(version, kind = 'dev') AS version FROM deps GROUP BY 1, 2)"
_MAJ = "CASE name " + " ".join(f"WHEN {lit(k)} THEN {v}" for k, v in dp.LATEST_MAJOR.items()) + " END"
_DEPF = f"""{_EFF}, gp AS (SELECT *, CAST({_MAJ} AS DOUBLE) - CAST(regexp_extract(version, '(\\d+)', 1) AS INTEGER) AS gap FROM eff WHERE name IN ({', '.join(lit(k) for k in dp.LATEST_MAJOR)})),
pk AS (SELECT DISTINCT repo_id, unnest(regexp_extract_all(content, {lit(dp.SPECIFIER)}, 1)) AS name FROM code_files),
dfn AS (SELECT repo_id, name AS package, version, 'deprecated' AS rule, 'high' AS severity FROM eff WHERE name IN ({', '.join(lit(k) for k in dp.DEPRECATED)})
  UNION ALL SELECT repo_id, name, version, 'outdated', CASE WHEN gap >= 3 THEN 'critical' WHEN gap >= 2 THEN 'high' ELSE 'medium' END FROM gp WHERE gap >= 1
  UNION ALL SELECT repo_id, name, max(version) FILTER (WHERE kind = 'prod') || ' / ' || max(version) FILTER (WHERE kind = 'dev'), 'mismatched', 'high' FROM deps GROUP BY 1, 2 HAVING count(DISTINCT kind) = 2
  UNION ALL SELECT repo_id, name, version, 'unused', 'low' FROM eff WHERE name NOT IN ({', '.join(lit(k) for k in dp.USED_BUT_NOT_IMPORTED)}) AND NOT starts_with(name, '@types/') AND NOT starts_with(name, '@radix-ui/')
    AND NOT EXISTS (SELECT 1 FROM pk WHERE pk.repo_id = eff.repo_id AND (pk.name = eff.name OR starts_with(pk.name, eff.name || '/') OR starts_with(pk.name, '@' || eff.name))))"""


@query("j10_deprecated_deps", f"WITH {dt.CODE_FILES}, {dt.DEPS}, {_DEPF} SELECT repo_id, package, version FROM dfn WHERE rule = 'deprecated'")
def j10(spark, sf):
    return dp.deprecated_deps(dt.deps(spark, sf)).select("repo_id", "package", "version")


@query("j11_outdated_deps", f"WITH {dt.CODE_FILES}, {dt.DEPS}, {_DEPF} SELECT repo_id, package, version, severity FROM dfn WHERE rule = 'outdated'")
def j11(spark, sf):
    return dp.outdated_deps(dt.deps(spark, sf)).select("repo_id", "package", "version", "severity")


@query("j12_mismatched_deps", f"WITH {dt.CODE_FILES}, {dt.DEPS}, {_DEPF} SELECT repo_id, package, version FROM dfn WHERE rule = 'mismatched'")
def j12(spark, sf):
    return dp.mismatched_deps(dt.deps(spark, sf)).select("repo_id", "package", "version")


@query("j9_unused_deps", f"WITH {dt.CODE_FILES}, {dt.DEPS}, {_DEPF} SELECT repo_id, package, version FROM dfn WHERE rule = 'unused'")
def j9(spark, sf):
    return dp.unused_deps(dt.deps(spark, sf), dp.imported_packages(dt.code_files(spark, sf))).select("repo_id", "package", "version")


@query("a5_dependency_health", f"""WITH {dt.CODE_FILES}, {dt.DEPS}, {_DEPF}, t AS (SELECT repo_id, count(DISTINCT name) FILTER (WHERE kind = 'prod') AS prod, count(DISTINCT name) FILTER (WHERE kind = 'dev') AS dev FROM deps GROUP BY 1),
f AS (SELECT repo_id, sum(CASE severity WHEN 'critical' THEN 20 WHEN 'high' THEN 10 WHEN 'medium' THEN 5 ELSE 2 END) AS lost, count(*) AS findings, count(*) FILTER (WHERE rule = 'unused') AS unused FROM dfn GROUP BY 1)
SELECT t.repo_id, prod, dev, coalesce(findings, 0) AS findings, coalesce(unused, 0) AS unused, prod > 50 AS excessive, CAST(greatest(0, 100 - coalesce(lost, 0)) AS INTEGER) AS score FROM t LEFT JOIN f ON f.repo_id = t.repo_id""")
def a5(spark, sf):
    d = dt.deps(spark, sf)
    return dp.dependency_health(d, dp.dependency_findings(d, dp.imported_packages(dt.code_files(spark, sf))))


_STMT = f"""st0 AS (SELECT repo_id, path, line, text, CASE regexp_extract(path, '\\.[^./]*$') WHEN '.ts' THEN 'ts' WHEN '.tsx' THEN 'ts' WHEN '.js' THEN 'js' WHEN '.jsx' THEN 'js' WHEN '.py' THEN 'py' WHEN '.go' THEN 'go' END AS language FROM code_lines),
st1 AS (SELECT repo_id, path, line, language, CASE WHEN language IN ('ts', 'js') THEN regexp_replace(
    CASE WHEN regexp_extract(text, '^\\s*import\\s+(?:[\\w*${{}},\\s]+\\s+from\\s+)?["'']([^"'']+)["'']', 1) <> '' THEN regexp_extract(text, '^\\s*import\\s+(?:[\\w*${{}},\\s]+\\s+from\\s+)?["'']([^"'']+)["'']', 1)
      WHEN regexp_matches(text, 'import\\s*\\(\\s*["''][^"''.]') THEN regexp_extract(text, 'import\\s*\\(\\s*["'']([^"'']+)["'']', 1) ELSE regexp_extract(text, 'require\\s*\\(\\s*["'']([^"'']+)["'']', 1) END, '^node:', '')
  WHEN language = 'py' THEN string_split(CASE WHEN regexp_extract(text, '^\\s*from\\s+([\\w.]+)\\s+import', 1) <> '' THEN regexp_extract(text, '^\\s*from\\s+([\\w.]+)\\s+import', 1) ELSE regexp_extract(text, '^\\s*import\\s+([\\w.]+)', 1) END, '.')[1]
  ELSE CASE WHEN regexp_extract(text, '^\\s*import\\s+"([^"]+)"', 1) <> '' THEN regexp_extract(text, '^\\s*import\\s+"([^"]+)"', 1) ELSE regexp_extract(text, '^\\s*"([^"]+)"\\s*$', 1) END END AS name FROM st0 WHERE language IS NOT NULL),
st AS (SELECT * FROM st1 WHERE name <> '' AND NOT starts_with(name, '.') AND NOT contains(name, '${{'))"""


@query("j13_import_statements", f"WITH {dt.CODE_LINES}, {_STMT} SELECT * FROM st")
def j13a(spark, sf):
    return dp.import_statements(dt.code_files(spark, sf))


def _declared(spark, sf):
    """Declared names with small misspellings in some repositories."""
    d = dt.deps(spark, sf)
    return d.select("repo_id", F.when(F.length("repo_id") % 2 == 0, F.concat(F.substring("name", 1, 2), F.lit("x"), F.substring("name", 3, 50))).otherwise(F.col("name")).alias("name")).distinct()


_DECL = "dc AS (SELECT DISTINCT repo_id, CASE WHEN length(repo_id) % 2 = 0 THEN substr(name, 1, 2) || 'x' || substr(name, 3, 50) ELSE name END AS name FROM deps)"
_BUILT = " OR ".join(f"(language = {lit(k)} AND name IN ({', '.join(lit(n) for n in v)}))" for k, v in dp.BUILTINS.items() if v)
_PH = ", ".join(lit(k) for k in dp.KNOWN_PHANTOMS)


@query("j13_phantom_imports", f"""WITH {dt.CODE_LINES}, {dt.DEPS}, {_DECL}, {_STMT}, s AS (SELECT * FROM st WHERE NOT ({_BUILT})),
r AS (SELECT * FROM s WHERE name NOT IN ({_PH}) AND lower(name) NOT IN ({_PH}) AND NOT EXISTS (SELECT 1 FROM dc WHERE dc.repo_id = s.repo_id AND dc.name IN (s.name, lower(s.name)))),
nn AS (SELECT DISTINCT repo_id, name FROM r), nr AS (SELECT nn.repo_id, nn.name, dc.name AS nearest FROM nn JOIN dc ON dc.repo_id = nn.repo_id AND levenshtein(lower(nn.name), lower(dc.name)) <= 2 QUALIFY row_number() OVER (PARTITION BY nn.repo_id, nn.name ORDER BY levenshtein(lower(nn.name), lower(dc.name)), dc.name) = 1)
SELECT repo_id, path, line, name, 'deprecated-api' AS category, 'high' AS severity, NULL AS nearest FROM s WHERE name IN ({_PH}) OR lower(name) IN ({_PH})
UNION ALL SELECT r.repo_id, path, line, r.name, CASE WHEN nearest IS NOT NULL THEN 'typo' ELSE 'missing-dependency' END, CASE WHEN nearest IS NOT NULL THEN 'medium' ELSE 'high' END, nearest FROM r LEFT JOIN nr ON nr.repo_id = r.repo_id AND nr.name = r.name""")
def j13(spark, sf):
    return dp.phantom_imports(dp.import_statements(dt.code_files(spark, sf)), _declared(spark, sf))


# --- education ----------------------------------------------------------------------------------------------------------------

@query("a37_repetition_risk", f"""WITH {dt.DOC_LINES}, n AS (SELECT repo_id, {o.trim('text')} AS t, count(*) AS n FROM doc_lines WHERE length({o.trim('text')}) >= 20 GROUP BY 1, 2), m AS (SELECT repo_id, max(n) AS m FROM n GROUP BY 1)
SELECT d.repo_id, coalesce(m, 0) AS max_repeats, CASE WHEN m >= 5 THEN 'high' WHEN m >= 3 THEN 'medium' ELSE 'low' END AS risk FROM (SELECT DISTINCT repo_id FROM doc_files) d LEFT JOIN m ON m.repo_id = d.repo_id""")
def a37(spark, sf):
    return ss.repetition_risk(dt.doc_files(spark, sf))


@query("p33_submission_layers")
def p33(spark, sf):
    f = dt.code_files(spark, sf)
    g = f.select("repo_id").distinct().select("repo_id", F.explode(F.lit(["naming", "testing", "performance"])).alias("category"), F.lit(True).alias("enforced"))
    return ss.submission_layers(f, g).withColumn("patterns", F.array_join("patterns", ","))


@query("p33_guideline_checks", f"""WITH {dt.CODE_FILES}, g AS (SELECT repo_id, sum(length(content)) + count(*) - 1 AS chars, bool_or(regexp_matches(lower(content), '(?:let|const|var)\\s+\\w+_\\w+')) AS sv, bool_or(regexp_matches(lower(content), '\\bfunction\\s+[a-z][a-zA-Z]*\\b')) AS pf,
  bool_or(regexp_matches(content, '//|#|/\\*\\*')) AS dc, bool_or(regexp_matches(lower(content), 'setinterval|while\\s*\\(\\s*true\\s*\\)')) AS bz, bool_or(regexp_matches(path, '\\.(?:test|spec)')) AS ts FROM code_files GROUP BY 1)
SELECT repo_id, r.c AS category, r.m AS matched FROM (SELECT repo_id, unnest([{{'c': 'naming', 'm': NOT sv OR pf}}, {{'c': 'structure', 'm': chars < 5000}}, {{'c': 'testing', 'm': ts}}, {{'c': 'ai-usage', 'm': true}}, {{'c': 'documentation', 'm': dc}}, {{'c': 'performance', 'm': NOT bz}}]) AS r FROM g)""")
def p33b(spark, sf):
    return ss.guideline_checks(dt.code_files(spark, sf))


@query("a36_audit_submissions")
def a36(spark, sf):
    f = dt.code_files(spark, sf)
    return ss.audit_submissions(ss.submission_layers(f), ai.vibe_index(ai.ai_pattern_scan(f), f)).select("repo_id", "score", "grade", "consistency", "seniority")


_SENT = ("why does this work?", "please fix the loop and explain", "make it now", "I want a list instead", "what is a closure", "ok")


@query("a35_session_scores", f"""WITH t AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN list_extract({list(_SENT)}, CAST((conv_id + turn) % 6 AS INTEGER) + 1) ELSE text END AS text, role = 'assistant' AND turn % 3 > 0 AS pc FROM conversations),
c AS (SELECT conv_id, CAST(count(*) AS INTEGER) AS turns, CAST(count(*) FILTER (WHERE role = 'user') AS INTEGER) AS user_turns, CAST(count(*) FILTER (WHERE role = 'assistant') AS INTEGER) AS assistant_turns, CAST(count(*) FILTER (WHERE pc) AS INTEGER) AS code_turns,
  CAST(count(*) FILTER (WHERE role = 'user' AND regexp_matches(text, '(?i)\\?$|\\bwhy\\b|\\bhow\\b|\\bexplain\\b')) AS INTEGER) AS follow_ups, CAST(count(*) FILTER (WHERE role = 'user' AND (regexp_matches(text, '(?i)\\b(?:modify|change|fix|adjust|adapt|update|refactor|simplify)\\b') OR contains(text, '?'))) AS INTEGER) AS modifications,
  CAST(count(*) FILTER (WHERE role = 'user' AND regexp_matches(text, '(?i)\\b(?:I want|I need|should|must|instead|rather|prefer)\\b')) AS INTEGER) AS specific, CAST(count(*) FILTER (WHERE role = 'user' AND regexp_matches(text, '(?i)^(?:make|build|create|write|do|solve|implement)\\s+(?:it|this|the|that|a|an)\\b')) AS INTEGER) AS generic,
  CAST(count(*) FILTER (WHERE role = 'user' AND regexp_matches(text, '(?i)\\b(?:why|how does|what is|explain|concept|principle|pattern|best practice)\\b')) AS INTEGER) AS conceptual FROM t GROUP BY 1),
s AS (SELECT *, CAST(least(100, 30 + least(40, follow_ups * 8) + least(30, modifications * 6)) AS INTEGER) AS understanding, CAST(greatest(0, least(100, 50 + specific * 8 - generic * 5)) AS INTEGER) AS autonomy, CAST(least(100, 20 + conceptual * 10 + least(40, assistant_turns * 2)) AS INTEGER) AS efficiency FROM c),
f AS (SELECT *, list_filter([CASE WHEN assistant_turns > 3 AND code_turns >= assistant_turns * 0.8 THEN 'code-in-most-turns' END, CASE WHEN user_turns > 2 AND generic > user_turns * 0.5 THEN 'mostly-generic-requests' END, CASE WHEN user_turns > 2 AND follow_ups = 0 THEN 'no-follow-ups' END, CASE WHEN understanding < 30 THEN 'low-understanding' END], lambda x: x IS NOT NULL) AS rf,
  list_filter([CASE WHEN follow_ups >= 2 THEN 'follow-ups' END, CASE WHEN specific >= 2 THEN 'specific-instructions' END, CASE WHEN conceptual >= 2 THEN 'conceptual-questions' END, CASE WHEN autonomy >= 70 THEN 'high-autonomy' END], lambda x: x IS NOT NULL) AS ps FROM s)
SELECT conv_id, turns, user_turns, assistant_turns, code_turns, follow_ups, modifications, specific, generic, conceptual, understanding, autonomy, efficiency, array_to_string(rf, ',') AS red_flags, array_to_string(ps, ',') AS positive_signs,
 CASE WHEN len(rf) >= 3 THEN 'outsourced' WHEN len(rf) >= 1 AND understanding < 50 THEN 'mixed' WHEN len(ps) >= 2 THEN 'healthy' ELSE 'average' END AS verdict FROM f""")
def a35(spark, sf):
    t = dt.table(spark, sf, "conversations")
    text = F.when(F.col("role") == "user", F.element_at(F.lit(list(_SENT)), ((F.col("conv_id") + F.col("turn")) % 6 + 1).cast("int"))).otherwise(F.col("text"))
    t = t.select("conv_id", "turn", "role", text.alias("text"), (F.col("turn") % 3 > 0).alias("produced_code"))
    return ss.session_scores(t).drop("own_comments").withColumn("red_flags", F.array_join("red_flags", ",")).withColumn("positive_signs", F.array_join("positive_signs", ","))


@query("a35_turn_counts", "SELECT conv_id, CAST(count(*) AS INTEGER) AS turns, CAST(count(*) FILTER (WHERE role = 'user') AS INTEGER) AS user_turns, CAST(count(*) FILTER (WHERE role = 'assistant') AS INTEGER) AS assistant_turns FROM conversations GROUP BY 1")
def a35b(spark, sf):
    return ss.turn_counts(dt.table(spark, sf, "conversations")).select("conv_id", "turns", "user_turns", "assistant_turns")



