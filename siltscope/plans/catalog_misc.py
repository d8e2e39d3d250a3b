"""Registered queries: evaluation, scope, impact, sources, functions, streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltscope.functions import numbers as nm
from siltscope.functions import text as tx
from siltscope.operators import ai_patterns as ai
from siltscope.operators import evaluate as ev
from siltscope.operators import impact as im
from siltscope.operators import matching
from siltscope.operators import production
from siltscope.operators import scope as sc
from siltscope.operators.findings import distinct_values
from siltscope.plans import driver_tables as dt
from siltscope.plans import oracle as o
from siltscope.plans.catalog_code import _AI
from siltscope.plans.catalog_text import PROSE_RULES
from siltscope.plans.registry import lit, query
from siltscope.rules import tables as rt
from siltscope.session import shared_dir
from siltscope.sources import files as sfiles
from siltscope.sources import quality as sq
from siltscope.sources import scanners as sn
from siltscope.sources import sinks
from siltscope.sources import tree
from siltscope.streaming import jobs as st

# --- evaluation ------------------------------------------------------------------------------------------

_TYPES = ("sql-injection", "xss", "hardcoded-secret", "race-condition-bug", "memory-leak", "null-check", "resource-leak-issue")
_DESC = ("query built from user input", "unsafe html output", "secret in source", "shared counter update", "listener never removed", "missing null guard", "file handle not closed")


def _pick(values, idx):
    return F.element_at(F.lit(list(values)), (idx + 1).cast("int"))


def _truth(spark, sf):
    """One truth per order, three per task; predictions come from its line items."""
    k = F.col("o_orderkey")
    return dt.table(spark, sf, "orders").select(
        (k - k % 3).alias("task_id"), (k % 3).cast("int").alias("truth_no"), _pick(_TYPES, k % 7).alias("type"), (k % 8).cast("int").alias("line"),
        _pick(_DESC, k % 7).alias("description"), F.when(k % 2 == 0, "security").otherwise("quality").alias("category"),
        F.when(k % 5 == 0, "critical").otherwise("high").alias("severity"))


def _pred(spark, sf):
    k, s = F.col("l_orderkey"), F.col("l_suppkey")
    li = dt.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_discount").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"), F.max("l_discount").alias("l_discount"))
    return li.select(
        (k - k % 3).alias("task_id"), (k % 3 * 10 + F.col("l_linenumber")).cast("int").alias("pred_no"), _pick(_TYPES, (k + s) % 7).alias("type"), (s % 8).cast("int").alias("line"),
        _pick(_DESC, (k + s * 2) % 7).alias("description"), F.when(s % 2 == 0, "security").otherwise("quality").alias("category"),
        F.when(s % 5 == 0, "critical").otherwise("high").alias("severity"), F.round(F.col("l_discount") * 10, 2).alias("confidence"))


_EVAL = f"""truth AS (SELECT o_orderkey - o_orderkey % 3 AS task_id, CAST(o_orderkey % 3 AS INTEGER) AS truth_no, list_extract({list(_TYPES)}, CAST(o_orderkey % 7 AS INTEGER) + 1) AS type, CAST(o_orderkey % 8 AS INTEGER) AS line,
  list_extract({list(_DESC)}, CAST(o_orderkey % 7 AS INTEGER) + 1) AS description, CASE WHEN o_orderkey % 2 = 0 THEN 'security' ELSE 'quality' END AS category, CASE WHEN o_orderkey % 5 = 0 THEN 'critical' ELSE 'high' END AS severity FROM orders),
li AS (SELECT l_orderkey AS k, l_linenumber AS n, min(l_suppkey) AS s, max(l_discount) AS d FROM lineitem GROUP BY 1, 2),
pred AS (SELECT k - k % 3 AS task_id, CAST(k % 3 * 10 + n AS INTEGER) AS pred_no, list_extract({list(_TYPES)}, CAST((k + s) % 7 AS INTEGER) + 1) AS type, CAST(s % 8 AS INTEGER) AS line, list_extract({list(_DESC)}, CAST((k + s * 2) % 7 AS INTEGER) + 1) AS description,
  CASE WHEN s % 2 = 0 THEN 'security' ELSE 'quality' END AS category, CASE WHEN s % 5 = 0 THEN 'critical' ELSE 'high' END AS severity, round(d * 10, 2) AS confidence FROM li)"""
# greedy assignment for at most three truths, unrolled: each truth takes its best prediction not taken before
_CANON = lambda c: f"regexp_replace({c}, '(-({'|'.join(tx.TYPE_SUFFIXES)}))+$', '')"
_PAIRS = f"""pairs AS (SELECT t.task_id, truth_no, pred_no, {_CANON('p.type')} AS a, {_CANON('t.type')} AS b, p.line AS pl, t.line AS tl, list_distinct(string_split(t.description, ' ')) AS td, list_distinct(string_split(p.description, ' ')) AS pd FROM truth t JOIN pred p ON p.task_id = t.task_id),
scored AS (SELECT task_id, truth_no, pred_no, 0.6::DOUBLE * (CASE WHEN a = b THEN 1.0 WHEN starts_with(a, b || '-') OR starts_with(b, a || '-') THEN 0.7
   WHEN len(list_intersect(string_split(a, '-'), string_split(b, '-'))) / least(len(string_split(a, '-')), len(string_split(b, '-'))) >= 0.5 THEN 0.4 ELSE 0.0 END)
  + 0.3::DOUBLE * (CASE WHEN pl > 0 AND tl > 0 THEN CASE WHEN abs(pl - tl) <= 2 THEN 1 - abs(pl - tl) / 3 ELSE 0 END WHEN pl = 0 AND tl = 0 THEN 1 ELSE 0 END)
  + 0.1::DOUBLE * len(list_intersect(list_filter(td, lambda w: length(w) > 2), list_filter(pd, lambda w: length(w) > 2))) / greatest(1, len(list_distinct(list_concat(list_filter(td, lambda w: length(w) > 2), list_filter(pd, lambda w: length(w) > 2))))) AS score FROM pairs)"""


def _greedy(src: str, keys: str = "task_id") -> str:
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys.split(", "))
    best = lambda n, where: f"SELECT {keys}, truth_no, pred_no, score FROM {src} s WHERE truth_no = {n}{where} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, pred_no) = 1"
    no = lambda m: f" AND NOT EXISTS (SELECT 1 FROM {m} WHERE {on(m, 's')} AND {m}.pred_no = s.pred_no)"
    return f"m0 AS ({best(0, '')}), m1 AS ({best(1, no('m0'))}), m2 AS ({best(2, no('m0') + no('m1'))}), mt AS (SELECT * FROM m0 UNION ALL SELECT * FROM m1 UNION ALL SELECT * FROM m2)"


_MATCH = f"{_EVAL}, {_PAIRS}, ok AS (SELECT * FROM scored WHERE score >= 0.5), {_greedy('ok')}"


@query("j28_match_findings", f"WITH {_MATCH} SELECT task_id, truth_no, pred_no, round(score, 6) AS score FROM mt")
def j28(spark, sf):
    return ev.match_findings(_pred(spark, sf), _truth(spark, sf)).withColumn("score", F.round("score", 6))


_RATES = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1"


@query("a32_score_outcomes", f"""WITH {_MATCH}, oc AS (SELECT 'tp' AS kind, category, severity FROM truth t WHERE EXISTS (SELECT 1 FROM mt WHERE mt.task_id = t.task_id AND mt.truth_no = t.truth_no)
 UNION ALL SELECT 'fn', category, severity FROM truth t WHERE NOT EXISTS (SELECT 1 FROM mt WHERE mt.task_id = t.task_id AND mt.truth_no = t.truth_no)
 UNION ALL SELECT 'fp', category, severity FROM pred p WHERE NOT EXISTS (SELECT 1 FROM mt WHERE mt.task_id = p.task_id AND mt.pred_no = p.pred_no)),
g AS (SELECT CASE WHEN grouping(category) = 0 THEN 'category' WHEN grouping(severity) = 0 THEN 'severity' ELSE 'all' END AS scope, coalesce(category, severity) AS label, count(*) FILTER (WHERE kind = 'tp') AS tp, count(*) FILTER (WHERE kind = 'fp') AS fp, count(*) FILTER (WHERE kind = 'fn') AS fn
  FROM oc GROUP BY GROUPING SETS ((), (category), (severity))) SELECT scope, label, tp, fp, fn, tp + fn AS support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM (SELECT *, {_RATES} FROM g)""")
def a32(spark, sf):
    p, t = _pred(spark, sf), _truth(spark, sf)
    out = ev.score_outcomes(ev.outcomes(p, t, ev.match_findings(p, t)))
    return out.select("scope", "label", "tp", "fp", "fn", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


_SIMPLE = """sp AS (SELECT t.task_id, th, truth_no, pred_no, 1.0 AS score FROM truth t JOIN pt p ON p.task_id = t.task_id WHERE (p.type = t.type OR contains(p.type, string_split(t.type, '-')[1])) AND ((t.line > 0 AND p.line > 0 AND abs(p.line - t.line) <= 2) OR t.line = 0))"""
_SWEEP = f"{_EVAL}, ths AS (SELECT CAST(unnest({list(ev.THRESHOLDS)}) AS DOUBLE) AS th), pt AS (SELECT pred.*, th FROM pred JOIN ths ON confidence >= th), {_SIMPLE}, {_greedy('sp', 'task_id, th')}"


@query("a33_threshold_sweep", f"""WITH {_SWEEP}, c AS (SELECT th, (SELECT count(*) FROM mt WHERE mt.th = ths.th) AS tp, (SELECT count(*) FROM pt WHERE pt.th = ths.th) AS made FROM ths), r AS (SELECT th AS threshold, tp, made - tp AS fp, (SELECT count(*) FROM truth) - tp AS fn FROM c),
x AS (SELECT *, {_RATES} FROM r) SELECT threshold, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, row_number() OVER (ORDER BY f1 DESC, precision DESC, threshold DESC) = 1 AS is_best FROM x""")
def a33(spark, sf):
    out = ev.threshold_sweep(_pred(spark, sf), _truth(spark, sf))
    return out.select("threshold", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "is_best")


@query("j29_match_simple", f"WITH {_EVAL}, pt AS (SELECT *, 0 AS th FROM pred), {_SIMPLE}, {_greedy('sp')} SELECT task_id, truth_no, pred_no FROM mt")
def j29(spark, sf):
    return ev.match_simple(_pred(spark, sf), _truth(spark, sf)).drop("score")


def _labelled(spark, sf):
    """Documents flagged by the junk rules are predicted low quality; the labels are the truth."""
    d = dt.table(spark, sf, "documents").select("doc_id", "text").join(dt.table(spark, sf, "labels"), "doc_id")
    hits = sum((tx.rx_count("text", r.pattern) for r in PROSE_RULES), F.lit(0))
    return d.select("doc_id", "quality", hits.alias("actual"), F.lit(0).alias("lo"), F.when(F.col("quality") == 1, 2).otherwise(1000000).alias("hi"))


_HITS = " + ".join(o.count("text", r.pattern) for r in PROSE_RULES)


@query("a34_calibrate", f"""WITH c AS (SELECT l.doc_id AS id, quality AS kind, {_HITS} AS actual, CASE WHEN quality = 1 THEN 2 ELSE 1000000 END AS hi FROM documents d JOIN labels l ON l.doc_id = d.doc_id)
SELECT kind, count(*) AS entries, count(*) FILTER (WHERE actual BETWEEN 0 AND hi) AS correct, round(avg(CASE WHEN actual BETWEEN 0 AND hi THEN 1 ELSE 0 END), 6) AS accuracy FROM c GROUP BY 1""")
def a34(spark, sf):
    base = _labelled(spark, sf)
    cal = base.select(F.col("doc_id").alias("id"), F.col("quality").alias("kind"), "lo", "hi")
    done = ev.calibrate(lambda c: base.select(F.col("doc_id").alias("id"), "actual"), cal)
    return ev.calibration_accuracy(done, ["kind"]).withColumn("accuracy", F.round("accuracy", 6))


@query("a32_label_confusion", f"""WITH c AS (SELECT quality, ({_HITS}) > 2 AS flagged FROM documents d JOIN labels l ON l.doc_id = d.doc_id), n AS (SELECT count(*) FILTER (WHERE flagged AND quality = 0) AS tp, count(*) FILTER (WHERE flagged AND quality = 1) AS fp, count(*) FILTER (WHERE NOT flagged AND quality = 0) AS fn FROM c)
SELECT tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM (SELECT *, {_RATES} FROM n)""")
def a32b(spark, sf):
    flagged, bad = F.col("actual") > 2, F.col("quality") == 0
    n = lambda c: F.sum(c.cast("long"))
    out = ev.rates(_labelled(spark, sf).agg(n(flagged & bad).alias("tp"), n(flagged & ~bad).alias("fp"), n(~flagged & bad).alias("fn")))
    return out.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def _walk(src: str) -> str:
    """The greedy walk as a recursion over positions in a file, with what it has kept."""
    near = """len(list_intersect(string_split(k.rule, '-'), string_split(s.rule, '-'))) > 0 AND CASE WHEN k.line > 0 AND s.line > 0 THEN abs(k.line - s.line) <= 2 ELSE k.category = s.category END"""
    return f"""best AS (SELECT * FROM {src} QUALIFY row_number() OVER (PARTITION BY repo_id, path, rule, category, line ORDER BY confidence DESC, ordinal, severity DESC, detail DESC) = 1),
slim AS (SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY confidence DESC, ordinal, line, rule, category) AS pos FROM best),
walk(repo_id, path, pos, kept) AS (
  SELECT repo_id, path, pos, [{{'rule': rule, 'category': category, 'line': line, 'severity': severity}}] FROM slim WHERE pos = 1
  UNION ALL
  SELECT s.repo_id, s.path, s.pos, CASE WHEN len(list_filter(w.kept, lambda k: {near})) > 0 THEN w.kept ELSE list_append(w.kept, {{'rule': s.rule, 'category': s.category, 'line': s.line, 'severity': s.severity}}) END
  FROM walk w JOIN slim s ON s.repo_id = w.repo_id AND s.path = w.path AND s.pos = w.pos + 1),
ends AS (SELECT repo_id, path, unnest(arg_max(kept, pos)) AS k FROM walk GROUP BY 1, 2)"""


@query("j30_dedupe_near", f"WITH RECURSIVE {dt.FINDINGS}, {_walk('findings')} SELECT repo_id, k.rule AS rule, count(*) AS kept FROM ends GROUP BY 1, 2")
def j30(spark, sf):
    f = dt.findings(spark, sf)
    return ev.dedupe_near(f).groupBy("repo_id", "rule").agg(F.count("*").alias("kept"))


_CAPPED = "capped AS (SELECT * FROM findings QUALIFY row_number() OVER (PARTITION BY repo_id, path, category, rule ORDER BY confidence DESC, line, ordinal, detail) <= 1)"


@query("x4_verify_findings", f"WITH RECURSIVE {dt.FINDINGS}, {_CAPPED}, {_walk('capped')} SELECT repo_id, k.severity AS severity, count(*) AS kept FROM ends GROUP BY 1, 2")
def x4(spark, sf):
    return ev.verify_findings(dt.findings(spark, sf)).groupBy("repo_id", "severity").agg(F.count("*").alias("kept"))


# --- scope ---------------------------------------------------------------------------------------------------

_DELIV = ("User login page", "CSV export of orders", "Payment checkout", "Search filter", "Email alerts", "Admin dashboard", "Quantum flux widget", "Docs and readme", "Deploy with dockerfile")
_CONS = ("keep the bundle small", "no new libraries", "finish in june")


def _briefs(spark, sf):
    k = F.col("c_custkey")
    # a brief's expansion takes most of the time, so briefs are dealt out before it
    return dt.spread(dt.table(spark, sf, "customer").select("c_custkey"), "c_custkey").select(
        k.alias("brief_id"), F.concat(F.lit("repo"), (k % 38).cast("string")).alias("repo_id"),
        F.when(k % 13 == 0, F.array().cast("array<string>")).otherwise(F.array(_pick(_DELIV, k % 9), _pick(_DELIV, (k * 5 + 1) % 9))).alias("deliverables"),
        F.array(_pick(_DELIV, (k * 7 + 3) % 9)).alias("exclusions"), F.array(_pick(_DELIV, (k + 4) % 9)).alias("promised"), F.array(_pick(_CONS, k % 3)).alias("constraints"))


_EXPAND = "list_distinct(list_concat(kw, " + ", ".join(
    f"CASE WHEN len(list_filter(kw, lambda k: k = {lit(n)} OR " + " OR ".join(f"contains(k, {lit(m)}) OR contains({lit(m)}, k)" for m in ms) + f")) > 0 THEN {[n, *ms]} ELSE [] END" for n, ms in sc.MARKERS.items()) + "))"
_KW = lambda c: f"list_distinct(list_filter(regexp_split_to_array(trim(regexp_replace(lower({c}), '[^a-z0-9/._-]+', ' ', 'g')), '\\s+'), lambda w: length(w) >= 2 AND w NOT IN ({', '.join(lit(x) for x in sc.STOP_WORDS)})))"
_ALLWORDS = sorted({w for n, m in sc.MARKERS.items() for w in (n, *m)})
_TOUCH = lambda arr, n, ms: f"len(list_filter({arr}, lambda k: k = {lit(n)} OR " + " OR ".join(f"contains(k, {lit(m)}) OR contains({lit(m)}, k)" for m in ms) + ")) > 0"
_SCOPE = f"""{dt.CODE_FILES}, ph AS (SELECT phrase, {_EXPAND} AS ex FROM (SELECT phrase, {_KW('phrase')} AS kw FROM (SELECT unnest({list(_DELIV)}) AS phrase))),
br AS (SELECT c_custkey AS brief_id, 'repo' || CAST(c_custkey % 38 AS VARCHAR) AS repo_id, CASE WHEN c_custkey % 13 = 0 THEN [] ELSE [list_extract({list(_DELIV)}, CAST(c_custkey % 9 AS INTEGER) + 1), list_extract({list(_DELIV)}, CAST((c_custkey * 5 + 1) % 9 AS INTEGER) + 1)] END AS deliverables,
  list_extract({list(_DELIV)}, CAST((c_custkey * 7 + 3) % 9 AS INTEGER) + 1) AS exclusion, list_extract({list(_DELIV)}, CAST((c_custkey + 4) % 9 AS INTEGER) + 1) AS promised, list_extract({list(_CONS)}, CAST(c_custkey % 3 AS INTEGER) + 1) AS cons FROM customer),
wd AS (SELECT DISTINCT unnest(list_concat({_ALLWORDS}, (SELECT flatten(list(ex)) FROM ph))) AS w), ew AS (SELECT DISTINCT repo_id, w FROM code_files JOIN wd ON contains(lower(path), w)), ev AS (SELECT repo_id, list(w) AS ev FROM ew GROUP BY 1),
pe AS (SELECT ev.repo_id, phrase, len(list_intersect(ex, ev)) > 0 AS hit FROM ev, ph), de AS (SELECT brief_id, repo_id, i, deliverables[i] AS d FROM br, LATERAL unnest(range(1, len(deliverables) + 1)) AS u(i)),
dx AS (SELECT brief_id, flatten(list(ex)) AS dk FROM de JOIN ph ON ph.phrase = de.d GROUP BY 1),
dh AS (SELECT brief_id, string_agg(d, '|' ORDER BY i) FILTER (WHERE coalesce(hit, false)) AS ins, count(*) FILTER (WHERE coalesce(hit, false)) AS n_in, string_agg(d, '|' ORDER BY i) FILTER (WHERE NOT coalesce(hit, false)) AS mis, count(*) FILTER (WHERE NOT coalesce(hit, false)) AS n_mis
  FROM de LEFT JOIN pe ON pe.repo_id = de.repo_id AND pe.phrase = de.d GROUP BY 1),
sm AS (SELECT br.*, coalesce(ins, '') AS in_scope, coalesce(n_in, 0) AS n_in, coalesce(mis, '') AS missing, coalesce(n_mis, 0) AS n_mis, coalesce(pe.hit, false) AS promised_hit,
  list_filter([{', '.join(f"CASE WHEN len(list_intersect(coalesce(ev, []), {[n, *ms]})) > 0 THEN CASE WHEN {_TOUCH('ph.ex', n, ms)} THEN '{n}:excluded' WHEN NOT ({_TOUCH('coalesce(dk, [])', n, ms)}) THEN '{n}:unplanned' END END" for n, ms in sc.MARKERS.items())}], lambda x: x IS NOT NULL) AS outs
  FROM br LEFT JOIN dh ON dh.brief_id = br.brief_id LEFT JOIN dx ON dx.brief_id = br.brief_id LEFT JOIN ev ON ev.repo_id = br.repo_id JOIN ph ON ph.phrase = br.exclusion LEFT JOIN pe ON pe.repo_id = br.repo_id AND pe.phrase = br.promised)"""


def _match(spark, sf):
    b = _briefs(spark, sf)
    return sc.scope_match(b, dt.code_paths(spark, sf).select("repo_id", F.col("path").alias("text"))), b


@query("j22_scope_match", f"WITH {_SCOPE} SELECT brief_id, repo_id, in_scope, missing AS missing_planned, array_to_string(outs, '|') AS out_of_scope, CASE WHEN promised_hit THEN promised ELSE '' END AS promised_found FROM sm")
def j22(spark, sf):
    m, _ = _match(spark, sf)
    return m.select("brief_id", "repo_id", *[F.array_join(c, "|").alias(c) for c in ("in_scope", "missing_planned", "out_of_scope", "promised_found")])


@query("a39_drift_status", f"""WITH {_SCOPE}, f AS (SELECT brief_id, repo_id, len(deliverables) AS n, n_in, n_mis, len(outs) AS n_out, coalesce(CAST(substr(repo_id, 5) AS INTEGER) % 7 * 20, 0) > 80 AND NOT regexp_matches(cons, '(?i)dep|librar|package|bundle|size') AS creep FROM sm)
SELECT brief_id, repo_id, CASE WHEN n = 0 THEN CASE WHEN n_out > 0 THEN 'at-risk' ELSE 'on-scope' END WHEN n_mis > 0 AND n_in = 0 THEN 'blocked' WHEN n_out = 0 AND n_mis = 0 THEN 'on-scope' WHEN n_out > 2 OR n_mis > 3 THEN 'drifting' ELSE 'at-risk' END AS status,
 concat_ws(',', CASE WHEN n_out > 0 THEN 'feature-creep' END, CASE WHEN n_mis > 0 THEN 'missing-planned' END, CASE WHEN creep THEN 'dependency-creep,technical-complexity-creep' END) AS drift_categories, CAST(n_out AS INTEGER) AS n_out_of_scope FROM f""")
def a39(spark, sf):
    m, b = _match(spark, sf)
    deps = b.select("repo_id").distinct().withColumn("dependencies", F.substring("repo_id", 5, 9).cast("int") % 7 * 20)
    return sc.drift_status(m, b, deps).select("brief_id", "repo_id", "status", F.array_join("drift_categories", ",").alias("drift_categories"), "n_out_of_scope")


_INTENTS = ("Users can upload files. Must not store secrets. We use stripe and aws.", "- checkout page\n## Goals\nAs a manager, see reports. Must be fast.", "Build search; without downtime. Role: admin\nlatency below 10 ms.", "plain words only")


def _intent_sql(patterns) -> str:
    found = "list_concat(" + ", ".join(f"regexp_extract_all(t, {lit(p)}, 1)" for p in patterns) + ")"
    clean = f"list_transform({found}, lambda v: trim(regexp_replace(regexp_replace(v, '[`*_#>-]+', ' ', 'g'), '\\s+', ' ', 'g')))"
    cap = f"list_transform({clean}, lambda v: CASE WHEN regexp_matches(v, '^[a-z]') THEN upper(left(v, 1)) || substr(v, 2) ELSE v END)"
    ok = f"list_filter({cap}, lambda v: length(v) > 3 AND length(v) < 200)"
    return f"array_to_string(list_filter({ok}, lambda v, i: list_position({ok}, v) = i), '|')"


@query("f15_extract_intent", f"""WITH d AS (SELECT doc_id, list_extract([{', '.join(lit(x) for x in _INTENTS)}], CAST(doc_id % 4 AS INTEGER) + 1) || chr(10) || text AS t FROM documents)
SELECT doc_id, {_intent_sql(sc.FEATURE_PATTERNS)} AS features, {_intent_sql(sc.CONSTRAINT_PATTERNS)} AS constraints, {_intent_sql(sc.PERSONA_PATTERNS)} AS personas, {_intent_sql(sc.QUALITY_PATTERNS)} AS quality FROM d""")
def f15(spark, sf):
    d = dt.table(spark, sf, "documents").select("doc_id", F.concat_ws("\n", _pick(_INTENTS, F.col("doc_id") % 4), "text").alias("text"))
    cols = ("features", "constraints", "personas", "quality")
    return sc.extract_intent(d).select("doc_id", *[F.array_join(c, "|").alias(c) for c in cols])


_ITEMS = ", ".join(f"CASE WHEN regexp_matches(lower(t), '(?:^|[^a-z0-9]){m.replace('.', chr(92) + '.')}(?:[^a-z0-9]|$)') THEN '{m}' END" for m in sc.INTEGRATIONS)


@query("f15_integrations", f"SELECT id, array_to_string(list_filter([{_ITEMS}], lambda x: x IS NOT NULL), '|') AS integrations FROM (SELECT doc_id AS id, text || ' ' || list_extract({list(_INTENTS)}, CAST(doc_id % 4 AS INTEGER) + 1) AS t FROM documents)")
def f15b(spark, sf):
    d = dt.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat_ws(" ", "text", _pick(_INTENTS, F.col("doc_id") % 4)).alias("text"))
    return sc.extract_intent(d).select("id", F.array_join("integrations", "|").alias("integrations"))


@query("f14_keywords", f"SELECT doc_id, array_to_string(list_sort({_KW('text')}), ' ') AS keywords FROM documents")
def f14(spark, sf):
    return dt.table(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(sc.keywords("text")), " ").alias("keywords"))


_GT = ("code-present", "tests-present", "deploy-preview", "health-endpoint", "docs-updated", "security", "performance", "manual-qa", "other")
_CRIT = ("click view", "stripe billing", "a b c", "error, purchase")


def _gate_scans(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    return dt.table(spark, sf, "events").select(
        F.col("event_id").alias("scan_id"), F.concat(F.lit('{"event": "'), "event_type", F.lit('", "url": "/health'), F.when(k % 3 == 0, "z").otherwise(""), F.lit('"}')).alias("report_text"),
        F.lit("{}").alias("builder_text"), F.array(F.when(k % 4 == 0, "Express").otherwise("Vite")).alias("stack"), (k % 3).alias("test_file_count"), (k % 5 == 0).alias("has_dockerfile"), (k % 7 == 0).alias("has_ci"),
        k.alias("deployment_score"), (F.lit(100) - k).alias("readme_completeness"), (k % 70).alias("docs_score"), (k % 2).alias("secrets_found"), F.when(k % 6 == 0, "HIGH").otherwise("low").alias("highest_severity"),
        k.alias("quality_score"), (k % 2 == 0).alias("has_logging"))


@query("j23_evaluate_gates", f"""WITH s AS (SELECT event_id AS scan_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type FROM events), g AS (SELECT o_orderkey AS gate_id, o_orderkey % 12000 AS scan_id, list_extract({list(_GT)}, CAST(o_orderkey % 9 AS INTEGER) + 1) AS type, list_extract({list(_CRIT)}, CAST(o_orderkey % 4 AS INTEGER) + 1) AS criterion FROM orders),
r AS (SELECT g.*, k, '{{"event": "' || event_type || '", "url": "/health' || CASE WHEN k % 3 = 0 THEN 'z' ELSE '' END || '"}}' AS t FROM g LEFT JOIN s ON s.scan_id = g.scan_id)
SELECT gate_id, scan_id, type, coalesce(CASE type WHEN 'code-present' THEN len(list_filter(regexp_split_to_array(lower(criterion), '[\\s,;]+'), lambda w: length(w) > 3 AND (contains(coalesce(t, ''), w) OR contains(CASE WHEN k % 4 = 0 THEN 'express' WHEN k IS NULL THEN '' ELSE 'vite' END, w)))) > 0
 WHEN 'tests-present' THEN k % 3 > 0 WHEN 'deploy-preview' THEN k % 5 = 0 OR k % 7 = 0 OR k >= 60 WHEN 'health-endpoint' THEN contains(coalesce(t, ''), '/health') OR k % 4 = 0 WHEN 'docs-updated' THEN 100 - k >= 60 OR k % 70 >= 60
 WHEN 'security' THEN k IS NULL OR (k % 2 = 0 AND k % 6 <> 0) WHEN 'performance' THEN k >= 70 AND k % 2 = 0 END, false) AS passed, type NOT IN ('manual-qa', 'other') AS auto_evaluated FROM r""")
def j23(spark, sf):
    g = dt.table(spark, sf, "orders").select(F.col("o_orderkey").alias("gate_id"), (F.col("o_orderkey") % 12000).alias("scan_id"), _pick(_GT, F.col("o_orderkey") % 9).alias("type"), _pick(_CRIT, F.col("o_orderkey") % 4).alias("criterion"))
    return sc.evaluate_gates(g, _gate_scans(spark, sf))


_AGENTS = "- **🔴 No eval in code**\n- **Keep small files**\ntext\n- plain"


@query("j25_guideline_compliance", """WITH v AS (SELECT 'g' || CAST(o_custkey % 400 AS VARCHAR) AS repo_id, list_extract(['no-eval', 'small-files', 'write-tests'], CAST(o_orderkey % 3 AS INTEGER) + 1) AS rule_id, CASE WHEN o_orderkey % 11 = 0 THEN 'must' ELSE 'should' END AS severity FROM orders),
g AS (SELECT repo_id, CAST(coalesce(sum(CASE WHEN rule_id IN ('no-eval', 'small-files') AND CAST(substr(repo_id, 2) AS INTEGER) % 2 = 0 THEN 1 END), 0) AS BIGINT) AS declared_violations, CAST(coalesce(sum(CASE WHEN NOT (rule_id IN ('no-eval', 'small-files') AND CAST(substr(repo_id, 2) AS INTEGER) % 2 = 0) THEN 1 END), 0) AS BIGINT) AS other_violations,
 CAST(coalesce(sum(CASE WHEN severity = 'must' THEN 1 END), 0) AS BIGINT) AS critical FROM v GROUP BY 1) SELECT *, CAST(greatest(0, 100 - (declared_violations + other_violations) * 10) AS INTEGER) AS score, critical = 0 AS passed FROM g""")
def j25(spark, sf):
    oo = dt.table(spark, sf, "orders")
    v = oo.select(F.concat(F.lit("g"), (F.col("o_custkey") % 400).cast("string")).alias("repo_id"), _pick(("no-eval", "small-files", "write-tests"), F.col("o_orderkey") % 3).alias("rule_id"), F.when(F.col("o_orderkey") % 11 == 0, "must").otherwise("should").alias("severity"))
    c = dt.table(spark, sf, "orders").select((F.col("o_custkey") % 400).alias("i")).distinct().filter("i % 2 = 0")
    return sc.guideline_compliance(c.select(F.concat(F.lit("g"), F.col("i").cast("string")).alias("repo_id"), F.lit(_AGENTS).alias("content")), v)


@query("j26_rules_for", "WITH a AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS repo_id, c_custkey % 3 AS security_issues, c_custkey % 7 AS ai_patterns, c_custkey % 5 = 0 AS is_education, c_custkey % 25 AS file_count, c_custkey % 2 = 0 AS has_ci, CASE WHEN c_custkey % 4 = 0 THEN ['py'] ELSE ['TypeScript', 'py'] END AS languages, c_custkey % 6 = 0 AS has_tests FROM customer) "
       + " UNION ALL ".join(f"SELECT repo_id, {i} AS rule_no, {lit(r)} AS rule, {lit(s)} AS severity FROM a WHERE {c.replace('array_contains', 'list_contains')}" for i, (r, s, c, _) in enumerate(sc.GUIDELINES)))
def j26(spark, sf):
    a = dt.table(spark, sf, "customer").selectExpr("concat('c', cast(c_custkey as string)) AS repo_id", "c_custkey % 3 AS security_issues", "c_custkey % 7 AS ai_patterns", "c_custkey % 5 = 0 AS is_education", "c_custkey % 25 AS file_count", "c_custkey % 2 = 0 AS has_ci",
                                                   "CASE WHEN c_custkey % 4 = 0 THEN array('py') ELSE array('TypeScript', 'py') END AS languages", "c_custkey % 6 = 0 AS has_tests")
    return sc.rules_for(a)


@query("a44_codebase_summary")
def a44(spark, sf):
    f = dt.code_files(spark, sf).unionByName(dt.root_files(spark, sf))
    scan = ai.ai_pattern_scan(f)
    found = production.production_files(f).select("repo_id", "rule", "category").unionByName(scan.select("repo_id", "rule", "category"))
    return sc.codebase_summary(f, f.select("repo_id", "path"), ai.vibe_index(scan, f), found).withColumn("languages", F.array_join("languages", ","))


# --- impact ----------------------------------------------------------------------------------------------------

def _changes(spark, sf):
    """Pull requests of ten derived files each; some files are removed or come without content."""
    f = dt.code_files(spark, sf)
    n = F.regexp_extract("path", r"(\d+)", 1).cast("long")
    kind = F.when(n % 9 == 0, "removed").when(n % 2 == 0, "added").otherwise("modified")
    return f.select(
        F.concat_ws("-", "repo_id", (n % 300).cast("string")).alias("pr_id"), F.concat(F.col("path"), F.lit("#"), n.cast("string")).alias("path0"), "path", kind.alias("kind"),
        F.when(n % 17 == 0, "").when(kind != "removed", F.col("content")).alias("content"), F.when(kind == "removed", F.col("content")).alias("previous_content"),
        F.when(n % 4 == 0, (n % 50).cast("int")).alias("lines_added"), F.when(n % 12 == 0, (n % 30).cast("int")).alias("lines_removed")).drop("path0")


_CHG = f"""chg AS (SELECT repo_id, repo_id || '-' || CAST(n % 300 AS VARCHAR) AS pr_id, path, kind, CASE WHEN n % 17 = 0 THEN '' WHEN kind <> 'removed' THEN content END AS content, CASE WHEN kind = 'removed' THEN content END AS previous_content,
  CASE WHEN n % 4 = 0 THEN n % 50 END AS lines_added, CASE WHEN n % 12 = 0 THEN n % 30 END AS lines_removed FROM (SELECT *, CASE WHEN n % 9 = 0 THEN 'removed' WHEN n % 2 = 0 THEN 'added' ELSE 'modified' END AS kind FROM (SELECT *, CAST(regexp_extract(path, '(\\d+)', 1) AS BIGINT) AS n FROM code_files)))"""
_PEN = "CASE h.severity WHEN 'critical' THEN 4.0 WHEN 'high' THEN 2.5 WHEN 'medium' THEN 1.0 WHEN 'low' THEN 0.25 ELSE 0.5 END * h.n"
_LC = "len(string_split(content, chr(10)))"
_REASONS = f"""{dt.CODE_LINES}, {_AI}, {_CHG}, live AS (SELECT * FROM chg WHERE kind <> 'removed' AND coalesce(content, '') <> ''),
rs AS (SELECT l.pr_id, l.path, l.kind, h.rule AS reason, -CAST({_PEN} AS DOUBLE) AS points, CAST({_PEN} AS DOUBLE) AS vp FROM ai JOIN live l ON l.path = ai.path AND l.repo_id = ai.repo_id
  UNION ALL SELECT pr_id, path, kind, 'removed', least(2.0, 0.2 * log2(1 + coalesce(lines_removed, len(string_split(previous_content, chr(10))), 0))), 0 FROM chg WHERE kind = 'removed'
  UNION ALL SELECT pr_id, path, kind, 'no-content', 0, 0 FROM chg WHERE kind <> 'removed' AND coalesce(content, '') = ''
  UNION ALL SELECT pr_id, path, kind, 'test-file', least(3.0, {_LC} * 0.05), 0 FROM live WHERE regexp_matches(path, '\\.(?:test|spec)\\.[jt]sx?$')
  UNION ALL SELECT pr_id, path, kind, 'large-file', -least(3.0, ({_LC} - 600) / 200), 0 FROM live WHERE {_LC} > 600
  UNION ALL SELECT pr_id, path, kind, 'async-unguarded', -1.5, 0 FROM live WHERE regexp_matches(content, 'async\\s+function|async\\s*\\(') AND NOT regexp_matches(content, 'try\\s*\\{{|\\.catch\\(')),
fi AS (SELECT c.pr_id, c.path, c.kind, floor(greatest(-15.0, least(10.0, coalesce(sum(floor(points * 10000 + 0.5)) / 10000, 0))) * 10 + 0.5) / 10 AS score_delta, floor(coalesce(sum(floor(vp * 10000 + 0.5)) / 10000, 0) * 10 + 0.5) / 10 AS vibe_contribution, count(reason) AS n_reasons
  FROM (SELECT DISTINCT pr_id, path, kind FROM chg) c LEFT JOIN rs ON rs.pr_id = c.pr_id AND rs.path = c.path AND rs.kind = c.kind GROUP BY 1, 2, 3)"""


@query("a25_pr_file_impact", f"WITH {_REASONS} SELECT * FROM fi")
def a25(spark, sf):
    return im.pr_file_impact(_changes(spark, sf))


@query("a26_pr_impact", f"""WITH {_REASONS}, cur AS (SELECT DISTINCT pr_id, CAST(length(pr_id) * 7 % 101 AS INTEGER) AS current_score FROM chg), d AS (SELECT pr_id, sum(floor(score_delta * 10 + 0.5)) / 10 AS d, count(*) AS files FROM fi GROUP BY 1),
sz AS (SELECT pr_id, CAST(sum(CASE WHEN coalesce(lines_added, 0) + coalesce(lines_removed, 0) > 0 THEN coalesce(lines_added, 0) + coalesce(lines_removed, 0) ELSE ceil(length(coalesce(content, '')) / 50) END) AS BIGINT) AS lines FROM chg GROUP BY 1),
p AS (SELECT cur.*, files, lines, CAST(greatest(0, least(100, floor(current_score + d + 0.5))) AS INTEGER) AS predicted_score FROM cur JOIN d ON d.pr_id = cur.pr_id JOIN sz ON sz.pr_id = cur.pr_id)
SELECT pr_id, current_score, predicted_score, predicted_score - current_score AS total_delta, files, lines, CASE WHEN lines < 200 THEN 'high' WHEN lines < 1000 THEN 'medium' ELSE 'low' END AS confidence FROM p""")
def a26(spark, sf):
    c = _changes(spark, sf)
    cur = c.select("pr_id").distinct().withColumn("current_score", (F.length("pr_id") * 7 % 101).cast("int"))
    return im.pr_impact(im.pr_file_impact(c), c, cur).drop("vibe_index", "vibe_direction")


@query("a26_top_changes", f"""WITH {_REASONS} SELECT pr_id, path, score_delta, 'win' AS kind_of FROM fi WHERE score_delta > 0 QUALIFY row_number() OVER (PARTITION BY pr_id ORDER BY score_delta, path) <= 3
UNION ALL SELECT pr_id, path, score_delta, 'risk' FROM fi WHERE score_delta < 0 QUALIFY row_number() OVER (PARTITION BY pr_id ORDER BY score_delta DESC, path) <= 3""")
def a26b(spark, sf):
    return im.top_changes(im.pr_file_impact(_changes(spark, sf)), 3).select("pr_id", "path", "score_delta", "kind_of")


_CAT = "CASE reason " + " ".join(f"WHEN {lit(k)} THEN {lit(v[0])}" for k, v in im.REASONS.items()) + " END"
_FIX = "CASE reason " + " ".join(f"WHEN {lit(k)} THEN {lit(v[1])}" for k, v in im.REASONS.items() if v[1]) + " END"
_EFF = "CASE reason " + " ".join(f"WHEN {lit(k)} THEN {lit(v[2])}" for k, v in im.REASONS.items() if v[2]) + " END"
_MUL = "CASE reason " + " ".join(f"WHEN {lit(k)} THEN {v[3]}::DOUBLE" for k, v in im.REASONS.items() if v[3]) + " END"


@query("a27_impact_breakdown", f"""WITH {_REASONS}, b AS (SELECT rs.pr_id, {_CAT} AS category, sum(floor(score_delta / n_reasons * 1000000 + 0.5)) / 1000000 AS d, count(DISTINCT rs.path) AS files FROM rs JOIN fi ON fi.pr_id = rs.pr_id AND fi.path = rs.path AND fi.kind = rs.kind WHERE n_reasons > 0 GROUP BY 1, 2)
SELECT pr_id, category, floor(d * 10 + 0.5) / 10 AS delta, files FROM b""")
def a27(spark, sf):
    r, impact = im.pr_reasons_and_impact(_changes(spark, sf))
    return im.impact_breakdown(impact, r)


_RECS = f"""rec AS (SELECT rs.pr_id, rs.path, reason, {_FIX} AS fix, {_EFF} AS effort, floor(abs(score_delta) * {_MUL} * 10 + 0.5) / 10 AS points_saved FROM rs JOIN fi ON fi.pr_id = rs.pr_id AND fi.path = rs.path AND fi.kind = rs.kind WHERE score_delta < 0 AND fi.kind <> 'removed' AND {_FIX} IS NOT NULL),
rv AS (SELECT *, points_saved / (CASE effort WHEN 'trivial' THEN 0 WHEN 'small' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END + 1) AS value FROM rec)"""


@query("t4_fix_recommendations", f"WITH {_REASONS}, {_RECS} SELECT pr_id, path, reason, fix, effort, points_saved, round(value, 6) AS value FROM rv")
def t4(spark, sf):
    r, impact = im.pr_reasons_and_impact(_changes(spark, sf))
    return im.fix_recommendations(impact, r).withColumn("value", F.round("value", 6))


@query("t4_fix_shortlists", f"WITH {_REASONS}, {_RECS} SELECT pr_id, path, reason, CASE WHEN effort IN ('trivial', 'small') THEN 'quick-win' ELSE 'refactor' END AS bucket FROM rv QUALIFY row_number() OVER (PARTITION BY pr_id, CASE WHEN effort IN ('trivial', 'small') THEN 1 ELSE 2 END ORDER BY value DESC, path, reason) <= 5")
def t4b(spark, sf):
    r, impact = im.pr_reasons_and_impact(_changes(spark, sf))
    return im.fix_shortlists(im.fix_recommendations(impact, r), 5).select("pr_id", "path", "reason", "bucket")


_AG = ("", "## Rules\nshort", "## Security first\n" + "line\n" * 12)


def _trust_in(spark, sf):
    s = dt.scans(spark, sf)
    k = F.col("scan_id")
    return s.select("scan_id", "overall_score", F.col("vibe_score").alias("vibe_index"), F.when(k % 4 > 0, (k % 90).cast("int")).alias("readability"), (k % 3).cast("int").alias("critical"), (k % 4).cast("int").alias("high"), (k % 9).cast("int").alias("medium"), (k % 5).cast("int").alias("low"),
                    _pick(_AG, k % 3).alias("agents_content"), F.when(k % 3 > 0, (k % 2500).cast("int")).alias("agents_tokens"))


_TR = f"""{dt.SCANS}, ti AS (SELECT scan_id, overall_score, vibe_score AS vibe_index, CASE WHEN scan_id % 4 > 0 THEN scan_id % 90 END AS readability, scan_id % 3 AS c, scan_id % 4 AS h, scan_id % 9 AS m, scan_id % 5 AS l, scan_id % 3 AS a, CASE WHEN scan_id % 3 > 0 THEN scan_id % 2500 END AS tk FROM scans),
tt AS (SELECT *, greatest(0, least(100, 100 - (c * 20 + h * 8 + m * 3 + l))) AS t_security, CASE WHEN a = 0 THEN 0 ELSE greatest(0, least(100, 50 + CASE WHEN tk < 800 THEN 25 WHEN tk > 2000 THEN -20 ELSE 0 END + CASE WHEN a = 2 THEN 10 ELSE 0 END + 5 - CASE WHEN a = 1 THEN 15 ELSE 0 END)) END AS t_agents FROM ti),
tr AS (SELECT *, CAST(floor((overall_score * 40 + greatest(0, 100 - vibe_index) * 20 + coalesce(readability, 0) * 15 + t_security * 15 + t_agents * 10) / 100 + 0.5) AS INTEGER) AS trust FROM tt)"""


@query("a28_trust_score", f"WITH {_TR} SELECT scan_id, trust, CASE WHEN trust >= 95 THEN 'A+' WHEN trust >= 85 THEN 'A' WHEN trust >= 70 THEN 'B' WHEN trust >= 55 THEN 'C' WHEN trust >= 40 THEN 'D' ELSE 'F' END AS trust_grade, CAST(t_security AS INTEGER) AS t_security, CAST(t_agents AS INTEGER) AS t_agents FROM tr")
def a28(spark, sf):
    return im.trust_score(_trust_in(spark, sf)).select("scan_id", "trust", "trust_grade", F.col("t_security").cast("int").alias("t_security"), F.col("t_agents").cast("int").alias("t_agents"))


@query("t5_trust_recommendations", f"""WITH {_TR}, r AS (SELECT scan_id, 0 AS ord, 'write-guidelines' AS action, 10 AS gain FROM tr WHERE a = 0 UNION ALL SELECT scan_id, 0, 'trim-guidelines', 6 FROM tr WHERE a > 0 AND tk > 2000
 UNION ALL SELECT scan_id, 1, 'reduce-generated-patterns', CAST(floor(vibe_index * 0.15 + 0.5) AS INTEGER) FROM tr WHERE vibe_index >= 50 UNION ALL SELECT scan_id, 2, 'fix-critical-security', c * 8 FROM tr WHERE c > 0 UNION ALL SELECT scan_id, 3, 'split-files-and-test', 6 FROM tr WHERE readability < 60 UNION ALL SELECT scan_id, 4, 'improve-code-health', 12 FROM tr WHERE overall_score < 60)
SELECT scan_id, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY gain DESC, ord) AS INTEGER) AS rank, action, CAST(gain AS INTEGER) AS gain FROM r QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY gain DESC, ord) <= 3""")
def t5(spark, sf):
    return im.trust_recommendations(_trust_in(spark, sf)).drop("effort")


@query("a29_overall_score", f"WITH s AS (SELECT event_id AS scan_id, event_id % 101 AS security, event_id % 97 AS quality, event_id % 89 AS vibe, event_id % 83 AS architecture, event_id % 79 AS deployment, event_id % 73 AS documentation, CASE WHEN event_id % 2 = 0 THEN event_id % 71 END AS license, event_id % 67 AS market FROM events) SELECT scan_id, CAST(floor(({' + '.join(f'coalesce({n}, 0) * {w}' for n, w in im.DIMENSION_WEIGHTS.items())}) / 100 + 0.5) AS INTEGER) AS overall FROM s")
def a29(spark, sf):
    s = dt.table(spark, sf, "events").selectExpr("event_id AS scan_id", *[f"event_id % {m} AS {n}" for n, m in (("security", 101), ("quality", 97), ("vibe", 89), ("architecture", 83), ("deployment", 79), ("documentation", 73), ("market", 67))], "CASE WHEN event_id % 2 = 0 THEN event_id % 71 END AS license")
    return im.overall_score(s).select("scan_id", "overall")


@query("a29_private_report", """SELECT 'c' || CAST(c_custkey AS VARCHAR) AS repo_id, CAST(c_custkey % 101 AS INTEGER) AS overall_score, CASE WHEN c_custkey % 101 >= 80 THEN 'B+' WHEN c_custkey % 101 >= 60 THEN 'C' WHEN c_custkey % 101 >= 40 THEN 'D' ELSE 'F' END AS grade,
 CASE WHEN c_custkey % 101 >= 80 THEN 'Production' WHEN c_custkey % 101 >= 60 THEN 'Beta' ELSE 'MVP' END AS maturity, CAST(greatest(0, 100 - (c_custkey % 13) * 10) AS INTEGER) AS security, CAST(CASE WHEN c_custkey % 3 > 0 THEN 40 ELSE 70 END AS INTEGER) AS architecture FROM customer""")
def a29b(spark, sf):
    c = dt.table(spark, sf, "customer").selectExpr("concat('c', cast(c_custkey as string)) AS repo_id", "cast(c_custkey % 101 as int) AS overall", "c_custkey % 13 AS secrets", "c_custkey % 3 AS xlarge")
    return im.private_report(c, c.select("repo_id", "secrets"), c.select("repo_id", "xlarge"))


# --- sources ---------------------------------------------------------------------------------------------------

@query("io2_select_sources", f"WITH {dt.CODE_FILES}, {dt.ROOTS}, f AS (SELECT * FROM code_files UNION ALL SELECT * FROM root_files) SELECT repo_id, path FROM f WHERE regexp_extract(path, '(\\.[^.]*)$', 1) IN ({', '.join(lit(e) for e in sfiles.UPLOAD_EXT)})")
def io2(spark, sf):
    return sfiles.select_sources(dt.code_files(spark, sf).unionByName(dt.root_files(spark, sf))).select("repo_id", "path")


@query("io3_stratified_sample", f"""WITH {dt.DOC_FILES}, d AS (SELECT *, string_split(path, '/')[1] AS dir FROM doc_files), r AS (SELECT *, row_number() OVER (PARTITION BY repo_id, dir ORDER BY path) AS rn, min(path) OVER (PARTITION BY repo_id, dir) AS f FROM d)
SELECT repo_id, path, length(content) AS n FROM r WHERE rn <= 5 QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY rn, f) <= 12""")
def io3(spark, sf):
    return sfiles.stratified_sample(dt.doc_files(spark, sf), max_total=12, max_per_dir=5).select("repo_id", "path", F.length("content").cast("long").alias("n"))


def _sarif_reports(spark, sf):
    li = dt.table(spark, sf, "lineitem")
    sev = F.when(F.col("l_returnflag") == "R", F.lit('"properties": {"severity": "ERROR"}')).when(F.col("l_returnflag") == "A", F.lit('"level": "note"')).otherwise(F.lit('"level": "warning"'))
    js = F.concat(F.lit('{"runs": [{"results": [{"ruleId": "t'), (F.col("l_orderkey") % 7).cast("string"), F.lit('", '), sev, F.lit(', "message": {"text": "m"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "p'), F.col("l_partkey").cast("string"), F.lit('"}}}]}]}]}'))
    return li.select(F.col("l_suppkey").cast("string").alias("repo_id"), js.alias("json"))


_TREE_DIR = ("src/lib", "node_modules/x", "app", "dist/js", "src/build")
_TREE_EXT = (".ts", ".md", ".py", ".min.js", "")


@query("io1_read_tree", f"""WITH f AS (SELECT source AS repo_id, list_extract({list(_TREE_DIR)}, CAST(doc_id % 5 AS INTEGER) + 1) || '/f' || CAST(doc_id AS VARCHAR) || list_extract({list(_TREE_EXT)}, CAST(doc_id // 5 % 5 AS INTEGER) + 1) AS path, coalesce(text, '') AS content FROM documents)
SELECT repo_id, path, sha256(content) AS content_hash, CAST(length(content) AS INTEGER) AS n_chars FROM f WHERE regexp_matches(path, '[.](ts|py|js)$') AND NOT regexp_matches(path, '(^|/)(node_modules|dist|build)/')""")
def io1(spark, sf):
    """The documents are written as a tree of files first."""
    k = F.col("doc_id")
    path = F.concat(_pick(_TREE_DIR, k % 5), F.lit("/f"), k.cast("string"), _pick(_TREE_EXT, F.floor(k / 5) % 5))
    root = shared_dir(spark, "tree")
    tree.write_tree(dt.table(spark, sf, "documents").select(F.col("source").alias("repo_id"), path.alias("path"), F.col("text").alias("content")), root)
    return tree.read_tree(spark, root).select("repo_id", "path", tx.content_hash("content").alias("content_hash"), F.length("content").alias("n_chars"))


@query("io6_secret_hits", """SELECT 'det' || CAST(l_suppkey % 5 AS VARCHAR) AS detector, l_linenumber % 2 = 0 AS verified, CASE WHEN l_returnflag = 'A' THEN '' ELSE 'raw-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-value' END AS raw, count(*) AS n
FROM lineitem WHERE l_quantity % 7 <> 0 GROUP BY 1, 2, 3""")
def io6(spark, sf):
    """The line items are written as JSON lines first; a seventh of the lines is broken."""
    li = dt.table(spark, sf, "lineitem")
    raw = F.when(F.col("l_returnflag") != "A", F.concat(F.lit("raw-"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_partkey").cast("string"), F.lit("-value")))
    good = F.to_json(F.struct(F.concat(F.lit("det"), (F.col("l_suppkey") % 5).cast("string")).alias("DetectorName"), (F.col("l_linenumber") % 2 == 0).alias("Verified"), raw.alias("Raw")))
    path = shared_dir(spark, "hits")
    li.select(F.when(F.col("l_quantity") % 7 != 0, good).otherwise(F.lit('{"DetectorName": "det'))).write.text(path)
    return sn.read_secret_hits(spark, path, cut=None).groupBy("detector", "verified", "raw").agg(F.count("*").alias("n"))


@query("u2_distinct_values", f"WITH {dt.FINDINGS} SELECT DISTINCT rule, category, severity FROM findings")
def u2(spark, sf):
    return distinct_values(dt.findings(spark, sf), "rule", "category", "severity")


@query("io4_sarif_findings", "SELECT CAST(l_suppkey AS VARCHAR) AS repo_id, 't' || CAST(l_orderkey % 7 AS VARCHAR) AS rule, CASE l_returnflag WHEN 'R' THEN 'ERROR' WHEN 'A' THEN 'NOTE' ELSE 'WARNING' END AS severity, 'p' || CAST(l_partkey AS VARCHAR) AS path, 'm' AS detail, CAST(CASE l_returnflag WHEN 'R' THEN 0.9 WHEN 'A' THEN 0.3 ELSE 0.6 END AS DOUBLE) AS confidence FROM lineitem")
def io4(spark, sf):
    return sn.sarif_findings(sn.parse_reports(_sarif_reports(spark, sf), "json", sn.SARIF))


@query("io5_vuln_findings", "SELECT CAST(p_partkey AS VARCHAR) AS repo_id, 'CVE-' || CAST(p_partkey AS VARCHAR) AS vuln_id, p_brand AS package, CASE WHEN p_size > 25 THEN 'HIGH' ELSE 'LOW' END AS severity, p_name AS title, '1.' || CAST(p_size AS VARCHAR) AS installed, CAST(NULL AS VARCHAR) AS fixed FROM part")
def io5(spark, sf):
    p = dt.table(spark, sf, "part")
    v = F.struct(F.concat(F.lit("CVE-"), F.col("p_partkey").cast("string")).alias("VulnerabilityID"), F.col("p_brand").alias("PkgName"), F.when(F.col("p_size") > 25, "HIGH").otherwise("LOW").alias("Severity"), F.col("p_name").alias("Title"), F.concat(F.lit("1."), F.col("p_size").cast("string")).alias("InstalledVersion"))
    js = F.to_json(F.struct(F.array(F.struct(F.array(v).alias("Vulnerabilities"))).alias("Results")))
    return sn.vuln_findings(sn.parse_reports(p.select(F.col("p_partkey").cast("string").alias("repo_id"), js.alias("json")), "json", sn.VULNS))


@query("io7_dockerfile_score", """WITH n AS (SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'R' AND l_quantity > 49 THEN 10 WHEN l_returnflag = 'A' AND l_quantity > 48 THEN 3 ELSE 0 END) AS lost, count(*) AS violations FROM lineitem GROUP BY 1)
SELECT CAST(s_suppkey AS VARCHAR) AS repo_id, s_suppkey % 9 > 0 AS has_dockerfile, coalesce(violations, 0) AS violations, CAST(CASE WHEN s_suppkey % 9 = 0 THEN 0 WHEN s_suppkey % 10 = 3 THEN 50 ELSE greatest(0, 100 - coalesce(lost, 0)) END AS INTEGER) AS score FROM supplier LEFT JOIN n ON l_suppkey = s_suppkey""")
def io7(spark, sf):
    v = dt.table(spark, sf, "lineitem").selectExpr("cast(l_suppkey as string) AS repo_id", "CASE WHEN l_returnflag = 'R' AND l_quantity > 49 THEN 'error' WHEN l_returnflag = 'A' AND l_quantity > 48 THEN 'warning' ELSE 'info' END AS level")
    r = dt.table(spark, sf, "supplier").selectExpr("cast(s_suppkey as string) AS repo_id", "s_suppkey % 9 > 0 AS has_dockerfile", "s_suppkey % 10 = 3 AS tool_failed")
    return sn.dockerfile_score(v, r)


@query("io9_issues", "SELECT 'r' || CAST(l_orderkey AS VARCHAR) AS rule, CASE WHEN l_returnflag = 'R' THEN 'CRITICAL' WHEN l_returnflag = 'A' THEN 'MINOR' ELSE 'MAJOR' END AS severity, CASE WHEN l_linenumber % 2 = 0 THEN 'reliability' ELSE 'maintainability' END AS category, CAST(l_linenumber AS INTEGER) AS line FROM lineitem")
def io9(spark, sf):
    li = dt.table(spark, sf, "lineitem")
    obj = F.concat(F.lit('{"rule": "r'), F.col("l_orderkey").cast("string"), F.lit('", "severity": "'), F.when(F.col("l_returnflag") == "R", "critical").when(F.col("l_returnflag") == "A", "MINOR").otherwise("odd"), F.lit('", "type": "'),
                   F.when(F.col("l_linenumber") % 2 == 0, "BUG").otherwise("code_smell"), F.lit('", "line": "'), F.col("l_linenumber").cast("string"), F.lit('"}'))
    js = F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("["), obj, F.lit("]"))).otherwise(F.concat(F.lit('{"total": 1, "issues": ['), obj, F.lit("]}")))
    return sq.issues_of(li.select(js.alias("value"))).select("rule", "severity", "category", "line")


@query("io10_gate_thresholds", "SELECT CASE WHEN p_partkey % 3 = 0 THEN 'test_coverage' WHEN p_partkey % 3 = 1 THEN 'bugs' ELSE 'custom' END AS metric, CASE WHEN p_partkey % 2 = 0 THEN 'GT' ELSE 'LT' END AS operator, CAST(p_size AS DOUBLE) AS error_threshold, CAST(NULL AS DOUBLE) AS warning_threshold FROM part")
def io10(spark, sf):
    p = dt.table(spark, sf, "part")
    js = F.concat(F.lit('{"name": "g", "conditions": [{"metric": "'), F.when(F.col("p_partkey") % 3 == 0, "coverage").when(F.col("p_partkey") % 3 == 1, "bugs").otherwise("custom"), F.lit('", '),
                  F.when(F.col("p_partkey") % 2 == 0, F.lit('"op": "GT", ')).otherwise(""), F.lit('"error": "'), F.col("p_size").cast("string"), F.lit('", "warning": "none"}]}'))
    return sq.gate_thresholds(p.select(js.alias("value"))).drop("level")


_RK = ("squid-bug", "security-x", "code_smell", "performance", "design", "other", "debug")


def _profile(spark, sf):
    p = dt.table(spark, sf, "part")
    k = F.col("p_partkey")
    raw = p.select(_pick(_RK, k % 7).alias("repositoryKey"), F.concat(F.lit("S"), k.cast("string")).alias("key"), F.when(k % 4 == 0, "critical").when(k % 4 == 1, "odd").alias("priority"), F.when(k % 4 == 2, "info").alias("severity"),
                   F.struct(F.array(F.struct(F.lit("max").alias("key"), F.col("p_size").cast("string").alias("value"))).alias("parameter")).alias("parameters"))
    return sq.profile_rules(raw)


_PROF = f"prof AS (SELECT list_extract({list(_RK)}, CAST(p_partkey % 7 AS INTEGER) + 1) AS repository_key, 'S' || CAST(p_partkey AS VARCHAR) AS rule_key, CASE p_partkey % 4 WHEN 0 THEN 'CRITICAL' WHEN 2 THEN 'INFO' ELSE 'MAJOR' END AS severity, CAST(CASE p_partkey % 4 WHEN 0 THEN 0.85 WHEN 2 THEN 0.25 ELSE 0.7 END AS DOUBLE) AS weight, list_extract(['reliability', 'security', 'maintainability', 'performance', 'architecture', 'unknown', 'unknown'], CAST(p_partkey % 7 AS INTEGER) + 1) AS category, CAST(p_size AS VARCHAR) AS max FROM part)"


@query("io8_profile_rules", f"WITH {_PROF} SELECT * FROM prof")
def io8(spark, sf):
    return _profile(spark, sf).select("repository_key", "rule_key", "severity", "weight", "category", F.col("parameters")["max"].alias("max"))


@query("a38_migration_coverage", f"WITH {_PROF} SELECT severity, count(*) AS total, count(*) FILTER (WHERE category <> 'unknown') AS mapped, string_agg(DISTINCT CASE WHEN category = 'unknown' THEN repository_key END, ',' ORDER BY CASE WHEN category = 'unknown' THEN repository_key END) AS unmapped, count(*) FILTER (WHERE category <> 'unknown') / count(*) * 100 AS percent FROM prof GROUP BY 1")
def a38(spark, sf):
    return sq.migration_coverage(_profile(spark, sf), ["severity"]).withColumn("unmapped", F.array_join("unmapped", ","))


@query("u3_category_gaps", f"WITH {_PROF} SELECT s.severity, c.category FROM (SELECT DISTINCT severity FROM prof) s, (SELECT unnest({list(sq.BUILTIN_CATEGORIES)}) AS category) c WHERE NOT EXISTS (SELECT 1 FROM prof p WHERE p.severity = s.severity AND p.category = c.category)")
def u3(spark, sf):
    return sq.category_gaps(_profile(spark, sf), keys=["severity"])


@query("io17_migration_config", f"""WITH {_PROF} SELECT 'rule' AS section, rule_key AS key, '{{"ruleKey":"' || rule_key || '","source":"profile:' || repository_key || '","weight":' || CAST(weight AS VARCHAR) || ',"category":"' || category || '","parameters":{{"max":"' || max || '"}}}}' AS value FROM prof""")
def io17(spark, sf):
    rules = _profile(spark, sf)
    th = spark.createDataFrame([], "metric string, operator string, error_threshold double, warning_threshold double")
    return sq.migration_config(rules, th)


@query("io11_extract_deps", f"""WITH {dt.ROOTS}, j AS (SELECT repo_id, path, content FROM root_files WHERE path = 'package.json' AND json_valid(content)),
d AS (SELECT repo_id, path, k.kind AS kind, unnest(json_keys(content, '$.' || k.f)) AS name, k.f AS f, content FROM j, (SELECT unnest([{{'f': 'dependencies', 'kind': 'prod'}}, {{'f': 'devDependencies', 'kind': 'dev'}}]) AS k))
SELECT repo_id, path AS manifest_path, kind, name, json_extract_string(content, '$.' || f || '."' || name || '"') AS version FROM d
UNION ALL SELECT repo_id, path, 'alias', string_split(name, '/')[2], json_extract_string(content, '$.' || f || '."' || name || '"') FROM d WHERE starts_with(name, '@')
UNION ALL SELECT repo_id, path, 'prod', lower(unnest(regexp_extract_all(content, '(?m)^([A-Za-z0-9_.-]+)', 1))), '' FROM root_files WHERE path = 'requirements.txt'
UNION ALL SELECT repo_id, path, 'prod', lower(unnest(regexp_extract_all(content, '(?m)^[ \\t]*([A-Za-z0-9_.-]+)\\s*=\\s*[{{]', 1))), '' FROM root_files WHERE path = 'pyproject.toml'""")
def io11(spark, sf):
    return sfiles.extract_deps(dt.root_files(spark, sf))


_RESP = ('{"findings": [{"line": 3, "severity": "blocker", "category": "security", "type": "xss", "description": "d1", "confidence": 1.5}]}', 'Here:\n```json\n{"issues": [{"severity": "odd", "description": "Bad Thing!", "line": 0}]}\n```', 'text {"problems": [{"description": "a } brace", "severity": "note", "type": "t", "confidence": 0.4, "line": 2}, {"line": 1}]} tail', 'nothing', '[]')


@query("io13_normalize_findings", """SELECT event_id AS response_id, r.c AS category, r.s AS severity, CAST(CASE WHEN r.l > 0 THEN r.l + event_id % 10 ELSE 0 END AS INTEGER) AS line, r.t AS type, r.d AS description, CAST(r.f AS DOUBLE) AS confidence FROM (SELECT event_id, list_extract([
 {'c': 'security', 's': 'critical', 'l': 3, 't': 'xss', 'd': 'd1', 'f': 1.0}, {'c': 'quality', 's': 'medium', 'l': 0, 't': 'quality-bad-thing', 'd': 'Bad Thing!', 'f': 0.7}, {'c': 'quality', 's': 'info', 'l': 2, 't': 't', 'd': 'a } brace', 'f': 0.4}, NULL, NULL], CAST(event_id % 5 AS INTEGER) + 1) AS r FROM events) WHERE r IS NOT NULL""")
def io13(spark, sf):
    e = dt.table(spark, sf, "events").select(F.col("event_id").alias("response_id"), _pick(_RESP, F.col("event_id") % 5).alias("raw"), (F.col("event_id") % 10 + 1).cast("int").alias("start"))
    return sn.normalize_findings(sn.parse_responses(e, "raw", sn.RESPONSE), ["response_id"], "start").drop("recommendation")


@query("io14_diff_files", "SELECT DISTINCT 'd' || CAST(o_custkey % 20 AS VARCHAR) AS repo_id, unnest(['src/a' || CAST(o_orderkey AS VARCHAR) || '.ts', 'src/old' || CAST(o_orderkey % 50 AS VARCHAR) || '.ts']) AS path FROM orders")
def io14(spark, sf):
    k = F.col("o_orderkey").cast("string")
    diff = F.concat(F.lit("diff --git a b\n--- a/src/old"), (F.col("o_orderkey") % 50).cast("string"), F.lit(".ts\n+++ b/src/a"), k, F.lit(".ts\n@@ -1 +1 @@\n-x\n+y"))
    return sfiles.diff_files(dt.table(spark, sf, "orders").select(F.concat(F.lit("d"), (F.col("o_custkey") % 20).cast("string")).alias("repo_id"), diff.alias("diff")))


@query("io15_sarif_documents", f"WITH {dt.FINDINGS}, n AS (SELECT repo_id, count(*) AS results FROM findings GROUP BY 1) SELECT repo_id, results, CAST(ceil(results / 5000) AS INTEGER) AS parts FROM n")
def io15(spark, sf):
    d = sinks.to_sarif(dt.findings(spark, sf))
    n = F.size(F.from_json("document", sn.SARIF)["runs"][0]["results"])
    return d.groupBy("repo_id").agg(F.sum(n).alias("results"), F.count("*").cast("int").alias("parts"))


@query("io16_review_rows", f"WITH {dt.FINDINGS} SELECT repo_id, path, severity, 'L' || CAST(line AS VARCHAR) AS line, rule AS type, detail AS description FROM findings")
def io16(spark, sf):
    return sinks.review_rows(dt.findings(spark, sf))


_FIXABLE = [r for r in rt.REVIEW_RULES if r.name in sinks.AUTO_FIXABLE]


@query("p38_propose_patches", f"""WITH {dt.CODE_LINES}, h AS (SELECT DISTINCT repo_id, path, line, rule FROM ({o.line_hits(_FIXABLE, 'code_lines')})), l AS (SELECT h.*, text AS old_text FROM h JOIN code_lines c ON c.repo_id = h.repo_id AND c.path = h.path AND c.line = h.line)
SELECT * FROM (SELECT *, CASE WHEN rule = 'any-type-abuse' AND contains(old_text, ': any') THEN regexp_replace(old_text, ': any\\b', ': unknown', 'g') WHEN rule = 'debug-code' AND {o.contains('old_text', 'console.log', 'console.debug')} THEN '// removed debug output' || chr(10) || regexp_extract(old_text, '^(\\s*)', 1) || '// use a logger'
 WHEN rule = 'TASK-comment' THEN old_text || ' (tracked: see issue tracker)' WHEN rule = 'hardcoded-secret' THEN regexp_extract(old_text, '^(\\s*)', 1) || '// secret removed: read it from process.env' END AS new_text FROM l) WHERE new_text IS NOT NULL""")
def p38(spark, sf):
    return sinks.propose_patches(matching.match_lines(dt.code_files(spark, sf), _FIXABLE, with_text=True))


_CODE = ("export function add(a: number): number {\n  return a;\n}", "export const f = async () => { await go(); };", "function inner() { return validate(email); }", "export class A<T> { try {} catch (e) {} }")


@query("p34_sample_checks", f"""WITH s AS (SELECT o_custkey % 5 AS task_id, o_orderkey AS sample_id, list_extract([{', '.join(lit(c) for c in _CODE)}], CAST(o_orderkey % 4 AS INTEGER) + 1) AS code FROM orders)
SELECT sample_id, regexp_matches(code, 'export\\s+(?:default|const|function|class|\\{{)') AS has_export, o_t AS has_typing, NOT {o.contains('code', 'async ', 'await ', 'fetch(', 'Promise')} OR regexp_matches(code, 'try\\s*\\{{|\\.catch\\s*\\(') AS handles_errors,
 contains(lower(code), 'validat') OR contains(lower(code), 'valid') OR contains(lower(code), 'check') OR contains(lower(code), 'format') OR contains(lower(code), 'regex') AS has_required, NOT regexp_matches(lower(code), '\\bawait\\b') AS avoids_banned, regexp_matches(code, '\\binner\\b') AS has_names
FROM (SELECT *, regexp_matches(code, ':\\s*[\\w.]+(?:\\[\\])?\\s*[=),]|interface\\s+\\w+|type\\s+\\w+\\s*[<=]|<[A-Z]\\w*>') AS o_t FROM s)""")
def p34(spark, sf):
    s = dt.table(spark, sf, "orders").select((F.col("o_custkey") % 5).alias("task_id"), F.col("o_orderkey").alias("sample_id"), _pick(_CODE, F.col("o_orderkey") % 4).alias("code"))
    t = dt.table(spark, sf, "customer").select((F.col("c_custkey") % 5).alias("task_id")).distinct().select("task_id", F.lit(["validation"]).alias("required"), F.lit(["await"]).alias("banned"), F.lit(["inner"]).alias("names"))
    return sinks.sample_checks(s, t).drop("task_id", "passed")


# pointers from each line to the first line of the chunk after one that starts there, then a walk along them
_X3_LIMIT = 400 * 4
_X3 = f"""WITH RECURSIVE {dt.DOC_LINES},
l0 AS (SELECT repo_id, path, line - 1 AS i, text, length(text) AS n, regexp_matches(text, '^[ \\t\\v\\f\\r]*$') AS blank FROM doc_lines),
l1 AS (SELECT *, sum(n + 1) OVER w AS z,
  min(CASE WHEN NOT blank THEN i END) OVER (PARTITION BY repo_id, path ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM l0 WINDOW w AS (PARTITION BY repo_id, path ORDER BY i ROWS UNBOUNDED PRECEDING)),
l2 AS (SELECT a.*, a.i > 0 AND a.blank AND b.i IS NOT NULL AND NOT regexp_matches(b.text, '^[ \\t\\v\\f\\r]') AS gap FROM l1 a LEFT JOIN l0 b ON a.repo_id = b.repo_id AND a.path = b.path AND b.i = a.nxt),
l3 AS (SELECT repo_id, path, i, n, z, z - n - 1 AS x, text, max(CASE WHEN gap THEN i END) OVER (PARTITION BY repo_id, path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_gap FROM l2),
size AS (SELECT repo_id, path, count(*) AS lines, max(z) - 1 AS chars FROM l3 GROUP BY 1, 2),
ptr AS MATERIALIZED (SELECT s.repo_id, s.path, s.i, greatest(e.i, s.i + 1) AS full FROM l3 s ASOF JOIN l3 e ON s.repo_id = e.repo_id AND s.path = e.path AND s.x + {_X3_LIMIT} + 1 < e.z),
hop AS MATERIALIZED (SELECT p.repo_id, p.path, p.i, CASE WHEN f.last_gap > p.i THEN f.last_gap ELSE p.full END AS nxt FROM ptr p JOIN l3 f ON f.repo_id = p.repo_id AND f.path = p.path AND f.i = p.full),
walk AS (SELECT repo_id, path, 0 AS chunk, CAST(0 AS BIGINT) AS a, lines, chars FROM size
  UNION ALL SELECT w.repo_id, w.path, w.chunk + 1, CAST(h.nxt AS BIGINT), lines, chars FROM walk w JOIN hop h ON h.repo_id = w.repo_id AND h.path = w.path AND h.i = w.a WHERE chars > {_X3_LIMIT}),
c AS (SELECT *, coalesce(lead(a) OVER (PARTITION BY repo_id, path ORDER BY chunk), lines) AS z FROM walk)
SELECT c.repo_id, c.path, chunk, CAST(a + 1 AS INTEGER) AS start_line, CAST(c.z AS INTEGER) AS end_line,
 sha256(string_agg(CASE WHEN i + 1 < 1000 THEN lpad(CAST(i + 1 AS VARCHAR), 4, ' ') ELSE CAST(i + 1 AS VARCHAR) END || ' | ' || text, chr(10) ORDER BY i)) AS text_hash
FROM c JOIN l3 ON l3.repo_id = c.repo_id AND l3.path = c.path AND i >= a AND i < c.z GROUP BY 1, 2, 3, 4, 5"""


@query("x3_chunk_files", _X3)
def x3(spark, sf):
    c = sfiles.chunk_files(dt.doc_files(spark, sf), max_tokens=400)
    return c.select("repo_id", "path", "chunk", "start_line", "end_line", F.sha2("text", 256).alias("text_hash"))


# --- functions -----------------------------------------------------------------------------------------------------

@query("f_text_functions", f"""SELECT doc_id, CAST(ceil(length(text) / 4) AS INTEGER) AS tokens, sha256(text) AS content_hash, {o.count('text', '@<@[A-Za-z]+@>@')} AS words, CAST(len(string_split(text, chr(10))) AS INTEGER) AS lines,
 regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM documents""")
def f_text(spark, sf):
    d = dt.table(spark, sf, "documents")
    return d.select("doc_id", tx.token_estimate("text").alias("tokens"), tx.content_hash("text").alias("content_hash"), tx.rx_count("text", tx.BL + "[A-Za-z]+" + tx.BR).alias("words"), tx.line_count("text").alias("lines"),
                    tx.slug("text").alias("slug"))


@query("f13_repo_owner_name", "SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]+)/([^/?#]+)', 1) AS owner, regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]+)/([^/?#]+)', 2) AS name FROM pages")
def f13(spark, sf):
    return dt.table(spark, sf, "pages").select("page_id", tx.repo_owner_name("url").alias("r")).select("page_id", "r.owner", "r.name")


@query("f1_path_helpers", f"""WITH {dt.CODE_FILES} SELECT path, regexp_extract(path, '[^/]*$') AS base, regexp_replace(path, '/?[^/]*$', '') AS dir, regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\\.[^.]*)$', 1) AS ext, {o.contains('path', '.test.', '.spec.', '__tests__')} AS is_test FROM code_files""")
def f1(spark, sf):
    return dt.code_paths(spark, sf).select("path", tx.base_name("path").alias("base"), tx.directory("path").alias("dir"), tx.extension("path").alias("ext"), tx.is_test_path("path").alias("is_test"))


@query("f3_edit_distance", "SELECT a.p_partkey AS a, b.p_partkey AS b, CAST(CASE WHEN levenshtein(a.p_name, b.p_name) <= 4 THEN levenshtein(a.p_name, b.p_name) ELSE -1 END AS INTEGER) AS distance FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def f3(spark, sf):
    p = dt.table(spark, sf, "part")
    b = p.select((F.col("p_partkey") - 1).alias("a"), F.col("p_partkey").alias("b"), F.col("p_name").alias("other"))
    return p.join(b, p.p_partkey == b.a).select("a", "b", tx.edit_distance("p_name", "other", 4).alias("distance"))


@query("f6_rounding", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor((25 - l_quantity) / 2 + 0.5) AS BIGINT) AS whole, floor((25 - l_quantity) / 8 * 10 + 0.5) / 10 AS tenth, greatest(-5.0, least(5.0, 25 - l_quantity)) AS clamped FROM lineitem")
def f6(spark, sf):
    q = 25 - F.col("l_quantity")
    return dt.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", nm.js_round(q / 2).alias("whole"), nm.js_round(q / 8, 1).alias("tenth"), nm.clamp(q, -5.0, 5.0).alias("clamped"))


@query("f7_f8_f16_scores", f"""WITH {dt.SCANS}, {dt.FINDINGS} SELECT scan_id, CASE WHEN overall_score >= 90 THEN 'A' WHEN overall_score >= 80 THEN 'B' WHEN overall_score >= 70 THEN 'C' WHEN overall_score >= 60 THEN 'D' ELSE 'F' END AS submission,
 CASE WHEN overall_score >= 80 THEN 'bright-green' WHEN overall_score >= 60 THEN 'green' WHEN overall_score >= 40 THEN 'yellow' WHEN overall_score >= 20 THEN 'orange' ELSE 'red' END AS band FROM scans""")
def f7(spark, sf):
    return dt.scans(spark, sf).select("scan_id", nm.grade("overall_score", "submission").alias("submission"), nm.grade("overall_score", "band").alias("band"))


@query("f10_u4_u5_type_words", f"""WITH t AS (SELECT o_orderkey AS id, list_extract({list(_TYPES)}, CAST(o_orderkey % 7 AS INTEGER) + 1) AS a, list_extract({list(_TYPES)}, CAST(o_custkey % 7 AS INTEGER) + 1) AS b FROM orders)
SELECT id, {_CANON('a')} AS canonical, len(list_intersect(string_split(a, '-'), string_split(b, '-'))) > 0 AS overlap, round(len(list_intersect(string_split(a, '-'), string_split(b, '-'))) / len(list_distinct(list_concat(string_split(a, '-'), string_split(b, '-')))), 6) AS jaccard FROM t""")
def f10(spark, sf):
    t = dt.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), _pick(_TYPES, F.col("o_orderkey") % 7).alias("a"), _pick(_TYPES, F.col("o_custkey") % 7).alias("b"))
    return t.select("id", tx.canonical_type("a").alias("canonical"), tx.tokens_overlap("a", "b").alias("overlap"), F.round(tx.jaccard(F.split("a", "-"), F.split("b", "-")), 6).alias("jaccard"))


@query("f11_f12_json_dates", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, 'none' AS missing, CAST(ts AS DATE) AS day, CAST(floor((epoch(TIMESTAMP '2024-12-01') - floor(epoch(ts))) / 2592000) AS INTEGER) AS months FROM events")
def f11(spark, sf):
    e = dt.table(spark, sf, "events")
    return e.select("event_id", tx.json_field("props", "$.k").cast("int").alias("k"), tx.json_field("props", "$.absent", "none").alias("missing"), nm.utc_day("ts").alias("day"), nm.months_since("ts", F.lit("2024-12-01").cast("timestamp")).alias("months"))


# --- streaming ---------------------------------------------------------------------------------------------------------

def _pr_events(e):
    return e.selectExpr("ts", "concat('https://host.example/r', cast(user_id as string)) AS repo_url", "cast(value as int) % 20 AS pr_number", "concat('sha', cast(cast(value as int) % 50 as string)) AS head_sha",
                        "CASE event_type WHEN 'click' THEN 'opened' WHEN 'view' THEN 'synchronize' WHEN 'signup' THEN 'reopened' ELSE 'closed' END AS action")


def _configs(spark, sf):
    return dt.table(spark, sf, "events").selectExpr("user_id").distinct().selectExpr("user_id AS config_id", "concat('https://host.example/r', cast(user_id as string)) AS repo_url", "user_id % 3 > 0 AS enabled")


@query("st1_pr_intake", """SELECT DISTINCT user_id AS config_id, CAST(trunc(value) AS INTEGER) % 20 AS pr_number, 'sha' || CAST(CAST(trunc(value) AS INTEGER) % 50 AS VARCHAR) AS head_sha, CASE event_type WHEN 'click' THEN 'opened' WHEN 'view' THEN 'synchronize' ELSE 'reopened' END AS action, 'pending' AS status
FROM events WHERE event_type IN ('click', 'view', 'signup') AND user_id % 3 > 0""")
def st1(spark, sf):
    out = st.pr_intake(_pr_events(st.read_stream(spark, sf, "events")), _configs(spark, sf), delay="60 days")
    return st.run_available(out, "pr-intake").drop("ts")


@query("j27_pr_intake_batch", """SELECT DISTINCT user_id AS config_id, CAST(trunc(value) AS INTEGER) % 20 AS pr_number, 'sha' || CAST(CAST(trunc(value) AS INTEGER) % 50 AS VARCHAR) AS head_sha, CASE event_type WHEN 'click' THEN 'opened' WHEN 'view' THEN 'synchronize' ELSE 'reopened' END AS action, 'pending' AS status
FROM events WHERE event_type IN ('click', 'view', 'signup') AND user_id % 3 > 0""")
def j27(spark, sf):
    return st.pr_intake(_pr_events(dt.table(spark, sf, "events")), _configs(spark, sf)).drop("ts")


@query("st2_rate_violations", """WITH w AS (SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS window_start, user_id % 10 AS client_id, count(*) AS requests FROM events GROUP BY 1, 2)
SELECT window_start, window_start + INTERVAL '6 hours' AS window_end, client_id, requests FROM w WHERE requests > 10 AND window_start + INTERVAL '6 hours' <= (SELECT max(ts) FROM events) - INTERVAL '1 minute'""")
def st2(spark, sf):
    e = st.read_stream(spark, sf, "events").select("ts", (F.col("user_id") % 10).alias("client_id"))
    return st.wall_clock(st.run_available(st.rate_violations(e, limit=10, seconds=6 * 3600), "rate"))


@query("st3_latest_status", f"WITH {dt.SCANS} SELECT repo_url, arg_max(scan_id, created_at) AS scan_id, arg_max(status, created_at) AS status, arg_max(overall_score, created_at) AS overall_score, max(created_at) AS created_at, count(*) AS scans FROM scans GROUP BY 1")
def st3(spark, sf):
    e = st.read_stream(spark, sf, "events")
    s = e.select(F.col("event_id").alias("scan_id"), F.concat(F.lit("https://host.example/o"), (F.col("user_id") % 5).cast("string"), F.lit("/r"), F.col("user_id").cast("string")).alias("repo_url"),
                 F.when(F.col("event_type") == "error", "failed").otherwise("complete").alias("status"), F.least(F.lit(100), F.floor("value")).cast("int").alias("overall_score"), F.col("ts").alias("created_at"))
    return st.wall_clock(st.run_available(st.latest_status(s), "status", mode="complete"))


@query("st4_daily_trend", f"""WITH {dt.SCANS}, d AS (SELECT CAST(created_at AS DATE) AS day, org_id, count(*) AS scans, CAST(floor(avg(overall_score) + 0.5) AS BIGINT) AS avg_score, list_extract(list(overall_score ORDER BY overall_score), CAST(floor(count(*) / 2) AS INTEGER) + 1) AS median_score FROM scans WHERE status = 'complete' GROUP BY 1, 2)
SELECT * FROM d WHERE day + INTERVAL '1 day' <= (SELECT max(created_at) FROM scans WHERE status = 'complete') - INTERVAL '1 day'""")
def st4(spark, sf):
    e = st.read_stream(spark, sf, "events")
    s = e.select((F.col("user_id") % 5).alias("org_id"), F.when(F.col("event_type") == "error", "failed").otherwise("complete").alias("status"), F.least(F.lit(100), F.floor("value")).cast("int").alias("overall_score"), F.col("ts").alias("created_at"))
    return st.run_available(st.daily_trend(s), "trend")


@query("st5_watch_and_scan", f"WITH {dt.DOC_LINES} SELECT repo_id, path, line, rule, severity FROM ({o.line_hits(PROSE_RULES, 'doc_lines')})")
def st5(spark, sf):
    d = st.read_stream(spark, sf, "documents").select(F.col("source").alias("repo_id"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))
    q, _, found = st.watch_and_scan(d, shared_dir(spark, "watch"), lambda f: matching.match_lines(f, PROSE_RULES).select("repo_id", "path", "line", "rule", "severity"), "repo_id string, path string, line int, rule string, severity string", keep_repeats=True)  # a doc_id that stands in several rows is scanned in each
    q.awaitTermination()
    return found.read()


@query("st6_session_rollup", """WITH e AS (SELECT user_id % 20 AS user_id, ts, event_type IN ('click', 'view') AS u, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id % 20 ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM e),
g AS (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, count(*) AS turns, count(*) FILTER (WHERE u) AS user_turns, count(*) FILTER (WHERE NOT u) AS assistant_turns FROM s GROUP BY user_id, sid) SELECT * FROM g WHERE session_end <= (SELECT max(ts) FROM events) - INTERVAL '1 hour'""")
def st6(spark, sf):
    e = st.read_stream(spark, sf, "events").select("ts", (F.col("user_id") % 20).alias("user_id"), F.when(F.col("event_type").isin("click", "view"), "user").otherwise("assistant").alias("role"))
    return st.wall_clock(st.run_available(st.session_rollup(e), "sessions"))


