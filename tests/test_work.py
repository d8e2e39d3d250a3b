"""Work is spread over tasks, and no text is broadcast or read over and over."""

import dataclasses
import random

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from siltscope.operators import commits as cm
from siltscope.operators import graph as gr
from siltscope.operators import matching, vibe
from siltscope.plans import driver_tables as dt
from siltscope.rules import tables as rt
from siltscope.rules.model import Rule
from siltscope.sources import sinks

from .conftest import SF


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_derived_files_of_one_row_group_are_dealt_to_all_tasks(spark, tmp_path):
    n = 60_000
    pq.write_table(pa.table({"o_orderkey": list(range(n)), "o_custkey": [i * 7919 % n for i in range(n)]}), tmp_path / "orders.parquet", row_group_size=n)
    chosen = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")  # several splits, and all rows in one
    try:
        assert spark.read.parquet(str(tmp_path / "orders.parquet")).rdd.getNumPartitions() > 1
        per_task = dt.code_files(spark, str(tmp_path)).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", chosen)
    assert len(per_task) >= spark.sparkContext.defaultParallelism and max(r["n"] for r in per_task) < n / 2


def test_briefs_of_one_row_group_are_dealt_to_all_tasks_and_paths_make_no_text(spark, sf):
    from siltscope.plans import catalog_misc

    per_task = catalog_misc._briefs(spark, sf).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
    assert len(per_task) >= spark.sparkContext.defaultParallelism
    paths = dt.code_paths(spark, sf)
    assert "Generate" not in _plan(paths) and "o_custkey" not in paths._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, paths.collect())) == sorted(map(tuple, dt.code_files(spark, sf).select("repo_id", "path").collect()))


def test_patches_neither_join_nor_broadcast_contents(spark, sf):
    rules = [Rule("debug-code", "low", r"console\.log", needles=("console.log",)), Rule("hardcoded-secret", "high", "AKIA", needles=("AKIA",))]
    f = dt.code_files(spark, sf)
    own = sinks.propose_patches(matching.match_lines(f, rules, with_text=True))
    joined = sinks.propose_patches(matching.match_lines(f, rules), f)
    assert "Join" not in _plan(own)
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    cols = ["repo_id", "path", "line", "rule", "old_text", "new_text"]
    got = sorted(map(tuple, own.select(*cols).collect()))
    assert got and got == sorted(map(tuple, joined.select(*cols).collect()))
    import __spark_entry__ as entry

    assert "Join" not in _plan(entry.queries()["p38_propose_patches"](spark, sf))


def test_few_symbols_are_searched_before_words_are_taken(spark, files, monkeypatch):
    f = files(("a.ts", "function go() {}\nago go\ngoing"), ("b.test.ts", "go(go)\nnothing"), ("c.ts", "none"))
    sy = spark.createDataFrame([("go",), ("Nope",), (None,)], "symbol string")
    few = gr.blast_radius(f, sy)
    assert "Contains(content" in _plan(few)
    got = sorted(map(tuple, few.collect()))
    assert got == [("go", "r", "a.ts", 2, 1, False), ("go", "r", "b.test.ts", 1, 2, True)]
    monkeypatch.setattr(gr, "FEW_SYMBOLS", 0)
    assert sorted(map(tuple, gr.blast_radius(f, sy).collect())) == got


def test_comment_walk_trims_a_line_once(spark, files):
    c = vibe.comment_counts(files(("a.ts", "x = 1;\r\n/* const a = 1;\nTODO\r\n*/ console.log(1)\n// return a;\nconsole.log(2); /* open\nfoo();\n*/"), ("b.ts", "plain\n*/"), ("c.ts", None)))
    assert sorted(map(tuple, c.collect()), key=repr) == [("r", "a.ts", 2, 1, 1), ("r", "b.ts", 0, 0, 0), ("r", "c.ts", None, None, None)]
    assert _plan(c).count("\r$") <= 1


def test_start_of_a_rule_leaves_no_match_out(spark, files):
    text = "\n".join((
        "const token = Math.random();", "Math.random() // key", "no word Math.random()", "key random.random() Math.random ( ) token", "a key Math.random(", ") key; Math.random() secret",
        "token\r\nx = Math.random()\rkey = Math.random()", "xMath.random() key Math.random()Math.random() nonce RANDOM.RANDOM()", "session Math.random() session"))
    from siltscope.rules import tables as rt

    rule = next(r for r in rt.REVIEW_RULES if r.name == "insecure-random")
    assert rule.start
    f = files(("a.ts", text), ("b.ts", "Math.random() key"))
    both = [f.select("path", F.explode(matching.match_starts(F.col("content"), p)).alias("m")).select("path", "m.*") for p in (rule.pattern, rule.start + rule.pattern)]
    a, b = (sorted(map(tuple, d.collect())) for d in both)
    assert len(a) > 5 and a == b


def test_members_of_change_classes_form_no_pairs(spark, monkeypatch):
    touched = spark.createDataFrame([("r", "s1", "a"), ("r", "s1", "b"), ("r", "s2", "a"), ("r", "s2", "b"), ("r", "s2", "c")], "repo_id string, sha string, path string")
    log = touched.select("repo_id", "sha").distinct().withColumn("authored_at", F.lit("2024-01-01").cast("timestamp"))
    want = sorted(map(tuple, cm.co_change_classes(log, touched)[1].collect()))
    monkeypatch.setattr(cm, "stored", lambda *a: (_ for _ in ()).throw(AssertionError("pairs were stored")))
    assert sorted(map(tuple, cm.co_change_members(log, touched).collect())) == want == [("r", "a", "a"), ("r", "a", "b"), ("r", "c", "c")]


def test_reasons_of_changes_are_searched_once(spark, sf):
    from siltscope.plans import catalog

    for name in ("a27_impact_breakdown", "t4_fix_recommendations", "t4_fix_shortlists"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        # the files' names are read once more for changes without a reason
        assert plan.count("/orders.parquet") == 1 and "innerHTML" not in plan.replace("el.innerHTML = html", ""), name


def test_only_texts_that_can_hold_a_long_function_are_walked(spark):
    from siltscope.operators import sessions, structure

    body = lambda n: "function f(a) {\n" + "  x();\n" * n + "}"
    texts = [body(n) for n in (0, 10, 48, 49, 50, 51, 52, 80)] + [body(60) + "\n" + body(70), "import a from 'a';\n" * 3 + body(2), body(51) + "}", body(48) + "}\n" + body(50) + "}", body(47) + "\n}", None]
    df = spark.createDataFrame([("r", f"{i:02d}", t) for i, t in enumerate(texts)], "repo_id string, path string, content string")
    got = [r[0] for r in df.orderBy("path").select(sessions.long_functions(F.col("content"))).collect()]

    def walked(text):
        depth, start, n = 0, -1, 0
        for i, x in enumerate(text.split("\n")):
            if depth == 0 and "function f" in x:
                depth, start = 1, i
            depth += x.count("{") - x.count("}")
            if depth == 0 and start >= 0 and i - start > 50:
                n, start = n + 1, -1
        return n

    assert got == [None if t is None else walked(t) for t in texts] and sum(g or 0 for g in got) == 2
    found = structure.structure_findings(df)
    rows = sorted((r["path"], r["rule"], r["detail"]) for r in found.collect())
    long_ = [(f"{i:02d}", "large-function", f"f:{n}") for i, n in ((4, 51), (5, 52), (6, 53), (7, 81), (8, 61), (8, 71), (10, 52), (11, 51))]
    assert rows == sorted(long_ + [("09", "duplicate-import", "import a from 'a'")] * 2)
    # lines are counted before functions are looked for
    plan = _plan(found.filter("rule = 'large-function'"))
    assert "replace(content" in plan.split("Generate explode(regexp_extract_all")[1]
    assert "CASE WHEN" in _plan(df.select(sessions.long_functions(F.col("content"))))


def test_review_rules_are_searched_once_and_group_numbers(spark, monkeypatch):
    """The registered review queries neither extract the texts of matches nor sort findings for the best of a line; places are the same either way."""
    import __spark_entry__ as entry

    for name in ("p2_review_scan", "p3_review_scan_lines", "p2_block_rule_matches"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_extract_all(content" not in plan and "max_by" not in plan


def test_searched_patterns_find_the_same_places(spark):
    rng = random.Random(5)
    words = ["sk-" + "a1" * 10, "sk_live_" + "Z" * 24, "AIza" + "-" * 35, "AKIA" + "X" * 16, "sk-short", "readFile(", "createReadStream (path.join(", "req.", "+", " ", "x", "\n", "\r", "\r\n", "\x01", "é", "token", "Math.random()", "RANDOM.random( )",
             "export function f", "export async function g", "\n}", "{", "y" * 1490, "\n" * 40]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(0, 14))) for _ in range(400)] + ["+req." * 60 + "\n+req.", "\nAKIA" + "X" * 16 + "\n" + ("AKIA" + "X" * 16 + "\n") * 50, "export function f" + "y" * 1499 + "\n}", "\nexport function f" + "y" * 1500 + "\n}"]
    f = spark.createDataFrame([("r", str(i), t) for i, t in enumerate(texts)], "repo_id string, path string, content string").repartition(4)
    rules = [r for r in rt.REVIEW_RULES if r.search or r.start or r.at_least]
    plain = [dataclasses.replace(r, search="", start="", at_least=0, needles=(), folded=(), also=()) for r in rules]
    got = sorted(map(tuple, matching.match_places(f, rules).select("path", "ordinal", "line").collect()))
    want = sorted(map(tuple, matching.match_files(f, plain).select("path", "ordinal", "line").collect()))
    assert got == want and {o for _, o, _ in got} == set(range(len(rules)))
