"""Operators against plain Python on random input, hot keys included."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from siltscope.operators import commits as cm
from siltscope.operators import dependencies as dp
from siltscope.operators import evaluate as ev
from siltscope.operators import graph as gr
from siltscope.operators import ordered, vibe
from siltscope.operators.complexity import nesting_depth
from siltscope.sources import files as sfiles
from siltscope.sources import scanners

BLANKS = " \t\r\n\f\x0b"


def depth_twin(text, mode):
    d = m = 0
    for line in text.split("\n"):
        t = line.strip(BLANKS)
        if mode == "braces":
            d = max(0, d + line.count("{") - line.count("}"))
        else:
            d += t.endswith(("{", "(", "=>"))
            if t.startswith(("}", ")", "]")):
                d = max(0, d - 1)
        m = max(m, d)
    return m


@pytest.mark.parametrize("mode", ["braces", "openers"])
def test_nesting(spark, mode):
    rnd = random.Random(1)
    pieces = ["{", "}", "a {", "} else {", "f(", ")", "x => ", "x =>", "]", "],", "", "  ", "text", "{ }", "}}", "{{", ") {", "  }  "]
    texts = ["\n".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 30))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["d"] for r in df.select("i", nesting_depth("t", mode).alias("d")).collect()}
    assert got == {i: depth_twin(t, mode) for i, t in enumerate(texts)}


def comments_twin(text):
    import re

    warn_rx = re.compile(r"\b(?:TODO|FIXME|HACK|TASK|FIX_NOW)\b", re.I | re.A)
    code_rx = re.compile(vibe.COMMENTED_CODE, re.A)
    con_rx = re.compile(r"\bconsole\.(?:log|warn|error|debug)\s*\(", re.A)
    code = warn = con = 0
    block = False

    def portion(raw):
        i = raw.find("/*")
        if i < 0:
            return raw.strip(BLANKS)
        j = raw.find("*/", i + 2)
        return (raw[i:] if j < 0 else raw[i : j + 2]).strip(BLANKS)

    for raw in text.split("\n"):
        line, note = raw.strip(BLANKS), None
        if not line:
            continue
        if block:
            note, block = portion(raw), "*/" not in raw
        elif line.startswith("//"):
            note = line
        elif line.startswith("/*"):
            note, block = portion(raw), "*/" not in raw
        else:
            plain = re.sub(r"/\*.*?\*/", " ", raw)
            con += len(con_rx.findall(plain.split("//")[0]))
            i = raw.find("/*")
            if i >= 0 and raw.find("*/", i + 2) < 0:
                note, block = raw[i:].strip(BLANKS), True
        if note is not None:
            warn += bool(warn_rx.search(note))
            code += bool(code_rx.search(note))
    return code, warn, con


def test_comment_state(spark):
    rnd = random.Random(2)
    pieces = ["/* open", "close */", "// const a = 1;", "// TODO x", "console.log(1)", "x(); /* tail", "/* one */ console.warn(2)", "", "* return;", "/** doc", " const z = 1; ", "a // console.log(3)", "*/"]
    texts = ["\n".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 25))) for _ in range(300)]
    df = spark.createDataFrame([("r", str(i), t) for i, t in enumerate(texts)], "repo_id string, path string, content string")
    got = {int(r["path"]): (r["commented_code"], r["warning_comments"], r["console_calls"]) for r in vibe.comment_counts(df).collect()}
    assert got == {i: comments_twin(t) for i, t in enumerate(texts)}


def test_greedy_match(spark):
    rnd = random.Random(3)
    pairs = [(t, i, j, round(rnd.random(), 2)) for t in range(40) for i in range(4) for j in range(5) if rnd.random() < 0.6]
    want = set()
    for t in range(40):
        used = set()
        for i in range(4):
            best = max(((s, -j, j) for tt, ii, j, s in pairs if tt == t and ii == i and j not in used), default=None)
            if best:
                used.add(best[2])
                want.add((t, i, best[2]))
    df = spark.createDataFrame(pairs, "task_id int, truth_no int, pred_no int, score double")
    for n in (1, 7):
        got = {(r[0], r[1], r[2]) for r in ev.greedy_match(df.repartition(n)).collect()}
        assert got == want


def near_twin(rows):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[3], r[4], r[2], r[0])):
        def near(k):
            if not set(k[0].split("-")) & set(r[0].split("-")):
                return False
            return abs(k[2] - r[2]) <= 2 if k[2] > 0 and r[2] > 0 else k[1] == r[1]
        if not any(near(k) for k in kept):
            kept.append(r)
    return {(r[0], r[1], r[2]) for r in kept}


def test_dedupe_near(spark):
    rnd = random.Random(4)
    data, want = [], set()
    for p in range(30):
        seen = {}
        for o in range(60 if p == 0 else 8):  # one hot file
            r = (rnd.choice(["a-b", "b-c", "c", "d-a"]), rnd.choice(["x", "y"]), rnd.randint(0, 12), round(rnd.random(), 3), o)
            seen[r[:3]] = max(seen.get(r[:3], r), r, key=lambda v: (v[3], -v[4]))
            data.append(("r", str(p), *r))
        want |= {(str(p), *k) for k in near_twin(list(seen.values()))}
    df = spark.createDataFrame(data, "repo_id string, path string, rule string, category string, line int, confidence double, ordinal int")
    got = {(r["path"], r["rule"], r["category"], r["line"]) for r in ev.dedupe_near(df).collect()}
    assert got == want


def test_copy_paste_is_exact(spark):
    rnd = random.Random(5)
    data, sets = [], {}
    for i in range(120):
        n = 30 if i % 20 == 0 else rnd.randint(2, 7)  # some files exceed the triple limit
        names = {f"f{rnd.randint(0, 40)}" for _ in range(n)} if i % 3 else {"main", "init", "run", "stop"}  # a third are copies
        path = f"p{i:03d}.ts"
        data.append(("r", path, "\n".join(f"function {x}() {{}}" for x in sorted(names)) + "\n" + "// pad" * 40))
        sets[path] = names
    want = {}
    for a in sets:
        c = [b for b in sets if b != a and len(sets[a]) >= 3 and len(sets[b]) >= 3 and len(sets[a] & sets[b]) >= 3]
        if c:
            want[a] = min(c)
    df = spark.createDataFrame(data, "repo_id string, path string, content string")
    assert {r["path"]: r["partner"] for r in gr.copy_paste(df, triple_limit=10).collect()} == want


def test_copy_paste_broadcasts_nothing_and_reads_files_once(spark):
    # the planner takes the size of slim keys for that of the signatures made of them
    keys = spark.range(60)
    df = keys.select(
        F.lit("r").alias("repo_id"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"),
        F.concat(*[F.concat(F.lit("function f"), (F.col("id") % m).cast("string"), F.lit("() {}\n")) for m in (2, 3, 5, 7)], F.repeat(F.lit("// pad"), F.lit(40))).alias("content"),
    )
    plan = gr.copy_paste(df)._jdf.queryExecution().sparkPlan().toString()
    assert "Broadcast" not in plan and "Range" not in plan and "SortMergeJoin" in plan


def test_co_change_is_exact(spark):
    rnd = random.Random(6)
    cf, cs = [], []
    for i in range(60):
        files = rnd.sample(range(40), 35 if i % 20 == 0 else rnd.randint(1, 5))
        cs.append(("r", f"s{i:02d}", "a", f"2024-01-01 00:{i:02d}:00", "m"))
        cf += [("r", f"s{i:02d}", f"f{x:02d}", "M") for x in files]
    by = defaultdict(set)
    for _, s, p, _ in cf:
        by[s].add(p)
    for k in (2, 3):
        want = Counter(pair for ps in by.values() for pair in combinations(sorted(ps), 2))
        want = {p: n for p, n in want.items() if n >= k}
        c = spark.createDataFrame(cs, "repo_id string, sha string, author_email string, authored_at string, message string")
        got = {(r["file_a"], r["file_b"]): r["shared_commits"] for r in cm.co_change(c, spark.createDataFrame(cf, "repo_id string, sha string, path string, change_kind string"), min_shared=k).collect()}
        assert got == want


def lev(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(cur[-1] + 1, prev[j] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def test_nearest_names(spark):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 7)))
    miss, known = sorted({word() for _ in range(60)}), sorted({word() for _ in range(40)})
    want = {}
    for m in miss:
        c = [(lev(m, k), k) for k in known if lev(m, k) <= 2]
        if c:
            want[m] = min(c)[1]
    df = lambda names: spark.createDataFrame([("r", n) for n in names], "repo_id string, name string")
    assert {r["name"]: r["nearest"] for r in dp.nearest_names(df(miss), df(known)).collect()} == want
    # a specifier of any length costs a fixed number of rows
    long = "data:" + "ab" * 5_000
    got = dp.nearest_names(df([long, "x"]), df([long[:-1] + "c", long[2:-1], "unrelated"])).collect()
    assert [(r["name"], r["nearest"], r["distance"]) for r in got] == [(long, long[:-1] + "c", 1)]


def naive_cuts(code, limit):
    """First lines of all chunks, by trying every line in turn."""
    lines = code.split("\n")
    if len(code) <= limit:
        return [0]
    ws = " \t\x0b\f\r"
    gaps = set()
    for i, line in enumerate(lines):
        after = [x for x in lines[i + 1 :] if x.strip(ws)]
        if i and not line.strip(ws) and after and after[0][0] not in ws:
            gaps.add(i)
    firsts = [0]
    while True:
        a = firsts[-1]
        over = [i for i in range(a + 1, len(lines)) if len("\n".join(lines[a : i + 1])) > limit]
        if not over:
            return firsts
        inside = [g for g in gaps if a < g < over[0]]
        firsts.append(max(inside) if inside else over[0])


def test_chunks_against_trying_every_line(spark):
    rnd = random.Random(8)
    parts = ["", "", " ", "\t\r", "x = 1", "    y", "def f():", "\ré", "中文😀"]
    texts = ["", "\n", "\n\n\n" + "z" * 90, "z" * 90 + "\n\n", " \n" * 200, "a" * 81, None]
    texts += ["\n".join(rnd.choice([*parts, "z" * rnd.randint(1, 100)]) for _ in range(rnd.randint(1, 80))) for _ in range(300)]
    texts.append("\n".join(f"line {i}" if i % 7 else "" for i in range(12000)))
    df = spark.createDataFrame([("r", str(i), t, i) for i, t in enumerate(texts)], "repo_id string, path string, content string, chunk int")
    got = defaultdict(list)
    for r in sfiles.chunk_files(df, 20).collect():
        got[int(r["path"])].append((r["chunk"], r["start_line"], r["end_line"], r["text"]))
    assert set(got) == {i for i, t in enumerate(texts) if t is not None}
    for i, chunks in got.items():
        lines = texts[i].split("\n")
        firsts = naive_cuts(texts[i], 80) if i < len(texts) - 1 else [s - 1 for _, s, _, _ in sorted(chunks)]
        want = []
        for n, (a, z) in enumerate(zip(firsts, [*firsts[1:], len(lines)])):
            want.append((n, a + 1, z, "\n".join(f"{j + 1:>4} | {lines[j]}" for j in range(a, z))))
        assert sorted(chunks) == want


def naive_object(raw):
    at = raw.find("{")
    depth, quoted, i = 0, False, at
    while 0 <= i < len(raw):
        if raw[i] == "\\":
            i += 1
        elif raw[i] == '"':
            quoted = not quoted
        elif not quoted and raw[i] in "{}":
            depth += 1 if raw[i] == "{" else -1
            if depth == 0:
                return raw[at : i + 1]
        i += 1
    return None


def test_first_object_against_a_character_loop(spark):
    rnd = random.Random(12)
    texts = ["", "{", "}{}", 'say {"a": "}"} then', '{"a\\"}"}', "{\\", "no", "x" * 300_000 + '{"k": [' + '{"v": "}"},' * 20_000 + "{}]} tail {"]
    texts += ["".join(rnd.choice(['{', '}', '"', "\\", "a", "é😀", "\n"]) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string")
    got = {r["i"]: r["o"] for r in df.select("i", scanners.first_object(F.col("t")).alias("o")).collect()}
    assert got.pop(-1) is None
    assert got == {i: naive_object(t) for i, t in enumerate(texts)}


def test_many_matches_and_long_try_blocks_of_one_file(spark):
    """200,000 matches or guarded lines in one file are placed in time linear in them."""
    from siltscope.operators import matching

    n = 200_000
    text = "\x01\n" + "try {\n" + "  go(x); go(y);\n" * n + "}\nlast go(z)"
    df = spark.createDataFrame([("r", "a.ts", text)], "repo_id string, path string, content string")
    hits = df.select(F.explode(matching.match_starts(F.col("content"), r"go\(\w\)")).alias("h")).select("h.line", "h.detail")
    s = hits.agg(F.count("*").alias("c"), F.sum("line").alias("s"), F.max("line").alias("m"), F.min("line").alias("l")).first()
    assert (s["c"], s["s"], s["m"], s["l"]) == (2 * n + 1, 2 * sum(range(3, n + 3)) + n + 4, n + 4, 3)
    g = matching.in_try_block(df).agg(F.count("*").alias("c"), F.min("line").alias("l"), F.max("line").alias("m")).first()
    assert (g["c"], g["l"], g["m"]) == (n + 1, 3, n + 3)


def test_ordered_helpers_on_a_hot_key(spark):
    rnd = random.Random(9)
    data = [("hot" if rnd.random() < 0.6 else f"k{rnd.randint(0, 5)}", i, rnd.randint(0, 9)) for i in range(400)]
    by = defaultdict(list)
    for k, i, v in data:
        by[k].append((i, v))
    want = {}
    for k, seq in by.items():
        total, prev = 0, None
        for n, (i, v) in enumerate(sorted(seq), 1):
            total += v
            want[i] = (total, prev, n)
            prev = v
    df = spark.createDataFrame(data, "k string, i int, v int")
    chunk = F.floor(F.col("i") / 25)
    a = ordered.prefix_sum(df.withColumn("c", chunk), ["k"], "c", "i", "v", "s")
    b = ordered.lag_in_key(df, ["k"], chunk, ["i"], F.col("v"), "p")
    c = ordered.row_number_in_key(df, ["k"], chunk, ["i"], "n")
    j = a.select("i", "s").join(b.select("i", "p"), "i").join(c.select("i", "n"), "i")
    assert {r["i"]: (r["s"], r["p"], r["n"]) for r in j.collect()} == want
    # without chunks: ranges of the order, whose borders Spark samples, however the rows crowd together
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranges = ordered.ranged(df, ["k"], ["i"])
        sizes = {r["_range"]: r["count"] for r in ranges.filter("k = 'hot'").groupBy("_range").count().collect()}
        assert len(sizes) > 1 and max(sizes.values()) < 0.75 * sum(sizes.values())
        a = ordered.prefix_sum(df, ["k"], None, "i", "v", "s")
        b = ordered.lag_in_key(df, ["k"], None, ["i"], F.col("v"), "p")
        c = ordered.row_number_in_key(df, ["k"], None, ["i"], "n")
        assert a.columns == [*df.columns, "s"] and b.columns == [*df.columns, "p"] and c.columns == [*df.columns, "n"]
        j = a.select("i", "s").join(b.select("i", "p"), "i").join(c.select("i", "n"), "i")
        assert {r["i"]: (r["s"], r["p"], r["n"]) for r in j.collect()} == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_results_do_not_depend_on_partitioning(spark):
    from siltscope.plans import driver_tables as dt

    f = dt.findings(spark, "/root/testdata/sf0.001")
    out = []
    for n in (1, 16):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        out.append(sorted(map(repr, ev.verify_findings(f.repartition(n)).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert out[0] == out[1]


def test_dead_exports_do_not_ship_words(spark):
    """Without broadcasts a word that all files hold leaves a task as one row of numbers; the results stay the same."""
    from siltscope.operators import graph as gr

    common = " ".join(f"word{i}" for i in range(400))
    data = [("r", f"src/f{i:03}.ts", f"export const a{i} = 1;\nexport const b{i} = 2;\nuse(b{i - 1});\n{common}") for i in range(200)]
    f = spark.createDataFrame(data, "repo_id string, path string, content string").repartition(4)
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def shuffled():
        stages = store.stageList(None, False, False, none, None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled()
        got = {r["symbol"] for r in gr.dead_exports(f, gr.imports(f)).collect()}
        assert shuffled() - before < 20_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {f"a{i}" for i in range(200)} | {"b199"}
