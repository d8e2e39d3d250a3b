"""Choices in rounds give what a walk gives: on random tasks, hot tasks and chains longer than the rounds."""

import random

from pyspark.sql import functions as F

from siltscope.operators import evaluate as ev
from siltscope.operators import rounds

from .test_twins import near_twin

PAIRS = "task_id int, truth_no int, pred_no int, score double"


def serial(pairs):
    out, used, done = set(), set(), set()
    for t, i, s, j in sorted((t, i, -s, j) for t, i, j, s in pairs):
        if (t, i) not in done and (t, j) not in used:
            done.add((t, i))
            used.add((t, j))
            out.add((t, i, j))
    return out


def wish():
    return F.struct((-F.col("score")).alias("s"), F.col("pred_no").alias("p"))


def test_assignments_of_any_number_of_rounds(spark):
    rng = random.Random(1)
    pairs = [(t, i, j, rng.choice([0.5, 0.7, 0.9])) for t in range(6) for i in range(12) for j in range(12) if rng.random() < 0.4]
    df, want = spark.createDataFrame(pairs, PAIRS), serial(pairs)
    for n in (0, 1, 2, 20):
        got = {tuple(r)[:3] for r in rounds.assign(df, ["task_id"], "truth_no", "pred_no", wish(), rounds=n, walk=0).collect()}
        assert got == want, n


def test_equal_wishes(spark):
    """Every truth wants the same predictions in the same order: a round settles one of them, the walk the rest."""
    pairs = [(1, i, j, 0.8) for i in range(30) for j in range(30)] + [(2, 0, 0, 0.5)]
    got = {tuple(r)[:3] for r in ev.greedy_match(spark.createDataFrame(pairs, PAIRS)).collect()}
    assert got == serial(pairs) and (1, 29, 29) in got


def test_a_hot_task_is_decided_in_rounds(spark, monkeypatch):
    walked = []
    walk = rounds.keep_in_order
    monkeypatch.setattr(rounds, "keep_in_order", lambda df, *a: walked.append(df.count()) or walk(df, *a))
    rng = random.Random(2)
    pairs = [(0, i, max(0, i + d), round(rng.random(), 3)) for i in range(1500) for d in (-2, -1, 0, 1, 2)]
    df = spark.createDataFrame(pairs, PAIRS).dropDuplicates(["task_id", "truth_no", "pred_no"])
    want = serial([tuple(r) for r in df.collect()])
    assert {tuple(r)[:3] for r in rounds.assign(df, ["task_id"], "truth_no", "pred_no", wish(), walk=200).collect()} == want
    assert walked[0] <= 200


def test_findings_meet_by_the_words_of_their_types(spark):
    types = ["sql-injection", "injection", "xss-bug", "dom-xss", "", None, "leak", "memory-leak-issue"]
    row = lambda i: (i % 3, i, types[i % 8], i % 5, f"text of {i % 4} words here", "c", "s", 1.0)
    ddl = "task_id int, {} int, type string, line int, description string, category string, severity string, confidence double"
    t, p = spark.createDataFrame([row(i) for i in range(60)], ddl.format("truth_no")), spark.createDataFrame([row(i * 7 + 1) for i in range(60)], ddl.format("pred_no"))
    score = ev.match_score()
    every = ev._sides(p, t, related=False).withColumn("score", score).filter("score >= 0.5").select("task_id", "truth_no", "pred_no", "score")
    met = ev._sides(p, t, related=True).withColumn("score", score).filter("score >= 0.5").select("task_id", "truth_no", "pred_no", "score")
    assert sorted(map(tuple, met.collect())) == sorted(map(tuple, every.collect())) and met.count() > 50


def test_near_findings_in_a_hot_file_and_in_long_chains(spark, monkeypatch):
    monkeypatch.setattr(ev, "first_apart", lambda *a: rounds.first_apart(*a, rounds=6, walk=0))
    rng = random.Random(3)
    ddl = "repo_id string, path string, rule string, category string, line int, confidence double, ordinal int"
    chain = [("r", "chain", "a-b", "x", i, 0.5, i) for i in range(1, 90)]
    hot = [("r", "hot", rng.choice(["a-b", "b-c", "d", "c-e"]), rng.choice("xyz"), rng.randrange(0, 900), round(rng.random(), 4), i) for i in range(900)]
    best = {}
    for r in chain + hot:
        k = r[:5]
        best[k] = max(best.get(k, r), r, key=lambda v: (v[5], -v[6]))
    want = set()
    for p in ("chain", "hot"):
        want |= {(p, *k) for k in near_twin([(r[2], r[3], r[4], r[5], r[6]) for r in best.values() if r[1] == p])}
    got = {(r["path"], r["rule"], r["category"], r["line"]) for r in ev.dedupe_near(spark.createDataFrame(chain + hot, ddl)).collect()}
    assert got == want


def test_no_rows(spark):
    assert ev.greedy_match(spark.createDataFrame([], PAIRS)).count() == 0
    ddl = "repo_id string, path string, rule string, category string, line int, confidence double, ordinal int"
    assert ev.dedupe_near(spark.createDataFrame([], ddl)).count() == 0


def test_small_files_are_walked_and_large_ones_decided_in_rounds(spark, monkeypatch):
    """Only a file beyond the limit takes rounds; nulls, repeats and files at the limit give what the walk gives."""
    seen = []
    apart = rounds.first_apart
    monkeypatch.setattr(ev, "first_apart", lambda items, *a: seen.append({r["path"] for r in items.select("path").distinct().collect()}) or apart(items, *a, rounds=3, walk=0))
    rng = random.Random(4)
    ddl = "repo_id string, path string, rule string, category string, line int, confidence double, ordinal int, detail string"
    size = {"hot": 300, "edge": 100, **{f"s{i}": 7 for i in range(40)}}
    data = [("r", p, rng.choice(["a-b", "b-c", "d", "c-e"]), rng.choice("xyz"), rng.randrange(0, n // 2), round(rng.random(), 2), i, f"d{i}") for p, n in size.items() for i in range(n)]
    df = spark.createDataFrame(data, ddl)
    want = set()
    for p in size:
        best = {}
        for r in data:
            if r[1] == p:
                best[r[2:5]] = max(best.get(r[2:5], r), r, key=lambda v: (v[5], -v[6]))
        want |= {(p, *k) for k in near_twin([(r[2], r[3], r[4], r[5], r[6]) for r in best.values()])}
    found = lambda rows: {(r["path"], r["rule"], r["category"], r["line"]) for r in rows}
    assert found(ev.dedupe_near(df, walk=100).collect()) == want and seen == [{"hot"}]
    assert found(ev.dedupe_near(df).collect()) == want and len(seen) == 1
    odd = spark.createDataFrame([("r", None, None, "x", 1, 0.5, 1, "d"), ("r", None, None, "x", 1, 0.9, 2, "e"), ("r", None, "a", "x", None, 0.5, 3, "f"), ("r", None, "a", "x", 4, 0.4, 4, "g")], ddl)
    assert sorted(r["detail"] for r in ev.dedupe_near(odd).collect()) == ["e", "f"]
