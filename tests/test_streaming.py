"""Streams give the batch result; late rows and replays are handled."""

import hashlib

import pytest
from pyspark.sql import functions as F

from siltscope.operators import matching
from siltscope.rules.model import Rule
from siltscope.streaming import jobs as st

EV = "ts timestamp, client_id string"


def _land(spark, path, rows, ddl):
    spark.createDataFrame(rows, ddl).selectExpr("*").coalesce(1).write.mode("append").parquet(path)


def test_rate_windows_and_late_rows(spark, tmp_path):
    path = str(tmp_path / "in")
    row = lambda t, c: (t, c)
    ddl = "t string, client_id string"
    _land(spark, path, [row(f"2024-01-01 00:00:{s:02d}", "a") for s in range(5)] + [row("2024-01-01 00:00:01", "b"), row("2024-01-01 00:10:00", "b")], ddl)
    stream = lambda: spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(path).select(F.col("t").cast("timestamp").alias("ts"), "client_id")
    out = st.run_available(st.rate_violations(stream(), limit=3, seconds=60), "t")
    assert [(r["client_id"], r["requests"]) for r in out.collect()] == [("a", 5)]
    # rows for the closed first minute arrive in a later file: the watermark drops them
    _land(spark, path, [row(f"2024-01-01 00:00:{s:02d}", "b") for s in range(10)], ddl)
    out = st.run_available(st.rate_violations(stream(), limit=3, seconds=60), "t")
    got = sorted((r["client_id"], r["requests"]) for r in out.collect())
    assert ("a", 5) in got and all(n <= 11 for _, n in got)


def test_status_stream_equals_batch(spark, sf):
    cols = ["event_id AS scan_id", "concat('r', cast(user_id as string)) AS repo_url", "event_type AS status", "cast(value as int) AS overall_score", "ts AS created_at"]
    s = st.read_stream(spark, sf, "events").selectExpr(*cols)
    b = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).selectExpr(*cols)
    got = st.run_available(st.latest_status(s), "s", mode="complete")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, st.latest_status(b).collect()))


def test_watch_scans_only_what_changed(spark, tmp_path):
    src, state = str(tmp_path / "in"), str(tmp_path / "state")
    ddl = "repo_id string, path string, content string"
    seen = []
    rules = [Rule("x", "high", "bad")]

    def scan(files):
        seen.append(sorted(r["path"] for r in files.select("path").collect()))
        return matching.match_lines(files, rules).select("repo_id", "path", "line")

    def run():
        q, _, found = st.watch_and_scan(spark.readStream.schema(ddl).parquet(src), state, scan, "repo_id string, path string, line int", checkpoint=str(tmp_path / "cp"))
        q.awaitTermination()
        assert q.exception() is None
        return sorted((r["path"], r["line"]) for r in found.read().collect())

    _land(spark, src, [("r", "a", "bad"), ("r", "b", "ok\nbad")], ddl)
    assert run() == [("a", 1), ("b", 2)]
    _land(spark, src, [("r", "a", "bad"), ("r", "b", "fixed"), ("r", "c", "bad")], ddl)
    assert run() == [("a", 1), ("c", 1)]
    assert seen == [["a", "b"], ["b", "c"]]


def test_pr_intake_batch(spark):
    ev = spark.createDataFrame([("2024-01-01", "u1", 1, "s", "opened"), ("2024-01-02", "u1", 1, "s", "opened"), ("2024-01-01", "u2", 1, "s", "opened"), ("2024-01-01", "u1", 2, "s", "closed")], "t string, repo_url string, pr_number int, head_sha string, action string")
    cfg = spark.createDataFrame([("c1", "u1", True), ("c2", "u2", False)], "config_id string, repo_url string, enabled boolean")
    out = st.pr_intake(ev.withColumn("ts", F.col("t").cast("timestamp")), cfg).collect()
    assert [(r["config_id"], r["pr_number"], r["status"]) for r in out] == [("c1", 1, "pending")]


def test_repeated_paths_in_a_batch_count_once(spark, tmp_path):
    src, state = str(tmp_path / "in"), str(tmp_path / "state")
    ddl = "repo_id string, path string, content string"
    rules = [Rule("x", "high", "bad")]
    twice = [("r", "a", "bad"), ("r", "a", "fine"), ("r", "a", "also\nbad")]
    want = max(twice, key=lambda r: hashlib.sha256(r[2].encode()).hexdigest())[2]
    _land(spark, src, twice, ddl)
    q, s, found = st.watch_and_scan(
        spark.readStream.schema(ddl).parquet(src), state, lambda f: matching.match_lines(f, rules).select("repo_id", "path", "line"), "repo_id string, path string, line int", checkpoint=str(tmp_path / "cp"))
    q.awaitTermination()
    assert q.exception() is None
    assert [r["line"] for r in found.read().collect()] == [i for i, x in enumerate(want.split("\n"), 1) if x == "bad"]
    # a replay of the batch leaves the same rows
    before = sorted(map(tuple, s.read().collect()))
    again = [tuple(r)[:3] for r in s.log.rows().filter("v = 0").collect()]
    s.log.append(spark.createDataFrame(again, "repo_id string, path string, content_hash string"), 0)
    assert sorted(map(tuple, s.read().collect())) == before


LINES = "repo_id string, path string, line int"


def _watch(spark, tmp_path, scan, **more):
    src = str(tmp_path / "in")
    stream = spark.readStream.schema("repo_id string, path string, content string").option("maxFilesPerTrigger", 1).parquet(src)
    return st.watch_and_scan(stream, str(tmp_path / "state"), scan, LINES, checkpoint=str(tmp_path / "cp"), **more)


def _bad_lines(files):
    return matching.match_lines(files, [Rule("x", "high", "bad")]).select("repo_id", "path", "line")


def test_a_batch_reads_no_history(spark, tmp_path, monkeypatch):
    """What was seen is looked up by key in the state store; the logs are for readers only."""
    src, ddl = str(tmp_path / "in"), "repo_id string, path string, content string"
    for i in range(4):
        _land(spark, src, [("r", f"f{j}", f"bad {j}" if i < 3 or j % 2 else f"bad\nbad {i}") for j in range(20)], ddl)
    with monkeypatch.context() as m:
        m.setattr(st.BatchLog, "rows", lambda self: (_ for _ in ()).throw(AssertionError("a batch read the log")))
        q, state, found = _watch(spark, tmp_path, _bad_lines)
        q.awaitTermination()
        assert q.exception() is None
    sizes = sorted(r["count"] for r in state.log.rows().groupBy("v").count().collect())
    assert sizes == [10, 20]
    assert found.read().count() == 30
    assert any("RocksDB" in k for p in q.recentProgress for s in p["stateOperators"] for k in map(str, s["customMetrics"])) or q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 20


def test_a_failed_batch_is_replayed_once(spark, tmp_path):
    src, ddl = str(tmp_path / "in"), "repo_id string, path string, content string"
    _land(spark, src, [("r", "a", "bad"), ("r", "b", "bad")], ddl)
    q, _, found = _watch(spark, tmp_path, _bad_lines)
    q.awaitTermination()
    _land(spark, src, [("r", "a", "fine\nbad"), ("r", "b", "bad")], ddl)

    def broken(files):
        raise RuntimeError("executor lost")

    q, _, found = _watch(spark, tmp_path, broken)
    try:
        q.awaitTermination()
    except Exception as e:
        assert "executor lost" in str(e)
    assert sorted(map(tuple, found.read().collect())) == [("r", "a", 1), ("r", "b", 1)]
    q, state, found = _watch(spark, tmp_path, _bad_lines)
    q.awaitTermination()
    assert sorted(map(tuple, found.read().collect())) == [("r", "a", 2), ("r", "b", 1)]
    assert state.log.rows().filter("v = 1").count() == 1


def test_content_that_returns_is_scanned_again(spark, tmp_path):
    src, ddl = str(tmp_path / "in"), "repo_id string, path string, content string"
    for text in ("bad", "fine", "bad", None, "x\nbad"):
        _land(spark, src, [("r", "a", text), (None, "n", "bad")], ddl)
        q, state, found = _watch(spark, tmp_path, _bad_lines)
        q.awaitTermination()
        want = [] if text in ("fine", None) else [("r", "a", text.split("\n").index("bad") + 1)]
        assert sorted(map(tuple, found.read().filter("repo_id is not null").collect())) == want
    assert state.log.rows().count() == 6


def test_compacted_logs_read_the_same(spark, tmp_path):
    src, ddl = str(tmp_path / "in"), "repo_id string, path string, content string"
    for i in range(5):
        _land(spark, src, [("r", f"f{j}", "bad\n" * (i * (j % 3) + 1)) for j in range(9)], ddl)
    q, state, found = _watch(spark, tmp_path, _bad_lines, compact_every=2)
    q.awaitTermination()
    assert q.exception() is None and state.log.base() == 3
    want = sorted(("r", f"f{j}", n + 1) for j in range(9) for n in range(4 * (j % 3) + 1))
    assert sorted(map(tuple, found.read().collect())) == want
    assert state.read().count() == 9 and state.log.rows().count() < 9 + 4 * 6


def test_daily_trend_equals_the_batch_operator(spark, sf):
    from siltscope.operators import history as hi

    cols = ["event_id AS scan_id", "user_id % 5 AS org_id", "'A' AS grade", "concat('r', user_id) AS repo_url", "'complete' AS status", "cast(least(100, floor(value)) as int) AS overall_score", "ts AS created_at"]
    got = st.run_available(st.daily_trend(st.read_stream(spark, sf, "events").selectExpr(*cols)), "trend")
    batch = hi.health_trend(spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).selectExpr(*cols))
    want = {(r["org_id"], r["day"]): (r["avg_score"], r["median_score"], r["scans"]) for r in batch.collect()}
    rows = got.collect()
    assert len(rows) > 10
    assert all(want[r["org_id"], r["day"]] == (r["avg_score"], r["median_score"], r["scans"]) for r in rows)


def test_rows_of_one_path_are_all_scanned_when_repeats_are_kept(spark, tmp_path):
    src, ddl = str(tmp_path / "in"), "repo_id string, path string, content string"
    _land(spark, src, [("r", "a", "bad"), ("r", "a", "bad"), ("r", "a", "fine\nbad"), (None, "b", "bad"), ("r", None, "bad"), ("r", None, None)], ddl)
    q, _, found = _watch(spark, tmp_path, _bad_lines, keep_repeats=True)
    q.awaitTermination()
    assert q.exception() is None
    want = [(None, "b", 1), ("r", None, 1), ("r", "a", 1), ("r", "a", 1), ("r", "a", 2)]
    assert sorted((tuple(r) for r in found.read().select("repo_id", "path", "line").collect()), key=repr) == sorted(want, key=repr)
    # the same rows again are no change; one more copy is
    _land(spark, src, [("r", "a", "fine\nbad"), ("r", "a", "bad"), ("r", "a", "bad"), (None, "b", "bad"), (None, "b", "bad")], ddl)
    q, _, found = _watch(spark, tmp_path, _bad_lines, keep_repeats=True)
    q.awaitTermination()
    want.append((None, "b", 1))
    assert sorted((tuple(r) for r in found.read().select("repo_id", "path", "line").collect()), key=repr) == sorted(want, key=repr)


def test_watch_query_scans_every_row_of_a_repeated_document(spark, tmp_path):
    import __spark_entry__ as entry

    d = spark.createDataFrame([(1, "contact a@b.org", "en", "s"), (1, "contact a@b.org", "en", "s"), (1, "#####", "en", "s"), (2, "license", "en", None), (3, "license", None, "s")], "doc_id long, text string, lang string, source string")
    d.coalesce(1).toPandas().to_parquet(tmp_path / "documents.parquet")
    got = sorted((tuple(r) for r in entry.queries()["st5_watch_and_scan"](spark, str(tmp_path)).select("repo_id", "path", "rule").collect()), key=repr)
    want = [("s", "en/1", "contact-mail"), ("s", "en/1", "contact-mail"), ("s", "en/1", "junk-run"), (None, "en/2", "license-line"), ("s", None, "license-line")]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("folder", [False, True])
def test_watch_query_reads_a_table_of_one_file_or_a_folder(spark, tmp_path, folder):
    import __spark_entry__ as entry

    d = spark.createDataFrame([(i, "license", "en", "s") for i in range(6)], "doc_id long, text string, lang string, source string")
    path = str(tmp_path / "documents.parquet")
    d.repartition(3).write.parquet(path) if folder else d.toPandas().to_parquet(path)
    got = sorted(r.path for r in entry.queries()["st5_watch_and_scan"](spark, str(tmp_path)).collect())
    assert got == [f"en/{i}" for i in range(6)]
