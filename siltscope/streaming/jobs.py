"""Structured Streaming versions of the event jobs.

Every function takes a streaming DataFrame and returns one; run_available() drives it over what is
there and returns the result as a batch DataFrame.  All aggregations combine on the map side, so one
busy client or repository leaves each task as one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltscope.operators.delta import hashed
from siltscope.session import shared_dir

PR_ACTIONS = ("opened", "synchronize", "reopened")


def pr_intake(events: DataFrame, configs: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Pending rows for pull-request events of repositories with an enabled configuration.

    events(ts, repo_url, pr_number, head_sha, action), configs(config_id, repo_url, enabled).  Repeated
    deliveries of one (configuration, pull request, commit, action) within the watermark are dropped.
    """
    live = configs.filter("enabled").select("config_id", "repo_url")
    e = events.filter(F.col("action").isin(*PR_ACTIONS))
    if e.isStreaming:
        e = e.withWatermark("ts", delay)
    j = e.join(live, "repo_url")
    keys = ["config_id", "pr_number", "head_sha", "action"]
    j = j.dropDuplicatesWithinWatermark(keys) if e.isStreaming else j.dropDuplicates(keys)
    return j.select("config_id", "pr_number", "head_sha", "action", F.lit("pending").alias("status"), "ts")


def rate_violations(requests: DataFrame, limit: int = 100, seconds: int = 60, slide: int | None = None, delay: str = "1 minute") -> DataFrame:
    """Clients with more than ``limit`` requests in a fixed (or sliding) window."""
    r = requests.withWatermark("ts", delay) if requests.isStreaming else requests
    w = F.window("ts", f"{seconds} seconds", f"{slide} seconds") if slide else F.window("ts", f"{seconds} seconds")
    n = r.groupBy(w.alias("w"), "client_id").agg(F.count("*").alias("requests"))
    return n.filter(F.col("requests") > limit).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "client_id", "requests")


def latest_status(scans: DataFrame) -> DataFrame:
    """Latest status and score per repository (update or complete mode)."""
    at = F.struct("created_at", "scan_id")
    return scans.groupBy("repo_url").agg(
        F.max_by(F.struct("scan_id", "status", "overall_score", "created_at"), at).alias("l"), F.count("*").alias("scans")
    ).select("repo_url", "l.*", "scans")


def daily_trend(scans: DataFrame, delay: str = "1 day") -> DataFrame:
    """Scans, rounded mean and upper median score per organisation and day, as the batch operator gives them.

    Scores are integers from 0 to 100, so a day's state is its histogram: one row a score, combined on the map side and merged
    in the state store. When the watermark closes a day, the median is read off the running counts of at most 101 rows.
    """
    s = scans.filter((F.col("status") == "complete") & F.col("overall_score").isNotNull())
    s = s.withWatermark("created_at", delay) if s.isStreaming else s
    bars = s.groupBy(F.window("created_at", "1 day").alias("w"), "org_id", F.col("overall_score").cast("long").alias("score")).agg(F.count("*").alias("n"))
    day = bars.groupBy("w", "org_id").agg(
        F.sum("n").alias("scans"), F.floor(F.sum(F.col("score") * F.col("n")) / F.sum("n") + 0.5).alias("avg_score"), F.array_sort(F.collect_list(F.struct("score", "n"))).alias("bars")
    )
    # the first score at which the running count passes half of all: position floor(n / 2) from 0
    start = F.struct(F.lit(0).cast("long").alias("below"), F.lit(None).cast("long").alias("score"))

    def step(acc: Column, bar: Column) -> Column:
        below = acc["below"] + bar["n"]
        return F.struct(below.alias("below"), F.coalesce(acc["score"], F.when(below > F.floor(F.col("scans") / 2), bar["score"])).alias("score"))

    median = F.aggregate("bars", start, step)["score"].cast("int").alias("median_score")
    return day.select(F.to_date("w.start").alias("day"), "org_id", "scans", "avg_score", median)


def session_rollup(turns: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Turns per user and session, a session ending after ``gap`` without a turn."""
    t = turns.withWatermark("ts", delay) if turns.isStreaming else turns
    g = t.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(
        F.count("*").alias("turns"),
        F.sum((F.col("role") == "user").cast("long")).alias("user_turns"),
        F.sum((F.col("role") == "assistant").cast("long")).alias("assistant_turns"),
    )
    return g.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "turns", "user_turns", "assistant_turns")


class BatchLog:
    """Rows appended by micro-batches, each in a partition of its own (``v``, the batch).

    Nothing that stands is rewritten. A batch that is replayed after a failure overwrites its own partition, so the outcome does
    not depend on where the failure happened. ``compact`` writes the rows that still count up to a batch once more, as a base;
    readers take the newest base and the batches after it.
    """

    def __init__(self, spark: SparkSession, path: str, ddl: str):
        self.spark, self.path, self.ddl = spark, path.rstrip("/"), ddl
        self.append(spark.createDataFrame([], ddl), -1)  # so that there is something to read
        spark.createDataFrame([], "base long").write.mode("append").parquet(f"{self.path}/bases")

    def append(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/rows/v={version}")

    def base(self) -> int | None:
        """The batch of the newest base; one number is read per compaction."""
        return self.spark.read.schema("base long").parquet(f"{self.path}/bases").agg(F.max("base")).first()[0]

    def rows(self) -> DataFrame:
        df = self.spark.read.schema(f"{self.ddl}, v long").parquet(f"{self.path}/rows")
        base = self.base()
        if base is None:
            return df
        return df.filter(F.col("v") > base).unionByName(self.spark.read.schema(f"{self.ddl}, v long").parquet(f"{self.path}/base-{base}"))

    def compact(self, live: DataFrame, version: int) -> None:
        """``live`` (with ``v``) stands for all batches up to ``version``; the base counts once its number is written."""
        live.write.mode("overwrite").parquet(f"{self.path}/base-{version}")
        self.spark.createDataFrame([(version,)], "base long").write.mode("append").parquet(f"{self.path}/bases")


class State:
    """The latest content hash of each file, and the batch that saw it, for readers; the stream itself keeps its own keyed state."""

    def __init__(self, log: BatchLog):
        self.log = log

    def read(self) -> DataFrame:
        last = F.max_by(F.struct("content_hash", "v"), "v").alias("l")
        return self.log.rows().groupBy("repo_id", "path").agg(last).select("repo_id", "path", "l.content_hash", "l.v")


class Current:
    """Findings of the batch that last scanned their file."""

    def __init__(self, log: BatchLog, state: State):
        self.log, self.state = log, state

    def versioned(self) -> DataFrame:
        # a repository or path that is null is a key like any other, as in the keyed state
        rows, last = self.log.rows().alias("f"), self.state.read().select("repo_id", "path", "v").alias("s")
        same = [F.col(f"f.{c}").eqNullSafe(F.col(f"s.{c}")) for c in ("repo_id", "path", "v")]
        return rows.join(last, same, "left_semi")

    def read(self) -> DataFrame:
        return self.versioned().drop("v")

    def compact(self, version: int) -> None:
        """Leave out what later batches have replaced, in both logs; findings first, so that they never miss their file."""
        self.log.compact(self.versioned(), version)
        self.state.log.compact(self.state.read(), version)


STATE = "repo_id string, path string, content_hash string"
CHANGED = "repo_id string, path string, content string, content_hash string"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: repeated rows of one content that leave in one piece
REPEATS = 64


def changed_files(stream: DataFrame, keep_repeats: bool = False) -> DataFrame:
    """Files whose content differs from what the stream saw of them last; of a path that a batch repeats, the content with the
    largest hash. With ``keep_repeats`` all rows that a batch has of a path are its content together: they come out again, each as often
    as it was there, if any of them or their number differs, and ``content_hash`` is one of all.

    The last hash of each (repository, path) is keyed state in the engine's store: a batch looks up and writes the keys it holds,
    whatever came before. Hashes are taken in the JVM; a batch's own contents are shuffled by file, and its history never.
    """

    def largest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best: tuple[str, str] | None = None
        for pdf in batches:
            for content_hash, content in zip(pdf["content_hash"], pdf["content"]):
                if best is None or (content_hash or "") > best[0]:
                    best = (content_hash or "", content)
        if best is None or (state.exists and state.get[0] == best[0]):
            return
        state.update((best[0],))
        yield pd.DataFrame({"repo_id": [key[0]], "path": [key[1]], "content": [best[1]], "content_hash": [best[0]]})

    def together(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen: dict[str, list] = {}  # equal contents are held once
        for pdf in batches:
            for content_hash, content in zip(pdf["content_hash"], pdf["content"]):
                seen.setdefault(content_hash or "", [content, 0])[1] += 1
        whole = "\n".join(f"{h} {n}" for h, (_, n) in sorted(seen.items()))
        digest = hashlib.sha256(whole.encode()).hexdigest()
        if not seen or (state.exists and state.get[0] == digest):
            return
        state.update((digest,))
        for content, n in seen.values():
            for first in range(0, n, REPEATS):
                k = min(REPEATS, n - first)
                yield pd.DataFrame({"repo_id": [key[0]] * k, "path": [key[1]] * k, "content": [content] * k, "content_hash": [digest] * k})

    step = together if keep_repeats else largest
    return hashed(stream.select("repo_id", "path", "content")).groupBy("repo_id", "path").applyInPandasWithState(step, CHANGED, "content_hash string", "append", GroupStateTimeout.NoTimeout)


def watch_and_scan(stream: DataFrame, state_path: str, scan_fn: Callable[[DataFrame], DataFrame], findings_ddl: str, checkpoint: str | None = None, compact_every: int | None = None, keep_repeats: bool = False):
    """Query that scans files as they land: only new or changed contents are scanned, findings of
    unchanged ones stay.  What has been seen is keyed state under the checkpoint; hashes and findings for readers are logs under
    ``state_path``, which executors and driver must share, compacted every ``compact_every`` batches.

    stream(repo_id, path, content): of a path that a batch repeats, the content with the largest hash counts, or with
    ``keep_repeats`` all of its rows.
    """
    spark = stream.sparkSession
    state = State(BatchLog(spark, state_path + "/state", STATE))
    found = Current(BatchLog(spark, state_path + "/findings", findings_ddl), state)
    columns = [f.name for f in spark.createDataFrame([], findings_ddl).schema]

    def step(batch: DataFrame, batch_id: int) -> None:
        changed = batch.persist()  # two writes, one pass over the state
        try:
            fresh = scan_fn(changed.select("repo_id", "path", "content"))
            found.log.append(fresh.select(*columns), batch_id)
            state.log.append(changed.select("repo_id", "path", "content_hash"), batch_id)
        finally:
            changed.unpersist()
        if compact_every and (batch_id + 1) % compact_every == 0:
            found.compact(batch_id)

    cp = checkpoint or shared_dir(spark, "watch-checkpoint")
    with rocksdb(spark):
        query = changed_files(stream, keep_repeats).writeStream.foreachBatch(step).option("checkpointLocation", cp).trigger(availableNow=True).start()
    return query, state, found


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, off the heap; a store that the session has chosen stays."""
    chosen = spark.conf.get(STATE_STORE, None)
    if chosen and not chosen.endswith("HDFSBackedStateStoreProvider"):
        yield
        return
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, chosen) if chosen else spark.conf.unset(STATE_STORE)


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a streaming DataFrame over everything available and read the result back from storage."""
    spark = stream.sparkSession
    out, cp = shared_dir(spark, name), shared_dir(spark, name + "-checkpoint")
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    q = stream.writeStream.foreachBatch(step).option("checkpointLocation", cp).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def read_stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A parquet table of the driver, one file or a folder of them, as a file stream."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    # a pattern that fits this name alone: without one the stream takes no path of a single file
    s = spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")
    # event time needs an instant; the tables store wall-clock timestamps
    local = {f.name for f in schema if f.dataType.typeName() == "timestamp_ntz"}
    return s.select(*[F.col(c).cast("timestamp").alias(c) if c in local else F.col(c) for c in s.columns])


def wall_clock(df: DataFrame) -> DataFrame:
    """Instants back to wall-clock timestamps."""
    return df.select(*[F.col(f.name).cast("timestamp_ntz").alias(f.name) if f.dataType.typeName() == "timestamp" else F.col(f.name) for f in df.schema])
