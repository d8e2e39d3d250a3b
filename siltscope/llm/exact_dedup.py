"""Exact deduplication with a cuckoo-filter index of live digests.

Every text is digested in the scan; only digests travel. Digest ranges (buckets) are independent: each holds a cuckoo
filter of its live 64-bit digests and the content records (SHA-256, byte length) behind them. An arrival that misses
the filter is new without a look at any record; a hit is verified against the bucket's records, so that a false
positive becomes a new live digest. Arrivals are summed up in the task that reads them first, so a text that makes
up a third of all rows sends one arrival per task.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltscope.llm.common import saved, texts
from siltscope.llm.cuckoo import CuckooFilter

#: contents a bucket should hold
BUCKET_ROWS = 20_000
LIVE = "bucket long, digest long, text_sha256 string, n_bytes long, keep_id long, group_size long"


def arrivals(keyed: DataFrame, n_buckets: int) -> DataFrame:
    """One row for each content and reading task: its largest doc_id and its rows."""
    return keyed.groupBy(
        F.pmod("digest", F.lit(n_buckets)).alias("bucket"), "digest", "text_sha256", "n_bytes", "part"
    ).agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("rows"))


class Bucket:
    """Live digests of one digest range with their content records."""

    def __init__(self, room: int) -> None:
        self.filter = CuckooFilter(room)
        self.content: dict[int, list[list]] = {}  # digest -> [sha256, bytes, keep_id, rows]
        self.false_hits = 0

    def _record(self, digest: int, sha: str, size: int) -> list | None:
        return next((r for r in self.content.get(digest, ()) if r[0] == sha and r[1] == size), None)

    def add(self, digest: int, sha: str, size: int, doc_id: int | None, rows: int) -> None:
        if digest in self.filter:
            r = self._record(digest, sha, size)
            if r is not None:
                r[2] = doc_id if r[2] is None else r[2] if doc_id is None else max(r[2], doc_id)
                r[3] += rows
                return
            self.false_hits += 1
        self.filter.insert(digest)
        self.content.setdefault(digest, []).append([sha, size, doc_id, rows])

    def remove(self, digest: int, sha: str, size: int) -> bool:
        """Forget a content, as when its documents are withdrawn; false if it is not live."""
        r = self._record(digest, sha, size) if digest in self.filter else None
        if r is None:
            return False
        self.content[digest].remove(r)
        self.filter.delete(digest)
        return True


def live(arrived: DataFrame, withdrawn: DataFrame | None = None) -> DataFrame:
    """The live contents after all arrivals, less the withdrawn ones (columns digest, text_sha256, n_bytes)."""
    cols = ["bucket", "digest", "text_sha256", "n_bytes", "doc_id", "rows"]
    moves = arrived.select(*cols)
    if withdrawn is not None:
        # a withdrawal is an arrival of no rows; it is worked off last
        gone = withdrawn.select("bucket", "digest", "text_sha256", "n_bytes", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("rows"))
        moves = moves.unionByName(gone)

    def index(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in cols[1:])))
        b = Bucket(min(len(rows), 1024))
        for r in rows:
            if r[4]:
                b.add(*r)
        for r in rows:
            if not r[4]:
                b.remove(*r[:3])
        bucket = table.column("bucket")[0].as_py() if len(rows) else 0
        out = [(bucket, d, *r) for d, records in b.content.items() for r in records]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        names = ["bucket", "digest", "text_sha256", "n_bytes", "keep_id", "group_size"]
        return pa.table([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=names)

    return moves.groupBy("bucket").applyInArrow(index, LIVE)


def exact_dedup(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Equal texts are byte-identical; of these the row with the largest doc_id stays. A null text is the empty text and
    duplicates it. Rows without a doc_id stay only if their whole group has none. Rows that repeat doc_id and text
    are one document and are marked alike. An empty table gives an empty result; other columns are ignored.
    """
    t = texts(docs)
    keyed = saved(
        t.select(
            "doc_id", F.sha2("text", 256).alias("text_sha256"), F.octet_length("text").cast("long").alias("n_bytes"),
            F.xxhash64("text").alias("digest"), F.spark_partition_id().alias("part"),
        ),
        "digests",
    )
    n_buckets = max(16, keyed.count() // bucket_rows)
    groups = live(arrivals(keyed, n_buckets)).filter("group_size > 1").select(F.col("text_sha256").alias("sha"), F.col("n_bytes").alias("size"), "keep_id", "group_size")
    # most documents are alone: only true groups are joined back, and a hot group's rows are split by the skew join
    k = keyed.join(groups, (keyed.text_sha256 == groups.sha) & (keyed.n_bytes == groups.size), "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return k.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256",
    )
