"""Directory trees of source files, walked and read by tasks.

Spark's file readers list every file on the driver and read them in the order of the listing. Here the driver lists the repositories'
folders alone; tasks walk below them and never enter a skipped folder. The walk is a table of paths and sizes, cut into
parts of equal bytes, and each part is read by one task. Paths are URIs that pyarrow's file systems open (local, HDFS, object stores);
for a store that only Spark reads there is ``files.read_files``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltscope.operators.ordered import prefix_sum
from siltscope.session import ship, stored
from siltscope.sources.files import SKIP_DIRS, SOURCE_EXT

#: bytes of files a task reads
PART_BYTES = 64 << 20
#: bytes of contents an Arrow batch holds; a larger file is a batch of its own
BATCH_BYTES = 8 << 20


def _opened(root: str) -> tuple[pafs.FileSystem, str]:
    fs, base = pafs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")
    return fs, base.rstrip("/")


def _listed(fs: pafs.FileSystem, folder: str) -> list[pafs.FileInfo]:
    return fs.get_file_info(pafs.FileSelector(folder, recursive=False))


def tree_manifest(spark: SparkSession, root: str, exts: Sequence[str] = SOURCE_EXT, skip_dirs: Sequence[str] = SKIP_DIRS, max_bytes: int | None = None) -> DataFrame:
    """(repo_id, path, bytes) of the files below ``root/<repo_id>/`` with a listed extension, outside skipped folders."""
    ship(spark)
    fs, base = _opened(root)
    repos = [(i.base_name,) for i in _listed(fs, base) if i.type == pafs.FileType.Directory]
    skipped, wanted = set(skip_dirs), tuple(exts)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _opened(root)
        for b in batches:
            for repo in b.column("repo_id").to_pylist():
                folders = [f"{base}/{repo}"]
                while folders:
                    found = []
                    for i in _listed(fs, folders.pop()):
                        if i.type == pafs.FileType.Directory:
                            if i.base_name not in skipped:
                                folders.append(i.path)
                        elif i.path.endswith(wanted) and "." in i.base_name[1:] and (max_bytes is None or i.size <= max_bytes):
                            found.append((repo, i.path[len(base) + len(repo) + 2 :], i.size))
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=["repo_id", "path", "bytes"])

    at = spark.createDataFrame(repos, "repo_id string").repartition(max(1, min(len(repos), 4 * spark.sparkContext.defaultParallelism)))
    return at.mapInArrow(walk, "repo_id string, path string, bytes long")


def read_tree(
    spark: SparkSession, root: str, exts: Sequence[str] = SOURCE_EXT, skip_dirs: Sequence[str] = SKIP_DIRS, max_bytes: int | None = None, part_bytes: int = PART_BYTES
) -> DataFrame:
    """files(repo_id, path, content) of ``tree_manifest``; bytes that are no UTF-8 are replaced."""
    listed = tree_manifest(spark, root, exts, skip_dirs, max_bytes).withColumn("_all", F.lit(0))
    placed = prefix_sum(listed, ["_all"], None, ["repo_id", "path"], "bytes", "_upto").withColumn("_part", F.floor(F.col("_upto") / part_bytes).cast("long"))
    placed = stored(placed.select("repo_id", "path", "bytes", "_part"), "tree")
    parts = (placed.agg(F.max("_part")).first()[0] or 0) + 1

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _opened(root)

        def batch(rows: list[tuple[str, str, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["repo_id", "path", "content"])

        for b in batches:
            rows, held = [], 0
            for repo, path, size in zip(*(b.column(c).to_pylist() for c in ("repo_id", "path", "bytes"))):
                if rows and held + size > BATCH_BYTES:
                    yield batch(rows)
                    rows, held = [], 0
                with fs.open_input_stream(f"{base}/{repo}/{path}") as f:
                    rows.append((repo, path, f.read().decode("utf-8", "replace")))
                held += size
            if rows:
                yield batch(rows)

    # a part is a range of its own: as many partitions as parts, each with about part_bytes of files
    return placed.repartitionByRange(parts, "_part").drop("_part").mapInArrow(read, "repo_id string, path string, content string")


def write_tree(files: DataFrame, root: str) -> int:
    """Write each row's content to ``root/<repo_id>/<path>`` and return how many files were written; a repeated task writes the same
    bytes again."""
    ship(files.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _opened(root)
        made = set()
        for b in batches:
            for repo, path, content in zip(*(b.column(c).to_pylist() for c in ("repo_id", "path", "content"))):
                full = f"{base}/{repo}/{path}"
                folder = full.rpartition("/")[0]
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                with fs.open_output_stream(full) as f:
                    f.write((content or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    return files.select("repo_id", "path", "content").mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
