"""What the operators share: reading documents, tables in the shared folder, slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltscope.session import shared_dir, ship

#: text a Python task holds decoded at a time; a longer document is a slice of its own
SLICE_BYTES = 1 << 20


#: rows of an Arrow batch, where the session has Spark's defaults: batches of whole texts wait outside the heap
ROWS, ROWS_DEFAULT, ROWS_SMALL = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "500"


def ready(spark: SparkSession) -> None:
    """Ship the package and keep Arrow batches of texts small; settings that the user has made stay."""
    ship(spark)
    if spark.conf.get(ROWS) == ROWS_DEFAULT:
        spark.conf.set(ROWS, ROWS_SMALL)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id and text alone (null text: empty), so that other columns never reach an operator."""
    ready(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def carried(docs: DataFrame) -> Column:
    """All columns of a row but its text, as one column ``rest`` that passes through an operator untouched."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there, on storage that outlives executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables of ``saved`` that nothing reads any more."""
    spark = tables[0].sparkSession
    for f in {x.rsplit("/", 1)[0] for df in tables for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    spark._jvm.System.gc()  # shuffles that nothing holds any more


def held_out(mod: int, rest: int) -> Column:
    """crc32 of doc_id written as text, modulo ``mod``, equals ``rest``; false without a doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod == rest, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of a slice have at most ``limit`` bytes, or it is one row."""
    for b in batches:
        if not b.num_rows:
            continue
        size = text_sizes(b.column(column))
        start = room = 0
        for i, n in enumerate(size):
            if i > start and room + n > limit:
                yield b.slice(start, i - start)
                start, room = i, 0
            room += n
        yield b.slice(start)


def text_sizes(arr: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(arr), 0).to_pylist()
