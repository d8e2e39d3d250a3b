"""Session defaults shared by jobs, tests and the benchmark."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # one task must fit the widest Arrow batch of whole files
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024),
    "spark.ui.showConsoleProgress": "false",
    # call-site capture costs a JVM round trip per column expression
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def get_spark(app: str = "siltscope", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session; explicit ``conf`` entries win over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_spark(cpus: int | None = None, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Local session for tests and the benchmark."""
    cpus = cpus or os.cpu_count() or 4
    return get_spark(
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(shuffle_partitions),
            "spark.driver.memory": memory,
            "spark.ui.enabled": "false",
        },
    )


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for stored tables and snapshots, in the folder the cluster names in ``spark.checkpoint.dir``.

    Where that is unset a local session takes a temporary folder. On a cluster there is no such folder that all machines see, so
    the setting is asked for.
    """
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: several readers, one computation, and a lineage that ends there."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a session, so that Python stages can import it.

    Workers that already have the package on their path take the same code from the archive.
    """
    import tempfile
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_siltscope_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "siltscope.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._siltscope_shipped = True
