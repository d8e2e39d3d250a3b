"""Order-dependent steps over hot keys.

One key may hold a third of all rows, so a plain ``Window.partitionBy(key)`` would put them into
one task.  These helpers split a key into ranges of the order itself (``ranged``): Spark samples the borders, so a key's ranges are
of one size however its rows crowd together.  They work inside (key, range) and carry only one row per range across the key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltscope.session import stored


CHUNK = "_range"


def ranged(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` stored in ranges of (keys, order), numbered by ``CHUNK`` along the order; equal rows share a range.

    Stored, because sampling again would draw other borders.
    """
    return stored(df.repartitionByRange(*keys, *order).withColumn(CHUNK, F.spark_partition_id()), "ranges")


def prefix_sum(
    df: DataFrame,
    keys: list[str],
    chunk: str | None,
    order: str | list[str],
    value: str,
    out: str,
    stop_after: float | None = None,
) -> DataFrame:
    """Running sum of ``value`` per key in (chunk, order).

    ``chunk`` must not decrease along ``order``; without one, rows are dealt to ranges.  With ``stop_after`` chunks that begin
    beyond it are dropped before any row of theirs is ordered.
    """
    order = [order] if isinstance(order, str) else order
    if chunk is None:
        df, chunk = ranged(df, keys, order), CHUNK
        return prefix_sum(df, keys, chunk, order, value, out, stop_after).drop(CHUNK)
    totals = df.groupBy(*keys, chunk).agg(F.sum(value).alias("_tot"))
    across = W.partitionBy(*keys).orderBy(chunk)
    starts = totals.select(
        *keys, chunk, (F.sum("_tot").over(across.rowsBetween(W.unboundedPreceding, 0)) - F.col("_tot")).alias("_start")
    )
    if stop_after is not None:
        starts = starts.filter(F.col("_start") <= stop_after)
    within = W.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (
        df.join(starts, [*keys, chunk])
        .withColumn(out, F.col("_start") + F.sum(value).over(within))
        .drop("_start")
    )


def lag_in_key(
    df: DataFrame,
    keys: list[str],
    chunk: Column | None,
    order: list[str],
    value: Column,
    out: str,
) -> DataFrame:
    """Previous row's ``value`` per key, computed inside (key, chunk).

    Only the last value of each chunk travels across the key; ``chunk`` must not decrease along
    ``order``; without one, rows are dealt to ranges.  ``value`` may be null: a null previous value stays null, as with lag().
    """
    if chunk is None:
        return lag_in_key(ranged(df, keys, order), keys, F.col(CHUNK), order, value, out).drop(CHUNK)
    ord_struct = F.struct(*order)
    base = df.withColumn("_chunk", chunk).withColumn("_v", F.struct(value.alias("v")))
    ends = base.groupBy(*keys, "_chunk").agg(F.max_by("_v", ord_struct).alias("_end"))
    carried = ends.select(
        *keys, "_chunk", F.lag("_end").over(W.partitionBy(*keys).orderBy("_chunk")).alias("_carry")
    )
    within = W.partitionBy(*keys, "_chunk").orderBy(*order)
    return (
        base.withColumn("_prev", F.lag("_v").over(within))
        .join(carried, [*keys, "_chunk"])
        .withColumn(out, F.coalesce("_prev", "_carry")["v"])
        .drop("_chunk", "_v", "_prev", "_carry")
    )


def row_number_in_key(df: DataFrame, keys: list[str], chunk: Column | None, order: list[str], out: str) -> DataFrame:
    """1-based position of each row per key, computed inside (key, chunk); without ``chunk`` rows are dealt to ranges."""
    if chunk is None:
        return row_number_in_key(ranged(df, keys, order), keys, F.col(CHUNK), order, out).drop(CHUNK)
    base = df.withColumn("_chunk", chunk)
    counts = base.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
    across = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, 0)
    starts = counts.select(*keys, "_chunk", (F.sum("_n").over(across) - F.col("_n")).alias("_start"))
    within = W.partitionBy(*keys, "_chunk").orderBy(*order)
    return (
        base.withColumn("_rn", F.row_number().over(within))
        .join(starts, [*keys, "_chunk"])
        .withColumn(out, (F.col("_start") + F.col("_rn")).cast("long"))
        .drop("_chunk", "_rn", "_start")
    )


def first_n(df: DataFrame, keys: list[str], order: list[Column | str], n: int | None) -> DataFrame:
    """First ``n`` rows per key; without ``n`` all rows.

    The rank filter is pushed below the shuffle (at most ``n`` rows per key and input partition
    leave a task), so a hot key costs n x partitions rows, not all of them.
    """
    if n is None:
        return df
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def keep_in_order(df: DataFrame, keys: list[str], order: list[Column], inputs: list[str], new_state: Callable[[], object], decide: Callable[..., bool]) -> DataFrame:
    """Rows of a greedy walk per key: ``decide(state, *inputs)`` says whether a row is kept.

    Rows are partitioned by key and sorted by Spark (the sort spills), then pass through as Arrow
    batches; only the walk's state is held, never the rows of a group, and many small groups share
    one batch.  Only keys and inputs become Python values.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            mask = []
            read = [zip(*[batch.column(c).to_pylist() for c in cols]) for cols in (keys, inputs)]
            for key, values in zip(*read):
                if key != current:
                    current, state = key, new_state()
                mask.append(decide(state, *values))
            yield batch.filter(pa.array(mask, pa.bool_()))

    placed = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return placed.mapInArrow(run, schema=df.schema)
