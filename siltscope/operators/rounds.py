"""Greedy choices that read as sequential, made in parallel rounds.

Both operators give what a walk over the sorted rows gives, but decide in each round everything that no earlier undecided row can
change, so a key with a third of all rows is spread over all tasks. A round is a few aggregations over slim rows, stored before the
next. When no more than ``walk`` rows of all keys together are undecided, they are walked in order, key by key: by then that is
bounded work, whatever one key holds of it. Rows that form one long chain of dependencies would need a round a link; what ``rounds``
rounds leave of them is walked as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltscope.operators.ordered import keep_in_order
from siltscope.session import stored

ROUNDS = 50
#: undecided rows that one task may walk
WALK = 50_000


#: ranges of key hashes that are counted to find keys with many rows
BUCKETS = 1 << 18


def many_rows(df: DataFrame, keys: Sequence[str], limit: int = WALK) -> DataFrame | None:
    """Keys with more than ``limit`` rows; None if there are none.

    Rows are counted per range of key hashes, so each task sends at most ``BUCKETS`` numbers; only keys of ranges beyond the limit are
    counted themselves.
    """
    keys = list(keys)
    slim = df.select(*keys, F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("_bucket"))
    full = [r[0] for r in slim.groupBy("_bucket").count().filter(F.col("count") > limit).select("_bucket").collect()]
    if not full:
        return None
    inside = slim.join(F.broadcast(df.sparkSession.createDataFrame([(b,) for b in full], "_bucket long")), "_bucket")
    return stored(inside.groupBy(*keys).count().filter(F.col("count") > limit).select(*keys), "many-rows")


def assign(pairs: DataFrame, keys: Sequence[str], taker: str, taken: str, wish: Column, rounds: int = ROUNDS, walk: int = WALK) -> DataFrame:
    """One-to-one assignment per key: takers in ascending order each take their first free choice by ``wish`` (a struct, ascending,
    that ends in ``taken`` so that no two choices of a taker are equal).

    Serial choice is the one stable matching of takers with things that all prefer the smaller taker, so it is found by proposals: each
    taker proposes to its first choice left, a thing holds on to the smallest taker that asks, and is gone for all larger ones. A
    proposal to a thing that no smaller taker has left among its choices is final, and the taker's other choices go.
    """
    keys = list(keys)
    columns = pairs.columns
    best = F.min_by(F.struct(*[c for c in columns if c not in (*keys, taker)]), wish)
    live, final = stored(pairs, "assign"), []
    for i in range(rounds):
        if live.count() <= walk:
            break
        asked = live.groupBy(*keys, taker).agg(best.alias("_b")).select(*keys, taker, "_b.*")
        held = asked.groupBy(*keys, taken).agg(F.min(taker).alias("_by"))
        first = live.groupBy(*keys, taken).agg(F.min(taker).alias("_first"))
        final.append(stored(asked.join(first, [*keys, taken]).filter(F.col(taker) == F.col("_first")).select(*columns), f"assigned-{i}"))
        open_ = live.join(held, [*keys, taken], "left").filter(F.col("_by").isNull() | (F.col(taker) <= F.col("_by")))
        live = stored(open_.join(final[-1].select(*keys, taker), [*keys, taker], "left_anti").select(*columns), f"assign-{i}")

    def decide(state: tuple[set, set], a: object, b: object) -> bool:
        done, gone = state
        if a in done or b in gone:
            return False
        done.add(a)
        gone.add(b)
        return True

    # choices that were pruned can never be made, so a walk over the others ends in the same assignment
    out = keep_in_order(live.withColumn("_w", wish), keys, [F.asc(taker), F.asc("_w")], [taker, taken], lambda: (set(), set()), decide).select(*columns)
    for f in final:
        out = out.unionByName(f)
    return out


def first_apart(items: DataFrame, keys: Sequence[str], order: Column, covers: Column, checks: Column, rounds: int = ROUNDS, walk: int = WALK) -> tuple[DataFrame, DataFrame]:
    """(kept, undecided): rows kept by a walk in ``order`` (a struct without ties) that drops a row near one kept before.

    Nearness is told by marks, arrays of strings: a row is near an earlier one if it ``checks`` a mark that the earlier one ``covers``.
    In a round a row is kept if no undecided earlier row covers a mark that it checks, and what is near a kept row goes. Both are
    minima per (key, mark), so rows are linear in marks, not in pairs. The undecided rows are for the caller to walk; no kept row is near
    them.
    """
    keys = list(keys)
    columns = items.columns
    left = stored(items.withColumn("_o", order).withColumn("_cov", covers).withColumn("_chk", checks).withColumn("_id", F.monotonically_increasing_id()), "apart")
    kept: list[DataFrame] = []
    for i in range(rounds):
        if left.count() <= walk:
            break
        first = left.select(*keys, F.explode("_cov").alias("_m"), "_o").groupBy(*keys, "_m").agg(F.min("_o").alias("_first"))
        seen = left.select(*keys, "_id", F.explode("_chk").alias("_m"), "_o").join(first, [*keys, "_m"])
        waits = seen.groupBy("_id").agg(F.max(F.col("_first") < F.col("_o")).alias("_wait"))
        judged = stored(left.join(waits, "_id", "left").withColumn("_wait", F.coalesce("_wait", F.lit(False))), f"apart-{i}")
        safe = judged.filter(~F.col("_wait"))
        kept.append(safe)
        near = safe.select(*keys, F.explode("_cov").alias("_m"), "_o").groupBy(*keys, "_m").agg(F.min("_o").alias("_kept"))
        rest = judged.filter("_wait").drop("_wait")
        gone = rest.select(*keys, "_id", F.explode("_chk").alias("_m"), "_o").join(near, [*keys, "_m"]).filter(F.col("_kept") < F.col("_o")).select("_id").distinct()
        left = stored(rest.join(gone, "_id", "left_anti"), f"apart-left-{i}")
    done = left.limit(0) if not kept else kept[0]
    for k in kept[1:]:
        done = done.unionByName(k)
    return done.select(*columns), left.select(*columns)
