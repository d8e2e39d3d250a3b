"""Best-fit packing of token pieces into sequences, improved by swaps between underfull bins.

There are at most ``capacity`` lengths, so the whole corpus is one small histogram: bins that hold the same lengths
are one class with a multiplicity, and placing, moving and swapping act on classes. The plan's size depends on the
capacity, not on the corpus. Spark tokenizes, cuts, counts, numbers the pieces of a length and gives each its slot.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltscope.llm.common import saved, slices, texts

CAPACITY = 1024
END_ID = 2
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int"

Bins = dict[tuple[int, ...], int]


def best_fit(counts: dict[int, int], capacity: int) -> Bins:
    """Best fit, longest first; ``{lengths of a bin, longest first: bins}``."""
    open_: dict[int, Bins] = defaultdict(dict)  # room left -> class -> bins
    rooms: list[int] = []

    def put(room: int, held: tuple[int, ...], n: int) -> None:
        if not open_[room]:
            insort(rooms, room)
        open_[room][held] = open_[room].get(held, 0) + n

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            room = next((r for r in rooms if r >= size), None)
            if room is None:
                each = capacity // size
                if left >= each:
                    put(capacity - each * size, (size,) * each, left // each)
                if left % each:
                    put(capacity - left % each * size, (size,) * (left % each), 1)
                break
            held, n = next(iter(open_[room].items()))
            n_now = min(n, left)
            if n_now == n:
                del open_[room][held]
                if not open_[room]:
                    rooms.remove(room)
            else:
                open_[room][held] = n - n_now
            put(room - size, (*held, size), n_now)
            left -= n_now
    out: Bins = {}
    for classes in open_.values():
        for held, n in classes.items():
            out[held] = out.get(held, 0) + n
    return out


def _gain(fuller: tuple[int, ...], other: tuple[int, ...], capacity: int) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
    """The best exchange that fills ``fuller`` up from ``other``: a move, one for one, or two for one.

    Returns by how much the sum of squared fills grows (0: none) and the two bins after it.
    """
    f, o = sum(fuller), sum(other)
    room = capacity - f
    best = (0, fuller, other)
    gives = [(x, (x,)) for x in set(other)]
    gives += [(a + b, (a, b)) for i, a in enumerate(other) for b in set(other[i + 1 :])]
    for back in (0, *set(fuller)):
        for x, items in gives:
            shift = x - back
            if not 0 < shift <= room or (not back and len(items) > 1):
                continue
            gain = (f + shift) ** 2 + (o - shift) ** 2 - f * f - o * o
            if gain > best[0]:
                a, b = list(fuller), list(other)
                for i in items:
                    b.remove(i)
                    a.append(i)
                if back:
                    a.remove(back)
                    b.append(back)
                best = (gain, tuple(sorted(a, reverse=True)), tuple(sorted(b, reverse=True)))
    return best


def _partners(under: list[tuple[int, ...]], capacity: int) -> Callable[[tuple[int, ...]], list[int]]:
    """A function that gives the places in ``under`` of all classes that an exchange can fill up from a class, last first.

    The largest shift that fits gains most, and it gains if the fuller bin ends above what the other one had.
    """
    fill = np.array([sum(h) for h in under])
    backs = [(0, *set(h)) for h in under]
    of = np.repeat(np.arange(len(under)), [len(b) for b in backs])
    back = np.array([x for b in backs for x in b])
    fits = back + (capacity - fill)[of]

    def largest(gives: list[int]) -> np.ndarray:
        at = np.searchsorted(gives := np.sort(gives), fits, "right") - 1
        return np.where(at < 0, -1, gives[at])

    def partners(other: tuple[int, ...]) -> list[int]:
        one = [*set(other)]
        two = [a + b for i, a in enumerate(other) for b in set(other[i + 1 :])]
        shift = np.where(back == 0, largest(one), largest(one + two)) - back
        return np.unique(of[shift > np.maximum(0, sum(other) - fill[of])])[::-1].tolist()

    return partners


def local_search(bins: Bins, capacity: int) -> Bins:
    """Exchange and move items between underfull bins while the sum of squared fills grows; emptied bins go.

    Every underfull class is tried with every other one, and the rounds end when none of them gains or no bin is left to save.
    """
    bins = dict(bins)
    total = sum(sum(held) * n for held, n in bins.items())
    least = -(-total // capacity)
    changed = True
    while changed and sum(bins.values()) > least:
        under = sorted((h for h in bins if sum(h) < capacity), key=lambda h: (sum(h), h))
        partners = _partners(under, capacity)
        changed = False
        for other in under:  # the emptiest gives first
            if not bins.get(other, 0):
                continue
            for at in partners(other):
                fuller = under[at]
                have = bins.get(other, 0), bins.get(fuller, 0)
                n = min(have) if other != fuller else have[0] // 2
                if not n:
                    continue
                _, a, b = _gain(fuller, other, capacity)
                for held, d in ((fuller, -n), (other, -n), (a, n), (b, n)):
                    if held:
                        bins[held] = bins.get(held, 0) + d
                changed = True
        bins = {h: n for h, n in bins.items() if n}
    return bins


def runs(bins: Bins) -> list[tuple[int, int, int, int, int]]:
    """(length, first, n, sequence, offset): pieces first..first+n-1 of that length go to sequences from ``sequence`` on."""
    seen: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for held, n in sorted(bins.items(), reverse=True):
        at = 0
        for size in held:
            out.append((size, seen[size], n, sequence, at))
            seen[size] += n
            at += size
        sequence += n
    return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Ids of each text, an end id after them, cut into pieces of at most ``capacity``; the first may be shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from siltscope.llm.tokens import encoder

        enc, part, end = encoder(tokenizer), TaskContext.get().partitionId(), end_id.to_bytes(4, "little")
        for b in slices(batches):
            rows: list[tuple] = []
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text"))):
                ids = ids.astype("<u4").tobytes() + end
                n = len(ids) // 4
                at, piece, size = 0, 0, n % capacity or capacity
                while at < n:
                    rows.append((doc_id, piece, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), part))
                    at, piece, size = at + size, piece + 1, capacity
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "part"])

    return texts(docs).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Rows without a doc_id, or with one that repeats, are packed like any
    other. Pieces of equal length are interchangeable; they take slots in the order of reading task, doc_id and piece.
    """
    spark = docs.sparkSession
    cut = saved(pieces(docs, tokenizer, capacity, end_id), "pieces")
    by_part = cut.groupBy("length", "part").count()
    counts: dict[int, int] = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    plan = runs(local_search(best_fit(counts, capacity), capacity))
    slots = F.broadcast(spark.createDataFrame(plan, "length int, first long, n long, sequence long, offset long"))
    # a length may hold most pieces: they are numbered within (length, reading task) and the tasks' sums come before
    before = by_part.select(
        "length", "part",
        F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece"))
    p = cut.withColumn("rank", rank).join(before, ["length", "part"]).withColumn("rank", F.col("rank") - 1 + F.col("before"))
    s = p.join(slots, (p.length == slots.length) & (p["rank"] >= slots["first"]) & (p["rank"] < slots["first"] + slots["n"]))
    return s.select(
        "doc_id", "piece", "start", p.length.cast("long").alias("length"), "ids_crc32",
        (slots["sequence"] + p["rank"] - slots["first"]).alias("sequence_id"), "offset",
    )
