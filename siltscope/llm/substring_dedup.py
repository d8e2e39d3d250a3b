"""Removal of passages that an earlier document has: exact windows of words behind a count-min prefilter.

Every window of 50 words is represented by an anchor, the smallest hash among its runs of 8 words: neighbouring
windows mostly share it, so a document has about one anchor in 20 words, and equal windows have equal anchors.
Pass 1 counts in how many documents an anchor occurs, in a sketch per partition; the sketches are merged. A window occurs
in at most as many documents as its anchor, and the sketch only overestimates, so no repeated window is missed. Pass 2 sends
just the windows whose anchor is estimated repeated to exact grouping by 96-bit hash.

A slice settles among its own documents first and sends one document per window: a passage that a third of all
documents share makes one row per slice. The sketch has a fixed largest size; beyond it more windows go to the second
pass, and results stay the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltscope.llm.common import carried, documents, saved, slices, texts
from siltscope.llm.sketch import CountMin
from siltscope.llm.words import Words, deal, group_starts, mix, sliding_min

WINDOW = 50
GRAM = 8
#: the sketch has three rows of 2^bits bytes: 64 counters a row for each document, within these bounds
BITS = (16, 24)
#: documents whose windows one group of the exact pass holds, were all windows estimated repeated
GROUP_DOCS = 1500
LAST = np.iinfo(np.int64).max


def anchors(w: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every window: the index of its first word, and its anchor."""
    gram = min(GRAM, window)
    at, h = w.runs(gram)
    k = window - gram + 1
    low = sliding_min(h, k)
    n = len(low)
    # windows within one document: its grams are neighbours, and words first and last are in the same row
    whole = (at[k - 1 :] - at[:n] == k - 1) & (w.doc[at[:n]] == w.doc[np.minimum(at[:n] + window - 1, len(w.doc) - 1)])
    return at[:n][whole], low[whole]


def sketch_anchors(t: DataFrame, bits: int, window: int) -> CountMin:
    """The merged sketch; each document counts once per anchor."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = CountMin(bits)
        for b in slices(batches):
            w = Words(b.column("text"))
            at, low = anchors(w, window)
            doc = w.doc[at]
            new = group_starts(doc, low) if len(low) else np.empty(0, np.int64)
            doc, low = doc[new], low[new]
            order = np.lexsort((low, doc))
            once = group_starts(doc[order], low[order]) if len(low) else order
            s.add(low[order][once])
        for p in s.batches():
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in p], pa.int32()), pa.array([x for _, x in p], pa.binary())], ["piece", "counts"])

    def merge(table: pa.Table) -> pa.Table:
        return pa.table({"piece": table.column("piece").slice(0, 1), "counts": pa.array([CountMin.merge(table.column("counts").to_pylist())], pa.binary())})

    schema = "piece int, counts binary"
    merged = t.select("text").mapInArrow(count, schema).groupBy("piece").applyInArrow(merge, schema)
    return CountMin.of(bits, [(r["piece"], r["counts"]) for r in merged.collect()])  # at most 3 * 2^bits bytes


def covered_starts(t: DataFrame, window: int, bits: int, n_groups: int) -> DataFrame:
    """(doc_id, key, starts): first words of windows that also start in a document with a smaller doc_id.

    ``t`` has doc_id, text, key; a document may get several rows, with int32 starts as bytes.
    """
    sketch = t.sparkSession.sparkContext.broadcast(sketch_anchors(t, bits, window).table)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = CountMin(bits, sketch.value)
        for b in slices(batches):
            w = Words(b.column("text"))
            at, low = anchors(w, window)
            repeated = s.count(low) >= 2
            at, low = at[repeated], low[repeated]
            if not len(at):
                continue
            first, h1 = w.runs(window)
            _, h2 = w.runs(window, second=True)
            pick = np.searchsorted(first, at)
            k1, k2 = h1[pick], (h2[pick] >> np.uint64(32)).astype(np.uint32)
            doc = w.doc[at]
            ids = np.array([LAST if x is None else x for x in b.column("doc_id").to_pylist()], dtype=np.int64)
            keys = b.column("key").to_numpy(zero_copy_only=False)
            start = (at - w.first[doc]).astype(np.int32)
            order = np.lexsort((ids[doc], k2, k1))
            k1, k2, doc, start, low = k1[order], k2[order], doc[order], start[order], low[order]
            g = group_starts(k1, k2)
            least = np.repeat(ids[doc][g], np.diff(np.append(g, len(k1))))
            here = ids[doc] > least
            rows = [(-1, *x) for x in _by_doc(doc[here], start[here], ids, keys)]
            order = np.flatnonzero(~here)
            order = order[np.lexsort((start[order], doc[order]))]
            k1, k2, doc, start, low = k1[order], k2[order], doc[order], start[order], low[order]
            # dealt by anchor, so that neighbouring windows stay together and their ids and places pack well
            out = [(p, k1[i].tobytes(), k2[i].tobytes(), ids[doc[i]].tobytes(), keys[doc[i]].tobytes(), start[i].tobytes()) for p, i in deal(mix(low), n_groups)]
            # what the slice has settled passes through any group
            out += [(int(abs(k) % n_groups), None, None, np.int64(d).tobytes(), np.int64(k).tobytes(), st) for _, d, k, st in rows]
            names = ["p", "k1", "k2", "doc", "key", "start"]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32())] + [pa.array([x[i] for x in out], pa.binary()) for i in range(1, 6)], names)

    def settle(table: pa.Table) -> pa.Table:
        done: list[tuple[int, int, bytes]] = []
        parts: list[tuple[np.ndarray, ...]] = []
        for k1, k2, doc, key, start in zip(*(table.column(c).to_pylist() for c in ("k1", "k2", "doc", "key", "start"))):
            if k1 is None:
                done.append((int(np.frombuffer(doc, np.int64)[0]), int(np.frombuffer(key, np.int64)[0]), start))
            else:
                parts.append((np.frombuffer(k1, np.uint64), np.frombuffer(k2, np.uint32), np.frombuffer(doc, np.int64), np.frombuffer(key, np.int64), np.frombuffer(start, np.int32)))
        if parts:
            k1, k2, doc, key, start = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((doc, k2, k1))
            k1, k2, doc, key, start = k1[order], k2[order], doc[order], key[order], start[order]
            g = group_starts(k1, k2)
            gone = doc > np.repeat(doc[g], np.diff(np.append(g, len(k1))))
            doc, key, start = doc[gone], key[gone], start[gone]
            order = np.lexsort((start, key, doc))
            doc, key, start = doc[order], key[order], start[order]
            cut = group_starts(doc, key) if len(doc) else np.empty(0, np.int64)
            done += [(int(doc[a]), int(key[a]), start[a:b].tobytes()) for a, b in zip(cut, np.append(cut[1:], len(doc)))]
        return pa.table([pa.array([None if x[0] == LAST else x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.binary())], names=["doc_id", "key", "starts"])

    posts = t.mapInArrow(post, "p int, k1 binary, k2 binary, doc binary, key binary, start binary")
    return posts.groupBy("p").applyInArrow(settle, "doc_id long, key long, starts binary")


def _by_doc(doc: np.ndarray, start: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> list[tuple[int, int, bytes]]:
    if not len(doc):
        return []
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    cut = group_starts(doc)
    return [(int(ids[doc[a]]), int(keys[doc[a]]), start[a:b].tobytes()) for a, b in zip(cut, np.append(cut[1:], len(doc)))]


def remove_repeats(docs: DataFrame, *carry: Column, window: int = WINDOW, bits: int | None = None) -> DataFrame:
    """One row per document: doc_id, carried columns, n_words, n_removed, kept_text (kept words joined by one space).

    A word goes if a window of ``window`` consecutive words that covers it also starts in a document with a smaller doc_id;
    windows are judged on the input. Null, empty and shorter texts lose nothing. A missing doc_id counts as larger than
    any. Rows that repeat a doc_id do not precede one another, so repeated rows lose the same words. Other columns are ignored.
    """
    t = texts(docs, F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), *carry)
    slim = t.select("doc_id", "text", "key")
    n = t.count()
    bits = bits or min(BITS[1], max(BITS[0], (64 * n).bit_length()))
    gone = saved(covered_starts(slim, window, bits, max(64, n // GROUP_DOCS)), "covered")
    gone = gone.groupBy("doc_id", "key").agg(F.collect_list("starts").alias("starts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n_words, n_removed, kept = [], [], []
            for text, starts in zip(b.column("text").to_pylist(), b.column("starts").to_pylist()):
                words = text.encode().split()
                n_words.append(len(words))
                if starts:
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    for s in starts:
                        at = np.frombuffer(s, np.int32)
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + window, -1)
                    stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                    n_removed.append(len(words) - len(stay))
                    words = [words[i] for i in stay.tolist()]
                else:
                    n_removed.append(0)
                kept.append(b" ".join(words).decode())
            out = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + out, [*names, "n_words", "n_removed", "kept_text"])

    g = gone.select(F.col("doc_id").alias("g_id"), F.col("key").alias("g_key"), "starts")
    j = t.join(g, t.doc_id.eqNullSafe(g.g_id) & (t.key == g.g_key), "left").drop("g_id", "g_key", "key")
    names = [c for c in t.columns if c not in ("text", "key")]
    schema = T.StructType([t.schema[c] for c in names]).add("n_words", "long").add("n_removed", "long").add("kept_text", "string")
    return j.mapInArrow(cut, schema)


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text`` and ``n_chars`` set anew where a document changed.

    A document that loses all its words goes; one that loses none keeps its text to the byte.
    """
    r = remove_repeats(docs, carried(docs), F.col("text").alias("given"), window=window).filter("n_removed < n_words OR n_words = 0")
    changed = F.col("n_removed") > 0
    columns = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("given"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(changed, F.length("kept_text").cast(kind)).otherwise(F.col("rest.n_chars"))
    return r.select(*[columns.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    r = remove_repeats(documents(spark, sf_dir))
    return r.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP10_SQL = f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS m FROM win) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS j FROM hit, range(0, {WINDOW}) AS r(k)),
kept AS (SELECT d.doc_id, string_agg(u.x, ' ' ORDER BY u.j) AS t, count(*) AS n
         FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d) u JOIN d USING (doc_id)
         LEFT JOIN gone g ON g.doc_id = u.doc_id AND g.j = u.j WHERE g.j IS NULL GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id)"""
