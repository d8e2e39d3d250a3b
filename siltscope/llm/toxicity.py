"""Toxicity by multiple-instance learning: a document is a bag of sentences, and only the bag has a label.

A sentence's score is a logistic function of the words and word beginnings in it. A document is toxic if any sentence is:
p(doc) = 1 - prod(1 - p(sentence)), the noisy-or. Its likelihood is climbed on document labels alone, and the
trained sentence scores then point at the sentences that carry the label.

The fit takes at most ``SAMPLE`` labelled documents of each class, those with the smallest hashed doc_id, and at most
``FEATURES`` features that screening on them selects; the model is a small table. Every document is scored on its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltscope.llm.common import carried, documents, held_out, saved, slices, texts
from siltscope.llm.words import BASE, BYTE, U, Words, group_starts, mix, powers

SAMPLE = 4000
FEATURES = 4096
#: bytes of the word beginnings that are features beside the whole word
HEADS = (4, 5, 6, 7, 8)
#: a feature needs so many documents of the sample, and so large a chi-square between the classes
SEEN, CHI2 = 5, 20.0
L2, STEPS, RATE = 1e-5, 500, 0.2
THRESHOLD = 0.7
MOD, REST = 3, 1

_SPLIT = np.ones(256, dtype=bool)  # all but ASCII letters, the apostrophe and bytes of other scripts separates words
_SPLIT[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0x27, *range(0x80, 0x100)]] = False
_END = np.zeros(256, dtype=bool)
_END[[ord(c) for c in ".!?\n"]] = True


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))


@dataclass(frozen=True)
class Model:
    """Sentence model: weights of sorted feature hashes, and the bias."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words]:
    """(sentence, feature) of a slice, sentences numbered through it; the row of each sentence; the words."""
    w = Words(text, lower=True, separators=_SPLIT)
    ends = np.concatenate(([0], np.cumsum(_END[w.data])))
    rows = len(text)
    # each text's last sentence is what follows its last end sign, so a text has at least one
    per_row = np.diff(ends[w.offsets]) + 1
    shift = np.arange(rows)
    row_of = np.repeat(np.arange(rows), per_row)
    sentence = ends[w.start] + shift[w.doc]
    n = w.end - w.start
    all_s, all_f = [sentence], [w.hash]
    if len(n):
        longest = max(HEADS)
        up = powers(BASE, longest)
        head = np.zeros(len(n), dtype=U)
        last = len(w.text) - 1
        for i in range(longest):
            head = head + np.where(n > i, BYTE[w.text[np.minimum(w.start + i, last)]] * up[i], U(0))
            if i + 1 in HEADS:
                long = n > i + 1
                all_s.append(sentence[long])
                all_f.append(mix(head[long] ^ U(i + 1)))
    return np.concatenate(all_s), np.concatenate(all_f), row_of, w


def select(batch_features: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which features are in sorted ``keys``, and where there."""
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(keys, batch_features), len(keys) - 1)
    hit = np.flatnonzero(keys[at] == batch_features)
    return hit, at[hit]


def matched(text: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words]:
    """Distinct (sentence, index of key) of a slice, the row of each sentence, and the words."""
    s, f, row_of, w = features(text)
    hit, at = select(f, keys)
    s = s[hit]
    if len(s):
        order = np.lexsort((at, s))
        s, at = s[order], at[order]
        g = group_starts(s, at)
        s, at = s[g], at[g]
    return s, at, row_of, w


def sample(labelled: DataFrame, size: int) -> DataFrame:
    """(doc_id, toxic): up to ``size`` rows of each class, by hashed doc_id."""
    one = labelled.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    part = [one.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size) for y in (0, 1)]
    return part[0].unionByName(part[1])


def screen(bags: DataFrame, n: dict[int, int], most: int) -> np.ndarray:
    """Feature hashes that tell the classes apart, sorted; at most ``most``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s, f, row_of, _ = features(b.column("text"))
            doc, y = row_of[s], b.column("toxic").to_numpy()
            order = np.lexsort((doc, f))
            f, doc = f[order], doc[order]
            if not len(f):
                continue
            g = group_starts(f, doc)
            f, y = f[g], y[doc[g]].astype(np.int64)
            g = group_starts(f)
            pos, all_ = np.add.reduceat(y, g), np.diff(np.append(g, len(f)))
            yield pa.RecordBatch.from_arrays([pa.array(f[g].view(np.int64)), pa.array(pos), pa.array(all_ - pos)], ["feature", "pos", "neg"])

    c = bags.mapInArrow(count, "feature long, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    a, b, n1, n0 = F.col("pos"), F.col("neg"), n.get(1, 0), n.get(0, 0)
    cross = a * (n0 - b) - b * (n1 - a)
    chi2 = (n1 + n0) * cross * cross / ((a + b) * (n1 + n0 - a - b + 1e-9) * F.lit(float(n1 * n0)))
    top = c.filter(a + b >= SEEN).withColumn("chi2", chi2.cast("double")).filter(F.col("chi2") >= CHI2).orderBy(F.desc("chi2"), "feature").limit(most)
    return np.sort(np.array([r["feature"] for r in top.select("feature").collect()], dtype=np.int64).view(U))


def climb(sentence: np.ndarray, feature: np.ndarray, doc_of: np.ndarray, y: np.ndarray, n_features: int, silent: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias that maximise the noisy-or likelihood. ``silent``: a document's sentences without any feature."""
    w, bias = np.zeros(n_features), -4.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(sentence, w[feature], minlength=len(doc_of))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        p0 = 1 / (1 + np.exp(-bias))
        none = np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(y)) + silent * np.log1p(-p0)
        bag = np.clip(-np.expm1(none), 1e-12, 1)
        pull = np.where(y == 1, -(1 - bag) / bag, 1.0)  # of the negative log-likelihood, by each sentence's logit, over p
        g_z = pull[doc_of] * p
        g = np.append(np.bincount(feature, g_z[sentence], minlength=n_features), g_z.sum() + (pull * silent).sum() * p0) / len(y)
        g[:-1] += L2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        d = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - d[:-1], float(np.clip(bias - d[-1], -12, 0))
    return w, bias


def fit(docs: DataFrame, labelled: DataFrame, size: int = SAMPLE, most: int = FEATURES) -> Model:
    """Train on the texts of ``docs`` that ``labelled`` (doc_id, toxic) names."""
    chosen = sample(labelled, size)
    bags = saved(texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic"), "bags")  # at most 2 * size rows
    n = {r["toxic"]: r["count"] for r in bags.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return Model(np.empty(0, U), np.empty(0), -12.0)
    keys = screen(bags, n, most)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s, at, row_of, _ = matched(b.column("text"), keys)
            rows = b.num_rows
            doc = row_of[s]
            cut = np.searchsorted(doc, np.arange(rows + 1))
            n_s = np.bincount(row_of, minlength=rows)
            first = np.cumsum(n_s) - n_s
            lists = [pa.array([x[a:z].tolist() for a, z in zip(cut, cut[1:])], pa.list_(pa.int32())) for x in ((s - first[doc]).astype(np.int32), at.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(n_s.astype(np.int32)), *lists], ["doc_id", "toxic", "sentences", "s", "f"])

    got = bags.mapInArrow(extract, "doc_id long, toxic int, sentences int, s array<int>, f array<int>").orderBy("doc_id").collect()  # sampled documents, selected features
    y = np.array([r["toxic"] for r in got])
    doc = np.repeat(np.arange(len(got)), [len(r["s"]) for r in got])
    s = np.array([x for r in got for x in r["s"]], dtype=np.int64)
    f = np.array([x for r in got for x in r["f"]], dtype=np.int64)
    g = group_starts(doc, s) if len(s) else np.empty(0, np.int64)
    sentence = np.cumsum(np.isin(np.arange(len(s)), g)) - 1
    doc_of = doc[g]
    silent = np.array([r["sentences"] for r in got]) - np.bincount(doc_of, minlength=len(got))
    w, bias = climb(sentence, f, doc_of, y, len(keys), silent)
    return Model(keys, w, bias)


def score(docs: DataFrame, model: Model, *carry: Column) -> DataFrame:
    """(doc_id, carried columns, score, spans): spans are (start, end, score) of sentences scored at least 0.5, in characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p0 = 1 / (1 + np.exp(-model.bias))
        for b in slices(batches):
            s, at, row_of, w = matched(b.column("text"), model.keys)
            rows = b.num_rows
            g = group_starts(s) if len(s) else np.empty(0, np.int64)
            hot = s[g]
            z = model.bias + (np.add.reduceat(model.weights[at], g) if len(g) else np.empty(0))
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            doc = row_of[hot]
            quiet = np.bincount(row_of, minlength=rows) - np.bincount(doc, minlength=rows)
            none = quiet * np.log1p(-p0) + np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=rows)
            spans: list[list[dict]] = [[] for _ in range(rows)]
            loud = np.flatnonzero(p >= 0.5)
            if len(loud):
                n_s = np.bincount(row_of, minlength=rows)
                first = np.cumsum(n_s) - n_s
                stop = np.flatnonzero(_END[w.data])
                for i in loud.tolist():
                    d = int(doc[i])
                    a, z_ = int(w.offsets[d]), int(w.offsets[d + 1])
                    ends = [a, *(stop[np.searchsorted(stop, a) : np.searchsorted(stop, z_)] + 1).tolist(), z_]
                    k = int(hot[i] - first[d])
                    text = w.data[a:z_].tobytes()
                    x, y = ends[k] - a, ends[k + 1] - a
                    spans[d].append({"start": len(text[:x].decode(errors="replace")), "end": len(text[:y].decode(errors="replace")), "score": float(p[i])})
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            out = [pa.array(np.clip(-np.expm1(none), 0, 1)), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + out, [*names, "score", "spans"])

    t = texts(docs, *carry)
    names = [c for c in t.columns if c != "text"]
    schema = T.StructType([t.schema[c] for c in names]).add("score", "double").add("spans", SPANS)
    return t.mapInArrow(run, schema)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, unchanged, that are not predicted toxic; learning as in ``toxicity``."""
    learn = labels.select("doc_id", "toxic").filter(~held_out(MOD, REST))
    s = score(docs, fit(docs, learn), carried(docs), F.col("text").alias("given"))
    return s.filter(F.col("score") < threshold).select(*[F.col("given").alias("text") if c == "text" else F.col(f"rest.`{c}`") for c in docs.columns])


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, spans.

    Labels are learned only from rows whose crc32(doc_id as text) mod 3 is not 1; a label other than 0 or 1 is no label, of
    several for a doc_id the largest counts. Null and empty texts have one empty sentence and its score. Without labels of both
    classes every score is near 0. Repeated rows are scored alike, rows without a doc_id too (held_out false).
    """
    learn = labels.select("doc_id", "toxic").filter(~held_out(MOD, REST))
    s = score(docs, fit(docs, learn))
    return s.select("doc_id", held_out(MOD, REST).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
