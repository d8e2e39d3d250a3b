"""Language identification by error-correcting output codes over byte n-grams.

Each language has a codeword; for every bit one binary logistic classifier over hashed n-gram shares separates the languages
whose bit is one. A text's decision values are compared with all codewords by logistic loss, each bit weighted by how well
its classifier did on the sample; the nearest codeword wins, and a text whose runner-up is close is flagged.

The fit takes at most ``SAMPLE`` labelled documents, equally many of each language, by hashed doc_id; every text is classified whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltscope.llm.common import documents, held_out, saved, slices, texts
from siltscope.llm.words import LOWER, U, flat

#: labelled documents of the fit; of each, the whole text and two short spans are examples
SAMPLE = 900
SPANS = (48, 240)
BITS = 13
SIZES = (1, 2, 3)
MAX_CODE = 31
STEPS, RATE, L2 = 300, 0.5, 1e-3
#: share of the best language below which a text is ambiguous
CLEAR = 0.8
MOD, REST = 4, 2
UNKNOWN = "und"

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass(frozen=True)
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # 2^BITS x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k rows of -1 and 1: all splits for few languages, else random columns whose rows lie far apart."""
    if k <= 5:
        cols = [[1 if i == 0 or not (c >> (i - 1)) & 1 else -1 for i in range(k)] for c in range(1, 1 << (k - 1))]
        return np.array(cols, dtype=np.float64).T.reshape(k, -1)
    rng = np.random.default_rng(seed)
    bits = min(MAX_CODE, max(15, int(10 * np.log2(k))))
    best, far = None, -1
    for _ in range(200):
        code = np.where(rng.random((k, bits)) < 0.5, -1.0, 1.0)
        code[0, np.all(code == code[0], axis=0)] *= -1  # every bit separates something
        apart = min(int((code[i] != code[i + 1 :]).sum(axis=1).min()) for i in range(k - 1))
        if apart > far:
            best, far = code, apart
    return best


def grams(text: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: bucket and row of the n-grams of a slice; signs and digits count as one blank kind, and no n-gram spans two rows."""
    data, offsets = flat(text)
    x = np.where(_LETTER[data], LOWER[data], 0x20).astype(U)
    row = np.repeat(np.arange(len(text)), np.diff(offsets))
    for n in SIZES:
        if len(x) < n:
            continue
        h = np.full(len(x) - n + 1, n, dtype=U)
        for j in range(n):
            h = (h + x[j : len(x) - n + 1 + j]) * U(0x9E3779B97F4A7C15)
            h ^= h >> U(29)
        inside = row[: len(x) - n + 1] == row[n - 1 :]
        yield ((h * U(0xD1342543DE82EF95)) >> U(64 - BITS))[inside].astype(np.int64), row[: len(x) - n + 1][inside]


def shares(text: pa.Array) -> np.ndarray:
    """rows x 2^BITS shares of the buckets."""
    out = np.zeros((len(text), 1 << BITS), dtype=np.float32)
    for bucket, row in grams(text):
        np.add.at(out, (row, bucket), 1)
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1)


def fit(docs: DataFrame) -> Model:
    """``docs`` has doc_id, text, lang; rows of the held-out part, without language or without text are left out."""
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(MOD, REST))
    names = sorted(r["lang"] for r in labelled.select("lang").distinct().collect())  # languages, not documents
    if not names:
        return Model([], np.empty((0, 0)), np.zeros((1 << BITS, 0)), np.empty(0), np.empty(0))
    each = max(SAMPLE // len(names), 3)
    first = Window.partitionBy("lang").orderBy("h", "doc_id")
    ids = labelled.select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).withColumn("r", F.row_number().over(first)).filter(F.col("r") <= each).select("doc_id").distinct()
    rows = saved(labelled.join(F.broadcast(ids), "doc_id").select("doc_id", "lang", "text"), "language-sample").orderBy("doc_id", "lang", "text")
    at = {x: i for i, x in enumerate(names)}

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            lang, examples = [], []
            for name, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                raw = text.encode()
                cut = [raw, *(raw[len(raw) // 3 :][:n] for n in SPANS)]
                examples += [c.decode(errors="ignore") for c in cut]
                lang += [at[name]] * len(cut)
            x = shares(pa.array(examples, pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])

    got = rows.select("lang", "text").mapInArrow(extract, "lang int, x binary").collect()  # 3 * SAMPLE rows of 2^BITS shares
    y = np.array([r["lang"] for r in got])
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in got])
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-4
    x = (x - mean) / spread
    code = codewords(len(names))
    target = code[y]
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    rate = RATE / np.sqrt(x.shape[1])
    for _ in range(STEPS if code.shape[1] else 0):
        z = x @ w + b
        g = (-target / (1 + np.exp(np.clip(target * z, -30, 30))) / len(y)).astype(np.float32)
        w -= rate * 10 * (x.T @ g + L2 * w)
        b -= rate * 10 * g.sum(axis=0)
    right = (np.sign(x @ w + b) == target).mean(axis=0) if code.shape[1] else np.empty(0)
    trust = np.log(np.clip(right, 0.51, 0.999) / (1 - np.clip(right, 0.51, 0.999)))
    w = w / spread[:, None]
    return Model(names, code, w.astype(np.float32), (b - mean @ w).astype(np.float64), trust / max(trust.sum(), 1e-9))


def decode(model: Model, z: np.ndarray) -> np.ndarray:
    """rows x languages: softmax of the negative weighted losses against each codeword."""
    margin = z[:, None, :] * model.code[None, :, :]
    loss = (np.logaddexp(0, -margin) * model.trust).sum(axis=2) * max(model.code.shape[1], 1)
    e = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
    return e / e.sum(axis=1, keepdims=True)


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ascii_ = np.zeros(256, dtype=bool)
        ascii_[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
        for b in slices(batches, limit=1 << 20):
            text = b.column("text")
            data, offsets = flat(text)
            rows = len(text)
            z, total = np.zeros((rows, len(model.bias))), np.zeros(rows)
            for bucket, row in grams(text):
                cut = np.searchsorted(row, np.arange(rows))
                full = np.flatnonzero(np.bincount(row, minlength=rows))
                if len(full) and len(model.bias):
                    z[full] += np.add.reduceat(model.weights[bucket], cut[full], axis=0, dtype=np.float64)
                total += np.bincount(row, minlength=rows)
            z = z / np.maximum(total, 1)[:, None] + model.bias
            share = decode(model, z) if model.langs else np.zeros((rows, 1))
            seen = np.concatenate(([0], np.cumsum(ascii_[data])))
            letters = seen[offsets[1:]] > seen[offsets[:-1]]
            for i in np.flatnonzero(~letters).tolist():
                letters[i] = has_letter(text[i].as_py())
            best = share.argmax(axis=1)
            known = letters & bool(model.langs)
            score = np.where(known, share[np.arange(rows), best], 0.0)
            pred = [model.langs[i] if k else UNKNOWN for i, k in zip(best.tolist(), known.tolist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pred, pa.string()), pa.array(score), pa.array(known & (score < CLEAR))], ["doc_id", "lang_pred", "score", "ambiguous"])

    return texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def language_id(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, ambiguous.

    Learns from text and lang of rows whose crc32(doc_id as text) mod 4 is not 2. A text that is null or has no letter is
    ``und`` with score 0, as is every text if there is nothing to learn from. Of one learned language all texts are that one.
    """
    r = identify(docs, fit(docs))
    return r.select("doc_id", held_out(MOD, REST).alias("held_out"), "lang_pred", "score", "ambiguous")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))
