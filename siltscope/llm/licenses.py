"""Licence scans by diagonal voting.

Every run of k words of every text is hashed and joined to the templates' runs (a small fixed table). A match at text word i and
template word j votes for the diagonal i - j; a copied notice gathers votes on one diagonal, an edited one on neighbours, which
are merged. Only votes leave a document. Spans with enough votes are verified word by word on the text.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltscope.llm.common import documents, saved, slices, texts
from siltscope.llm.license_templates import PHRASES, TEMPLATES
from siltscope.llm.words import Words

K = 4
#: diagonals this near belong to one occurrence: so many words may have come or gone between its parts
NEAR = 3
#: share of a template's runs that must vote before a span is verified, and of its words that must be found there
VOTES, FOUND = 0.3, 0.9
#: up to so many spans are broadcast to their texts; beyond it the join shuffles
BROADCAST_SPANS = 500_000

#: words are runs of digits, letters and everything beyond ASCII
_SPLIT = np.ones(256, dtype=bool)
_SPLIT[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def words_of(text: pa.Array) -> Words:
    return Words(text, lower=True, separators=_SPLIT)


def word_list(text: str) -> list[bytes]:
    w = words_of(pa.array([text]))
    return [w.text[a:b].tobytes() for a, b in zip(w.start, w.end)]


def base_places(docs: DataFrame, phrases: dict[str, str]) -> DataFrame:
    """doc_id, key, n_words, n_base, first_word, last_word, base (labels) of every text."""
    wanted = [(word_list(p), label) for p, label in sorted(phrases.items())]
    hashes = [words_of(pa.array([p])).runs(len(ws))[1][0] for (ws, _), p in zip(wanted, sorted(phrases))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            w = words_of(b.column("text"))
            rows = b.num_rows
            places: list[list[int]] = [[] for _ in range(rows)]
            labels: list[set[str]] = [set() for _ in range(rows)]
            for (ws, label), h in zip(wanted, hashes):
                at, run_hash = w.runs(len(ws))
                for i in at[run_hash == h].tolist():
                    if all(w.text[w.start[i + j] : w.end[i + j]].tobytes() == x for j, x in enumerate(ws)):
                        d = int(w.doc[i])
                        places[d].append(i - int(w.first[d]))
                        labels[d].add(label)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("key"), pa.array(w.counts().astype(np.int64)), pa.array([len(p) for p in places], pa.int64()),
                 pa.array([min(p) if p else None for p in places], pa.int64()), pa.array([max(p) if p else None for p in places], pa.int64()),
                 pa.array([sorted(x) for x in labels], pa.list_(pa.string()))],
                ["doc_id", "key", "n_words", "n_base", "first_word", "last_word", "base"],
            )

    return docs.mapInArrow(run, "doc_id long, key long, n_words long, n_base long, first_word long, last_word long, base array<string>")


def word_runs(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, key, at, run): the hash of every run of k words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            w = words_of(b.column("text"))
            at, h = w.runs(k)
            ends = np.searchsorted(at, w.first).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), lists], ["doc_id", "key", "runs"])

    return docs.mapInArrow(run, "doc_id long, key long, runs array<long>").select("doc_id", "key", F.posexplode("runs").alias("at", "run"))


def votes(runs: DataFrame, templates: Sequence[tuple[str, str]], k: int) -> DataFrame:
    """Merged diagonals with enough votes: doc_id, key, template, low, high (diagonals), votes."""
    spark = runs.sparkSession
    rows, least = [], []
    for t, (_, text) in enumerate(templates):
        _, h = words_of(pa.array([text])).runs(k)
        rows += [(t, j, int(x)) for j, x in enumerate(h.view(np.int64).tolist())]
        least.append((t, max(1, int(np.ceil(VOTES * len(h))))))
    table = F.broadcast(spark.createDataFrame(rows, "template int, place int, run long"))  # the templates' words
    d = runs.join(table, "run").groupBy("doc_id", "key", "template", (F.col("at") - F.col("place")).alias("diagonal")).agg(F.count("*").alias("votes"))
    w = Window.partitionBy("doc_id", "key", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(w) > NEAR).cast("int")
    merged = d.withColumn("span", F.sum(F.coalesce(apart, F.lit(0))).over(w)).groupBy("doc_id", "key", "template", "span").agg(F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.sum("votes").alias("votes"))
    enough = F.broadcast(spark.createDataFrame(least, "template int, least int"))
    return merged.join(enough, "template").filter("votes >= least").select("doc_id", "key", "template", "low", "high", "votes")


def found_share(template: list[bytes], span: list[bytes]) -> float:
    """Share of the template's words that stand in the span in their order, cut by words put between them."""
    m = difflib.SequenceMatcher(None, template, span, autojunk=False).get_matching_blocks()
    blocks = [x for x in m if x.size]
    if not blocks:
        return 0.0
    found = sum(x.size for x in blocks)
    between = blocks[-1].b + blocks[-1].size - blocks[0].b - found
    return max(0.0, (found - between) / len(template))


def best_of(hits: list[dict]) -> list[dict]:
    """Hits that no better one overlaps: one notice is not read as its near relatives too. In order of place and label."""
    kept: list[dict] = []
    for h in sorted(hits, key=lambda h: (-h["share"], h["word"], h["label"])):
        if not any(k["share"] > h["share"] and h["word"] < k["end"] and k["word"] < h["end"] for k in kept):
            kept.append(h)
    return sorted(({c: h[c] for c in ("label", "word", "share")} for h in kept), key=lambda h: (h["word"], h["label"]))


def verified(docs: DataFrame, spans: DataFrame, templates: Sequence[tuple[str, str]]) -> DataFrame:
    """doc_id, key, found (labels), best (the largest share), hits (label, first word, share) of documents with a verified span."""
    per_doc = spans.groupBy("doc_id", "key").agg(F.collect_list(F.struct("template", "low", "high")).alias("spans"))
    few = spans.count() <= BROADCAST_SPANS
    per_doc = per_doc.withColumnsRenamed({"doc_id": "s_id", "key": "s_key"})
    j = docs.join(F.broadcast(per_doc) if few else per_doc, docs.doc_id.eqNullSafe(F.col("s_id")) & (docs.key == F.col("s_key"))).select("doc_id", "key", "text", "spans")
    known = [(label, word_list(text)) for label, text in templates]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for doc_id, key, text, spans_ in zip(*(b.column(c).to_pylist() for c in ("doc_id", "key", "text", "spans"))):
                ws = word_list(text)
                hits = []
                for s in spans_:
                    label, t = known[s["template"]]
                    a = max(0, s["low"])
                    share = found_share(t, ws[a : max(0, s["high"]) + len(t)])
                    if share >= FOUND:
                        hits.append({"label": label, "word": a, "share": share, "end": a + len(t)})
                hits = best_of(hits)
                if hits:
                    out.append((doc_id, key, sorted({h["label"] for h in hits}), max(h["share"] for h in hits), hits))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("share", pa.float64())]))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], ["doc_id", "key", "found", "best", "hits"])

    return j.mapInArrow(run, "doc_id long, key long, found array<string>, best double, hits array<struct<label: string, word: bigint, share: double>>")


def license_scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, k: int = K) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, hits.

    Null and empty texts have no words and no labels. ``score`` is 1 where a base phrase stands, else the best verified share of a
    template, else 0; ``hits`` are the verified spans. Repeated rows get the same values, rows without a doc_id too.
    """
    t = texts(docs, F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    v = saved(verified(t, saved(votes(word_runs(t, k), templates, k), "votes"), templates).dropDuplicates(["doc_id", "key"]), "licence-spans")
    v = v.withColumnsRenamed({"doc_id": "v_id", "key": "v_key"})
    b = base_places(t, phrases)
    r = b.join(v, b.doc_id.eqNullSafe(v.v_id) & (b.key == v.v_key), "left")
    both = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    return r.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        F.coalesce("hits", F.array().cast("array<struct<label: string, word: bigint, share: double>>")).alias("hits"),
    )


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))
