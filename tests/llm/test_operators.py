"""Operators against brute force, round trips and held-out accuracy, and on odd input."""

import collections
import hashlib
import math
import random
import re
import string
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltscope.llm import brown, components, cuckoo, exact_dedup, jaccard_join, language_id, licenses, packing, quality, sentencepiece_scan, sketch, substring_dedup, tokens, toxicity, words
from siltscope.llm.queries import ORACLES, QUERIES, byte_bpe

from .conftest import LONG, ODD

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
TEXTS = {**{i: t or "" for i, t in ODD if i is not None}, 10: "null columns"}


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"v{rng.randrange(vocabulary)}" for _ in range(n))


# --- words, cuckoo filter, sketch, components ---------------------------------------------------

def test_words_are_runs_of_other_than_blanks():
    texts = ["a  b\tc", "", "x", "\x0b\x0c\r\n", "é A b C"]
    w = words.Words(pa.array(texts))
    assert [w.data[a:b].tobytes().decode() for a, b in zip(w.start, w.end)] == [x for t in texts for x in split(t)]
    assert w.counts().tolist() == [len(split(t)) for t in texts]
    low = words.Words(pa.array(["A b", "a B"]), lower=True)
    assert low.hash[0] == low.hash[2] and low.hash[1] == low.hash[3]


def test_runs_are_equal_where_words_are():
    w = words.Words(pa.array(["a b c d", "x a\n b  c", "b c"]))
    at, h = w.runs(3)
    seen = {}
    for i, x in zip(at.tolist(), h.tolist()):
        seen.setdefault(x, set()).add(tuple(w.data[w.start[j] : w.end[j]].tobytes() for j in range(i, i + 3)))
    assert all(len(v) == 1 for v in seen.values()) and len(seen) == 3
    assert words.sliding_min(np.array([5, 1, 4, 9, 2, 7]), 3).tolist() == [1, 1, 2, 2]


def test_cuckoo_filter_inserts_deletes_and_grows():
    f = cuckoo.CuckooFilter(4)
    keys = [random.Random(1).getrandbits(64) for _ in range(1)] + [hash(i) * 0x9E3779B97F4A7C15 & cuckoo.MASK for i in range(5000)]
    for k in keys:
        f.insert(k)
    assert f.grown > 0 and all(k in f for k in keys)
    for k in keys[:2500]:
        assert f.delete(k)
    assert not f.delete(12345) and all(k in f for k in keys[2500:])
    assert sum(k in f for k in keys[:2500]) < 50 and len(f) == len(keys) - 2500


def test_bucket_verifies_hits_and_withdraws():
    b = exact_dedup.Bucket(4)
    b.add(5, "s1", 3, 10, 2)
    b.add(5, "s2", 3, 11, 1)  # the same digest, another content
    b.add(5, "s1", 3, 12, 1)
    assert b.content[5] == [["s1", 3, 12, 3], ["s2", 3, 11, 1]] and b.false_hits == 1
    assert b.remove(5, "s1", 3) and not b.remove(5, "s1", 3) and 5 in b.filter
    assert b.remove(5, "s2", 3) and 5 not in b.filter


def test_sketch_overestimates_and_merges():
    rng = np.random.default_rng(3)
    keys = words.mix(rng.integers(0, 500, 3000).astype(np.uint64))
    a, b = sketch.CountMin(10), sketch.CountMin(10)
    a.add(keys[:1500])
    b.add(keys[1500:])
    by = collections.defaultdict(list)
    for i, p in a.pieces() + b.pieces():
        by[i].append(p)
    m = sketch.CountMin.of(10, [(i, sketch.CountMin.merge(ps)) for i, ps in by.items()])
    one, n = np.unique(keys, return_counts=True)
    assert (m.count(one) >= np.minimum(n, sketch.TOP)).all()


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(10, 60)] + [(5, 100), (100, 101), (7, 7)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 10 for i in range(10, 61)}, 5: 5, 100: 5, 101: 5}


# --- 1 packing -------------------------------------------------------------------------------------

def test_ids_are_those_of_the_tokenizer():
    enc = tokens.Encoder(byte_bpe())
    rng = random.Random(5)
    alphabet = ["a", "Zq", " ", "  ", "\n", "\t", ".", ",", "'s", "'", "7", "é", " ", "日", "\r\n", "x,y", " ", "<|endoftext|>", "🙂"]
    texts = [t for t in TEXTS.values() if len(t) < 10_000] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(400)]
    assert enc.by_unit
    for t, a, b in zip(texts, enc.encode(pa.array(texts)), enc.whole(texts)):
        assert a.tolist() == b.tolist(), repr(t)


def brute_pieces(text, enc, capacity):
    ids = [*enc.whole([text])[0].tolist(), 2]
    first = len(ids) % capacity or capacity
    cuts = [0, *range(first, len(ids) + 1, capacity)]
    return [(i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def test_packing_is_whole_and_tight(odd, docs):
    rng = random.Random(2)
    more = docs(*[(100 + i, prose(rng, rng.randrange(1, 90))) for i in range(150)])
    rows = packing.pack(odd.unionByName(more), byte_bpe(), capacity=64).collect()
    enc = tokens.Encoder(byte_bpe())
    texts = [(i, t or "") for i, t in ODD] + [(10, "null columns")] + [(r.doc_id, r.text) for r in more.collect()]
    want = collections.Counter((i, *p) for i, t in texts for p in brute_pieces(t, enc, 64))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    least = -(-sum(r.length for r in rows) // 64)
    assert least <= len(bins) <= least + 2


def test_swaps_empty_a_bin():
    # best fit leaves three bins, an exchange frees one
    bins = {(6, 3): 1, (5, 3): 1, (2,): 1, (1,): 1}
    out = packing.local_search(bins, 10)
    assert sum(sum(h) * n for h, n in out.items()) == 20 and sum(out.values()) == 2
    rng = random.Random(4)
    for _ in range(20):
        counts = collections.Counter(rng.randrange(1, 101) for _ in range(300))
        fit = packing.best_fit(counts, 100)
        got = packing.local_search(fit, 100)
        for b in (fit, got):
            assert all(sum(h) <= 100 for h in b)
            assert collections.Counter(x for h, n in b.items() for x in h * n) == counts
        assert sum(got.values()) <= sum(fit.values())


def test_search_tries_every_underfull_class():
    # 900 bins that nothing can move between, and in the middle of them by fill one whose 500 another takes, which frees a bin
    bins = {(size,): 1 for size in range(1501, 2401)} | {(1450, 500): 1}
    out = packing.local_search(bins, 3000)
    assert sum(out.values()) == 900
    assert sorted(x for h, n in out.items() for x in h * n) == sorted(x for h in bins for x in h)
    # what is left has no exchange that gains
    rng = random.Random(9)
    out = packing.local_search(packing.best_fit(collections.Counter(rng.randrange(300, 1000) for _ in range(900)), 1000), 1000)
    under = [h for h in out if sum(h) < 1000]
    assert all(packing._gain(a, b, 1000)[0] == 0 for a in under for b in under if a != b or out[a] > 1)


def test_packing_nothing(empty):
    assert packing.pack(empty, byte_bpe()).collect() == []


# --- 2 toxicity ------------------------------------------------------------------------------------

def toxic_set(docs, spark, n=400):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        sentences = [prose(rng, rng.randrange(4, 12)) for _ in range(rng.randrange(2, 9))]
        y = int(rng.random() < 0.4)
        if y:
            sentences.insert(rng.randrange(len(sentences) + 1), f"you {rng.choice(['zorgish', 'zorgial', 'blurk'])} thing")
        rows.append((i, ". ".join(sentences) + "."))
        labels.append((i, 1, y))
    return docs(*rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict(rows), {i: y for i, _, y in labels}


def test_toxicity_generalises_and_finds_the_sentence(docs, spark):
    d, labels, texts, y = toxic_set(docs, spark)
    rows = toxicity.toxicity(d, labels).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in y if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r.predicted == y[r.doc_id] for r in held) >= 0.97 * len(held)
    found = [texts[r.doc_id][s.start : s.end] for r in held if y[r.doc_id] for s in r.spans]
    assert found and sum(bool(re.search("zorg|blurk", f)) for f in found) >= 0.97 * len(found)


def test_held_out_labels_change_nothing(docs, spark):
    d, labels, _, _ = toxic_set(docs, spark, 150)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity.toxicity(d, x).collect()} for x in (labels, flipped))
    assert a == b


def test_toxicity_on_odd_input(odd, empty, spark):
    labels = spark.createDataFrame([(4, 1, 1), (5, 1, 0), (None, None, 1), (6, None, None), (4, 0, 0), (8, 1, 5)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(odd, labels).collect()
    assert len(rows) == len(ODD) + 1 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.toxicity(empty, labels).collect() == []
    assert len(toxicity.toxicity(odd, labels.limit(0)).collect()) == len(ODD) + 1
    kept = toxicity.without_toxic(odd, labels)
    assert kept.columns == odd.columns and kept.count() == len(ODD) + 1


# --- 3 SentencePiece ---------------------------------------------------------------------------------

def test_chunked_encoding_is_the_best_path_and_decodes(odd, docs):
    model = sentencepiece_scan.piece_bpe()
    lat = sentencepiece_scan.Lattice(model)
    rng = random.Random(3)
    more = docs((50, "".join(rng.choice("abcdeftion") for _ in range(900))), (51, " ".join("".join(rng.choice("theranio") for _ in range(5)) for _ in range(300))), (52, "日本" * 200 + " ok"))
    d = odd.filter("doc_id IS NULL OR doc_id NOT IN (5, 9)").unionByName(more)
    enc = sentencepiece_scan.encode(d, model, giant=100, chunk=70)
    rows = sentencepiece_scan.decode(enc, model).collect()
    texts = collections.Counter((r.doc_id, r.text or "") for r in d.collect())
    assert collections.Counter((r.doc_id, r.text) for r in rows) == texts
    assert max(r.n_chunks for r in rows) > 5
    for r in rows:
        z = sentencepiece_scan.marked(r.text)
        best = lat.forward(z, 0, len(z))[0][-1]
        assert math.isclose(r.score, best, rel_tol=1e-9) and r.n_tokens * 4 == len(r.ids)
    assert sentencepiece_scan.encode(d.limit(0), model).collect() == []


def test_max_plus_products_are_associative():
    rng = np.random.default_rng(1)
    m = [rng.normal(size=(4, 4)) for _ in range(6)]
    left = m[0]
    for x in m[1:]:
        left = sentencepiece_scan.product(left, x)
    assert np.allclose(sentencepiece_scan.running(m)[-1], left)


# --- 4 licences ----------------------------------------------------------------------------------------

def test_brown_scores_runs_of_whole_documents():
    sizes = np.array([3, 250, 2, 2, 1, 4, 4, 1], dtype=np.int32)
    n = int(sizes.sum())
    got = list(brown.by_documents(np.arange(8), np.zeros(8, np.uint8), sizes, np.arange(n), np.arange(n) * 2, limit=5))
    assert [g[2].tolist() for g in got] == [[3], [250], [2, 2, 1], [4], [4, 1]]
    assert np.concatenate([g[0] for g in got]).tolist() == list(range(8)) and all(len(g[3]) == len(g[4]) == g[2].sum() for g in got)
    assert np.concatenate([g[3] for g in got]).tolist() == list(range(n))


def test_sentencepiece_runs_of_letters_are_remembered_once():
    lat = sentencepiece_scan.Lattice(sentencepiece_scan.piece_bpe())
    text = " ".join(f"bortelun{x}" for x in ("", ",", ".", "!!", "%%%", ".\nÜber", "²."))
    z = sentencepiece_scan.marked(text)
    ids, score = lat.solve(z)
    best, back = lat.forward(z, 0, len(z))
    assert ids == lat.ids_between(z, back, 0, len(z)) and score == best[-1]
    assert [u for u in lat.units if "bortelun" in u] == ["▁bortelun"]
    lat.cut_at_letters, lat.units = False, {}
    assert lat.solve(z) == (ids, score)


def license_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_scan(odd, docs):
    gpl = next(t for label, t in licenses.TEMPLATES if label == "gpl-3" and t.startswith("it under"))
    edited = gpl.replace("Free Software Foundation", "Free Old Software Foundation")
    rows = [(20, "x Released under the MIT License. y under THE mit-license"), (21, "head " * 30 + edited + " tail"), (22, "under the mit"), (23, "Licensed under CC BY-NC 4.0"), (24, "general public matters"), (25, LONG + " Apache License, version 2")]
    d = odd.unionByName(docs(*rows))
    got = licenses.license_scan(d).collect()
    texts = collections.Counter((r.doc_id, *license_base(r.text)) for r in d.collect())
    assert collections.Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == texts
    by = {r.doc_id: r for r in got}
    assert by[20].labels == "mit" and by[21].labels == "gpl-3" and by[21].base_labels == "" and 0.9 <= by[21].score < 1
    assert by[22].labels == "" and by[23].labels == "cc-by-nc" and by[24].score == 0 and by[25].labels == "apache-2"
    assert abs(by[21].hits[0].word - 30) <= licenses.NEAR
    assert licenses.license_scan(d.limit(0)).collect() == []


def test_license_headers_of_one_family_are_told_apart(docs):
    header = "x it under the terms of the GNU {}General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version. y"
    kinds = [("gpl-2", "", "2"), ("gpl-3", "", "3"), ("lgpl-2.1", "Lesser ", "2.1"), ("lgpl-3", "Lesser ", "3"), ("agpl-3", "Affero ", "3")]
    got = licenses.license_scan(docs(*[(i, header.format(family, version)) for i, (_, family, version) in enumerate(kinds)])).collect()
    assert {r.doc_id: (r.labels, r.score) for r in got} == {i: (label, 1.0) for i, (label, _, _) in enumerate(kinds)}


# --- 5 language model --------------------------------------------------------------------------------------

def test_brown_scores(odd, docs):
    rng = random.Random(6)
    more = docs(*[(100 + i, " ".join(f"{'ab'[(i + j) % 2]}{rng.randrange(25)}" for j in range(rng.randrange(5, 60)))) for i in range(200)])
    d = odd.unionByName(more)
    rows = brown.class_scores(d, vocabulary=40, classes=6).collect()
    docs_ = [(r.doc_id, (r.text or "").translate(LOWER)) for r in d.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter()
    for i, t in docs_:
        if not held(i):
            c.update([*split(t), None])
    n, v = sum(c.values()), len(c)
    want = collections.defaultdict(list)
    for i, t in docs_:
        tok = [*split(t), None]
        want[i].append((held(i), len(tok), sum(c[x] > 0 for x in tok), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tok)))
    for r in rows:
        assert any(math.isclose(r.base_score, w[4], rel_tol=1e-9) and (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] for w in want[r.doc_id])
    assert len(rows) == len(docs_) and all(r.score < 0 for r in rows)
    new = [r for r in rows if r.held_out and r.doc_id >= 100]
    assert sum(r.score for r in new) > sum(r.base_score for r in new)  # words of two kinds alternate
    assert brown.class_scores(d.limit(0)).collect() == []


def test_sketch_leaves_a_task_in_small_batches():
    s = sketch.CountMin(22)
    s.add(words.mix(np.arange(1, 40_000, dtype=np.uint64)))
    batches = list(s.batches())
    assert len(batches) > 2 and max(sum(len(x) for _, x in b) for b in batches) <= 1 << 20
    assert (sketch.CountMin.of(22, [p for b in batches for p in b]).table == s.table).all()


def test_brown_words_settle_as_gains_say_one_by_one():
    rng = np.random.default_rng(5)
    k, c, n = 6, 6 + 1 + brown.BANDS, 300
    a = np.floor(rng.exponential(300, (c, c)))
    total = np.zeros((n, 2 * c + 1))
    of = rng.integers(0, k, n)
    for w in range(n):
        places, sizes = rng.integers(0, 2 * c, 1 + w % 12), rng.integers(1, 9, 1 + w % 12)
        np.add.at(total[w], places, sizes)
        total[w, -1] = min(total[w, of[w]], total[w, c + of[w]])
    m, want = a.copy(), of.copy()
    for w in range(n):
        old, r, l, s = want[w], total[w, :c].copy(), total[w, c : 2 * c].copy(), total[w, -1]
        m[old] -= r
        m[:, old] -= l
        m[old, old] += s
        r[old] -= s
        l[old] -= s
        gain = brown.gains(m, r, l, s, k)
        new = int(gain.argmax()) if gain.max() > gain[old] + 1e-9 else old
        m[new] += r
        m[:, new] += l
        m[new, new] += s
        want[w] = new
    got = brown.settled(a, total, of, k)
    assert (got == want).all() and (want != of).sum() > 50


def test_brown_clusters_words_beyond_the_seed(docs):
    rng = random.Random(8)
    is_held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    train = iter(i for i in range(10**6) if not is_held(i))
    hot = [(next(train), " ".join(f"{'ab'[j % 2]}{(i + j) % 500}" for j in range(1000))) for i in range(20)]
    rare = [(next(train), " ".join(f"{'cd'[j % 2]}{rng.randrange(60)}" for j in range(20))) for _ in range(60)]
    c, d = [f"c{i}" for i in range(60)], [f"d{i}" for i in range(60)]
    one, two = [i for i in range(100) if is_held(i)][:2]
    new = [(one, " ".join(x for p in zip(c, d) for x in p)), (two, " ".join([*c, *d]))]
    by = {r.doc_id: r for r in brown.class_scores(docs(*hot, *rare, *new)).collect()}
    assert by[one].n_known == by[two].n_known and math.isclose(by[one].base_score, by[two].base_score)
    assert by[one].score > by[two].score + 20


def test_class_model_sums_to_one(docs):
    rng = np.random.default_rng(2)
    t, s = 12, 12 + 1 + brown.BANDS
    m = rng.integers(0, 30, (s, s))
    m[t + 1], m[:, t + 1] = 0, 0  # nothing unseen in training
    top = m[:, :t].sum(axis=0).astype(float)
    once = [0, 7, 5, 3, 2, 4]
    x = brown.model(m, int(m.sum()), 40, once, top, 4, 3)
    assert np.allclose(x.step.sum(axis=1), 1)
    total = np.zeros(int(x.of.max()) + 1)
    np.add.at(total, x.of[:t], x.emit[:t])
    assert np.allclose(total[: int(x.of[:t].max()) + 1], 1)
    for r in range(1, 5):
        assert math.isclose(x.emit[t + 1 + r] * once[r], 1)


def test_exchange_finds_alternating_classes():
    m = np.zeros((9, 9))
    m[:4, 4:8], m[4:8, :4], m[8, :4], m[4:8, 8] = 50, 50, 10, 10
    m[:8, :8] += np.random.default_rng(1).integers(0, 9, (8, 8))
    of = brown.exchange(m, 8, 2, 8)
    assert len(set(of[:4])) == len(set(of[4:8])) == 1 and of[0] != of[4] and of[8] == 2


# --- 6 language ----------------------------------------------------------------------------------------------

def test_codewords_lie_apart():
    for k in (2, 3, 5, 9, 20):
        code = language_id.codewords(k)
        assert set(np.unique(code)) <= {-1.0, 1.0} and all((code[i] != code[j]).any() for i in range(k) for j in range(i))
        assert all((c != c[0]).any() for c in code.T)


def test_language_of_held_out_texts(docs, odd, empty):
    rng = random.Random(7)
    kinds = {"aa": "theringonst", "bb": "schungeitpf", "cc": "éèquoiment"}
    rows = []
    for i in range(240):
        lang = list(kinds)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(kinds[lang]) for _ in range(rng.randrange(3, 8))) for _ in range(rng.randrange(4, 60))), lang, "s"))
    d = docs(*rows, (900, None, "aa", "s"), (901, "12 34 !?", "aa", "s"), (902, "thering onst", None, "s"))
    got = {r.doc_id: r for r in language_id.language_id(d).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.97 * len(held) and all(got[r[0]].held_out for r in held)
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[900].score == 0 and got[902].lang_pred == "aa"
    one = language_id.language_id(odd).collect()
    assert {r.lang_pred for r in one} == {"en", "und"} and all(0 <= r.score <= 1 for r in one)
    assert language_id.language_id(empty).collect() == []
    assert {r.lang_pred for r in language_id.language_id(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# --- 7 Jaccard join ----------------------------------------------------------------------------------------------

def shingles(t):
    w = [x for x in split((t or "").translate(LOWER))]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                up[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return collections.Counter((doc, len(s), least[find(i)]) for i, (doc, s) in enumerate(sets))


def near_copies(seed, bases=6, copies=14):
    rng = random.Random(seed)
    rows, i = [], 0
    common = prose(rng, 12)
    for _ in range(bases):
        base = prose(rng, rng.choice([3, 5, 6, 9, 12, 30, 80, 200])).split()
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 18 + 2))):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], [w[at], f"n{rng.randrange(50)}"], [f"n{rng.randrange(10**6)}"], [w[at].upper()]])
            rows.append((i, " ".join(w) + (" " + common if rng.random() < 0.3 else "")))
            i += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,limit", [(1, None), (3, 0), (4, 14)])
def test_jaccard_join_is_exact(docs, seed, limit):
    rows = near_copies(seed)
    got = jaccard_join.jaccard_join(docs(*rows), limit=limit).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)


def test_jaccard_join_tells_texts_of_one_id_apart(docs):
    rng = random.Random(12)
    rows = []
    for ids in ((7, None), (9, None), (11, 20), (13, 20), (None, None), (20, 30)):
        base = prose(rng, 12)
        rows += [(ids[0], base), (ids[1], base + " tail")]
    rows += [rows[1], rows[5]]
    last = jaccard_join.LAST
    want = collections.Counter({tuple(None if x == last else x for x in r): c for r, c in brute_components([(last if i is None else i, t) for i, t in rows]).items()})
    got = jaccard_join.jaccard_join(docs(*rows)).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert {r.component_id for r in got if r.doc_id == 9} == {9}


def test_jaccard_join_on_odd_input(odd, empty):
    got = jaccard_join.jaccard_join(odd).collect()
    assert len(got) == len(ODD) + 1
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.n_shingles, r.component_id))
    assert by[1] == {(0, 1)} and by[2] == {(0, 2)} and by[3] == {(0, 3)} and by[4] == {(1, 4)} and by[8] == {(1, 8)}
    assert by[None] == {(1, 4), (0, None)} and {c for _, c in by[5] | by[9]} == {5}
    assert jaccard_join.jaccard_join(empty).collect() == []


# --- 8 exact dedup, 9 quality, 10 substring dedup: SQL is the oracle; here odd input ---------------------------------

def test_exact_dedup_on_odd_input(odd, empty, docs):
    got = exact_dedup.exact_dedup(odd).collect()
    rows = [(i, t or "") for i, t in ODD] + [(10, "null columns")]
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    want = collections.Counter()
    for i, t in rows:
        ids = [x for x in groups[t] if x is not None]
        keep = max(ids, default=None)
        want[(i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest())] += 1
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want
    assert exact_dedup.exact_dedup(empty).collect() == []


def test_index_forgets_withdrawn_contents(docs):
    t = docs((1, "a"), (2, "a"), (3, "b")).select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("long").alias("n_bytes"), F.xxhash64("text").alias("digest"), F.lit(0).alias("part"))
    a = exact_dedup.arrivals(t, 4)
    live = exact_dedup.live(a, a.filter("doc_id = 2").select("bucket", "digest", "text_sha256", "n_bytes")).collect()
    assert [(r.keep_id, r.group_size) for r in live] == [(3, 1)]


def brute_repeat(w):
    seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    return len({i + k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(5)})


def test_quality_counts(odd, empty, docs):
    more = docs((30, "a b c d e a b c d e f g"), (31, "the " * 40), (32, "# x\ny\n# x\n\n y\ny\n"), (33, "a b c d e f\n" * 3 + "$|<>"))
    d = odd.unionByName(more)
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.line_rules(d).collect())
    want = collections.Counter()
    for r in d.collect():
        t = r.text or ""
        w, lines = split(t), [x for x in t.split("\n") if split(x)]
        rep = brute_repeat(w)
        want[(r.doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), rep, len(w) < 10 or 100 * rep > 20 * len(w))] += 1
    assert got == want
    assert quality.line_rules(empty).collect() == []


def test_lines_of_many_documents_of_a_host_go(docs):
    rng = random.Random(9)
    own = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(30))
    rows = [(i, f"Shared  footer {i} line of the site\n{own()}", "en", "h") for i in range(30)]
    rows += [(100 + i, "shared footer 7 line of the site\nshared footer line of all and more words here " + "x", "en", "h") for i in range(30)]
    rows += [(300, "Shared footer 1 line of the site\n" + own(), "en", "other")]
    got = {r.doc_id: r for r in quality.line_rules(docs(*rows), line_docs=20).collect()}
    assert all(got[i].n_line_words == 7 and got[i].kept for i in range(30))
    assert all(not got[100 + i].kept and not got[100 + i].base_failed for i in range(30))
    assert got[300].n_line_words == 0 and got[300].kept


def brute_substring(rows, window):
    first = {}
    for i, t in rows:
        w = split(t)
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(first.get(g, i), i)
    out = {}
    for i, t in rows:
        w = split(t)
        gone = {k + j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for j in range(window)}
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize("window,bits", [(50, None), (10, 17), (6, 4)])
def test_substring_dedup_is_exact(docs, window, bits):
    rng = random.Random(window)
    passages = [prose(rng, n) for n in (5, 10, 49, 50, 51, 70, 120)]
    rows = [(i, "  ".join(rng.choice([prose(rng, rng.randrange(40)), rng.choice(passages)]) for _ in range(rng.randrange(6)))) for i in range(60)]
    rows += [(100, "The " * 200), (101, "x " + "The " * 120), (102, rows[3][1])]
    got = substring_dedup.remove_repeats(docs(*rows), window=window, bits=bits).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == brute_substring(rows, window)


def test_substring_dedup_on_odd_input(odd, empty):
    got = substring_dedup.remove_repeats(odd).collect()
    assert len(got) == len(ODD) + 1
    by = {r.doc_id: r for r in got}
    assert by[9].n_removed == len(split(LONG)) and by[9].kept_text == "tail" and by[5].n_removed == 0 and by[1].n_words == 0
    assert substring_dedup.remove_repeats(empty).collect() == []
    kept = substring_dedup.without_repeats(odd)
    assert kept.columns == odd.columns
    texts = {r.doc_id: (r.text, r.n_chars) for r in kept.collect()}
    assert texts[9] == ("tail", 4) and texts[6][0] == dict(ODD)[6]


# --- queries -----------------------------------------------------------------------------------------------------------

def test_ten_operators_are_registered():
    assert sorted({int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES}) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)


def test_jaccard_join_leaves_few_candidates_of_one_large_group(docs, monkeypatch):
    """Copies of one text, each with one or two words changed: hubs join them, so pairs do not grow with the group's square."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(150)]

    def copy(i):
        words_ = list(base)
        for at in rng.sample(range(len(base)), 1 + i % 2):
            words_[at] = f"c{i}at{at}"
        return " ".join(words_)

    n = 800
    counted, light_heavy = [], jaccard_join.light_heavy

    def counting(active, limit):
        pairs = light_heavy(active, limit)
        counted.append((active.count(), pairs.count()))
        return pairs

    monkeypatch.setattr(jaccard_join, "light_heavy", counting)
    got = jaccard_join.jaccard_join(docs(*[(i, copy(i)) for i in range(n)])).collect()
    assert len(got) == n and {r.component_id for r in got} == {0}
    assert counted[0][0] == n and counted[0][1] <= n


def test_jaccard_join_min_hashes_have_salts_of_their_own(spark):
    """A min-hash depends on the token and its salt, not on the token's place in a set's order."""
    rows = [(0, 3, [5, 6, 7]), (1, 4, [5, 6, 7, 8]), (2, 3, [8, 9, 5]), (3, 3, [9, 5, 6])]
    sets = spark.createDataFrame(rows, "sid long, n int, tokens array<long>")
    got = {r.sid: r.mins for r in jaccard_join.rarest(sets).collect()}
    df = collections.Counter(t for _, _, ts in rows for t in ts)
    tok = sets.select("sid", F.explode("tokens").alias("t"))
    for j in range(jaccard_join.HASHES * jaccard_join.ROUNDS):
        least = {}
        for r in tok.select("sid", "t", F.xxhash64("t", F.lit(j)).alias("h")).collect():
            if df[r.t] > 1:
                least[r.sid] = min(least.get(r.sid, r.h), r.h)
        assert {s: m[j] for s, m in got.items()} == {s: least[s] for s in got}
    assert len(set(got[1])) > 1
