"""Merkle manifests against a plain tree, on odd rows, and with proofs checked one by one."""

import hashlib
import os
import random
import zlib
from urllib.parse import urlparse

from pyspark.sql import functions as F

from siltscope.llm import merkle

from .conftest import ODD


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, text):
    return h(*[field(v) for v in (row.doc_id, row.source, row.lang, row.n_chars, text)])


def climb(level, at, k, other):
    """Root, proof and folded hash of the leaf at ``at``."""
    proof = []
    while len(level) > 1:
        run = range(at // k * k, min(at // k * k + k, len(level)))
        proof += [level[i] for i in run if i != at]
        other = h(*[other if i == at else level[i] for i in run])
        level = [h(*level[i : i + k]) for i in range(0, len(level), k)]
        at //= k
    return level[0], proof, other


def brute(rows, k=3):
    trees = {}
    for r in rows:
        trees.setdefault(r.source, []).append(r)
    keys = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in keys:
        trees[s].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
    subs = [climb([leaf(r, r.text) for r in trees[s]], 0, k, "")[0] for s in keys]
    out = []
    for i, s in enumerate(keys):
        level = [leaf(r, r.text) for r in trees[s]]
        for j, r in enumerate(trees[s]):
            other = r.text
            if r.doc_id is not None and other is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0:
                other = other.replace("\n", "")
            _, p1, f1 = climb(level, j, k, leaf(r, other))
            root, p2, f2 = climb(subs, i, k, f1)
            out.append((r.doc_id, level[j], subs[i], root, h(*p1, *p2), f2, f2 == root))
    return sorted(out, key=repr)


def manifest(df, **more):
    tampers = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    return merkle.manifest(df, F.when(tampers, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")), **more)


def result(df, **more):
    return sorted((tuple(r) for r in manifest(df, **more).collect()), key=repr)


def test_odd_rows(odd):
    rows = odd.select("doc_id", "text", "lang", "source", "n_chars").collect()
    assert result(odd) == brute(rows)
    assert len(rows) == len(ODD) + 1


def test_trees_of_many_sizes_and_repeated_ids(docs):
    rng = random.Random(3)
    rows = []
    for key, n in [(None, 1), ("", 1), ("a", 2), ("b", 3), ("ä", 4), ("Z", 10), ("hot", 900), ("z1", 27), ("z2", 28)]:
        rows += [(rng.randrange(n + 3), f"{rng.randrange(5)}\n{i % 7}", "en", key) for i in range(n)]
    df = docs(*rows)
    got = result(df)
    assert got == brute(df.select("doc_id", "text", "lang", "source", "n_chars").collect())
    assert 0 < sum(r[-1] for r in got) < len(got)
    assert len({r[3] for r in got}) == 1


def test_one_row_one_tree_and_other_fanouts(docs):
    one = docs((8, "a\nb"))
    assert result(one) == brute(one.select("doc_id", "text", "lang", "source", "n_chars").collect())
    tree = docs(*[(i, "x\n") for i in range(50)])
    rows = tree.select("doc_id", "text", "lang", "source", "n_chars").collect()
    for k in (2, 3, 7):
        assert result(tree, fanout=k) == brute(rows, k)


def test_paths_are_laid_out_per_block(docs, monkeypatch):
    """Small blocks: every level above them is copied, results stay."""
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 1)
    df = docs(*[(i, f"{i}\n", "en", f"s{i % 4}") for i in range(200)])
    assert result(df) == brute(df.select("doc_id", "text", "lang", "source", "n_chars").collect())


def test_equal_rows_and_null_ids(docs):
    df = docs(*[(None, "same\n")] * 40, *[(4, "same\n")] * 40)
    assert result(df) == brute(df.select("doc_id", "text", "lang", "source", "n_chars").collect())


def test_empty_table(empty):
    assert manifest(empty).count() == 0


def test_row_limit_is_put_back(docs, spark):
    before = spark.conf.get(merkle.ROW_LIMIT)
    manifest(docs((1, "a"))).count()
    assert spark.conf.get(merkle.ROW_LIMIT) == before


def test_only_the_manifest_stays_stored(docs, monkeypatch):
    tables = []
    keep = merkle.saved
    monkeypatch.setattr(merkle, "saved", lambda df, name: tables.append((name, keep(df, name))) or tables[-1][1])
    assert manifest(docs(*[(i, f"{i}\n", "en", f"s{i % 4}") for i in range(40)])).count() == 40
    left = {name for name, t in tables if any(os.path.exists(urlparse(f).path) for f in t.inputFiles())}
    assert left == {"merkle-manifest"}
