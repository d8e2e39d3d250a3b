"""Fill-in-the-middle against plain slicing of regex tokens, and what the chunk cache shares."""

import hashlib
import random
import re

from siltscope.llm import fill_middle as fm

from .conftest import LONG, ODD

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def brute(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    h1, h2, h3, h4 = fm.seeds(doc_id)
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (doc_id, len(tokens), "plain", None, None, sha(text), sha(text))
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return (doc_id, len(tokens), form, len(p), len(m), sha(out), sha(text))


def texts(rng, n):
    pieces = ["word", " ", "\n", "  \t", "é日本", "\x0b\x0c\r", "😀", "x" * 300, " ", "\x1f", "a<", "S>", "<P", "\x00"]
    for _ in range(n):
        yield "".join(rng.choice(pieces) for _ in range(rng.choice([0, 1, 2, 5, 40, 3000])))


def test_counts_and_every_cut():
    rng = random.Random(5)
    cache = fm.Summaries()
    for t in [*texts(rng, 60), "x" * 30_000, " " * 30_000, "ab " * 9000, "é" * 20_000 + " end "]:
        tokens = TOKEN.findall(t)
        c = fm.Counted(t.encode(), cache)
        assert c.n == len(tokens)
        ks = range(len(tokens) + 1) if len(tokens) < 50 else rng.sample(range(len(tokens) + 1), 50)
        for k in ks:
            p = "".join(tokens[:k])
            assert c.cut(k) == (len(p.encode()), len(p)), (k, len(tokens))


def test_documents_against_brute_force(docs, odd, spark):
    rng = random.Random(6)
    rows = [(i, t) for i, t in enumerate(texts(rng, 150))] + [(-3, "neg ative"), (2**60, "large id "), (500, "has <P> mark"), (501, "has <M>"), (502, "<S>")]
    columns = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    got = sorted((tuple(r) for r in fm.fill_middle(docs(*rows), with_output=False).select(columns).collect()), key=repr)
    assert got == sorted((brute(*r) for r in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    key = lambda r: repr(r)
    assert sorted((tuple(r) for r in fm.fill_middle(odd).select(columns).filter("doc_id is not null").collect()), key=key) == sorted(
        (brute(i, t) for i, t in [*ODD, (10, "null columns")] if i is not None), key=key
    )


def test_output_gives_the_text_back(odd):
    for r in fm.fill_middle(odd).collect():
        assert sha(r.output) == r.output_sha256
        assert sha(fm.restored(r.output.encode(), r.form).decode()) == r.restored_sha256


def test_missing_id_has_its_own_seed(docs):
    rows = fm.fill_middle(docs((None, "a b c"))).collect()
    assert [r.doc_id for r in rows] == [None] and rows[0].restored_sha256 == sha("a b c")


def test_empty_table(empty):
    assert fm.fill_middle(empty).count() == 0


def test_shared_passages_are_scanned_once():
    cache = fm.Summaries()
    fm.Counted(LONG.encode(), cache)
    first = cache.scanned
    c = fm.Counted(("some other beginning " + LONG).encode(), cache)
    assert c.n == len(LONG.split()) + 3
    assert first > 100 and cache.scanned - first < 5 and cache.shared > first - 5


def test_chunks_depend_on_content_in_segments(monkeypatch):
    data = LONG.encode()
    whole = fm.chunk_ends(data)
    monkeypatch.setattr(fm, "SEGMENT", 1000)
    assert fm.chunk_ends(data) == whole and whole[-1] == len(data)


def test_cache_is_bounded():
    cache = fm.Summaries(limit=5000)
    rng = random.Random(7)
    for _ in range(50):
        fm.Counted(bytes(rng.randrange(97, 123) for _ in range(3000)), cache)
        assert cache.held <= 5000 + fm.MOST
