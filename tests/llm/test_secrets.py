"""Secret scans: base patterns against their plain form, novelty against compressing by hand, planted strings and clean texts."""

import hashlib
import random
import re
import string

import zstandard
from pyspark.sql import functions as F

from siltscope.llm import secrets
from siltscope.llm.queries import op12_secret_scan

from .conftest import LONG, ODD

PLAIN = {
    "assign": re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def brute(text):
    text = text or ""
    out = []
    for i, (kind, rule) in enumerate(PLAIN.items()):
        for m in rule.finditer(text):
            if {"assign": lambda: len(m[2]) >= 6, "access": lambda: len(m[0]) >= 20, "hex": lambda: len(m[0]) >= 24}[kind]():
                out.append((m.start(), i, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def base(text):
    low = text.encode().lower()
    return [f"{k}:{s}:{e}" for s, e, k in sorted(secrets.base_spans(text, low), key=lambda x: (x[0], secrets.KINDS.index(x[2])))]


def noise(rng, n):
    pieces = ["password", "PassWD", "secret", "token", "api_key", "ApiKey", "to", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH12", "0123456789abcdef", "ab", "é", "ſecret=abcdefg", "toKen=abcdefg", "\n", "x.y/z+", "secretoken=abcdef"]
    for _ in range(n):
        yield "".join(rng.choice(pieces) for _ in range(rng.randrange(60)))


def test_base_kinds_against_their_plain_patterns():
    rng = random.Random(1)
    for t in noise(rng, 3000):
        assert base(t) == brute(t), t
    assert base("token='abcde'") == [] and base("AKIA" + "A" * 15) == [] and base("a" * 23) == []
    assert base("secretoken=abcdef")[0] == "assign:5:17"


def key(rng, n=32):
    return "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))


def test_marginal_bytes_are_those_of_two_compressions():
    words = b" ".join(sorted({b"connection", b"retry", b"handler", b"configuration", b"timeout", b"request"}))
    n = secrets.Novelty(words)
    text = "auth handler: configuration_timeout or Xk29fLq0ZpTr81Vb in the request"
    whole = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    press = lambda b: len(zstandard.ZstdCompressor(level=3, dict_data=whole, write_content_size=False, write_checksum=False, write_dict_id=False).compress(b))
    for s in ("configuration_timeout", "Xk29fLq0ZpTr81Vb"):
        a = text.index(s)
        context = (text[:a] + text[a + len(s) :] + "\n").encode()
        assert abs(n.of(text, a, a + len(s))[0] - (press(context + s.encode()) - press(context))) <= 1
    a, b = text.index("configuration_timeout"), text.index("Xk29")
    assert n.of(text, a, a + 21)[1] < secrets.NOVELTY < n.of(text, b, b + 16)[1]


def test_planted_strings_are_found_and_clean_texts_left_alone(docs, spark, sf):
    rng = random.Random(2)
    corpus = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() if r.text]
    code = "def open_connection(session, retry_handler):\n    authorization = load_configuration2(session)\n    return connection_pool.request(authorization)\n"
    planted, rows = {}, []
    for i in range(120):
        t = rng.choice(corpus)[:400] + "\n" + code
        if i % 2:
            k = key(rng)
            t += f"client.auth = '{k}'\n" if i % 4 == 1 else f"Authorization: Bearer {k}\n"
            planted[i] = k
        rows.append((i, t + code))
    got = {r.doc_id: r.spans for r in secrets.secret_spans(docs(*rows)).collect()}
    novel = {i: [rows[i][1][s.start : s.end] for s in spans if s.kind == "novel"] for i, spans in got.items()}
    caught = sum(k in novel[i] for i, k in planted.items())
    assert caught >= 0.95 * len(planted)
    assert sum(bool(novel[i]) for i in got if i not in planted) <= 2
    assert all(s.bytes is not None for spans in got.values() for s in spans if s.kind == "novel")


def test_a_string_known_from_the_code_around_is_not_new(docs):
    k = "Qz81kdLw02PfXm47"
    once, twice = f"credential {k}\n", f"x = lookup({k})\ncredential {k}\n"
    got = {r.doc_id: [s.kind for s in r.spans] for r in secrets.secret_spans(docs((1, once), (2, twice)), words=b"").collect()}
    assert got == {1: ["novel"], 2: []}


def test_base_spans_stay_and_novel_ones_do_not_overlap_them(docs):
    rng = random.Random(4)
    texts = list(noise(rng, 200))
    rows = secrets.secret_spans(docs(*enumerate(texts)), words=b"").collect()
    for r in rows:
        assert [f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind != "novel"] == brute(texts[r.doc_id])
        taken = [(s.start, s.end) for s in r.spans if s.kind != "novel"]
        assert all(e <= s.start or a >= s.end for s in r.spans if s.kind == "novel" for a, e in taken)
        assert [s.start for s in r.spans] == sorted(s.start for s in r.spans)


def test_dictionary_counts_documents_and_has_a_size(docs, empty):
    d = docs((1, "alpha alpha alpha beta"), (2, "beta gamma1 once"), (3, "beta alpha delta_x"), (4, None), (5, "gamma1 delta_x"))
    counts = {bytes(r.word): r.n for r in secrets.identifier_counts(d).collect()}
    assert counts[b"alpha"] == 2 and counts[b"beta"] == 3 and counts[b"gamma"] == 2
    assert secrets.dictionary(d) == b"gamma delta_x alpha beta"
    assert secrets.dictionary(d, 12) == b"alpha beta" and secrets.dictionary(empty) == b""


def test_odd_documents(odd, empty):
    rows = secrets.secret_spans(odd).collect()
    assert len(rows) == len(ODD) + 1 and secrets.secret_spans(empty).count() == 0
    assert all(not r.spans for r in rows if r.doc_id in (1, 2, 3))


def test_long_texts_and_long_strings(docs):
    k = key(random.Random(9), 20_000)
    text = LONG + f" bearer {k} " + LONG
    (row,) = secrets.secret_spans(docs((1, text)), words=b"").collect()
    assert [(s.kind, s.start, s.end) for s in row.spans] == [("novel", text.index(k), text.index(k) + 20_000)]


def test_query_digests(spark, sf):
    rows = {r.doc_id: r for r in op12_secret_scan(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        want = brute(r.text)
        got = rows[r.doc_id]
        assert got.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (got.n_assign, got.n_access, got.n_hex) == tuple(sum(s.startswith(k) for s in want) for k in secrets.KINDS[:3])
        assert [s for s in got.spans.split(",") if s and not s.startswith("novel")] == want
    assert op12_secret_scan(spark, sf).filter(F.col("doc_id").isNull()).count() == 0
