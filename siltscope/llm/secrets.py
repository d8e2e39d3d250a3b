"""Secrets in texts: three patterns, and strings in a sensitive context that a primed compressor finds new.

A string that stands shortly after a word such as ``auth`` or ``credential`` is a candidate. Its novelty is what it costs a
zstandard compressor that already knows the corpus' identifiers (a dictionary) and has just seen the text around the string: compressed
bytes of context and string, less those of the context alone, as a share of what a random string of its alphabet needs. Names, paths
and words of the corpus are matches into the dictionary or into the code around; a random key is literals, or codes no shorter than its
alphabet allows. Candidates at ``NOVELTY`` or above are reported as ``novel``.

The identifiers are counted over all documents; the dictionary holds those in most documents, up to ``DICTIONARY_BYTES``, most
frequent last (where matches are cheapest). It is the model of this operator, so its size is a parameter and it is the one thing
that is broadcast. Digits never enter it: a key that is repeated through a corpus doesn't become an identifier.

The patterns' spans are those of whole matches (for ``assign`` keyword and value). Defined results: a null text is empty and has
no spans. An empty table gives no rows. Rows are independent of their copies but for the counts of identifiers, in which a
repeated row counts again. Words in equally many documents enter the dictionary in their order. Extra columns are not read, whatever
their names. Very long texts are scanned whole, one at a time in a worker; a candidate has no greatest length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltscope.llm.common import documents, slices, texts

#: fixed patterns of the base kinds; case is ASCII's
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs of 24 or more are the runs whose shorter ones were dropped
KINDS = ("assign", "access", "hex", "novel")
#: bytes that a text with an assignment or a sensitive word has in it, lower-cased
ASSIGNS = (b"passw", b"secret", b"token", b"key")
SENSITIVE_PARTS = (*ASSIGNS, b"passphrase", b"pwd", b"credential", b"auth", b"bearer", b"signature", b"session")
SENSITIVE = re.compile(r"password|passwd|passphrase|pwd|secret|token|(?:api|access|private|signing)[_ -]?key|credential|auth|bearer|signature|session", re.ASCII | re.IGNORECASE)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
EDGES = "._=-/+"

#: code points between a sensitive word's end and a candidate's start; candidate length; context before and after
NEAR, LEAST, BEFORE, AFTER = 64, 12, 256, 128
#: compressed bits at least, as a share of length * log2(alphabet)
NOVELTY = 0.9
#: a string's alphabet is made of those of these that it uses
ALPHABETS = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+/_.=-")
DICTIONARY_BYTES = 32_768
WORD = re.compile(rb"[A-Za-z_\x80-\xff]{4,40}")
#: words a task counts before it hands them on
HELD_WORDS = 200_000

SPANS = "array<struct<kind:string, start:bigint, end:bigint, bytes:bigint>>"


def identifier_counts(docs: DataFrame) -> DataFrame:
    """word, n: the number of documents of every word without digits, 4 to 40 bytes long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for b in slices(batches):
            for text in b.column("text").cast(pa.large_binary()):
                counts.update(set(WORD.findall(text.as_py())))
                if len(counts) > HELD_WORDS:
                    yield handed(counts)
                    counts = Counter()
        yield handed(counts)

    def handed(counts: Counter[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    return docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def dictionary(docs: DataFrame, limit: int = DICTIONARY_BYTES) -> bytes:
    """The words of most documents, as many as ``limit`` bytes hold; words of one document only are none."""
    most = limit // 5  # a word and its blank have 5 bytes at least
    words: list[bytes] = []
    for r in identifier_counts(docs).filter("n > 1").orderBy(F.desc("n"), "word").limit(most).collect():
        limit -= len(r.word) + 1
        if limit < 0:
            break
        words.append(bytes(r.word))
    return b" ".join(reversed(words))


class Novelty:
    """Marginal compressed bytes of a string after its surroundings, with a dictionary in place."""

    def __init__(self, words: bytes, level: int = 3) -> None:
        more = {}
        if len(words) >= 8:
            known = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=level)
            more["dict_data"] = known
        else:
            more["level"] = level
        self.press = zstandard.ZstdCompressor(write_content_size=False, write_checksum=False, write_dict_id=False, **more).compress

    def of(self, text: str, start: int, end: int) -> tuple[int, float]:
        """Bytes the string adds, and their share of what a random string of its length and alphabet needs."""
        context = f"{text[max(start - BEFORE, 0) : start]}{text[end : end + AFTER]}\n".encode()
        string = text[start:end].encode()
        added = len(self.press(context + string)) - len(self.press(context))
        used = set(text[start:end])
        alphabet = sum(len(a) for a in ALPHABETS if used & set(a))
        return added, 8 * added / (len(string) * math.log2(alphabet))


def base_spans(text: str, low: bytes) -> list[tuple[int, int, str]]:
    """Matches of the three patterns as (start, end, kind)."""
    found = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if b"akia" in low:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if any(w in low for w in ASSIGNS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    return found


def mixed(string: str) -> bool:
    """Letters and digits, or capitals after a small letter and small letters after two capitals: no plain word."""
    digit = any(c.isdigit() for c in string)
    return (digit and any(c.isalpha() for c in string)) or (re.search(r"[a-z][A-Z]", string) is not None and re.search(r"[A-Z]{2}[a-z]", string) is not None)


def candidates(text: str, low: bytes, taken: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """Strings that begin within ``NEAR`` of a sensitive word, of mixed characters, and overlap no span in ``taken``."""
    if not any(w in low for w in SENSITIVE_PARTS):
        return
    taken = sorted((s, e) for s, e, _ in taken)
    at = k = 0
    for word in SENSITIVE.finditer(text):
        at, last = max(at, word.end()), word.end() + NEAR
        while at <= last:
            # a run is looked for from where the window begins, and may end anywhere
            m = CANDIDATE.search(text, at, last + LEAST)
            if not m or m.start() > last:
                break
            m = CANDIDATE.match(text, m.start())
            at = m.end()
            string = m[0].strip(EDGES)
            start = m.start() + len(m[0]) - len(m[0].lstrip(EDGES))
            end = start + len(string)
            while k < len(taken) and taken[k][1] <= start:
                k += 1
            free = all(s >= end or e <= start for s, e in taken[k : k + 3])
            if free and len(string) >= LEAST and mixed(string):
                yield start, end


def scan(text: str, novelty: Novelty) -> list[tuple[str, int, int, int | None]]:
    """All spans of a text as (kind, start, end, marginal bytes of novel ones), by start, then kind as listed."""
    low = text.encode().lower()
    found = base_spans(text, low)
    out = [(s, KINDS.index(kind), e, None) for s, e, kind in found]
    for start, end in candidates(text, low, found):
        added, share = novelty.of(text, start, end)
        if share >= NOVELTY:
            out.append((start, 3, end, added))
    return [(KINDS[k], s, e, added) for s, k, e, added in sorted(out, key=lambda x: x[:2])]


def secret_spans(docs: DataFrame, words: bytes | None = None) -> DataFrame:
    """Per document: doc_id and ``spans``, an array of (kind, start, end, bytes) in code points, end exclusive; ``bytes`` are the
    marginal compressed bytes of novel strings. ``words`` is a dictionary made elsewhere; else it comes from ``docs``."""
    docs = texts(docs)
    words = dictionary(docs) if words is None else words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(words)
        for b in slices(batches):
            spans = [[dict(zip(("kind", "start", "end", "bytes"), s)) for s in scan(t.as_py(), novelty)] for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, kind)], names=["doc_id", "spans"])

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("bytes", pa.int64())]))
    return docs.mapInArrow(run, f"doc_id long, spans {SPANS}")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(documents(spark, sf_dir))

    def of_kind(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select("doc_id", *[of_kind(k) for k in KINDS[:3]], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), of_kind("novel"))
