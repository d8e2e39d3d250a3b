"""Fill-in-the-middle forms of documents, their cuts located over memoized content-defined chunks.

A rolling hash over the last ``WINDOW`` bytes cuts a text into chunks where it hits a pattern, so equal passages give equal chunks
wherever they stand. What a chunk contributes is its boundary summary: words that begin in it, whether its first and last
byte belong to a word, and its code points. Summaries are kept in a cache by content: the lookup compares the bytes themselves, so a
shared chunk is scanned once a task and never mistaken for another. Combining the counts along a document (a word that runs across a
boundary counts once) gives its number of tokens, and the one chunk that holds a cut is the only one looked at again.

Tokens are ``blanks* word`` or, at the end, ``blanks``, over the blanks 0x20 and 0x09-0x0D. A token but the last thus ends where a
word ends, and a text has as many as words begin in it, one more if it ends blank.

Defined results: a null text is empty; empty texts and those that hold a mark stay plain. A missing doc_id is the empty text in
the seed. Rows are independent, so ties and repeated rows do not matter: equal rows give equal rows. An empty table gives no rows.
Extra columns are not read, whatever their names. A very long text is a slice of its own and stands in a worker once, with its
output.
"""

from __future__ import annotations

import hashlib
import re
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltscope.llm.common import documents, slices, texts
from siltscope.llm.words import BYTE, U, mix

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80
#: bytes the rolling hash sees; a boundary is one in 2 ** PATTERN places; least and most bytes of a chunk
WINDOW, PATTERN, LEAST, MOST = 32, 9, 64, 8192
#: bytes hashed at a time
SEGMENT = 1 << 20
#: bytes of chunks a task's cache holds
CACHE_BYTES = 32 << 20
BLANKS = b" \t\n\v\f\r"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, {output}output_sha256 string, restored_sha256 string"


def boundaries(data: bytes) -> np.ndarray:
    """Places where the rolling hash of the ``WINDOW`` bytes before hits the pattern."""
    out = []
    for at in range(0, len(data), SEGMENT):
        first = max(at - WINDOW + 1, 0)
        byte = BYTE[np.frombuffer(data, dtype=np.uint8, count=min(at + SEGMENT, len(data)) - first, offset=first)]
        span, rolled = 1, byte
        while span < WINDOW:  # sum of BYTE[i - j] * 2^j by doubling
            longer = rolled.copy()
            longer[span:] += rolled[:-span] << U(span)
            span, rolled = 2 * span, longer
        out.append(np.flatnonzero((mix(rolled[at - first :]) >> U(64 - PATTERN)) == 0) + at + 1)
    return np.concatenate(out)


def chunk_ends(data: bytes) -> list[int]:
    """Where content-defined chunks of ``data`` end."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    found = boundaries(data)
    ends, at = [], 0
    while at < n:
        i = np.searchsorted(found, at + LEAST)
        end = int(found[i]) if i < len(found) else n
        at = min(end, at + MOST, n)
        ends.append(at)
    return ends


class Summaries:
    """Boundary summaries (words begun, begins in a word, ends in a word, code points) by content; the least recently used go."""

    def __init__(self, limit: int = CACHE_BYTES) -> None:
        self.limit, self.held, self.known = limit, 0, OrderedDict()
        self.scanned = self.shared = 0

    def of(self, chunk: bytes) -> tuple[int, bool, bool, int]:
        known = self.known.get(chunk)
        if known is not None:
            self.known.move_to_end(chunk)
            self.shared += 1
            return known
        known = len(chunk.split()), chunk[0] not in BLANKS, chunk[-1] not in BLANKS, len(chunk) - sum_continuations(chunk)
        self.scanned += 1
        self.known[chunk] = known
        self.held += len(chunk)
        while self.held > self.limit and len(self.known) > 1:
            old, _ = self.known.popitem(last=False)
            self.held -= len(old)
        return known


def sum_continuations(chunk: bytes) -> int:
    """Bytes that continue a code point."""
    return int(np.count_nonzero((np.frombuffer(chunk, dtype=np.uint8) & 0xC0) == 0x80)) if not chunk.isascii() else 0


class Counted:
    """A text as chunks with running counts: words begun and code points before each."""

    def __init__(self, data: bytes, cache: Summaries) -> None:
        self.data, self.ends = data, chunk_ends(data)
        self.words, self.chars, self.inside = [0], [0], [False]
        start = 0
        for end in self.ends:
            words, first, last, chars = cache.of(data[start:end])
            self.words.append(self.words[-1] + words - (first and self.inside[-1]))
            self.chars.append(self.chars[-1] + chars)
            self.inside.append(last)
            start = end
        self.n = self.words[-1] + (bool(data) and not self.inside[-1])

    def cut(self, k: int) -> tuple[int, int]:
        """Bytes and code points of the first ``k`` tokens."""
        if k <= 0:
            return 0, 0
        if k > self.words[-1] or (k == self.n):
            return len(self.data), self.chars[-1]
        # the k-th word begins in chunk c - 1 and ends there or in a later chunk
        c = int(np.searchsorted(self.words, k))
        start = self.ends[c - 2] if c > 1 else 0
        skip = k - self.words[c - 1] - 1 + (self.inside[c - 1] and self.data[start] not in BLANKS)
        for i, m in enumerate(WORD.finditer(self.data, start, self.ends[c - 1])):
            if i == skip:
                end = m.end()
                break
        while end == self.ends[c - 1] and c < len(self.ends):
            m = WORD.match(self.data, end, self.ends[c])
            if not m:
                break
            end, c = m.end(), c + 1
        start = self.ends[c - 2] if c > 1 else 0
        return end, self.chars[c - 1] + end - start - sum_continuations(self.data[start:end])


def seeds(doc_id: int | None) -> tuple[int, int, int, int]:
    text = hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(text[i : i + 8], 16) for i in (0, 8, 16, 24))


def transformed(doc_id: int | None, data: bytes, cache: Summaries) -> tuple[int, str, int | None, int | None, bytes]:
    """Tokens, form, code points of prefix and middle, output."""
    text = Counted(data, cache)
    h1, h2, h3, h4 = seeds(doc_id)
    if not data or h3 % 100 >= FIM_PERCENT or any(m.encode() in data for m in (PREFIX, SUFFIX, MIDDLE)):
        return text.n, "plain", None, None, data
    a, b = sorted((h1 % (text.n + 1), h2 % (text.n + 1)))
    (i, chars_i), (j, chars_j) = text.cut(a), text.cut(b)
    view = memoryview(data)
    prefix, middle, suffix = view[:i], view[i:j], view[j:]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if h4 % 100 < SPM_PERCENT:
        return text.n, "spm", chars_i, chars_j - chars_i, b"".join((s, suffix, p, prefix, m, middle))
    return text.n, "psm", chars_i, chars_j - chars_i, b"".join((p, prefix, s, suffix, m, middle))


def restored(output: bytes, form: str) -> bytes:
    """The text that an output of this form came from; marks stand in no transformed text, so each occurs once."""
    if form == "plain":
        return output
    p, s, m = (output.index(x.encode()) for x in (PREFIX, SUFFIX, MIDDLE))
    if form == "psm":
        return output[p + 3 : s] + output[m + 3 :] + output[s + 3 : m]
    return output[p + 3 : m] + output[m + 3 :] + output[s + 3 : p]


def fill_middle(docs: DataFrame, with_output: bool = True) -> DataFrame:
    """Per document: doc_id, n, form, prefix_chars, middle_chars, (output,) output_sha256, restored_sha256."""
    schema = SCHEMA.format(output="output string, " if with_output else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Summaries()
        for b in slices(batches):
            ids = b.column("doc_id").to_pylist()
            data = b.column("text").cast(pa.large_binary())
            rows = []
            for i, doc_id in enumerate(ids):
                n, form, prefix, middle, out = transformed(doc_id, data[i].as_py(), cache)
                row = {"doc_id": doc_id, "n": n, "form": form, "prefix_chars": prefix, "middle_chars": middle}
                if with_output:
                    row["output"] = out.decode()
                rows.append(row | {"output_sha256": hashlib.sha256(out).hexdigest(), "restored_sha256": hashlib.sha256(restored(out, form)).hexdigest()})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    arrow = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in schema.split(", ")])
    return texts(docs).mapInArrow(run, schema)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle(documents(spark, sf_dir), with_output=False)


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens
  FROM documents
), k AS (
  SELECT doc_id, text, tokens, len(tokens) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(tokens) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(tokens) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT doc_id, text, n, form, array_to_string(tokens[1:least(a, b)], '') AS prefix, array_to_string(tokens[least(a, b) + 1:greatest(a, b)], '') AS middle,
         array_to_string(tokens[greatest(a, b) + 1:], '') AS suffix
  FROM k
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(CASE WHEN form = 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM p"""
