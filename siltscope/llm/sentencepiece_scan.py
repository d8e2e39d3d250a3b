"""SentencePiece encoding and decoding of whole texts by a max-plus scan.

The best segmentation of a text into pieces is a longest path in a lattice whose arcs are pieces with the model's scores. A giant
document is cut into chunks. A chunk's transfer matrix holds, for every number of characters that a piece from the
chunk before has taken from its start and every number that its own last piece takes from the next, the best score between;
matrices combine by the associative max-plus product. Running products give the best state at every boundary, and each chunk
is then traced back by itself.

Pieces have their mark of a blank in front, so the lattice is cut before each blank that follows another character; the units
between are solved once per worker and remembered, in runs of letters and of others if no piece holds both. A chunk without any blank
is solved as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltscope.llm.common import documents, saved, slices, texts

MARK = "▁"
#: texts of more characters are cut into chunks of so many
GIANT, CHUNK = 32_768, 8_192
#: units a worker remembers
UNITS = 1_000_000
#: how far the score of a character without a piece lies below the lowest piece
UNKNOWN = 10.0
_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
# letters of Latin; a run of others may hold letters of other scripts
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_LETTER, _OTHER = f"[{_LATIN}]", f"[^{_LATIN}{MARK}]"
_PART = re.compile(f"{MARK}*(?:{_LETTER}+|{_OTHER}+)|{MARK}+")
_open: dict[str, "Lattice"] = {}


def lattice(path: str) -> "Lattice":
    if path not in _open:
        _open[path] = Lattice(path)
    return _open[path]


class Lattice:
    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.piece: dict[str, tuple[int, float]] = {}
        self.bytes_of: list[bytes] = []
        self.byte_id = [0] * 256
        for i in range(sp.get_piece_size()):
            name = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(name[3:-1], 16)] = i
                self.bytes_of.append(bytes([int(name[3:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.piece[name] = (i, sp.get_score(i))
                self.bytes_of.append(name.replace(MARK, " ").encode())
        self.longest = max(map(len, self.piece))
        # pieces that the model all but forbids, by a score far below all ranks, do not set the price of an unknown character
        self.unknown = min((s for _, s in self.piece.values() if s > -1e6), default=0.0) - UNKNOWN
        #: scores of pieces and of their beginnings, the latter a score that no path takes
        self.starts = {p[:i]: -np.inf for p in self.piece for i in range(1, len(p))} | {p: s for p, (_, s) in self.piece.items()}
        self.packed = {p: i.to_bytes(4, "little") for p, (i, _) in self.piece.items()}
        self.packed_byte = [i.to_bytes(4, "little") for i in self.byte_id]
        self.cut_at_marks = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.piece)
        self.cut_at_letters = not any(re.search(f"{_LETTER}{_OTHER}|{_OTHER}{_LETTER}", p) for p in self.piece)
        self.units: dict[str, tuple[bytes, float]] = {}

    def arcs(self, z: str, i: int) -> Iterator[tuple[int, float]]:
        """(end, score) of the arcs that begin at i; a character without a piece has one of its own."""
        get, n = self.piece.get, len(z)
        if z[i] not in self.piece:
            yield i + 1, self.unknown
        for j in range(i + 1, min(i + self.longest, n) + 1):
            p = get(z[i:j])
            if p is not None:
                yield j, p[1]

    def forward(self, z: str, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Best score to reach each place of z by arcs that begin in start..stop-1, and where the last arc began."""
        best, back = np.full(len(z) + 1, -np.inf), np.full(len(z) + 1, -1, dtype=np.int64)
        score, came = best.tolist(), back.tolist()
        score[start] = 0.0
        for i in range(start, stop):
            if score[i] == -np.inf:
                continue
            for j, s in self.arcs(z, i):
                if score[i] + s > score[j]:
                    score[j], came[j] = score[i] + s, i
        return np.array(score), np.array(came)

    def ids_between(self, z: str, back: np.ndarray | list[int], start: int, end: int) -> bytes:
        parts: list[bytes] = []
        while end > start:
            i = back[end]
            p = self.packed.get(z[i:end])
            parts.append(p if p is not None else b"".join([self.packed_byte[b] for b in z[i:end].encode()]))
            end = i
        parts.reverse()
        return b"".join(parts)

    def unit(self, u: str) -> tuple[bytes, float]:
        """Ids and score of a unit; where no piece holds letters beside others, runs of either are solved and remembered by themselves."""
        got = self.units.get(u)
        if got is None:
            parts = _PART.findall(u) if self.cut_at_letters else [u]
            if len(parts) > 1:
                solved = [self.units.get(p) or self.unit(p) for p in parts]
                return b"".join([s[0] for s in solved]), sum([s[1] for s in solved])
            if len(self.units) >= UNITS:
                self.units.clear()
            score, back = self.best(u)
            got = self.units[u] = self.ids_between(u, back, 0, len(u)), score
        return got

    def best(self, u: str) -> tuple[float, list[int]]:
        """``forward`` over a whole unit, without arrays: most units are a few characters."""
        get, longest, n, never = self.starts.get, self.longest, len(u), -np.inf
        score, back = [never] * (n + 1), [-1] * (n + 1)
        score[0] = 0.0
        for i in range(n):
            here = score[i]
            s = get(u[i])
            arc = here + (self.unknown if s is None or s == never else s)
            if arc > score[i + 1]:
                score[i + 1], back[i + 1] = arc, i
            if s is None:
                continue
            for j in range(i + 2, min(i + longest, n) + 1):
                s = get(u[i:j])
                if s is None:
                    break  # neither a piece nor the beginning of one
                s += here
                if s > score[j]:
                    score[j] = s
                    back[j] = i
        return score[n], back

    def solve(self, z: str) -> tuple[bytes, float]:
        """Ids and score of a text that stands by itself; z has marks for blanks."""
        known, unit = self.units.get, self.unit
        solved = [known(u) or unit(u) for u in (_UNIT.findall(z) if self.cut_at_marks else [z])]
        return b"".join([s[0] for s in solved]), float(sum([s[1] for s in solved]))

    def cuts(self, chunk: str) -> tuple[int, int] | None:
        """The first and last place in a chunk that no piece crosses."""
        if not self.cut_at_marks:
            return None
        at = [m.start() + 1 for m in re.finditer(f"[^{MARK}](?={MARK})", chunk)]
        return (at[0], at[-1]) if at else None

    def matrix(self, chunk: str, tail: str) -> np.ndarray:
        """longest x longest: from characters taken at the start to characters taken of the tail."""
        k, n = self.longest, len(chunk)
        z = chunk + tail[: k - 1]
        m = np.full((k, k), -np.inf)
        cut = self.cuts(chunk)
        if cut:
            first, last = cut
            middle = self.solve(chunk[first:last])[1] if last > first else 0.0
            end, _ = self.forward(z[last:], 0, n - last)
            over = end[n - last :][:k]
            for s in range(min(k, first + 1)):
                head = self.forward(chunk[:first], s, first)[0][first]
                m[s, : len(over)] = head + middle + over
        else:
            for s in range(min(k, n + 1)):
                over = self.forward(z, s, n)[0][n:][:k]
                m[s, : len(over)] = over
        return m

    def trace(self, chunk: str, tail: str, start: int, over: int) -> bytes:
        """Ids of the best path of a chunk between two boundary states."""
        n = len(chunk)
        z = chunk + tail[: self.longest - 1]
        cut = self.cuts(chunk)
        if not cut:
            _, back = self.forward(z, start, n)
            return self.ids_between(z, back, start, n + over)
        first, last = cut
        head = self.ids_between(chunk[:first], self.forward(chunk[:first], start, first)[1], start, first)
        middle = self.solve(chunk[first:last])[0] if last > first else b""
        rest = z[last:]
        return head + middle + self.ids_between(rest, self.forward(rest, 0, n - last)[1], 0, n - last + over)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the blank that encoding puts in front goes."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode(errors="replace")
        return raw[1:] if raw.startswith(" ") else raw


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product of two matrices."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def running(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """All prefix products, by doubling: as many rounds as the logarithm of their number."""
    out, step = list(matrices), 1
    while step < len(out):
        out = out[:step] + [product(out[i - step], out[i]) for i in range(step, len(out))]
        step *= 2
    return out


def boundaries(matrices: list[np.ndarray]) -> tuple[list[int], float]:
    """The best state before each chunk and after the last, and the score: from the prefix products, last boundary first."""
    prefix = running(matrices)
    states = [0]
    for i in range(len(matrices) - 1, 0, -1):
        states.append(int((prefix[i - 1][0] + matrices[i][:, states[-1]]).argmax()))
    return [0, *reversed(states)], float(prefix[-1][0, 0])


RESULT = "doc_id long, n_tokens long, n_chunks int, score double, ids binary"


def encode(docs: DataFrame, model: str, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_chunks, score, ids (little-endian 32-bit, packed).

    A null or empty text has no tokens. Characters without a piece become byte pieces. Rows that repeat a doc_id, or lack one, are
    encoded each by itself; an empty table gives an empty result.
    """
    t = texts(docs)
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.binary())
    names = ["doc_id", "n_tokens", "n_chunks", "score", "ids"]

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(model)
        for b in slices(batches):
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids, score = lat.solve(marked(text))
                rows.append((doc_id, len(ids) // 4, 1, score, ids))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    small = t.filter(F.length("text") <= giant).mapInArrow(short, RESULT)

    # giant texts: chunks of one row each, dealt out evenly; a row carries what its last piece may take of the next chunk
    big = t.filter(F.length("text") > giant).withColumn("z", F.concat(F.lit(MARK), F.translate("text", " ", MARK))).withColumn("row", F.monotonically_increasing_id())
    n = F.floor((F.length("z") + chunk - 1) / chunk)
    cut = big.select("row", "doc_id", n.cast("int").alias("n_chunks"), "z", F.explode(F.sequence(F.lit(0), n.cast("int") - 1)).alias("i"))
    parts = cut.select(
        "row", "doc_id", "n_chunks", "i", F.substring("z", F.col("i") * chunk + 1, F.lit(chunk)).alias("body"), F.substring("z", (F.col("i") + 1) * chunk + 1, F.lit(64)).alias("tail"),
    )
    parts = saved(parts.repartition(F.col("row"), F.col("i")), "giant-chunks")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(model)
        for b in slices(batches, "body"):
            ms = [lat.matrix(c, tail).astype(np.float64).tobytes() for c, tail in zip(b.column("body").to_pylist(), b.column("tail").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("i"), pa.array(ms, pa.binary())], ["row", "i", "m"])

    def combine(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        ms = [np.frombuffer(m).reshape(int(len(m) ** 0.5 / 8**0.5 + 0.5), -1) for m in table.column("m").to_pylist()]
        states, score = boundaries(ms)
        return pa.table({"row": table.column("row"), "i": table.column("i"), "start": pa.array(states[:-1], pa.int32()), "over": pa.array(states[1:], pa.int32()), "score": pa.array([score] * len(ms))})

    states = parts.mapInArrow(matrices, "row long, i int, m binary").groupBy("row").applyInArrow(combine, "row long, i int, start int, over int, score double")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(model)
        for b in slices(batches, "body"):
            ids = [lat.trace(*x) for x in zip(*(b.column(c).to_pylist() for c in ("body", "tail", "start", "over")))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "doc_id", "n_chunks", "i", "score")), pa.array(ids, pa.binary())], ["row", "doc_id", "n_chunks", "i", "score", "ids"])

    traced = parts.join(states, ["row", "i"]).select("row", "doc_id", "n_chunks", "i", "score", "body", "tail", "start", "over").mapInArrow(trace, "row long, doc_id long, n_chunks int, i int, score double, ids binary")

    def whole(table: pa.Table) -> pa.Table:
        r = table.sort_by("i")
        ids = b"".join(r.column("ids").to_pylist())
        row = (r.column("doc_id")[0].as_py(), len(ids) // 4, r.column("n_chunks")[0].as_py(), r.column("score")[0].as_py(), ids)
        return pa.table([pa.array([x], k) for x, k in zip(row, kinds)], names=names)

    return small.unionByName(traced.groupBy("row").applyInArrow(whole, RESULT))


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """The rows of ``encoded`` (doc_id, n_tokens, n_chunks, score, ids) with ``text`` in addition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(model)
        for b in slices(batches, "ids", 4 << 20):
            out = [lat.decode(np.frombuffer(x, "<u4")) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, "text"])

    return encoded.select("doc_id", "n_tokens", "n_chunks", "score", "ids").mapInArrow(run, f"{RESULT}, text string")


def piece_bpe() -> str:
    """The public SentencePiece model; a file of the installed environment on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op3_sentencepiece_scan(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, n_chunks, score, ids_crc32, decoded_sha256 (equal to that of the text)."""
    d = decode(encode(documents(spark, sf_dir), piece_bpe()), piece_bpe())
    return d.select("doc_id", "n_tokens", "n_chunks", "score", F.crc32("ids").alias("ids_crc32"), F.sha2("text", 256).alias("decoded_sha256"))
