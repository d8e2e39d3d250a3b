"""Language-model scores by Brown classes: exchange clustering, class transitions and word emissions.

1. Every task encodes its texts against a dictionary of its own (64-bit word hashes), with training counts.
2. The dictionaries are dealt out by hash, summed, and each task's words get their counts over the whole corpus back.
3. The vocabulary, every word seen ``FREQUENT`` times or more, is clustered by exchange. The ``SEED`` most frequent words are
   clustered first, on the driver, and the others spread over their classes; then each sweep counts, for every word of the vocabulary, the classes beside it, brings a word's counts together
   by hash, moves it to its best class and sends the classes back. Rarer words fall into classes of equal count.
4. P(w | v) = P(class(w) | class(v)) P(w | class(w)), interpolated with the smoothed unigram. Words never seen share one event, whose
   probability after a class is that of words seen once: leaving one occurrence out turns those into unseen words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltscope.llm.common import documents, dropped, held_out, saved, slices, texts
from siltscope.llm.words import U, Words, deal

#: words seen so often or more are clustered
FREQUENT = 5
#: words that give the classes a start
SEED = 1000
CLASSES = 48
SWEEPS = 4
#: weight of the unigram in the mixture
UNIGRAM = 0.05
MOD, REST = 7, 2
#: the token after a text's last word
END = U(0xE11D0F7E47)
#: tokens after which a task starts a new dictionary
CHUNK_TOKENS = 1_200_000
#: tokens that are scored at once
SCORED_TOKENS = 100_000
#: documents whose dictionaries one group of the counting pass holds
GROUP_DOCS = 1500
#: classes of words outside the vocabulary: unseen, seen once to four times, more often
BANDS = 6


def packed(x: np.ndarray) -> bytes:
    """Compressed with the numbers' first bytes together, then their second ones, and so on: high bytes are mostly alike."""
    return pa.compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(raw: bytes, kind: type, n: int) -> np.ndarray:
    if not n:
        return np.empty(0, kind)
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw, n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def packed_words(words: np.ndarray) -> bytes:
    """Sorted hashes as their number and their differences."""
    return len(words).to_bytes(4, "little") + packed(np.diff(words, prepend=U(0)))


def unpacked_words(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw[4:], U, int.from_bytes(raw[:4], "little")), dtype=U)


CHUNKS = "chunk long, words binary, train binary, ids binary, held binary, sizes binary, tokens binary"


def encoded(t: DataFrame) -> DataFrame:
    """One row per task or part of one: its dictionary, training counts and token indexes. ``t`` has doc_id, text, held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 20
        parts: list[tuple] = []
        room = 0

        def flush() -> pa.RecordBatch:
            words, to = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            shift = np.cumsum([0, *(len(p[0]) for p in parts)])
            tokens = np.concatenate([to[a + p[1]] for a, p in zip(shift, parts)]).astype(np.int32)
            ids, held, sizes = (np.concatenate([p[i] for p in parts]) for i in (2, 3, 4))
            train = np.bincount(tokens[np.repeat(held & 1 == 0, sizes)], minlength=len(words))
            row = (chunk, packed_words(words), packed(train), ids.tobytes(), held.tobytes(), sizes.astype(np.int32).tobytes(), packed(tokens))
            return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *(pa.array([x], pa.binary()) for x in row[1:])], [c.split()[0] for c in CHUNKS.split(", ")])

        for b in slices(batches):
            w = Words(b.column("text"), lower=True)
            h = np.insert(w.hash, w.first[1:], END)
            words, at = np.unique(h, return_inverse=True)
            ids = np.array([-1 if x is None else x for x in b.column("doc_id").to_pylist()], dtype=np.int64)
            none = np.array([x is None for x in b.column("doc_id").to_pylist()])
            held = np.array(b.column("held").to_pylist(), dtype=np.uint8) + 2 * none.astype(np.uint8)
            parts.append((words, at.astype(np.int32), ids, held, w.counts() + 1))
            room += len(h)
            if room >= CHUNK_TOKENS:
                chunk += 1
                yield flush()
                parts, room = [], 0
        if parts:
            chunk += 1
            yield flush()

    return t.mapInArrow(run, CHUNKS)


COUNTED = "p int, chunk long, counts binary, n long, v long, once array<long>, top array<struct<word: bigint, count: bigint>>"


def counted(chunks: DataFrame, n_groups: int, vocabulary: int) -> DataFrame:
    """Per group and chunk the corpus counts of its words there; per group (chunk -1) sums and its most frequent words."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, words, train in zip(*(b.column(c).to_pylist() for c in ("chunk", "words", "train"))):
                words = unpacked_words(words)
                train = unpacked(train, np.int64, len(words))
                rows = [(p, chunk, packed_words(words[i]), packed(train[i])) for p, i in deal(words, n_groups)]
                kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["p", "chunk", "words", "train"])

    def total(table: pa.Table) -> pa.Table:
        p = table.column("p")[0].as_py()
        chunks_ = table.column("chunk").to_pylist()
        words = [unpacked_words(x) for x in table.column("words").to_pylist()]
        train = [unpacked(x, np.int64, len(w)) for x, w in zip(table.column("train").to_pylist(), words)]
        all_, to = np.unique(np.concatenate(words), return_inverse=True)
        count = np.bincount(to, np.concatenate(train).astype(np.float64), minlength=len(all_)).astype(np.int64)
        cuts = np.cumsum([0, *(len(w) for w in words)])
        back = count[to]
        seen = count > 0
        once = np.bincount(np.minimum(count[seen], 6), minlength=7)[:7]
        other = np.flatnonzero(seen & (all_ != END))
        best = other[np.lexsort((all_[other].view(np.int64), -count[other]))[:vocabulary]]
        top = [{"word": int(a), "count": int(c)} for a, c in zip(all_[best].view(np.int64), count[best])]
        rows = [(p, c, packed(back[a:z]), None, None, None, None) for c, a, z in zip(chunks_, cuts, cuts[1:])]
        rows.append((p, -1, None, int(count.sum()), int(seen.sum()), once.tolist(), top))
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.struct([("word", pa.int64()), ("count", pa.int64())])))
        return pa.table([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=["p", "chunk", "counts", "n", "v", "once", "top"])

    return chunks.select("chunk", "words", "train").mapInArrow(post, "p int, chunk long, words binary, train binary").groupBy("p").applyInArrow(total, COUNTED)


def unit_of(words: np.ndarray, counts: np.ndarray, top: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Vocabulary words 0.., the end, then the bands. ``top`` are sorted hashes, ``where`` their units."""
    n = len(top)
    out = n + 1 + np.minimum(counts, BANDS - 1)
    if n:
        at = np.minimum(np.searchsorted(top, words), n - 1)
        hit = top[at] == words
        out[hit] = where[at[hit]]
    out[words == END] = n
    return out.astype(np.int16)


RESOLVED = "chunk long, words binary, ids binary, held binary, sizes binary, tokens binary, n_words int, counts binary, units binary"


def resolved_row(row: tuple) -> pa.Table:
    kinds = (pa.int64(), *[pa.binary()] * 5, pa.int32(), pa.binary(), pa.binary())
    return pa.table([pa.array([x], k) for x, k in zip(row, kinds)], names=[c.split()[0] for c in RESOLVED.split(", ")])


def resolved(chunks: DataFrame, counts: DataFrame, top: np.ndarray, where: np.ndarray) -> DataFrame:
    """Chunks with each dictionary word's corpus count and unit in the place of its hash."""

    def join(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        base = next(r for r in rows if r["words"] is not None)
        words = unpacked_words(base["words"])
        got = {r["p"]: r["counts"] for r in rows if r["counts"] is not None}
        n_groups = table.column("groups")[0].as_py()
        count = np.zeros(len(words), np.int64)
        for p, i in deal(words, n_groups):
            count[i] = unpacked(got[p], np.int64, len(i))
        row = (base["chunk"], base["words"], base["ids"], base["held"], base["sizes"], base["tokens"], len(words), packed(count), packed(unit_of(words, count, top, where)))
        return resolved_row(row)

    return chunks.unionByName(counts, allowMissingColumns=True).groupBy("chunk").applyInArrow(join, RESOLVED)


def read_chunk(r: dict, units: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """ids, held (bit 0; bit 1: no id), sizes, counts and units (or ``units`` of the dictionary) of each token."""
    ids, held, sizes = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["held"], np.uint8), np.frombuffer(r["sizes"], np.int32)
    tokens = unpacked(r["tokens"], np.int32, int(sizes.sum()))
    count = unpacked(r["counts"], np.int64, r["n_words"])
    unit = unpacked(r["units"], np.int16, r["n_words"]) if units is None else units
    return ids, held, sizes, count[tokens], unit[tokens].astype(np.int64)


def by_documents(ids: np.ndarray, held: np.ndarray, sizes: np.ndarray, count: np.ndarray, unit: np.ndarray, limit: int | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """A chunk's documents in runs of at most ``limit`` tokens, or of one document, so that scores take little room at once."""
    limit = SCORED_TOKENS if limit is None else limit
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        first = int(ends[start] - sizes[start])
        stop = max(start + 1, int(np.searchsorted(ends, first + limit, side="right")))
        last = int(ends[stop - 1])
        yield ids[start:stop], held[start:stop], sizes[start:stop], count[first:last], unit[first:last]
        start = stop


def before(unit: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """The unit before each token; a text begins after an end."""
    prev = np.empty_like(unit)
    prev[1:] = unit[:-1]
    prev[np.cumsum(sizes) - sizes] = end
    return prev


def bigrams(chunks: DataFrame, n_units: int, end: int, named: Callable[[dict], np.ndarray] | None = None) -> np.ndarray:
    """Bigram counts of units, or of what ``named`` gives a chunk's words, over all training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros(n_units * n_units, dtype=np.int64)
        for b in batches:
            for r in b.to_pylist():
                _, held, sizes, _, unit = read_chunk(r) if named is None else read_chunk(r, named(r))
                use = np.repeat(held & 1 == 0, sizes)
                m += np.bincount((before(unit, sizes, end) * n_units + unit)[use], minlength=len(m))
        m = m.reshape(n_units, n_units)
        rows = np.flatnonzero(m.any(axis=1))
        if len(rows):
            yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array([m[i].tobytes() for i in rows], pa.binary())], ["unit", "counts"])

    def add(table: pa.Table) -> pa.Table:
        s = np.sum([np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist()], axis=0)
        return pa.table({"unit": table.column("unit").slice(0, 1), "counts": pa.array([s.tobytes()], pa.binary())})

    schema = "unit int, counts binary"
    out = np.zeros((n_units, n_units), dtype=np.int64)
    for r in chunks.mapInArrow(run, schema).groupBy("unit").applyInArrow(add, schema).collect():  # n_units rows of n_units counts
        out[r["unit"]] = np.frombuffer(r["counts"], np.int64)
    return out


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def gains(a: np.ndarray, r: np.ndarray, l: np.ndarray, s: float, k: int) -> np.ndarray:
    """What each of the first k classes gains in likelihood by a word that is in none: its counts to the right and left, and beside itself."""
    on, to, own = np.flatnonzero(r), np.flatnonzero(l), np.arange(k)
    rows, cols = a[:k, on], a[to, :k].T
    gain = (xlogx(rows + r[on]) - xlogx(rows)).sum(axis=1) + (xlogx(cols + l[to]) - xlogx(cols)).sum(axis=1)
    d = a[own, own]
    gain += xlogx(d + r[:k] + l[:k] + s) - xlogx(d) - (xlogx(d + r[:k]) - xlogx(d)) - (xlogx(d + l[:k]) - xlogx(d))
    # wherever the word goes, its neighbours' classes gain its contexts
    out, into = a.sum(axis=1)[:k] + l[:k], a.sum(axis=0)[:k] + r[:k]
    return gain - (xlogx(out + r.sum() + s) - xlogx(out) + xlogx(into + l.sum() + s) - xlogx(into))


def settled(a: np.ndarray, total: np.ndarray, of: np.ndarray, k: int) -> np.ndarray:
    """Classes after one turn over words of classes ``of``: each moves where ``gains`` is largest, later ones see its move.

    ``total``: of each word the counts of classes to the right, to the left, and of the word beside itself. All terms of a word's gains
    lie in one table and take one logarithm: most words have few neighbours, so calls cost more than numbers.
    """
    c = len(a)
    of = of.copy()
    g = np.concatenate((a[:k].T, a[:, :k]))  # of each class, what stands to its right, then to its left
    d = g[:k].diagonal()
    sums = np.stack((a.sum(axis=1)[:k], a.sum(axis=0)[:k]))
    sides = np.stack((total[:, :c].sum(axis=1), total[:, c : 2 * c].sum(axis=1)), axis=1)
    table = np.empty((4 * c + 8, k))
    sign = np.concatenate((np.ones(2 * c), -np.ones(2 * c)))
    signs = [np.concatenate((sign[:n], sign[2 * c : 2 * c + n], [1, 1, -1, -1, -1, -1, 1, 1])) for n in range(2 * c + 1)]

    def shift(j: int, v: np.ndarray, s: float) -> None:
        g[:, j] += v
        g[j] += v[c : c + k]
        g[c + j] += v[:k]
        g[j, j] += s
        g[c + j, j] += s

    for w, side in enumerate(sides):
        old, v, s = of[w], total[w, :-1].copy(), total[w, -1]
        v[old] -= s
        v[c + old] -= s
        shift(old, -v, -s)
        sums[:, old] -= side
        on = np.flatnonzero(v)
        n = len(on)
        x = table[: 2 * n + 8]
        r, l = v[:k], v[c : c + k]
        beside = x[n : 2 * n]
        g.take(on, axis=0, out=beside, mode="clip")
        np.add(beside, v[on, None], out=x[:n])
        x[2 * n], x[2 * n + 1] = d + (r + l + s), d
        np.add(d, r, out=x[2 * n + 2])
        np.add(d, l, out=x[2 * n + 3])
        np.add(sums, side[:, None], out=x[2 * n + 4 : 2 * n + 6])
        x[2 * n + 6 :] = sums
        y = np.maximum(x, 1)
        np.log(y, out=y)
        y *= x
        gain = signs[n] @ y
        new = int(gain.argmax())
        if gain[new] <= gain[old] + 1e-9:
            new = old
        shift(new, v, s)
        sums[:, new] += side
        of[w] = new
    return of


def exchange(m: np.ndarray, n_words: int, classes: int, sweeps: int) -> np.ndarray:
    """The class of each unit: units from ``n_words`` on have classes of their own; each word is moved to the class
    that raises the class-bigram likelihood most, in turns over all words, until none moves."""
    m = m.astype(np.float64)
    k = max(1, min(classes, n_words))
    of = np.concatenate((np.arange(n_words) % k, k + np.arange(len(m) - n_words)))
    c = k + len(m) - n_words
    to = np.zeros((len(m), c))
    to[np.arange(len(m)), of] = 1
    right, left = m @ to, m.T @ to  # of each unit, by class of its neighbour
    a = to.T @ right
    for _ in range(sweeps):
        moved = 0
        for w in range(n_words):
            old, r, l, s = of[w], right[w].copy(), left[w].copy(), m[w, w]
            a[old] -= r
            a[:, old] -= l
            a[old, old] += s
            r[old] -= s
            l[old] -= s
            gain = gains(a, r, l, s, k)
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = old
            a[new] += r
            a[:, new] += l
            a[new, new] += s
            if new != old:
                moved += 1
                of[w] = new
                right[:, old] -= m[:, w]
                right[:, new] += m[:, w]
                left[:, old] -= m[w]
                left[:, new] += m[w]
        if not moved:
            break
    return of


def likelihood(a: np.ndarray) -> float:
    """Of class bigrams, less what no clustering changes."""
    return float(xlogx(a).sum() - xlogx(a.sum(axis=0)).sum() - xlogx(a.sum(axis=1)).sum())


def is_member(words: np.ndarray, counts: np.ndarray, floor: tuple[int, int]) -> np.ndarray:
    """Words of the vocabulary: seen more often than the floor, or as often with no greater hash."""
    return ((counts > floor[0]) | ((counts == floor[0]) & (words.view(np.int64) <= floor[1]))) & (words != END)


@dataclass(frozen=True)
class Classes:
    """Reads the classes of a chunk's words. ``of``: of each unit; words of the vocabulary that have none yet start spread over all k."""

    of: np.ndarray
    k: int
    floor: tuple[int, int]

    def words(self, r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, whether in the vocabulary, classes."""
        words = unpacked_words(r["words"])
        cls = self.of[unpacked(r["units"], np.int16, len(words))]
        me = is_member(words, unpacked(r["counts"], np.int64, len(words)), self.floor)
        start = me & (cls >= self.k)
        cls[start] = (words[start] % U(self.k)).astype(np.int64)
        return words, me, cls

    def units(self, r: dict) -> np.ndarray:
        """Classes, words seen ``FREQUENT`` times apart: behind all others, in the same order."""
        words, me, cls = self.words(r)
        five = me & (unpacked(r["counts"], np.int64, len(words)) == FREQUENT)
        return cls + (self.k + 1 + BANDS) * five


BESIDE = "p int, chunk long, words binary, classes binary, cells binary, counts binary"


def beside(chunks: DataFrame, classes: Classes, n_groups: int) -> DataFrame:
    """Per chunk and group the words of the vocabulary, their classes, and how often which class stands right, left and the word beside itself."""
    end = classes.k
    c = end + 1 + BANDS
    width = 2 * c + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                words, me, cls = classes.words(r)
                held, sizes = np.frombuffer(r["held"], np.uint8), np.frombuffer(r["sizes"], np.int32)
                tokens = unpacked(r["tokens"], np.int32, int(sizes.sum())).astype(np.int64)
                use, starts = np.repeat(held & 1 == 0, sizes), np.zeros(len(tokens), dtype=bool)
                starts[np.cumsum(sizes) - sizes] = True
                prev = np.concatenate((tokens[:1], tokens[:-1]))
                left = use & me[tokens]
                right = use & ~starts & me[prev]
                same = right & (prev == tokens)
                cells = np.concatenate((
                    tokens[left] * width + c + np.where(starts, end, cls[prev])[left],
                    prev[right] * width + cls[tokens][right],
                    tokens[same] * width + 2 * c,
                ))
                cells, n = np.unique(cells, return_counts=True)
                rows = []
                for p, i in deal(words, n_groups):  # sorted words: a range each
                    i = i[me[i]]
                    if not len(i):
                        continue
                    place = np.full(int(i[-1] - i[0]) + 1, -1, dtype=np.int64)
                    place[i - i[0]] = np.arange(len(i))
                    x, z = np.searchsorted(cells, [i[0] * width, (i[-1] + 1) * width])
                    local = place[cells[x:z] // width - i[0]] * width + cells[x:z] % width
                    rows.append((p, r["chunk"], packed_words(words[i]), packed(cls[i].astype(np.int16)), packed(np.diff(local, prepend=0)), packed(n[x:z].astype(np.int32)), z - x))
                if rows:
                    kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 4, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows), kinds)], [*(x.split()[0] for x in BESIDE.split(", ")), "n"])

    return chunks.mapInArrow(run, BESIDE + ", n long")


def moved(near: DataFrame, a: np.ndarray, k: int) -> DataFrame:
    """Per group and chunk the new classes of its words. A group sees its own moves at once, those of others in the next sweep."""
    c = len(a)
    width = 2 * c + 1

    def run(table: pa.Table) -> pa.Table:
        got = {x: table.column(x).to_pylist() for x in table.column_names}
        words = [unpacked_words(x) for x in got["words"]]
        all_, to = np.unique(np.concatenate(words), return_inverse=True)
        cuts = np.cumsum([0, *(len(w) for w in words)])
        total = np.zeros(len(all_) * width)
        of = np.zeros(len(all_), dtype=np.int64)
        for x, z, cls, cells, n, size in zip(cuts, cuts[1:], got["classes"], got["cells"], got["counts"], got["n"]):
            at = np.cumsum(unpacked(cells, np.int64, size))
            total[to[x:z][at // width] * width + at % width] += unpacked(n, np.int32, size)
            of[to[x:z]] = unpacked(cls, np.int16, z - x)
        of = settled(a, total.reshape(-1, width), of, k)
        back = of[to].astype(np.int16)
        return pa.table([pa.array(got["p"], pa.int32()), pa.array(got["chunk"], pa.int64()), pa.array([packed(back[x:z]) for x, z in zip(cuts, cuts[1:])], pa.binary())], names=["p", "chunk", "classes"])

    return near.groupBy("p").applyInArrow(run, "p int, chunk long, classes binary")


def reclassed(chunks: DataFrame, moves: DataFrame, classes: Classes, n_groups: int) -> DataFrame:
    """Chunks whose words of the vocabulary have their new classes as units."""

    def join(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        base = next(r for r in rows if r["words"] is not None)
        got = {r["p"]: r["classes"] for r in rows if r["classes"] is not None}
        words, me, cls = classes.words(base)
        for p, i in deal(words, n_groups):
            i = i[me[i]]
            if len(i):
                cls[i] = unpacked(got[p], np.int16, len(i))
        return resolved_row((*(base[x] for x in ("chunk", "words", "ids", "held", "sizes", "tokens", "n_words", "counts")), packed(cls.astype(np.int16))))

    return chunks.unionByName(moves, allowMissingColumns=True).groupBy("chunk").applyInArrow(join, RESOLVED)


def clustered(chunks: DataFrame, of: np.ndarray, k: int, floor: tuple[int, int], n_groups: int, sweeps: int) -> tuple[DataFrame, np.ndarray, Classes]:
    """Chunks after sweeps over the whole vocabulary, the bigrams of ``Classes.units``, and what reads the chunks' classes.

    Sweeps go on while the likelihood rises, and the best stays.
    """
    c = k + 1 + BANDS
    fold = np.concatenate((np.arange(c), np.arange(k)))
    classes = Classes(of, k, floor)
    best, m = chunks, bigrams(chunks, c + k, k, classes.units)
    for _ in range(sweeps):
        moves = saved(moved(beside(best, classes, n_groups), folded(m, fold), k), "moves")
        now = saved(reclassed(best, moves, classes, n_groups), "classes")
        dropped(moves)
        classes_now = Classes(np.arange(c), k, floor)
        n = bigrams(now, c + k, k, classes_now.units)
        if likelihood(folded(n, fold)) <= likelihood(folded(m, fold)):
            dropped(now)
            break
        dropped(best)
        best, m, classes = now, n, classes_now
    return best, m, classes


def folded(m: np.ndarray, to: np.ndarray) -> np.ndarray:
    out = np.zeros((int(to.max()) + 1,) * 2)
    np.add.at(out, (to[:, None], to[None, :]), m)
    return out


@dataclass(frozen=True)
class Model:
    n: int  # training tokens
    v: int  # distinct ones
    of: np.ndarray  # class of each unit
    step: np.ndarray  # class x class: log-free transition probabilities
    emit: np.ndarray  # of each unit: P(unit's word | class); bands hold a factor for each occurrence or word
    rare: int  # the first band's unit


def model(m: np.ndarray, n: int, v: int, once: list[int], top_counts: np.ndarray, classes: int, sweeps: int, fives: np.ndarray | None = None) -> Model:
    """``once[r]``: words of count r outside the vocabulary, r up to 5; ``fives``: what share of each word class is seen 5 times."""
    t = len(top_counts)
    of = exchange(m, t, classes, sweeps)
    c = int(of.max()) + 1
    to = np.zeros((len(m), c))
    to[np.arange(len(m)), of] = 1
    a = to.T @ m @ to
    # leaving one occurrence out: what was seen r + 1 times stands for what is seen r times
    shift = np.eye(c)
    first = c - BANDS
    many = a[:, c - 1].sum()
    five = min(1.0, 5 * once[5] / many) if many else 0.0
    for r in range(BANDS):
        shift[first + r] = 0
    for r in range(1, BANDS - 1):
        shift[first + r, first + r - 1] = 1
    shift[c - 1, c - 2], shift[c - 1, c - 1] = five, 1 - five
    if fives is not None:
        words = np.arange(len(fives))
        shift[words, words], shift[words, c - 2] = 1 - fives, fives
    a = shift.T @ a @ shift
    share = (a.sum(axis=0) + 1e-3) / (a.sum() + 1e-3 * c)
    strength = 5.0
    step = (a + strength * share) / (a.sum(axis=1, keepdims=True) + strength)
    emit = np.ones(len(m))
    whole = np.bincount(of[:t], top_counts, minlength=c)
    emit[:t] = top_counts / np.maximum(whole[of[:t]], 1)
    for r in range(1, BANDS - 1):
        emit[t + 1 + r] = 1 / max(once[r], 1)
    emit[-1] = 1 / max(many, 1)  # times the word's count
    return Model(n, v, of, step, emit, t + 1)


def scored(chunks: DataFrame, model_: Model, whole: np.ndarray, classes: Classes | None = None) -> DataFrame:
    """``whole``: training tokens of each word class; there a word has the share of its count."""
    last, end = len(model_.emit) - 1, model_.rare - 1
    per = np.ones(last + 1)
    per[: len(whole)] = np.maximum(whole, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                for ids, held, sizes, count, unit in by_documents(*read_chunk(r, classes and classes.words(r)[2])):
                    at = np.cumsum(sizes) - sizes
                    base = (count + 1) / (model_.n + model_.v + 1)
                    word = model_.emit[unit] * np.where((unit == last) | (unit < end), count / per[unit], 1)
                    p = model_.step[model_.of[before(unit, sizes, end)], model_.of[unit]] * word if model_.n else base
                    p = (1 - UNIGRAM) * p + UNIGRAM * base
                    sums = [np.add.reduceat(x, at) for x in ((count > 0).astype(np.int64), np.log10(base), np.log10(p))]
                    none = held & 2 > 0
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, pa.int64(), mask=none), pa.array((held & 1).astype(bool)), pa.array(sizes.astype(np.int64)), pa.array(sums[0]), pa.array(np.full(len(ids), model_.n, np.int64)), pa.array(sums[1]), pa.array(sums[2])],
                        ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                    )

    return chunks.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def class_scores(docs: DataFrame, vocabulary: int | None = None, classes: int = CLASSES, sweeps: int = SWEEPS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Learns from rows whose crc32(doc_id as text) mod 7 is not 2 (without a doc_id: from all). Null and empty texts are the end
    token alone. Repeated rows count as often as they stand and get equal scores. Without training rows both scores are those of an
    empty model. ``vocabulary`` clusters so many words, the most frequent, instead of all seen ``FREQUENT`` times.
    """
    t = texts(docs).withColumn("held", held_out(MOD, REST).cast("int"))
    n_groups = max(16, t.count() // GROUP_DOCS)
    chunks = saved(encoded(t), "encoded")
    wanted = SEED if vocabulary is None else vocabulary
    counts = saved(counted(chunks, n_groups, wanted), "counted")
    sums = counts.filter("chunk = -1").agg(F.sum("n").alias("n"), F.sum("v").alias("v"), *[F.sum(F.get("once", r)).alias(f"r{r}") for r in range(1, 6)]).first()
    n, v = sums["n"] or 0, sums["v"] or 0
    top = counts.filter("chunk = -1").select(F.explode("top").alias("t")).select("t.word", "t.count").orderBy(F.desc("count"), "word").limit(wanted).collect()  # the seed, or the vocabulary asked for
    once = [0, *(sums[f"r{r}"] or 0 for r in range(1, 6))]
    if vocabulary is None:
        floor, top = (FREQUENT - 1, -(1 << 63)), [r for r in top if r["count"] >= FREQUENT]
        once[FREQUENT] = 0
    else:
        floor = (top[-1]["count"], top[-1]["word"]) if top else (1 << 62, 0)
        once = [x - sum(t["count"] == r for t in top) for r, x in enumerate(once)]
    top = top[:SEED]
    words = np.array([r["word"] for r in top], dtype=np.int64).view(U)
    order = np.argsort(words)
    base = chunks.select("chunk", "words", "ids", "held", "sizes", "tokens").withColumn("groups", F.lit(n_groups))
    backs = counts.filter("chunk >= 0").select("p", "chunk", "counts").withColumn("groups", F.lit(n_groups))
    ready = saved(resolved(base, backs, words[order], order), "resolved")
    dropped(chunks)
    dropped(counts)
    m = bigrams(ready, len(words) + 1 + BANDS, len(words))
    # the end is a class of its own and no word of a band
    ends = int(m[:, len(words)].sum())
    if 1 <= ends <= 5 and once[ends]:
        once[ends] -= 1
    of = exchange(m, len(words), classes, sweeps)
    k = int(of.max()) - BANDS
    if not len(words):
        return scored(ready, model(m, n, v, once, np.zeros(0), classes, 0), np.zeros(0))
    ready, m, named = clustered(ready, of, k, floor, n_groups, sweeps)
    a = folded(m, np.concatenate((np.arange(k + 1 + BANDS), np.arange(k))))
    whole = a.sum(axis=0)[:k]
    fives = m.sum(axis=0)[k + 1 + BANDS :] / np.maximum(whole, 1)
    return scored(ready, model(a, n, v, once, whole, k, 0, fives), whole, named)


def op5_brown_score(spark, sf_dir: str) -> DataFrame:
    return class_scores(documents(spark, sf_dir))
