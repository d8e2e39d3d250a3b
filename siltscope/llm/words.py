"""Words of whole Arrow batches as 64-bit hashes, without a Python object per word.

A word is a run of bytes that are not blank (0x20, 0x09-0x0D). Each byte stands for a random 64-bit
number, a word's hash is their polynomial in an odd base modulo 2^64, mixed; a run of k words is
hashed from its words' hashes, so blanks between words do not count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(20260801)
BYTE = _rng.integers(1, 2**64 - 1, 256, dtype=U)
#: a second, independent set for 96-bit identities
BYTE2 = _rng.integers(1, 2**64 - 1, 256, dtype=U)
BASE2 = U(0xA0761D6478BD642F)
STEP2 = U(0xE7037ED1A0B428DB)
BASE = U(0x9E3779B97F4A7C15)
STEP = U(0xD1342543DE82EF95)
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x = x ^ (x >> U(27))
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), int(base), dtype=U)
    out[0] = U(1)
    return np.multiply.accumulate(out)


def flat(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row begins; a row more than there are rows. No nulls."""
    arr = arr.cast(pa.large_binary())
    offsets = np.frombuffer(arr.buffers()[1], dtype=np.int64, count=arr.offset + len(arr) + 1)[arr.offset :]
    data = arr.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """Words of a slice: ``start``/``end`` in ``data``, ``hash``, ``doc`` (row), ``first`` (each row's first word, one more than rows)."""

    def __init__(self, arr: pa.Array, lower: bool = False, separators: np.ndarray = BLANK) -> None:
        self.data, offsets = flat(arr)
        self.offsets = offsets
        data = LOWER[self.data] if lower else self.data
        self.text = data
        inside = ~separators[data]
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[offsets] = True
        before = np.zeros(len(data), dtype=bool)
        before[1:] = inside[:-1]
        after = np.zeros(len(data), dtype=bool)
        after[:-1] = inside[1:]
        self.start = np.flatnonzero(inside & (~before | cut[:-1]))
        self.end = np.flatnonzero(inside & (~after | cut[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(arr)), np.diff(self.first))
        n = self.end - self.start
        if len(n):
            at = np.concatenate(([0], np.cumsum(n)[:-1]))
            place = np.arange(int(n.sum())) - np.repeat(at, n)
            self.hash = mix(np.add.reduceat(BYTE[data[inside]] * powers(BASE, int(n.max()))[place], at) + n.astype(U))
            self._again = lambda: mix(np.add.reduceat(BYTE2[data[inside]] * powers(BASE2, int(n.max()))[place], at) + n.astype(U))
        else:
            self.hash = np.empty(0, U)
            self._again = lambda: np.empty(0, U)

    def counts(self) -> np.ndarray:
        """Words of each row."""
        return np.diff(self.first)

    def hash2(self) -> np.ndarray:
        """Hashes of the words that do not depend on ``hash``."""
        return self._again()

    def runs(self, k: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Of every k consecutive words of a row: the index of the first, and the hash (``second``: the independent one)."""
        n = len(self.hash)
        if n < k:
            return np.empty(0, np.int64), np.empty(0, U)
        one, step = (self.hash2(), STEP2) if second else (self.hash, STEP)
        up = powers(int(step), n)
        total = np.concatenate((np.zeros(1, U), np.cumsum(one * up)))
        down = powers(pow(int(step), -1, 2**64), n - k + 1)
        h = mix((total[k:] - total[:-k]) * down + U(k))
        whole = self.doc[: n - k + 1] == self.doc[k - 1 :]
        at = np.flatnonzero(whole)
        return at, h[at]


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """The minimum of every k neighbours."""
    if len(x) < k:
        return x[:0]
    span = 1
    while 2 * span <= k:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = k - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def deal(keys: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """Deal 64-bit keys out to n ranges: (range, indexes of its keys), ranges without keys left out."""
    if not len(keys):
        return []
    to = ((keys >> U(32)) * U(n)) >> U(32)
    order = np.argsort(to, kind="stable")
    to = to[order]
    cuts = np.flatnonzero(np.diff(to)) + 1
    return [(int(to[part[0]]), order[part]) for part in np.split(np.arange(len(order)), cuts)]


def group_starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination of values begins in sorted columns."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)
