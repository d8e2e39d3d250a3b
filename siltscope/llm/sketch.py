"""A count-min sketch of 64-bit keys with saturating byte counters, dealt out in pieces so that it merges in parallel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
DEPTH = 3
TOP = 255
#: bytes of a piece
PIECE = 1 << 16
#: pieces that travel together
TOGETHER = 16
_ODD = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9))


class CountMin:
    """Counts are never underestimated up to 255, where they stay."""

    def __init__(self, bits: int, table: np.ndarray | None = None) -> None:
        self.bits = bits
        self.table = np.zeros((DEPTH, 1 << bits), dtype=np.uint8) if table is None else table

    def _places(self, keys: np.ndarray) -> list[np.ndarray]:
        return [((keys * odd) >> U(64 - self.bits)).astype(np.int64) for odd in _ODD]

    def add(self, keys: np.ndarray) -> None:
        for row, at in zip(self.table, self._places(keys)):
            one, n = np.unique(at, return_counts=True)
            row[one] = np.minimum(row[one].astype(np.int64) + n, TOP)

    def count(self, keys: np.ndarray) -> np.ndarray:
        return np.minimum.reduce([row[at] for row, at in zip(self.table, self._places(keys))])

    def pieces(self) -> list[tuple[int, bytes]]:
        """The pieces that hold any count."""
        return [p for b in self.batches() for p in b]

    def batches(self) -> Iterator[list[tuple[int, bytes]]]:
        """``pieces``, a few at a time: a task that hands them on holds no second copy of the sketch."""
        flat = self.table.reshape(-1, min(PIECE, 1 << self.bits))
        at = [i for i, x in enumerate(flat) if x.any()]
        for k in range(0, len(at), TOGETHER):
            yield [(i, flat[i].tobytes()) for i in at[k : k + TOGETHER]]

    @staticmethod
    def merge(pieces: list[bytes]) -> bytes:
        total = np.zeros(len(pieces[0]), dtype=np.int64)
        for p in pieces:
            total = np.minimum(total + np.frombuffer(p, np.uint8), TOP)
        return total.astype(np.uint8).tobytes()

    @classmethod
    def of(cls, bits: int, pieces: list[tuple[int, bytes]]) -> "CountMin":
        out = cls(bits)
        flat = out.table.reshape(-1, min(PIECE, 1 << bits))
        for i, p in pieces:
            flat[i] = np.frombuffer(p, np.uint8)
        return out
