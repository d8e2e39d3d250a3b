"""A cuckoo filter that keeps its keys: membership with insertion, deletion and growth."""

from __future__ import annotations

SLOTS = 4
KICKS = 200
MASK = 0xFFFFFFFFFFFFFFFF


def _mix(x: int) -> int:
    x = ((x ^ (x >> 31)) * 0x7FB5D329728EA185) & MASK
    x = ((x ^ (x >> 27)) * 0x81DADEF4BC2DD44D) & MASK
    return x ^ (x >> 33)


class CuckooFilter:
    """16-bit fingerprints in buckets of four. A key has two buckets; the second follows from the first and the
    fingerprint, so that an entry can move without its key. The keys of live entries are stored: when an insertion
    finds no room, the table doubles and is filled anew from them. ``key in filter`` may be wrong only by saying yes.
    """

    def __init__(self, room: int = 1024) -> None:
        self.keys: dict[int, int] = {}
        self.grown = 0
        self._clear(max(2, 1 << max(1, (max(room, 1) * 5 // (4 * SLOTS) - 1).bit_length())))

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.table: list[list[int]] = [[] for _ in range(buckets)]

    def _places(self, key: int) -> tuple[int, int, int]:
        x = _mix(key & MASK)
        mark = (x >> 48) or 1
        first = x & self.mask
        return mark, first, first ^ (_mix(mark) & self.mask)

    def __contains__(self, key: int) -> bool:
        mark, a, b = self._places(key)
        return mark in self.table[a] or mark in self.table[b]

    def __len__(self) -> int:
        return sum(self.keys.values())

    def insert(self, key: int) -> None:
        self.keys[key] = self.keys.get(key, 0) + 1
        if self.keys[key] == 1 and not self._place(key):
            self._grow()

    def delete(self, key: int) -> bool:
        """Take a live key out; false if it is not live."""
        left = self.keys.get(key, 0) - 1
        if left < 0:
            return False
        if left:
            self.keys[key] = left
            return True
        del self.keys[key]
        mark, a, b = self._places(key)
        (self.table[a] if mark in self.table[a] else self.table[b]).remove(mark)
        return True

    def _place(self, key: int) -> bool:
        mark, a, b = self._places(key)
        for at in (a, b):
            if len(self.table[at]) < SLOTS:
                self.table[at].append(mark)
                return True
        at = a
        for kick in range(KICKS):
            bucket = self.table[at]
            i = (mark + kick) % SLOTS
            mark, bucket[i] = bucket[i], mark
            at ^= _mix(mark) & self.mask
            if len(self.table[at]) < SLOTS:
                self.table[at].append(mark)
                return True
        return False

    def _grow(self) -> None:
        while True:
            self.grown += 1
            self._clear(2 * (self.mask + 1))
            if all(self._place(k) for k in self.keys):
                return
