"""Token ids of whole texts with a public tokenizer, fast enough to be read once per corpus."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from siltscope.llm.words import BASE, BLANK, BYTE, U, flat, mix, powers

#: units kept per worker; the cache starts anew beyond it
UNITS = 1_200_000
_open: dict[str, "Encoder"] = {}

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_STOP = np.zeros(256, dtype=bool)  # ASCII signs that never join a word; the apostrophe may
_STOP[[b for b in range(0x21, 0x7F) if not (chr(b).isalnum() or chr(b) == "'")]] = True


def encoder(path: str) -> "Encoder":
    """The worker's encoder of a vocabulary file; workers are reused, and so is its cache."""
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]


class Encoder:
    """Encodes texts to 32-bit ids, special tokens' strings being ordinary text.

    A byte-level vocabulary first splits a text by a pattern of letters, digits, signs and blanks. Some of the places
    where it splits are seen from two neighbouring bytes; units between such places are encoded once and
    remembered under a 64-bit hash. Texts with other than ASCII blanks, and other kinds of vocabulary, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.encode_special_tokens = True
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_unit = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and spec["model"]["type"] == "BPE"
        vocab = self.tokenizer.get_vocab()
        self.blank = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.blank[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        self._forget()

    def _forget(self) -> None:
        self.keys = np.empty(0, U)
        self.at = np.empty(0, np.int64)
        self.size = np.empty(0, np.int64)
        self.pool = np.empty(0, np.uint32)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where a unit begins: before a single blank, a sign after a letter, a line end after a visible byte, and the
        word after a single line end."""
        n = len(data)
        blank = BLANK[data]
        first = np.zeros(n + 1, dtype=bool)
        first[offsets] = True
        first = first[:-1]
        p_blank = np.ones(n, dtype=bool)  # a text's start counts as a blank, so that nothing is cut beyond it
        p_blank[1:] = blank[:-1]
        p_blank |= first
        n_blank = np.ones(n, dtype=bool)
        n_blank[:-1] = blank[1:]
        n_blank[:-1] |= first[1:]
        prev = np.zeros(n, dtype=np.uint8)
        prev[1:] = data[:-1]
        pp_blank = np.ones(n, dtype=bool)
        pp_blank[1:] = p_blank[:-1]
        pp_blank[1:] |= first[:-1]
        space, line = data == 0x20, data == 0x0A
        return (
            first
            | (space & (~p_blank | ~n_blank))
            | (_STOP[data] & _LETTER[prev])
            | (line & ~p_blank & (prev < 0x80))
            | ((prev == 0x0A) & ~pp_blank & _LETTER[data])
        )

    def _learn(self, units: list[str], hashes: np.ndarray) -> None:
        words = [i for i, u in enumerate(units) if u[0] == " " and u[1:].isalpha()]
        ids: list[np.ndarray] = [None] * len(units)  # type: ignore[list-item]
        if words:
            joined = np.array(self.tokenizer.encode_batch_fast(["".join([units[i] for i in words])], add_special_tokens=False)[0].ids, dtype=np.uint32)
            starts = np.flatnonzero(self.blank[joined])
            if len(starts) == len(words):  # each unit begins at a token that begins with a blank
                for i, a, b in zip(words, starts.tolist(), [*starts[1:].tolist(), len(joined)]):
                    ids[i] = joined[a:b]
            else:
                words = []
        rest = [i for i, x in enumerate(ids) if x is None]
        for i, part in zip(rest, self.whole([units[i] for i in rest])):
            ids[i] = part
        size = np.array([len(x) for x in ids], dtype=np.int64)
        at = len(self.pool) + np.cumsum(size) - size
        self.pool = np.concatenate((self.pool, *ids))
        to = np.searchsorted(self.keys, hashes)
        self.keys, self.at, self.size = np.insert(self.keys, to, hashes), np.insert(self.at, to, at), np.insert(self.size, to, size)

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a column without nulls."""
        if not self.by_unit or not len(column):
            return self.whole(column.to_pylist())
        if len(self.keys) > UNITS:
            self._forget()
        data, offsets = flat(column)
        if not len(data):
            return [np.empty(0, np.uint32)] * len(column)
        starts = np.flatnonzero(self.cuts(data, offsets))
        n = np.diff(np.append(starts, len(data)))
        place = np.arange(len(data)) - np.repeat(starts, n)
        h = mix(np.add.reduceat(BYTE[data] * powers(BASE, int(n.max()))[place], starts) + n.astype(U))
        keys, one, which = np.unique(h, return_index=True, return_inverse=True)
        to = np.searchsorted(self.keys, keys)
        found = np.zeros(len(keys), dtype=bool)
        if len(self.keys):
            found = self.keys[np.minimum(to, len(self.keys) - 1)] == keys
        new = np.flatnonzero(~found)
        if len(new):
            raw = data.tobytes()
            a = starts[one[new]]
            self._learn([raw[x:y].decode(errors="replace") for x, y in zip(a.tolist(), (a + n[one[new]]).tolist())], keys[new])
            to = np.searchsorted(self.keys, keys)
        size, at = self.size[to][which], self.at[to][which]
        end = np.cumsum(size)
        ids = self.pool[np.arange(int(end[-1])) - np.repeat(end - size - at, size)]
        of = np.concatenate((np.zeros(1, np.int64), end))[np.searchsorted(starts, offsets)]
        out = [ids[a:b] for a, b in zip(of[:-1], of[1:])]
        # blanks beyond ASCII: U+0085, U+00A0, and lead bytes of U+1680, U+2000-206F, U+3000
        nxt = np.zeros(len(data), dtype=np.uint8)
        nxt[:-1] = data[1:]
        odd = ((data == 0xC2) & ((nxt == 0xA0) | (nxt == 0x85))) | ((data == 0xE1) & (nxt == 0x9A)) | ((data == 0xE2) & ((nxt == 0x80) | (nxt == 0x81))) | ((data == 0xE3) & (nxt == 0x80))
        if odd.any():
            rows = np.unique(np.searchsorted(offsets, np.flatnonzero(odd), side="right") - 1).tolist()
            for i, x in zip(rows, self.whole([column[i].as_py() for i in rows])):
                out[i] = x
        return out
