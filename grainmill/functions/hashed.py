"""Words, hashes and windows of a whole batch of texts at once, in numpy over the UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from grainmill.functions.batches import utf8

_U = np.uint64
_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_Q = _U(0xD6E8FEB86659FD93)
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _P and of its inverse, up to n."""
    if len(_tables.get("up", ())) < n:
        n = max(n, 1 << 20)
        for name, base in (("up", _P), ("down", pow(_P, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _tables[name] = np.cumprod(steps, dtype=np.uint64)
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Scan:
    """The words [^\\x20\\x09-\\x0D]+ of each text of a column, as positions in its bytes.

    data, offsets: the bytes (A-Z lower-cased if asked) and where each text starts; doc, start, end: of
    each word the row, first byte and byte after the last.
    """

    def __init__(self, column: pa.Array, lower: bool = False):
        raw, self.offsets = utf8(column)
        self.raw, self.data, self.rows = raw, LOWER[raw] if lower else raw, len(column)
        self.inside = ~SPACE[raw]
        n, cut = len(raw), self.offsets[:-1][self.offsets[:-1] < len(raw)]
        before = np.zeros(n + 1, bool)
        before[1:] = self.inside
        after = before[1:].copy()
        after[:-1], after[-1:] = self.inside[1:], False
        before = before[:n]
        before[cut] = False
        after[cut[cut > 0] - 1] = False
        self.start = np.flatnonzero(self.inside & ~before)
        self.end = np.flatnonzero(self.inside & ~after) + 1
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1
        self._sums: np.ndarray | None = None

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.rows)

    def per_doc(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text are marked."""
        sums = np.concatenate(([0], np.cumsum(mask)))
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges, the same wherever the bytes stand."""
        up, down = _powers(len(self.data) + 1)
        if self._sums is None:
            self._sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[self.data] * up[: len(self.data)], dtype=np.uint64)))
        return mix((self._sums[end] - self._sums[start]) * down[start] + (end - start).astype(np.uint64))

    def words(self) -> np.ndarray:
        return self.hashes(self.start, self.end)


def windows(words: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of each run of so many words that lies in one text."""
    if len(words) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(words) - size + 1
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = total * _Q + words[k : k + n]
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    return mix(total[at]), at


def shingles(words: np.ndarray, doc: np.ndarray, rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct windows of each text, by row and hash; a text of fewer words has its whole sequence as one, an empty text none."""
    hashes, at = windows(words, doc, size)
    counts = np.bincount(doc, minlength=rows)
    short = np.flatnonzero((counts > 0) & (counts < size))
    owner = doc[at]
    if len(short):
        first = np.searchsorted(doc, short)
        total = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            there = k < counts[short]
            total[there] = total[there] * _Q + words[first[there] + k]
        owner = np.concatenate((owner, short))
        hashes = np.concatenate((hashes, mix(total + counts[short].astype(np.uint64) * _U(_P))))
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return owner[new], hashes[new]
