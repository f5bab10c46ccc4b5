"""PartEnum signatures of hashed sets: two sets that reach a Jaccard threshold share one. Module grainmill.llm.partenum tells how."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.functions.hashed import Scan, mix, shingles

_U = np.uint64
RATIO = 1.4
_SEED = np.random.default_rng(5).integers(1, 2**63, 4, dtype=np.uint64)


class Bands:
    """The instances for a threshold in percent."""

    def __init__(self, percent: int, most: int = 1 << 33):
        self.percent = percent
        edges = [1]
        while edges[-1] < most:
            edges.append(max(edges[-1] + 1, int(edges[-1] * RATIO)))
        self.edges = np.array(edges, np.int64)
        self.k = 2 * (self.edges[1:] - 1) * (100 - percent) // (100 + percent)  # features in which two sets of an instance may differ
        self.parts = np.array([self._parts(int(k), int(e) * percent / 100) for k, e in zip(self.k, self.edges[:-1], strict=True)], np.int64)

    @staticmethod
    def _parts(k: int, least: float) -> int:
        """The fewest parts that leave sets of the least size more than k non-empty ones, by three standard deviations where that can be."""
        if k == 0:
            return 1
        m = k + 1
        while m < 3 * k + 3:
            empty = np.exp(-least / m)
            if m * (1 - empty) - 3 * np.sqrt(m * empty * (1 - (1 + least / m) * empty)) > k:
                break
            m += max(1, m // 200)
        return m

    def instances(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each size: the first and last instance."""
        return np.searchsorted(self.edges, sizes, "right") - 1, np.searchsorted(self.edges, sizes * 100 // self.percent, "right") - 1


def totals(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The sums modulo 2**64 of runs of so many values."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    ends = np.cumsum(size)
    return sums[ends] - sums[ends - size]


def keys(features: np.ndarray, size: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set, the first of so many bits."""
    n = size.astype(np.uint64)
    one, two = (mix(totals(mix(features + seed), size) + n) for seed in (_SEED[0], _SEED[2]))
    return (one >> _U(64 - bits)).view(np.int64), two.view(np.int64)


def classes_of(features: np.ndarray, size: np.ndarray, shared: np.ndarray, bits: int = 64) -> np.ndarray:
    """The class of each set: its first hash, or both for those that different sets are known to share."""
    one, two = keys(features, size, bits)
    return np.where(np.isin(one, shared), mix(one.view(np.uint64) + mix(two.view(np.uint64))).view(np.int64), one) if len(shared) else one


def collisions(hashed: DataFrame) -> np.ndarray:
    """The first hashes (c) that sets of different second hashes (c2) share: at n different sets about n**2 / 2**65."""
    odd = hashed.groupBy("c").agg(F.min("c2").alias("x"), F.max("c2").alias("y")).filter("x <> y").select("c")
    return odd.toArrow().column("c").to_numpy()


def sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature) pairs in order, and the size of each row's set."""
    scan = Scan(column, lower=True)
    owner, features = shingles(scan.words(), scan.doc, scan.rows, words)
    return owner, features, np.bincount(owner, minlength=scan.rows)


def signatures(owner: np.ndarray, features: np.ndarray, size: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of the k + 1 parts of each set with the most features, over its instances.

    Two sets that differ in at most k features have all parts but k in common, empty ones included. Of as many parts in one
    order for all sets, here by features and then by signature, their first k + 1 share one then (the prefix filter). Parts
    of one feature or none, which many unlike sets have in common, come last.
    """
    first, last = bands.instances(size)
    rows, signs = [], []
    for step in range(int((last - first).max(initial=0)) + 1):
        instance = first + step
        use = (size > 0) & (instance <= last)
        use &= bands.k[np.minimum(instance, len(bands.k) - 1)] > 0  # else only equal sets match
        if not use.any():
            continue
        parts = np.where(use, bands.parts[np.minimum(instance, len(bands.k) - 1)], 0)
        base = np.cumsum(parts) - parts
        mine = use[owner]
        who, what = owner[mine], mix(features[mine] + instance[owner[mine]].astype(np.uint64) * _SEED[1])
        part = ((what >> _U(32)) * parts[who].astype(np.uint64)) >> _U(32)
        slot = base[who] + part.astype(np.int64)
        total = np.zeros(int(parts.sum()), np.uint64)
        np.add.at(total, slot, mix(what + _SEED[2]))
        row = np.repeat(np.arange(len(size)), parts)
        number = np.arange(len(total)) - base[row]
        sign = mix(total + mix(number.astype(np.uint64) + instance[row].astype(np.uint64) * _SEED[3]))
        order = np.lexsort((sign, -np.bincount(slot, minlength=len(total)), row))  # rows stay in place, so number is the rank within a row
        out = number <= bands.k[np.minimum(instance, len(bands.k) - 1)][row]
        rows.append(row[out])
        signs.append(sign[order[out]])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(signs)


def sketches(owner: np.ndarray, features: np.ndarray, rows: int, bits: int) -> list[bytes]:
    """Parity bitmaps of so many bits a set."""
    at = owner * bits + (mix(features + _SEED[1]) % _U(bits)).astype(np.int64)
    flags = (np.bincount(at, minlength=rows * bits) & 1).astype(np.uint8).reshape(rows, bits)
    return [x.tobytes() for x in np.packbits(flags, axis=1)]


def bound(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Features in which sets of these sizes may differ, or -1 where the sizes alone rule the pair out."""
    far = (a + b) * (100 - percent) // (100 + percent)
    return np.where(100 * np.minimum(a, b) >= percent * np.maximum(a, b), far, -1)


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by sig and c, those whose signature two classes or more share, with the least as leader.

    Between batches only the leader and the last class of the run that may go on are held, however long it is.
    """
    run: tuple[int, int, int, bool] | None = None  # signature, leader, last class, and whether the leader is out
    for batch in batches:
        sig, c = (batch.column(k).to_numpy() for k in range(2))
        if not len(sig):
            continue
        before = (run[0], run[2]) if run else (~sig[0], c[0])
        new = np.append(True, (sig[1:] != sig[:-1]) | (c[1:] != c[:-1]))
        new[0] = (sig[0], c[0]) != before
        sig, c = sig[new], c[new]
        if not len(sig):
            continue
        on = run is not None and sig[0] == run[0]
        waiting = on and not run[3]
        if waiting:
            sig, c = np.append(run[0], sig), np.append(run[1], c)
        start = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        length = np.diff(np.append(start, len(sig)))
        lead = c[start]
        out = length > 1
        if on:
            lead[0], out[0] = run[1], True
        run = int(sig[-1]), int(lead[-1]), int(c[-1]), bool(out[-1])
        keep = np.repeat(out, length)
        yield pa.RecordBatch.from_pydict({"sig": sig[keep], "c": c[keep], "leader": np.repeat(lead, length)[keep]})
