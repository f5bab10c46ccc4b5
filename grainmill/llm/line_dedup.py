"""Line dedup by an exact set-similarity join.

A line is its set of lower-cased words. Lines are ordered by doc_id, place in the text and class; a line is removed if an
earlier line, removed itself or not, reaches the Jaccard threshold. Lines of fewer than `least` distinct words, blank ones
among them, stay and remove nothing; with a `least` of 1 every line with a word counts.

Equal sets are one class, known by its first line. The words of a class are ordered by rarity, from counts over all
documents. Two sets that reach the threshold share a word among their first few (the prefix); words that occur once can't
be it. Classes that share such a word are candidates if sizes (length filter), places of the word (positional filter) and a
parity sketch, whose differing bits never outnumber the differing words, allow it; exact Jaccard on the lines' words decides.
The sketch has 64 bits, or 256 between lines of LONG words and more, where random lines fill 64 bits. As one earlier match is
enough, one exchange finds the WIDTH earliest candidates of a class at each word, a class is decided against the first of
each, and only if none matches against the others. Classes that have more candidates and no match yet go on, with 64 times
as many, until all are used up; of the others only the cells of those are moved again. So a group of g near copies costs
about g comparisons. A word of more than BLOCK classes is dealt out in pairs of blocks.

Words are 64-bit hashes; a class is known by a 64-bit hash of its set, or by two where a second one shows that different
sets share the first. Null texts stay null; a row without a doc_id counts as one of the least doc_id. Identical rows (doc_id
and text) are one document. A line of any length is one set. An empty table gives an empty result. All other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import bitmap, chunks, dropped, marked, released, trimmed, written
from grainmill.llm.partenum import collisions, totals
from grainmill.llm.words import Scan, mix

LEAST, PERCENT, RARITY_BITS = 1, 80, 23
BLOCK = 8192  # classes of a word that a task compares at once, or twice as many for a pair of blocks
LONG = 64  # distinct words from which on a line has the wider sketch
WIDTH = 16  # candidates of a class at a word that the first exchange finds
GROUP = 1 << 18  # postings of the cells that a task holds at once, or those of one cell
SMALL = 512  # classes of a word whose pairs of like size are all compared, for many words at once
CHUNK = 1 << 19  # bytes of text that are handled at once: arrays of this size are used again, not mapped anew
_U = np.uint64
_WIDE = ("wide_0", "wide_1", "wide_2")
_SLOTS = 1 << 13  # counters that travel together


def split_lines(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The lines of each text, their rows and their places."""
    lists = pc.split_pattern(column.fill_null("").cast(pa.large_string()), "\n")
    parent = pc.list_parent_indices(lists).to_numpy()
    first = np.searchsorted(parent, np.arange(len(column)))
    return lists.flatten(), parent, np.arange(len(parent)) - first[parent]


def _count(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        for batch in chunks(batches, most=CHUNK):
            slots = (Scan(batch.column("text"), lower=True).words() & _U((1 << bits) - 1)).astype(np.int64)
            np.add.at(counts, slots, np.uint32(1))  # of the same type: else numpy takes tens of times as long
        parts = counts.reshape(-1, min(_SLOTS, 1 << bits))
        most = parts.max(1)
        for few, kind in ((most < 1 << 16, np.uint16), (most >= 1 << 16, np.uint32)):  # in half the bytes where they fit
            use = np.flatnonzero(few & (most > 0))
            for at in range(0, len(use), 64):
                which = use[at : at + 64]
                yield pa.RecordBatch.from_pydict({"part": pa.array(which, pa.int32()), "wide": pa.array([kind is np.uint32] * len(which)), "counts": pa.array([parts[k].astype(kind).tobytes() for k in which], pa.binary())})

    return run


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The summed counters of each part as levels; rows sorted by part."""

    def out(part: int, total: np.ndarray) -> pa.RecordBatch:
        level = np.minimum(255, 2 + np.floor(8 * np.log2(np.maximum(total, 2) / 2))).astype(np.uint8)
        level[total < 2] = total[total < 2]
        return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "levels": pa.array([level.tobytes()], pa.binary())})

    now, total = None, None
    for batch in batches:
        for part, wide, counts in zip(*(batch.column(k).to_pylist() for k in ("part", "wide", "counts")), strict=True):
            own = np.frombuffer(counts, np.uint32 if wide else np.uint16).astype(np.uint64)
            if part == now:
                total += own
            else:
                if now is not None:
                    yield out(now, total)
                now, total = part, own
    if now is not None:
        yield out(now, total)


def rarity(docs: DataFrame, bits: int = RARITY_BITS) -> np.ndarray:
    """Of each slot of word hashes, how frequent its words are in all documents: 0 none, 1 once, from 2 on eighths of an octave.

    The counts are exact by slot; words that share one look more frequent than they are, which only changes the order
    (the same for all lines). The driver and each executor hold 2**bits bytes, whatever the input.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = docs.select("text").mapInArrow(_count(bits), "part int, wide boolean, counts binary").repartition(parts, "part").sortWithinPartitions("part")
    table = counts.mapInArrow(_levels, "part int, levels binary").toArrow()  # 2**bits bytes at most
    levels = np.zeros(1 << bits, np.uint8)
    for part, own in zip(table.column("part").to_pylist(), table.column("levels").to_pylist(), strict=True):
        levels[part * len(own) : (part + 1) * len(own)] = np.frombuffer(own, np.uint8)
    return levels


def _hashed(words: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = size.astype(np.uint64)
    return tuple(mix(totals(mix(words + _U(seed)), size) + n).view(np.int64) for seed in (0, 0xA5A5A5A5A5A5A5A5))


def _named(one: np.ndarray, two: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """The classes: the first hash, or both for those that different sets are known to share."""
    return np.where(np.isin(one, shared), mix(one.view(np.uint64) + mix(two.view(np.uint64))).view(np.int64), one) if len(shared) else one


def _distinct(lines: pa.Array, levels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, word, key) of the distinct words of each line, by line and by key: the word's hash, or with levels its rarity and hash."""
    scan = Scan(lines, lower=True)
    words, owner = scan.words(), scan.doc
    key = words
    if levels is not None:
        key = (levels[(words & _U(len(levels) - 1)).astype(np.int64)].astype(np.uint64) << _U(56)) | (words >> _U(8))
    # the words come by line: one sort by line and the upper bits of the key, by both where these don't tell keys apart
    left = _U(64 - int(owner[-1]).bit_length() if len(owner) else 64)
    one = (owner.astype(np.uint64) << left) | (key >> (_U(64) - left)) if left < 64 else key
    by = np.argsort(one)
    same = one[by[1:]] == one[by[:-1]]
    if (key[by[1:]][same] != key[by[:-1]][same]).any():
        by = np.lexsort((key, owner))
    owner, key, words = owner[by], key[by], words[by]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])
    return owner[new], words[new], key[new]


def _measure(shared, least: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        # a task sends a class to the join once, and again for an earlier line, so copies don't fill the exchange
        seen: dict[int, list[int]] = {}
        for batch in chunks(batches, most=CHUNK):
            lines, parent, place = split_lines(batch.column("text"))
            owner, words, key = _distinct(lines, levels)
            size = np.bincount(owner, minlength=len(lines))
            cls, second = _hashed(words, size)
            sketch = np.zeros(len(lines), np.uint64)
            np.bitwise_xor.at(sketch, owner, _U(1) << (words & _U(63)))
            wide = [np.zeros(len(lines), np.uint64) for _ in range(3)]  # the fourth part is what they leave of the sketch
            big = np.flatnonzero(size[owner] >= LONG)
            part = (words[big] >> _U(6)) & _U(3)
            for k, own in enumerate(wide):
                of = big[part == _U(k)]
                np.bitwise_xor.at(own, owner[of], _U(1) << (words[of] & _U(63)))
            use = np.flatnonzero((size >= least) & (size > 0))
            new = np.zeros(len(use), bool)
            doc = batch.column("doc_id").fill_null(-(1 << 63)).to_numpy()[parent[use]]
            for k, (c, *here) in enumerate(zip(cls[use].tolist(), doc.tolist(), place[use].tolist(), strict=True)):
                if c not in seen or here < seen[c]:
                    seen[c] = here
                    new[k] = True
            if len(seen) > 250_000:  # some 70 MB
                seen.clear()
            n = size[use]
            length = n - (percent * n + 99) // 100 + 1
            length[100 * n < percent * (n + 1)] = 0  # a set so small is near to equal ones alone, its class
            length[~new] = 0
            ends = np.cumsum(length)
            at = np.arange(ends[-1] if len(ends) else 0)
            first = (np.cumsum(size) - size)[use]
            keys = key[np.repeat(first - ends + length, length) + at]
            keep = keys >> _U(56) > _U(1)  # no other line has a word that occurs once
            which, spot = np.repeat(np.arange(len(use)), length)[keep], (at - np.repeat(ends - length, length) + 1)[keep]
            # the low bits give way to the place of the word, 255 for all from there on, which only weakens the filter
            keys = (keys[keep] & ~_U(255)) | np.minimum(spot, 255).astype(np.uint64)
            bounds = np.append(0, np.cumsum(np.bincount(which, minlength=len(use))))
            rows = pa.array(parent[use])
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id").take(rows), "row": batch.column("row").take(rows), "place": pa.array(place[use], pa.int32()), "c": cls[use], "c2": second[use],
                    "n": pa.array(n, pa.int32()), "sketch": sketch[use].view(np.int64),
                    **{name: own[use].view(np.int64) for name, own in zip(_WIDE, wide, strict=True)}, "prefix": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(keys.view(np.int64))),
                }
            )

    return run


def _allowed(n, at, m, to, differ, percent: int) -> np.ndarray:
    """Which pairs of sizes n, m with the word at these places (from 1) the length, positional and sketch filters let through."""
    total = n + m
    need = -(-percent * total // (100 + percent))
    fit = 1 + np.minimum(np.where(at < 255, n - at, n), np.where(to < 255, m - to, m)) >= need
    return fit & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (np.bitwise_count(differ.view(np.uint64)) <= total - 2 * need)


def _alike(n, m, differ, parts, percent: int) -> np.ndarray:
    """Which pairs of sizes n, m the wider sketch lets through, by the differing bits of the narrow one and of the wider one's parts; all with a short line."""
    total = n + m
    last = differ.copy()
    for p in parts:
        last ^= p
    bits = sum(np.bitwise_count(p.view(np.uint64)).astype(np.int64) for p in (*parts, last))
    return (np.minimum(n, m) < LONG) | (bits <= total - 2 * -(-percent * total // (100 + percent)))


_ROW = ("cell", "doc", "place", "c", "shape", "sketch", "open", *_WIDE)  # shape: size and, in 8 bits, place of the word
_PLANES = 48  # bytes of a packed row: cell, doc, place with the open flag, c, shape and sketch


def _packed(rows: list[np.ndarray], cells: np.ndarray, shape: np.ndarray, of: np.ndarray, groups: int) -> pa.RecordBatch:
    """Postings as one block of bytes for each group of cells: all first bytes, all second ones and so on, without those that are zero.

    rows: doc, place, c, sketch, open and the wide sketch of each line; of: each posting's line.
    """
    doc, place, c, sketch, open_, *wide = rows
    place = (place << 1) | open_
    # by group and then by the upper bytes of the cell, which so repeat
    group = mix(cells.view(np.uint64)) % _U(groups)
    by = np.argsort((group << _U(40)) | (cells.view(np.uint64) >> _U(24)) if groups < 1 << 24 else group)
    group = group[by].astype(np.int64)
    start = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(by) else np.zeros(0, np.int64)
    ends, blocks, at = np.append(start[1:], len(by)), [], 0
    while at < len(start):  # many groups at once, but few postings
        to = max(at + 1, int(np.searchsorted(ends, start[at] + (1 << 15), "right")))
        here = by[start[at] : ends[to - 1]]
        line = of[here]
        table = np.stack([cells[here], doc[line], place[line], c[line], shape[here], sketch[line]], axis=1)
        large = np.stack([w[line] for w in wide], axis=1)
        long_ = table[:, 4] >> 8 >= LONG
        for k in range(at, to):
            own = slice(start[k] - start[at], ends[k] - start[at])
            planes = np.ascontiguousarray(table[own].view(np.uint8).T)
            used = planes.any(1)
            blocks.append(b"".join((np.packbits(used).tobytes(), planes.shape[1].to_bytes(4, "little"), planes[used].tobytes(), large[own][long_[own]].tobytes())))
        at = to
    return pa.RecordBatch.from_pydict({"group": pa.array(group[start], pa.int32()), "block": pa.array(blocks, pa.binary())})


def _unpacked(block: bytes) -> list[np.ndarray]:
    """The columns _ROW of a block."""
    head = _PLANES // 8
    used, n = np.unpackbits(np.frombuffer(block, np.uint8, head)) > 0, int.from_bytes(block[head : head + 4], "little")
    planes = np.zeros((_PLANES, n), np.uint8)
    own = int(used.sum()) * n
    planes[used] = np.frombuffer(block, np.uint8, own, head + 4).reshape(-1, n)
    cell, doc, place, c, shape, sketch = np.ascontiguousarray(planes.T).view(np.int64).T
    wide = np.zeros((n, len(_WIDE)), np.int64)
    wide[shape >> 8 >= LONG] = np.frombuffer(block, np.int64, -1, head + 4 + own).reshape(-1, len(_WIDE)) if len(block) > head + 4 + own else 0
    return [cell, doc, place >> 1, c, shape, sketch, (place & 1) > 0, *wide.T]


def _gathered(parts: Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]], groups: int, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """(group, block) of postings that come as arguments of _packed(), so many at once."""

    def out() -> pa.RecordBatch:
        ends = np.cumsum([0, *(len(h[0][0]) for h in held)])
        of = np.concatenate([h[3] + np.int32(e) for h, e in zip(held, ends, strict=False)])
        return _packed([np.concatenate(x) for x in zip(*(h[0] for h in held), strict=True)], np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]), of, groups)

    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[1])
        if n >= most:
            yield out()
            held, n = [], 0
    if n:
        yield out()
    held.clear()
    trimmed()


def _pack_rows(groups: int):
    """(group, block) of rows with the columns _ROW."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in batches:
                cell, doc, place, c, shape, sketch, open_, *wide = (batch.column(k).to_numpy(zero_copy_only=False) for k in _ROW)
                yield [doc, place, c, sketch, open_, *wide], cell, shape, np.arange(len(cell), dtype=np.int32)

        return _gathered(parts(), groups)

    return run


def _pack_lines(groups: int, often: np.ndarray, blocks: np.ndarray):
    """(group, block) of the postings of lines, all open; the frequent words (sorted) are dealt out in pairs of so many blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in batches:
                doc, place, c, size, sketch, *wide = (batch.column(k).fill_null(-(1 << 63) if k == "doc_id" else 0).to_numpy() for k in ("doc_id", "place", "c", "n", "sketch", *_WIDE))
                rows = [doc, place.astype(np.int64), c, sketch, np.ones(len(c), bool), *wide]
                prefix = batch.column("prefix")
                of, word = pc.list_parent_indices(prefix).to_numpy().astype(np.int32), prefix.flatten().to_numpy()
                cell, shape = word & ~255, (size.astype(np.int64)[of] << 8) | (word & 255)
                spot = np.minimum(np.searchsorted(often, cell), max(len(often) - 1, 0))
                split = often[spot] == cell if len(often) else np.zeros(len(cell), bool)
                yield rows, cell[~split], shape[~split], of[~split]
                left = np.flatnonzero(split)
                while len(left):
                    ends = np.cumsum(blocks[spot[left]])
                    some = max(1, int(np.searchsorted(ends, 1 << 18, "right")))
                    here, left = left[:some], left[some:]
                    times = blocks[spot[here]]
                    other = np.arange(ends[some - 1]) - np.repeat(ends[:some] - times, times)
                    own = np.repeat((mix(c[of[here]].view(np.uint64)) % times.astype(np.uint64)).astype(np.int64), times)
                    pair = (np.minimum(own, other) << 32) | np.maximum(own, other)
                    cells = mix(np.repeat(cell[here], times).view(np.uint64) + mix(pair.view(np.uint64) + _U(1))).view(np.int64)
                    yield rows, cells, np.repeat(shape[here], times), np.repeat(of[here], times)

        return _gathered(parts(), groups)

    return run


def _cells(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[list[np.ndarray]]:
    """Whole cells, many at once, of blocks sorted by group."""

    def out(held: list[bytes]) -> Iterator[list[np.ndarray]]:
        parts = [np.concatenate(x) for x in zip(*map(_unpacked, held), strict=True)]
        by = np.argsort(parts[0])
        cell = parts[0][by]
        ends, at = np.append(np.flatnonzero(cell[1:] != cell[:-1]) + 1, len(cell)), 0
        while at < len(cell):
            to = int(ends[np.searchsorted(ends, min(at + rows, len(cell)))])  # a cell may be longer than that
            yield [x[by[at:to]] for x in parts]
            at = to

    now, held = None, []
    for batch in batches:
        for group, block in zip(batch.column("group").to_pylist(), batch.column("block"), strict=True):
            if group != now and held:
                yield from out(held)
                held = []
            now = group
            held.append(block.as_py())
    if held:
        yield from out(held)
    held.clear()
    trimmed()


def _earliest_first(part: list[np.ndarray]) -> list[np.ndarray]:
    """Rows that come by cell, by cell, doc, place and class, with the earliest line of a class in each cell."""
    cell, doc, place, c = part[:4]
    number = np.append(0, np.cumsum(cell[1:] != cell[:-1]))
    low, bits = int(doc.min()), [int(x).bit_length() for x in (number[-1], int(doc.max()) - int(doc.min()), place.max())]
    by = None
    if sum(bits) < 64:  # one sort does where the three fit a number and tell the lines apart
        one = (number << (bits[1] + bits[2])) | ((doc - low) << bits[2]) | place
        by = np.argsort(one)
        same = one[by[1:]] == one[by[:-1]]
        if (c[by[1:]][same] != c[by[:-1]][same]).any():
            by = None
    by = np.lexsort((c, place, doc, cell)) if by is None else by
    part = [x[by] for x in part]
    where = np.cumsum(np.append(0, part[0][1:] != part[0][:-1])).astype(np.uint64)
    mark = mix(part[3].view(np.uint64) + mix(where))
    by = np.argsort(mark, kind="stable")
    again = (mark[by[1:]] == mark[by[:-1]]) & (where[by[1:]] == where[by[:-1]]) & (part[3][by[1:]] == part[3][by[:-1]])
    new = np.ones(len(mark), bool)
    new[by[1:][again]] = False
    return [x[new] for x in part]


def _near(percent: int, width: int):
    """(a, b, later, more): for each open class b of a cell its `width` earliest candidates, whether a is a later one than the first, and whether b has others."""

    def passing(i, j, n, at, sketch, wide) -> np.ndarray:
        """Which of the pairs (i, j) all filters let through, as places in i."""
        total = n[i] + n[j]
        ok = np.flatnonzero(np.bitwise_count((sketch[i] ^ sketch[j]).view(np.uint64)) <= total - 2 * -(-percent * total // (100 + percent)))  # most fail by this
        i, j = i[ok], j if np.ndim(j) == 0 else j[ok]
        fit = np.flatnonzero(_allowed(n[i], at[i], n[j], at[j], sketch[i] ^ sketch[j], percent))
        i, j = i[fit], j if np.ndim(j) == 0 else j[fit]
        return ok[fit[_alike(n[i], n[j], sketch[i] ^ sketch[j], [w[i] ^ w[j] for w in wide], percent)]]

    def alike_in_size(n, start, length) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(i, j), the later and the earlier one, of the pairs in short cells that the length filter lets through, so many at once."""
        number = np.repeat(np.arange(len(start)), length)
        use = np.flatnonzero(np.repeat((length > 1) & (length <= SMALL), length))
        by = use[np.lexsort((n[use], number[use]))]
        number, size = number[by], n[by]
        step = int(size.max()) + 1 if len(by) else 1
        key = number * step + size
        ends = np.searchsorted(key, number * step + np.minimum(100 * size // percent, step - 1), "right")
        count = ends - np.arange(len(by)) - 1
        sums, lo = np.append(0, np.cumsum(count)), 0
        while lo < len(by):
            hi = max(lo + 1, int(np.searchsorted(sums, sums[lo] + (1 << 16), "right")) - 1)
            one = np.repeat(np.arange(lo, hi), count[lo:hi])
            two = one + 1 + np.arange(len(one)) - np.repeat(sums[lo:hi] - sums[lo], count[lo:hi])
            yield np.maximum(by[one], by[two]), np.minimum(by[one], by[two])
            lo = hi

    def earliest(n, at, sketch, wide, open_, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """(i, j) of the first width + 1 candidates j of each open i in a long cell."""
        left, need, found = np.arange(lo, hi)[open_[lo:hi]], np.full(hi - lo, width + 1), []
        for j in range(lo, hi):
            left = left[(left > j) & (need[left - lo] > 0)]
            if not len(left):
                break
            i = left[passing(left, j, n, at, sketch, wide)]
            need[i - lo] -= 1
            found.append((i, np.full(len(i), j)))
        return tuple(np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in range(2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _cells(batches):
            part = _earliest_first(part)
            cell, _, _, c, shape, sketch, open_, *wide = part
            n, at = shape >> 8, shape & 255
            start = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            length = np.diff(np.append(start, len(cell)))
            found = [earliest(n, at, sketch, wide, open_, int(s), int(s + k)) for s, k in zip(start[length > SMALL], length[length > SMALL], strict=True)]
            for i, j in alike_in_size(n, start, length):
                i, j = i[open_[i]], j[open_[i]]
                ok = passing(i, j, n, at, sketch, wide)
                found.append((i[ok], j[ok]))
            i, j = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in range(2))
            i, j = i[c[i] != c[j]], j[c[i] != c[j]]  # should two marks be equal
            by = np.lexsort((j, i))
            i, j = i[by], j[by]
            first = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, np.int64)
            count = np.diff(np.append(first, len(i)))
            rank = np.arange(len(i)) - np.repeat(first, count)
            keep = rank < width
            yield pa.RecordBatch.from_pydict({"a": c[j[keep]], "b": c[i[keep]], "later": rank[keep] > 0, "more": np.repeat(count > width, count)[keep]})

    return run


def _words(shared, odd: np.ndarray):
    """(c, words) of the classes that the one bitmap has, from rows that the other has; a batch gives each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, marks = shared.value
        for batch in chunks((b.filter(pa.array(marked(rows, b.column("row").to_numpy()))) for b in batches), most=CHUNK):
            lines, _, _ = split_lines(batch.column("text"))
            owner, words, _ = _distinct(lines)
            size = np.bincount(owner, minlength=len(lines))
            cls = _named(*_hashed(words, size), odd)
            hit = (size > 0) & marked(marks, cls)
            hit[np.flatnonzero(hit)] = np.isin(np.arange(int(hit.sum())), np.unique(cls[hit], return_index=True)[1])
            offsets = np.append(0, np.cumsum(8 * size[hit])).astype(np.int32)
            sets = pa.Array.from_buffers(pa.binary(), int(hit.sum()), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(words[hit[owner]].tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(cls[hit]), sets], ["c", "words"])

    return run


def _verify(percent: int):
    """b of the pairs (b, words_a, words_b) that reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "words_a"):
            owner, words, sizes = [], [], []
            for side in ("words_a", "words_b"):
                own = batch.column(side).to_pylist()
                sizes.append(np.array([len(x) // 8 for x in own], np.int64))
                words.append(np.frombuffer(b"".join(own), np.uint64))
                owner.append(np.repeat(np.arange(len(own)), sizes[-1]))
            owner, words = np.concatenate(owner), np.concatenate(words)
            order = np.lexsort((words, owner))
            owner, words = owner[order], words[order]
            both = np.bincount(owner[1:][(owner[1:] == owner[:-1]) & (words[1:] == words[:-1])], minlength=batch.num_rows)
            yield batch.filter(pa.array(100 * both >= percent * (sizes[0] + sizes[1] - both))).select(["b"])

    return run


def _confirmed(texts: DataFrame, firsts: DataFrame, near: DataFrame, odd: np.ndarray, percent: int, bits: int) -> DataFrame:
    """b of the pairs (a, b, later) of classes that reach the threshold, as c; later ones are tried for those b that no other pair settles."""
    spark = texts.sparkSession
    wanted = near.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    wanted = written(firsts.select("c", F.col("first.row").alias("row")).join(wanted, "c"), "wanted")
    shared = spark.sparkContext.broadcast((bitmap(wanted, "row", bits), bitmap(wanted, "c", bits)))
    released(spark)  # again: what a listener of the last query still held can go now
    found = texts.select("row", "text").mapInArrow(_words(shared, odd), "c long, words binary").join(wanted.select("c"), "c", "left_semi")
    sets = written(found.dropDuplicates(["c"]), "words")
    released(spark)
    one, two = (sets.select(F.col("c").alias(k), F.col("words").alias(f"words_{k}")) for k in "ab")

    def matching(pairs: DataFrame) -> DataFrame:
        out = pairs.select("a", "b").distinct().join(one, "a").join(two, "b").select("b", "words_a", "words_b").mapInArrow(_verify(percent), "b long")
        return written(out.select(F.col("b").alias("c")).distinct(), "matched")

    out = matching(near.filter("not later"))
    rest = written(near.filter("later").join(out.select(F.col("c").alias("b")), "b", "left_anti").select("a", "b").distinct(), "pairs")
    released(spark)
    if not rest.isEmpty():
        out = out.unionByName(matching(rest))
    dropped(spark, wanted, sets, rest)
    released(spark)
    return out


def _often(lines: DataFrame) -> DataFrame:
    """word, blocks of the words that more than BLOCK lines have in their prefixes."""
    # only words that occur so often in all lines can have so many classes: their level, the top byte, says it
    least = 2 + int(8 * np.log2(BLOCK / 2)) - 1
    often = lines.select(F.explode(F.filter("prefix", lambda p: F.shiftrightunsigned(p, 56) >= least)).alias("p")).groupBy(F.expr("p & ~255L").alias("word")).count()
    return written(often.filter(F.col("count") > BLOCK).select("word", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "often")


def _postings(lines: DataFrame, often: DataFrame) -> DataFrame:
    """A row for each word of a prefix: cell (the word, or one of a frequent word's pairs of blocks), doc, place, c, shape and sketch."""
    each = lines.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), "place", "c", "n", "sketch", *_WIDE, F.explode("prefix").alias("p"))
    each = each.select(F.expr("p & ~255L").alias("cell"), "doc", F.col("place").cast("long").alias("place"), "c", (F.shiftleft(F.col("n").cast("long"), 8) + F.expr("p & 255L")).alias("shape"), "sketch", *_WIDE)
    if often.isEmpty():
        return each
    own = F.expr("cast(pmod(xxhash64(c), blocks) as int)")
    split = each.join(often, F.col("cell") == F.col("word")).withColumn("own", own).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    split = split.withColumn("cell", F.xxhash64("word", F.least("own", "with"), F.greatest("own", "with"))).select(each.columns)
    return each.join(often, F.col("cell") == F.col("word"), "left_anti").unionByName(split)


def removed_lines(docs: DataFrame, *, percent: int = PERCENT, least: int = LEAST, rarity_bits: int = RARITY_BITS, bits: int = 22) -> DataFrame:
    """doc_id, row (a hash of the row) and removed, the places of its removed lines, of every document that loses lines."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text").withColumn("row", F.xxhash64("doc_id", "text"))
    known = spark.sparkContext.broadcast(rarity(docs, rarity_bits))
    schema = "doc_id long, row long, place int, c long, c2 long, n int, sketch long, wide_0 long, wide_1 long, wide_2 long, prefix array<long>"
    lines = written(texts.mapInArrow(_measure(known, least, percent), schema), "lines")
    odd = collisions(lines)
    if len(odd):

        def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.set_column(3, "c", pa.array(_named(batch.column("c").to_numpy(), batch.column("c2").to_numpy(), odd)))

        lines, before = written(lines.mapInArrow(renamed, lines.schema), "lines"), lines
        dropped(spark, before)
    here = F.struct("doc_id", "place", "row")
    firsts = written(lines.groupBy("c").agg(F.min(here).alias("first"), F.count(F.lit(1)).alias("copies")), "classes")
    released(spark)
    ruled, parts = lines.filter(F.size("prefix") > 0), int(spark.conf.get("spark.sql.shuffle.partitions"))
    often = _often(ruled)
    each = _postings(ruled, often)
    total = (ruled.agg(F.sum(F.size("prefix"))).first()[0] or 0) + (often.agg(F.sum(F.expr(f"{BLOCK}L * blocks * blocks"))).first()[0] or 0)
    groups = parts * max(1, -(-total // (parts * GROUP)))
    block = "group int, block binary"
    if often.count() <= 1_000_000:  # of so many words, tasks know each
        table = often.sort("word").toArrow()
        packed = ruled.select("doc_id", "place", "c", "n", "sketch", *_WIDE, "prefix").mapInArrow(_pack_lines(groups, table.column("word").to_numpy(), table.column("blocks").to_numpy().astype(np.int64)), block)
    else:
        packed = each.withColumn("open", F.lit(True)).select(*_ROW).mapInArrow(_pack_rows(groups), block)
    width, matched, rows = WIDTH, None, None
    while True:
        near = packed.repartitionById(parts, F.col("group") % parts).sortWithinPartitions("group").mapInArrow(_near(percent, width), "a long, b long, later boolean, more boolean")
        near = written(near, "near")
        released(spark)
        now = _confirmed(texts, firsts, near, odd, percent, bits)
        matched = now if matched is None else matched.unionByName(now)
        left = written(near.filter("more").select(F.col("b").alias("c")).distinct().join(matched, "c", "left_anti"), "left")
        dropped(spark, near, *([] if rows is None else [rows]))
        if left.isEmpty():
            break
        width *= 64
        some = written(each.join(left, "c", "left_semi").select("cell").distinct(), "some")  # as a table its size is known, so Spark need not move all rows to meet a few cells
        rows = each.join(some, "cell", "left_semi").join(left.withColumn("here", F.lit(True)), "c", "left").withColumn("open", F.col("here").isNotNull())
        # as a table: sorted straight from the joins, the same rows gave 466 of 1,040 open classes candidates, and all from a table
        rows = written(rows.select(*_ROW), "rows")
        packed = rows.mapInArrow(_pack_rows(groups), block)
        dropped(spark, some)
    all_, firsts = firsts, firsts.join(matched.distinct().withColumn("hit", F.lit(True)), "c", "left").filter("copies > 1 or hit")  # the others lose no line
    firsts = written(firsts, "classes")
    # classes of more than a hundred-thousandth of all lines, at most so many, are joined by broadcast: no task gets them whole
    often = F.broadcast(firsts.filter(F.col("copies") > max(1000, lines.count() // 100_000)))
    slim = lines.select("doc_id", "row", "place", "c")
    gone = slim.join(often, "c").unionByName(slim.join(often.select("c"), "c", "left_anti").join(firsts, "c"))
    gone = gone.filter(F.col("hit").isNotNull() | ~here.eqNullSafe(F.col("first"))).select("doc_id", "row", "place").distinct()
    out = written(gone.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list("place")).alias("removed")), "removed")
    dropped(spark, lines, all_, firsts)
    released(spark)
    return out


_DOC, _HASH, _GONE = "__grainmill_doc", "__grainmill_row", "__grainmill_removed"  # names of our own beside the caller's


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        removed = batch.column(_GONE).to_pylist()
        for k, gone in enumerate(removed):
            if gone:
                out = set(gone)
                texts[k] = "\n".join(x for i, x in enumerate(texts[k].split("\n")) if i not in out)
        names = [n for n in batch.schema.names if n != _GONE]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names], names)


def line_dedup(docs: DataFrame, **options) -> DataFrame:
    """The documents, with all their columns, less the removed lines; n_chars, where there is one, follows the text."""
    gone = removed_lines(docs, **options).select(F.col("doc_id").alias(_DOC), F.col("row").alias(_HASH), F.col("removed").alias(_GONE))
    held = docs.join(gone, F.col("doc_id").eqNullSafe(F.col(_DOC)) & (F.xxhash64("doc_id", "text") == F.col(_HASH)), "left")
    out = held.select(*docs.columns, _GONE).mapInArrow(_without, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)
