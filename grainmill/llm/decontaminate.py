"""Benchmark decontamination by template windows.

Words lose the punctuation around them and A-Z and Latin-1 capitals are lower-cased. Numbers (words with a digit), names
(capitalised words) and units (after a number) become typed placeholders, so a question whose numbers and names were
exchanged keeps its template. A second form leaves names as words, so a change of case keeps that. Windows of `size` template words are hash-joined between documents and benchmark items;
an item of fewer words is a window of its own length, which below `least` words counts only if all words and slots are equal. A shared window counts if its slots are
consistent: equal values stand for equal values in both directions. A window of too few literal words counts only if all
its slots are equal. A document is contaminated by an item if a window counts.

Executors drop windows that no item can have by a bitmap of the items' window hashes; its size is a parameter, so what
is sent to them is bounded, and it never drops a shared window. What is left is joined by hash and template.

Null and empty texts and items have no windows. Repeated rows are judged alike. An empty table on either side gives
no hits. Other columns are ignored, or by clean() kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import bitmap, chunks, written
from grainmill.llm.words import LOWER, Scan, mix, windows

SIZE, LEAST = 10, 8
#: Units that stand for a placeholder after a number.
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "feet", "foot", "ft", "yard", "yards", "mile", "miles", "mg", "g", "kg", "gram", "grams", "ton", "tons", "pound", "pounds", "ounce", "ounces",
    "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "cent", "cents", "dollar", "dollars", "euro", "euros", "usd", "eur", "percent", "degrees", "meter", "meters", "metre", "metres", "mph", "kmh",
)
_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_KIND = mix(np.array([11, 22, 33, 44], np.uint64))
NUM, NAME, UNIT = 1, 2, 3
_MARKS = ("", "<num>", "<name>", "<unit>")


class Templates:
    """The template words of each text of a column: doc, start, end, kind and hash of each."""

    def __init__(self, column: pa.Array):
        scan = Scan(column)
        raw = scan.raw
        high = np.zeros(len(raw), bool)  # second bytes of À-Þ
        high[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        scan.data = LOWER[raw] + 32 * high.astype(np.uint8)
        start, end, doc = scan.start.copy(), scan.end.copy(), scan.doc
        live = np.arange(len(start))
        while len(live):
            live = live[(start[live] < end[live]) & _PUNCT[raw[np.minimum(start[live], len(raw) - 1)]]]
            start[live] += 1
        live = np.arange(len(start))
        while len(live):
            live = live[(start[live] < end[live]) & _PUNCT[raw[end[live] - 1]]]
            end[live] -= 1
        full = start < end
        self.raw, self.doc, self.start, self.end = raw, doc[full], start[full], end[full]
        start, end = self.start, self.end
        digits = np.concatenate(([0], np.cumsum(_DIGIT[raw])))
        self.kind = np.zeros(len(start), np.int8)
        first = raw[start]
        capital = (first >= 65) & (first <= 90)
        capital |= (first == 0xC3) & high[np.minimum(start + 1, max(len(raw) - 1, 0))] if len(raw) else False
        self.kind[capital] = NAME
        number = digits[end] > digits[start]
        self.kind[number] = NUM
        self.hash = scan.hashes(start, end)
        after = np.zeros(len(start), bool)
        after[1:] = number[:-1] & (self.doc[1:] == self.doc[:-1])
        self.kind[after & ~number & np.isin(self.hash, _unit_hashes())] = UNIT
        bare = np.where(self.kind == NAME, 0, self.kind)  # names as any other words, for texts whose case was changed
        self.forms = [(kind, np.where(kind > 0, _KIND[kind], self.hash)) for kind in (self.kind, bare)]
        self.rows = scan.rows

    def word(self, k: int) -> str:
        return self.raw[self.start[k] : self.end[k]].tobytes().decode("utf-8", "replace")

    def window(self, kinds: np.ndarray, at: int, size: int) -> tuple[str, list[str], int]:
        """(template, slot values, literal words) of a window."""
        kinds = kinds[at : at + size].tolist()
        words = [self.word(at + j).lower() for j in range(size)]
        template = " ".join(_MARKS[k] or w for k, w in zip(kinds, words, strict=True))
        return template, [w for k, w in zip(kinds, words, strict=True) if k], kinds.count(0)


_units: list[np.ndarray] = []


def _unit_hashes() -> np.ndarray:
    if not _units:
        _units.append(np.zeros(0, np.uint64))
        _units[0] = Scan(pa.array([" ".join(UNITS)])).words()
    return _units[0]


def item_windows(items: DataFrame, id_column: str, *, size: int) -> DataFrame:
    """item, n (words of the window), at, key, template, slots, literals and of (windows of the item), for every window of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found = Templates(batch.column("text"))
            counts = np.bincount(found.doc, minlength=found.rows)
            ids = batch.column(0).to_pylist()
            rows = []
            for n in sorted({size, *counts[(counts > 0) & (counts < size)].tolist()}):
                for kinds, hashes in found.forms:
                    keys, at = windows(hashes, found.doc, n)
                    for key, k in zip(keys.tolist(), at.tolist(), strict=True):
                        d = found.doc[k]
                        if n == size or counts[d] == n:
                            rows.append((ids[d], n, int(k - np.searchsorted(found.doc, d)), key - (1 << 64) * (key >> 63), *found.window(kinds, k, n)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.int32()))], ["item", "n", "at", "key", "template", "slots", "literals"])

    return items.select(F.col(id_column).cast("long").alias("item"), "text").mapInArrow(run, "item long, n int, at int, key long, template string, slots array<string>, literals int")


def _candidates(bitmap: np.ndarray, sizes: list[int]):
    mask = np.uint64(len(bitmap) * 8 - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found = Templates(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            rows = []
            for n, (kinds, hashes) in product(sizes, found.forms):
                keys, at = windows(hashes, found.doc, n)
                slot = keys & mask
                hit = np.flatnonzero(bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
                for j in hit.tolist():
                    key, k = int(keys[j]), int(at[j])
                    template, slots, _ = found.window(kinds, k, n)
                    rows.append((ids[found.doc[k]], n, key - (1 << 64) * (key >> 63), template, slots))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.string())))], ["doc_id", "n", "key", "template", "d_slots"])

    return run


def hits(docs: DataFrame, items: DataFrame, *, id_column: str = "item_id", size: int = SIZE, least: int = LEAST, literals: int = 6, bits: int = 24) -> DataFrame:
    """doc_id, item, n_windows (distinct windows of the item that the document shares with consistent slots) and verbatim (those with equal slots).

    The bitmap has 2**bits bits whatever the benchmark's size: a larger benchmark only lets more windows through to the join.
    """
    listed = written(item_windows(items, id_column, size=size).distinct(), "windows")
    packed = bitmap(listed, "key", bits)
    sizes = [r.n for r in listed.select("n").distinct().collect()]
    shared = docs.select("doc_id", "text").mapInArrow(_candidates(packed, sizes), "doc_id long, n int, key long, template string, d_slots array<string>")
    pairs = shared.join(listed, ["key", "n", "template"])
    both = F.size(F.array_distinct(F.arrays_zip("d_slots", "slots")))
    same = F.col("d_slots") == F.col("slots")
    consistent = (both == F.size(F.array_distinct("d_slots"))) & (both == F.size(F.array_distinct("slots")))
    counted = pairs.filter(same | (consistent & (F.col("n") >= least) & (F.col("literals") >= F.least(F.lit(literals), (F.col("n") + 1) / 2))))
    once = counted.groupBy("doc_id", "item", "n", "at").agg(F.max(same).alias("same"))
    return once.groupBy("doc_id", "item").agg(F.count(F.lit(1)).alias("n_windows"), F.count_if("same").alias("verbatim"))


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents, with all their columns, that share no window with an item. A document without a doc_id stays."""
    found = written(hits(docs, items, **options).select("doc_id").distinct(), "hits")
    return docs.join(found, "doc_id", "left_anti")
