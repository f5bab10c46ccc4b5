"""Quality rules whose thresholds adapt to each language and source.

Fixed rules reject documents that are too short or repeat themselves. The rest is judged against fences taken
from KLL quantile sketches of five rates, one sketch a (lang, source) group. The sketches are mergeable: groups of
fewer than `least` documents use the merged sketch of their language, and languages of fewer the merged sketch of all.

Null text counts as empty, so it fails the word minimum. Null lang or source forms a group of its own. Ties and
repeated rows are judged alike, one output row per input row. An empty table gives an empty result. Columns other
than doc_id, text, lang and source are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import chunks, written
from grainmill.llm.words import Scan, mix, windows

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutter")
#: Rate -> (least distance of a fence from the quartile, whether low values fail too). The distance only decides where
#: the quartiles of a group are equal or nearly so, and stays below what the base rule lets through.
RATES = {"symbol_rate": (0.05, False), "dup_line_rate": (0.1, False), "repeat_rate": (0.1, False), "stutter_rate": (0.05, False), "word_length": (0.5, True)}


def _lines(scan: Scan) -> tuple[np.ndarray, np.ndarray]:
    """(lines with a word, those equal to an earlier one) of each text."""
    breaks = np.flatnonzero(scan.data == 10)
    start = np.unique(np.concatenate((scan.offsets[:-1], breaks + 1)))
    start = start[start < len(scan.data)]
    doc = np.searchsorted(scan.offsets, start, "right") - 1
    at = np.searchsorted(breaks, start)
    end = np.minimum(scan.offsets[doc + 1], np.append(breaks, len(scan.data))[at])
    full = np.searchsorted(scan.start, end) > np.searchsorted(scan.start, start)
    doc, hashes = doc[full], scan.hashes(start[full], end[full])
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    again = np.zeros(len(doc), bool)
    again[1:] = (doc[1:] == doc[:-1]) & (hashes[1:] == hashes[:-1])
    return np.bincount(doc, minlength=scan.rows), np.bincount(doc[again], minlength=scan.rows)


def _repeated(scan: Scan, words: np.ndarray) -> np.ndarray:
    """Words of each text inside a window that the text has twice or more."""
    keys, at = windows(words, scan.doc, WINDOW)
    keys = mix(keys + scan.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.concatenate((at[order[1:][same]], at[order[:-1][same]]))
    cover = np.zeros(len(scan.start) + WINDOW + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    inside = np.cumsum(cover)[: len(scan.start)] > 0
    return np.bincount(scan.doc[inside], minlength=scan.rows)


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text of a column."""
    scan = Scan(column)
    lines, again = _lines(scan)
    first = (scan.data & 0xC0) != 0x80
    words = scan.words()
    stutter = scan.doc[1:][(words[1:] == words[:-1]) & (scan.doc[1:] == scan.doc[:-1])]
    values = (scan.counts(), scan.per_doc(scan.inside & first), scan.per_doc(SYMBOLS[scan.data]), lines, again, _repeated(scan, words), np.bincount(stutter, minlength=scan.rows))
    return dict(zip(COUNTS, values, strict=True))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        found = measure(batch.column("text"))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "lang", "source")), *(pa.array(found[c], pa.int64()) for c in COUNTS)],
            ["doc_id", "lang", "source", *COUNTS],
        )


def features(docs: DataFrame) -> DataFrame:
    """Counts of every whole text."""
    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS)
    return docs.select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"), "text").mapInArrow(_features, schema)


def _rates() -> dict[str, Column]:
    words, lines = F.greatest(F.col("n_words"), F.lit(1)).cast("double"), F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    return {"symbol_rate": F.col("n_symbols") / words, "dup_line_rate": F.col("n_dup_lines") / lines, "repeat_rate": F.col("n_repeat_words") / words, "stutter_rate": F.col("n_stutter") / words, "word_length": F.col("word_chars") / words}


def fences(passed: DataFrame, *, least: int, reach: float, k: int) -> DataFrame:
    """A row for each (lang, source): the bounds of each rate, from merged sketches where the group is small."""
    # a sketch depends on random bits, so it is made once and written: what reads it again, after a lost executor too, sees the same
    own = written(passed.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), *(F.kll_sketch_agg_double(r, F.lit(k)).alias(r) for r in RATES)), "sketches")
    by_lang = written(own.groupBy("lang").agg(F.sum("n").alias("lang_n"), *(F.kll_merge_agg_double(r, F.lit(k)).alias(f"lang_{r}") for r in RATES)), "sketches")
    by_all = by_lang.agg(*(F.kll_merge_agg_double(f"lang_{r}", F.lit(k)).alias(r) for r in RATES)).first()  # a sketch a rate
    groups = own.join(by_lang.withColumnRenamed("lang", "l2"), F.col("lang").eqNullSafe(F.col("l2")))
    bounds = []
    for rate, (floor, both) in RATES.items():
        sketch = F.when(F.col("n") >= least, F.col(rate)).when(F.col("lang_n") >= least, F.col(f"lang_{rate}")).otherwise(F.lit(by_all[rate]))
        low, high = (F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in (0.25, 0.75))
        span = F.greatest(F.lit(floor), F.lit(reach) * (high - low))
        bounds.append((high + span).alias(f"{rate}_most"))
        if both:
            bounds.append((low - span).alias(f"{rate}_least"))
    return groups.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *bounds)


def quality_rules(docs: DataFrame, *, least_words: int = 20, most_repeat_percent: int = 30, least: int = 200, reach: float = 3.0, k: int = 200) -> DataFrame:
    """One row per document: its counts, base_failed and kept.

    A rate fails when it lies beyond its quartile by `reach` times the distance of the quartiles, and by a floor
    (RATES) that keeps a group of near equal documents from rejecting ordinary ones. k sizes the sketches.
    The fences have a row per group, so Spark broadcasts them only while they are below its size threshold.
    """
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat_percent * F.col("n_words"))
    judged = written(features(docs).withColumn("base_failed", failed), "quality").withColumns(_rates())
    bounds = fences(judged.filter(~F.col("base_failed")), least=least, reach=reach, k=k)
    inside = F.lit(True)
    for rate, (_, both) in RATES.items():
        inside &= F.col(rate) <= F.col(f"{rate}_most")
        if both:
            inside &= F.col(rate) >= F.col(f"{rate}_least")
    out = judged.join(bounds, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(False))
    return out.select("doc_id", "lang", "source", *COUNTS, *RATES, "base_failed", kept.alias("kept"))
