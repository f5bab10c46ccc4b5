"""Language identification by rank-order profiles of character n-grams.

A profile lists the most frequent 1- to 3-grams of a language's learning documents by rank. A document's own most
frequent n-grams are compared with each profile: every n-gram counts how far out of place it stands, one that the
profile lacks counts `size`. The nearest profile wins, ties go to the language that sorts first.

Learning and the least scores of reject() take every learning document, unless `sample` asks for at most so many of each
language, those with the least hash of doc_id. Predictions see the text alone. Null text and text without a letter give `und` and
score 0, as does any text when nothing could be learned. Repeated rows each get their row; an empty table gives an
empty result; further columns are ignored or, by `reject`, kept as they are.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.llm.common import chunks, dropped, written

SIZE = 300
UNKNOWN = "und"
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(text: str) -> np.ndarray:
    """The 1- to 3-grams of the lower-cased words of letters, each word between spaces, as numbers of 21 bits a character."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _is_letter()[points]
    if not letter.any():
        return np.zeros(0, np.uint64)
    points = np.concatenate(([32], np.where(letter, points, 32), [32])).astype(np.uint64)
    space = points == 32
    points = points[np.concatenate(([True], ~(space[1:] & space[:-1])))]
    space = points == 32
    two = (points[:-1] << np.uint64(21)) | points[1:]
    three = (two[:-1] << np.uint64(21)) | points[2:]
    return np.concatenate((points[~space], two, three[~space[1:-1]]))


def ranked(text: str, size: int = SIZE) -> np.ndarray:
    """The most frequent n-grams of a text, by count and then by code."""
    codes, counts = np.unique(grams(text), return_counts=True)
    if len(codes) > size:
        floor = np.partition(counts, -size)[-size]
        most = counts >= floor
        codes, counts = codes[most], counts[most]
    return codes[np.lexsort((codes, -counts))][:size]


class Profiles:
    """Languages and, for each, its n-grams by rank."""

    def __init__(self, lists: dict[str, list[int]], size: int = SIZE):
        self.langs, self.size = sorted(lists), size
        codes = [np.array(lists[x], np.uint64) for x in self.langs]
        self.codes = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.uint64)
        self.ranks = np.full((len(self.langs), len(self.codes) + 1), -1, np.int64)
        for k, own in enumerate(codes):
            self.ranks[k, np.searchsorted(self.codes, own)] = np.arange(len(own))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and a score: 1 less the mean distance as a share of the largest."""
        own = ranked(text or "", self.size)
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.codes, own)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != own)] = len(self.codes)
        there = self.ranks[:, at]
        far = np.where(there < 0, self.size, np.abs(there - np.arange(len(own)))).sum(1)
        best = int(far.argmin())
        return self.langs[best], 1.0 - float(far[best]) / (self.size * len(own))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _lessons(docs: DataFrame, sample: int | None = None) -> DataFrame:
    """lang, doc_id and text of the learning documents, all of them or at most `sample` a language."""
    known = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    if sample is None:
        return known
    # hashes spread evenly, so those below 4 * sample / n hold the least `sample` of a language's n documents and about 4 times
    # as many: no task ranks a whole language; should a language have too few below it, it learns from those
    near = known.select("lang", "doc_id", F.xxhash64("doc_id").alias("h"))
    share = F.shiftrightunsigned("h", 1).cast("double") / float(1 << 63)
    near = near.join(near.groupBy("lang").agg(F.count(F.lit(1)).alias("of")), "lang").filter(share * F.col("of") <= 4 * sample)
    first = Window.partitionBy("lang").orderBy(share, "doc_id")
    chosen = near.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= sample).select("lang", "doc_id").distinct()
    chosen = written(chosen, "lessons")
    small = chosen.count() <= 200_000  # at most `sample` ids a language, but languages may be many
    return known.join(F.broadcast(chosen) if small else chosen, ["lang", "doc_id"], "left_semi")


def learn(docs: DataFrame, *, size: int = SIZE, sample: int | None = None) -> Profiles:
    """Profiles of every lang value among documents that aren't held out. The driver gets `size` rows a language."""
    few = _lessons(docs, sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        held = 0
        for batch in chunks(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = np.unique(grams(text), return_counts=True)
                found.setdefault(lang, []).append(own)
                held += len(own[0])
            if held > 2_000_000:
                found = {lang: [_summed(own)] for lang, own in found.items()}
                held = sum(len(own[0][0]) for own in found.values())
                if held > 1_000_000:
                    yield from _counted(found)
                    found, held = {}, 0
        yield from _counted(found)

    totals = few.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    by_count = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    lists: dict[str, list[int]] = {}
    for row in totals.withColumn("rank", F.row_number().over(by_count)).filter(F.col("rank") <= size).orderBy("lang", "rank").collect():
        lists.setdefault(row.lang, []).append(row.code)
    return Profiles(lists, size)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and the sums of their counts."""
    codes, counts = (np.concatenate([p[k] for p in parts]) for k in range(2))
    by = np.argsort(codes)
    codes, counts = codes[by], counts[by]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(codes) else counts


def _counted(found: dict[str, list[tuple[np.ndarray, np.ndarray]]], most: int = 50_000) -> Iterator[pa.RecordBatch]:
    for lang, own in found.items():
        codes, counts = _summed(own)
        for at in range(0, len(codes), most):
            code, n = codes[at : at + most].view(np.int64), counts[at : at + most]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(n), pa.string()), "code": code, "n": pa.array(n, pa.int64())})


def _predict(profiles: Profiles, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            got = [profiles.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*keep, "lang_pred", "score"])

    return run


def language_id(docs: DataFrame, *, size: int = SIZE, sample: int | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    out = docs.select("doc_id", "text").mapInArrow(_predict(learn(docs, size=size, sample=sample), ["doc_id"]), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def least_scores(docs: DataFrame, profiles: Profiles, *, sample: int | None = None, enough: int = 20, reach: float = 3.0, width: float = 0.1) -> dict[str, float]:
    """Of each language, the score below which a text is far from its learning documents.

    It lies `reach` times the distance of the quartiles, at least `width`, below the lower quartile of the scores of the
    learning documents that are told rightly; a language of fewer than `enough` such documents takes that of all languages.
    """
    told = _lessons(docs, sample).select("lang", "text").mapInArrow(_predict(profiles, ["lang"]), "lang string, lang_pred string, score double").filter("lang = lang_pred")
    told = written(told.select("lang", "score"), "scores")
    found = _quartiles(told)
    dropped(docs.sparkSession, told)
    low = {lang: one - max(width, reach * (three - one)) for lang, (n, one, three) in found.items() if n >= enough}
    return {lang: low.get(lang, low.get(None, 0.0)) for lang in profiles.langs}


BINS = 1 << 12


def _quartiles(told: DataFrame) -> dict[str | None, tuple[int, float, float]]:
    """Of each lang, and of all as None: how many scores, and their exact lower and upper quartile (interpolated).

    Counts by bin come first, then the scores of the bins that hold the ranks next to a quartile. The driver gets BINS rows a
    language and then the distinct scores of at most four bins each, a few thousand, as a score is a ratio of small whole numbers.
    """
    bin_ = F.floor(F.col("score") * BINS).cast("int")
    counted = told.groupBy("lang", bin_.alias("bin")).count().collect()
    bins: dict[str | None, Counter] = {}
    for r in counted:
        for lang in (r.lang, None):
            bins.setdefault(lang, Counter())[r.bin] += r["count"]
    ranks = {lang: [int(q * (own.total() - 1)) for q in (0.25, 0.75)] for lang, own in bins.items()}
    asked: dict[str | None, dict[int, int]] = {}  # bins with a wanted rank, and the rank at which each begins
    for lang, own in bins.items():
        at = 0
        for b, n in sorted(own.items()):
            if any(at <= k < at + n for rank in ranks[lang] for k in (rank, rank + 1)):
                asked.setdefault(lang, {})[b] = at
            at += n
    want = sorted({b for own in asked.values() for b in own})
    values: dict[tuple[str | None, int], Counter] = {}
    for r in told.filter(bin_.isin(want)).groupBy("lang", "score", bin_.alias("bin")).count().collect() if want else ():
        for lang in (r.lang, None):
            values.setdefault((lang, r.bin), Counter())[r.score] += r["count"]

    def score(lang: str | None, rank: int) -> float:
        b, at = max(((b, at) for b, at in asked[lang].items() if at <= rank), key=lambda x: x[1])
        for value, n in sorted(values[lang, b].items()):
            at += n
            if rank < at:
                return value
        raise AssertionError("a rank beyond the bin that was counted to hold it")

    out = {}
    for lang, own in bins.items():
        n, got = own.total(), []
        for q, rank in zip((0.25, 0.75), ranks[lang], strict=True):
            one, two = score(lang, rank), score(lang, min(rank + 1, n - 1))
            got.append(one + (q * (n - 1) - rank) * (two - one))
        out[lang] = (n, *got)
    return out


def reject(docs: DataFrame, *, least_score: float = 0.05, size: int = SIZE, sample: int | None = None) -> DataFrame:
    """The documents, with all their columns, whose language could be told: not `und`, and scored at least as least_scores() asks of it, or least_score if that is more."""
    profiles = learn(docs, size=size, sample=sample)
    judge = profiles.predict
    least = {lang: max(least_score, low) for lang, low in least_scores(docs, profiles, sample=sample).items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            got = [judge(t) for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least[lang] for lang, score in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def crc_fold(doc_id: int) -> int:
    """The fold of a doc_id; held out where it is 1."""
    return zlib.crc32(str(doc_id).encode()) % 3
