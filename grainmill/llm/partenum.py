"""Exact Jaccard join of word-shingle sets by PartEnum signatures.

Equal sets become one class first. Sizes fall into bands; the instance of a band joins all pairs whose larger set lies
in it, so a set takes part in the instances of its own size and of the largest partner it may have. Within an
instance, two sets that reach the threshold differ in at most k features. The feature domain is hashed into more than k
parts, of which at least one must agree: the content of a part is a signature. As all but k parts agree, a set signs only
its first k + 1 in an order that is the same for all sets: parts with many features before those with one or none, which
many unlike sets share. No pair is lost by that (the prefix filter).

Pairs that share a signature are candidates. An odd sketch (a parity bitmap, whose differing bits never outnumber the
differing features) rules most false ones out, and exact Jaccard on the texts decides. First each class is compared
with one leader. Once those links are merged, a bucket's members carry their sketches, and of the pairs that these
allow between different components only a spanning forest is decided on texts: what it links is one component and
needs no further pair. Buckets with a refused pair go on, less the refused pairs and with more links a member, until
none holds an undecided pair. So a group of g near copies costs about g comparisons and no link between different
components is lost. A bucket of more than BLOCK members is dealt out in blocks, first each alone, then in pairs.

Features are 64-bit hashes of word windows. A class is known by a 64-bit hash of its set; where a second hash shows
that different sets share the first, both make the class, so equality rests on 128 bits.

Null, empty and blank texts have an empty set and no links. A class whose rows all lack a doc_id has no component_id of its own. Rows that repeat a doc_id are documents of their own. An
empty table gives an empty result; columns other than doc_id and text are ignored, or by keep_one() kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.functions.signatures import Bands, bound, classes_of, collisions, keys, runs, sets, signatures, sketches, totals  # noqa: F401
from grainmill.llm.common import bitmap, chunks, dropped, marked, released, written
from grainmill.llm.graphs import components
from grainmill.llm.words import mix

SKETCH_BITS = 1024
GONE, GONE_ROW = "__grainmill_gone", "__grainmill_gone_row"  # names of our own beside the columns of the caller


def _near(sketch: np.ndarray, size: np.ndarray, i, j, percent: int) -> np.ndarray:
    """Which of the pairs may reach the threshold, by size and sketch."""
    differ = np.bitwise_count(sketch[i] ^ sketch[j]).sum(-1)
    return differ <= bound(size[i], size[j], percent)


BLOCK = 4096  # members of a bucket that a task holds at once, or twice as many for a pair of blocks


def _spanning(part: np.ndarray, near, width: int) -> list[tuple[int, np.ndarray]]:
    """Pairs (i, js) that span what near(i, among) links between different parts; a part is reached at most `width` times."""
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(int(part.max()) + 2))
    need = np.full(len(cuts) - 1, width)
    seen = np.zeros(len(cuts) - 1, bool)
    found = []
    for root in range(len(part)):
        if seen[part[root]]:
            continue
        seen[part[root]] = True
        need[part[root]] -= 1
        queue = order[cuts[part[root]] : cuts[part[root] + 1]].tolist()
        for i in queue:  # it grows
            among = np.flatnonzero(need[part] > 0)
            if not len(among):
                break
            js = among[near(i, among)]
            if not len(js):
                continue
            js = js[np.unique(part[js], return_index=True)[1]]
            found.append((i, js))
            need[part[js]] -= 1
            for k in part[js][~seen[part[js]]].tolist():
                queue.extend(order[cuts[k] : cuts[k + 1]].tolist())
            seen[part[js]] = True
    return found


def _undecided(percent: int, width: int):
    """(sig, lo, hi, a, b) of spanning links within each cell, a block of a bucket or two; rows sorted by these three.

    A row with `other` is a pair that the texts refused.
    """

    def of(label, c, size, block, sketch, refused: tuple, cross: bool) -> tuple[np.ndarray, np.ndarray] | None:
        if len(c) < 2 or (label == label[0]).all():
            return None
        order = np.argsort(c)
        label, c, size, block, sketch = (x[order] for x in (label, c, size, block, sketch))
        banned: dict[int, list[int]] = {}
        for one, two in (refused, refused[::-1]):
            for i, j in zip(np.searchsorted(c, one).tolist(), np.searchsorted(c, two).tolist(), strict=True):
                banned.setdefault(i, []).append(j)

        def near(i, among: np.ndarray) -> np.ndarray:
            ok = (label[among] != label[i]) & (block[among] != block[i] if cross else True)
            ok[ok] = _near(sketch, size, i, among[ok], percent)
            if i in banned:
                ok &= ~np.isin(among, banned[i])
            return ok

        if len(c) <= 128:  # all at once
            far = np.bitwise_count(sketch[:, None] ^ sketch[None]).sum(-1, dtype=np.int64)
            all_ = (far <= bound(size[:, None], size[None], percent)) & (label[:, None] != label[None])
            if cross:
                all_ &= block[:, None] != block[None]
            for i, js in banned.items():
                all_[i, js] = False
            if not all_.any():
                return None
            near = lambda i, among: all_[i, among]
        found = _spanning(np.unique(label, return_inverse=True)[1], near, width)
        if not found:
            return None
        i, j = np.concatenate([np.full(len(js), i) for i, js in found]), np.concatenate([js for _, js in found])
        return np.minimum(c[i], c[j]), np.maximum(c[i], c[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # those of the cell that may go on
        for batch in _with_end(batches):
            if batch is not None and not batch.num_rows:
                continue
            last = [held[-1].column(k)[held[-1].num_rows - 1].as_py() for k in ("sig", "lo", "hi")] if held else None
            if batch is not None and last is not None and all(pc.all(pc.equal(batch.column(k), v)).as_py() for k, v in zip(("sig", "lo", "hi"), last, strict=True)):
                held.append(batch)
                continue
            if batch is not None:
                held.append(batch)
            if not held:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            key = np.stack([t.column(k).to_numpy().astype(np.int64) for k in ("sig", "lo", "hi")])
            start = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(0)))
            stop = np.append(start[1:], t.num_rows)
            done = len(start) - (batch is not None)
            held = t.slice(int(start[-1])).to_batches() if batch is not None else []
            columns = [t.column(k).to_numpy() for k in ("label", "c", "n", "block")]
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(t.num_rows, -1)
            other, bad = t.column("other").fill_null(0).to_numpy(), t.column("other").is_valid().to_numpy()
            out = []
            # cells of two members and no refused pair, most of all, go together
            two = start[:done][(stop[:done] - start[:done] == 2)]
            two = two[~bad[two] & ~bad[two + 1]]
            label, c, size, block = columns
            two = two[label[two] != label[two + 1]]
            two = two[(key[1, two] == key[2, two]) | (block[two] != block[two + 1])]
            two = two[_near(sketch, size, two, two + 1, percent)]
            out.append((two, np.minimum(c[two], c[two + 1]), np.maximum(c[two], c[two + 1])))
            for at, to in zip(start[:done].tolist(), stop[:done].tolist(), strict=True):
                mine = np.arange(at, to)
                if to - at == 2 and not bad[at:to].any():
                    continue
                no, mine = mine[bad[at:to]], mine[~bad[at:to]]
                pairs = of(*(x[mine] for x in (*columns, sketch)), (c[no], other[no]), key[1, at] != key[2, at])
                if pairs is not None:
                    out.append((np.full(len(pairs[0]), at), *pairs))
            at, a, b = (np.concatenate([o[k] for o in out]) for k in range(3))
            yield pa.RecordBatch.from_pydict({"sig": key[0, at], "lo": pa.array(key[1, at], pa.int32()), "hi": pa.array(key[2, at], pa.int32()), "a": a, "b": b})

    return run


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def plausible(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and sketches of known(c, n, sketch) don't rule out, before any text is moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                size = [batch.column(k).to_numpy() for k in ("n_a", "n_b")]
                one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for k in ("sketch_a", "sketch_b"))
                yield batch.filter(pa.array(np.bitwise_count(one ^ two).sum(-1) <= bound(*size, percent))).select(["a", "b"])

    one, two = (known.select(F.col("c").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"sketch_{k}")) for k in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def _verify(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text_a"):
            one, two = (sets(batch.column(k), words) for k in ("text_a", "text_b"))
            owner, features = np.concatenate((one[0], two[0])), np.concatenate((one[1], two[1]))
            order = np.lexsort((features, owner))
            owner, features = owner[order], features[order]
            both = np.bincount(owner[1:][(owner[1:] == owner[:-1]) & (features[1:] == features[:-1])], minlength=batch.num_rows)
            yield batch.filter(pa.array(100 * both >= percent * (one[2] + two[2] - both))).select(["a", "b"])

    return run


def jaccard_join(docs: DataFrame, *, words: int = 5, percent: int = 80, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, row, n_shingles, c, component_id) and links (a, b) between classes, those that made the components.

    row is a hash of doc_id and text. bits is the width of a class's first hash.
    """
    spark, bands = docs.sparkSession, Bands(percent)
    texts = docs.select("doc_id", "text").withColumn("row", F.xxhash64("doc_id", "text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            _, features, size = sets(batch.column("text"), words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(size, pa.int64()), *(pa.array(x) for x in keys(features, size, bits))], ["doc_id", "row", "n_shingles", "c", "c2"])

    measured = written(texts.mapInArrow(measure, "doc_id long, row long, n_shingles long, c long, c2 long"), "sets")
    odd = collisions(measured.filter("n_shingles > 0"))
    if len(odd):
        shared = F.expr("c in (" + ", ".join(f"{c}L" for c in odd.tolist()) + ")")

        def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                one, two = (batch.column(k).to_numpy().view(np.uint64) for k in ("c", "c2"))
                yield batch.set_column(3, "c", pa.array(mix(one + mix(two)).view(np.int64)))

        measured = written(measured.filter(~shared).unionByName(measured.filter(shared).mapInArrow(renamed, measured.schema)), "sets")
    classes = measured.filter("n_shingles > 0").groupBy("c").agg(F.min("doc_id").alias("least"), F.min("row").alias("row"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a task signs a class once, so copies don't fill the exchange
        for batch in chunks(batches):
            owner, features, size = sets(batch.column("text"), words)
            key = classes_of(features, size, odd, bits)
            new = np.zeros(len(key), bool)
            for k, c in enumerate(key.tolist()):
                if c not in seen:
                    seen.add(c)
                    new[k] = True
            if len(seen) > 1_000_000:
                seen.clear()
            mine = new[owner]
            row, signs = signatures(owner[mine], features[mine], np.where(new, size, 0), bands)
            for at in range(0, len(row), 200_000):
                yield pa.RecordBatch.from_pydict({"sig": signs[at : at + 200_000].view(np.int64), "c": key[row[at : at + 200_000]]})

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    signed = texts.select("text").mapInArrow(sign, "sig long, c long").repartition(n, "sig").sortWithinPartitions("sig", "c")
    members = written(signed.mapInArrow(runs, "sig long, c long, leader long"), "buckets")

    released(spark)
    wanted = members.select("c").distinct()
    marks = spark.sparkContext.broadcast(bitmap(classes.join(wanted, "c", "left_semi"), "row", 24))
    released(spark)  # again: what a listener of the last query still held can go now

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (b.filter(pa.array(marked(marks.value, b.column("row").to_numpy()))) for b in batches)
        for batch in chunks(rows):
            owner, features, size = sets(batch.column("text"), words)
            drawn = sketches(owner, features, batch.num_rows, SKETCH_BITS)
            yield pa.RecordBatch.from_arrays([pa.array(classes_of(features, size, odd, bits)), pa.array(size, pa.int64()), pa.array(drawn, pa.binary()), batch.column("text")], ["c", "n", "sketch", "text"])

    drawn = texts.select("row", "text").mapInArrow(draw, "c long, n long, sketch binary, text string")
    known = written(drawn.join(wanted, "c", "left_semi").dropDuplicates(["c"]), "candidates")
    released(spark)

    def decided(pairs: DataFrame) -> DataFrame:
        asked = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()  # so that only their texts are moved
        if pairs.count() <= 200_000:
            asked = F.broadcast(asked)  # at most 400,000 numbers
        some = known.select("c", "text").join(asked, "c", "left_semi")
        one, two = (some.select(F.col("c").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")
        out = written(pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(_verify(words, percent), "a long, b long"), "links")
        released(spark)
        return out

    stars = members.filter("c <> leader").groupBy("c", "leader").count()
    star = stars.groupBy("c").agg(F.max_by("leader", F.struct("count", -F.col("leader"))).alias("a")).select("a", F.col("c").alias("b"))
    star = written(plausible(star, known, percent), "pairs")
    links = decided(star)
    labels = components(links)
    labels = written(labels, "labels")

    plain = members.select("sig", "c").join(labels.withColumnRenamed("node", "c"), "c", "left").select("sig", "c", F.coalesce("label", "c").alias("label"))
    print_ = (F.bit_xor(F.xxhash64("c")).alias("h1"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("h2"), F.min("c").alias("h3"), F.max("c").alias("h4"))
    open_ = plain.groupBy("sig").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("size"), *print_).filter("x <> y")
    open_ = open_.groupBy("size", "h1", "h2", "h3", "h4").agg(F.min("sig").alias("sig"))  # of buckets with the same members one is enough
    open_ = open_.select("sig", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    cells = members.select("sig", "c").join(open_, "sig").join(known.select("c", "n", "sketch"), "c")
    cells = written(cells.withColumn("block", F.expr("cast(pmod(xxhash64(c), blocks) as int)")), "cells")
    dropped(spark, members, star)
    released(spark)
    alone = cells.withColumn("lo", F.col("block")).withColumn("hi", F.col("block"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with")
    across = cells.filter("blocks > 1").select("*", other).filter("with <> block").withColumn("lo", F.least("block", "with")).withColumn("hi", F.greatest("block", "with"))
    for rows in (alone, across):
        cell, refused, width = ["sig", "lo", "hi"], None, 1
        while True:
            now = rows if refused is None else rows.join(refused.select(cell).distinct(), cell, "left_semi")
            now = now.join(labels.withColumnRenamed("node", "c"), "c", "left").select(*cell, "c", F.coalesce("label", "c").alias("label"), "n", "sketch", "block", F.lit(None).cast("long").alias("other"))
            if refused is not None:
                none = (F.lit(v).alias(k) for k, v in (("label", 0), ("n", 0), ("sketch", bytearray(SKETCH_BITS // 8)), ("block", 0)))
                now = now.unionByName(refused.select(*cell, F.col("a").alias("c"), F.col("b").alias("other"), *none))
            found = now.repartition(n, *cell).sortWithinPartitions(*cell).mapInArrow(_undecided(percent, width), "sig long, lo int, hi int, a long, b long")
            found = written(found, "pairs")
            released(spark)
            if found.isEmpty():
                break
            more = decided(written(found.select("a", "b").distinct(), "pairs"))
            if not more.isEmpty():
                links = links.unionByName(more)
                labels = written(components(labels.filter("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more)), "labels")
            again = found.join(more, ["a", "b"], "left_anti").select(*cell, "a", "b")
            open_cells = written(again, "refused")
            if open_cells.isEmpty():
                break
            refused = open_cells if refused is None else written(refused.join(open_cells.select(cell).distinct(), cell, "left_semi").unionByName(open_cells), "refused")
            width *= 32  # after the first links nearly all pairs left are refused, and each round moves the open cells again
    dropped(spark, cells)
    named = classes.join(labels.withColumnRenamed("node", "c"), "c", "left").select("c", "least", F.coalesce("label", "c").alias("label"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = written(named.join(least, "label").select("c", "component_id"), "components")
    out = measured.join(named, "c", "left").select("doc_id", "row", "n_shingles", "c", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out, links


def keep_one(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents, with all their columns, less those of a group that aren't its least by doc_id (and then by a hash of doc_id and text).

    A row is known by doc_id and text, so rows that repeat a doc_id with other texts are judged each on its own; of
    identical rows one stays. Documents without words or without a doc_id always stay.
    """
    found = written(jaccard_join(docs, words=words, percent=percent)[0].filter("n_shingles > 0 and doc_id is not null"), "groups")
    first = found.filter("doc_id = component_id").groupBy("component_id").agg(F.min("row").alias("first"))
    gone = found.join(first, "component_id").filter("doc_id <> component_id or row <> first").select(F.col("doc_id").alias(GONE), F.col("row").alias(GONE_ROW)).distinct()
    same = (F.col("doc_id") == F.col(GONE)) & (F.xxhash64("doc_id", "text") == F.col(GONE_ROW))
    kept = docs.join(gone, same, "left_anti")
    again = found.groupBy("doc_id", "row").count().filter("count > 1").select(F.col("doc_id").alias(GONE), F.col("row").alias(GONE_ROW))
    if again.isEmpty():
        return kept
    once = kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, same, "left_anti").unionByName(once).select(docs.columns)
