"""Exact and near duplicates of records, and what to keep of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.batches import chunks
from grainmill.functions.hashed import mix
from grainmill.functions.signatures import Bands, bound, collisions, keys, runs, sets, signatures, sketches
from grainmill.functions.text import normalize, shingles, text, words
from grainmill.plans.storage import dropped, released, stored
from grainmill.schema import lists

PREFIX, SHINGLE, THRESHOLD = 2000, 3, 0.85
PERMUTATIONS = 128
SKETCH_BITS = 1024


def comparable(messages: Column | None = None) -> Column:
    """Contents, reasoning and tool arguments of all lists, a line each; roles, label and answer don't count."""
    parts = F.flatten(F.transform(lists() if messages is None else messages, lambda m: F.concat(F.array(m["content"], m["reasoning"]), F.coalesce(F.transform(m["tool_calls"], lambda c: c["arguments"]), F.array().cast("array<string>")))))
    return F.array_join(F.filter(parts, lambda p: text(p) != ""), "\n")


def exact_groups(df: DataFrame) -> DataFrame:
    """keep_id, keep_seq and n of each group of records whose normalised text is equal and not empty.

    Texts are grouped by their SHA-256, with partial counts, so a text of a third of all rows is a row a task.
    """
    keyed = df.select("id", "seq", normalize(comparable()).alias("t")).filter("t <> ''").select("id", "seq", F.sha2("t", 256).alias("key"))
    groups = keyed.groupBy("key").agg(F.min(F.struct("seq", "id")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return groups.select("key", F.col("first.id").alias("keep_id"), F.col("first.seq").alias("keep_seq"), "n")


def exact_drops(df: DataFrame) -> DataFrame:
    """id of every later copy, with keep_id."""
    keyed = df.select("id", "seq", F.sha2(normalize(comparable()), 256).alias("key"))
    return keyed.join(exact_groups(df), "key").filter("id <> keep_id").select("id", "keep_id")


def without(df: DataFrame, drops: DataFrame) -> DataFrame:
    """The records that no group drops; a record that one group keeps and another drops goes."""
    return df.join(drops.select("id").distinct(), "id", "left_anti")


def shingled(df: DataFrame, size: int = SHINGLE, prefix: int | None = PREFIX) -> DataFrame:
    """id, seq and sh, the distinct word shingles of the normalised text (by default of its first 2000 characters)."""
    t = normalize(comparable())
    out = df.select("id", "seq", words(t if prefix is None else F.left(t, F.lit(prefix))).alias("w"))
    # a filter on sh would be pushed below the projection and take the words apart once for each shingle
    return out.filter(F.size("w") > 0).select("id", "seq", shingles(F.col("w"), size).alias("sh"))


def signature(sh: Column, n: int = PERMUTATIONS) -> Column:
    """MinHash values under n hash functions."""
    hashed = F.transform(sh, lambda s: F.xxhash64(s))
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda seed: F.array_min(F.transform(hashed, lambda h: F.xxhash64(h, seed))))


def _exact_links(df: DataFrame, threshold: float, size: int, prefix: int | None) -> tuple[DataFrame, DataFrame]:
    """(texts, links): id, seq and class c of each record with a word, and (c, c2, similarity) of all pairs of classes at the threshold.

    Equal sets are one class. Shingles are 64-bit hashes, sets are known by 128 bits. A prefix of None
    compares whole texts. Signatures travel alone; the sets only of those that share one.
    """
    percent = int(threshold * 100 + 1e-9)  # candidates of at least that; the exact similarity decides
    if not 1 <= percent <= 100:
        raise ValueError(f"a threshold from 0.01 to 1 is needed, not {threshold}")
    bands = Bands(percent)
    t = normalize(comparable())
    plain = df.select("id", "seq", F.array_join(words(t if prefix is None else F.left(t, F.lit(prefix))), " ").alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            _, features, n = sets(batch.column("text"), size)
            batch = pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("id", "seq", "text")), *(pa.array(x) for x in keys(features, n))], ["id", "seq", "text", "c", "c2"])
            yield batch.filter(pa.array(n > 0))

    kinds = {f.name: f.dataType.simpleString() for f in plain.schema}
    texts = stored(plain.mapInArrow(measure, f"id {kinds['id']}, seq {kinds['seq']}, text string, c long, c2 long"))
    odd = collisions(texts)
    if len(odd):

        def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                one, two = (batch.column(k).to_numpy().view(np.uint64) for k in ("c", "c2"))
                yield batch.set_column(3, "c", pa.array(np.where(np.isin(one.view(np.int64), odd), mix(one + mix(two)).view(np.int64), one.view(np.int64))))

        texts = stored(texts.mapInArrow(renamed, texts.schema))
    released(spark := df.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            owner, features, n = sets(batch.column("text"), size)
            c = batch.column("c").to_numpy()
            new = np.zeros(len(c), bool)
            new[np.unique(c, return_index=True)[1]] = True  # copies in a batch sign once
            mine = new[owner]
            row, signs = signatures(owner[mine], features[mine], np.where(new, n, 0), bands)
            for at in range(0, len(row), 200_000):
                yield pa.RecordBatch.from_pydict({"sig": signs[at : at + 200_000].view(np.int64), "c": c[row[at : at + 200_000]]})

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    signed = texts.select("c", "text").mapInArrow(sign, "sig long, c long").repartition(parts, "sig").sortWithinPartitions("sig", "c")
    members = stored(signed.mapInArrow(runs, "sig long, c long, leader long").select("sig", "c"))
    released(spark)
    # of buckets with the same members one is enough
    print_ = (F.count(F.lit(1)), F.min("c"), F.max("c"), F.bit_xor(F.xxhash64("c")), F.bit_xor(F.xxhash64("c", F.lit(1))))
    print_ = [x.alias(f"h{k}") for k, x in enumerate(print_)]
    once = members.groupBy("sig").agg(*print_).groupBy(*(f"h{k}" for k in range(len(print_)))).agg(F.min("sig").alias("sig")).select("sig")
    some = stored(members.join(once, "sig"))
    near = some.join(some.select("sig", F.col("c").alias("c2")), "sig").filter("c < c2").select("c", "c2").distinct()
    near = stored(near)
    dropped(members, some)
    released(spark)

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            owner, features, n = sets(batch.column("text"), size)
            raw = [features[to - k : to].tobytes() for to, k in zip(np.cumsum(n).tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"c": batch.column("c"), "n": pa.array(n, pa.int64()), "sketch": pa.array(sketches(owner, features, len(n), SKETCH_BITS), pa.binary()), "sh": pa.array(raw, pa.binary())})

    wanted = near.select(F.explode(F.array("c", "c2")).alias("c")).distinct()
    held = stored(texts.select("c", "text").join(wanted, "c", "left_semi").dropDuplicates(["c"]).mapInArrow(drawn, "c long, n long, sketch binary, sh binary"))
    known = stored(texts.select("id", "seq", "c"))
    dropped(texts)
    released(spark)

    def plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for k in ("x", "y"))
                differ = np.bitwise_count(one ^ two).sum(-1)
                yield batch.filter(pa.array(differ <= bound(batch.column("n").to_numpy(), batch.column("n2").to_numpy(), percent))).select(["c", "c2"])

    # sizes and sketches first: most pairs go by them, and no set is moved for those
    two = held.select(F.col("c").alias("c2"), F.col("n").alias("n2"), F.col("sketch").alias("y"))
    likely = near.join(held.select("c", "n", F.col("sketch").alias("x")), "c").join(two, "c2").select("c", "c2", "n", "n2", "x", "y")
    likely = stored(likely.mapInArrow(plausible, "c long, c2 long"))
    dropped(near)
    released(spark)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                one, two = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(one, two, assume_unique=True))
                score.append(both / (len(one) + len(two) - both))
            yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("c2"), pa.array(score, pa.float64())], ["c", "c2", "similarity"])

    links = likely.join(held.select("c", F.col("sh").alias("x")), "c").join(held.select(F.col("c").alias("c2"), F.col("sh").alias("y")), "c2").select("c", "c2", "x", "y")
    links = stored(links.mapInArrow(compare, "c long, c2 long, similarity double").filter(F.col("similarity") >= threshold))
    dropped(held, likely)
    released(spark)
    return known, links


def exact_pairs(df: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, prefix: int | None = PREFIX) -> DataFrame:
    """(a, b, similarity) of all pairs of distinct texts at the threshold, by signatures of which such a pair shares one.

    Equal sets are joined through the first of them.
    """
    known, links = _exact_links(df, threshold, size, prefix)
    wanted = links.select(F.explode(F.array("c", "c2")).alias("c")).distinct()
    name = known.join(wanted, "c", "left_semi").groupBy("c").agg(F.min(F.struct("seq", "id")).alias("first")).select("c", F.col("first.id").alias("id"))
    return links.join(name.withColumnRenamed("id", "a"), "c").join(name.select(F.col("c").alias("c2"), F.col("id").alias("b")), "c2").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")


def classes(df: DataFrame, size: int = SHINGLE, prefix: int | None = PREFIX) -> DataFrame:
    """id and class_id of each record with a word, class_id being the first of the records whose shingles are equal: the member that exact_pairs() names."""
    sets = stored(shingled(df, size, prefix).select("id", "seq", F.sha2(F.array_join(F.array_sort("sh"), "\n"), 256).alias("key")))
    first = sets.groupBy("key").agg(F.min(F.struct("seq", "id")).alias("first")).select("key", F.col("first.id").alias("class_id"))
    return sets.join(first, "key").select("id", "class_id")


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, label) of the nodes of links(a, b), label the least node reachable, by alternating stars."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = None
    for _ in range(most):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        wide = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = wide.groupBy("u").agg(F.min("v").alias("m"))
        edges = stored(wide.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v")).filter("u <> v").distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
        seen = now
    raise RuntimeError("components did not settle")


def near_groups(df: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, prefix: int | None = PREFIX) -> DataFrame:
    """id, keep_id and similarity (the least of the group's passing edges) of each record in a group of near duplicates, of all pairs at the threshold.

    Equal sets are compared through one of them, so a group of copies costs no pairs. A prefix of None compares whole texts.
    Records without an id are left out; a group has two ids at least.
    """
    known, links = _exact_links(df.filter("id is not null"), threshold, size, prefix)
    labels = stored(components(links.select(F.col("c").alias("a"), F.col("c2").alias("b"))))
    least = links.join(labels, links.c == labels.node).groupBy("label").agg(F.min("similarity").alias("similarity"))
    linked = labels.join(least, "label").select(F.col("node").alias("c"), "label", "similarity")
    # a class without a link is a group by its copies alone
    members = stored(known.join(linked, "c", "left").select("id", "seq", F.coalesce("label", "c").alias("label"), F.coalesce("similarity", F.lit(1.0)).alias("similarity")))
    keep = members.groupBy("label").agg(F.min_by("id", F.struct("seq", "id")).alias("keep_id"), F.min("id").alias("x"), F.max("id").alias("y")).filter("x <> y").select("label", "keep_id")
    return members.join(keep, "label").select("id", "keep_id", "similarity")


def find_duplicates(df: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, prefix: int | None = PREFIX) -> DataFrame:
    """kind, id and keep_id of what exact and near duplicate detection drops."""
    near = near_groups(df, threshold, size, prefix).filter("id <> keep_id")
    return exact_drops(df).select(F.lit("exact").alias("kind"), "id", "keep_id").unionByName(near.select(F.lit("near").alias("kind"), "id", "keep_id"))
