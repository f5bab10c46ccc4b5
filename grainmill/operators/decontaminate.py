"""Benchmark screening by word n-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.functions.text import words
from grainmill.operators.dedup import comparable

NGRAM, LEAST = 13, 5


def item_grams(items: DataFrame, n: int = NGRAM, least: int = LEAST) -> DataFrame:
    """(size, gram) of the items: all n-grams, or the whole of an item of `least` to n - 1 words."""
    w = items.select("benchmark", words(F.col("text")).alias("w")).filter(F.size("w") >= least)
    size = F.least(F.size("w"), F.lit(n))
    return w.select("benchmark", size.alias("size"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.array_join(F.slice("w", i, size), " "))).alias("gram")).groupBy("size", "gram").agg(F.min("benchmark").alias("benchmark"))


def hits(df: DataFrame, items: DataFrame, n: int = NGRAM, least: int = LEAST) -> DataFrame:
    """id, benchmark, gram and at of the first hit of each record: the longest window, then the leftmost.

    The item grams are joined by value; Spark broadcasts them only below its size threshold.
    """
    grams = item_grams(items, n, least)
    sizes = [r.size for r in grams.select("size").distinct().collect()]  # at most n - least + 1
    w = df.select("id", words(comparable()).alias("w"))
    each = None
    for size in sorted(sizes):
        own = w.filter(F.size("w") >= size).select("id", F.lit(size).alias("size"), F.posexplode(_grams(size)).alias("at", "gram"))
        each = own if each is None else each.unionByName(own)
    if each is None:
        return df.select("id", F.lit("").alias("benchmark"), F.lit("").alias("gram"), F.lit(0).alias("at")).limit(0)
    found = each.join(grams, ["size", "gram"])
    best = found.groupBy("id").agg(F.min(F.struct((-F.col("size")).alias("s"), "at", "gram", "benchmark")).alias("b"))
    return best.select("id", "b.benchmark", "b.gram", "b.at")


def _grams(size: int):
    return F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.array_join(F.slice("w", i, size), " "))


def flagged(df: DataFrame, found: DataFrame) -> DataFrame:
    """The records with `flagged` set on those that were hit."""
    ids = found.select("id", F.lit(True).alias("_hit")).distinct()
    return df.join(ids, "id", "left").withColumn("flagged", F.col("flagged") | F.col("_hit").isNotNull()).drop("_hit")
