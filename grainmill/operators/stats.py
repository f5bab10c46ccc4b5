"""Dataset analytics as single-pass aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.text import text
from grainmill.operators.quality import score_class
from grainmill.operators.tokens import estimated_tokens
from grainmill.schema import lists

TOKEN_EDGES = (256, 512, 1024, 2048, 4096, 8192)


def counts(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def role_counts(df: DataFrame) -> DataFrame:
    """Messages of each role over all lists."""
    return df.select(F.explode(lists()).alias("m")).groupBy(F.col("m.role").alias("role")).agg(F.count(F.lit(1)).alias("n"))


def token_bucket(tokens: Column) -> Column:
    """The upper edge of a token count's histogram class; null above the last."""
    out = F.lit(None).cast("int")
    for edge in reversed(TOKEN_EDGES):
        out = F.when(tokens <= edge, edge).otherwise(out)
    return out


def token_histogram(df: DataFrame, tokens: Column | None = None) -> DataFrame:
    """Records of each token class, classes without any among them."""
    got = df.select(token_bucket(estimated_tokens() if tokens is None else tokens).alias("edge")).groupBy("edge").agg(F.count(F.lit(1)).alias("n"))
    edges = df.sparkSession.createDataFrame([(e,) for e in (*TOKEN_EDGES, None)], "e int")
    return edges.join(got, F.col("e").eqNullSafe(F.col("edge")), "left").select(F.col("e").alias("edge"), F.coalesce("n", F.lit(0)).alias("n"))


def overview(df: DataFrame) -> DataFrame:
    """One row: records, flagged, reviewed, with reasoning, with tool calls, turns, scores, tokens, tags."""
    some = lambda f: F.count_if(F.exists(lists(), f))
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("flagged").alias("flagged"), F.count_if("reviewed").alias("reviewed"),
        some(lambda m: text(m["reasoning"]) != "").alias("with_reasoning"), some(lambda m: F.size(F.coalesce(m["tool_calls"], F.array())) > 0).alias("with_tool_calls"),
        (F.sum(F.size(lists())) / F.count(F.lit(1))).alias("avg_turns"), F.avg("quality_score").alias("avg_score"),
        F.sum("token_count").alias("tokens"), F.count("token_count").alias("tokenized"), F.sum(estimated_tokens()).alias("estimated_tokens"),
    )


def score_classes(df: DataFrame) -> DataFrame:
    return df.filter("quality_score is not null").groupBy(score_class(F.col("quality_score")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def top_tags(df: DataFrame, most: int = 12) -> DataFrame:
    """The most frequent tags, ties by name."""
    return df.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(most)


def percent_label(n: Column, total: Column) -> Column:
    """Whole percents that say 0 or 100 only where it is so."""
    share = F.lit(100.0) * n / total
    return F.when((total == 0) | (n == 0), "0%").when(share < 1, "<1%").when((share > 99) & (n < total), "99%").otherwise(F.concat(F.floor(share + F.lit(0.5)).cast("int").cast("string"), F.lit("%")))


def dominant_type(df: DataFrame, project_type: str) -> str:
    """The most frequent type; the project's own wins a tie."""
    rows = counts(df, "type").orderBy(F.desc("n"), F.desc(F.col("type") == project_type), "type").limit(1).collect()
    return rows[0].type if rows else project_type
