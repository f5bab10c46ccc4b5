"""Token estimates as native expressions, and a seam for a real tokenizer."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.text import text
from grainmill.schema import lists

PER_MESSAGE = 4


def _counted(m: Column) -> Column:
    calls = F.coalesce(F.array_join(F.transform(m["tool_calls"], lambda c: text(c["arguments"])), ""), F.lit(""))
    return F.concat(text(m["content"]), text(m["reasoning"]), calls)


def estimated_tokens() -> Column:
    """Four characters a token, and four tokens a message, over all lists of a record."""
    chars = F.aggregate(lists(), F.lit(0), lambda n, m: n + F.length(_counted(m)))
    return (F.size(lists()) * PER_MESSAGE + F.ceil(chars / F.lit(4.0))).cast("int")


def approximate(c: Column) -> Column:
    """3.5 characters a token, none for empty text."""
    return F.ceil(F.length(text(c)) / F.lit(3.5)).cast("long")


def counted_tokens(df: DataFrame, count: Callable[[str], int], column: str = "token_count") -> DataFrame:
    """Tokens by a callable over each message's text, plus four a message, where the column is still null."""

    @F.pandas_udf("int")
    def total(texts: pd.Series) -> pd.Series:
        return pd.Series([sum(count(t) for t in own) + PER_MESSAGE * len(own) for own in texts])

    return df.withColumn(column, F.coalesce(F.col(column), total(F.transform(lists(), _counted))))
