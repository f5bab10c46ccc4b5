"""String columns with the white space, words and word boundaries of the data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the white space of the data model, as a character class without its brackets.
SPACE = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def blank(c: Column) -> Column:
    return ~text(c).rlike(f"[^{SPACE}]")


def normalize(c: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text(c)), f"[{SPACE}]+", " "))


def words(c: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text(c)), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(w: Column, size: int) -> Column:
    """Distinct runs of `size` words; the whole of a shorter sequence; none of an empty one."""
    runs = F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.array_join(F.slice(w, i, size), " "))
    return F.when(F.size(w) >= size, F.array_distinct(runs)).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))


def half_up(c: Column) -> Column:
    """The nearest whole number of a value that isn't negative, halves up."""
    return F.floor(c + F.lit(0.5))
